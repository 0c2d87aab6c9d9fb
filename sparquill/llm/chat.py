"""Chat formatting checked by a grammar round trip, in built-in functions only.

Grammar of a rendered conversation: turn*; turn = "<s>[" role "]" flag newline text "</s>", where flag is empty
for content as it is and a backslash for escaped content. The parser cuts at "</s>", takes the role up to the
first "]" and the text after the first newline. Each turn is rendered as it is and parsed again; if role or text
are not what they were, they are escaped, which leaves no "<", "]" or newline for the parser to stumble on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.llm.common import read

OPEN, ROLE_END, CLOSE = "<s>[", "]", "</s>"
#: Escapes, in the order that they are applied: a backslash first.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("]", "\\r")]
PROBE = "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _head(role: Column, flag: str) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(f"{ROLE_END}{flag}\n"))


def parse(rendered: Column) -> Column:
    """array<struct<role, text, body>> of a rendered string; body is the text as it stands there.

    Null where the string is not of the grammar.
    """
    parts = F.split(rendered, f"\\Q{CLOSE}\\E", -1)

    def turn(part: Column) -> Column:
        at = F.instr(part, ROLE_END)
        raw = F.substring(part, F.lit(len(OPEN) + 1), at - (len(OPEN) + 1))
        rest = F.substring(part, at + 1, F.length(part))
        escaped = F.startswith(rest, F.lit("\\\n"))
        good = F.startswith(part, F.lit(OPEN)) & (at > 0) & (escaped | F.startswith(rest, F.lit("\n")))
        body = F.substring(rest, F.when(escaped, 3).otherwise(2), F.length(rest))
        own = F.struct(F.when(escaped, unescape(raw)).otherwise(raw).alias("role"), F.when(escaped, unescape(body)).otherwise(body).alias("text"), body.alias("body"))
        return F.when(good, own)

    turns = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), turn)
    ended = F.element_at(parts, -1) == ""
    return F.when(ended & ~F.exists(turns, lambda t: t.isNull()), turns)


def render(role: Column, text: Column) -> tuple[Column, Column]:
    """Head and body of a turn: as they are if that parses back to the same turn, else escaped."""
    plain = F.concat(_head(role, ""), text, F.lit(CLOSE))
    back = parse(plain)
    same = F.coalesce((F.size(back) == 1) & (F.get(back, F.lit(0))["role"] == role) & (F.get(back, F.lit(0))["text"] == text), F.lit(False))
    return F.when(same, _head(role, "")).otherwise(_head(escape(role), "\\")), F.when(same, text).otherwise(escape(text))


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, parsed, loss_spans, identical for the turns (conv_id, turn, role, text).

    Turns are in order of turn (nulls first), ties by role, then text; null roles and texts are empty. parsed is
    what the parser reads from formatted; loss_spans are the (start, length) in code points, from 0, of the
    bodies of the trained role, in order; identical tells that parsed equals the source. Each turn is rendered,
    and its place found, as a row of its own; a conversation's rows meet once, as its one string must. Null
    conv_ids form one conversation. An empty table gives an empty result; other columns are left out, whatever their
    names.
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    head, body = render(F.col("role"), F.col("text"))
    rows = rows.select("*", head.alias("head"), body.alias("body"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    size = F.length("head") + F.length("body") + len(CLOSE)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    rows = rows.select("conv_id", F.row_number().over(order).alias("nr"), "role", "text", F.concat("head", "body", F.lit(CLOSE)).alias("out"), (before + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))
    one = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nr", "role", "text", "out", "start", "length"))).alias("t"))
    formatted = F.array_join(F.col("t")["out"], "")
    spans = F.transform(F.filter("t", lambda t: t["role"] == trained), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    one = one.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"), F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    parsed = one.withColumn("parsed", parse(F.col("formatted")))
    back = F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return parsed.select("conv_id", "formatted", "parsed", "loss_spans", F.coalesce(back == F.col("source"), F.lit(False)).alias("identical"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    done = format_chats(turns.unionByName(probe))
    recovered = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # The mask is read as a trainer would: by its spans from the formatted string; the parsed turn tells if a span is escaped.
    masked = F.transform("loss_spans", lambda s: F.substring("formatted", s["start"].cast("int") + 1, s["length"].cast("int")))
    plain = F.transform(F.filter("parsed", lambda t: t["role"] == "assistant"), lambda t: t["body"] != t["text"])
    loss = F.array_join(F.zip_with(masked, plain, lambda m, escaped: F.when(escaped, unescape(m)).otherwise(m)), "")
    done = done.select("conv_id", F.size("parsed").cast("long").alias("n_turns"), recovered.alias("recovered"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return done.select("conv_id", "n_turns", sha("recovered").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha("loss").alias("loss_sha256"), "formatted_chars")


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, contains(role, ']') OR contains(role, '</s>') OR contains(text, '</s>') AS esc,
    replace(replace(replace(role, '\', '\b'), '<', '\l'), ']', '\r') AS erole,
    replace(replace(replace(text, '\', '\b'), '<', '\l'), ']', '\r') AS etext FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(10 + CASE WHEN esc THEN 1 + length(erole) + length(etext) ELSE length(role) + length(text) END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

