"""Fill-in-middle by relational units.

The units of all texts are rows (posexplode), their ends a running sum in a window. Each document asks for two
cuts by a unit's ordinal; the requests join the units, the two offsets come together again per document, and the
text is cut by substring. Only lengths travel until then, and a text meets its offsets in one join, in which the
copies of a frequent row are dealt by a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.llm.common import content_key, fresh, read, row_key, spread_join, stored, text_of

UNITS = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
RATE, SPM_RATE = 100, 50  # percent of the texts that are transformed, and of those in the order suffix, prefix, middle
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from a document's id; a null id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cuts(docs: DataFrame, units: str = UNITS, seed: int = SEED) -> DataFrame:
    """One row for each distinct (doc_id, text): key, copies (rows that have it), n (units), first_end and second_end,
    the code points before the two cuts."""
    found = docs.select("doc_id", content_key().alias("key"), F.regexp_extract_all(text_of(), F.lit(units), F.lit(0)).alias("units"))
    found = found.select("doc_id", "key", F.posexplode_outer("units").alias("pos", "unit"))
    # Copies of a row are one document with equal units, combined before they are dealt.
    each = found.groupBy("key", "pos").agg(F.max("doc_id").alias("doc_id"), F.max(F.length("unit")).alias("length"), F.count("*").alias("copies"))
    document = Window.partitionBy("key")
    each = stored(each.select("key", "pos", "doc_id", "copies", F.count("pos").over(document).alias("n"), F.sum("length").over(document.orderBy("pos")).alias("end")))
    h1, h2, *_ = draws(F.col("doc_id"), seed)
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    both = [F.struct(F.lit(k).alias("cut"), cut.alias("ordinal")) for k, cut in ((1, F.least(one, two)), (2, F.greatest(one, two)))]
    asked = each.where("pos IS NULL OR pos = n - 1").select("key", "copies", "n", F.inline(F.array(*both)))
    met = asked.join(each.select("key", (F.col("pos") + 1).cast("long").alias("ordinal"), "end"), ["key", "ordinal"], "left")
    offset = [F.coalesce(F.max(F.when(F.col("cut") == k, F.col("end"))), F.lit(0)).alias(name) for k, name in ((1, "first_end"), (2, "second_end"))]
    return met.groupBy("key").agg(F.max("copies").alias("copies"), F.max("n").alias("n"), *offset)


def rebuilt(output: Column, form: Column) -> Column:
    """The text from an output and its form. The marks are found, as no text that has them is transformed."""
    def at(mark: str) -> Column:
        return F.locate(mark, output)

    def between(start: Column, stop: Column) -> Column:
        return F.substring(output, start + 3, stop - start - 3)

    p, s, m = at(PREFIX), at(SUFFIX), at(MIDDLE)
    end = F.length(output) + 1
    psm = F.concat(between(p, s), between(m, end), between(s, m))
    spm = F.concat(between(p, m), between(m, end), between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_middle(docs: DataFrame, units: str = UNITS, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs (doc_id, text, any other columns) with n, form, prefix_chars, middle_chars and output.

    A null text is the empty one: no units, form plain, output empty. A text that has a mark stays plain. Rows with
    equal id and text get equal outputs, rows with equal ids alone the same draws. Columns of docs that are named as
    the added ones are replaced. An empty table gives an empty result.
    """
    docs = docs.drop(*ADDED)
    key, copies, n, first, second, salt = fresh(docs, "key", "copies", "units", "first_end", "second_end", "row")
    offsets = stored(cuts(docs.select("doc_id", "text"), units, seed).toDF(key, copies, n, first, second))
    total = offsets.agg(F.sum(copies)).first()[0] or 0
    met = spread_join(docs.withColumn(key, content_key()).withColumn(salt, row_key()), offsets, key, copies, salt, total)
    text = text_of()
    _, _, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    out = met.withColumn("form", form)
    prefix, middle = F.substring(text, F.lit(1), F.col(first)), F.substring(text, F.col(first) + 1, F.col(second) - F.col(first))
    suffix = F.substring(text, F.col(second) + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    plain = F.col("form") == "plain"
    return out.select(
        *docs.columns, F.col(n).alias("n"), "form",
        F.when(~plain, F.col(first)).alias("prefix_chars"), F.when(~plain, F.col(second) - F.col(first)).alias("middle_chars"),
        F.when(plain, text).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2(c, 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (rebuilt(F.col("output"), F.col("form")), "restored_sha256"))]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, CASE WHEN t = '' THEN [] ELSE regexp_extract_all(t, '[^\n]*\n|[^\n]+') END AS us,
             [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN [0, 1, 2, 3]] AS hs FROM t),
c AS (SELECT *, len(us)::BIGINT AS n, hs[1] % (len(us) + 1) AS x, hs[2] % (len(us) + 1) AS y FROM u),
e AS (SELECT *, length(array_to_string(us[1:least(x, y)], '')) AS i, length(array_to_string(us[1:greatest(x, y)], '')) AS j FROM c),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 100 THEN 'plain'
                     WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || substr(t, 1, i) || '<S>' || substr(t, j + 1) || '<M>' || substr(t, i + 1, j - i)
                        ELSE '<S>' || substr(t, j + 1) || '<P>' || substr(t, 1, i) || '<M>' || substr(t, i + 1, j - i) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
