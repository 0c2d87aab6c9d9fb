"""Text functions as column expressions: tokenizers, names, chunks, predicates, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    """Lower-cased pieces between white space."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def word_tokens(c: Column) -> Column:
    """Runs of letters, digits, underscores and hyphens, of any script."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))


def identifier_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z_][a-z0-9_^]*"), F.lit(0))


def code_tokens(c: Column, stop: list[str]) -> Column:
    """Identifiers with $ and ^, of two characters or more, without the stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"\$?[a-z_^][a-z0-9_^]*"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(stop))


def name_parts(c: Column) -> Column:
    """Parts of an upper-cased identifier between _ and ^, of two characters or more, and the whole."""
    up = F.upper(c)
    return F.concat(F.filter(F.split(up, "[_^]"), lambda p: F.length(p) >= 2), F.array(up))


def variations(word: Column) -> Column:
    """A word, without its trailing s, and with common endings."""
    base = F.when(F.endswith(word, F.lit("s")) & (F.length(word) > 3), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    endings = F.array(*[F.lit(s) for s in ("", "s", "ing", "ed", "ion", "tion", "ment", "er", "or")])
    return F.array_distinct(F.concat(F.array(word), F.transform(endings, lambda s: F.concat(base, s))))


def core_terms(c: Column, stop: list[str]) -> Column:
    return F.filter(tokens(c), lambda w: ~w.isin(stop))


def phrases(c: Column) -> Column:
    """Quoted strings and runs of capitalised words, each once."""
    quoted = F.regexp_extract_all(c, F.lit('"([^"]+)"'), F.lit(1))
    names = F.regexp_extract_all(c, F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"), F.lit(0))
    return F.array_distinct(F.concat(quoted, names))


def is_garbage(c: Column) -> Column:
    """Over 20 % unprintable or over 50 % non-ASCII characters, a NUL or a replacement mark; never under 10 characters."""
    n = F.length(c)
    unprintable = n - F.length(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    foreign = n - F.length(F.regexp_replace(c, r"[^\x00-\x7F]", ""))
    marked = F.contains(c, F.lit("\x00")) | F.contains(c, F.lit("�"))
    return F.when(n < 10, False).otherwise((unprintable > 0.2 * n) | (foreign > 0.5 * n) | marked)


def snippet(c: Column, most: int = 300) -> Column:
    """Whole sentences from the start, up to `most` characters; the first one's beginning if it is longer."""
    sentences = F.filter(F.split(c, r"[.!?]\s+"), lambda s: s != "")
    joined = F.aggregate(
        sentences, F.struct(F.lit("").alias("text"), F.lit(False).alias("full")),
        lambda a, s: F.when(a["full"] | (F.length(a["text"]) + F.length(s) + 2 > most), F.struct(a["text"].alias("text"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(a["text"], s, F.lit(". ")).alias("text"), F.lit(False).alias("full"))),
        lambda a: F.rtrim(a["text"]),
    )
    return F.when(joined == "", F.substring(c, 1, most)).otherwise(joined)


def sentences_with(c: Column, word: str) -> Column:
    return F.filter(F.transform(F.split(c, r"\."), lambda s: F.trim(s)), lambda s: F.contains(F.lower(s), F.lit(word.lower())))


def wildcard(pattern: str) -> str:
    """* and ? of a name pattern as a regular expression; nothing else is escaped, nothing anchored."""
    return pattern.replace("*", ".*").replace("?", ".")


def word_chunks(docs: DataFrame, size: int, overlap: int, least: int = 50) -> DataFrame:
    """(doc_id, chunk_index, start_word, chunk, chunk_id): windows of `size` words every size - overlap ones.

    Chunks of under `least` characters are dropped before they are counted.
    """
    step = size - overlap
    w = docs.select("doc_id", tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = w.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).alias("start_word"))
    cut = starts.select("doc_id", "start_word", F.array_join(F.slice("w", F.col("start_word") + 1, size), " ").alias("chunk")).where(F.length("chunk") >= least)
    nr = F.row_number().over(Window.partitionBy("doc_id").orderBy("start_word")) - 1
    return cut.select("doc_id", nr.alias("chunk_index"), "start_word", "chunk", F.md5("chunk").alias("chunk_id"))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line), from 1."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def line_chunks(docs: DataFrame, size: int, overlap: int, least: int = 50) -> DataFrame:
    """(doc_id, chunk_index, start_line, end_line, chunk): runs of whole lines of about `size` words, by the document's mean of words a line.

    The next chunk starts about `overlap` words, one line at least, before the last one's end, but always after its
    start; none follows the one that ends the document. A chunk of under `least` characters, white space around it left
    out, is dropped, and the next one starts at its end. A text without words has no chunks.
    """
    lines = F.regexp_extract_all("text", F.lit("[^\n]*\n|[^\n]+"), F.lit(0))
    d = docs.select("doc_id", lines.alias("l"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words")).where("words > 0").withColumn("n", F.size("l"))
    of = lambda k: F.greatest(F.lit(1), F.floor(k * F.col("n") / F.col("words")).cast("int"))
    d = d.select("doc_id", "l", "n", of(size).alias("per"), of(overlap).alias("lap"))
    body = lambda start, end: F.array_join(F.slice("l", start + 1, end - start), "")

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        end = F.least(at + F.col("per"), F.col("n"))
        short = F.length(F.regexp_replace(body(at, end), r"^\s+|\s+$", "")) < least
        back = end - F.col("lap")
        after = F.when(short | (end == F.col("n")) | (back <= 0), end).otherwise(F.greatest(back, at + 1))
        more = F.when(short, F.array().cast("array<struct<a:int,b:int>>")).otherwise(F.array(F.struct(at.alias("a"), end.alias("b"))))
        return F.when(at >= F.col("n"), s).otherwise(F.struct(after.alias("at"), F.concat(s["out"], more).alias("out")))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))
    cut = d.select("doc_id", "l", F.posexplode(F.aggregate(F.sequence(F.lit(1), F.col("n")), none, step)["out"]).alias("chunk_index", "c"))
    return cut.select("doc_id", "chunk_index", (F.col("c.a") + 1).alias("start_line"), F.col("c.b").alias("end_line"), body(F.col("c.a"), F.col("c.b")).alias("chunk"))
