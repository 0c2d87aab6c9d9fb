"""Keywords that texts have nearly: by the share of longest matching blocks, behind a filter join that loses no pair.

The share of matching blocks of two words is at most that of the characters they have in common, counted as often as
both have them. So words over the cutoff share one of the first few of their numbered characters, if both are
sorted alike and as many are taken as the cutoff lets differ; only words that meet there are compared. Distinct
words are compared, once for the whole corpus.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.sources.shared import stored

#: Frequent letters last, so that words meet at rare ones; all other characters come before these.
ORDER = "zqxjkvbpygfwmucldrhsnioate"
WORD = r"(?U)\w{3,}"
LEAST, ALIKE = 5, 0.7  # characters of a keyword; share of the shorter length in the longer, which must be exceeded


def numbered(word: Column) -> Column:
    """A word's characters, each with how many equal ones have come, as sorted strings."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    rank = lambda c: F.lpad(F.position(c, F.lit(ORDER)).cast("string"), 2, "0")
    return F.array_sort(F.transform(chars, lambda c, k: F.concat(rank(c), c, F.size(F.filter(F.slice(chars, 1, k + 1), lambda x: x == c)).cast("string"))))


def _prefix(word: Column, cutoff: float) -> Column:
    """As many of the sorted characters as two words over the cutoff can't all differ in: the other one is at least so
    long, and so many characters must be shared."""
    n = F.length(word)
    other = F.ceil(n * (cutoff / (2 - cutoff)) - 1e-9)
    shared = F.ceil((n + other) * (cutoff / 2) - 1e-9)
    return F.slice(numbered(word), F.lit(1), F.greatest(n - shared + 1, F.lit(1)).cast("int"))


@F.arrow_udf(T.DoubleType())
def _blocks(keywords: pa.Array, words: pa.Array) -> pa.Array:
    matcher, out, last = SequenceMatcher(), [], None
    for keyword, word in zip(keywords.to_pylist(), words.to_pylist(), strict=True):
        if keyword != last:
            matcher.set_seq2(keyword)
            last = keyword
        matcher.set_seq1(word)
        out.append(matcher.ratio())
    return pa.array(out, pa.float64())


def similar_words(words: DataFrame, keywords: DataFrame, cutoff: float) -> DataFrame:
    """(keyword, word, ratio): the pairs of distinct words and keywords whose ratio of matching blocks is the cutoff, above 0, or more."""
    longest = keywords.agg(F.max(F.length("keyword"))).first()[0] or 0
    left = keywords.select("keyword").distinct().select("keyword", F.explode(_prefix(F.col("keyword"), cutoff)).alias("at"))
    some = words.select("word").where((F.length("word") > 0) & (F.length("word") <= longest * (2 - cutoff) / cutoff + 1e-9)).distinct()
    right = some.select("word", F.explode(_prefix(F.col("word"), cutoff)).alias("at"))
    a, b = F.length("keyword"), F.length("word")
    met = left.join(right, "at").where(2 * F.least(a, b) >= (a + b) * cutoff - 1e-9).select("keyword", "word").distinct()
    common = F.size(F.array_intersect(numbered(F.col("keyword")), numbered(F.col("word"))))
    near = met.where(2 * common >= (a + b) * cutoff - 1e-9)
    return near.withColumn("ratio", _blocks("keyword", "word")).where(F.col("ratio") >= cutoff)


def fuzzy_keywords(docs: DataFrame, keywords: DataFrame, cutoff: float) -> DataFrame:
    """(doc_id, keyword, word, ratio): keywords (keyword, in any case) of five characters or more with the word of each text that is nearest.

    Words are runs of three or more letters, digits and underscores, in lower case. Of equal ratios the last word in
    order counts. A keyword counts where its nearest word reaches the cutoff and their lengths are alike. Rows with
    equal doc_id are one document; null texts have no words.
    """
    known = keywords.select(F.lower(F.trim("keyword")).alias("keyword")).where(F.length("keyword") >= LEAST).distinct()
    at = stored(docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("word")).distinct())
    pairs = stored(similar_words(at, known, cutoff))
    best = at.join(pairs, "word").groupBy("doc_id", "keyword").agg(F.max(F.struct("ratio", "word")).alias("m")).select("doc_id", "keyword", "m.word", "m.ratio")
    a, b = F.length("keyword"), F.length("word")
    return best.where(F.least(a, b) / F.greatest(a, b) > ALIKE)
