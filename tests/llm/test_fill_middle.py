import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sparquill.llm import fill_middle as op
from sparquill.llm.common import read

DOCS = "doc_id long, text string"


def brute(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(op.UNITS, text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    psm = h4 % 100 >= spm_rate
    return len(units), "psm" if psm else "spm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}" if psm else f"<S>{suffix}<P>{prefix}<M>{middle}"


def got(df):
    return sorted([(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in df.collect()], key=str)


def test_whole_table_and_rebuilt_texts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = op.fill_middle(docs)
    assert got(found) == sorted([(r.doc_id, r.text, *brute(*r)) for r in docs.collect()], key=str)
    assert found.where(~op.rebuilt(op.F.col("output"), op.F.col("form")).eqNullSafe(op.F.coalesce("text", op.F.lit("")))).count() == 0


def test_nulls_marks_repeats_long_texts_and_clashing_columns(spark):
    texts = [None, "", "\n", "\n\n", "one line", "a\nb\nc\n", "a\nb\nc\n", "a\nb\nc\n", "has <S> in it\n", "<\nP>", "\U0001f600\né\r\nx\x00\n", "l\n" * 50000, "y" * 200000, "<P\n<S\n<M\n"]
    ids = [1, None, 3, 4, 5, 6, 6, None, 8, 9, 10, 11, None, 13]
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in zip(ids, texts, strict=True)], DOCS + ", n int, key string").repartition(3)
    found = op.fill_middle(docs)
    assert found.columns == ["doc_id", "text", "key", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert got(found) == sorted([(d, t, *brute(d, t)) for d, t in zip(ids, texts, strict=True)], key=str)
    assert found.where(~op.rebuilt(op.F.col("output"), op.F.col("form")).eqNullSafe(op.F.coalesce("text", op.F.lit("")))).count() == 0
    assert op.fill_middle(spark.createDataFrame([], DOCS)).count() == 0
    some = op.fill_middle(docs, rate=40, spm_rate=10)
    assert got(some) == sorted([(d, t, *brute(d, t, 40, 10)) for d, t in zip(ids, texts, strict=True)], key=str)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.text("<PSM>\naé\U0001f600", max_size=25)), min_size=1, max_size=30))
def test_any_text_is_rebuilt(spark, rows):
    found = op.fill_middle(spark.createDataFrame(rows, DOCS))
    assert got(found) == sorted([(d, t, *brute(d, t)) for d, t in rows], key=str)
    assert found.where(~op.rebuilt(op.F.col("output"), op.F.col("form")).eqNullSafe(op.F.col("text"))).count() == 0
