import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparquill.llm import near_dedup
from sparquill.llm.common import read

DOCS = "doc_id long, text string"


def brute(rows, radius=2, k=3):
    prints = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, p, low.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    assert got(near_dedup.near_duplicates(docs)) == brute([tuple(r) for r in docs.collect()])


def test_query_names_and_types(spark, sf_dir):
    out = near_dedup.op3_simhash_near_dedup(spark, sf_dir)
    assert out.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert all(len(r.fingerprint) == 16 for r in out.collect())


def test_nulls_empty_short_ties_and_repeated_rows(spark):
    rows = [(5, None), (4, ""), (3, " \t"), (None, "A b"), (2, "a B"), (2, "a b"), (1, "x"), (9, "É é É"), (8, "é é é"), (7, "word " * 30000), (None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    assert got(near_dedup.near_duplicates(docs)) == brute(rows)
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_filter_keeps_one_of_each_component_and_all_columns(spark):
    rows = [(1, "a b c d", 7), (2, "A b c D", 8), (2, "A b c D", 8), (3, "other words are here", 9), (3, "other words are here", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    out = near_dedup.near_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [rows[0], rows[3]]


def test_filter_keeps_one_row_of_each_component_with_null_and_repeated_ids(spark):
    rows = [(None, "one text of its own"), (None, "quite another piece of writing"), (4, "first words under a repeated id"), (4, "second and different words there"), (4, "First words under a repeated id"),
            (7, "shared by a null id and seven"), (None, "shared by a null id and seven"), (None, "null twice here and nowhere else"), (None, "null twice here and nowhere else")]
    out = sorted(map(tuple, near_dedup.near_dedup(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert out == sorted([rows[0], rows[1], rows[3], rows[4], rows[5], rows[7]], key=str)


@pytest.mark.parametrize("group,tile,finer", [(32768, 4096, 8192), (32768, 4096, 20), (8, 4, 20), (1, 16, 1)])
def test_links_of_dense_groups(spark, group, tile, finer):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in centres:
        at = int(c)
        for _ in range(150):
            at = (int(c) if rng.random() < 0.5 else at) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
            prints.add(at)
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fingerprint long")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in near_dedup.links(df, 2, group, tile, finer).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in edges)

    def parts(pairs):
        root = {p: p for p in prints}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for p in prints:
            out.setdefault(find(p), []).append(p)
        return sorted(out.values())

    assert parts(edges) == parts([(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])
    assert len(edges) <= 3 * 65 * len(prints)


def test_components_of_a_long_chain(spark):
    from sparquill.llm.components import components

    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = {r.node: r.root for r in components(edges).collect()}
    assert out == {k: 1 for k in range(2, 201)}


def test_components_of_hubs_chains_and_pairs_are_those_of_union_find(spark, monkeypatch):
    """Hubs of most edges, with the join's broadcast of frequent nodes and without."""
    from sparquill.llm import common, components

    rng = np.random.default_rng(11)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 4000, (900, 2))} | {(5000, k) for k in range(5001, 7000)} | {(k, 7000) for k in range(6990, 6999)}
    root = {n: n for e in edges for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {n: find(n) for n in root if find(n) != n}
    df = spark.createDataFrame(list(edges), "a long, b long")
    for hot in (10, 10**9):
        monkeypatch.setattr(components, "spread_join", lambda *args: common.spread_join(*args, hot=hot))  # noqa: B023
        assert {r.node: r.root for r in components.components(df).collect()} == want


def test_a_join_with_a_frequent_key_spreads_its_rows(spark):
    """Two thirds of all rows have one key: they are dealt over partitions, and the result is that of a plain join."""
    from sparquill.llm.common import spread_join

    rows = spark.range(0, 9000).select(F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("salt"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("salt").alias("most"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = spread_join(rows, table, "k", "n", "salt", 9000, 100)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 1.3 * 9000 / 4
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, rows.join(table, "k").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept[0])
        spark.conf.set("spark.sql.adaptive.enabled", kept[1])


@pytest.mark.parametrize("radius", [1, 2, 3, 6])
def test_finer_keys_lose_no_pair_and_part_the_rest(spark, radius):
    rng = np.random.default_rng(radius)
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    rows = []
    for _ in range(300):
        block = int(rng.integers(radius + 1))
        free = [k for k in range(64) if not cuts[block] <= k < cuts[block + 1]]
        a = int(rng.integers(0, 1 << 63, dtype=np.uint64)) << 1 | int(rng.integers(2))
        b = a
        for k in rng.choice(free, int(rng.integers(radius + 1)), replace=False):
            b ^= 1 << int(k)
        rows.append((block, *(int(np.uint64(x).view(np.int64)) for x in (a, b))))
    df = spark.createDataFrame(rows, "block int, a long, b long")
    key = lambda c: F.get(near_dedup.block_keys(F.col(c), radius), F.col("block"))
    finer = lambda c: near_dedup.finer_keys(key(c), F.col(c), radius)
    got = df.select(F.arrays_overlap(finer("a"), finer("b")).alias("met"), F.size(finer("a")).alias("n"), (key("a") == key("b")).alias("same")).collect()
    assert all(r.met and r.n == radius + 1 and r.same for r in got)
    assert df.select(F.explode(finer("a")).alias("k")).distinct().count() > 250 * (radius + 1) * 0.5


def test_a_block_value_of_half_the_rows_is_cut(spark):
    rng = np.random.default_rng(11)
    low = rng.integers(0, 1 << 43, 6_000, dtype=np.uint64) << np.uint64(21)  # one value in the lowest 21 bits
    rest = rng.integers(0, 1 << 63, 6_000, dtype=np.uint64)
    prints = np.unique(np.r_[low, rest, low[:50] ^ np.uint64(1 << 30)])
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fingerprint long")
    found = near_dedup.links(df, 2, finer=500)
    edges = {frozenset(x % (1 << 64) for x in r) for r in found.collect()}
    assert {frozenset((int(x), int(x ^ np.uint64(1 << 30)))) for x in low[:50]} <= edges
    keyed = df.select(F.explode(near_dedup.block_keys(F.col("fingerprint"), 2)).alias("g"), "fingerprint")
    hot = keyed.groupBy("g").count().where("count > 500").join(keyed, "g")
    most = hot.select(F.explode(near_dedup.finer_keys(F.col("g"), F.col("fingerprint"), 2)).alias("k")).groupBy("k").count().agg(F.max("count")).first()[0]
    assert hot.count() > 5_000 and most < 60
