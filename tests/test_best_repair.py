import random
import time

from sparquill.operators import mining as op

ASKED = "key long, entity string, message string"
KNOWN = "id long, entity string, field string, message string, score double"


def test_best_repair_like_brute_force(spark):
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", "".join(rng.choice("aAbß€") for _ in range(rng.randrange(1, 7)))])
    asked = [(k % 150, rng.choice(["x", "y", None]), text()) for k in range(200)]
    known = [(k, rng.choice(["x", "y", None]), "f", text(), rng.choice([None, 0.4, 0.5, 0.9])) for k in range(60)]
    want = {}
    for key, entity, message in asked:
        for i, e, _, m, score in known:
            if None not in (entity, message, m, score) and e == entity and score >= 0.5 and (m.lower() in message.lower() or message.lower() in m.lower()):
                want[key] = min(want.get(key, (0, 1 << 40)), (-score, i))
    got = {r.key: (-r.score, r.id) for r in op.best_repair(spark.createDataFrame(asked, ASKED), spark.createDataFrame(known, KNOWN)).collect()}
    assert got == want and want


def test_best_repair_compares_no_copies(spark):
    """40,000 messages by 40,000 repairs of one entity: 1.6 billion pairs of rows, but few different texts."""
    asked = spark.range(40_000).selectExpr("id AS key", "'e' AS entity", "concat('red widget ', id % 20) AS message")
    known = spark.range(40_000).selectExpr("id", "'e' AS entity", "'f' AS field", "concat('widget ', id % 20) AS message", "0.5D + id % 5 / 10D AS score")
    began = time.perf_counter()
    got = op.best_repair(asked, known).selectExpr("count(*) AS n", "count(DISTINCT key) AS keys").first()
    assert (got.n, got.keys) == (40_000, 40_000) and time.perf_counter() - began < 40
