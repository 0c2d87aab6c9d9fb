"""Texts of `documents` as procedures, passages of `benchmark` as a taxonomy; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.operators import capabilities as op
from sparquill.sources.tables import table


def _procedures(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    w = F.filter(F.split("body", r"\s+"), lambda x: x != "")
    t = t.withColumn("w", w)
    return t.select(F.col("doc_id").alias("id"), F.array_join(F.slice("w", 1, 3), "_").alias("name"), "body", F.slice("w", 4, 2).alias("calls"), (F.col("doc_id") % 7 == 0).alias("utility"), F.least(F.length("body") / 500, F.lit(10.0)).alias("complexity"))


def _taxonomy(spark, d):
    w = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    b = table(spark, d, "benchmark").select("item_id", w.alias("w")).where(F.size("w") >= 8)
    return b.select(F.col("item_id").alias("entry"), F.concat(F.lit("d"), (F.col("item_id") % 12).cast("string")).alias("domain"), F.array(F.concat_ws("_", F.get("w", F.lit(0)), F.get("w", F.lit(1))), F.get("w", F.lit(2))).alias("capabilities"),
                    F.array(F.get("w", F.lit(3)), F.concat_ws(" ", F.get("w", F.lit(4)), F.get("w", F.lit(5)))).alias("primary"), F.array(F.get("w", F.lit(6)), F.get("w", F.lit(7))).alias("related"))


def capability_matches(spark, d):
    return op.match(_procedures(spark, d), _taxonomy(spark, d)).withColumn("capabilities", F.array_join("capabilities", ","))


def capability_names(spark, d):
    return op.direct_matches(_procedures(spark, d), _taxonomy(spark, d)).withColumn("score", F.round("score", 6))


def capability_code(spark, d):
    return op.code_matches(_procedures(spark, d), _taxonomy(spark, d))


def capability_keywords(spark, d):
    words = _procedures(spark, d).select("id", F.explode(F.concat("calls", op.name_words(F.col("name")))).alias("keyword"))
    return op.keyword_capabilities(words, _taxonomy(spark, d))


WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"
# Names are matched once each: nm are the distinct ones with their words, cw the capabilities with theirs.
BASE = f"""p AS (SELECT doc_id AS id, array_to_string(w[1:3], '_') AS name, lower(array_to_string(w[1:3], '_')) AS low, body, w[4:5] AS calls, doc_id % 7 = 0 AS utility, least(length(body) / 500, 10.0) AS complexity FROM (SELECT doc_id, coalesce(text, '') AS body, {WORDS.format("coalesce(text, '')")} AS w FROM documents)),
x AS (SELECT item_id AS entry, 'd' || item_id % 12 AS domain, [w[1] || '_' || w[2], w[3]] AS caps, [w[4], w[5] || ' ' || w[6]] AS pri, [w[7], w[8]] AS rel FROM (SELECT item_id, {WORDS.format('lower(text)')} AS w FROM benchmark) WHERE len(w) >= 8),
k AS (SELECT entry, caps, unnest(pri) AS kw, true AS main FROM x UNION ALL SELECT entry, caps, unnest(rel), false FROM x),
im AS (SELECT kw, (SELECT max(c) FROM (SELECT count(*) AS c FROM k GROUP BY kw)) / count(*) AS im FROM k GROUP BY kw),
dm AS (SELECT cap, count(DISTINCT domain) AS n, 1 / (1 + count(DISTINCT domain)) AS spec FROM (SELECT domain, unnest(caps) AS cap FROM x) GROUP BY cap),
cw AS (SELECT cap, unnest(string_split(replace(lower(cap), ' ', '_'), '_')) AS w FROM dm),
sk AS (SELECT *, CASE WHEN utility AND complexity < 2 THEN 'utility' WHEN length(body) < 100 AND contains(lower(body), 'return') OR length(body) < 500 AND (SELECT coalesce(sum(CAST(contains(lower(p.body), t) AND contains(array_to_string(list_concat(pri, rel), ','), t) AS INT)), 0) FROM x, (VALUES {', '.join(f"('{t}')" for t in op.GENERAL)}) g(t)) > 3 THEN 'noise' END AS reason FROM p)"""
NAMES = f"""nm AS (SELECT DISTINCT low, {WORDS.format("replace(low, '_', ' ')")} AS ws FROM a),
nw AS (SELECT low, unnest(ws) AS w FROM nm),
kk AS (SELECT kw, {WORDS.format("replace(kw, '_', ' ')")} AS ws FROM im),
hit AS (SELECT low, kw FROM nm, kk WHERE contains(low, kw) OR ((len(kk.ws) > 1 OR len(kk.ws[1]) > 3) AND len(list_filter(kk.ws, lambda q: len(list_filter(nm.ws, lambda v: contains(v, q) OR contains(q, v))) > 0)) = len(kk.ws))),
al AS (SELECT low, cap, sum(CASE WHEN nw.w = cw.w THEN 3.0 ELSE 1.5 END) AS s FROM nw JOIN cw ON length(cw.w) > 2 AND (contains(nw.w, cw.w) OR contains(cw.w, nw.w)) GROUP BY ALL),
ow AS (SELECT kw, unnest(caps) AS cap, CASE WHEN main THEN 2.0 ELSE 1.0 END AS wt FROM k),
di AS (SELECT a.id, cap, round(sum(s), 9) AS score FROM a JOIN (SELECT low, cap, wt * im AS s FROM hit JOIN ow USING (kw) JOIN im USING (kw) UNION ALL SELECT low, cap, s FROM al) USING (low) GROUP BY a.id, cap HAVING round(sum(s), 9) >= 2)"""
CODE = """tx AS (SELECT id, low, lower(body || ' ' || array_to_string(calls, ' ')) AS t, lower(array_to_string(calls, chr(10))) AS c FROM a WHERE NOT (length(body) < 200 AND regexp_matches(low, '^(add_|log_|format_|get_|set_)'))),
fd AS (SELECT id, low, entry, caps, kw, CASE WHEN main THEN CASE WHEN contains(c, kw) THEN 3.0 ELSE 1.0 END ELSE CASE WHEN contains(c, kw) THEN 1.0 ELSE 0.25 END END * im AS s FROM tx JOIN k ON contains(t, kw) JOIN im USING (kw)),
tt AS (SELECT id, low, entry, round(sum(s), 9) AS total, list(kw) AS ks, any_value(caps) AS caps FROM fd GROUP BY ALL HAVING round(sum(s), 9) >= 2),
ec AS (SELECT id, low, entry, total, ks, unnest(list_distinct(caps)) AS cap FROM tt),
ti AS (SELECT kw, cap, sum(CASE WHEN q.w = cw.w THEN 1.5 ELSE 1.0 END) AS s FROM (SELECT kw, unnest(string_split(replace(kw, ' ', '_'), '_')) AS w FROM im) q JOIN cw ON length(q.w) > 2 AND cw.w <> '' AND (contains(q.w, cw.w) OR contains(cw.w, q.w)) GROUP BY ALL),
ts AS (SELECT id, entry, cap, sum(s) AS s FROM (SELECT id, entry, cap, unnest(ks) AS kw FROM ec) JOIN ti USING (kw, cap) GROUP BY ALL),
co AS (SELECT DISTINCT ec.id, ec.cap FROM ec LEFT JOIN ts USING (id, entry, cap) LEFT JOIN al ON al.low = ec.low AND al.cap = ec.cap JOIN dm ON dm.cap = ec.cap
  WHERE round(coalesce(ts.s, 0) + coalesce(al.s, 0) * 4 / 3 + 3 * spec, 9) >= CASE WHEN total > 8 THEN 1.8 WHEN total > 5 THEN 2.4 ELSE 3.6 END)"""
SQL = {
    "capability_names": f"WITH {BASE}, a AS (FROM p), {NAMES} SELECT id, cap AS capability, round(score, 6) AS score FROM di",
    "capability_code": f"WITH {BASE}, a AS (FROM p), {NAMES}, {CODE} SELECT id, cap AS capability FROM co",
    "capability_matches": f"""WITH {BASE}, a AS (FROM sk WHERE reason IS NULL), {NAMES}, {CODE},
f AS (SELECT id, cap, max(n) AS by_name FROM (SELECT id, cap, 1 AS n FROM di UNION ALL SELECT id, cap, 0 FROM co) GROUP BY ALL),
r AS (SELECT id, cap, complexity, row_number() OVER (PARTITION BY id ORDER BY spec DESC, cap) AS place FROM f JOIN a USING (id) JOIN dm USING (cap) WHERE (by_name = 1 OR complexity >= CASE WHEN spec > 0.5 THEN 0.3 ELSE 0.6 END) AND (complexity >= 2 OR n <= 5)),
g AS (SELECT id, string_agg(cap, ',' ORDER BY cap) AS caps FROM r WHERE place <= greatest(3, floor(complexity)) GROUP BY id),
d1 AS (SELECT id, count(*) AS n FROM di GROUP BY id), c1 AS (SELECT id, count(*) AS n, sum(spec) AS s FROM co JOIN dm USING (cap) GROUP BY id)
SELECT id, reason, coalesce(caps, '') AS capabilities, coalesce(d1.n, 0) AS direct, coalesce(c1.n, 0) AS code, CASE WHEN reason IS NULL THEN round(least(least(0.4 * coalesce(d1.n, 0), 0.8) + least(0.3 * coalesce(c1.s, 0), 0.6) + least(greatest(complexity - 3, 0) * 0.1, 0.2), 1.0), 3) ELSE 0 END AS confidence
FROM sk LEFT JOIN g USING (id) LEFT JOIN d1 USING (id) LEFT JOIN c1 USING (id)""",
    "capability_keywords": f"WITH {BASE}, o AS (SELECT DISTINCT kw, unnest(caps) AS cap FROM k), v AS (SELECT DISTINCT id, lower(unnest(list_concat(calls, {WORDS.format(chr(34) + 'nn' + chr(34))}))) AS kw FROM (SELECT *, replace(low, '_', ' ') AS nn FROM p)) SELECT id, cap AS capability, count(*) AS n FROM v JOIN o USING (kw) GROUP BY ALL",
}

QUERIES = {f.__name__: f for f in (capability_matches, capability_names, capability_code, capability_keywords)}
