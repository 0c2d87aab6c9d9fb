"""Queries on repairs of nested payments, which are made of customers, with their SQL over DuckDB's own JSON tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.functions import json
from sparquill.operators import repair_features, repairs
from sparquill.sources.tables import dealt, table

_K = "c_custkey"
_BIC = f"CASE WHEN {_K} % 4 <> 0 THEN concat('DEUT', CASE WHEN {_K} % 3 = 0 THEN 'US' ELSE 'DE' END, 'FF', CASE WHEN {_K} % 5 = 0 THEN 'XXX' ELSE '' END) END"
_COUNTRY = f"CASE WHEN {_K} % 3 = 0 THEN 'US' WHEN {_K} % 3 = 1 THEN 'de' END"
_MEMBER = f"CASE WHEN {_K} % 5 <> 1 THEN CAST({_K} AS VARCHAR(20)) END"
_STREET = f"CASE WHEN {_K} % 4 > 0 THEN concat(CAST({_K} % 300 AS VARCHAR(20)), ' Main Street ', c_mktsegment) END"
_TEXT = "concat(c_mktsegment, ' ', c_name, ' ', c_mktsegment, ' ', c_name)"
#: Keys are in order, as VARIANT keeps no other.
PAYMENT = {
    "cdtrAcct": {"Ccy": f"CASE {_K} % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' END", "Id": {"IBAN": f"CASE WHEN {_K} % 3 <> 2 THEN concat('GB82 WEST', CAST({_K} AS VARCHAR(20)), '12345698') END"}, "Tp": "CASE WHEN c_nationkey % 2 = 0 THEN 'IBAN' ELSE 'Othr' END"},
    "cdtrAgt": {"FinInstnId": {"BIC": _BIC, "ClrSysMmbId": {"ClrSysId": {"Cd": f"CASE {_K} % 3 WHEN 0 THEN 'USABA' WHEN 1 THEN 'FEDWIRE' ELSE 'x' END"}, "MmbId": _MEMBER}, "Nm": f"CASE WHEN {_K} % 6 <> 5 THEN concat(c_name, CASE WHEN {_K} % 2 = 0 THEN ' BANK N.A.' ELSE '' END) END", "PstlAdr": {"AdrLine": [_STREET, f"concat('PO BOX ', CAST({_K} AS VARCHAR(20)))", _TEXT], "Ctry": _COUNTRY}}},
    "clearing": "CASE c_nationkey % 4 WHEN 0 THEN 'CHIPS' WHEN 1 THEN 'fed' WHEN 2 THEN 'SWIFT' ELSE 'other' END",
    "dbtr": {"CtryOfRes": f"CASE WHEN {_K} % 7 < 3 THEN 'US' END", "Nm": "c_name"},
    "flags": {"ace_repairs": f"{_K} % 2 = 0", "stp_failed": f"{_K} % 5 = 0"},
    "rmtInf": {"Ustrd": [_TEXT, f"CASE WHEN {_K} % 3 = 0 THEN concat({_TEXT}, {_TEXT}, {_TEXT}, {_TEXT}, ' inv #', CAST(c_nationkey AS VARCHAR(20))) END"]},
    "source": "CASE c_nationkey % 3 WHEN 0 THEN 'SWF' WHEN 1 THEN 'FED' ELSE '' END",
}
_AGENT = {"FinInstnId": {"MmbId": _MEMBER, "Nm": "c_name", "PstlAdr": {"Ctry": _COUNTRY}}}
_MENDED = {"FinInstnId": {"BIC": "'CHASUS33'", "ClrSysMmbId": {"ClrSysId": {"Cd": "'USABA'"}, "MmbId": _MEMBER}, "Nm": f"CASE WHEN {_K} % 2 = 0 THEN upper(c_name) ELSE concat(c_name, '.') END", "PlaceAdr": {"Ctry": _COUNTRY}}}
REPAIRED = {"Dbtr": {"Nm": "c_name"}, "cdtrAgt": {"after": _MENDED, "before": _AGENT}, "clearing": "'FED'", "other": {"x": "1"}, "source": "c_mktsegment"}

RULES = [
    (1, "7001", "BIC and name", "has_bic AND has_name", 0.97), (2, "7002", "clearing alone", "has_clearing AND NOT has_bic", 0.99), (3, "7003", "AdrLine too long", "NOT has_name", 0.5), (4, "7004", "split Ustrd", "", 0.8),
    (5, "7005", "debtor", "changes_in_dbtr AND not has_country", 0.96), (6, "7006", "weak", "has_bic", 0.94), (7, "7007", "heard as has_name", "NOT has_name", 0.95), (8, "7008", "none", "changes_in_ultmt", 1.0), (9, "6021", "known", "has_iban", 1.0),
]


def _made(spec, spark: bool) -> str:
    """SQL of either engine for nested data."""
    if isinstance(spec, dict):
        parts = [f"'{k}', {_made(v, spark)}" if spark else f"'{k}': {_made(v, spark)}" for k, v in spec.items()]
        return f"named_struct({', '.join(parts)})" if spark else f"{{{', '.join(parts)}}}"
    if isinstance(spec, list):
        return f"{'array(' if spark else '['}{', '.join(_made(v, spark) for v in spec)}{')' if spark else ']'}"
    return spec


def _documents(spark, d, **specs):
    return dealt(table(spark, d, "customer"), _K).select(_K, *[F.expr(f"to_json({_made(s, True)}, map('ignoreNullFields', 'false'))").alias(name) for name, s in specs.items()])


def _nodes(spark, d):
    return json.nodes(_documents(spark, d, doc=PAYMENT), _K, "doc")


def json_nodes(spark, d):
    return _nodes(spark, d).select(_K, "path", "parent", "top", "name", "kind", F.when(~F.col("kind").isin("object", "array"), F.col("value")).alias("value"), "member")


def repair_vector(spark, d):
    return repair_features.vector(repair_features.facts(_nodes(spark, d), _K), _K)


def _rule_facts(spark, d):
    n = _nodes(spark, d)
    more = {"rules": {"all": "n_bic + n_iban + n_mmbid + n_nm + n_ctry + n_adrline + length(text_adrline)"}}
    scalar = "kind NOT IN ('object', 'array', 'null')"
    longest = n.groupBy(_K).agg(F.expr(f"max(CASE WHEN {scalar} AND contains(name, 'ustrd') THEN length(value) END)").alias("longest_ustrd"), F.expr(f"sum(CASE WHEN {scalar} AND contains(name, 'adrline') THEN length(value) END)").alias("chars_adrline"), F.expr("collect_set(top)").alias("entities"))
    return repair_features.facts(n, _K, more).join(longest, _K)


def _rules(spark):
    return spark.createDataFrame(RULES, "nr int, repair_id string, description string, condition string, confidence double")


def discovered_rules(spark, d):
    f = _rule_facts(spark, d)
    return repairs.fired(repairs.tests(f, _K, F.col("entities")), repairs.condition_parts(_rules(spark)), _K)


def predicted_repairs(spark, d):
    found = repairs.predicted(_rule_facts(spark, d), _rules(spark), _K, F.col("entities"))
    return found.select(_K, F.posexplode("repairs").alias("pos", "r")).select(_K, "pos", "r.repair_id", "r.confidence", "r.rule")


def before_states(spark, d):
    found = repairs.before_states(_documents(spark, d, doc=REPAIRED), _K, "doc")
    get = lambda p: F.get_json_object("document", p)
    return found.select(_K, get("$.cdtrAgt.FinInstnId.MmbId").alias("member"), get("$.cdtrAgt.FinInstnId.PstlAdr.Ctry").alias("country"), get("$.dbtr.Nm").alias("debtor"), get("$.source").alias("source"), get("$.other").alias("other"), get("$.cdtrAgt.after").alias("after"))


def _states(spark, d):
    docs = _documents(spark, d, before=_AGENT, after=_MENDED)
    one = F.when(F.col(_K) % 11 != 0, F.col("before"))
    return docs.select(_K, F.lit("cdtrAgt").alias("entity"), one.alias("before"), F.when(F.col(_K) % 13 != 0, F.col("after")).alias("after"))


def repair_changes(spark, d):
    c = repairs.changes(_states(spark, d), [_K])
    joined = [F.array_join(x, ",").alias(x) for x in ("added", "removed", "changed", "structure")]
    return c.select(_K, "entity", *joined, "total", "signature")


def change_patterns(spark, d):
    made = table(spark, d, "orders").select(F.col("o_custkey").alias(_K), F.concat(F.lit("60"), F.lpad((F.col("o_orderkey") % 40).cast("string"), 2, "0")).alias("repair_id"))
    return repairs.change_patterns(repairs.changes(_states(spark, d), [_K]), made, _K)


def change_vector(spark, d):
    return repairs.change_features(repairs.changes(_states(spark, d), [_K]), _K)


def moved_subtrees(spark, d):
    docs = _documents(spark, d, before=_AGENT, after=_MENDED)
    return json.moves(json.nodes(docs, _K, "before"), json.nodes(docs, _K, "after"), _K)


# DuckDB: a row for each node below the root. Paths have no dots in their keys here.
def _tree(spec, name: str = "t") -> str:
    return f"""{name}_d AS (SELECT {_K}, to_json({_made(spec, False)}) AS doc FROM customer),
{name}_j AS (SELECT d.{_K}, j.* FROM {name}_d d, json_tree(d.doc) j),
{name} AS (SELECT n.{_K}, substr(n.fullkey, 3) AS path, substr(n.path, 3) AS parent, n.id, lower(regexp_extract(n.fullkey, '^\\$\\.([^.\\[]+)', 1)) AS top, lower(CASE WHEN p.type = 'ARRAY' THEN p.key ELSE n.key END) AS name,
  CASE n.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind,
  CASE WHEN n.type IN ('OBJECT', 'ARRAY') THEN CAST(n.value AS VARCHAR) WHEN n.type <> 'NULL' THEN json_extract_string(n.value, '$') END AS value, p.type = 'OBJECT' AS member, length(regexp_replace(n.fullkey, '[^.\\[]', '', 'g')) AS deep
  FROM {name}_j n JOIN {name}_j p ON n.{_K} = p.{_K} AND n.parent = p.id)"""


_SCALAR = "kind NOT IN ('object', 'array', 'null')"


def _duck_fact(name: str) -> str:
    counts = {
        "flags_true": f"count_if(top = 'flags' AND deep = 2 AND {_SCALAR} AND value NOT IN ('', 'false', '0'))", "fields": "count_if(member AND kind NOT IN ('object', 'array'))", "leaves": "count_if(kind NOT IN ('object', 'array'))", "depth": "max(deep)", "arrays": "count_if(member AND kind = 'array')",
        "empties": "count_if(member AND (kind = 'null' OR value = ''))", "entities": "count_if(deep = 1 AND kind = 'object')", "agents": "count_if(deep = 1 AND contains(top, 'agt'))", "parties": "count_if(deep = 1 AND top IN ('cdtr', 'dbtr'))",
    }
    if name in counts:
        return counts[name]
    for where in ("_in_", "_under_"):
        if where in name:
            f, e = name.split(where)
            return f"bool_or(top = '{e}' AND deep > 1 AND contains(name, '{f}'){' AND ' + _SCALAR if where == '_in_' else ''})"
    kind, f = name.split("_", 1)
    own = f"{_SCALAR} AND contains(name, '{f}')"
    return {
        "has": f"bool_or(top = '{f}')", "top": f"coalesce(max(lower(value)) FILTER (WHERE top = '{f}' AND deep = 1), '')", "flag": f"coalesce(bool_or(value NOT IN ('', 'false', '0')) FILTER (WHERE top = 'flags' AND name = '{f}'), false)",
        "n": f"count_if({own})", "first": f"arg_min(value, id) FILTER (WHERE {own})", "text": f"string_agg(value, ' ' ORDER BY id) FILTER (WHERE {own})", "kinds": f"count(DISTINCT value) FILTER (WHERE {own})", "cases": f"count(DISTINCT upper(value)) FILTER (WHERE {own})",
    }[kind]


def _vector_sql() -> str:
    facts = ", ".join(f"{_duck_fact(n)} AS {n}" for n in repair_features.mentioned(repair_features.FEATURES))
    duck = lambda c: c.replace("regexp_like(", "regexp_matches(").replace("\\\\", "\\")
    wide = ", ".join(f'coalesce(CAST({duck(c)} AS DOUBLE), 0) AS "{g}_{n}"' for g, own in repair_features.FEATURES.items() for n, c in own.items())
    return f"WITH {_tree(PAYMENT)}, f AS (SELECT {_K}, {facts} FROM t GROUP BY 1) SELECT {_K}, {wide} FROM f"


_RULES = "r(nr, repair_id, description, condition, confidence) AS (VALUES " + ", ".join(f"({n}, '{r}', '{d}', '{c}', {x})" for n, r, d, c, x in RULES) + ")"
_FACTS = f"""f AS (SELECT {_K}, {', '.join(f"count_if({_SCALAR} AND contains(name, '{x}')) > 0 AS {x}" for x in ('bic', 'iban', 'mmbid', 'nm', 'ctry'))}, count_if({_SCALAR} AND contains(name, 'adrline')) AS lines, sum(length(value)) FILTER (WHERE {_SCALAR} AND contains(name, 'adrline')) AS chars, max(length(value)) FILTER (WHERE {_SCALAR} AND contains(name, 'ustrd')) AS ustrd, list(DISTINCT top) AS tops FROM t GROUP BY 1)"""
_MET = f"""p AS (SELECT nr, trim(unnest(string_split(condition, 'AND'))) AS part FROM r),
m AS (SELECT {_K}, nr, bool_and(CASE WHEN contains(lower(part), 'not has_bic') THEN NOT bic WHEN contains(lower(part), 'not has_country') THEN (CASE WHEN contains(lower(part), 'bic') THEN NOT bic ELSE NOT ctry END) WHEN contains(lower(part), 'has_bic') THEN bic
  WHEN contains(lower(part), 'has_clearing') THEN mmbid WHEN contains(lower(part), 'has_name') THEN nm WHEN contains(lower(part), 'changes_in_') THEN list_contains(tops, string_split(lower(part), 'changes_in_')[2]) ELSE false END) AS ok FROM f, p GROUP BY ALL)"""
_CHANGES = f"""{_tree(_AGENT, 'b')}, {_tree(_MENDED, 'a')},
s AS (SELECT {_K}, {_K} % 11 <> 0 AS x, {_K} % 13 <> 0 AS y FROM customer),
j AS (SELECT coalesce(b.{_K}, a.{_K}) AS k, coalesce(b.path, a.path) AS path, b.path IS NULL AS plus, a.path IS NULL AS minus, b.kind IS DISTINCT FROM a.kind OR b.value IS DISTINCT FROM a.value AS differ FROM b FULL JOIN a ON b.{_K} = a.{_K} AND b.path = a.path),
g AS (SELECT k, string_agg(path, ',' ORDER BY path) FILTER (WHERE plus) AS added, string_agg(path, ',' ORDER BY path) FILTER (WHERE minus) AS removed, string_agg(path, ',' ORDER BY path) FILTER (WHERE NOT plus AND NOT minus AND differ) AS changed,
  count_if(plus) AS na, count_if(minus) AS nr, count_if(NOT plus AND NOT minus AND differ) AS nc FROM j GROUP BY 1),
c AS (SELECT s.{_K}, 'cdtrAgt' AS entity, CASE WHEN x AND y THEN coalesce(added, '') ELSE '' END AS added, CASE WHEN x AND y THEN coalesce(removed, '') ELSE '' END AS removed, CASE WHEN x AND y THEN coalesce(changed, '') ELSE '' END AS changed,
  CASE WHEN x AND y THEN 'mmbid_restructured,clearing_structure_added' WHEN y THEN 'entity_added' WHEN x THEN 'entity_removed' ELSE '' END AS structure, CASE WHEN x AND y THEN na + nr + nc + 2 WHEN x OR y THEN 1 ELSE 0 END AS total,
  concat('cdtrAgt:', CASE WHEN x AND y THEN concat_ws(',', CASE WHEN na > 0 THEN 'added:' || na END, CASE WHEN nr > 0 THEN 'removed:' || nr END, CASE WHEN nc > 0 THEN 'changed:' || nc END, 'mmbid_restructured,clearing_structure_added') WHEN y THEN 'entity_added' WHEN x THEN 'entity_removed' ELSE '' END) AS signature,
  CASE WHEN x AND y THEN na ELSE 0 END AS na, CASE WHEN x AND y THEN nr ELSE 0 END AS nr, CASE WHEN x AND y THEN nc ELSE 0 END AS nc FROM s JOIN g ON s.{_K} = g.k)"""

SQL = {
    "json_nodes": f"WITH {_tree(PAYMENT)} SELECT {_K}, path, parent, top, name, kind, CASE WHEN kind NOT IN ('object', 'array') THEN value END AS value, member FROM t",
    "repair_vector": _vector_sql(),
    "discovered_rules": f"WITH {_RULES}, {_tree(PAYMENT)}, {_FACTS}, {_MET} SELECT {_K}, nr FROM m WHERE ok",
    "predicted_repairs": f"""WITH {_RULES}, {_tree(PAYMENT)}, {_FACTS}, {_MET},
o AS (SELECT {_K}, 1 AS stage, 0 AS nr, '6021' AS repair_id, 1.0 AS confidence, 'country from bic' AS rule FROM f WHERE bic AND NOT ctry UNION ALL SELECT {_K}, 2, 0, '6035', 1.0, 'bic from clearing' FROM f WHERE mmbid AND NOT bic
  UNION ALL SELECT {_K}, 3, 0, '6036', 1.0, 'name from bic' FROM f WHERE bic AND NOT nm UNION ALL SELECT {_K}, 4, 3, '7003', 0.5, 'address' FROM f WHERE chars > 140 OR lines > 3 UNION ALL SELECT {_K}, 5, 4, '7004', 0.8, 'remittance' FROM f WHERE ustrd > 140
  UNION ALL SELECT {_K}, 6, 0, '6021', 0.95, 'country from iban' FROM f WHERE iban AND NOT bic AND NOT ctry UNION ALL SELECT {_K}, 7, m.nr, repair_id, confidence, 'discovered' FROM m JOIN r ON m.nr = r.nr WHERE ok AND confidence >= 0.95),
u AS (SELECT *, row_number() OVER (PARTITION BY {_K}, repair_id ORDER BY stage, nr) AS again FROM o)
SELECT {_K}, row_number() OVER (PARTITION BY {_K} ORDER BY stage, nr) - 1 AS pos, repair_id, confidence, rule FROM u WHERE again = 1""",
    "before_states": f"SELECT {_K}, {_MEMBER} AS member, {_COUNTRY} AS country, c_name AS debtor, c_mktsegment AS source, CAST(NULL AS VARCHAR) AS other, CAST(NULL AS VARCHAR) AS after FROM customer",
    "repair_changes": f"WITH {_CHANGES} SELECT {_K}, entity, added, removed, changed, structure, total, signature FROM c",
    "change_patterns": f"WITH {_CHANGES} SELECT signature, '60' || lpad(CAST(o_orderkey % 40 AS VARCHAR), 2, '0') AS repair_id, count(*) AS n FROM c JOIN orders ON {_K} = o_custkey GROUP BY ALL",
    "change_vector": f"""WITH {_CHANGES} SELECT {_K}, least(na / 10, 1) AS added, least(nr / 10, 1) AS removed, least(nc / 10, 1) AS changed, least(total / 5, 1) AS "cdtrAgt_changes", CAST(structure = 'entity_added' AS DOUBLE) AS "cdtrAgt_added", CAST(contains(structure, 'mmbid_restructured') AS DOUBLE) AS "cdtrAgt_restructured",
{', '.join(f'0.0 AS "{e}_{x}"' for e in ("dbtrAgt", "cdtr", "dbtr") for x in ("changes", "added", "restructured"))}, CAST(contains(lower(added), 'bic') AS DOUBLE) AS bic_added, CAST(contains(lower(added), 'nm') AS DOUBLE) AS nm_added, CAST(contains(lower(added), 'ctry') AS DOUBLE) AS ctry_added FROM c""",
    "moved_subtrees": f"SELECT {_K}, 'mmbid' AS name, 'FinInstnId.MmbId' AS from_path, 'FinInstnId.ClrSysMmbId.MmbId' AS to_path FROM customer UNION ALL SELECT {_K}, 'ctry', 'FinInstnId.PstlAdr.Ctry', 'FinInstnId.PlaceAdr.Ctry' FROM customer",
}

QUERIES = {f.__name__: f for f in (json_nodes, repair_vector, discovered_rules, predicted_repairs, before_states, repair_changes, change_patterns, change_vector, moved_subtrees)}
