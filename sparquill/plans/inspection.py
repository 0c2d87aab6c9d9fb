"""Diagnosis queries over tables at hand, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.functions import fields
from sparquill.functions import json as nested
from sparquill.operators import inspection as op
from sparquill.operators import search
from sparquill.plans.graph import E, _edges
from sparquill.plans.keywords import DIM, TOK, VALUES
from sparquill.sources.tables import table


def missing_procedures(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("procedure").alias("type"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 5 > 0, F.col("p_brand")).alias("file"), (F.col("p_size") % 7 == 0).alias("external"))
    return op.missing_files(p, _edges(spark, d)).withColumn("callers", F.array_join("callers", ","))


def data_usage(spark, d):
    procs = table(spark, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_name").alias("code"))
    symbols = table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("symbol")).unionAll(spark.createDataFrame([("red",), ("bolt",), ("widget",)], "symbol string"))
    return op.data_usage(procs, symbols, ["bolt"])


BIC = "CASE o_custkey % 5 WHEN 0 THEN 'deutdeff' || lpad(o_custkey % 7, 3, '0') WHEN 1 THEN 'NOTABIC' WHEN 2 THEN 'ABCDEF' || lpad(o_custkey % 30, 2, '0') WHEN 3 THEN ' CHASUS33 ' END"


def directory_lookup(spark, d):
    directory = spark.createDataFrame([("DEUTDEFF", "Active"), ("CHASUS33", "closed"), *[(f"ABCDEF{k:02d}", "active") for k in range(0, 30, 2)]], "bic string, status string")
    return op.directory_status(table(spark, d, "orders"), "o_orderkey", F.expr(BIC), directory).groupBy("status").agg(F.count("*").alias("n"))


def field_conflicts(spark, d):
    o = table(spark, d, "orders")
    codes = o.select(F.col("o_orderkey").alias("txn"), F.explode(F.array(F.concat(F.lit("88"), F.lpad((90 + F.col("o_custkey") % 10).cast("string"), 2, "0")), F.concat(F.lit("800"), (F.col("o_orderkey") % 7).cast("string"), F.when(F.col("o_custkey") % 2 == 0, "_CDTPTY").otherwise("")))).alias("code"))
    return op.field_conflicts(codes)


def repair_distribution(spark, d):
    return op.repair_distribution(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("txn"), F.concat(F.lit("R"), F.floor(F.sqrt("l_partkey")).cast("string")).alias("repair")))


def global_consistency(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS k", "CASE WHEN l_suppkey % 3 = 0 THEN 'gb82 ' || l_linenumber % 2 END AS iban", "CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'a ' || l_suppkey % 2 END AS account",
        "CASE WHEN l_linenumber % 3 = 0 THEN 'N' || l_partkey % 2 END AS nch", "'deut' || l_suppkey % 2 AS bic", "l_linenumber % 4 = 0 AS is_clabe", "array(CASE WHEN l_suppkey % 2 = 0 THEN 'de' ELSE 'FR' END, 'long') AS countries",
    )
    return op.global_features(rows, "k")


def pruned_patterns(spark, d):
    seen = table(spark, d, "lineitem").select(F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("fingerprint"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return op.pruned(seen, 5, 20).groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("at").alias("oldest"))


def keyword_places(spark, d):
    return op.keyword_places(table(spark, d, "documents"), "License").withColumn("context", F.md5("context"))


def listed_names(spark, d):
    return op.listed(table(spark, d, "supplier").select(F.upper("s_name").alias("name")), "r#00000001")


def text_relevance(spark, d):
    return op.relevance(table(spark, d, "documents"), ["the", "license", "und", "que", "of", "is", "zu"]).groupBy("relevance").agg(F.count("*").alias("n"))


def synonym_scores(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    dim = spark.createDataFrame([(k, c, p == "low") for k, c, p in DIM], "term string, category string, synonym boolean")
    return op.synonym_scores(search.term_counts(docs), dim)


def single_labels(spark, d):
    codes = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("txn")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("codes"))
    return op.single_label(codes, "1-URGENT").groupBy("first", "target", "any").agg(F.count("*").alias("n"))


def party_view(spark, d):
    wide = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("cdt_name"), F.col("c_mktsegment").alias("dbt_name"), F.col("c_nationkey").alias("amount"))
    return op.party_view(wide, "k", "cdt", ["cdt", "dbt", "bnf"])


def code_series(spark, d):
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.concat((8 + F.col("o_orderkey") % 2).cast("string"), F.lit("001")).alias("code"), F.when(F.col("o_orderkey") % 3 == 0, "fires").when(F.col("o_orderkey") % 3 == 1, "eligible").otherwise("cannot_fire").alias("status"))
    return op.series_counts(r, ["k"])


def codes_in_responses(spark, d):
    item = F.struct((6000 + F.col("o_orderkey") % 5000).cast("string").alias("Code"), F.when(F.col("o_custkey") % 3 == 0, "BNFBNK bad").when(F.col("o_custkey") % 3 == 1, "see CDTPTY").alias("InformationalData"))
    docs = table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.struct(F.array(item, F.struct(F.lit("12").alias("Code"), F.lit("x").alias("InformationalData"))).alias("MsgStatus")).alias("AuditTrail"))).alias("doc"))
    return op.response_codes(nested.flatten(docs, "o_orderkey", "doc"), "o_orderkey")


def sibling_keywords(spark, d):
    dim = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("keyword"), F.col("p_brand").alias("category"))
    return op.siblings(dim, "red").withColumn("categories", F.array_join("categories", ","))


def includes(spark, d):
    files = table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.concat(F.lit("?SOURCE lib_"), F.col("p_size").cast("string"), F.lit("(x)\nDEFINE d_"), F.col("p_partkey").cast("string"), F.lit(" = 1#;\n")).alias("text"))
    return op.include_names(files)


def index_profile(spark, d):
    return op.word_index_profile(table(spark, d, "documents"), 100)


def party_hints(spark, d):
    info = F.concat(F.element_at(F.array(*[F.lit(x) for x in (*fields.HINTS, "NONE", "CDT")]), (F.col("o_orderkey") % 12 + 1).cast("int")), F.lit(" text"))
    short, name = fields.party_hint(info)
    return table(spark, d, "orders").groupBy(F.coalesce(short, F.lit("-")).alias("short"), F.coalesce(name, F.lit("-")).alias("name")).agg(F.count("*").alias("n"))


NAMES = ["BICFI", "clrSysMmbId", "Nm", "PstlAdr", "ctryOfRes", "IBAN", "other", "ClrSysId"]
TYPES = ["int(32)", "INT(16)", "INT", "real(64)", "REAL(9)", " unsigned(8)", "STRING", "foo", "int(7)", "FIXED"]


def _dealt(spark, d, values):
    """Each order with its place in a list of values, and the value there."""
    nr = (F.col("o_orderkey") % len(values)).cast("int")
    return table(spark, d, "orders").select(nr.alias("nr"), F.element_at(F.array(*[F.lit(v) for v in values]), nr + 1).alias("v"))


def repair_texts(spark, d):
    return _dealt(spark, d, NAMES).groupBy(F.col("v").alias("field"), fields.repair_text(F.col("v")).alias("text")).agg(F.count("*").alias("n"))


def plain_types(spark, d):
    return _dealt(spark, d, TYPES).groupBy(F.col("v").alias("name"), fields.plain_type(F.col("v")).alias("type")).agg(F.count("*").alias("n"))


def address_countries(spark, d):
    a, b = F.col("c_custkey"), F.col("c_nationkey")
    line = lambda s, t: F.struct(F.lit(s).alias("seq"), t.alias("text"))
    third = F.when(a % 2 == 0, F.when(a % 3 == 0, "Berlin, DE 10115 FR").otherwise("some us city 12")).otherwise("")
    lines = F.when(a % 5 == 0, F.array(line("1", F.lit("a road")), line("2", F.lit("PARIS FR")))).otherwise(F.array(line("1", F.lit("x")), line("3", third), line("4", F.when(b % 2 == 0, "Roma,IT").otherwise("nowhere"))))
    return table(spark, d, "customer").groupBy(F.coalesce(fields.address_country(lines, ["DE", "FR", "US", "IT"]), F.lit("-")).alias("country")).agg(F.count("*").alias("n"))


def length_violations(spark, d):
    return table(spark, d, "part").select("p_partkey", fields.too_long(F.concat_ws(" ", "p_name", "p_type", "p_brand"), 27).alias("v")).where("v IS NOT NULL").select("p_partkey", "v.*")


VALUES_ = ["EUR", "eur", "EU", "E1R", " Name ", "", None, "a-b", "DEUTDEFF", "DEUTDEFF50", "DE1TDEFF", "DEUT DEFF"]


def field_checks(spark, d):
    rows = _dealt(spark, d, VALUES_)
    kinds = {"text": fields.text_check(F.col("v"), 2, 5, False), "currency": fields.code_check(F.col("v"), 3), "bic": fields.bic_check(F.col("v"))}
    out = None
    for k, c in kinds.items():
        own = rows.select("nr", F.lit(k).alias("kind"), F.explode(c).alias("x")).select("nr", "kind", "x.level")
        out = own if out is None else out.unionAll(own)
    return out.groupBy("nr", "kind", "level").agg(F.count("*").alias("n"))


def repair_needs(spark, d):
    p = table(spark, d, "part")
    c = {"bic": F.when(F.col("p_size") % 2 == 0, "B"), "iban": F.when(F.col("p_size") % 3 == 0, "I"), "clearing": F.when(F.col("p_size") % 5 == 0, "C"), "country": F.when(F.col("p_size") % 7 == 0, "DE").otherwise(""), "name": F.when(F.col("p_size") % 4 == 0, F.col("p_name")), "address": F.array_repeat("p_type", 1 + (F.col("p_size") % 5).cast("int")), "remittance": F.array(F.repeat(F.lit("r"), 120 + F.col("p_size")))}
    return p.select("p_partkey", *[v.alias(k) for k, v in fields.repair_needs(c).items()])


def metadata_forms(spark, d):
    c = F.when(F.col("p_size") % 4 == 0, '{"a": 1}').when(F.col("p_size") % 4 == 1, "plain").when(F.col("p_size") % 4 == 2, "7")
    return table(spark, d, "part").groupBy(fields.normal_metadata(c).alias("metadata")).agg(F.count("*").alias("n"))


C = "c AS (SELECT o_orderkey AS txn, '88' || lpad(CAST(90 + o_custkey % 10 AS VARCHAR), 2, '0') AS code FROM orders UNION SELECT o_orderkey, '800' || o_orderkey % 7 || CASE WHEN o_custkey % 2 = 0 THEN '_CDTPTY' ELSE '' END FROM orders)"
SQL = {
    "missing_procedures": f"""WITH {E}, p AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 7 = 0 THEN 'external' WHEN p_size % 5 = 0 THEN 'missing' ELSE 'valid' END AS kind FROM part), c AS (SELECT dst, list_sort(list(DISTINCT name))[1:10] AS l FROM e JOIN p ON src = id GROUP BY 1)
      SELECT id, kind, CASE WHEN kind = 'valid' THEN '' ELSE coalesce(array_to_string(l, ','), '') END AS callers FROM p LEFT JOIN c ON dst = id""",
    "data_usage": "WITH w AS (SELECT DISTINCT p_partkey AS name, upper(unnest(regexp_extract_all(p_name, '[A-Za-z_^][A-Za-z0-9_^]*'))) AS symbol FROM part), s AS (SELECT DISTINCT upper(unnest(string_split(p_type, ' '))) AS symbol FROM part UNION SELECT unnest(['RED', 'WIDGET'])) SELECT name, symbol FROM w JOIN s USING (symbol) WHERE symbol <> 'BOLT'",
    "directory_lookup": "SELECT CASE o_custkey % 5 WHEN 0 THEN 'active' WHEN 2 THEN CASE WHEN o_custkey % 30 % 2 = 0 THEN 'active' ELSE 'unknown' END WHEN 3 THEN 'inactive' ELSE 'format' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "field_conflicts": f"""WITH {C}, f AS (SELECT code, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 5), g(field, base) AS (VALUES {', '.join(f"('{f}', '{b}')" for f, bases in op.FIELD_GROUPS.items() for b in bases)}), k AS (SELECT field, code, n FROM f JOIN g ON base = string_split(code, '_')[1]),
      p AS (SELECT a.field, a.code AS code1, b.code AS code2, a.n AS n1, b.n AS n2, (SELECT count(*) FROM c x JOIN c y ON x.txn = y.txn WHERE x.code = a.code AND y.code = b.code) AS "both" FROM k a JOIN k b ON a.field = b.field AND a.code < b.code) SELECT *, round("both" / least(n1, n2), 4) AS ratio FROM p WHERE "both" / least(n1, n2) < 0.1""",
    "repair_distribution": "WITH r AS (SELECT DISTINCT l_orderkey AS txn, 'R' || CAST(floor(sqrt(l_partkey)) AS BIGINT) AS repair FROM lineitem) SELECT repair, count(*) AS n, round(count(*) / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 6) AS share, CASE WHEN count(*) >= 100 THEN 'excellent' WHEN count(*) >= 50 THEN 'good' WHEN count(*) >= 20 THEN 'fair' WHEN count(*) >= 10 THEN 'poor' ELSE 'too few' END AS band FROM r GROUP BY 1",
    "global_consistency": """WITH p AS (SELECT l_orderkey AS k, CASE WHEN l_suppkey % 3 = 0 THEN 'GB82' || l_linenumber % 2 END AS i, CASE WHEN l_linenumber % 2 <> 0 THEN 'A' || l_suppkey % 2 END AS a, CASE WHEN l_linenumber % 3 = 0 THEN 'N' || l_partkey % 2 END AS n, CASE WHEN l_suppkey % 2 = 0 THEN 'DE' ELSE 'FR' END AS c, l_linenumber % 4 = 0 AS clabe FROM lineitem)
      SELECT k, count(i) AS iban_count, count(DISTINCT i) <= 1 AS ibans_consistent, count(a) AS account_count, count(DISTINCT a) <= 1 AS accounts_consistent, count(n) AS nch_count, count(DISTINCT n) <= 1 AS nchs_consistent, count(*) AS bic4_count, true AS bic4s_consistent,
        count(*) FILTER (clabe) AS clabe_count, count(DISTINCT coalesce(a, '')) FILTER (clabe) <= 1 AS clabes_consistent, count(DISTINCT c) AS country_count, count(DISTINCT c) <= 1 AS countries_consistent FROM p GROUP BY 1""",
    "pruned_patterns": "WITH s AS (SELECT l_returnflag || l_suppkey AS f, l_orderkey * 10 + l_linenumber AS at1 FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY at1 DESC) AS k, count(*) OVER (PARTITION BY f) AS n FROM s) SELECT f AS fingerprint, count(*) AS n, min(at1) AS oldest FROM r WHERE n >= 5 AND k <= 20 GROUP BY 1",
    "listed_names": "SELECT upper(s_name) AS name FROM supplier WHERE contains(upper(s_name), 'R#00000001')",
    "text_relevance": "WITH x AS (SELECT least(1.0, (" + " + ".join(f"CAST(contains(lower(text), '{k}') AS INT)" for k in ("the", "license", "und", "que", "of", "is", "zu")) + ") / 5.0) AS r FROM documents) SELECT CAST(r AS DOUBLE) AS relevance, count(*) AS n FROM x GROUP BY 1",
    "synonym_scores": f"WITH dim(term, category, priority) AS (VALUES {VALUES}), t AS (SELECT doc_id, unnest({TOK}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), s AS (SELECT doc_id, category, sum(2 * ln(1 + tf) * CASE WHEN priority = 'low' THEN 0.5 ELSE 1 END) AS s FROM c JOIN dim USING (term) GROUP BY 1, 2) SELECT doc_id, category, round(s / max(s) OVER (PARTITION BY doc_id), 6) AS score FROM s",
    "single_labels": "WITH c AS (SELECT o_custkey, min(o_orderpriority) AS f, bool_or(o_orderpriority = '1-URGENT') AS t FROM orders GROUP BY 1) SELECT f AS first, t AS target, true AS any, count(*) AS n FROM c GROUP BY 1, 2",
    "party_view": "SELECT c_custkey AS k, c_name AS name, c_nationkey AS amount FROM customer",
    "code_series": "SELECT o_custkey AS k, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0) AS fired_8, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 = 1) AS fired_9, count(*) FILTER (o_orderkey % 3 = 1 AND o_orderkey % 2 = 0) AS eligible_8, count(*) FILTER (o_orderkey % 3 = 1 AND o_orderkey % 2 = 1) AS eligible_9 FROM orders GROUP BY 1",
    "codes_in_responses": "WITH x AS (SELECT o_orderkey, o_custkey, 6000 + o_orderkey % 5000 AS c FROM orders) SELECT o_orderkey, CAST(c AS VARCHAR) AS code FROM x WHERE c < 10000 UNION ALL SELECT o_orderkey, c || '_BNFBNK' FROM x WHERE c < 10000 AND o_custkey % 3 = 0",
    "sibling_keywords": f"WITH dim AS (SELECT unnest(string_split(p_name, ' ')) AS keyword, p_brand AS category FROM part) SELECT keyword, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM dim WHERE keyword <> 'red' AND category IN (SELECT category FROM dim WHERE keyword = 'red') GROUP BY 1",
    "includes": "SELECT p_partkey AS file, 'include' AS kind, 'lib_' || p_size AS name FROM part UNION ALL SELECT p_partkey, 'define', 'd_' || p_partkey FROM part",
    "index_profile": f"WITH x AS (SELECT lang, CAST(ceil(len({TOK}) / 100) AS BIGINT) AS c, length(text) AS n FROM documents) SELECT lang, count(*) AS docs, CAST(sum(c) AS BIGINT) AS chunks, round(avg(c), 4) AS mean_chunks, round(sum(n) / sum(c), 4) AS mean_length FROM x GROUP BY 1",
    "party_hints": f"WITH h AS (SELECT {list(fields.HINTS)} AS s, {list(fields.HINTS.values())} AS l), x AS (SELECT o_orderkey % 12 + 1 AS k FROM orders) SELECT coalesce(s[k], '-') AS short, coalesce(l[k], '-') AS name, count(*) AS n FROM x, h GROUP BY 1, 2",
    "repair_texts": """WITH e AS (SELECT unnest(['BICFI', 'clrSysMmbId', 'Nm', 'PstlAdr', 'ctryOfRes', 'IBAN', 'other', 'ClrSysId']) AS field, unnest(['BIC looked up from Clearing System ID', 'National clearing code looked up from BIC', 'Name looked up from BIC', 'Address looked up from BIC', 'Country Code extracted from address', 'IBAN validated and formatted', 'other field added or corrected', 'Clearing System ID identified']) AS text), o AS (SELECT o_orderkey % 8 AS nr, count(*) AS n FROM orders GROUP BY 1) SELECT field, text, n FROM (SELECT *, row_number() OVER () - 1 AS nr FROM e) JOIN o USING (nr)""",
    "plain_types": f"""WITH e AS (SELECT unnest({TYPES}) AS name, unnest(['INT32', 'INT16', 'INT', 'REAL64', 'REAL', 'UNSIGNED', 'STRING', 'UNKNOWN', 'INT', 'FIXED']) AS type), o AS (SELECT o_orderkey % 10 AS nr, count(*) AS n FROM orders GROUP BY 1) SELECT name, type, n FROM (SELECT *, row_number() OVER () - 1 AS nr FROM e) JOIN o USING (nr)""",
    "address_countries": "SELECT CASE WHEN c_custkey % 5 = 0 THEN 'FR' WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'DE' ELSE 'US' END WHEN c_nationkey % 2 = 0 THEN 'IT' ELSE '-' END AS country, count(*) AS n FROM customer GROUP BY 1",
    "length_violations": "WITH x AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS v FROM part) SELECT p_partkey, length(v) AS length, 27 AS most, left(v, 30) || CASE WHEN length(v) > 30 THEN '...' ELSE '' END AS preview FROM x WHERE length(v) > 27",
    "field_checks": """WITH e AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]) AS nr, 'text' AS kind, unnest(['PASS', 'PASS', 'PASS', 'PASS', 'ERROR', 'ERROR', 'ERROR', 'ERROR', 'ERROR', 'ERROR', 'ERROR', 'ERROR']) AS level
      UNION ALL SELECT unnest([0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]), 'currency', unnest(['PASS', 'WARNING', 'PASS', 'ERROR', 'ERROR', 'ERROR', 'ERROR', 'ERROR', 'ERROR', 'ERROR', 'ERROR', 'ERROR', 'ERROR'])
      UNION ALL SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]), 'bic', unnest(['ERROR', 'ERROR', 'ERROR', 'ERROR', 'ERROR', 'ERROR', 'ERROR', 'ERROR', 'PASS', 'ERROR', 'ERROR', 'PASS'])), o AS (SELECT o_orderkey % 12 AS nr, count(*) AS n FROM orders GROUP BY 1) SELECT nr, kind, level, n * count(*) AS n FROM e JOIN o USING (nr) GROUP BY nr, kind, level, n""",
    "repair_needs": "SELECT p_partkey, p_size % 2 = 0 AND p_size % 7 <> 0 AS country_from_bic, p_size % 3 = 0 AND p_size % 2 <> 0 AND p_size % 7 <> 0 AS country_from_iban, p_size % 5 = 0 AND p_size % 2 <> 0 AS bic_from_clearing, p_size % 2 = 0 AND p_size % 4 <> 0 AS name_from_bic, length(p_type) * (1 + p_size % 5) > 140 OR 1 + p_size % 5 > 3 AS address_standardised, p_size > 20 AS remittance_split FROM part",
    "metadata_forms": """SELECT CASE p_size % 4 WHEN 0 THEN '{"a": 1}' WHEN 1 THEN '{"value":"plain"}' WHEN 2 THEN '{"value":"7"}' ELSE '{}' END AS metadata, count(*) AS n FROM part GROUP BY 1""",
    "keyword_places": """WITH x AS (SELECT doc_id, text, string_split(lower(text), 'license') AS p FROM documents), y AS (SELECT doc_id, text, p, unnest(range(len(p) - 1)) AS nr FROM x), z AS (SELECT doc_id, text, nr, CAST(list_sum(list_transform(p[1:nr + 1], lambda s: length(s))) + 7 * nr AS INT) AS start FROM y)
      SELECT doc_id, nr, start, md5(text[greatest(start - 30, 0) + 1 : start + 37]) AS context FROM z""",
}

QUERIES = {f.__name__: f for f in (
    missing_procedures, data_usage, directory_lookup, field_conflicts, repair_distribution, global_consistency, pruned_patterns, keyword_places, listed_names, text_relevance, synonym_scores, single_labels,
    party_view, code_series, codes_in_responses, sibling_keywords, includes, index_profile, party_hints, repair_texts, plain_types, address_countries, length_violations, field_checks, repair_needs, metadata_forms,
)}
