"""Diagnosis of graphs, directories, code sets and data dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions import text
from sparquill.functions.fields import party_hint

# Codes about one field, which are likely to exclude each other.
FIELD_GROUPS = {"account": ("8894", "8896", "8004", "8033"), "bic": ("8001", "8005", "8006"), "country": ("8006", "8027", "8022"), "amount": ("8090", "8091")}
# How many samples make a repair learnable, and what that is called.
FEASIBILITY = [(100, "excellent"), (50, "good"), (20, "fair"), (10, "poor")]


def missing_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, callers): procedures (id, type, name, file, external) by whether they are external, without a file, or valid; with the
    first names of what calls those that are not.
    """
    kind = F.when(F.col("external").eqNullSafe(True), "external").when(F.coalesce(F.col("file"), F.lit("")) == "", "missing").otherwise("valid")
    own = nodes.where("type = 'procedure'").select("id", kind.alias("kind"))
    names = nodes.select(F.col("id").alias("src"), F.col("name").alias("caller"))
    calls = edges.select("src", "dst").distinct().join(own.where("kind <> 'valid'").select(F.col("id").alias("dst")), "dst").join(names, "src")
    # Names once each, so that a called-by-all procedure's list is of names, cut to the first ten.
    place = F.row_number().over(Window.partitionBy("dst").orderBy("caller"))
    few = calls.select("dst", "caller").distinct().withColumn("place", place).where(F.col("place") <= 10).groupBy("dst").agg(F.array_sort(F.collect_list("caller")).alias("callers"))
    return own.join(few.withColumnRenamed("dst", "id"), "id", "left").select("id", "kind", F.coalesce("callers", F.array().cast("array<string>")).alias("callers"))


def data_usage(procedures: DataFrame, symbols: DataFrame, keywords: list[str]) -> DataFrame:
    """(name, symbol): symbols (symbol) that stand as a word in a procedure's code (name, code), but for the language's own words."""
    words = procedures.select("name", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("code", F.lit(r"[A-Za-z_^][A-Za-z0-9_^]*"), F.lit(0)), F.upper))).alias("symbol"))
    known = symbols.select(F.upper("symbol").alias("symbol")).distinct().where(~F.col("symbol").isin([k.upper() for k in keywords]))
    return words.join(known, "symbol").select("name", "symbol")


def directory_status(rows: DataFrame, key: str, bic: Column, directory: DataFrame | None) -> DataFrame:
    """(key, status) of BICs against a directory (bic of eight characters, status): format, unknown, inactive or active; without a directory
    not_loaded. The first eight characters count.
    """
    b = F.upper(F.trim(bic))
    good = b.rlike("^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$")
    own = rows.select(key, F.when(good, F.substring(b, 1, 8)).alias("b8"))
    if directory is None:
        return own.select(key, F.when(F.col("b8").isNull(), "format").otherwise("not_loaded").alias("status"))
    d = directory.select(F.col("bic").alias("b8"), F.lower("status").alias("listed"))
    status = F.when(F.col("b8").isNull(), "format").when(F.col("listed").isNull(), "unknown").when(F.col("listed") != "active", "inactive").otherwise("active")
    return own.join(d, "b8", "left").select(key, status.alias("status"))


def field_conflicts(codes: DataFrame, least: int = 5, most_ratio: float = 0.1) -> DataFrame:
    """(field, code1, code2, n1, n2, both, ratio): frequent codes (txn, code) about one field that rarely meet."""
    groups = F.array(*[F.struct(F.lit(f).alias("field"), F.array(*[F.lit(c) for c in bases]).alias("bases")) for f, bases in FIELD_GROUPS.items()])
    c = codes.select("txn", "code").distinct()
    freq = c.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    fields = freq.select("code", "n", F.explode(F.filter(groups, lambda g: F.array_contains(g["bases"], F.substring_index("code", "_", 1)))["field"]).alias("field"))
    a, b = fields.alias("a"), fields.alias("b")
    pairs = a.join(b, (F.col("a.field") == F.col("b.field")) & (F.col("a.code") < F.col("b.code"))).select(F.col("a.field").alias("field"), F.col("a.code").alias("code1"), F.col("b.code").alias("code2"), F.col("a.n").alias("n1"), F.col("b.n").alias("n2"))
    kept = c.join(fields.select("code").distinct(), "code", "left_semi")
    x, y = kept.alias("x"), kept.alias("y")
    met = x.join(y, (F.col("x.txn") == F.col("y.txn")) & (F.col("x.code") < F.col("y.code"))).groupBy(F.col("x.code").alias("code1"), F.col("y.code").alias("code2")).agg(F.count("*").alias("both"))
    ratio = F.round(F.col("both") / F.least("n1", "n2"), 4)
    return pairs.join(met, ["code1", "code2"], "left").na.fill(0, ["both"]).where(F.col("both") / F.least("n1", "n2") < most_ratio).select("field", "code1", "code2", "n1", "n2", "both", ratio.alias("ratio"))


def repair_distribution(repairs: DataFrame) -> DataFrame:
    """(repair, n, share, band) of repairs (txn, repair): how many transactions have one, and how learnable that makes it."""
    counts = repairs.distinct().groupBy("repair").agg(F.count("*").alias("n"))
    total = repairs.select("txn").distinct().agg(F.count("*").alias("total"))
    band = F.lit("too few")
    for least, name in reversed(FEASIBILITY):
        band = F.when(F.col("n") >= least, name).otherwise(band)
    return counts.join(total).select("repair", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), band.alias("band"))


def global_features(parties: DataFrame, key: str) -> DataFrame:
    """(key, ..._count, ..._consistent) over a message's parties (key, iban, account, nch, countries array, bic, is_clabe): how many values
    of each kind there are, and whether all are equal; a country counts once however often it is named.
    """
    plain = lambda c: F.nullif(F.regexp_replace(F.upper(c), "[ -]", ""), F.lit(""))
    account = F.nullif(F.replace(F.upper("account"), F.lit(" "), F.lit("")), F.lit(""))
    values = {"iban": plain("iban"), "account": account, "nch": F.nullif(F.col("nch"), F.lit("")), "bic4": F.when(F.length("bic") >= 4, F.upper(F.substring("bic", 1, 4))), "clabe": F.when(F.col("is_clabe"), F.coalesce(account, F.lit("")))}
    # One pass: a party has a row for each of its countries, and its values on the first of them; all are equal if the least is the largest.
    named = F.array_distinct(F.transform(F.filter("countries", lambda c: F.length(c) == 2), F.upper))
    rows = parties.select(key, *[v.alias(name) for name, v in values.items()], named.alias("_named")).repartition(key)
    rows = rows.select(key, *values, F.posexplode_outer("_named").alias("_nr", "country"))
    out = []
    for name in values:
        v = F.when(F.coalesce("_nr", F.lit(0)) == 0, F.col(name))
        out += [F.count(v).alias(f"{name}_count"), F.coalesce(F.min(v) == F.max(v), F.lit(True)).alias(f"{name}s_consistent")]
    return rows.groupBy(key).agg(*out, F.size(F.collect_set("country")).cast("long").alias("country_count")).withColumn("countries_consistent", F.col("country_count") <= 1)


def pruned(seen: DataFrame, least: int, last: int = 100) -> DataFrame:
    """seen (fingerprint, at, ...) of fingerprints that occur `least` times or more, the `last` latest rows of each."""
    frequent = seen.groupBy("fingerprint").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("fingerprint")
    place = F.row_number().over(Window.partitionBy("fingerprint").orderBy(F.desc("at")))
    return seen.join(frequent, "fingerprint").withColumn("place", place).where(F.col("place") <= last).drop("place")


def keyword_places(docs: DataFrame, keyword: str, around: int = 30) -> DataFrame:
    """(doc_id, nr, start, context): each place of a text, in any case, with its first character's place from 0 and what stands around it."""
    low = F.lower("text")
    parts = docs.select("doc_id", "text", F.split(low, "\\Q" + keyword.lower() + "\\E", -1).alias("p")).where(F.size("p") > 1)
    ends = F.transform("p", lambda x: F.length(x))
    placed = parts.select("doc_id", "text", F.posexplode(F.slice(ends, 1, F.size(ends) - 1)).alias("nr", "n"))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("nr"))
    at = placed.withColumn("start", (before + F.col("nr") * len(keyword)).cast("int"))
    first = F.greatest(F.col("start") - around, F.lit(0))
    return at.select("doc_id", "nr", "start", F.substring("text", first + 1, F.col("start") - first + len(keyword) + around).alias("context"))


def listed(names: DataFrame, pattern: str) -> DataFrame:
    """Names that contain the pattern's upper-case form as it is."""
    return names.where(F.contains("name", F.lit(pattern.upper())))


def relevance(docs: DataFrame, keywords: list[str]) -> DataFrame:
    """(doc_id, relevance): the number of keywords that a text contains over five, 1 at most."""
    n = sum((F.contains(F.lower("text"), F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
    return docs.select("doc_id", F.least(F.lit(1.0), n / 5.0).alias("relevance"))


def synonym_scores(counts: DataFrame, dim: DataFrame, credit: float = 0.5) -> DataFrame:
    """(doc_id, category, score): 2 ln(1 + n) for each keyword of a category (term, category, synonym boolean), `credit` of it for a synonym, over the document's largest."""
    summed = counts.join(dim, "term").groupBy("doc_id", "category").agg(F.sum(2 * F.log1p("tf") * F.when(F.col("synonym"), credit).otherwise(1.0)).alias("score"))
    return summed.select("doc_id", "category", F.round(F.col("score") / F.max("score").over(Window.partitionBy("doc_id")), 6).alias("score"))


def single_label(codes: DataFrame, target: str) -> DataFrame:
    """(txn, first, target, any) of (txn, codes array): the first code, whether the target is among them, and whether any is."""
    return codes.select("txn", F.get("codes", F.lit(0)).alias("first"), F.array_contains("codes", target).alias("target"), (F.size("codes") > 0).alias("any"))


def party_view(rows: DataFrame, key: str, party: str, parties: list[str]) -> DataFrame:
    """rows with a party's features under their bare names, and all features that are no party's; those of other parties are left out."""
    own = {c[len(party) + 1 :]: c for c in rows.columns if c.startswith(f"{party}_")}
    free = [c for c in rows.columns if c != key and not any(c.startswith(f"{p}_") for p in parties) and c not in own]
    return rows.select(key, *[F.col(c).alias(name) for name, c in own.items()], *free)


def series_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fired_8, fired_9, eligible_8, eligible_9) of results (keys, code, status)."""
    n = lambda status, digit: F.count_if((F.col("status") == status) & F.startswith("code", F.lit(digit))).alias(f"{'fired' if status == 'fires' else status}_{digit}")
    return results.groupBy(*keys).agg(*[n(s, x) for s in ("fires", "eligible") for x in "89"])


def response_codes(leaves: DataFrame, key: str) -> DataFrame:
    """(key, code) of flattened responses (key, path, value): each Code of four digits from 6000 on, also with the party that the
    InformationalData beside it begins with.
    """
    at = F.regexp_extract("path", r"^(.*?)(Code|InformationalData)$", 1)
    kind = F.regexp_extract("path", r"(?:^|\.)(Code|InformationalData)$", 1)
    both = leaves.select(key, at.alias("at"), kind.alias("kind"), "value").where("kind <> ''").groupBy(key, "at").agg(F.max(F.when(F.col("kind") == "Code", F.col("value"))).alias("code"), F.max(F.when(F.col("kind") == "InformationalData", F.col("value"))).alias("info"))
    good = both.where(F.col("code").rlike("^[6-9][0-9]{3}(_.*)?$"))
    hint = party_hint(F.col("info"))[0]
    return good.select(key, F.explode(F.array_compact(F.array("code", F.when(hint.isNotNull(), F.concat_ws("_", "code", hint))))).alias("code")).distinct()


def siblings(dim: DataFrame, keyword: str) -> DataFrame:
    """Other keywords of a keyword's categories, with them."""
    own = dim.where(F.col("keyword") == keyword).select("category").distinct()
    return dim.join(own, "category", "left_semi").where(F.col("keyword") != keyword).groupBy("keyword").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def include_names(files: DataFrame) -> DataFrame:
    """(file, kind, name) of preprocessor lines in files (file, text): ?SOURCE includes and DEFINE names."""
    named = lambda kind, pattern: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    every = F.concat(named("include", r"(?im)^\?SOURCE\s+([^\s,(]+)"), named("define", r"(?i)\bDEFINE\s+([A-Za-z_^][A-Za-z0-9_^]*)"))
    return files.select("file", F.explode(every).alias("x")).select("file", "x.kind", "x.name").distinct()


def word_index_profile(docs: DataFrame, size: int) -> DataFrame:
    """(lang, docs, chunks, mean_chunks, mean_length): chunks of so many words of each language's documents (doc_id, lang, text)."""
    n = F.size(text.tokens(F.col("text")))
    x = docs.select("lang", F.ceil(n / size).alias("chunks"), F.length("text").alias("chars"))
    return x.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("chunks").alias("chunks"), F.round(F.avg("chunks"), 4).alias("mean_chunks"), F.round(F.sum("chars") / F.sum("chunks"), 4).alias("mean_length"))
