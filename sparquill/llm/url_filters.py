"""URL filters: rules, and below them a path-template tree for each host, in built-in functions only.

Paths are counted once as distinct (host, path) with their labels. Segments that look like identifiers become
wildcards. Then the tree is built from the root: a node skips what all paths below it share, and where they part,
a segment becomes a wildcard if the node's children are nearly as many as its urls, unless the child's own labels
differ from its siblings'. So a step is made only where paths part, down to their real depth, whatever it is. From
the deepest parting up, sibling branches whose labelled shares do not differ significantly from the siblings'
together are merged into the wildcard branch, which has the evidence of them all. A template is rejected if its
share of bad labels, smoothed towards the overall share, is above the limit by its lower confidence bound.

Hosts, nodes, templates and urls may hold any share of the rows: they are joined by `spread_join`, with counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import LOWER, UPPER, read, row_key, spread_join, stored

ANY = "*"
IDENTIFIER = r"^[0-9]+(\.[a-z]{1,5})?$|^[0-9a-f]{8}[0-9a-f-]{8,}$"
FEW_ROWS, SPREAD = 8, 0.5  # a node is variable if more than this share of at least so many urls are different children
#: A branch differs from its siblings by a two-sided test at this z, made stricter by the number of siblings; fewer labels never do.
SIMILAR_Z, LEAST_LABELS = 1.96, 8
SMOOTHING = 20.0
#: A template's odds of bad labels, over the overall odds, above which it is rejected; the share above which any is; and the z of the lower bound.
REJECT_ODDS, REJECT_SHARE, REJECT_Z = 1.75, 0.9, 1.645
#: (verdict, host, path): fits the host and all its subdomains, where the url's path starts with path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no `://`."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return tuple(F.coalesce(c, F.lit("")) for c in (F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), F.regexp_extract(url, parts, 2)))


def matched_rules(urls: DataFrame, key: str, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """key, rule and verdict for the rows of urls (key, host, path) that a rule fits; the longest rule wins, of equal ones the blocking one.

    A url meets only the rules of its own host's suffixes, by an equi-join.
    """
    listed = [(v, h.lower(), p, h + p, len(h + p)) for v, h, p in rules]
    held = urls.sparkSession.createDataFrame(listed, "rule_verdict string, suffix string, start string, rule string, length int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = urls.where("host <> ''").select(key, "path", F.explode(suffixes).alias("suffix")).join(held, "suffix").where(F.startswith("path", "start"))
    best = met.groupBy(key).agg(F.max(F.struct("length", (F.col("rule_verdict") == "block").alias("block"), "rule", "rule_verdict")).alias("m"))
    return best.select(key, F.col("m.rule").alias("rule"), F.col("m.rule_verdict").alias("rule_verdict"))


def _far(bad: str, labels: Column, all_bad: str, all_labels: Column, siblings: str) -> Column:
    """Whether a branch's share of bad labels differs from its siblings' together. The test's z grows with their number, as the chance that one of them passes it does."""
    share = F.col(all_bad) / F.greatest(all_labels, F.lit(1))
    gap = F.col(bad) - share * labels
    return (labels >= LEAST_LABELS) & (gap * gap > (SIMILAR_Z**2 + 2 * F.log(F.col(siblings))) * labels * share * (1 - share))


def _joined(host: str, *parts: str) -> Column:
    """Host and segments as one key: none of them has a slash."""
    return F.concat_ws("/", host, *parts)


def _templates(paths: DataFrame, total: int) -> DataFrame:
    """host, general, n, bad, good and the array `template` for distinct paths (host, the array general, n, bad, good), of which there are total.

    Each step takes the nodes with several paths left: it skips the segments that all of a node's paths share, as
    their least and largest do, and goes down the segment where they part, or the wildcard. A node with one path
    left is done. So there are as many steps as a path has partings.
    """
    at = stored(paths.withColumns({"template": F.array().cast("array<string>"), "rest": F.col("general"), "node": F.col("host")}))
    done = []
    while True:
        ends = at.groupBy("node").agg(F.min("rest").alias("low"), F.max("rest").alias("high"), F.count("*").alias("paths"))
        parting = F.array_position(F.zip_with("low", "high", lambda x, y: F.coalesce(x == y, F.lit(False))), False)
        ends = ends.select("node", "paths", F.when(F.col("low") != F.col("high"), F.coalesce(F.nullif(parting, F.lit(0)) - 1, F.size("low")).cast("int")).alias("skip"))
        at = spread_join(at, ends, "node", "paths", "general", total).withColumn("segment", F.get("rest", F.col("skip"))).drop("paths")
        at = stored(at.withColumn("child", F.concat_ws("/", "node", "segment")))
        single = F.col("skip").isNull()
        done.append(at.where(single | F.col("segment").isNull()).select("host", "general", "n", "bad", "good", F.concat("template", "rest").alias("template")))
        at = at.where(~single & F.col("segment").isNotNull())
        if at.isEmpty():
            break
        children = stored(at.groupBy("node", "child").agg(F.count("*").alias("paths"), *[F.sum(c).alias(c) for c in ("n", "bad", "good")]))
        nodes = children.groupBy("node").agg(F.count("*").alias("siblings"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "bad", "good")])
        variable = (F.col("all_n") >= FEW_ROWS) & (F.col("siblings") > SPREAD * F.col("all_n"))
        far = _far("bad", F.col("bad") + F.col("good"), "all_bad", F.col("all_bad") + F.col("all_good"), "siblings")
        children = spread_join(children, nodes, "node", "siblings", "child", total).select("child", "paths", (variable & ~far).alias("wide"))
        at = spread_join(at, children, "child", "paths", "general", total)
        taken = F.concat("template", F.slice("rest", F.lit(1), F.col("skip")), F.array(F.when(F.col("wide"), ANY).otherwise(F.col("segment"))))
        left = F.slice("rest", F.col("skip") + 2, F.greatest(F.size("rest") - F.col("skip") - 1, F.lit(0)))
        at = at.select("host", "general", "n", "bad", "good", taken.alias("template"), left.alias("rest"))
        at = stored(at.withColumn("node", _joined("host", "template")))
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def _partings(templates: DataFrame) -> list[int]:
    """The positions, deepest first, at which some templates of a host part that are equal before."""
    before = F.aggregate("template", F.array(F.lit(0).cast("long")), lambda hashes, s: F.concat(hashes, F.array(F.xxhash64(F.element_at(hashes, -1), s))))
    steps = templates.select("host", F.posexplode(F.arrays_zip(F.slice(before, F.lit(1), F.size("template")).alias("h"), F.col("template").alias("s"))).alias("k", "x"))
    sides = steps.groupBy("host", "k", "x.h").agg(F.min("x.s").alias("low"), F.max("x.s").alias("high"))
    return sorted((r.k for r in sides.where("low <> high").select("k").distinct().collect()), reverse=True)


def _merged(templates: DataFrame) -> DataFrame:
    """templates (host, template, bad, good) with `merged`: similar siblings as one wildcard branch, from the deepest parting up."""
    at = templates = stored(templates.withColumn("merged", F.col("template")))
    for k in _partings(templates):
        pool = F.when(F.size("merged") > k, F.transform("merged", lambda s, i: F.when(i == k, ANY).otherwise(s)))  # noqa: B023
        branch = at.withColumn("pool", pool).where("pool IS NOT NULL").groupBy("host", "merged", "pool").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))
        pools = branch.groupBy("host", "pool").agg(F.sum("b").alias("all_b"), F.sum("g").alias("all_g"), F.count("*").alias("siblings")).where("siblings > 1")
        far = _far("b", F.col("b") + F.col("g"), "all_b", F.col("all_b") + F.col("all_g"), "siblings")
        moved = branch.join(pools, ["host", "pool"]).where(~far).select("host", "merged", "pool")
        at = at.join(moved, ["host", "merged"], "left").withColumn("merged", F.coalesce("pool", "merged")).drop("pool")
        at = stored(at)
    return at


def template_tree(paths: DataFrame) -> DataFrame:
    """(url, template, labelled, purity, least, limit, n) for paths (host, path, n, bad, good), one row for each; url is host and path.

    template is the host's template as a string; labelled the number of labels below it; purity the smoothed
    share of bad ones; least its lower confidence bound; limit the purity beyond which a template is rejected, the
    same for all.
    """
    general = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.when(s.rlike(IDENTIFIER), ANY).otherwise(s))
    paths = stored(paths.withColumn("general", general).withColumn("kind", _joined("host", "general")))
    overall = paths.agg(F.sum("bad").alias("b"), F.sum("good").alias("g"), F.count("*").alias("n")).first()
    kinds = paths.groupBy("host", "general").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    wild = stored(_templates(kinds, overall.n))
    merged = stored(_merged(wild.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("kinds"))))
    total = merged.groupBy(_joined("host", "merged").alias("branch")).agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"), F.count("*").alias("templates"))
    prior = (overall.b or 0) / max((overall.b or 0) + (overall.g or 0), 1)
    limit = min(REJECT_SHARE, REJECT_ODDS * prior / (1 - prior + REJECT_ODDS * prior))
    labelled = F.col("all_bad") + F.col("all_good")
    purity = (F.col("all_bad") + SMOOTHING * prior) / (labelled + SMOOTHING)
    least = F.col("purity") - REJECT_Z * F.sqrt(F.greatest(F.col("purity") * (1 - F.col("purity")), F.lit(0.0)) / (F.col("labelled") + SMOOTHING))
    judged = merged.select(_joined("host", "template").alias("grown"), "kinds", _joined("host", "merged").alias("branch"), F.concat(F.lit("/"), F.array_join("merged", "/")).alias("name"))
    judged = spread_join(judged, total, "branch", "templates", "grown", overall.n).select("grown", "kinds", "name", labelled.alias("labelled"), purity.alias("purity")).withColumn("least", least)
    known = wild.select(_joined("host", "general").alias("kind"), _joined("host", "template").alias("grown"))
    known = spread_join(known, judged, "grown", "kinds", "kind", overall.n).drop("grown", "kinds")
    sizes = paths.groupBy("kind").agg(F.count("*").alias("paths"))
    out = spread_join(paths.select("kind", F.concat("host", "path").alias("url"), "n"), known.join(sizes, "kind"), "kind", "paths", "url", overall.n)
    return out.select("url", F.col("name").alias("template"), "labelled", "purity", "least", F.lit(limit).alias("limit"), "n")


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, labelled, purity, least and limit of each row of pages (page_id, url).

    labels (page_id, bad boolean) are what the templates' purity counts. A rule's verdict stands; else the
    template's: block where the lower bound of its purity exceeds the limit. A null url, or one without `://`, has an empty host and
    path, and a template like any other. Repeated rows each get a row; an empty table gives an empty result; null
    labels, and those of null page_ids, count as none. Other columns of pages are left out, whatever their names.
    """
    key = "row"
    host, path = host_path(F.col("url"))
    marked = labels.where("bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    urls = stored(pages.select("page_id", host.alias("host"), path.alias("path"), row_key().alias(key)).join(marked, "page_id", "left"))
    paths = urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    tree = stored(template_tree(paths))
    asked = urls.join(matched_rules(urls, key, rules), key, "left").withColumn("url", F.concat("host", "path"))
    out = spread_join(asked, tree, "url", "n", key, tree.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n)
    verdict = F.coalesce("rule_verdict", F.when(F.col("least") > F.col("limit"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "labelled", "purity", "least", "limit")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled as the document that it shows: its number ends the path, and on all pages at hand that
    document's language is the path's. Bad are those of low quality and toxic ones.
    """
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    number = F.try_to_number(F.nullif(F.regexp_extract(host_path(F.col("url"))[1], r"/([0-9]{1,18})(\.html|/)?$", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    marks = read(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    labels = pages.select("page_id", number.alias("doc_id")).join(marks, "doc_id").select("page_id", "bad")
    return url_filter(pages, labels)
