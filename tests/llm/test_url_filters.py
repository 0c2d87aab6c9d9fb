import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparquill.llm import url_filters as op
from sparquill.llm.common import read


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), v, h + p) for v, h, p in op.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[2], best[1]


def same(rows, found):
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in found), key=str)
    assert got == sorted(((k, *brute(u)[:3]) for k, u in rows), key=str)
    urls = {}
    for k, u in rows:
        urls.setdefault(k, brute(u))
    for r in found:
        assert r.verdict in ("allow", "block")
        if r.rule:
            assert r.verdict == urls[r.page_id][3]


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in read(spark, sf_dir, "pages").select("page_id", "url").collect()]
    same(rows, op.op2_url_filter(spark, sf_dir).collect())


def test_odd_urls(spark):
    urls = [None, "", "no scheme/x", "http://", "HTTP://A.Example.NET/de/8?x#y", "https://example.net", "x://com/en/", "x://notcom/en/", "x://a.com/EN/", "x://example.com/en/71#q", "a://b://c/d", "https://É.org/es/?", "s://org/es/" + "p/" * 3000, "s://h/a\nb?c"]
    rows = list(enumerate(urls)) + [(4, urls[4])]
    pages = spark.createDataFrame([(k, u, 1) for k, u in rows], "page_id long, url string, row int")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    same(rows, op.url_filter(pages, labels).collect())
    assert op.url_filter(pages.limit(0), labels).count() == 0


def test_bad_branch_is_blocked_and_good_siblings_merge(spark):
    rows, labels = [], []
    for k in range(900):
        section = ("spam", "news", "sport")[k % 3]
        rows.append((k, f"https://site.test/{section}/{k}"))
        if k % 2 == 0:
            labels.append((k, section == "spam"))
    found = op.url_filter(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean"), rules=[("block", "none.test", "/")]).collect()
    assert {(r.template, r.verdict) for r in found if "/spam/" in r.path} == {("/spam/*", "block")}
    assert {r.verdict for r in found if "/spam/" not in r.path} == {"allow"}


def differs(own, together, siblings):
    share = together[0] / max(sum(together), 1)
    spread = (op.SIMILAR_Z**2 + 2 * math.log(siblings)) * sum(own) * share * (1 - share)
    return sum(own) >= op.LEAST_LABELS and (own[0] - share * sum(own)) ** 2 > spread


def brute_tree(urls, labels):
    """(template, labelled, purity, verdict) of each url, by recursion in plain Python."""
    counts = defaultdict(Counter)
    for k, u in urls.items():
        host, path, *_ = brute(u)
        general = tuple("*" if re.search(op.IDENTIFIER, s) else s for s in path.split("/") if s)
        counts[host][(general, None if labels.get(k) is None else bool(labels[k]))] += 1
    template = {}

    def grow(host, prefix, rows):  # rows: {general: what is left of it}
        if len(set(rows.values())) == 1:
            template.update({(host, g): prefix + rest for g, rest in rows.items()})
            return
        skip = next(i for i in range(9999) if len({r[i : i + 1] for r in rows.values()}) > 1)
        weight, labelled, children = Counter(), defaultdict(lambda: [0, 0]), defaultdict(dict)
        for g, rest in rows.items():
            if len(rest) > skip:
                weight[rest[skip]] += sum(counts[host][(g, x)] for x in (None, True, False))
                for i, bad in enumerate((True, False)):
                    labelled[rest[skip]][i] += counts[host][(g, bad)]
        n = sum(weight.values())
        wide = n >= op.FEW_ROWS and len(weight) > op.SPREAD * n
        together = [sum(x[i] for x in labelled.values()) for i in (0, 1)]
        for g, rest in rows.items():
            if len(rest) > skip:
                literal = not wide or differs(labelled[rest[skip]], together, len(weight))
                children[rest[skip] if literal else "*"][g] = rest[skip + 1 :]
            else:
                template[(host, g)] = prefix + rest
        for s, below in children.items():
            grow(host, prefix + next(iter(rows.values()))[:skip] + (s,), below)

    for host, held in counts.items():
        grow(host, (), {g: g for g, _ in held})
    found = defaultdict(lambda: [0, 0])
    for host, held in counts.items():
        for (g, bad), n in held.items():
            if bad is not None:
                found[(host, template[(host, g)])][not bad] += n
            found[(host, template[(host, g)])]
    merged = {x: x[1] for x in found}
    for k in reversed(range(max(len(t) for _, t in found))):
        branch = defaultdict(lambda: [0, 0])
        for x, t in merged.items():
            if len(t) > k:
                for i in (0, 1):
                    branch[(x[0], t)][i] += found[x][i]
        pools = defaultdict(list)
        for host, t in branch:
            pools[(host, t[:k] + ("*",) + t[k + 1 :])].append(t)
        move = {}
        for (host, pool), siblings in pools.items():
            together = [sum(branch[(host, t)][i] for t in siblings) for i in (0, 1)]
            for t in siblings:
                if len(siblings) > 1 and not differs(branch[(host, t)], together, len(siblings)):
                    move[(host, t)] = pool
        merged = {x: move.get((x[0], t), t) for x, t in merged.items()}
    total = defaultdict(lambda: [0, 0])
    for x, t in merged.items():
        for i in (0, 1):
            total[(x[0], t)][i] += found[x][i]
    b, n = sum(x[0] for x in found.values()), sum(map(sum, found.values()))
    prior = b / max(n, 1)
    limit = min(op.REJECT_SHARE, op.REJECT_ODDS * prior / (1 - prior + op.REJECT_ODDS * prior))
    out = {}
    for k, u in urls.items():
        host, path, rule, verdict = brute(u)
        t = merged[(host, template[(host, tuple("*" if re.search(op.IDENTIFIER, s) else s for s in path.split("/") if s))])]
        bad, good = total[(host, t)]
        purity = (bad + op.SMOOTHING * prior) / (bad + good + op.SMOOTHING)
        least = purity - op.REJECT_Z * math.sqrt(max(purity * (1 - purity), 0) / (bad + good + op.SMOOTHING))
        out[k] = ("/" + "/".join(t), bad + good, round(purity, 9), verdict or ("block" if least > limit else "allow"))
    return out


def same_tree(spark, urls, labels):
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    found = op.url_filter(pages, spark.createDataFrame(list(labels.items()), "page_id long, bad boolean")).collect()
    got = {r.page_id: (r.template, r.labelled, round(r.purity, 9), r.verdict) for r in found}
    assert got == brute_tree(urls, labels)
    return found


def test_tree_of_the_whole_table_is_that_of_brute_force(spark):
    d = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in read(spark, d, "pages").collect()}
    marks = {r.doc_id: r.quality == 0 or r.toxic == 1 for r in read(spark, d, "labels").collect()}
    numbers = {k: re.search(r"/([0-9]+)(\.html|/)?$", brute(u)[1]) for k, u in urls.items()}
    labels = {k: marks[int(m[1])] for k, m in numbers.items() if m and int(m[1]) in marks}
    want = brute_tree(urls, labels)
    got = {r.page_id: (r.template, r.labelled, round(r.purity, 9), r.verdict) for r in op.op2_url_filter(spark, d).collect()}
    assert labels and got == want


def test_random_trees_are_those_of_brute_force(spark):
    rng = random.Random(5)
    urls, labels = {}, {}
    for k in range(4000):
        depth = rng.choice([0, 1, 2, 3, 5, 14])
        parts = [rng.choice("abc" if i % 3 else ["x", "y", f"slug-{rng.randint(0, 400)}", str(k)]) for i in range(depth)]
        urls[k] = f"http://{rng.choice(['one', 'two', 'three'])}.test/" + "/".join(parts)
        if rng.random() < 0.6:
            labels[k] = rng.random() < (0.8 if "b" in parts[1:2] else 0.1)
    found = same_tree(spark, urls, labels)
    assert {r.verdict for r in found} == {"allow", "block"} and max(r.template.count("/") for r in found) > 8


def test_a_bad_branch_below_many_levels_is_found(spark):
    deep = "/".join("abcdefghijkl")
    urls = {k: f"https://site.test/{deep}/{('spam', 'news')[k % 2]}/{k}" for k in range(300)} | {k: f"https://other.test/{k}" for k in range(300, 500)} | {999: "x://deep.test/" + "p/" * 3000}
    found = same_tree(spark, urls, {k: k < 300 and k % 2 == 0 for k in range(0, 500, 3)})
    assert {r.verdict for r in found if "/spam/" in r.path} == {"block"} and {r.verdict for r in found if "/spam/" not in r.path} == {"allow"}


@pytest.mark.parametrize("sections", [20, 40, 400, 4000])
def test_a_bad_section_is_blocked_among_any_number(spark, sections):
    each, bad = (50 if sections < 4000 else 12), 7
    pages = spark.range(sections * each).selectExpr("id AS page_id", f"concat('https://site.test/s-', id % {sections}, 'x/', id) AS url")
    labels = spark.range(sections * each).selectExpr("id AS page_id", f"id % {sections} = {bad} AS bad")
    found = op.url_filter(pages, labels).groupBy("verdict").agg(F.collect_set(F.regexp_extract("path", "^/s-([0-9]+)", 1)).alias("s"), F.count("*").alias("n")).collect()
    got = {r.verdict: (set(r.s), r.n) for r in found}
    assert got["block"] == ({str(bad)}, each) and got["allow"][1] == (sections - 1) * each


def test_a_bad_section_among_slugs_keeps_its_name(spark):
    urls = {k: f"https://site.test/{'spam/' + str(k) if k % 10 == 0 else f'post-{k}-x'}" for k in range(600)}
    found = same_tree(spark, urls, {k: k % 10 == 0 for k in urls})
    assert {(r.template, r.verdict) for r in found} == {("/spam/*", "block"), ("/*", "allow")}


def test_few_labels_reject_nothing(spark):
    urls = {k: f"https://h{k % 50}.test/a/{k}" for k in range(300)}
    found = same_tree(spark, urls, {k: k % 50 == 3 or k % 7 == 0 for k in urls})
    assert {r.verdict for r in found} == {"allow"}


def test_one_host_and_one_url_with_half_of_all_rows(spark):
    rows = [(k, f"https://big.test/p-{k}-q/x") for k in range(300)] + [(k, "https://one.test/a") for k in range(300, 700)] + [(k, None) for k in range(700, 900)]
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(k, k % 3 == 0) for k in range(900)], "page_id long, bad boolean")
    found = op.url_filter(pages, labels).collect()
    assert sorted(r.page_id for r in found) == list(range(900))
    assert {(r.host, r.template, r.labelled) for r in found} == {("big.test", "/*/x", 300), ("one.test", "/a", 400), ("", "/", 200)}


def test_labels_of_one_kind(spark):
    urls = {k: f"https://site.test/a/{k}" for k in range(40)}
    assert {r.verdict for r in same_tree(spark, urls, {k: False for k in urls})} == {"allow"}
    assert {r.verdict for r in same_tree(spark, urls, {k: True for k in urls})} == {"block"}
