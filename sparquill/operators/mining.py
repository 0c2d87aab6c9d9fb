"""Pattern mining over (txn, code) tables: co-occurrence, exclusion, preconditions, encodings, class weights, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.operators.ranks import by_hash
from sparquill.sources.shared import stored


def co_occurrence(codes: DataFrame) -> DataFrame:
    """(code1, code2, n): transactions with both codes, code1 < code2. A transaction has few codes, so its pairs are few."""
    c = codes.select("txn", "code").distinct()
    a, b = c.alias("a"), c.alias("b")
    pairs = a.join(b, (F.col("a.txn") == F.col("b.txn")) & (F.col("a.code") < F.col("b.code")))
    return pairs.groupBy(F.col("a.code").alias("code1"), F.col("b.code").alias("code2")).agg(F.count("*").alias("n"))


def exclusions(codes: DataFrame, least: int = 10, most_ratio: float = 0.05) -> DataFrame:
    """Pairs of frequent codes that rarely meet: both counts, meetings, their share of the rarer one, and a confidence.

    Pairs that never meet count too, so all pairs of frequent codes are listed: the vocabulary's square, not the data's.
    """
    freq = codes.select("txn", "code").distinct().groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    a, b = freq.alias("a"), freq.alias("b")
    pairs = a.join(b, F.col("a.code") < F.col("b.code")).select(F.col("a.code").alias("code1"), F.col("b.code").alias("code2"), F.col("a.n").alias("n1"), F.col("b.n").alias("n2"))
    met = pairs.join(co_occurrence(codes).withColumnRenamed("n", "both"), ["code1", "code2"], "left").na.fill(0, ["both"])
    ratio = F.col("both") / F.least("n1", "n2")
    confidence = F.when(F.col("both") == 0, "high").when(ratio < 0.02, "medium").otherwise("low")
    return met.where(ratio <= most_ratio).select("code1", "code2", "n1", "n2", "both", F.round(ratio, 4).alias("ratio"), confidence.alias("confidence"))


def preconditions(flags: DataFrame, codes: DataFrame, support: float = 0.95, least: int = 10) -> DataFrame:
    """(code, feature, share, n): features (txn, feature, value) that are true in at least so many of a code's transactions."""
    j = codes.select("txn", "code").distinct().join(flags, "txn").groupBy("code", "feature").agg(F.avg(F.col("value").cast("int")).alias("share"), F.count("*").alias("n"))
    return j.where((F.col("share") >= support) & (F.col("n") >= least)).select("code", "feature", F.round("share", 6).alias("share"), "n")


def implications(codes: DataFrame, flags: DataFrame, least: int = 3) -> DataFrame:
    """(feature, code, n): features whose true transactions all have the code."""
    c = codes.select("txn", "code").distinct()
    true = flags.where("value").select("txn", "feature")
    total = true.groupBy("feature").agg(F.count("*").alias("total"))
    both = true.join(c, "txn").groupBy("feature", "code").agg(F.count("*").alias("n"))
    return both.join(total, "feature").where((F.col("n") == F.col("total")) & (F.col("n") >= least)).select("feature", "code", "n")


def code_statistics(codes: DataFrame, severities: list[str]) -> DataFrame:
    """Counts by code and severity, the total and its share of all rows in percent."""
    wide = codes.groupBy("code").pivot("severity", severities).count().na.fill(0)
    total = sum((F.col(s) for s in severities), F.lit(0))
    w = wide.withColumn("total", total)
    return w.withColumn("percent", F.round(F.col("total") * 100 / F.sum("total").over(Window.partitionBy()), 4))


def lookup_table(rows: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Occurrences and distinct ids of each combination; nulls are values."""
    return rows.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.count_distinct(id_column).alias("ids"))


def learned_lookup(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last non-null value of each key by an ordinal, and how many different ones there were."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias("value"), F.count_distinct(value).alias("variants"))


def clean_directory(rows: DataFrame) -> DataFrame:
    """(country, bank, n, known): banks and whether any row without an error names them."""
    return rows.groupBy("country", "bank").agg(F.count("*").alias("n"), F.bool_or(~F.col("has_error")).alias("known"))


def class_weights(labels: DataFrame, most: float = 10.0) -> DataFrame:
    """(label, n, ratio, balanced, inverse): negatives over positives, capped; n / (classes (count + 1)), capped; 1 / (share + 0.01) normalised."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    total, k = F.sum("n").over(every), F.count("*").over(every)
    c = counts.select("label", "n", F.least((total - F.col("n")) / F.col("n"), F.lit(most)).alias("ratio"), F.least(total / (k * (F.col("n") + 1)), F.lit(most)).alias("balanced"), (1 / (F.col("n") / total + 0.01)).alias("raw"))
    return c.select("label", "n", F.round("ratio", 6).alias("ratio"), F.round("balanced", 6).alias("balanced"), F.round(F.col("raw") / F.sum("raw").over(every), 6).alias("inverse"))


def label_encoding(labels: DataFrame, least: int) -> DataFrame:
    """(label, n, number): labels by name from 0; those with fewer rows share __RARE__."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    merged = counts.groupBy(F.when(F.col("n") >= least, F.col("label")).otherwise("__RARE__").alias("label")).agg(F.sum("n").alias("n"))
    return merged.withColumn("number", F.row_number().over(Window.orderBy("label")) - 1)


def frequency_encoding(rows: DataFrame, column: str) -> DataFrame:
    """(column, share) of all rows."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.select(column, F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


def downsampled(rows: DataFrame, positive: str, ratio: int, key: str) -> DataFrame:
    """All positive rows and at most ratio times as many negative ones, those with the smallest hash of their key."""
    n = rows.where(F.col(positive)).count()
    kept = by_hash(rows.where(~F.col(positive)), [positive], key).where(F.col("rank") < ratio * n).drop("rank")
    return rows.where(F.col(positive)).unionByName(kept)


def confusion(scored: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, tn, precision, recall, f1) of rows (label, truth, predicted)."""
    t, p = F.col("truth"), F.col("predicted")
    c = scored.groupBy("label").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return c.select("*", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def boosted(scores: DataFrame, pairs: DataFrame, strong: float = 0.7, step: float = 0.1) -> DataFrame:
    """scores (txn, code, p): codes of p over `strong` add min(step, n / 100) to their partners, 1 at most."""
    both = pairs.select("code1", "code2", "n").unionAll(pairs.select(F.col("code2"), F.col("code1"), F.col("n")))
    lift = scores.where(F.col("p") > strong).join(both, F.col("code") == F.col("code1")).groupBy("txn", F.col("code2").alias("code")).agg(F.sum(F.least(F.lit(step), F.col("n") / 100)).alias("lift"))
    return scores.join(lift, ["txn", "code"], "left").select("txn", "code", F.round(F.least(F.lit(1.0), F.col("p") + F.coalesce("lift", F.lit(0.0))), 6).alias("p"))


def thresholded(scores: DataFrame, thresholds: DataFrame, default: float) -> DataFrame:
    """scores (txn, code, p) that reach their code's threshold, else that of the code before _, else the default."""
    own = thresholds.select("code", F.col("threshold").alias("own"))
    base = thresholds.select(F.col("code").alias("base"), F.col("threshold").alias("general"))
    j = scores.withColumn("base", F.substring_index("code", "_", 1)).join(own, "code", "left").join(base, "base", "left")
    return j.where(F.col("p") >= F.coalesce("own", "general", F.lit(default))).select("txn", "code", "p")


def amount_bucket(c):
    """0 for none, then up to 1,000, 10,000, 100,000, a million and above."""
    return F.when(c <= 0, 0).when(c <= 1000, 1).when(c <= 10_000, 2).when(c <= 100_000, 3).when(c <= 1_000_000, 4).otherwise(5)


def stratified_folds(rows: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """rows with `fold`: within each label by hash of the key in turn."""
    return by_hash(rows, [label], key, "fold").withColumn("fold", F.col("fold") % k)


def cross_validated(rows: DataFrame, folds: int, train, predict) -> DataFrame:
    """(fold, label, f1, macro, mean, deviation): F1 of each label in each fold (rows: fold, label, ...), its mean in the fold, and
    that mean's mean and standard deviation. train makes a model of all other folds' rows, predict (label, truth, predicted) of the fold's.
    """
    # Stored, as each fold's training and prediction read the rows, and three results the scores.
    rows, out = stored(rows), None
    for k in range(folds):
        own = confusion(predict(train(rows.where(F.col("fold") != k)), rows.where(F.col("fold") == k))).select(F.lit(k).alias("fold"), "label", "f1")
        out = own if out is None else out.unionAll(own)
    out = stored(out)
    by_fold = out.groupBy("fold").agg(F.avg("f1").alias("macro"))
    return out.join(by_fold, "fold").join(by_fold.agg(F.avg("macro").alias("mean"), F.stddev_pop("macro").alias("deviation")))


def summary_scores(counts: DataFrame) -> DataFrame:
    """(precision, recall, micro_f1, macro_f1, exact) of confusion rows: micro from summed counts, macro the mean F1 of the labels."""
    s = counts.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("macro"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, missed = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + missed), 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + missed), 6).alias("micro_f1"), F.round("macro", 6).alias("macro_f1"))


def set_scores(scored: DataFrame, key: str) -> DataFrame:
    """(rows, exact, hamming) of (key, label, truth, predicted): the share of keys with all labels right, and of wrong labels."""
    wrong = F.count_if(F.col("truth") != F.col("predicted"))
    each = scored.groupBy(key).agg(wrong.alias("wrong"), F.count("*").alias("n"))
    return each.agg(F.count("*").alias("rows"), F.round(F.avg((F.col("wrong") == 0).cast("int")), 6).alias("exact"), F.round(F.sum("wrong") / F.sum("n"), 6).alias("hamming"))


def ensemble(first: DataFrame, second: DataFrame, support: DataFrame, weights: tuple[float, float] = (0.6, 0.4), rare: int = 10, least: float = 0.5, rare_least: float = 0.7) -> DataFrame:
    """(txn, code, p): weighted means of two models' scores (txn, code, p), a missing one as 0, that reach `least`, or
    rare_least for codes of a support (code, n) under `rare`.
    """
    j = first.withColumnRenamed("p", "p1").join(second.withColumnRenamed("p", "p2"), ["txn", "code"], "full")
    p = F.coalesce("p1", F.lit(0.0)) * weights[0] + F.coalesce("p2", F.lit(0.0)) * weights[1]
    k = j.select("txn", "code", F.round(p, 6).alias("p")).join(support, "code", "left")
    return k.where(F.col("p") >= F.when(F.coalesce("n", F.lit(0)) < rare, rare_least).otherwise(least)).select("txn", "code", "p")


def presence_profile(fields: DataFrame, contexts: DataFrame, samples: int = 5) -> DataFrame:
    """(context, field, rate, shortest, longest, dashes, samples, required) of fields (txn, field, value) in contexts (txn,
    context): the share of the context's transactions with the field, lengths, values with a dash, the first different
    values, and whether all have it.
    """
    totals = contexts.groupBy("context").agg(F.count_distinct("txn").alias("total"))
    j = fields.join(contexts, "txn")
    # Of each value one row, so that the list of samples is never that of all rows.
    values = j.groupBy("context", "field", "value").agg(F.min("txn").alias("txn"))
    first = F.row_number().over(Window.partitionBy("context", "field").orderBy("value"))
    few = values.withColumn("place", first).where(F.col("place") <= samples).groupBy("context", "field").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    f = j.groupBy("context", "field").agg(F.count_distinct("txn").alias("n"), F.min(F.length("value")).alias("shortest"), F.max(F.length("value")).alias("longest"), F.count_if(F.contains("value", F.lit("-"))).alias("dashes"))
    rate = F.col("n") / F.col("total")
    return f.join(totals, "context").join(few, ["context", "field"]).select("context", "field", F.round(rate, 6).alias("rate"), "shortest", "longest", "dashes", "samples", (F.col("n") == F.col("total")).alias("required"))


def applied_lookups(rows: DataFrame, lookups: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """rows with the column `target` filled by each (lookup (key, value), key column, target) in turn where it is null, so
    a later lookup may use what an earlier one has found; filled_<target> tells that.
    """
    for k, (lookup, key, target) in enumerate(lookups):
        named = lookup.select(F.col("key").alias("_key"), F.col("value").alias("_value"))
        flag = f"filled_{target}"
        had = F.col(flag) if flag in rows.columns else F.lit(False)
        rows = rows.join(named, F.col(key) == F.col("_key"), "left")
        rows = rows.withColumn(flag, had | (F.col(target).isNull() & F.col("_value").isNotNull())).withColumn(target, F.coalesce(target, "_value")).drop("_key", "_value")
    return rows


def repair_actions(diffs: DataFrame) -> DataFrame:
    """(entity, action, field, n, txns): how often each action changes a field of an entity, of diffs (txn, entity, action, field)."""
    return diffs.groupBy("entity", "action", "field").agg(F.count("*").alias("n"), F.count_distinct("txn").alias("txns"))


def entity_patterns(diffs: DataFrame, codes: DataFrame, entity_share: float = 0.95, field_share: float = 0.90, least: int = 3) -> DataFrame:
    """(code, kind, value, share, n): entities that change in entity_share, and fields in field_share, of a code's transactions, `least` of them or more."""
    c = codes.select("txn", "code").distinct()
    total = c.groupBy("code").agg(F.count("*").alias("total")).where(F.col("total") >= least)
    marks = diffs.select("txn", F.explode(F.array(F.struct(F.lit("entity").alias("kind"), F.col("entity").alias("value")), F.struct(F.lit("field").alias("kind"), F.col("field").alias("value")))).alias("m")).select("txn", "m.kind", "m.value").distinct()
    met = marks.join(c, "txn").groupBy("code", "kind", "value").agg(F.count("*").alias("n")).join(total, "code")
    share = F.col("n") / F.col("total")
    return met.where(share >= F.when(F.col("kind") == "entity", entity_share).otherwise(field_share)).select("code", "kind", "value", F.round(share, 6).alias("share"), "n")


def cross_code(pairs: DataFrame, least: int) -> DataFrame:
    """(function, capabilities, n): functions with at least so many capabilities, of pairs (function, capability)."""
    f = pairs.distinct().groupBy("function").agg(F.array_sort(F.collect_list("capability")).alias("capabilities"))
    return f.select("function", "capabilities", F.size("capabilities").alias("n")).where(F.col("n") >= least)


def _grams(c: str, size) -> Column:
    """The different grams of a text, of so many characters each."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.length(c) >= size, F.sequence(F.lit(1), F.length(c) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(c), i, size)))


def containing(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(entity, part, whole): texts of parts (entity, text), each pair once, that those of wholes (entity, text) of the same entity contain; both sides are distinct and stored.

    What contains a part has all its grams of three characters (a shorter part is its own gram), so the two meet only on
    that gram of the part which the fewest wholes of the entity have. The empty part is in all of them.
    """
    held = stored(wholes.select("entity", F.col("text").alias("whole"), F.explode(F.concat(*[_grams("text", k) for k in (1, 2, 3)])).alias("gram")))
    often = held.groupBy("entity", "gram").agg(F.count("*").alias("n"))
    asked = parts.where("text <> ''").select("entity", F.col("text").alias("part"), F.explode(_grams("text", F.least(F.length("text"), F.lit(3)))).alias("gram"))
    rarest = asked.join(often, ["entity", "gram"], "left").groupBy("entity", "part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).select("entity", "part", F.col("m.gram").alias("gram"))
    met = rarest.join(held, ["entity", "gram"]).where(F.contains("whole", F.col("part"))).select("entity", "part", "whole")
    return met.unionAll(parts.where("text = ''").join(wholes.select("entity", F.col("text").alias("whole")), "entity").select("entity", F.col("text").alias("part"), "whole"))


def best_repair(asked: DataFrame, repairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """asked (key, entity, message) with the id and score of the best repair (id, entity, field, message, score): of the same entity,
    with the same message or one that contains the other, from a score of threshold on; the best by score, then the smallest id.

    Of equal messages of an entity one is asked for and the best repair is known, and different ones meet by containing().
    """
    low = F.lower("message").alias("text")
    best = lambda id, score, m: F.min_by(m, F.struct((-F.col(score)).alias("s"), id)).alias("m")
    pair = F.struct("id", "score")
    known = stored(repairs.where((F.col("score") >= threshold) & F.col("entity").isNotNull() & F.col("message").isNotNull()).groupBy("entity", low).agg(best("id", "score", pair)))
    texts = stored(asked.where("entity IS NOT NULL AND message IS NOT NULL").select("entity", low).distinct())
    inner = containing(known.select("entity", "text"), texts).select("entity", F.col("whole").alias("text"), F.col("part").alias("known"))
    outer = containing(texts, known.select("entity", "text")).select("entity", F.col("part").alias("text"), F.col("whole").alias("known"))
    met = inner.unionAll(outer).join(known.select("entity", F.col("text").alias("known"), "m"), ["entity", "known"])
    found = met.groupBy("entity", "text").agg(best("m.id", "m.score", F.col("m")))
    rows = asked.select("key", "entity", low).hint("merge").join(found, ["entity", "text"])
    return rows.groupBy("key").agg(best("m.id", "m.score", F.col("m"))).select("key", "m.id", "m.score")


def matching_spec(messages: DataFrame, specs: DataFrame) -> DataFrame:
    """(key, place) of messages (key, source, clearing, parties array): the first of specs (place, source, clearing, parties array)
    with the same source, clearing and parties; else the first one of the source and clearing whose parties include the message's.
    """
    j = messages.alias("m").join(specs.alias("s"), (F.col("m.source") == F.col("s.source")) & (F.col("m.clearing") == F.col("s.clearing")))
    own, theirs = F.array_sort(F.array_distinct("m.parties")), F.array_sort(F.array_distinct("s.parties"))
    exact, within = own == theirs, F.size(F.array_except("m.parties", "s.parties")) == 0
    return j.where(within).groupBy("m.key").agg(F.min(F.struct((~exact).cast("int").alias("x"), F.col("s.place").alias("place"))).alias("best")).select("key", "best.place")


def encoded(rows: DataFrame, seen: DataFrame, flags: list[str], numbers: list[str], classes: list[str], frequencies: list[str]) -> DataFrame:
    """rows as numbers: flags as 0 or 1, numbers with 0 for null, classes as places among the sorted values of `seen`, with
    __missing__ for null and __unknown__ for values that it lacks, frequencies as shares of its rows.

    Each column's values and shares are a table of its own that is joined, so any number of values will do.
    """
    out = rows.select("*", *[F.coalesce(F.col(c), F.lit(False)).cast("int").alias(f"{c}_flag") for c in flags], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"{c}_number") for c in numbers])
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("__missing__"))
    total = seen.count()
    for c in classes:
        every = seen.select(filled(c).alias("_v")).unionAll(seen.sparkSession.createDataFrame([("__missing__",), ("__unknown__",)], "_v string")).distinct()
        numbered = every.withColumn("_nr", F.row_number().over(Window.orderBy("_v")) - 1)  # a column's different classes
        unknown = numbered.where("_v = '__unknown__'").select(F.col("_nr").alias("_other"))
        out = out.join(numbered, filled(c) == F.col("_v"), "left").join(unknown).withColumn(f"{c}_encoded", F.coalesce("_nr", "_other")).drop("_v", "_nr", "_other")
    for c in frequencies:
        shares = seen.groupBy(filled(c).alias("_v")).agg((F.count("*") / total).alias("_share"))
        out = out.join(shares, filled(c) == F.col("_v"), "left").withColumn(f"{c}_freq", F.round(F.coalesce("_share", F.lit(0.0)), 6)).drop("_v", "_share")
    return out


def recalled(asked: DataFrame, memory: DataFrame, threshold: float = 0.5, most: int = 3) -> DataFrame:
    """(key, repair, score) of asked (key, context, fingerprint, fields) from a memory (context, fingerprint, fields, repair): the
    repairs of equal fingerprints (score 1); without one, those of the `most` most similar memories of the same context, from a
    similarity of fields of threshold on, by their best similarity.
    """
    m = memory.distinct()
    exact = asked.select("key", "fingerprint").join(m.select("fingerprint", "repair"), "fingerprint").select("key", "repair", F.lit(1.0).alias("score")).distinct()
    rest = asked.join(exact.select("key").distinct(), "key", "left_anti")
    j = rest.alias("a").join(m.alias("m"), "context")
    like = F.size(F.array_intersect("a.fields", "m.fields")) / F.greatest(F.size(F.array_union("a.fields", "m.fields")), F.lit(1))
    near = j.select("key", F.col("m.fingerprint").alias("fp"), "repair", F.round(like, 6).alias("score")).where(F.col("score") >= threshold)
    place = F.dense_rank().over(Window.partitionBy("key").orderBy(F.desc("score"), "fp"))
    best = near.withColumn("place", place).where(F.col("place") <= most).groupBy("key", "repair").agg(F.max("score").alias("score"))
    return exact.unionAll(best)
