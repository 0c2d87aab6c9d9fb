"""Repairs of payments: conditions of discovered rules, predicted repairs, states before a repair and what one changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.functions import json

# Entities that a repair may touch, those with change features of their own, metadata that stays.
ENTITIES = ("cdtr", "dbtr", "cdtrAgt", "dbtrAgt", "cdtrAcct", "dbtrAcct", "instgAgt", "instdAgt", "intrmyAgt1", "intrmyAgt2", "rmtInf")
KEY_ENTITIES = ("cdtrAgt", "dbtrAgt", "cdtr", "dbtr")
METADATA = ("source", "clearing", "flags", "parties")
TOPICS = {"address": "address|adrline", "remittance": "remittance|rmtinf|ustrd"}
SURE = 0.95


def tests(facts: DataFrame, key: str, entities: Column) -> DataFrame:
    """(key, test): what a condition can ask of a payment and that is so. facts has n_bic, n_mmbid, n_nm and n_ctry; entities
    are the lower-case names of a payment's top keys."""
    n = lambda f: F.col(f"n_{f}") > 0
    asked = [F.when(n("bic"), "bic").otherwise("no bic"), F.when(n("mmbid"), "clearing"), F.when(n("nm"), "name"), F.when(~n("ctry"), "no country")]
    return facts.select(key, F.explode(F.concat(F.array_compact(F.array(*asked)), F.transform(entities, lambda e: F.concat(F.lit("changes in "), e)))).alias("test"))


def condition_parts(rules: DataFrame) -> DataFrame:
    """(nr, test, n_tests): the distinct tests of each rule (nr, condition), whose parts AND joins.

    Only a missing bic or country can be asked for; NOT before another test is not heard. A part that mentions both a
    missing country and a bic asks for a missing bic. A part of another form is never met.
    """
    parts = rules.select("nr", F.explode(F.split("condition", "AND")).alias("part")).select("nr", F.lower(F.trim("part")).alias("part"))
    p = F.col("part")
    has = lambda s: F.contains(p, F.lit(s))
    missing = has("not has_bic") | has("not has_country")
    test = (
        F.when(missing & has("bic"), "no bic").when(missing, "no country").when(has("has_bic"), "bic").when(has("has_clearing"), "clearing").when(has("has_name"), "name")
        .when(has("changes_in_"), F.concat(F.lit("changes in "), F.get(F.split(p, "changes_in_"), F.lit(1)))).otherwise("never")
    )
    own = parts.select("nr", test.alias("test")).distinct()
    return own.join(own.groupBy("nr").agg(F.count("*").alias("n_tests")), "nr")


def fired(met: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """(key, nr): the rules all of whose tests a payment meets. Rules are looked up by test, so that a payment meets only rules
    that ask something that it has; any number of rules is one plan."""
    return met.join(parts, "test").groupBy(key, "nr").agg(F.count("*").alias("n"), F.first("n_tests").alias("n_tests")).where("n = n_tests").select(key, "nr")


def predicted(facts: DataFrame, rules: DataFrame, key: str, entities: Column) -> DataFrame:
    """(key, repairs): for each payment with any, its repairs in order as (repair_id, confidence, rule); rule tells what fired.

    First the three sure ones: a country from a BIC (6021), a BIC from a clearing id (6035), a name from a BIC (6036).
    Then the first rule on addresses, if these are long, and the first on remittances, if one is; then a country from
    an IBAN (6021), and the rules of at least 0.95 whose conditions hold. A repair counts once, where it came first; a rule
    on addresses or remittances whose repair there is already gives way to the next one. rules has nr (the order),
    repair_id, description, condition and confidence. facts has n_bic, n_iban, n_mmbid, n_nm, n_ctry, n_adrline,
    chars_adrline and longest_ustrd.
    """
    n = lambda f: F.col(f"n_{f}") > 0
    known = [
        (1, n("bic") & ~n("ctry"), "6021", 1.0, "country from bic"), (2, n("mmbid") & ~n("bic"), "6035", 1.0, "bic from clearing"), (3, n("bic") & ~n("nm"), "6036", 1.0, "name from bic"),
        (6, n("iban") & ~n("bic") & ~n("ctry"), "6021", 0.95, "country from iban"),
    ]
    option = lambda stage, nr, repair, sure, rule: F.struct(F.lit(stage).alias("stage"), nr.cast("long").alias("nr"), repair.alias("repair_id"), sure.cast("double").alias("confidence"), rule.alias("rule"))
    own = F.array_compact(F.array(*[F.when(c, option(stage, F.lit(0), F.lit(repair), F.lit(sure), F.lit(rule))) for stage, c, repair, sure, rule in known]))
    needs = {"address": (F.col("chars_adrline") > 140) | (F.col("n_adrline") > 3), "remittance": F.col("longest_ustrd") > 140}
    topics = F.array_compact(F.array(*[F.when(c, t) for t, c in needs.items()]))
    fixed = facts.select(key, F.explode(own).alias("o"))
    about = [rules.where(F.lower("description").rlike(pattern)).select(F.lit(t).alias("topic"), option(4 + k, F.col("nr"), F.col("repair_id"), F.col("confidence"), F.lit(t)).alias("o")) for k, (t, pattern) in enumerate(TOPICS.items())]
    topical = facts.select(key, F.explode(topics).alias("topic")).join(reduce(DataFrame.unionAll, about), "topic").select(key, "o")
    certain = rules.where(F.col("confidence") >= SURE)
    found = fired(tests(facts, key, entities), condition_parts(certain), key).join(certain, "nr").select(key, option(7, F.col("nr"), F.col("repair_id"), F.col("confidence"), F.lit("discovered")).alias("o"))
    options = fixed.unionAll(topical).unionAll(found).groupBy(key).agg(F.array_sort(F.collect_list("o")).alias("options"))
    nothing = F.array().cast("array<struct<stage:int,nr:bigint,repair_id:string,confidence:double,rule:string>>")

    def add(taken: Column, o: Column) -> Column:
        again = F.exists(taken, lambda t: (t["repair_id"] == o["repair_id"]) | ((t["stage"] == o["stage"]) & o["stage"].isin(4, 5)))
        return F.when(again, taken).otherwise(F.concat(taken, F.array(o)))

    chosen = F.transform(F.aggregate("options", nothing, add), lambda t: F.struct(t["repair_id"].alias("repair_id"), t["confidence"].alias("confidence"), t["rule"].alias("rule")))
    return options.select(key, chosen.alias("repairs"))


def before_states(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, document): each payment as it was before its repairs, rebuilt from its nodes.

    Entities that hold `before` are what that holds, other entities as they are if they are objects; entities get
    their usual spelling; metadata stays; all else goes. A payment of which nothing stays is an empty object.
    """
    n = json.nodes(rows, key, document)
    known = F.create_map(*[F.lit(x) for e in ENTITIES for x in (e.lower(), e)])
    name = F.try_element_at(known, F.lower("path"))
    member = F.lower(F.regexp_extract("path", r"\.(.*)$", 1))
    top = n.where((F.size("at") == 1) & (F.col("path").isin(*METADATA) | (name.isNotNull() & (F.col("kind") == "object"))))
    before = n.where((F.size("at") == 2) & (F.substring_index("path", ".", -1) == "before") & (member == "before"))
    states = before.select(key, F.col("parent").alias("path"), _json("kind", "value").alias("before"))
    whole = top.select(key, "path", F.coalesce(name, F.col("path")).alias("entity"), _json("kind", "value").alias("value")).join(states, [key, "path"], "left")
    leaves = whole.select(key, F.array("entity").alias("path"), F.when(F.col("path").isin(*METADATA), F.col("value")).otherwise(F.coalesce("before", "value")).alias("value"))
    every = rows.where(F.try_parse_json(document).isNotNull()).select(key, F.array().cast("array<string>").alias("path"), F.lit("{}").alias("value"))
    return json.rebuilt(leaves.unionAll(every), key)


def _json(kind: str, value: str) -> Column:
    """A node's value as JSON."""
    text = F.to_json(F.array(value))
    return F.when(F.col(kind) == "string", text.substr(F.lit(2), F.length(text) - 2)).when(F.col(kind) == "null", "null").otherwise(F.col(value))


def changes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What repairs changed in entities: rows (keys, entity, before, after) of JSON strings, with added, removed and changed (sorted
    paths of fields), structure (what changed as a whole), total and signature.

    Fields are the keys of objects, nested ones too, but for those in arrays. An entity that is null or empty before
    or after was added or removed; nothing else is said of it then. Clearing is restructured where a member id stands
    before, and one and a clearing system after; its structure is added where only the state after has one.
    """
    both = rows.select(F.struct(*keys, "entity").alias("k"), "before", "after")
    empty = lambda c: F.coalesce(F.to_json(F.try_parse_json(c)).isin("{}", "null"), F.lit(True))
    here = [json.nodes(both.where(~empty("before") & ~empty("after")), "k", c).where("NOT contains(path, '[')").select("k", "path", F.struct("kind", "value").alias(c)) for c in ("before", "after")]
    met = here[0].join(here[1], ["k", "path"], "full")
    own = F.substring_index("path", ".", -1)
    seen = lambda side, *names: F.coalesce(F.bool_or(F.col(side).isNotNull() & reduce(Column.__or__, [F.contains(own, F.lit(x)) for x in names])), F.lit(False))
    gathered = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("path"))))
    inner = met.groupBy("k").agg(
        gathered(F.col("before").isNull()).alias("added"), gathered(F.col("after").isNull()).alias("removed"), gathered(F.col("before").isNotNull() & F.col("after").isNotNull() & ~F.col("before").eqNullSafe(F.col("after"))).alias("changed"),
        (seen("before", "MmbId") & seen("after", "ClrSysId") & seen("after", "MmbId")).alias("moved"), (~seen("before", "ClrSysId", "ClrSysMmbId") & seen("after", "ClrSysId", "ClrSysMmbId")).alias("cleared"),
    )
    whole = F.when(empty("before") & ~empty("after"), "entity_added").when(~empty("before") & empty("after"), "entity_removed")
    out = both.select("k", whole.alias("whole")).join(inner, "k", "left")
    structure = F.array_compact(F.array(F.col("whole"), F.when(F.col("moved"), "mmbid_restructured"), F.when(F.col("cleared"), "clearing_structure_added")))
    none = F.array().cast("array<string>")
    out = out.select("k.*", *[F.coalesce(c, none).alias(c) for c in ("added", "removed", "changed")], structure.alias("structure"))
    counts = [F.when(F.size(c) > 0, F.concat(F.lit(f"{c}:"), F.size(c).cast("string"))) for c in ("added", "removed", "changed")]
    signature = F.concat(F.col("entity"), F.lit(":"), F.array_join(F.concat(F.array_compact(F.array(*counts)), F.col("structure")), ","))
    return out.withColumns({"total": F.size("added") + F.size("removed") + F.size("changed") + F.size("structure"), "signature": signature})


def change_patterns(changed: DataFrame, repairs: DataFrame, key: str) -> DataFrame:
    """(signature, repair_id, n): how often a change of that form goes with a repair of the same payment."""
    return changed.select(key, "signature").join(repairs.select(key, "repair_id"), key).groupBy("signature", "repair_id").agg(F.count("*").alias("n"))


def change_features(changed: DataFrame, key: str) -> DataFrame:
    """One row of numbers from 0 to 1 for each payment of changes()."""
    total = lambda c, by: F.least(F.sum(F.size(c)) / by, F.lit(1.0))
    of = lambda e, c: F.coalesce(F.max(F.when(F.col("entity") == e, c)), F.lit(0.0))
    structure = lambda e, what: of(e, F.array_contains("structure", what).cast("double"))
    entities = [c for e in KEY_ENTITIES for c in (of(e, F.least(F.col("total") / 5, F.lit(1.0))).alias(f"{e}_changes"), structure(e, "entity_added").alias(f"{e}_added"), structure(e, "mmbid_restructured").alias(f"{e}_restructured"))]
    adds = [F.max(F.contains(F.lower(F.array_join("added", " ")), F.lit(w)).cast("double")).alias(f"{w}_added") for w in ("bic", "nm", "ctry")]
    return changed.groupBy(key).agg(total("added", 10).alias("added"), total("removed", 10).alias("removed"), total("changed", 10).alias("changed"), *entities, *adds)
