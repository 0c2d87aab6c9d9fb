"""Bank directories of several kinds and formats in one schema, and lookups in them.

A directory row is (kind, code, bank_name, country, city, status, valid_from, valid_to). Kinds: bic by its first eight
characters, aba, and the sort codes gb, de and au.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.functions.identifiers import aba_valid

SCHEMA = {"kind": "string", "code": "string", "bank_name": "string", "country": "string", "city": "string", "status": "string", "valid_from": "date", "valid_to": "date"}
#: The digits of a code, and the country of a kind's codes; a BIC has its own.
DIGITS = {"aba": 9, "gb": 6, "de": 8, "au": 6}
COUNTRIES = {"aba": "US", "gb": "GB", "de": "DE", "au": "AU"}
BIC = "^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$"


def code_of(kind: str, code: Column) -> Column:
    """The code as directories hold it; null where it can't be one."""
    if kind == "bic":
        b = F.upper(F.trim(code))
        return F.when(F.length(b) >= 8, F.substring(b, 1, 8))
    bare = F.trim(code) if kind == "aba" else F.regexp_replace(code, "[- ]", "")
    return F.when(bare.rlike(f"^[0-9]{{{DIGITS[kind]}}}$"), bare)


def normalised(rows: DataFrame, kind: str, names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(directory rows, rejected rows) of one source. names gives the source's column for a column of the schema, where it has another name.

    A row whose code can't be one of its kind is rejected, as it came. Columns that a source lacks are null; its
    status is active then, and the country that of its kind.
    """
    have = {c.lower(): c for c in rows.columns}
    source = lambda c: (names or {}).get(c, have.get({"code": {"bic": "bic", "aba": "routing_number"}.get(kind, "code")}.get(c, c)))
    col = lambda c: F.col(f"`{source(c)}`").cast(SCHEMA[c]) if source(c) else F.lit(None).cast(SCHEMA[c])
    code = code_of(kind, col("code"))
    country = F.coalesce(F.nullif(F.upper(F.trim(col("country"))), F.lit("")), F.substring(code, 5, 2) if kind == "bic" else F.lit(COUNTRIES[kind]))
    made = {"kind": F.lit(kind), "code": code, "country": country, "status": F.lower(F.coalesce(F.nullif(F.trim(col("status")), F.lit("")), F.lit("active")))}
    return rows.where(code.isNotNull()).select(*[made.get(c, col(c)).alias(c) for c in SCHEMA]), rows.where(code.isNull())


def read_csv(spark: SparkSession, path: str, kind: str, delimiter: str = ",", names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """normalised() of files with a header line; all columns are read as strings."""
    return normalised(spark.read.csv(path, header=True, sep=delimiter), kind, names)


def read_json(spark: SparkSession, path: str, kind: str, names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """normalised() of JSON lines, or of files that are one array of objects."""
    return normalised(spark.read.json(path, multiLine=True), kind, names)


def directory(parts: list[DataFrame]) -> DataFrame:
    """The parts as one directory with one row for each kind, code and first day of validity: the one of the last part that has it, then the largest."""
    marked = [p.select(*SCHEMA, F.lit(k).alias("part")) for k, p in enumerate(parts)]
    rows = reduce(DataFrame.unionAll, marked)
    keys = ["kind", "code", "valid_from"]
    rest = [c for c in SCHEMA if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct("part", *rest)).alias("r"))
    return last.select(*keys, *[f"r.{c}" for c in rest]).select(*SCHEMA)


def lookup(asked: DataFrame, held: DataFrame, loaded: list[str]) -> DataFrame:
    """asked (key, kind, code, country, day) with `exists`, `message` and `bank_name`; kind is bic or nch, whose directory the country names.

    Checked in order: an empty code, its form, a checksum where it has one; then a kind whose directory is not among
    the loaded ones passes; else the code must be held and active on the day (null: on any; the latest counts). A
    country without a directory passes. Each distinct question is looked up once, and the answer joined to its rows.
    """
    code, country = F.trim("code"), F.upper(F.coalesce("country", F.lit("")))
    form = F.when(F.col("kind") == "bic", "bic")
    for kind, place in COUNTRIES.items():
        form = form.when(country == place, kind)
    questions = asked.select("kind", "code", "country", "day").distinct().withColumn("form", form)
    own = F.when(F.col("form") == "bic", F.when(F.upper(code).rlike(BIC), code_of("bic", code)))
    for kind in DIGITS:
        own = own.when(F.col("form") == kind, code_of(kind, F.regexp_replace(code, "[- ]", "")))
    questions = questions.withColumn("own", own)
    fits = (F.col("day").isNull()) | ((F.coalesce("valid_from", F.col("day")) <= F.col("day")) & (F.coalesce("valid_to", F.col("day")) >= F.col("day")))
    keys = ["kind", "code", "country", "day"]
    known = held.select(F.col("kind").alias("form"), F.col("code").alias("own"), "bank_name", "status", "valid_from", "valid_to")
    met = questions.join(known, ["form", "own"]).where(fits)
    found = met.groupBy(*keys).agg(F.max(F.struct(F.coalesce("valid_from", F.lit("0001-01-01").cast("date")).alias("since"), "status", "bank_name")).alias("f"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys]
    q = questions.alias("q").join(found.alias("m"), reduce(Column.__and__, same("q", "m")), "left").select("q.*", "f")
    message = (
        F.when(F.coalesce("code", F.lit("")) == "", "empty").when(F.col("form").isNull(), "no directory for the country").when(F.col("own").isNull(), "format")
        .when((F.col("form") == "aba") & ~aba_valid(F.col("own"))[1], "checksum").when(~F.col("form").isin(loaded), "not loaded")
        .when(F.col("f").isNull(), "unknown").when(F.col("f.status") != "active", "inactive")
    )
    answered = q.select(*keys, message.alias("message"), F.col("f.bank_name").alias("bank_name"))
    out = asked.alias("q").join(answered.alias("m"), reduce(Column.__and__, same("q", "m")), "left")
    passes = F.col("message").isNull() | F.col("message").isin("no directory for the country", "not loaded")
    return out.select("q.*", passes.alias("exists"), "message", "bank_name")
