"""Repeated occurrences of a payment's parties merged into one, as an aggregation with partial results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.functions.identifiers import cleaned, iban_valid


def looks_like_iban(account: Column) -> Column:
    """Two letters, two digits and 11 to 30 letters or digits, without regard to spaces and hyphens."""
    return F.coalesce(cleaned(account).rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), F.lit(False))


def merged(occurrences: DataFrame, keys: list[str], ordinal: str, account: str, first: list[str], filled: list[str]) -> DataFrame:
    """One row for each of the keys (none of them null): occurrences (how many), the fields and the account.

    Fields of `first` are the first occurrence's, null or not; those of `filled` the first that is not null. The account is
    the first occurrence's, unless a later one looks like an IBAN and the first does not: then the first that does.
    account_type is IBAN, or OTHER, or null without an account; iban_valid tells format and checksum; iban_country is
    its first two letters. Each field is the least of structs led by its rank, so equal ordinals go by value.
    """
    led = lambda rank, c: F.struct(*rank, c.alias("v"))
    place, iban = F.col(ordinal), looks_like_iban(F.col(account))
    aggs = [F.min(led([place], F.col(c)))["v"].alias(c) for c in first]
    aggs += [F.min(F.when(F.col(c).isNotNull(), led([place], F.col(c))))["v"].alias(c) for c in filled]
    best = F.min(F.when(F.col(account).isNotNull() & iban, led([place], F.col(account))))["v"]
    plain = F.min(led([place], F.col(account)))["v"]
    out = occurrences.groupBy(*keys).agg(F.count("*").alias("occurrences"), *aggs, F.coalesce(best, plain).alias(account))
    good, checked = iban_valid(F.col(account))
    is_iban = looks_like_iban(F.col(account))
    kind = F.when(F.col(account).isNotNull(), F.when(is_iban, "IBAN").otherwise("OTHER"))
    return out.withColumns({"account_type": kind, "iban_valid": is_iban & good & checked, "iban_country": F.when(is_iban, F.substring(cleaned(F.col(account)), 1, 2)), "needs_formatting": is_iban & F.col(account).rlike("[ -]")})


def entries_counted(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, count, present): rows of repeated entries, such as bank information, for each of the keys."""
    return entries.groupBy(*keys).agg(F.count("*").alias("count")).withColumn("present", F.col("count") > 0)
