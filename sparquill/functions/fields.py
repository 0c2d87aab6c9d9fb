"""Checks and readings of single fields, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parties that a free text may begin with, and what they are called.
HINTS = {
    "BNFBNK": "BeneficiaryBankInfo", "BNFPTY": "BeneficiaryPartyInfo", "BNPPTY": "BeneficiaryPartyInfo", "CDTPTY": "CreditPartyInfo", "DBTPTY": "DebitPartyInfo", "ORGPTY": "OriginatingPartyInfo",
    "INTBNK": "IntermediaryBankInfo", "SNDBNK": "SendingBankInfo", "ACWBNK": "AccountWithInstitution", "ORDBNK": "OrderingInstitution",
}
# What a repair of a field is said to be, by the first text that the field's name contains.
REPAIR_TEXTS = [
    ("BICFI", "BIC looked up from Clearing System ID"), ("BIC", "BIC looked up from Clearing System ID"), ("NM", "Name looked up from BIC"), ("NAME", "Name looked up from BIC"),
    ("PSTLADR", "Address looked up from BIC"), ("ADDRESS", "Address looked up from BIC"), ("CTRYOFRES", "Country Code extracted from address"), ("COUNTRY", "Country Code extracted from address"),
    ("CDTPTY", "ISO Country Code extracted from field"), ("IBAN", "IBAN validated and formatted"), ("CLRSYSMMBID", "National clearing code looked up from BIC"), ("MMBID", "Member ID looked up from BIC"), ("CLRSYSID", "Clearing System ID identified"),
]
# The language's plain types.
PLAIN_TYPES = ("INT", "INT16", "INT32", "INT64", "REAL", "REAL32", "REAL64", "FIXED", "STRING", "BYTE", "CHAR", "UNSIGNED", "STRUCT")


def party_hint(info: Column) -> tuple[Column, Column]:
    """The party that a text begins with, and its long name; null if none."""
    short = reduce(lambda other, h: F.when(F.startswith(info, F.lit(h)), h).otherwise(other), reversed(HINTS), F.lit(None).cast("string"))
    return short, F.try_element_at(F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv]), short)


def repair_text(field: Column) -> Column:
    """What a repair of a field is said to be."""
    up = F.upper(field)
    return reduce(lambda other, kv: F.when(F.contains(up, F.lit(kv[0])), kv[1]).otherwise(other), reversed(REPAIR_TEXTS), F.concat(field, F.lit(" field added or corrected")))


def plain_type(name: Column) -> Column:
    """A declared type without its size, UNKNOWN if it is none."""
    up = F.upper(F.trim(name))
    sized = lambda base, sizes: F.when(F.startswith(up, F.lit(f"{base}(")), reduce(lambda other, s: F.when(F.contains(up, F.lit(s)), f"{base}{s}").otherwise(other), reversed(sizes), F.lit(base)))
    return F.coalesce(sized("INT", ("32", "64", "16")), sized("REAL", ("64", "32")), F.when(F.startswith(up, F.lit("UNSIGNED")), "UNSIGNED"), F.when(up.isin(*PLAIN_TYPES), up), F.lit("UNKNOWN"))


def address_country(lines: Column, countries: list[str]) -> Column:
    """The country of address lines (array of structs seq, text): in line 3, else in the last one, the first two-letter code after
    a comma, else the last one anywhere; null if there is none.
    """
    third = F.get(F.filter(lines, lambda x: (x["seq"] == "3") & (x["text"] != "")), F.lit(0))["text"]
    line = F.upper(F.trim(F.coalesce(third, F.try_element_at(lines, F.lit(-1))["text"])))
    parts = F.filter(F.split(F.replace(line, F.lit(","), F.lit(" , ")), r"\s+"), lambda p: p != "")
    letters = F.transform(parts, lambda p: F.regexp_replace(p, "[^A-Z]", ""))
    found = F.filter(F.transform(parts, lambda p, k: F.struct(F.get(letters, k).alias("code"), F.coalesce(F.get(parts, k - 1) == ",", F.lit(False)).alias("after"))), lambda x: x["code"].isin(*countries))
    return F.coalesce(F.get(F.filter(found, lambda x: x["after"]), F.lit(0))["code"], F.try_element_at(found, F.lit(-1))["code"])


def too_long(value: Column, most: int) -> Column:
    """(length, most, preview) of a text of over `most` characters, else null; the preview is its first 30."""
    preview = F.concat(F.substring(value, 1, 30), F.when(F.length(value) > 30, "...").otherwise(""))
    return F.when(F.length(value) > most, F.struct(F.length(value).alias("length"), F.lit(most).alias("most"), preview.alias("preview")))


def _levels(error: Column, warning: Column) -> Column:
    return F.when(error.isNotNull(), F.array(F.struct(F.lit("ERROR").alias("level"), error.alias("message")))).otherwise(
        F.filter(F.array(F.struct(F.when(warning.isNotNull(), "WARNING").alias("level"), warning.alias("message")), F.struct(F.lit("PASS").alias("level"), F.lit("valid").alias("message"))), lambda x: x["level"].isNotNull())
    )


def text_check(value: Column, least: int, most: int, dashes: bool = True) -> Column:
    """Levels and messages of a text field: an ERROR alone, or a WARNING of outer white space and a PASS."""
    n = F.length(value)
    error = F.when(value.isNull(), "missing").when(F.trim(value) == "", "empty").when(n < least, f"under {least} characters").when(n > most, f"over {most} characters")
    return _levels(error if dashes else F.coalesce(error, F.when(F.contains(value, F.lit("-")), "dashes not allowed")), F.when(value != F.trim(value), "outer white space"))


def code_check(value: Column, size: int) -> Column:
    """Levels and messages of a code of so many letters, as of a currency or country."""
    error = F.when(value.isNull(), "missing").when(F.length(value) != size, f"not {size} characters").when(~value.rlike(r"^\p{L}*$"), "not letters only")
    return _levels(error, F.when(value != F.upper(value), "not in upper case"))


def bic_check(value: Column) -> Column:
    """Levels and messages of a BIC, white space in it not counted."""
    v = F.replace(value, F.lit(" "), F.lit(""))
    part = lambda a, n, p: ~F.substring(v, a, n).rlike(p)
    error = F.when(value.isNull(), "missing").when(F.contains(v, F.lit("-")), "dashes not allowed").when(~F.length(v).isin(8, 11), "not 8 or 11 characters")
    error = F.coalesce(error, F.when(part(1, 4, r"^\p{L}*$"), "bank code not letters").when(part(5, 2, r"^\p{L}*$"), "country code not letters").when(part(7, 2, r"^[\p{L}\p{N}]*$"), "location code not letters and digits"))
    return _levels(error, F.lit(None).cast("string"))


def repair_needs(rows_have: dict[str, Column]) -> dict[str, Column]:
    """Which repairs a party needs, by its bic, iban, clearing, country, name, address (array) and remittance (array)."""
    c = rows_have
    has = lambda name: F.coalesce(c[name] != "", F.lit(False))
    chars = F.aggregate(c["address"], F.lit(0), lambda s, x: s + F.length(x))
    return {
        "country_from_bic": has("bic") & ~has("country"),
        "country_from_iban": has("iban") & ~has("bic") & ~has("country"),
        "bic_from_clearing": has("clearing") & ~has("bic"),
        "name_from_bic": has("bic") & ~has("name"),
        "address_standardised": F.coalesce((chars > 140) | (F.size(c["address"]) > 3), F.lit(False)),
        "remittance_split": F.coalesce(F.exists(c["remittance"], lambda x: F.length(x) > 140), F.lit(False)),
    }


def normal_metadata(c: Column) -> Column:
    """A JSON object as it is; any other JSON value, or a text that is none, as {"value": it}; null as {}."""
    object_ = F.startswith(F.trim(c), F.lit("{")) & F.try_parse_json(c).isNotNull()
    return F.when(c.isNull(), "{}").when(object_, c).otherwise(F.to_json(F.struct(c.alias("value"))))
