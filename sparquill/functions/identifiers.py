"""Checks of payment identifiers as column expressions: IBAN, BIC, ABA, national account numbers.

Each takes string columns and gives nullable-safe booleans: a null or malformed value is False.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Registered IBAN lengths by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24,
    "XK": 20,
}
# National account structures by country.
BBAN_STRUCTURES = {
    "DE": r"^(\d{8})(\d{10})$", "FR": r"^(\d{5})(\d{5})([A-Z0-9]{11})(\d{2})$", "ES": r"^(\d{4})(\d{4})(\d{2})(\d{10})$", "IT": r"^([A-Z])(\d{5})(\d{5})([A-Z0-9]{12})$",
    "NL": r"^([A-Z]{4})(\d{10})$", "BE": r"^(\d{3})(\d{7})(\d{2})$", "AT": r"^(\d{5})(\d{11})$", "CH": r"^(\d{5})([A-Z0-9]{12})$", "LU": r"^(\d{3})([A-Z0-9]{13})$",
    "GB": r"^([A-Z]{4})(\d{6})(\d{8})$", "IE": r"^([A-Z]{4})(\d{6})(\d{8})$", "FI": r"^(\d{3})(\d{11})$", "SE": r"^(\d{3})(\d{17})$", "NO": r"^(\d{4})(\d{6})(\d{1})$",
    "DK": r"^(\d{4})(\d{10})$", "PL": r"^(\d{8})(\d{16})$", "CZ": r"^(\d{4})(\d{6})(\d{10})$", "SK": r"^(\d{4})(\d{6})(\d{10})$", "HU": r"^(\d{3})(\d{4})(\d{1})(\d{15})(\d{1})$",
    "RO": r"^([A-Z]{4})([A-Z0-9]{16})$", "BG": r"^([A-Z]{4})(\d{4})(\d{2})([A-Z0-9]{8})$", "HR": r"^(\d{7})(\d{10})$", "SI": r"^(\d{5})(\d{8})(\d{2})$", "RS": r"^(\d{3})(\d{13})(\d{2})$",
    "EE": r"^(\d{2})(\d{14})$", "LV": r"^([A-Z]{4})([A-Z0-9]{13})$", "LT": r"^(\d{5})(\d{11})$", "PT": r"^(\d{4})(\d{4})(\d{11})(\d{2})$", "GR": r"^(\d{3})(\d{4})([A-Z0-9]{16})$",
    "CY": r"^(\d{3})(\d{5})([A-Z0-9]{16})$", "MT": r"^([A-Z]{4})(\d{5})([A-Z0-9]{18})$", "SA": r"^(\d{2})([A-Z0-9]{18})$", "AE": r"^(\d{3})(\d{16})$", "IL": r"^(\d{3})(\d{3})(\d{13})$",
    "TR": r"^(\d{5})(0)([A-Z0-9]{16})$", "QA": r"^([A-Z]{4})([A-Z0-9]{21})$", "KW": r"^([A-Z]{4})([A-Z0-9]{22})$", "BH": r"^([A-Z]{4})([A-Z0-9]{14})$", "MC": r"^(\d{5})(\d{5})([A-Z0-9]{11})(\d{2})$",
    "SM": r"^([A-Z])(\d{5})(\d{5})([A-Z0-9]{12})$", "LI": r"^(\d{5})([A-Z0-9]{12})$",
}
# Check-digit weights.
ABA_WEIGHTS = (3, 7, 1, 3, 7, 1, 3, 7, 1)
SPANISH_WEIGHTS = (1, 2, 4, 8, 5, 10, 9, 7, 3, 6)
NORWEGIAN_WEIGHTS = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
POLISH_WEIGHTS = (3, 9, 7, 1, 3, 9, 7)
CZECH_WEIGHTS = (6, 3, 7, 9, 10, 5, 8, 4, 2, 1)
HUNGARIAN_WEIGHTS = (9, 7, 3, 1)
ESTONIAN_WEIGHTS = (7, 3, 1)
# What 0-9 and A-Z count at odd places of an Italian account.
ITALIAN_ODD = (
    1, 0, 5, 7, 9, 13, 15, 17, 19, 21,
    1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23,
)
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def cleaned(c: Column) -> Column:
    return F.upper(F.translate(c, " -", ""))


def _code(c: Column, k: int) -> Column:
    """A digit's value or a letter's, A = 10, of the k-th character (from 1)."""
    at = F.ascii(F.substring(c, k, 1))
    return F.when(at >= 65, at - 55).otherwise(at - 48)


def weighted(c: Column, weights: tuple[int, ...]) -> Column:
    """The sum of digit times weight over the string's first characters."""
    return reduce(Column.__add__, [_code(c, k + 1) * w for k, w in enumerate(weights)])


def repeated(weights: tuple[int, ...], n: int) -> tuple[int, ...]:
    return tuple(weights[k % len(weights)] for k in range(n))


def to_ten(total: Column) -> Column:
    """What is missing to the next multiple of ten."""
    return (10 - total % 10) % 10


def mod97(c: Column) -> Column:
    """The number that a string of digits and letters (A = 10) writes, modulo 97; any length."""
    def step(rest: Column, ch: Column) -> Column:
        at = F.ascii(ch)
        return F.when(at >= 65, (rest * 100 + at - 55) % 97).otherwise((rest * 10 + at - 48) % 97)

    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0), step)


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def iban_valid(c: Column) -> tuple[Column, Column]:
    """(format, checksum): the country's length, else 15 to 34; and the whole modulo 97 is 1."""
    s = cleaned(c)
    country = F.substring(s, 1, 2)
    n = F.length(s)
    known = reduce(lambda out, kv: out.when(country == kv[0], n == kv[1]), IBAN_LENGTHS.items(), F.when(n < 5, False)).otherwise(n.between(15, 34))
    letters = country.rlike("^[A-Z]{2}$") & (n >= 5)
    turned = F.concat(F.substring(s, F.lit(5), n), F.substring(s, 1, 4))
    return sure(letters & known), sure(letters & s.rlike("^[A-Z0-9]*$") & F.when(s.rlike("^[A-Z0-9]*$"), mod97(turned) == 1))


def bic_valid(c: Column, countries: list[str]) -> tuple[Column, Column]:
    """(format, country): 8 or 11 characters of the bank pattern; characters 5 and 6 in countries."""
    s = F.upper(F.trim(c))
    sized = F.length(s).isin(8, 11)
    return sure(sized & s.rlike("^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$")), sure(sized & F.substring(s, 5, 2).isin(countries))


def bic4_valid(c: Column) -> Column:
    return sure(c.rlike("^[A-Za-z]{4}"))


def aba_valid(c: Column) -> tuple[Column, Column]:
    """(format, checksum) of a nine-digit routing number."""
    s = F.trim(c)
    nine = sure(s.rlike("^[0-9]{9}$"))
    return nine, nine & sure(F.when(nine, weighted(s, ABA_WEIGHTS) % 10 == 0))


def french_key(bank: Column, branch: Column, account: Column, stated: Column) -> Column:
    digits = F.translate(F.upper(account), LETTERS, "12345678912345678923456789")
    number = lambda c: c.cast("decimal(38,0)")
    return number(stated) == 97 - (number(bank) * 89 + number(branch) * 15 + number(digits) * 3) % 97


def spanish_digits(bank: Column, branch: Column, stated: Column, account: Column) -> Column:
    def digit(c: Column) -> Column:
        rest = 11 - weighted(c, SPANISH_WEIGHTS) % 11
        return F.when(rest == 11, 0).when(rest == 10, 1).otherwise(rest)

    return stated == F.concat(digit(F.concat(F.lit("00"), bank, branch)).cast("string"), digit(account).cast("string"))


def italian_letter(stated: Column, bank: Column, branch: Column, account: Column) -> Column:
    odd = F.array(*[F.lit(v) for v in ITALIAN_ODD])
    code = F.upper(F.concat(bank, branch, account))
    total = reduce(Column.__add__, [F.get(odd, _code(code, k)) if k % 2 else F.when(_code(code, k) >= 10, _code(code, k) - 10).otherwise(_code(code, k)) for k in range(1, 23)])
    return F.upper(stated) == F.substring(F.lit(LETTERS), total % 26 + 1, F.lit(1))


def belgian_digits(bank: Column, account: Column, stated: Column) -> Column:
    rest = F.concat(bank, account).cast("long") % 97
    return stated.cast("long") == F.when(rest == 0, 97).otherwise(rest)


def finnish_digit(bank: Column, account: Column) -> Column:
    full = F.concat(bank, account)  # 14 digits, the last is the check digit; weights 2, 1, ... from its left
    parts = [_code(full, k) * (2 if k % 2 else 1) for k in range(1, 14)]
    return _code(full, 14) == to_ten(reduce(Column.__add__, [F.when(p < 10, p).otherwise(p - 9) for p in parts]))


def norwegian_digit(bank: Column, account: Column, stated: Column) -> Column:
    rest = weighted(F.concat(bank, account), NORWEGIAN_WEIGHTS) % 11
    return F.when(rest == 1, False).otherwise(stated.cast("int") == F.when(rest == 0, 0).otherwise(11 - rest))


def polish_digit(bank_branch: Column) -> Column:
    return _code(bank_branch, 8) == to_ten(weighted(bank_branch, POLISH_WEIGHTS))


def czech_digits(prefix: Column, account: Column) -> Column:
    return (weighted(prefix, CZECH_WEIGHTS[4:]) % 11 == 0) & (weighted(account, CZECH_WEIGHTS) % 11 == 0)


def hungarian_digits(bank: Column, branch: Column, check1: Column, account: Column, check2: Column) -> Column:
    first = to_ten(weighted(F.concat(bank, branch), repeated(HUNGARIAN_WEIGHTS, 7)))
    return (check1.cast("int") == first) & (check2.cast("int") == to_ten(weighted(account, repeated(HUNGARIAN_WEIGHTS, 15))))


def estonian_digit(bank: Column, account: Column) -> Column:
    full = F.concat(bank, account)
    return _code(full, 16) == to_ten(weighted(full, repeated(ESTONIAN_WEIGHTS, 15)))


def mod97_digits(number: Column, stated: Column) -> Column:
    """98 less the number times 100 modulo 97: Slovenia, Serbia, Portugal."""
    return stated.cast("int") == 98 - (mod97(number) * 100) % 97


def bban_valid(iban: Column) -> tuple[Column, Column]:
    """(structure, national check) of what follows an IBAN's first four characters; countries without a check pass it."""
    s = cleaned(iban)
    country, bban = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))
    part = lambda code, k: F.regexp_extract(bban, BBAN_STRUCTURES[code], k)
    checks = {
        "FR": lambda c: french_key(part(c, 1), part(c, 2), part(c, 3), part(c, 4)), "MC": lambda c: french_key(part(c, 1), part(c, 2), part(c, 3), part(c, 4)),
        "ES": lambda c: spanish_digits(part(c, 1), part(c, 2), part(c, 3), part(c, 4)),
        "IT": lambda c: italian_letter(part(c, 1), part(c, 2), part(c, 3), part(c, 4)), "SM": lambda c: italian_letter(part(c, 1), part(c, 2), part(c, 3), part(c, 4)),
        "BE": lambda c: belgian_digits(part(c, 1), part(c, 2), part(c, 3)), "FI": lambda c: finnish_digit(part(c, 1), part(c, 2)),
        "NO": lambda c: norwegian_digit(part(c, 1), part(c, 2), part(c, 3)), "PL": lambda c: polish_digit(part(c, 1)),
        "CZ": lambda c: czech_digits(part(c, 2), part(c, 3)), "SK": lambda c: czech_digits(part(c, 2), part(c, 3)),
        "HU": lambda c: hungarian_digits(*[part(c, k) for k in range(1, 6)]), "EE": lambda c: estonian_digit(part(c, 1), part(c, 2)),
        "SI": lambda c: mod97_digits(F.concat(part(c, 1), part(c, 2)), part(c, 3)), "RS": lambda c: mod97_digits(F.concat(part(c, 1), part(c, 2)), part(c, 3)),
        "PT": lambda c: mod97_digits(F.concat(part(c, 1), part(c, 2), part(c, 3)), part(c, 4)),
    }
    shaped = reduce(lambda out, kv: out.when(country == kv[0], bban.rlike(kv[1])), BBAN_STRUCTURES.items(), F.when(s.isNull() | (F.length(s) < 5), False)).otherwise(F.lit(True))
    checked = reduce(lambda out, kv: out.when((country == kv[0]) & bban.rlike(BBAN_STRUCTURES[kv[0]]), kv[1](kv[0])), checks.items(), F.when(~shaped, False)).otherwise(F.lit(True))
    return sure(shaped), sure(checked)


def account_type(c: Column) -> Column:
    """CLABE (18 digits), ABA (9 with a good checksum), CHIPS (6 digits) or null."""
    s = F.trim(c)
    return F.when(s.rlike("^[0-9]{18}$"), "CLABE").when(aba_valid(s)[1], "FEDABA").when(s.rlike("^[0-9]{6}$"), "CHIPS")


def looks_like_iban(c: Column) -> Column:
    s = cleaned(c)
    return sure(s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & F.length(s).between(15, 34))


def looks_like_bic(c: Column) -> Column:
    return sure(F.upper(F.trim(c)).rlike("^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$"))


def amount(c: Column) -> Column:
    """A number with commas as double; 0.0 if it is none."""
    return F.coalesce(F.replace(c, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def compound_parts(c: Column) -> tuple[Column, Column, Column]:
    """(parts between slashes, has a BIC among them, has a nine-digit routing number among them)."""
    parts = F.split(F.coalesce(c, F.lit("")), "/")
    return F.size(parts), F.exists(parts, looks_like_bic), F.exists(parts, lambda p: sure(p.rlike("^[0-9]{9}$")))


def dirty(c: Column) -> Column:
    """Has anything but letters and digits."""
    return sure(c.rlike("[^A-Za-z0-9]"))


def cleaning_reason(c: Column) -> Column:
    """What has to be cleaned, comma-separated; empty if nothing."""
    marks = [("spaces", " "), ("dashes", "-"), ("slashes", "/"), ("dots", r"\."), ("lowercase", "[a-z]")]
    return F.concat_ws(", ", *[F.when(c.rlike(pattern), name) for name, pattern in marks])


def bank_code(iban: Column, width: dict[str, int] | None = None) -> Column:
    """The first characters of the national account number, four unless the country has its own width."""
    s = cleaned(iban)
    width = width or {"DE": 8, "FR": 5, "ES": 4, "AT": 5, "CH": 5, "BE": 3, "PL": 8, "FI": 3, "PT": 4, "CZ": 4}
    n = reduce(lambda out, kv: out.when(F.substring(s, 1, 2) == kv[0], kv[1]), width.items(), F.when(F.length(s) < 5, 0)).otherwise(4)
    return F.substring(s, F.lit(5), n)


def domestic_account_valid(c: Column, country: Column) -> Column:
    """National account numbers: US 4 to 17 digits, PL 26, GB 8, DE up to 10, else 4 to 20 digits or 4 to 30 letters and digits.

    What begins as an IBAN does is none.
    """
    s = cleaned(c)
    other = s.rlike("^[0-9]{4,20}$") | (s.rlike("^[A-Z0-9]{4,30}$") & ~s.rlike("^[0-9]*$"))
    sized = F.when(country == "US", s.rlike("^[0-9]{4,17}$")).when(country == "PL", s.rlike("^[0-9]{26}$")).when(country == "GB", s.rlike("^[0-9]{8}$")).when(country == "DE", s.rlike("^[0-9]{1,10}$"))
    return sure(~s.rlike("^[A-Z]{2}[0-9]{2}") & sized.otherwise(other))
