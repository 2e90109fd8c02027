"""Check digits, as column expressions and as plain functions for Python workers.

Each check exists twice on purpose: the expressions stay in the JVM, the functions serve scans of whole catalogs, and the
tests hold the one against the other. A value of the wrong length or form fails; null stays null.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and weights of the checks.
NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
HETU_LETTERS = "0123456789ABCDEFHJKLMNPRSTUVWXY"
FISCAL_ODD = {c: v for c, v in zip("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23], strict=True)}
SSN_PREFIXES = ("000", "666", "123456789", "98765432", "078051120")
WEIGHTS = {"aba": (3, 7, 1, 3, 7, 1, 3, 7, 1), "nhs": (10, 9, 8, 7, 6, 5, 4, 3, 2, 1), "tfn": (1, 4, 3, 7, 5, 8, 6, 9, 10)}
VERHOEFF_D = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9),
    (1, 2, 3, 4, 0, 6, 7, 8, 9, 5),
    (2, 3, 4, 0, 1, 7, 8, 9, 5, 6),
    (3, 4, 0, 1, 2, 8, 9, 5, 6, 7),
    (4, 0, 1, 2, 3, 9, 5, 6, 7, 8),
    (5, 9, 8, 7, 6, 0, 4, 3, 2, 1),
    (6, 5, 9, 8, 7, 1, 0, 4, 3, 2),
    (7, 6, 5, 9, 8, 2, 1, 0, 4, 3),
    (8, 7, 6, 5, 9, 3, 2, 1, 0, 4),
    (9, 8, 7, 6, 5, 4, 3, 2, 1, 0),
)
VERHOEFF_P = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9),
    (1, 5, 7, 6, 2, 8, 3, 0, 9, 4),
    (5, 8, 0, 3, 7, 9, 6, 1, 4, 2),
    (8, 9, 1, 6, 0, 4, 3, 5, 2, 7),
    (9, 4, 5, 3, 1, 2, 6, 8, 7, 0),
    (4, 2, 8, 6, 5, 7, 3, 9, 0, 1),
    (2, 7, 9, 3, 8, 0, 6, 4, 1, 5),
    (7, 0, 4, 6, 9, 1, 3, 2, 5, 8),
)


# --- plain functions -------------------------------------------------------------------------------------------------


def _digits(s: str) -> list[int]:
    return [int(c) for c in s if c in "0123456789"]


def _dot(d: list[int], weights) -> int:
    return sum(a * b for a, b in zip(d, weights))


def _fold9(n: int) -> int:
    return n - 9 if n > 9 else n


def luhn(s: str) -> bool:
    d = _digits(s)[::-1]
    return bool(d) and (sum(d[::2]) + sum(_fold9(2 * x) for x in d[1::2])) % 10 == 0


def iban(s: str) -> bool:
    s = re.sub(r"[\s-]", "", s).upper()
    return len(s) >= 4 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ssn(s: str) -> bool:
    d = re.sub(r"\D", "", s, flags=re.ASCII)
    return len(d) == 9 and len(set(d)) > 1 and d[3:5] != "00" and d[5:] != "0000" and d[0] != "9" and not d.startswith(SSN_PREFIXES)


def mac(s: str) -> bool:
    h = re.sub(r"[:.-]", "", s).upper()
    return re.fullmatch(r"[0-9A-F]{12}", h) is not None and h not in ("F" * 12, "0" * 12)


def npi(s: str) -> bool:
    d = re.sub(r"\D", "", s, flags=re.ASCII)
    return len(d) == 10 and len(set(d[:-1])) > 1 and luhn("80840" + d)


def dea(s: str) -> bool:
    tail = re.sub(r"[\s-]", "", s)[2:]
    if not re.fullmatch(r"[0-9]+", tail):
        return False
    d = _digits(tail)
    return (2 * sum(d[:-1][::2]) + sum(d[:-1][1::2]) - d[-1]) % 10 == 0


def nif(s: str) -> bool:
    s = s.replace("-", "")
    return NIF_LETTERS[int(re.sub(r"[^0-9]", "", s)) % 23] == s[-1]


def nie(s: str) -> bool:
    s = s.replace("-", "")
    return 8 <= len(s) <= 9 and s[0] in "XYZ" and NIF_LETTERS[int(str("XYZ".index(s[0])) + s[1:-1]) % 23] == s[-1]


def fiscal(s: str) -> bool:
    s = s.upper()
    if len(s) != 16:
        return False
    total = sum(FISCAL_ODD[c] for c in s[:15:2]) + sum(int(c) if c.isdigit() else ord(c) - 65 for c in s[1:15:2])
    return chr(65 + total % 26) == s[15]


def vat(s: str) -> bool:
    d = _digits(s)
    return len(d) == 11 and any(d) and (sum(d[:10:2]) + sum(_fold9(2 * x) for x in d[1:10:2]) + d[10]) % 10 == 0


def pesel(s: str) -> bool:
    d = _digits(s)
    return len(d) == 11 and _dot(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)) % 10 == d[10]


def hetu(s: str) -> bool:
    return len(s) == 11 and HETU_LETTERS[int(s[:6] + s[7:10]) % 31] == s[10]


def personnummer(s: str) -> bool:
    d = re.sub(r"[-+]", "", s)[-10:]
    if len(d) != 10:
        return False
    month, day = int(d[2:4]), int(d[4:6])
    return 1 <= month <= 12 and (1 <= day <= 31 or 61 <= day <= 91) and luhn(d)


def steuer(s: str) -> bool:
    d = _digits(s)
    if len(d) != 11 or len(set(d[:10])) == 1:
        return False
    p = reduce(lambda p, x: ((x + p) % 10 or 10) * 2 % 11, d[:10], 10)
    return (11 - p) % 10 == d[10]


def abn(s: str) -> bool:
    d = _digits(s)
    return len(d) == 11 and (_dot([9 if d[0] == 0 else d[0] - 1, *d[1:]], (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19))) % 89 == 0


def acn(s: str) -> bool:
    d = _digits(s)
    return len(d) == 9 and -_dot(d, (8, 7, 6, 5, 4, 3, 2, 1)) % 10 == d[8]


def au_medicare(s: str) -> bool:
    d = _digits(s)
    return len(d) == 10 and _dot(d, (1, 3, 7, 9, 1, 3, 7, 9)) % 10 == d[8]


def verhoeff(n: int) -> bool:
    """Of a number, so leading zeros do not count."""
    c = 0
    for i, x in enumerate(reversed(str(n))):
        c = VERHOEFF_D[c][VERHOEFF_P[i % 8][int(x)]]
    return c == 0


def aadhaar(s: str) -> bool:
    d = re.sub(r"\D", "", s, flags=re.ASCII)
    return len(d) == 12 and d[0] >= "2" and d != d[::-1] and verhoeff(int(d))


def nin(s: str) -> bool:
    return re.fullmatch(r"[0-9]{11}", s) is not None and verhoeff(int(s))


def rrn(s: str) -> bool:
    d = _digits(s)
    return len(d) == 13 and d[7] * 10 + d[8] <= 95 and (11 - _dot(d, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)) % 11) % 10 == d[12]


def tnin(s: str) -> bool:
    d = _digits(s)
    x = _dot(d, range(13, 1, -1)) % 11 if len(d) == 13 else 0
    return len(d) == 13 and (1 - x if x <= 1 else 11 - x) == d[12]


def _weighted(name: str, modulus: int) -> Callable[[str], bool]:
    return lambda s: len(d := _digits(s)) == len(WEIGHTS[name]) and _dot(d, WEIGHTS[name]) % modulus == 0


def sentinel_year(s: str) -> bool:
    return re.fullmatch("[0-9]{4}", s[:4]) is not None and not 1900 <= int(s[:4]) <= 2100


def shannon_entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def _total(check: Callable[[str], bool]) -> Callable[[str], bool]:
    """A value of a form that the check cannot read fails it."""

    @wraps(check)
    def passes(s: str) -> bool:
        try:
            return bool(check(s))
        except (ValueError, KeyError, IndexError):
            return False

    return passes


CHECKS: dict[str, Callable[[str], bool]] = {f.__name__: _total(f) for f in (luhn, iban, ssn, mac, npi, dea, nif, nie, fiscal, vat, pesel, hetu, personnummer, steuer, abn, acn, au_medicare, aadhaar, nin, rrn, tnin, sentinel_year)} | {
    "aba": _weighted("aba", 10), "nhs": _weighted("nhs", 11), "tfn": _weighted("tfn", 11)
}


# --- column expressions ----------------------------------------------------------------------------------------------


def _only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _at(d: Column, i: int) -> Column:
    """The digit at place i, from 0."""
    return d.substr(i + 1, 1).try_cast("int")


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _weigh(d: Column, weights) -> Column:
    return _sum([_at(d, i) * w for i, w in enumerate(weights)])


def _folded(x: Column) -> Column:
    return F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)


def _known(length: int, d: Column, test: Column) -> Column:
    return F.coalesce((F.length(d) == length) & test, F.lit(False))


def _letter(letters: str, n: Column) -> Column:
    return F.lit(letters).substr((n % len(letters) + 1).cast("int"), F.lit(1))


def luhn_col(s: Column) -> Column:
    d = F.split(F.reverse(_only_digits(s)), "")
    total = F.aggregate(F.transform(d, lambda c, i: F.when(i % 2 == 1, _folded(c.try_cast("int"))).otherwise(c.try_cast("int"))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return (F.length(_only_digits(s)) > 0) & (total % 10 == 0)


def iban_col(s: Column) -> Column:
    c = F.upper(F.regexp_replace(s, r"[\s-]", ""))
    turned = F.split(F.concat(c.substr(F.lit(5), F.length(c)), c.substr(1, 4)), "")
    rest = F.aggregate(turned, F.lit(0), lambda r, x: F.when(x.rlike("^[A-Z]$"), (r * 100 + F.ascii(x) - 55) % 97).otherwise((r * 10 + F.coalesce(x.try_cast("int"), F.lit(0))) % 97))
    return (F.length(c) >= 4) & c.rlike("^[0-9A-Z]*$") & (rest == 1)


def ssn_col(s: Column) -> Column:
    d = _only_digits(s)
    bad = reduce(lambda a, b: a | b, [d.startswith(p) for p in SSN_PREFIXES])
    return (F.length(d) == 9) & ~d.rlike(r"^(\d)\1*$") & (d.substr(4, 2) != "00") & (d.substr(6, 4) != "0000") & (d.substr(1, 1) != "9") & ~bad


def mac_col(s: Column) -> Column:
    h = F.upper(F.regexp_replace(s, r"[:.\-]", ""))
    return h.rlike("^[0-9A-F]{12}$") & ~h.isin("F" * 12, "0" * 12)


def npi_col(s: Column) -> Column:
    d = _only_digits(s)
    return (F.length(d) == 10) & ~d.rlike(r"^(\d)\1{8}") & luhn_col(F.concat(F.lit("80840"), d))


def dea_col(s: Column) -> Column:
    tail = F.regexp_replace(s, r"[\s-]", "").substr(F.lit(3), F.length(s))
    d = F.split(tail, "")
    n = F.length(tail)
    total = F.aggregate(F.transform(d, lambda c, i: F.when(i == n - 1, -c.try_cast("int")).when(i % 2 == 0, 2 * c.try_cast("int")).otherwise(c.try_cast("int"))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return tail.rlike("^[0-9]+$") & (total % 10 == 0)


def nif_col(s: Column) -> Column:
    return F.coalesce(_letter(NIF_LETTERS, _only_digits(s).try_cast("bigint")) == F.right(s, F.lit(1)), F.lit(False))


def nie_col(s: Column) -> Column:
    c = F.replace(s, F.lit("-"), F.lit(""))
    n = F.concat((F.instr(F.lit("XYZ"), c.substr(1, 1)) - 1).cast("string"), c.substr(F.lit(2), F.length(c) - 2))
    return F.coalesce(F.length(c).between(8, 9) & c.rlike("^[XYZ]") & (_letter(NIF_LETTERS, n.try_cast("bigint")) == F.right(c, F.lit(1))), F.lit(False))


def fiscal_col(s: Column) -> Column:
    u = F.upper(s)
    chars = "".join(FISCAL_ODD)
    odd = F.array(*[F.lit(v) for v in FISCAL_ODD.values()])
    even = F.array(*[F.lit(int(c) if c.isdigit() else ord(c) - 65) for c in chars])
    place = [F.instr(F.lit(chars), u.substr(i + 1, 1)) for i in range(15)]
    total = _sum([F.when(p > 0, F.get(odd if i % 2 == 0 else even, p - 1)) for i, p in enumerate(place)])
    return F.coalesce((F.length(u) == 16) & (F.char(total % 26 + 65) == u.substr(16, 1)), F.lit(False))


def vat_col(s: Column) -> Column:
    d = _only_digits(s)
    return _known(11, d, ~d.rlike("^0+$") & ((_sum([_at(d, i) for i in range(0, 10, 2)]) + _sum([_folded(_at(d, i)) for i in range(1, 10, 2)]) + _at(d, 10)) % 10 == 0))


def pesel_col(s: Column) -> Column:
    d = _only_digits(s)
    return _known(11, d, _weigh(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)) % 10 == _at(d, 10))


def hetu_col(s: Column) -> Column:
    return F.coalesce((F.length(s) == 11) & (_letter(HETU_LETTERS, F.concat(s.substr(1, 6), s.substr(8, 3)).try_cast("bigint")) == s.substr(11, 1)), F.lit(False))


def personnummer_col(s: Column) -> Column:
    d = F.right(F.regexp_replace(s, "[-+]", ""), F.lit(10))
    month, day = d.substr(3, 2).try_cast("int"), d.substr(5, 2).try_cast("int")
    return _known(10, d, month.between(1, 12) & (day.between(1, 31) | day.between(61, 91)) & luhn_col(d))


def steuer_col(s: Column) -> Column:
    d = _only_digits(s)
    p = F.lit(10)
    p = F.aggregate(F.split(d.substr(1, 10), ""), p, lambda a, x: F.when((F.coalesce(x.try_cast("int"), F.lit(0)) + a) % 10 == 0, 20 % 11).otherwise((F.coalesce(x.try_cast("int"), F.lit(0)) + a) % 10 * 2 % 11))
    return _known(11, d, ~d.rlike(r"^(\d)\1{9}") & ((11 - p) % 10 == _at(d, 10)))


def abn_col(s: Column) -> Column:
    d = _only_digits(s)
    first = F.when(_at(d, 0) == 0, 9).otherwise(_at(d, 0) - 1)
    return _known(11, d, (first * 10 + _sum([_at(d, i) * (2 * i - 1) for i in range(1, 11)])) % 89 == 0)


def acn_col(s: Column) -> Column:
    d = _only_digits(s)
    return _known(9, d, (10 - _weigh(d, (8, 7, 6, 5, 4, 3, 2, 1)) % 10) % 10 == _at(d, 8))


def au_medicare_col(s: Column) -> Column:
    d = _only_digits(s)
    return _known(10, d, _weigh(d, (1, 3, 7, 9, 1, 3, 7, 9)) % 10 == _at(d, 8))


def verhoeff_col(n: Column) -> Column:
    """Of a bigint column."""
    d, p = (F.array(*[F.lit(c) for row in t for c in row]) for t in (VERHOEFF_D, VERHOEFF_P))
    digits = F.transform(F.split(F.reverse(n.cast("string")), ""), lambda c, i: F.get(p, i % 8 * 10 + c.try_cast("int")))
    return F.aggregate(digits, F.lit(0), lambda a, x: F.get(d, a * 10 + x)) == 0


def aadhaar_col(s: Column) -> Column:
    d = _only_digits(s)
    return _known(12, d, (d.substr(1, 1) >= "2") & (d != F.reverse(d)) & verhoeff_col(d.try_cast("bigint")))


def nin_col(s: Column) -> Column:
    return F.coalesce(s.rlike("^[0-9]{11}$") & verhoeff_col(s.try_cast("bigint")), F.lit(False))


def rrn_col(s: Column) -> Column:
    d = _only_digits(s)
    return _known(13, d, (d.substr(8, 2).try_cast("int") <= 95) & ((11 - _weigh(d, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)) % 11) % 10 == _at(d, 12)))


def tnin_col(s: Column) -> Column:
    d = _only_digits(s)
    x = _weigh(d, range(13, 1, -1)) % 11
    return _known(13, d, F.when(x <= 1, 1 - x).otherwise(11 - x) == _at(d, 12))


def _weighted_col(name: str, modulus: int) -> Callable[[Column], Column]:
    return lambda s: _known(len(WEIGHTS[name]), _only_digits(s), _weigh(_only_digits(s), WEIGHTS[name]) % modulus == 0)


def sentinel_year_col(s: Column) -> Column:
    return F.coalesce(s.rlike("^[0-9]{4}") & ~s.substr(1, 4).try_cast("int").between(1900, 2100), F.lit(False))


def entropy_col(s: Column) -> Column:
    """Bits for each character; 0 for an empty value. Characters are sorted, and each run of equal ones is counted at its end."""
    chars = F.array_sort(F.filter(F.split(s, ""), lambda c: c != ""))
    n = F.length(s).cast("double")
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum"))

    def part(k: Column) -> Column:
        return F.when(k > 0, k / n * F.log2(k / n)).otherwise(F.lit(0.0))

    def step(a: Column, c: Column) -> Column:
        same = a["c"] == c
        return F.struct(c.alias("c"), F.when(same, a["k"] + 1).otherwise(F.lit(1.0)).alias("k"), F.when(same, a["sum"]).otherwise(a["sum"] + part(a["k"])).alias("sum"))

    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(F.aggregate(chars, start, step, lambda a: -(a["sum"] + part(a["k"]))))


COLUMN_CHECKS: dict[str, Callable[[Column], Column]] = {
    "luhn": luhn_col, "iban": iban_col, "ssn": ssn_col, "mac": mac_col, "npi": npi_col, "dea": dea_col, "nif": nif_col, "nie": nie_col, "fiscal": fiscal_col, "vat": vat_col, "pesel": pesel_col,
    "hetu": hetu_col, "personnummer": personnummer_col, "steuer": steuer_col, "abn": abn_col, "acn": acn_col, "au_medicare": au_medicare_col, "aadhaar": aadhaar_col, "nin": nin_col, "rrn": rrn_col,
    "tnin": tnin_col, "sentinel_year": sentinel_year_col, "aba": _weighted_col("aba", 10), "nhs": _weighted_col("nhs", 11), "tfn": _weighted_col("tfn", 11),
}


def register_check(name: str, plain: Callable[[str], bool], column: Callable[[Column], Column]) -> None:
    """A validator of one's own for custom rules, in both forms."""
    CHECKS[name], COLUMN_CHECKS[name] = _total(plain), column
