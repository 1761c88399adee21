"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Numbers and dates that pass their check are permuted by a keyed Feistel network over exactly the values of
their format, so a card number stays a valid card number of the same grouping, a date a date, and equal values
stay equal in every document. The network runs over two halves of any two sizes, added to in turn:
``l = l + f(r) mod A``, ``r = r + f(l) mod B``; each step can be undone with the key, so it is a permutation of
the A * B values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.arrays import let
from corpusloom.llm.registry import fresh

ROUNDS = 8
FIRST_DAY = "1800-01-01"
#: Days of 400 Gregorian years are 189 * 773.
DAYS = (189, 773)
#: Valid area and group numbers, valid serials.
SSN_SIZES = (898 * 99, 9_999)

# The public table of country calling codes, of one, two or else three digits.
COUNTRY_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

# Fixed formats. Each alternative starts where no longer value can have begun and has bounded repeats.
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}+(?:\.[A-Za-z0-9\-]{1,63}+){1,8}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ISO_DATE = r"(?<![0-9\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-])"
DAY_FIRST = r"(?<![0-9./])[0-9]{2}(?:\.[0-9]{2}\.|/[0-9]{2}/)[0-9]{4}(?![0-9/])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[ .\-][0-9]{4}(?!\-?[0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9])"
ANY = "|".join((EMAIL, IBAN, ISO_DATE, DAY_FIRST, IPV4, SSN, PHONE, CARD))


def _only(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _number(text: Column) -> Column:
    return text.cast("long")


def feistel(left: Column, right: Column, sizes: tuple[Column, Column], key: str, kind: str | Column) -> Column:
    """struct(l, r): the pair permuted under the key; ``left < sizes[0]``, ``right < sizes[1]``."""

    name = kind if isinstance(kind, Column) else F.lit(kind)

    def f(turn: Column, half: Column, size: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(key), name, turn.cast("string"), half.cast("string"), size.cast("string")))
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)

    def step(acc: Column, turn: Column) -> Column:
        a, b = acc["l"], acc["r"]
        even = F.struct(F.pmod(a + f(turn, b, sizes[0]), sizes[0]).alias("l"), b.alias("r"))
        odd = F.struct(a.alias("l"), F.pmod(b + f(turn, a, sizes[1]), sizes[1]).alias("r"))
        return F.when(turn % 2 == 0, even).otherwise(odd)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_digits(digits: Column, key: str, kind: str | Column) -> Column:
    """A digit string of 2 to 36 characters to one of the same length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    ten = F.lit("1")
    sizes = (F.rpad(ten, half + 1, "0").cast("long"), F.rpad(ten, rest + 1, "0").cast("long"))
    swapped = feistel(_number(F.substring(digits, F.lit(1), half)), _number(F.substring(digits, half + 1, rest)), sizes, key, kind)
    return let(swapped, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), rest, "0")))


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum; digits at places of parity ``doubled`` from the right count twice."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((i % 2) == doubled, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add)


def _put_back(shape: Column, digits: Column) -> Column:
    """Digits in the places where ``shape`` has digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        out = F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["at"], F.lit(1))).otherwise(c))
        return F.struct(out.alias("out"), (acc["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"))

    return F.aggregate(F.split(shape, ""), start, step)["out"]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _card(text: Column, key: str) -> Column:
    def valid(d: Column) -> Column:
        payload = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        whole = let(payload, lambda p: F.concat(p, F.pmod(-_luhn(p, 1), F.lit(10)).cast("string")))
        return F.when(_luhn(d, 0) % 10 == 0, _put_back(text, whole)).otherwise(text)

    return let(_digits(text), valid)


def _mod97(text: Column) -> Column:
    """Letters count as 10 to 35; the remainder of the whole number."""

    def add(acc: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban(text: Column, key: str) -> Column:
    def valid(flat: Column) -> Column:
        body, land = F.substring(flat, F.lit(5), F.length(flat) - 4), F.substring(flat, 1, 2)
        digits = _digits(body)
        enough = F.length(digits).between(2, 36)
        moved = let(permuted_digits(digits, key, "iban"), lambda d: _put_back(body, d))
        whole = let(moved, lambda b: F.concat(land, F.lpad((98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))
        grouped = let(whole, lambda w: _regroup(text, w))
        return F.when((_mod97(F.concat(body, F.substring(flat, 1, 4))) == 1) & enough, grouped).otherwise(text)

    return let(F.replace(text, F.lit(" "), F.lit("")), valid)


def _regroup(shape: Column, flat: Column) -> Column:
    """The characters of ``flat`` with the spaces of ``shape``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        space = c == " "
        out = F.concat(acc["out"], F.when(space, c).otherwise(F.substring(flat, acc["at"], F.lit(1))))
        return F.struct(out.alias("out"), (acc["at"] + F.when(space, 0).otherwise(1)).alias("at"))

    return F.aggregate(F.split(shape, ""), start, step)["out"]


def _moved_date(iso: Column, key: str) -> Column:
    """A yyyy-MM-dd string to that of another day of the 400 years, null if it is no such day."""
    first = F.lit(FIRST_DAY).cast("date")
    a, b = DAYS

    def moved(day: Column) -> Column:
        p = feistel(F.floor(day / b), F.pmod(day, F.lit(b)), (F.lit(a).cast("long"), F.lit(b).cast("long")), key, "date")
        to = let(p, lambda x: F.date_format(F.date_add(first, (x["l"] * b + x["r"]).cast("int")), "yyyy-MM-dd"))
        return F.when(day.between(0, a * b - 1), to)

    return let(F.datediff(iso.try_cast("date"), first), moved)


def _iso_date(text: Column, key: str) -> Column:
    return F.coalesce(_moved_date(text, key), text)


def _day_first(text: Column, key: str) -> Column:
    """dd.MM.yyyy or dd/MM/yyyy; with a slash also MM/dd/yyyy where only that is a day."""
    a, b, year, mark = F.substring(text, 1, 2), F.substring(text, 4, 2), F.substring(text, 7, 4), F.substring(text, 3, 1)

    def written(iso: Column, day_first: bool) -> Column:
        day, month, y = F.substring(iso, 9, 2), F.substring(iso, 6, 2), F.substring(iso, 1, 4)
        return F.concat(*((day, mark, month, mark, y) if day_first else (month, mark, day, mark, y)))

    first = let(_moved_date(F.concat_ws("-", year, b, a), key), lambda d: written(d, True))
    second = let(_moved_date(F.concat_ws("-", year, a, b), key), lambda d: written(d, False))
    return F.coalesce(first, F.when(mark == "/", second), text)


def _ipv4(text: Column, key: str) -> Column:
    def moved(o: Column) -> Column:
        size = F.lit(65_536).cast("long")
        p = feistel(F.get(o, 0) * 256 + F.get(o, 1), F.get(o, 2) * 256 + F.get(o, 3), (size, size), key, "ipv4")
        parts = lambda x: [(x["l"] / 256).cast("long"), x["l"] % 256, (x["r"] / 256).cast("long"), x["r"] % 256]
        return F.when(F.array_max(o) < 256, let(p, lambda x: F.concat_ws(".", *(v.cast("string") for v in parts(x))))).otherwise(text)

    return let(F.transform(F.split(text, r"\."), lambda x: x.cast("int")), moved)


def _ssn(text: Column, key: str) -> Column:
    """Permuted over exactly the valid numbers: 898 areas (not 000, 666, 900 and above) by 99 groups, and 9999 serials."""
    area, group, serial = (F.substring(text, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    sizes = tuple(F.lit(n).cast("long") for n in SSN_SIZES)

    def written(p: Column) -> Column:
        nth = F.floor(p["l"] / 99).cast("long")
        parts = (nth + F.when(nth >= 665, 2).otherwise(1), p["l"] % 99 + 1, p["r"] + 1)
        return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in zip(parts, (3, 2, 4))))

    return F.when(valid, let(feistel(place, serial - 1, sizes, key, "ssn"), written)).otherwise(text)


def _phone(text: Column, key: str) -> Column:
    """The country code stays, all other digits move, alike for every way to write the number.

    A number without a code is North American, as its grouping is.
    """

    def moved(digits: Column) -> Column:
        code = F.when(text.startswith("+"), F.regexp_extract(digits, COUNTRY_CODE, 0)).otherwise(F.lit(""))
        return let(code, lambda c: let(F.substring(digits, F.length(c) + 1, F.length(digits)), lambda rest: _put_back(
            text, F.concat(c, permuted_digits(rest, key, F.concat(F.lit("phone+"), F.when(c == "", "1").otherwise(c))))
        )))

    return let(_digits(text), moved)


def _email(text: Column, key: str) -> Column:
    """No number: a keyed name in a domain that doesn't exist."""
    return F.concat(F.lit("u"), F.substring(F.md5(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(text))), 1, 16), F.lit("@example.invalid"))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one matched value; values that fail their check stay."""
    kinds = ((EMAIL, _email), (ISO_DATE, _iso_date), (DAY_FIRST, _day_first), (IPV4, _ipv4), (SSN, _ssn), (CARD, _card), (IBAN, _iban), (PHONE, _phone))
    out = F
    for pattern, change in kinds:
        out = out.when(value.rlike(_only(pattern)), change(value, key))
    return out.otherwise(value)


def kind_of(value: Column) -> Column:
    kinds = (("email", EMAIL), ("date", ISO_DATE), ("date", DAY_FIRST), ("ipv4", IPV4), ("ssn", SSN), ("card", CARD), ("iban", IBAN), ("phone", PHONE))
    out = F
    for name, pattern in kinds:
        out = out.when(value.rlike(_only(pattern)), F.lit(name))
    return out


def pseudonymised(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with all their columns, their text changed, and ``replaced``: array<struct<kind, pseudonym>>.

    Null text stays null with nothing replaced, empty text stays empty; equal rows give equal rows. Values that
    fail their check (Luhn, mod 97, octets, days that don't exist, invalid areas) stay as they are. Texts of any length are read whole.
    IPv6 addresses, dates in other orders and lower-case IBANs are no formats of this operator and stay.
    """
    found, new, replaced = fresh(documents, "found", "new", "replaced")
    out = documents.withColumn(found, F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))
    out = out.withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda v: pseudonym(v, key))))
    pieces = F.split(F.col(text), ANY)
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.col(new), lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")
    changed = F.filter(F.zip_with(F.col(found), F.col(new), lambda old, to: F.struct(old.alias("old"), to.alias("to"))), lambda x: x["old"] != x["to"])
    listed = F.transform(changed, lambda x: F.struct(kind_of(x["old"]).alias("kind"), x["to"].alias("pseudonym")))
    empty = F.array().cast("array<struct<kind:string,pseudonym:string>>")
    out = out.withColumn(replaced, F.when(F.size(found) > 0, listed).otherwise(empty))
    out = out.withColumn(text, F.when(F.size(found) > 0, joined).otherwise(F.col(text)))
    return out.select(*documents.columns, replaced)
