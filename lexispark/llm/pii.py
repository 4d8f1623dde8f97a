"""Pseudonyms for personal data by keyed, format-preserving Feistel permutations.

Values are looked for at every place of a text, validated (Luhn, mod 97, octet ranges, calendar, number ranges), and replaced by a
value of the same format; the first valid one wins where two overlap, and one that fails hides nothing inside it. A value moves
under a keyed permutation of its format, which depends on the key and the format only, so equal values have equal pseudonyms in all
documents, and different values have different ones. Only column expressions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import free_prefix

ROUNDS = 8

#: Groups of a card's digits; one separator is used throughout. Where a longer layout starts with a shorter one it comes first.
CARD_GROUPS = [(4, 4, 4, 4, 3), (4, 4, 4, 4, 2), (4, 4, 4, 4, 1), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 5), (4, 3, 3, 3), (6, 13)]
CARD = "|".join([r"\d{13,19}", *(sep.join(rf"\d{{{n}}}" for n in groups) + r"(?!\d)" for groups in CARD_GROUPS for sep in (" ", "-", r"\."))])
#: Kind -> pattern. An earlier kind wins where two could start.
PATTERNS: dict[str, str] = {
    "email": r"(?<![\p{L}\p{N}_.+%-])[\p{L}\p{N}][\p{L}\p{N}_.+%-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![\w@-])",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_])(?i:password|passwd|secret|token|api_key|apikey)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?:[0-9a-f]{12,128}|[0-9A-F]{12,128})(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "iso_date": r"(?<![\w/.-])\d{4}(?:-\d{2}-|/\d{2}/)\d{2}(?:(?=T\d{2}(?!\d{3}))|(?![\w/-]|\.\d))",
    "dmy_date": r"(?<![\w/.-])\d{2}(?:\.\d{2}\.|/\d{2}/|-\d{2}-)\d{4}(?![\w/-]|\.\d)",
    "short_date": r"(?<![\w/.-])(?:\d/\d{1,2}|\d{2}/\d|\d\.\d{1,2}|\d{2}\.\d)[/.]\d{4}(?![\w/-]|\.\d)",
    "card": rf"(?<![\w.-])(?:{CARD})(?![\w-]|\.\d)",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]|\.\d)",
    "phone": r"(?<![\w(+])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])",
    "intl_phone": r"(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\d{1,4}){2,5}(?![\w-])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: An empty match wherever a value could start, also inside another one; group 1 is the value.
START = f"(?=({ANY}))"
#: A 400-year cycle of the calendar has 146097 = 189 * 773 days.
FIRST_DAY, DATE_HALVES = "1800-01-01", (189, 773)
#: Without the first twelve days of its 4800 months it has 88497 = 9 * 9833.
MONTH_FIRST_HALVES = (9, 9833)


def _number(hex_digits: Column) -> Column:
    """The first 48 bits of a hexadecimal digest."""
    return F.conv(F.substring(hex_digits, 1, 12), 16, 10).cast("long")


def _feistel_number(x: Column, high: int, low: int, key: str, kind: str) -> Column:
    """Keyed permutation of 0 .. high * low - 1: in turn each half is shifted by a digest of the other one."""
    state = F.struct(F.floor(x / F.lit(low)).cast("long").alias("a"), F.pmod(x, F.lit(low)).cast("long").alias("b"))

    def step(s: Column, r: Column) -> Column:
        def shift(half: Column) -> Column:
            return _number(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r, half), 256))

        even = r % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + shift(s["b"]), F.lit(high))).otherwise(s["a"]).cast("long").alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + shift(s["a"]), F.lit(low))).cast("long").alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step, lambda s: s["a"] * F.lit(low) + s["b"])


#: Alphabet of each layout sign; other signs keep their place.
ALPHABETS = {"d": "0123456789", "N": "23456789", "B": "01", "H": "0123456789ABCDEF", "h": "0123456789abcdef", "X": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
# letters of Latin-1, Greek and Cyrillic by case
ALPHABETS |= {sign: "".join(map(chr, range(a, b + 1))) for sign, a, b in (("l", 0xF8, 0xFF), ("e", 0xDF, 0xF6), ("E", 0xC0, 0xD6), ("L", 0xD8, 0xDE), ("g", 0x3B1, 0x3C9), ("c", 0x430, 0x44F), ("C", 0x410, 0x42F))}


def _feistel_text(value: Column, layout: Column, key: str, kind: str) -> Column:
    """Keyed permutation of the texts of one layout: in turn each half's signs are shifted, within their alphabets, by digests of the other half."""
    alphabet = F.create_map(*(F.lit(x) for kv in ALPHABETS.items() for x in kv))
    signs = F.transform(
        F.sequence(F.lit(1), F.length(value)),
        lambda i: F.struct(F.try_element_at(alphabet, F.substr(layout, i, F.lit(1))).alias("abc"), F.substr(value, i, F.lit(1)).alias("c")),
    )
    half = F.floor(F.length(value) / 2)

    def step(state: Column, r: Column) -> Column:
        # a half is cut out in a lambda of its own, so that it is made once a round
        moving, still = F.when(r % 2 == 0, F.lit(0)).otherwise(F.lit(1)), F.when(r % 2 == 0, F.lit(1)).otherwise(F.lit(0))
        parts = F.transform(F.array(F.array_join(F.transform(F.filter(state, lambda x, i: F.when(i < half, 0).otherwise(1) == still), lambda x: x["c"]), "")), lambda other: F.transform(
            state,
            lambda x, i: F.when(
                x["abc"].isNull() | (F.when(i < half, 0).otherwise(1) != moving), x
            ).otherwise(
                F.struct(
                    x["abc"].alias("abc"),
                    F.substr(x["abc"], (F.pmod(F.instr(x["abc"], x["c"]) - 1 + _number(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), layout, r, i, other), 256)), F.length(x["abc"])) + 1).cast("int"), F.lit(1)).alias("c"),
                )
            ),
        ))
        return F.get(parts, F.lit(0))

    return F.array_join(F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), signs, step), lambda x: x["c"]), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a text of digits, the last one taken once, the one before twice, and so on."""
    n = F.length(digits)
    terms = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when((n - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(
            (2 * F.substr(digits, i, F.lit(1)).cast("int")) - F.when(F.substr(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x)


def _relaid(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(shape)),
            lambda i: F.when(F.substr(shape, i, F.lit(1)).rlike("[0-9]"), F.substr(digits, F.length(F.regexp_replace(F.substr(shape, F.lit(1), i), "[^0-9]", "")), F.lit(1))).otherwise(F.substr(shape, i, F.lit(1))),
        ),
        "",
    )


def _card(v: Column, key: str) -> Column:
    """First digit and separators stay, the check digit is made anew; without a valid check digit the value stays."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    n = F.length(digits)
    body = F.substr(digits, F.lit(1), n - 1)
    moved = _feistel_text(body, F.concat(F.lit("."), F.repeat(F.lit("d"), n - 2)), key, "card")
    made = F.get(F.transform(F.array(moved), lambda m: F.concat(m, F.pmod(10 - _luhn(F.concat(m, F.lit("0"))), F.lit(10)).cast("string"))), F.lit(0))
    return F.when(_luhn(digits) % 10 == 0, _relaid(v, made)).otherwise(v)


def _ip(v: Column, key: str) -> Column:
    octets = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    moved = F.get(
        F.transform(F.array(_feistel_number(number, 1 << 16, 1 << 16, key, "ip")), lambda m: F.array_join(F.transform(F.array(*(F.lit(1 << s).cast("long") for s in (24, 16, 8, 0))), lambda p: F.pmod(F.floor(m / p), F.lit(256)).cast("string")), ".")), F.lit(0)
    )
    return F.when(F.forall(octets, lambda x: x < 256), moved).otherwise(v)


def _date(v: Column, pattern: str, key: str) -> Column:
    """Days from 1800 to 2199; a text that is no such day stays."""
    day = F.datediff(F.try_to_date(v, pattern), F.lit(FIRST_DAY).cast("date"))
    high, low = DATE_HALVES
    moved = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), _feistel_number(day, high, low, key, "date").cast("int")), pattern)
    return F.when((day >= 0) & (day < high * low), moved).otherwise(v)


def _month_first(v: Column, key: str, pattern: str = "MM/dd/yyyy") -> Column:
    """Dates that can only be read month first, so days 13 to 31; they are permuted among themselves, apart from day-first dates.

    They are numbered from 1800 to 2199: the days before one, less the first twelve of its month and of each month before.
    """
    first, (high, low) = F.lit(FIRST_DAY).cast("date"), MONTH_FIRST_HALVES
    date = F.try_to_date(v, pattern)
    month = (F.year(date) - F.year(first)) * 12 + F.month(date) - 1
    moved = _feistel_number((F.datediff(date, first) - 12 * (month + 1)).cast("long"), high, low, key, "month first")

    def made(n: Column) -> Column:
        # the month is within two of where months of equal length would put it
        about = F.floor(n * 4800 / (high * low)).cast("int")
        months = F.filter(F.sequence(about - 2, about + 2), lambda m: F.datediff(F.add_months(first, m), first) - 12 * m <= n)
        return F.date_format(F.date_add(first, (n + 12 * (F.array_max(months) + 1)).cast("int")), pattern)

    return F.when((F.dayofmonth(date) > 12) & F.year(date).between(1800, 2199), F.get(F.transform(F.array(moved), made), F.lit(0))).otherwise(v)


def _dmy(v: Column, key: str) -> Column:
    def either(sep: str) -> Column:
        day_first = f"dd{sep}MM{sep}yyyy"
        return F.when(F.try_to_date(v, day_first).isNotNull(), _date(v, day_first, key)).otherwise(_month_first(v, key, f"MM{sep}dd{sep}yyyy"))

    return F.when(v.contains("."), _date(v, "dd.MM.yyyy", key)).when(v.contains("-"), either("-")).otherwise(either("/"))


#: Of dates with a part of one digit: the other part from and to, the one-digit parts that go with it, and what makes their number times 400 years.
SHORT_PARTS = [(1, 9, "123456789", (180, 180)), (10, 28, "123456789", (171, 400)), (29, 30, "13456789", (80, 80)), (31, 31, "13578", (40, 50))]


def _short_date(v: Column, key: str) -> Column:
    """Dates of 1800 to 2199 with a part of one digit, the other from 1 to 31, are moved within their layout: one digit and one, 10 to 28, 29 and
    30, or 31. A day of 29 or more is only moved to months that have it; other texts stay."""
    sep = F.when(v.contains("/"), "/").otherwise(".")
    parts = F.split(v, "[/.]")
    first, second, year = (F.get(parts, F.lit(i)) for i in range(3))
    ahead = F.length(first) == 1  # the one-digit part stands first
    one, other = F.when(ahead, first).otherwise(second), F.when(ahead, second).otherwise(first).cast("long")
    same_sign = F.regexp_replace(v, "[0-9]", "").isin("//", "..")
    out = None
    for low, high, digits, halves in SHORT_PARTS:
        n, m = len(digits), high - low + 1
        at = F.instr(F.lit(digits), one) - 1
        number = ((year.cast("long") - 1800) * m + other - low) * n + at

        def made(x: Column) -> Column:
            d, o = F.substr(F.lit(digits), (x % n + 1).cast("int"), F.lit(1)), (F.floor(x / n) % m + low).cast("string")
            return F.concat(F.when(ahead, d).otherwise(o), sep, F.when(ahead, o).otherwise(d), sep, F.lpad((F.floor(x / (n * m)) + 1800).cast("string"), 4, "0"))

        moved = F.get(F.transform(F.array(_feistel_number(number, *halves, key, f"short {low}")), made), F.lit(0))
        fits = same_sign & other.between(low, high) & (F.length(other.cast("string")) == F.when(ahead, F.length(second)).otherwise(F.length(first))) & (at >= 0) & year.cast("long").between(1800, 2199)
        out = F.when(fits, moved) if out is None else out.when(fits, moved)
    return out.otherwise(v)


def _phone(v: Column, key: str) -> Column:
    """Country code and separators stay; the first digits of area and exchange code stay among 2 to 9, or among 0 and 1."""
    core = F.regexp_replace(v, r"^\+1[ .-]?", "")
    layout = core
    for start in (r"(?<=\A\(?)", r"(?<=[) .-])"):  # the area code starts the number, the exchange code has a separator on both sides
        end = r"(?=\d\d[) .-])"
        layout = F.regexp_replace(F.regexp_replace(layout, f"{start}[2-9]{end}", "N"), f"{start}[01]{end}", "B")
    layout = F.regexp_replace(layout, r"\d", "d")
    return F.concat(F.substr(v, F.lit(1), F.length(v) - F.length(core)), _feistel_text(core, layout, key, "phone"))


#: Social security numbers: area 001 to 899 but for 666, group 01 to 99, serial 0001 to 9999.
SSN_HALVES = (898 * 99, 9999)


def _ssn(v: Column, key: str) -> Column:
    """Moved within all valid numbers; an invalid one stays."""
    area, group, serial = (F.substring(v, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * SSN_HALVES[1] + serial - 1
    moved = _feistel_number(number.cast("long"), *SSN_HALVES, key, "ssn")

    def made(n: Column) -> Column:
        front = F.floor(n / SSN_HALVES[1])
        at = F.floor(front / 99)
        return F.format_string("%03d-%02d-%04d", at + F.when(at >= 665, 2).otherwise(1), front % 99 + 1, n % SSN_HALVES[1] + 1)

    return F.when(valid, F.get(F.transform(F.array(moved), made), F.lit(0))).otherwise(v)


def _mod97(signs: Column) -> Column:
    """The remainder by 97 of digits and letters read as one number, A as 10 to Z as 35."""
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.transform(F.split(signs, ""), value), F.lit(0), lambda a, x: (a * F.when(x < 10, 10).otherwise(100) + x) % 97)


def _iban(v: Column, key: str) -> Column:
    """Country, letters and digits keep their places, the check digits are made anew; without valid check digits the value stays."""
    signs = F.replace(v, F.lit(" "), F.lit(""))
    body = F.substr(signs, F.lit(5), F.length(signs))
    layout = F.regexp_replace(F.regexp_replace(body, "[A-Z]", "A"), "[0-9]", "d")
    moved = _feistel_text(body, layout, key, "iban")
    country = F.substring(signs, 1, 2)

    def made(m: Column) -> Column:
        new = F.concat(country, F.lpad((98 - _mod97(F.concat(m, country, F.lit("00")))).cast("string"), 2, "0"), m)
        places = F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.when(F.substr(v, i, F.lit(1)) == " ", " ").otherwise(F.substr(new, i - F.length(F.regexp_replace(F.substr(v, F.lit(1), i), "[^ ]", "")), F.lit(1))))
        return F.array_join(places, "")

    valid = (_mod97(F.concat(body, F.substring(signs, 1, 4))) == 1) & F.substring(signs, 3, 2).cast("int").between(2, 98)
    return F.when(valid, F.get(F.transform(F.array(moved), made), F.lit(0))).otherwise(v)


def _ipv6(v: Column, key: str) -> Column:
    """Hexadecimal digits keep their places and case; values without a digit, or of both cases, stay."""
    upper, lower = v.rlike("[A-F]"), v.rlike("[a-f]")
    layout = F.when(upper, F.regexp_replace(v, "[0-9A-F]", "H")).otherwise(F.regexp_replace(v, "[0-9a-f]", "h"))
    # equal layouts of both cases are told apart by their sign; digits alone count as lower case
    return F.when(v.rlike("[0-9]") & ~(upper & lower), _feistel_text(v, layout, key, "ipv6")).otherwise(v)


def _intl_phone(v: Column, key: str) -> Column:
    """The first two digits stay; values of fewer than 8 or more than 15 digits stay whole."""
    n = F.length(F.regexp_replace(v, r"\D", ""))
    layout = F.concat(F.lit("..."), F.regexp_replace(F.substr(v, F.lit(4), F.length(v)), r"\d", "d"))
    return F.when(n.between(8, 15), _feistel_text(v, layout, key, "phone")).otherwise(v)


def _email(v: Column, key: str) -> Column:
    """The part before the ``@`` is permuted sign by sign within digits and letters of an alphabet; other signs and the domain stay."""
    local = F.substring_index(v, "@", 1)
    layout = local
    for sign, kind in (("A", "[A-Z]"), ("a", "[a-z]"), ("d", "[0-9]"), *((s, f"[{ALPHABETS[s]}]") for s in "leELgcC")):
        layout = F.regexp_replace(layout, kind, sign)
    return F.concat(_feistel_text(local, layout, key, "email"), F.substr(v, F.length(local) + 1, F.length(v)))


def _access_key(v: Column, key: str) -> Column:
    return _feistel_text(v, F.concat(F.lit("...."), F.repeat(F.lit("X"), 16)), key, "access_key")


def _secret(v: Column, key: str) -> Column:
    value = F.regexp_extract(v, "[0-9a-fA-F]+$", 0)  # no letter stands before it, as a sign does
    kind = F.when(value.rlike("[A-F]"), "H").otherwise("h")
    return F.concat(F.substr(v, F.lit(1), F.length(v) - F.length(value)), _feistel_text(value, F.repeat(kind, F.length(value)), key, "secret"))


HANDLERS: dict[str, Callable[[Column, str], Column]] = {
    "email": _email,
    "access_key": _access_key,
    "secret": _secret,
    "iban": _iban,
    "ipv6": _ipv6,
    "ip": _ip,
    "iso_date": lambda v, key: F.when(v.contains("/"), _date(v, "yyyy/MM/dd", key)).otherwise(_date(v, "yyyy-MM-dd", key)),
    "dmy_date": _dmy,
    "short_date": _short_date,
    "card": _card,
    "ssn": _ssn,
    "phone": _phone,
    "intl_phone": _intl_phone,
}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one value that matches a pattern; what fails its validation stays as it is."""
    out = None
    for kind, handler in HANDLERS.items():
        is_kind = value.rlike(rf"\A(?:{PATTERNS[kind]})\z")
        out = F.when(is_kind, handler(value, key)) if out is None else out.when(is_kind, handler(value, key))
    return out.otherwise(value)


def _is_card(value: Column) -> Column:
    return value.rlike(rf"\A(?:{CARD})\z") & (_luhn(F.regexp_replace(value, "[^0-9]", "")) % 10 == 0)


def _card_alone(found: Column) -> Column:
    """Of a card layout of 17 to 19 digits in groups the first 16, if they are valid: the others are a code or a date beside it."""
    card = F.substr(found, F.lit(1), F.lit(19))
    is_long = found.rlike(r"\A\d{4}(?: \d{4}){3} \d{1,3}\z|\A\d{4}(?:-\d{4}){3}-\d{1,3}\z|\A\d{4}(?:\.\d{4}){3}\.\d{1,3}\z")
    return F.when(is_long & _is_card(card), card).otherwise(found)


#: Items that are folded into one array, which is copied for each.
FOLDED = 128


def _running(items: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """first, step(first, items[0]), and so on: a fold's states. They are gathered in arrays of ``FOLDED``, so time is nearly in proportion."""

    def some(state: Column, chunk: Column) -> Column:
        inner = F.aggregate(F.slice(items, chunk * FOLDED + 1, F.lit(FOLDED)), F.array(state["last"]), lambda s, x: F.concat(s, F.array(step(F.element_at(s, -1), x))))
        joined = lambda s: F.struct(F.element_at(s, -1).alias("last"), F.concat(state["parts"], F.array(F.slice(s, 2, F.size(s)))).alias("parts"))
        return F.get(F.transform(F.array(inner), joined), F.lit(0))

    chunks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FOLDED).cast("int"))
    return F.flatten(F.aggregate(chunks, F.struct(first.alias("last"), F.array(F.array(first)).alias("parts")), some, lambda s: s["parts"]))


def _phones_alone(values: Column, lengths: Column) -> Column:
    """International phone numbers end before a valid card, and at the last group that makes at most 15 digits; else they are empty."""
    is_phone = lambda v: v.rlike(r"\A\+[2-9]")
    starts = _running(lengths, F.lit(0), lambda s, n: s + n)

    def cut(starts: Column) -> Column:
        cards = F.filter(F.transform(values, lambda v, i: F.when(_is_card(v), F.get(starts, i))), lambda c: c.isNotNull())

        def one(v: Column, i: Column) -> Column:
            ahead = F.array_min(F.filter(F.transform(cards, lambda c: c - F.get(starts, i)), lambda d: d > 0))
            whole = F.substr(v, F.lit(1), F.coalesce(ahead, F.length(v)))
            return F.when(is_phone(v), F.regexp_extract(whole, r"\A\+\d(?:[ .-]?\d){7,14}(?=[ .-]|\z)", 0)).otherwise(v)

        return F.transform(values, one)

    return F.when(F.exists(values, is_phone), F.get(F.transform(F.array(starts), cut), F.lit(0))).otherwise(values)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """Replace ``text`` by its pseudonymised form; if ``count`` is given, a column of that name has the number of changed values.

    All rows and all other columns stay, whatever their names, repeated rows too; a column of the name ``count`` is replaced. Null and
    empty texts, and texts without a value, stay as they are. An empty table gives an empty table.
    """
    t, w = F.col(text), free_prefix(docs)
    columns = [c for c in docs.columns if c.lower() != (count or "").lower()]
    padded_, found_, values_, pieces_, lengths_, new_, valid_, taken_ = (w + n for n in ("padded", "found", "values", "pieces", "lengths", "new", "valid", "taken"))
    # a leading space is no part of any value; with it the text before the first start is never dropped
    padded = F.when(t.rlike("[0-9@]"), F.concat(F.lit(" "), t))
    step = docs.select(*(F.col(f"`{c}`") for c in columns), padded.alias(padded_))
    step = step.withColumn(found_, F.regexp_extract_all(padded_, F.lit(START), F.lit(1)))
    some = F.size(found_) > 0
    step = step.withColumn(values_, F.when(some, F.transform(found_, _card_alone))).withColumn(pieces_, F.when(some, F.split(padded_, START, -1)))
    # length of the piece of text that each value starts
    step = step.withColumn(lengths_, F.transform(F.slice(pieces_, 2, F.size(found_)), F.length))
    step = step.withColumn(values_, _phones_alone(F.col(values_), F.col(lengths_)))
    step = step.withColumn(new_, F.when(some, F.transform(values_, lambda v: pseudonym(v, key))))
    valid = F.zip_with(values_, new_, lambda v, new: F.when(v != new, F.length(v)).otherwise(0))
    step = step.withColumn(valid_, valid)
    # signs of each piece that belong to a value which started before it
    taken = _running(F.arrays_zip(F.col(valid_).alias("v"), F.col(lengths_).alias("n")), F.lit(0), lambda s, x: F.greatest(F.lit(0), F.when(s > 0, s).otherwise(x["v"]) - x["n"]))
    step = step.withColumn(taken_, F.when(some, taken))
    rest = lambda x, n: F.substr(x["piece"], n + 1, F.length(x["piece"]))
    parts = F.transform(
        F.arrays_zip(F.slice(pieces_, 2, F.size(found_)).alias("piece"), F.col(new_).alias("new"), F.col(valid_).alias("v"), F.slice(taken_, 1, F.size(found_)).alias("before")),
        lambda x: F.when(x["before"] > 0, rest(x, x["before"])).when(x["v"] > 0, F.concat(x["new"], rest(x, x["v"]))).otherwise(x["piece"]),
    )
    whole = F.concat(F.substr(F.get(pieces_, F.lit(0)), F.lit(2)), F.array_join(parts, ""))
    out = [F.when(some, whole).otherwise(t).alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in columns]
    if count:
        changed = F.size(F.filter(F.arrays_zip(F.col(valid_).alias("v"), F.slice(taken_, 1, F.size(found_)).alias("before")), lambda x: (x["v"] > 0) & (x["before"] == 0)))
        out.append(F.when(some, changed).otherwise(0).cast("long").alias(count))
    return step.select(*out)
