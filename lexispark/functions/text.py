"""Column functions on corpus text: tokens, markers, folding, markup."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: White space of the token definition, as a character class that Java and RE2 read alike.
SPACE = r"\t-\r\x20\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: Legacy private-use letters and their jamo. The full table is a file of the user's.
LEGACY = {"\ue57b": "\u1106\u11a1", "\uf537": "\u1112\u119e", "\ue285": "\u1102\u119e\u11ab", "\ue669": "\u1107\u11a1\u11a8"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def legacy_hangul(text: Column, table: dict[str, str] | None = None) -> Column:
    """Replace legacy private-use letters by Unicode jamo; texts without any are not touched."""
    table = LEGACY if table is None else table
    if len(table) > 16:  # one look at each sign instead of one at the text for each letter
        signs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
        out = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(signs, c), c)), "")
    else:
        out = text
        for old, new in table.items():
            out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(text.rlike("[\ue000-\uf8ff]"), out).otherwise(text)


def read_legacy_table(spark: SparkSession, path: str) -> dict[str, str]:
    """A table of legacy letters from a file: in each line the letter's code point and those of its jamo, in hexadecimal, by blanks."""
    rows = (r[0].split("#")[0].split() for r in spark.read.text(path).collect())
    return {chr(int(r[0], 16)): "".join(chr(int(x, 16)) for x in r[1:]) for r in rows if len(r) > 1}


def use_legacy_table(table: dict[str, str]) -> None:
    """Use more legacy letters than the four known ones, in all that follows."""
    LEGACY.update(table)


def trim(text: Column) -> Column:
    """A text without white space at its ends; only one that has some is looked at sign by sign."""
    ends = F.substring(text, 1, 1).isin(*_SPACES) | F.substring(text, -1, 1).isin(*_SPACES)
    return F.when(ends, F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")).otherwise(text)


def is_marker(token: Column) -> Column:
    """A non-speech marker such as ``{laughing}``."""
    return trim(token).rlike(r"^\{[^}]+\}\z")


def looks_marked(value: Column) -> Column:
    return value.startswith("{") & value.endswith("}")


_SIGNS = r"\p{P}\p{S}"
#: Punctuation before and after the core of a token; tokens of mere punctuation have no core.
_EDGES = rf"(?=[{_SIGNS}])(?:(?<![^{SPACE}])[{_SIGNS}]++(?=[^{SPACE}])|(?<=[^{_SIGNS}{SPACE}])[{_SIGNS}]++(?![^{SPACE}]))"
#: The same for texts with a brace, as a marker is taken as it is, or with signs of two surrogates, which looking back would halve.
_IN_TEXT = rf"(?<![^{SPACE}])(?:(\{{[^}}{SPACE}]+\}})|[{_SIGNS}]*+([^{_SIGNS}{SPACE}](?:[^{SPACE}]*[^{_SIGNS}{SPACE}])?)[{_SIGNS}]*)(?![^{SPACE}])"
_ALONE = rf"(?s)\A(?:(\{{[^}}]+\}})|[{_SIGNS}{SPACE}]*+([^{_SIGNS}{SPACE}](?:.*[^{_SIGNS}{SPACE}])?)[{_SIGNS}{SPACE}]*)\z"


def normalized(surface: Column) -> Column:
    """The search form of a token: lower-cased without punctuation at its edges; markers and mere punctuation stay whole."""
    return F.lower(F.regexp_replace(F.btrim(legacy_hangul(surface), F.lit(_SPACES)), _ALONE, "$1$2"))


def _split(text: Column) -> Column:
    # only the first and the last part can be blank
    return F.array_remove(F.split(text, rf"[{SPACE}]+", -1), "")


def surfaces(text: Column) -> Column:
    return _split(F.coalesce(text, F.lit("")))


def terms(text: Column) -> Column:
    """The normalised tokens of a text: the whole text is rewritten by one expression and then cut, so no token is handled alone."""
    t = legacy_hangul(F.coalesce(text, F.lit("")))
    bare = F.when(t.rlike(r"[{\x{10000}-\x{10ffff}]"), F.regexp_replace(t, _IN_TEXT, "$1$2")).otherwise(F.regexp_replace(t, _EDGES, ""))
    return _split(F.lower(bare))


def tokens(text: Column) -> Column:
    """``array<struct<surface, normalized>>`` of a text, in order; no token is blank."""
    return F.arrays_zip(surfaces(text).alias("surface"), terms(text).alias("normalized"))


def folded_like(text: Column, query: str, around: bool = True) -> Column:
    """LIKE that ignores the case of A-Z only; ``%`` and ``_`` of the query are wildcards and nothing is an escape."""
    pattern = query.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return F.translate(text, UPPER, LOWER).like(f"%{pattern}%" if around else pattern)


_ENTITY = "(?i)&(?:#x[0-9a-f]+|#[0-9]+|amp|lt|gt|quot|apos);"


def entities(text: Column) -> Column:
    """Named and numeric entities are decoded once, so ``&amp;lt;`` gives ``&lt;``; numbers that are no code point stay."""

    def sign(e: Column) -> Column:
        low = F.lower(e)
        digits = F.regexp_extract(low, "[0-9a-f]+", 0)
        code = F.when(low.startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        number = F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        named = F.create_map(*(F.lit(x) for kv in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")) for x in kv))
        return F.coalesce(F.when(low.startswith("&#"), number).otherwise(F.try_element_at(named, low)), e)

    found = F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)), sign)
    whole = F.zip_with(F.split(text, _ENTITY, -1), found, lambda piece, e: F.concat(piece, F.coalesce(e, F.lit(""))))
    return F.when(text.rlike(_ENTITY), F.array_join(whole, "")).otherwise(text)


def strip_markup(text: Column) -> Column:
    """Comments and tags go, white space collapses, then entities are decoded."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]+>", "")
    return legacy_hangul(entities(trim(F.regexp_replace(out, rf"[{SPACE}]+", " "))))


def tag_text(markup: Column, tag: str) -> Column:
    """The inner markup of the first element of that name, blank if there is none."""
    return F.regexp_extract(markup, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)


def year_of(text: Column) -> Column:
    found = F.regexp_extract(text, r"\d{3,4}", 0)
    return F.when(found != "", found).otherwise(trim(text))


def document_of_sentence(sentence_id: Column) -> Column:
    """A sentence id without its last dotted part, if it has more than two; ``document`` if it is blank."""
    parts = F.split(sentence_id, r"\.", -1)
    shorter = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), ".")
    return F.when(F.coalesce(sentence_id, F.lit("")) == "", F.lit("document")).when(F.size(parts) > 2, shorter).otherwise(sentence_id)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 10)


_ENDS, _LAUGHS = r".!?\x{3002}\x{ff1f}\x{ff01}", r"\x{314b}\x{314e}\x{315c}\x{3160}"


def terminal(text: Column) -> Column:
    """Whether a sentence ends here: punctuation, then perhaps reaction letters, then perhaps closing signs."""
    return text.rlike(rf"[{_ENDS}](?:[{SPACE}]*[{_LAUGHS}]+)?[\"')\]}}\x{{201d}}\x{{2019}}]*+[{SPACE}]*+\z")


def reaction(text: Column) -> Column:
    """Whether a text is nothing but punctuation and reaction letters."""
    return text.rlike(rf"\A[{SPACE}]*+[{_ENDS}{_LAUGHS}][{_ENDS}{_LAUGHS}{SPACE}]*+\z")


def glued(text: Column) -> Column:
    """Whether a reaction joins the text before it without a space."""
    return text.rlike(rf"\A[{SPACE}]*+[{_ENDS}]++[{_LAUGHS}]*+[{SPACE}]*+\z")
