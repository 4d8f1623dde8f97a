"""Tokens, markup and other column functions against slow versions."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from lexispark.functions import text as X

SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def slow(token):
    t = token.strip(SPACES)
    if regex.fullmatch(r"\{[^}]+\}", t):
        return t.lower()
    bare = regex.sub(rf"^[\p{{P}}\p{{S}}{SPACES}]+", "", t)
    return regex.sub(rf"[\p{{P}}\p{{S}}{SPACES}]+\Z", "", bare).lower() or t.lower()


def test_tokens_against_slow(spark):
    rnd = random.Random(3)
    signs = "abAB.,{}!()  　가나\n\t😀-𐐷"
    lines = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 25))) for _ in range(1500)]
    lines += ["{laugh}", "{a b}", "a{b}", "{x}.", "{}", "...", "", "  ", "x" * 5000 + "!", "!" * 3000]
    rows = spark.createDataFrame([(t,) for t in lines], "t string")
    for r in rows.select("t", X.tokens(F.col("t")).alias("k"), X.normalized(F.col("t")).alias("n")).collect():
        words = [w for w in regex.split(f"[{SPACES}]+", r["t"]) if w]
        assert [(k["surface"], k["normalized"]) for k in r["k"]] == [(w, slow(w)) for w in words], r["t"]
        assert r["n"] == slow(r["t"]), r["t"]
    assert one(spark, X.tokens(F.lit(None).cast("string"))) == []


def test_markers_and_like(spark):
    assert one(spark, X.is_marker(F.lit(" {cough} "))) and not one(spark, X.is_marker(F.lit("{}")))
    assert one(spark, X.folded_like(F.lit("xQzy"), "q_Y")) and not one(spark, X.folded_like(F.lit("ü"), "Ü")) and one(spark, X.folded_like(F.lit("p\\q"), "p\\Q"))


@pytest.mark.parametrize(
    ("text", "want"),
    [("1 &lt; 2 &AMP; &#51;&#x33;", "1 < 2 & 33"), ("&amp;gt;", "&gt;"), ("&#xD900;&#0;&nope;&", "&#xD900;&#0;&nope;&"), ("&#99999999999999999999;", "&#99999999999999999999;"), ("", ""), (None, None), ("&#x1F600;", "😀")],
)
def test_entities(spark, text, want):
    assert one(spark, X.entities(F.lit(text).cast("string"))) == want


def test_markup(spark):
    assert one(spark, X.strip_markup(F.lit("<b>one</b>two <!-- x > y -->\n three&#33;"))) == "onetwo three!"
    assert one(spark, X.tag_text(F.lit("<P a='1'>x <i>y</i></P><p>z</p>"), "p")) == "x <i>y</i>"


def test_years_and_ids(spark):
    assert [one(spark, X.year_of(F.lit(t))) for t in ("spring 987", " none ", "17201")] == ["987", "none", "1720"]
    assert [one(spark, X.document_of_sentence(F.lit(t))) for t in ("w.x.y.7", "w.x", "", "w")] == ["w.x.y", "w.x", "document", "w"]
    assert one(spark, X.short_hash(F.lit("q"))) == "22ea1c649c"


def test_legacy_letters(spark, tmp_path):
    assert one(spark, X.legacy_hangul(F.lit("a\ue57b\uf537b"))) == "a\u1106\u11a1\u1112\u119eb" and one(spark, X.legacy_hangul(F.lit("\ue001"))) == "\ue001"
    (tmp_path / "letters.txt").write_text("# letter jamo\n" + "".join(f"{0xE100 + k:X} 1100 {0x1161 + k % 20:X}\n" for k in range(40)) + "E285 1102 119E 11AB # known\n")
    table = X.read_legacy_table(spark, f"file://{tmp_path}/letters.txt")
    assert len(table) == 41 and table["\ue285"] == X.LEGACY["\ue285"]
    assert one(spark, X.legacy_hangul(F.lit("x\ue103\ue285\ue0ff y"), table)) == "x\u1100\u1164\u1102\u119e\u11ab\ue0ff y"
