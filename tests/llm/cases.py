"""Rows that every operator must cope with: nulls, empty and long texts, ties, repeats, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the cat sat on the mat while seven quiet birds watched the long grey river run down to the sea again "


def odd_documents(spark, extra: bool = False):
    rows = [
        (0, PROSE * 3, "en", "a", 1),
        (0, PROSE * 3, "en", "a", 1),
        (1, None, None, None, None),
        (2, "", "en", "", 0),
        (3, " \n\t ", None, "a", 4),
        (None, "no id here but some words to read", "en", "b", 3),
        (4, "x", "fr", "b", 1),
        (5, "word " * 3_000, "en", "a", 15_000),
        (6, PROSE.upper(), "de", None, 9),
        (7, "4111 1111 1111 1111 \u00e9\u00e8 \U0001f600 \x00 $1 \\", "fr", "b", 2),
        (8, PROSE * 3, "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("key", "size", "rows", "digest", "bin", "piece", "kept", "n_words", "_words", "_text", "cluster", "score", "set", "host", "path", "rule", "u_id", "best", "w_id", "W_TEXT", "w_words", "N_LINES", "b_key", "k", "r1", "cls"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def equal_rows(spark, n: int = 5000, key: int | None = None):
    """``n`` equal texts beside two others; with ``key``, ``n`` different texts of that id."""
    rows = [(k if key is None else key, PROSE if key is None else f"{PROSE}{k}", "en", "a", 1) for k in range(n)]
    return spark.createDataFrame([*rows, (n + 1, "der hund und die katze liegen unter dem alten baum im garten", "de", "b", 1), (n + 2, PROSE[:40], "en", "b", 1)], SCHEMA)
