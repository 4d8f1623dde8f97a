import re
from collections import Counter

import pytest
from cases import no_documents, odd_documents

from lexispark.llm import quality_rules, queries, url_filter

SF = "/root/testdata/sf0.001"


def slow_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


@pytest.mark.parametrize("extra", [False, True])
def test_measures_odd(spark, extra):
    got = quality_rules.ledger(odd_documents(spark, extra)).collect()
    assert len(got) == 11
    for r in got:
        assert {k: r[k] for k in ("n_words",)} == {"n_words": slow_measures(r["text"])["n_words"]}
        for k, v in slow_measures(r["text"]).items():
            assert r[k] == v, (k, r["doc_id"])
    assert quality_rules.ledger(no_documents(spark)).count() == 0


def test_measures_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op6_quality_rules(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = slow_measures(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        assert r["base_failed"] == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_ablations(spark):
    entries = quality_rules.ledger(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    bits = [r["fail_bits"] for r in entries.collect()]
    for r in quality_rules.ablations(entries, quality_rules.DEFAULT).collect():
        bit = quality_rules.BIT[r["rule"]]
        assert r["failed"] == sum(bool(b & bit) for b in bits)
        assert r["failed_only"] == sum(b == bit for b in bits)
        assert r["rejected_without"] == sum(bool(b & ~bit) for b in bits)
    assert {r["failed"] for r in quality_rules.ablations(entries.limit(0), quality_rules.BASE).collect()} == {0}


def slow_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7", "x://com/en/", "x://a.com/en", "x://acom/en/1", "x://a.example.com/en/71?x#y", "x://b.example.net/de/81", "x://example.net/de/1"]
    urls += ["x://org?/es/", "x://a.org/es/\u00e9#", "x://y/z://a.com/en/", "x://." + "a." * 3000 + "com/en/" + "q" * 9000, "x://com./en/", "http://u@com:80/en/1", "x://com/en/"]
    pages = spark.createDataFrame([(k, u, "mine", "u") for k, u in enumerate(urls)] * 2, "page_id long, url string, best string, verdict string")
    got = url_filter.judge(pages, url_filter.rule_table(spark, queries.URL_RULES)).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == slow_verdict(r["url"]), r["url"]
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark, queries.URL_RULES)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, url_filter.rule_table(spark, [])).collect()} == {"allow"}


def test_url_query(spark):
    want = {r["page_id"]: slow_verdict(r["url"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in queries.op10_url_filter(spark, SF).collect()}
    assert got == want
