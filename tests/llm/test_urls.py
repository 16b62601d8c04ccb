import random

import pytest

from strandmill.llm import url_terms, urls

ROWS = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/7x?q", "http://example.com/en/", "http://a.b.net/de/8#x", "http://x.example.net/de/8", "https://notnet/de/", "http://shop.org/es/?porn", "http://h/xxx", "http://h/cheap-loan", "http://h/cheapest/loans", "http://h/cheap", "http://h/cheap/cheap", "ftp://?q", "http://é.fr/casino_poker", "a://b://c/d"]


def test_rules_and_terms(spark):
    frame = spark.createDataFrame([(k, u, "x") for k, u in enumerate(ROWS)] + [(None, ROWS[4], "y")], "page_id long, url string, host string")
    found = {r["page_id"]: r for r in urls.judge(frame).collect()}
    assert len(found) == len(ROWS) + 1
    assert (found[0]["host"], found[0]["path"], found[0]["rule"], found[0]["verdict"]) == ("", "", None, "allow")
    assert (found[3]["host"], found[3]["path"], found[3]["rule"], found[3]["verdict"]) == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert [found[k]["rule"] for k in (4, 5, 6, 7, 8)] == ["com/en/", "net/de/", "example.net/de/8", None, "org/es/"]
    assert [found[k]["verdict"] for k in (5, 6, 8, 9, 10, 11, 12, 13, 15)] == ["allow", "block", "block", "block", "block", "allow", "allow", "allow", "block"]
    assert (found[14]["host"], found[14]["path"]) == ("", "") and (found[16]["host"], found[16]["path"]) == ("b:", "//c/d")
    assert urls.judge(frame.limit(0)).count() == 0


def brute(url, terms, limit):
    """Distinct terms and their weight, every term at every place."""
    url = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
    letter = set("abcdefghijklmnopqrstuvwxyz0123456789")
    held = {}
    for t, w in terms:
        if any(url.startswith(t, i) and (i == 0 or url[i - 1] not in letter) and (i + len(t) == len(url) or url[i + len(t)] not in letter) for i in range(len(url))):
            held[t] = w
    strict = sum(w >= limit for w in held.values())
    return strict, len(held) - strict, sum(held.values())


def test_automaton_equals_search():
    rng, judge = random.Random(2), urls.UrlJudge()
    words = [t for t, _ in url_terms.VOCABULARY]
    for _ in range(300):
        url = "http://h" + "".join(rng.choice("-_/.x1é") + rng.choice(words) for _ in range(rng.randint(0, 4))) + rng.choice(["", "/", "s", "-x"])
        assert judge.terms(url) == brute(url, url_terms.VOCABULARY, url_terms.LIMIT)


def test_soft_terms_block_together_only(spark):
    """At least two distinct soft terms that weigh the limit; repeats of one don't add up."""
    soft = [(t, w) for t, w in url_terms.VOCABULARY if w < url_terms.LIMIT]
    assert len({t for t, _ in url_terms.VOCABULARY}) == len(url_terms.VOCABULARY) >= 150 and {w for _, w in soft} == {1, 2, 3}
    rows = ["http://casino-win.com/x", "http://casino.com/x", "http://free.com/win/now/buy", "http://free.com/win/now", "http://casino.com/casino/CASINO", "http://ads-track.com/x", "http://h/" + "a-" * 200_000 + "casino/poker"]
    found = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules=()).collect()}
    assert [found[k]["verdict"] for k in range(7)] == ["block", "allow", "block", "allow", "allow", "block", "block"]
    assert all(found[k]["strict_terms"] == 0 for k in range(7)) and found[6]["soft_terms"] == 2


def test_the_vocabulary_may_be_a_table(spark, monkeypatch):
    table = spark.createDataFrame([("Odd", 9), ("bit", 5), ("bit", 1), (None, 3), ("", 3), ("none", None)], "term string, weight int")
    pages = spark.createDataFrame([(1, "http://x/ODD"), (2, "http://x/bit"), (3, "http://x/none"), (4, None)], "page_id long, url string")
    found = {r["page_id"]: (r["verdict"], r["weight"]) for r in urls.judge(pages, terms=table, limit=6).collect()}
    assert found == {1: ("block", 9), 2: ("allow", 5), 3: ("allow", 0), 4: ("allow", 0)}
    assert {r["verdict"] for r in urls.judge(pages, terms=()).collect()} == {"allow"}
    monkeypatch.setattr(urls, "MOST_TERMS", 5)
    with pytest.raises(ValueError, match="at most 5"):
        urls.judge(pages, terms=table)
