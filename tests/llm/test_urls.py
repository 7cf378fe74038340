"""URL rules: the index against running every rule on every URL."""

import random
import re

import pytest

from logweave.llm import urls

PARTS = ["http://", "https://", "", "://", "www.", "example.com", "Example.COM", "net", "m.", "casino-win.", ".", "/",
         "en/", "es/", "fr/", "/es/x", "?a=/en/", "#top", "com", "spam.org", "ads", "é", "english"]


def slow(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = re.split(r"[?#]", rest[cut:])[0]
    fit = [r for r in rules if re.match(r.pattern, host + path)]
    best = max(fit, key=lambda r: r.rank, default=None)
    return host, path, best


def test_index_finds_what_running_all_rules_finds(spark):
    r = random.Random(5)
    made = ["".join(r.choices(PARTS, k=r.randint(0, 6))) for _ in range(600)] + [None, ""]
    rules = urls.PATH_RULES + urls.PATTERN_RULES + (
        urls.path_rule("block", "org", "/en"), urls.pattern_rule("block", "all-fr", r".*/fr/"))
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(made)],
                               "page_id long, url string, host string, rule string")
    got = {x.id: x for x in urls.filter_urls(df, rules).collect()}
    assert len(got) == len(made)
    for i, u in enumerate(made):
        host, path, best = slow(u, rules)
        assert (got[i].host, got[i].path) == (host, path)
        assert got[i].matched == (best and best.name) and got[i].verdict == (best.verdict if best else "allow")
        assert got[i].rule == (best.name if best and best.rank[0] else None)


def test_longest_rule_and_subdomains():
    index = urls.Index(urls.PATH_RULES, {})
    for where, name in [("www.example.com/en/1", "www.example.com/en/"), ("m.example.com/en/1", "example.com/en/"),
                        ("myexample.com/en/", "com/"), ("example.com", None), ("a.net/es/", "net/es/"),
                        ("a.net/de/", None), ("a.net/es", None)]:
        won = index.judge(where)
        assert (won and won[0]) == name


def test_rules_are_filed_under_their_rarest_token():
    index = urls.Index([urls.path_rule("block", "example.com", "/en/")], {"example": 9, "com": 50, "en": 2})
    assert list(index.filed) == ["en"] and index.candidates("www.example.com/de/") == []


def test_limits_and_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(df).count() == 0
    with pytest.raises(ValueError):
        urls.filter_urls(df, max_rules=2)
