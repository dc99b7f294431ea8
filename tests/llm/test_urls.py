import random
import re
import time
from fnmatch import translate

import pytest

from lorebed.llm import urls
from lorebed.llm.urls import GlobAutomaton, Rule, UrlFilter


def test_automaton_matches_a_plain_version():
    rnd = random.Random(7)
    globs = ["", "*", "?", "a*b", "*ab*", "a?c", "*a", "b*", "**", "ab" * 50 + "*", "*x?z*y*", *("".join(rnd.choice("ab*?") for _ in range(rnd.randint(1, 9))) for _ in range(60))]
    texts = ["", "a", "ab", "abc", "xyzy", "ab" * 60, *("".join(rnd.choice("abxyz") for _ in range(rnd.randint(0, 12))) for _ in range(300))]
    hit = GlobAutomaton([(g, True) for g in globs]).match(texts)
    for i, text in enumerate(texts):
        assert hit[i].tolist() == [bool(re.match(translate(g), text)) for g in globs], text


def test_case_and_escapes():
    a = GlobAutomaton([("Ab*", False), ("Ab*", True), (r"a\*b", True)])
    assert a.match(["aBc", "Abc", "a*b", "axb"]).tolist() == [[True, False, False], [True, True, False], [False, False, True], [False, False, False]]
    assert GlobAutomaton([]).match(["x"]).shape == (1, 0)


def plain_rule(host, path, rules=urls.RULES):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)


def test_rules_match_a_plain_version():
    rnd = random.Random(5)
    hosts = ["org", "example.org", "a.example.org", "xexample.org", "com", "b.com", "example.net", "", "org.com", "example.org:80"]
    paths = ["", "/", "/es/", "/es/1", "/en/1", "/en/12", "/en/2", "/fr/", "/de/x", "/x.org/", "/.org/", "/a/.example.org/es/"]
    pairs = [(rnd.choice(hosts), rnd.choice(paths)) for _ in range(400)]
    rule, verdict = UrlFilter().judge([h for h, _ in pairs], [p for _, p in pairs])
    for (h, p), r, v in zip(pairs, rule, verdict, strict=True):
        want = plain_rule(h, p)
        assert r == (want.text if want else None)
        assert not want or v == want.verdict


def test_few_long_texts_move_by_themselves():
    rnd = random.Random(11)
    globs = ["*ab*ba*", "a*b", "?b*", "*" + "ab" * 40 + "*", "*aaaaaaaa"]
    automaton = GlobAutomaton([(g, True) for g in globs])
    texts = ["".join(rnd.choice("ab") for _ in range(n)) for n in (0, 3, 500, 900, 40, 900, 1, 77, *[5] * 20, 3000)]
    texts += ["ab" * 200 + "a" * 8, "ab" * 39 + "b"]
    alone = [automaton.match([t])[0].tolist() for t in texts]
    assert automaton.match(texts).tolist() == alone == [[bool(re.match(translate(g), t)) for g in globs] for t in texts]
    began = time.process_time()
    assert UrlFilter().judge(["a.net"], ["/" + "y" * 1_000_000 + "/ads/x"])[1] == ["block"]
    assert time.process_time() - began < 10


def test_globs_decide_the_rest():
    rule, verdict = UrlFilter((Rule("allow", "net", "/ok/"),)).judge(["cheap-pills.net", "cheap-pills.net", "a.net"], ["/ok/", "/x", "/x"])
    assert rule == ["net/ok/", None, None] and verdict == ["allow", "block", "allow"]


def test_odd_urls(spark, duck, same):
    odd = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.Org/Es/?q#f", "https://a.example.org?x", "x://h#y", "http://é.com/fr/ß?", "http://h/" + "a" * 20_000, "http://com/fr/", "a://b://c.org/", "http://x\n.org/y"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(odd + odd[:2])], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("", "", None, "allow")
    assert (got[4].host, got[4].path, got[4].rule) == ("example.org", "/Es/", "org/")
    assert (got[5].host, got[5].path, got[5].rule) == ("a.example.org", "", None)
    assert urls.judge(pages.limit(0)).count() == 0
    con = duck.cursor()
    con.execute("CREATE TEMP TABLE pages AS SELECT * FROM (VALUES " + ", ".join("(?, ?)" for _ in odd) + ") p(page_id, url)", [x for p in enumerate(odd) for x in p])
    same(urls.judge(pages.filter(f"page_id < {len(odd)}")), con.sql(urls.judge_sql()))
