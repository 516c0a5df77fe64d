import re

import pytest
from pyspark.sql import functions as F

from landheat.llm import urls

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
WORDS = ["adult", "ads", "bets", "casino", "pills", "spam"]


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    if best:
        return host, path, *best
    return host, path, None, "block" if set(re.split(r"[.-]", host)) & set(WORDS) else "allow"


ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x", "x://a.org?q", "x://a.org", "x://org/", "x://notexample.org/es/", "x://b.example.org/en/12", "x://b.example.org/EN/12", "x://casino-win.net", "x://a.com:80/fr/", "x://ads.de/a#b", "x://É.com/de/ü?x", "a://b://c.org/", "x://a.com/fr", "x://bets-x.com/fr/y", "x://my.casinos.net/"]


def test_pages_match_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: brute(r.url) for r in pages.collect()}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages).collect()} == want


def test_edges(spark):
    rows = [(i, u) for i, u in enumerate(ODD)] + [(None, "x://a.org/"), (4, ODD[4])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("token", F.lit(1))
    got = urls.judged(pages).collect()
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(str((i, *brute(u))) for i, u in rows)
    assert urls.judged(pages.limit(0)).count() == 0


def test_rules_are_found_by_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"x://h{i}.example.org/en/{i}") for i in range(20)] + [(99, "x://a.example.org/es/1")], "page_id long, url string")
    us = pages.select("url").withColumn("tokens", urls.tokens(F.col("url")))
    index = {r.name: r.token for r in urls.rule_index(us, urls.RULES).collect()}
    assert index["example.org/es/"] == "es" and index["org/"] == "org"
    free = urls.UrlRule("digits", "block", r"^[^/]*[0-9]{3}", ())
    assert urls.rule_index(us, (free,)).first().token == "*"


LINES = ["||example.org^", "@@||good.example.org/en/*", "|b.example.org/|", "/tracker/*/pixel", "banner", "||shop.*/de/", "@@/tracker/1/", "^track^", "-win.", "||É.com^", "! a comment", "", "||EXAMPLE.net/Path|", "*ad*"]


def fits(line, key):
    """Whether a filter-list line fits, by walking the line beside the text."""
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    body, key = low(line.removeprefix("@@")), low(key)
    host = body.startswith("||")
    start = not host and body.startswith("|")
    body = body[2 if host else 1 if start else 0 :]
    end = body.endswith("|")
    body = body.removesuffix("|")

    def walk(i, j):
        if i == len(body):
            return not end or j == len(key)
        if body[i] == "*":
            return any(walk(i + 1, k) for k in range(j, len(key) + 1))
        if body[i] == "^":
            return (j == len(key) and walk(i + 1, j)) or (j < len(key) and not (key[j].isascii() and (key[j].isalnum() or key[j] in "_.%-")) and walk(i + 1, j + 1))
        return j < len(key) and key[j] == body[i] and walk(i + 1, j + 1)

    size = len(key.split("/", 1)[0])
    begins = [0] if start else [0, *(k + 1 for k in range(size) if key[k] == ".")] if host else range(len(key) + 1)
    return any(walk(0, k) for k in begins)


KEYS = ["example.org", "www.example.org/x", "notexample.org/", "good.example.org/en/1", "b.example.org/", "b.example.org/x", "a.com/tracker/7/x/pixel.gif", "a.com/Tracker/1/pixel", "a.com/mybanners/1", "shop.fr/de/1", "a.shop.co.uk/DE/", "x.com/track/", "x.com/tracks", "x.com/a-track", "casino-win.net/", "É.com/", "example.net/path", "example.net/path/2", "bad.com/\nad\n", "a.com/tracker/\n/pixel"]


def test_list_rules_match_a_plain_walk(spark):
    lines = spark.createDataFrame([(x,) for x in [*LINES, LINES[0], None]], "rule string")
    rules = urls.list_rules(lines)
    assert sorted(r.name for r in rules) == sorted(x for x in LINES if x and not x.startswith("!"))
    pages = spark.createDataFrame(list(enumerate("x://" + k for k in KEYS)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judged(pages, rules).collect()}
    for i, key in enumerate(KEYS):
        want = sorted(r.name for r in rules if fits(r.name, key))
        assert (key, got[i].words) == (key, want)
        assert got[i].rule is None and got[i].verdict == ("block" if want and not any(x.startswith("@@") for x in want) else "allow")


def test_base_rules_go_before_list_rules_and_few_patterns_run(spark):
    many = (*urls.RULES, *(urls.list_rule(f"||h{i}.example.net/p{i}^") for i in range(3000)), urls.list_rule("||org^"))
    pages = spark.createDataFrame([(i, f"x://www.h{i}.example.net/p{i}/1") for i in range(200)] + [(900, "x://a.org/1"), (901, None)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.words) for r in urls.judged(pages, many).collect()}
    assert got == {i: (None, "block", [f"||h{i}.example.net/p{i}^"]) for i in range(200)} | {900: ("org/", "allow", ["||org^"]), 901: (None, "allow", [])}
    assert {r.patterns: r.urls for r in urls.patterns_run(pages, many).collect()} == {0: 1, 1: 200, 2: 1}


@pytest.mark.parametrize("line", ["||a.com^$third-party", "a.com##.ad", "@@", "*", "||^"])
def test_lines_that_cannot_be_rules(line):
    with pytest.raises(ValueError):
        urls.list_rule(line)


def test_too_many_rules(spark):
    with pytest.raises(ValueError):
        urls.list_rules(spark.createDataFrame([("a",), ("b",)], "rule string"), most_rules=1)
