"""Rules, aliases and precedence of the URL filter."""

from pyspark.sql import functions as F

from duoclass.llm import urlfilter as U

SCHEMA = "page_id long, url string, html string, host string, rule string"


def link(url):
    return f'<html><head><link rel="canonical" href="{url}"></head></html>'


ROWS = [
    (1, "https://a.example.net/en/x?q=1#f", None, "", ""),      # the longer allow rule
    (2, "https://EXAMPLE.NET/de/", None, "", ""),               # net/ blocks
    (3, "http://example.com/de/1", None, "", ""),               # blocked
    (4, "http://notexample.com/de/1", None, "", ""),            # another host
    (5, "http://b.org/fr/1", link("http://c.com/1"), "", ""),   # allowed, and so its alias
    (6, "http://c.com/1", link("http://d.net/1"), "", ""),      # allowed by 5, not blocked by d.net
    (7, "http://e.com/1", link("http://d2.net/1"), "", ""),     # blocked through an alias that isn't a page
    (8, "HTTP://E.com/1#part", None, "", ""),                   # another spelling of 7
    (9, "http://f.com/1", '<meta content="0; url=http://e.com/1" http-equiv=refresh>', "", ""),
    (10, "http://g.com/1", "<link href='http://f.com/1' rel=stylesheet>", "", ""),  # no alias
    (11, None, link("http://d.net/1"), "", ""),
    (12, "no scheme", link("http://d.net/1"), "", ""),
    (13, "", "", "", ""),
    (14, "x://", None, "", ""),
    (15, "http://net", None, "", ""),                            # host net, empty path: no rule starts it
    (16, "http://net/", None, "", ""),
    (17, "http://h.com?x=/de/", link("http://h.com?x=/de/"), "", ""),
]


def judge(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    return U.judge_urls(df, U.RULES, U.page_edges(df))


def test_rules_and_aliases(spark):
    out = judge(spark, ROWS + [ROWS[6]])
    assert sorted(out.columns) == sorted(["page_id", "url", "html", "host", "path", "rule", "verdict"])
    rows = out.collect()
    assert len(rows) == len(ROWS) + 1
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/de/", "net/", "block")
    assert got[3] == ("example.com", "/de/1", "example.com/de/", "block")
    assert got[4] == ("notexample.com", "/de/1", None, "allow")
    assert got[5] == ("b.org", "/fr/1", "org/fr/", "allow")
    assert got[6][2:] == (None, "allow")
    assert got[7][2:] == got[8][2:] == got[9][2:] == (None, "block")
    assert got[10][3] == "allow"
    assert got[11] == ("", "", None, "allow") and got[12] == ("", "", None, "allow") and got[13] == ("", "", None, "allow")
    assert got[14] == ("", "", None, "allow")
    assert got[15] == ("net", "", None, "allow") and got[16] == ("net", "/", "net/", "block")
    assert got[17] == ("h.com", "", None, "allow")


def test_given_redirects(spark):
    """A redirect table: a chain of aliases carries a block to its far end."""
    n = 40
    df = spark.createDataFrame([(i, f"http://s{i}.com/", None, "", "") for i in range(n)], SCHEMA)
    chain = spark.createDataFrame([(f"http://s{i}.com/", f"http://s{i + 1}.com/") for i in range(n - 1)]
                                  + [("http://s7.com/", "http://bad.net/"), (None, "http://bad.net/")], "src string, dst string")
    assert {r["verdict"] for r in U.judge_urls(df, U.RULES, chain).collect()} == {"block"}
    allow = chain.union(spark.createDataFrame([("http://x.org/fr/", "http://s39.com/")], "src string, dst string"))
    assert {r["verdict"] for r in U.judge_urls(df, U.RULES, allow).collect()} == {"allow"}


def test_empty_table(spark):
    assert judge(spark, []).count() == 0


def test_equal_rules_allow_first(spark):
    df = spark.createDataFrame([(1, "http://a.b/", None, "", "")], SCHEMA)
    rules = [("a.b", "/", "block"), ("a.b", "/", "allow")]
    assert U.judge_urls(df, rules, U.page_edges(df)).first()["verdict"] == "allow"


def test_targets_are_resolved(spark):
    base = "https://H.org/a/b/c.html?q=1#f"
    cases = {"/x/../y?z#k": "https://H.org/y?z#k", "//d.net/1": "https://d.net/1", "d": "https://H.org/a/b/d", "./d/./e/..": "https://H.org/a/b/d/",
             "../../../up": "https://H.org/up", "?p=2": "https://H.org/a/b/c.html?p=2", "http://o.net": "http://o.net", "#top": None, "": None,
             "mailto:x@y": None, "..": "https://H.org/a/", "e?u=../v": "https://H.org/a/b/e?u=../v"}
    df = spark.createDataFrame([(base, t, w) for t, w in cases.items()] + [("http://h.org", "d", "http://h.org/d"), ("no url", "d", None), (None, "d", None),
                                                                           ("no url", "ftp://x.y/", "ftp://x.y/")], "u string, t string, w string")
    for r in df.withColumn("g", U.resolve(F.col("u"), F.col("t"))).collect():
        assert r["g"] == r["w"], r


def test_relative_links_carry_decisions(spark):
    rows = [(1, "http://a.com/p/q", '<meta http-equiv="refresh" content="0; url=//d.net/1">', "", ""),
            (2, "http://c.org/x", link("/fr/y"), "", ""), (3, "http://example.com/de/x", link("../z"), "", ""), (4, "http://example.com/z", None, "", "")]
    got = {r["page_id"]: r["verdict"] for r in judge(spark, rows).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "block"}


def test_clashing_columns(spark):
    """Columns with names that the operator uses inside are kept as they are."""
    df = spark.createDataFrame([(r[0], r[1], r[2], "mine", "own", "x") for r in ROWS], "page_id long, url string, html string, _node string, _alias string, alias_verdict string")
    out = U.judge_urls(df, U.RULES, U.page_edges(df))
    assert out.columns == [*df.columns, "host", "path", "rule", "verdict"]
    want = {r["page_id"]: r["verdict"] for r in judge(spark, ROWS).collect()}
    for r in out.collect():
        assert (r["_node"], r["_alias"], r["alias_verdict"]) == ("mine", "own", "x") and r["verdict"] == want[r["page_id"]]
