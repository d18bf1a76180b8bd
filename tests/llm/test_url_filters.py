"""URL verdicts against a scan of all rules."""

import re

from credence.llm import url_filters as uf


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(h + p, v) for h, p, v in uf.HOST_RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        rule, verdict = max(fits, key=lambda x: len(x[0]))
        return host, path, rule, verdict
    hits = {v for p, v in uf.PATTERNS if host and re.search(p, url.lower())}
    return host, path, None, "allow" if "allow" in hits or not hits else "block"


def check(spark, urls):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(df).collect()} == {i: brute(u) for i, u in enumerate(urls)}


def test_whole_table(spark, sf_dir):
    check(spark, [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()])


def test_odd_urls(spark):
    check(spark, [
        None, "", "x", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/x", "https://example.com/en/", "https://a.b.example.com/en/?q", "https://example.com", "https://notexample.com/en/", "https://x.net/es/#f", "net://net/fr/", "https://net/fr",
        "http://a://b/c", "https://spam-farm.example.org/x", "https://my-spam-farm.org/robots.txt", "http://x.org/a-adult-b", "http://x.org/adultx/", "http://casino-win.org", "http://x.org/wp-login.php", "http://x.org/wp-login.phpx", "http://x.org:80/?utm_source=spam", "http://é.org/" + "a/" * 50_000,
        "http://x.org\n/wp-login.php", "http://.com/", "http://com./",
    ])


def test_rules_in_many_blocks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(uf, "MAX_RULE_BYTES", 30)
    assert len(uf.rule_blocks(uf.HOST_RULES, uf.PATTERNS)) > 5
    check(spark, [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(300).collect()] + ["http://a.www.example.com/en/", "http://x.org/a-adult-b", "https://my-spam-farm.org/robots.txt"])


def test_literal_tokens_are_in_every_match():
    assert uf.literal_tokens(r"/wp-login\.php\b") == {"wp", "login", "php"}
    assert uf.literal_tokens(r"/ab+c/") == set() and uf.literal_tokens(r"abc/") == set() and uf.literal_tokens(r"^abc$") == {"abc"}
    assert uf.literal_tokens(r"[/.-]adult[/.-]") == {"adult"} and uf.literal_tokens(r"[a/]adult/") == set() and uf.literal_tokens(r"/a|b/") == set()


def test_empty_table(spark):
    assert uf.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://a.net/fr/x", "h", "v"), (1, "http://a.net/fr/x", "h", "v"), (None, None, "h", "v"), (2, "no scheme", "h", "v")], "page_id long, url string, host string, verdict string")
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in uf.judge(df).collect()), key=str)
    assert got == sorted([(1, "a.net", "/fr/x", "net/fr/", "block")] * 2 + [(0, "", "", None, "allow"), (2, "", "", None, "allow")], key=str)
