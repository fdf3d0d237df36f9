import random

from mergeloom.llm import url_filters


def brute(url, rules):
    url = url or ""
    if "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = max(((len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_rules(spark):
    r = random.Random(2)
    hosts = ["com", "example.com", "www.example.com", "a.b.example.com", "xexample.com", "example.net", "net", "example.com:80", "EXAMPLE.COM", "com.", "co", ""]
    paths = ["", "/", "/en/", "/en", "/en/x", "/es/1?a#b", "?q=/en/", "#/en/", "/fr/", "/en//x#y?z"]
    urls = [f"{s}://{h}{p}" for s in ("http", "") for h in hosts for p in paths] + [None, "", "example.com/en/", "mailto:x", "http:/x", "a://b://example.com/en/"]
    r.shuffle(urls)
    urls += urls[:5]
    rules = [*url_filters.RULES, ("example.com", "/en/x", "block"), ("b.example.com", "/", "block"), ("b.example.com", "/", "allow"), ("com", "", "allow")]
    df = spark.createDataFrame([(i, u, "host", "rule") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    extra = spark.createDataFrame([*rules, ("", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    for given, known in ((extra, rules), (url_filters.rule_table(spark, url_filters.RULES), url_filters.RULES), (extra.limit(0), [])):
        got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filters.url_filter(df, given, parts=3).collect()}
        assert got == {i: brute(u, known) for i, u in enumerate(urls)}


def test_hot_host_and_nothing(spark):
    df = spark.createDataFrame([(i, f"https://www.example.com/en/{i}") for i in range(2000)], "page_id long, url string")
    rules = url_filters.rule_table(spark, url_filters.RULES)
    assert {x.verdict for x in url_filters.url_filter(df, rules).collect()} == {"allow"}
    assert url_filters.url_filter(df.limit(0), rules).count() == 0
    assert url_filters.url_filter(spark.createDataFrame([(None, None), (None, None)], "page_id long, url string"), rules).count() == 2


def test_query(spark, sf, oracle):
    got = sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.op8_url_filters(spark, sf).collect())))
    assert got == sorted(map(str, oracle.sql(f"SELECT page_id, host, path, rule, verdict FROM ({url_filters.SQL['op8_url_filters']})").fetchall()))


def test_many_rules_on_a_host_and_long_urls(spark):
    r = random.Random(3)
    rules = [("example.com", f"/{'x' * (i % 7)}{i}/", r.choice(["allow", "block"])) for i in range(400)] + [("com", "/" + "y" * 5_000, "block")]
    urls = [f"http://{r.choice(['', 'a.', 'b.c.'])}example.com/{'x' * (i % 7)}{i % 450}/{i}" for i in range(900)] + ["http://q.com/" + "y" * 100_000, "http://q.com/" + "y" * 4_999]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filters.url_filter(df, url_filters.rule_table(spark, rules), parts=3).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
