from docsift.llm import url_filter

RULES = "host string, path string, verdict string"


def judged(spark, pages, rules):
    df = spark.createDataFrame(pages, "page_id long, url string, host string, verdict string")
    return {(r["page_id"], r["host"], r["path"]): (r["rule"], r["verdict"])
            for r in url_filter.judge_urls(df, spark.createDataFrame(rules, RULES)).collect()}


def fits(url, rules):
    """A plain reading of the rules."""
    if url is None or "://" not in url:
        return None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = max(((len(h + p), h + p, v) for h, p, v in rules
                if h and (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return (best[1], best[2]) if best else (None, "allow")


def test_against_a_plain_reading(spark):
    hosts = ["net", "a.net", "example.net", "WWW.Example.NET", "xnet", "example.com", "a.b.org", "", "net:80", "u@net", "é.net"]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/de/y/z", "/fr/?q#f", "?x=/de/", "#/fr/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "nourl", "a://b://net/", "https:/net/"]
    pages = [(i, u, "clash", "clash") for i, u in enumerate(urls)]
    rules = url_filter.RULES + [("a.b.org", "/de", "block"), ("", "/en/", "block"), ("example.com", "", "allow")]
    got = judged(spark, pages, rules)
    assert len(got) == len(urls)
    for (i, _, _), r in got.items():
        assert r == fits(urls[i], rules), urls[i]


def test_repeats_empty_tables_and_nulls(spark):
    pages = [(1, "http://a.net/", "", "")] * 3 + [(None, "http://a.net/", "", ""), (None, None, "", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(url_filter.RULES + [(None, "/", "block"), ("net", "/", "allow")], RULES)
    out = url_filter.judge_urls(df, rules).collect()
    assert sorted((str(r["page_id"]), r["verdict"]) for r in out) == [("1", "block")] * 3 + [("None", "allow"), ("None", "block")]
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(df, rules.limit(0)).collect()} == {"allow"}


def test_filter_has_no_false_negatives(spark):
    rules = spark.range(500).selectExpr("concat('h', id, '.net') AS host", "'/' AS path")
    built = url_filter.build_filter(rules, 4)  # far too small: all that can go wrong is a false positive
    b, m = url_filter._block(rules["host"], rules["path"], 4), url_filter._mask(rules["host"], rules["path"])
    kept = rules.withColumn("block", b).withColumn("mask", m).join(built, "block").filter("(word & mask) = mask")
    assert kept.count() == 500
