import pytest

from panelspark.llm.urlfilter import ALLOW_HOSTS, BLOCK_HOSTS, PATHS, filter_urls, grams, matching_rule, split_url, train, RULES


@pytest.mark.parametrize(
    "url,host,path",
    [("http://A.Example.org/en/1?q#x", "a.example.org", "/en/1"), ("x://h", "h", ""), ("https://h?x=/y", "h", ""), ("https://h#/y", "h", ""), ("nothing", "", ""), (None, "", ""), ("", "", ""), ("http://É.com/É", "É.com", "/É"), ("a://b://c/d", "b:", "//c/d")],
)
def test_split(url, host, path):
    assert split_url(url) == (host, path)


@pytest.mark.parametrize(
    "url,want",
    [
        ("http://example.org/es/5", ("block", "example.org/es/")),
        ("http://m.example.org/en/15", ("block", "example.org/en/1")),
        ("http://m.example.org/en/25", ("allow", "org/")),
        ("http://x.com/fr/", ("allow", "com/fr/")),
        ("http://x.com/de/1", ("block", "com/de/")),
        ("http://com/de/1", ("block", "com/de/")),
        ("http://xcom/de/1", None),
        ("http://x.net/es/", None),
        ("http://x.org", None),
        ("http://notexample.org/es/1", ("allow", "org/")),
    ],
)
def test_rules(url, want):
    assert matching_rule(*split_url(url), RULES) == want


def test_held_out_accuracy():
    table = [(f"http://{h}{p}", y) for hosts, y in ((BLOCK_HOSTS, 1), (ALLOW_HOSTS, 0)) for h in hosts for p in PATHS]
    hosts = [split_url(u)[0] for u, _ in table]
    held = {h for h in set(hosts) if sum(map(ord, h)) % 5 == 0}
    weights, bias = train([r for r, h in zip(table, hosts, strict=True) if h not in held])
    wrong = total = 0
    for (u, y), h in zip(table, hosts, strict=True):
        if h in held:
            at = grams(*split_url(u))
            wrong += (weights[at].sum() / len(at) ** 0.5 + bias >= 0) != bool(y)
            total += 1
    assert total > 50 and wrong / total < 0.35


def test_table(spark):
    schema = "page_id long, url string, host string, verdict string"
    rows = [(1, "http://www.cheap-pills.example.net/en/2", "a", "b"), (2, "http://www.theory.example.net/en/2", None, None), (2, None, None, None), (None, "http://x.org/", None, None)]
    got = sorted(((r.page_id or 0, r.host, r.rule, r.verdict) for r in filter_urls(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(0, "x.org", "org/", "allow"), (1, "www.cheap-pills.example.net", None, "block"), (2, "", None, got[2][3]), (2, "www.theory.example.net", None, "allow")]
    assert filter_urls(spark.createDataFrame([], schema)).collect() == []
