from staylink.llm.url_filter import LABELLED, RULES, judge, split_url, train

from .conftest import frame

URLS = ["http://WWW.Example.com/en/x?y#z", "https://a.b.example.com/en/", "http://example.com/EN/", "http://x.net/es/1", "http://net/fr/", "http://x.org/es/1", "http://notexample.com/en/", "http://sub.www.example.com/en/q", "http://example.com", "http://example.com?q=/en/", "no scheme", "", None, "a://b://c/d", "http://evil.example.com.org/en/", "http://x.net/de/", "http:///en/", "x" * 5000 + "://h.net/fr/" + "p" * 20000]


def brute(url):
    host, path = split_url(url)
    best = None
    for kind, domain, prefix in RULES:
        if (host == domain or host.endswith("." + domain)) and path.startswith(prefix) and (best is None or len(domain + prefix) > len(best[1])):
            best = (kind, domain + prefix)
    return host, path, best


def test_rules_equal_brute_force(spark):
    table = frame(spark, [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[3])], "page_id long, url string", clash=("host", "score"))
    got = judge(table).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, best = brute(URLS[r.page_id] if r.page_id is not None else URLS[3])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == (best[0] if best else "block" if r.score >= 0.5 else "allow")
    assert judge(table.limit(0)).count() == 0


def test_model_fits_and_generalises(spark):
    urls = [u for u, _ in LABELLED]
    got = {r.page_id: r.score for r in judge(spark.createDataFrame(list(enumerate([*urls, "http://spam-casino.example.org/en/5", "http://thther.example.org/en/685"])), "page_id long, url string")).collect()}
    assert all((got[i] >= 0.5) == bool(v) for i, (_, v) in enumerate(LABELLED))
    assert got[len(urls)] > 0.5 > got[len(urls) + 1]
    w, b = train([])
    assert not w.any() and b == 0
