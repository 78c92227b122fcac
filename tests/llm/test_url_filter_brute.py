"""URL verdicts against a plain version, and the classifier on hosts that it did not learn from."""

from reelbase.llm import url_filter as U

URLS = [None, "", "nothing", "http://A.Net/x?y", "https://a.example.net/en/1#z", "http://example.com/de/9", "ftp://b.org/fr/", "http://notnet/", "http://a.net", "x://y://z.net/", "http://Ex.ORG?fr/", "http://é.org/fr/é#", "http://" + "a" * 90_000 + ".net/" + "b" * 90_000, "http://royalcasino.com/en/5", "http://library.com/en/5"]


def brute(url, model):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        ends = [rest.find(c) for c in "/?#" if c in rest]
        host, tail = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
        path = tail.split("?")[0].split("#")[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    return host, path, None, "block" if U.score(*model, host, path) >= 0.6 else "allow"


def test_verdicts_equal_a_plain_version(spark):
    model = U.fit([(*U.split_url(u), y) for u, y in U.LABELLED])
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(URLS)] + [(0, None, None), (None, URLS[3], "x")], "page_id long, url string, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.url_verdicts(pages).collect()}
    assert got == {(i, *brute(u, model)) for i, u in [*enumerate(URLS), (None, URLS[3])]}
    assert U.url_verdicts(pages.limit(0)).count() == 0
    allowed = {r.page_id: r.verdict for r in U.url_verdicts(pages, rules=[], labelled=[]).collect()}
    assert set(allowed.values()) == {"allow"}


def test_classifier_on_hosts_that_it_did_not_learn():
    got = U.held_out_accuracy()
    assert got["allow"] > 0.93 and got["block"] > 0.65
