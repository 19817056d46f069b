"""The fetch policy over recorded routes, and the data source."""

import json

from factweave.sources import fetch as X

HTML = {"content-type": "text/html; charset=utf-8"}
ROUTES = {
    "https://a.org/": (200, HTML, b"<p>x"), "https://a.org/pdf": (200, {"content-type": "application/pdf"}, b"x"), "https://a.org/empty": (200, HTML, b" \n"), "https://a.org/gone": (404, HTML, b"x"),
    "https://a.org/r": (302, {"location": "/r2"}, b""), "https://a.org/r2": (301, {"location": "https://a.org/"}, b""), "https://a.org/loop": (302, {"location": "/loop"}, b""),
    "https://a.org/in": (302, {"location": "http://inside.org/"}, b""), "https://a.org/bad": (302, {"location": "ftp://a.org/"}, b""),
}
NAMES = {"a.org": ["93.184.216.34"], "inside.org": ["93.184.216.34", "10.0.0.1"]}


def fetch(url):
    return X.safe_fetch(url, lookup=lambda h: NAMES.get(h, []), get=X.recorded(ROUTES))


def test_policy():
    said = {u: fetch(u)["failure"] for u in [*ROUTES, "https://a.org/none", "http://inside.org/", "http://nowhere.org/", "junk", "ftp://a.org/", "http://["]}
    assert said == {
        "https://a.org/": None, "https://a.org/pdf": "non_html", "https://a.org/empty": "empty_body", "https://a.org/gone": "http_error", "https://a.org/r": None, "https://a.org/r2": None,
        "https://a.org/loop": "too_many_redirects", "https://a.org/in": "redirect_target_blocked", "https://a.org/bad": "invalid_url", "https://a.org/none": "unreachable",
        "http://inside.org/": "resolved_ip_blocked", "http://nowhere.org/": "dns_resolution_failed", "junk": "invalid_url", "ftp://a.org/": "invalid_url", "http://[": "invalid_url",
    }
    assert fetch("https://a.org/r")["final_url"] == "https://a.org/" and fetch("https://a.org/r")["hops"] == 2


def test_source(spark):
    spark.dataSource.register(X.PageSource)
    routes = json.dumps({u: [s, h, b.decode()] for u, (s, h, b) in ROUTES.items()})
    df = spark.read.format("pages").option("urls", json.dumps([*ROUTES, "https://a.org/"])).option("routes", routes).option("parts", "3").load()
    got = {r.requested_url: r.failure for r in df.collect()}
    assert len(got) == len(ROUTES) == df.count() and got["https://a.org/"] is None and got["https://a.org/loop"] == "too_many_redirects"


def test_whatever_goes_wrong_is_a_class():
    import http.client
    import time

    def raising(e):
        def get(url, address):
            raise e

        return get

    def said(url="https://a.org/", lookup=lambda h: ["93.184.216.34"], get=None):
        return X.safe_fetch(url, lookup=lookup, get=get or X.recorded(ROUTES))["failure"]

    def refuse(host):
        raise UnicodeError(host)

    assert said(get=raising(http.client.BadStatusLine("x"))) == said(get=raising(http.client.IncompleteRead(b"x"))) == said(get=raising(TimeoutError())) == "unreachable"
    assert said(get=raising(X.TooLarge("x"))) == "body_too_large"
    assert said("https://a.org:99999/") == "invalid_url" and said(lookup=refuse) == "dns_resolution_failed"
    assert said(get=lambda u, a: (302, {"location": "http://["}, b"")) == "invalid_url"
    start, slow = time.monotonic(), X.socket.getaddrinfo
    X.socket.getaddrinfo = lambda *a: time.sleep(1) or []
    try:
        X.resolve("a.org", seconds=0.2)
        raise AssertionError
    except TimeoutError:
        assert time.monotonic() - start < 2
    finally:
        X.socket.getaddrinfo = slow
