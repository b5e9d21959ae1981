from datetime import datetime, timedelta
from urllib.parse import urlsplit

from graphloom.llm.url_filters import filter_urls, validity_intervals


def at(day):
    return datetime(2024, 1, 1) + timedelta(days=day)


CHANGES = [("host", "a.example.com", "block", at(10)), ("host", "a.example.com", "remove", at(50)), ("host", "a.example.com", "allow", at(300)), ("domain", "Example.com", "block", at(20)), ("domain", "com", "allow", at(0)), ("prefix", "b.example.com/x/y", "block", at(0)), ("prefix", "b.example.com/x", "allow", at(5)), ("host", "a.example.com", "block", at(10)), ("host", None, "block", at(1)), ("odd", "a", "block", at(1)), ("prefix", "b.example.com/", "block", at(700)), ("host", "[::1]", "block", at(3)), ("prefix", "[::1]/Login", "allow", at(6)), ("prefix", "[::1]/login", "block", at(7)), ("domain", "0.0.1", "block", at(1)), ("domain", "[2001:db8::1]", "block", at(2)), ("host", "10.0.0.1", "block", at(9)), ("domain", "4]", "block", at(1)), ("prefix", "b.example.com/X", "block", at(19))]
URLS = ["http://a.example.com/x", "https://user:p@B.example.com.:8080/x/y/z?q#f", "http://b.example.com/x/yy", "http://example.com", "http://other.com/", "ftp://x.org/a", "nonsense", None, "", "http://[::1]:80/Login", "http://u@v@[2001:DB8::1]/", "http://10.0.0.1/x", "http://b.example.com/X/y", "http://[::ffff:1.2.3.4]/", "//b.example.com/x", "HTTP://B.EXAMPLE.COM/x/y/Z", "http://b.example.com:/x//y", "http://b.example.com?x/y", "http:///x", "http://a.example.com..:1/"]


def expected(url, when, changes):
    state = {}
    for kind, pattern, action, t in sorted((c for c in changes if all(c) and c[0] != "odd"), key=lambda c: c[3]):
        if t <= when:
            state[kind, pattern if kind == "prefix" else pattern.lower()] = action
    parts = urlsplit(url or "")
    host = (parts.hostname or "").rstrip(".")
    if not host or not parts.scheme:
        return 0, "none"
    address = ":" in host or not host.strip("0123456789.")
    host = f"[{host}]" if ":" in host else host
    keys, labels, path = [], [host] if address else host.split("."), [p for p in parts.path.split("/") if p]
    keys += [("prefix", host + "/" + "/".join(path[:i])) for i in range(len(path), -1, -1)]
    keys += [("host", host)] + [("domain", ".".join(labels[i:])) for i in range(len(labels))]
    met = [state[k] for k in keys if state.get(k, "remove") != "remove"]
    return len(met), met[0] if met else "none"


def test_as_of_join(spark):
    rows = [(10_000 * i + d, u, at(d), "x") for i, u in enumerate(URLS) for d in (0, 4, 5, 10, 19, 20, 49, 50, 300, 650, 700, 1000)]
    rows += [(999_999, URLS[0], None, "x"), (10, URLS[0], at(10), "x"), (None, URLS[0], at(10), "x")]
    captures = spark.createDataFrame(rows, "capture_id long, url string, fetched_at timestamp, verdict string")
    changes = spark.createDataFrame(CHANGES, "kind string, pattern string, action string, changed_at timestamp")
    out = filter_urls(captures, changes).collect()
    assert len(out) == len(rows)
    found = {r.capture_id: (r.matches, r.verdict) for r in out}
    for i, url, when, _ in rows:
        assert found[i] == (expected(url, when, CHANGES) if when else (0, "none")), (url, when)
    assert filter_urls(captures.limit(0), changes).count() == 0
    assert {r.verdict for r in filter_urls(captures, changes.limit(0)).collect()} == {"none"}


def test_intervals_end_with_the_next_change(spark):
    changes = spark.createDataFrame(CHANGES, "kind string, pattern string, action string, changed_at timestamp")
    spans = [(r.valid_from, r.valid_to, r.action) for r in validity_intervals(changes).where("kind = 'host' AND pattern = 'a.example.com'").orderBy("valid_from").collect()]
    assert spans[0] == (at(10), at(50), "block") and spans[1][0] == at(300) and len(spans) == 2


def test_patterns_take_the_form_of_keys(spark):
    changes = [("prefix", "One.com/en/", "block", at(0)), ("prefix", "two.com.//a//b//", "block", at(0)), ("domain", "three.com.", "block", at(0)), ("host", "four.com.", "block", at(0)), ("prefix", "five.com", "block", at(0)), ("prefix", "five.com/x/", "allow", at(1)), ("prefix", "five.com/x", "remove", at(2))]
    urls = {"http://one.com/en/a": "block", "http://one.com/english": "none", "http://two.com/a/b/c": "block", "http://two.com/a": "none", "http://x.three.com/": "block", "http://four.com": "block", "http://five.com/x/y": "block", "http://six.com/": "none"}
    captures = spark.createDataFrame([(i, u, at(5)) for i, u in enumerate(urls)], "capture_id long, url string, fetched_at timestamp")
    out = filter_urls(captures, spark.createDataFrame(changes, "kind string, pattern string, action string, changed_at timestamp")).collect()
    assert {[*urls][r.capture_id]: r.verdict for r in out} == urls and max(r.matches for r in out) == 1
