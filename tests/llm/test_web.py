from ferrule.llm import queries as Q
from ferrule.llm import url_filter as U
from ferrule.llm import warc


def test_rules(spark):
    cases = {
        "http://Example.COM/en/x": ("example.com", "/en/x", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://a.b.example.com/en/?q=1": ("a.b.example.com", "/en/", "example.com/en/", "block"), "http://www.example.com/fr": ("www.example.com", "/fr", "com/", "allow"),
        "http://x.net/es/1#f": ("x.net", "/es/1", "net/es/", "block"), "http://x.net/esp": ("x.net", "/esp", None, "allow"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"), "http://example.com?x=/en/": ("example.com", "", None, "allow"), "no scheme com/": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http:///en/": ("", "/en/", None, "allow"), "http://com/a://net/es/": ("com", "/a://net/es/", "com/", "allow"), "http://a..com/x\ny": ("a..com", "/x\ny", "com/", "allow"),
    }
    rows = [(i, u) for i, u in enumerate([*cases, *cases])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "1 as rule", "'y' as _row")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, U.rules_frame(spark, Q.URL_RULES)).collect()}
    assert got == {i: cases[u] for i, u in rows}
    same = pages.unionByName(pages)
    assert U.judge(same, U.rules_frame(spark, Q.URL_RULES)).count() == 2 * len(rows)
    assert U.judge(pages.limit(0), U.rules_frame(spark, Q.URL_RULES)).count() == 0
    assert {r.verdict for r in U.judge(pages, U.rules_frame(spark, Q.URL_RULES).limit(0)).collect()} == {"allow"}


RECORDS = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, length long, headers map<string,string>, key string, here int"


def records(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], RECORDS)


def test_revisits(spark):
    rows = [
        (1, "http://a.com/x/", 10, "response", '"1"', "m1", "d1", 5, {"ETag": '"1"', "Content-Type": "t", "Cache-Control": "old"}),
        (2, "https://A.com:443/x#f", 20, "revisit", '"1"', None, None, 0, {"cache-control": "new", "Content-Length": "0", "DATE": "20", "Date": "21"}),
        (3, "http://a.com/x", 30, "response", '"2"', "m2", "d2", 6, None),
        (4, "http://a.com/x?utm_source=q", 31, "revisit", '"1"', None, None, 0, {}),
        (5, "http://a.com/x", 32, "revisit", None, "m2", None, 0, None),
        (6, "http://a.com/x", 33, "revisit", None, None, None, 0, None),
        (7, "http://a.com/x", 10, "revisit", '"1"', None, None, 0, None),
        (8, "http://b.com/", 99, "revisit", '"1"', None, None, 0, None),
        (9, None, 99, "revisit", None, None, None, 0, None),
        (10, "http://a.com/x", None, "revisit", None, None, None, 0, None),
        (11, "http://a.com/x", 30, "response", '"3"', None, "d3", 7, {}),
        (12, "http://a.com/x", 40, "revisit", '"3"', None, None, 0, None),
        (12, "http://a.com/x", 40, "revisit", '"3"', None, None, 0, None),
    ]
    for blocks in (1, 3, 256):
        got = sorted(((r.record_id, r.status, r.matched_id, r.http_status, r.digest) for r in warc.resolve(records(spark, rows), blocks).collect()))
        assert got == [
            (2, "resolved", 1, 200, "d1"), (4, "mismatch", 11, 304, None), (5, "unvalidated", 11, 200, "d3"), (6, "unvalidated", 11, 200, "d3"), (7, "no_response", None, 304, None), (8, "no_response", None, 304, None),
            (9, "no_url", None, 304, None), (10, "no_time", None, 304, None), (12, "resolved", 11, 200, "d3"), (12, "resolved", 11, 200, "d3"),
        ]
    merged = {r.record_id: r.headers for r in warc.resolve(records(spark, rows)).collect()}
    assert merged[2] == {"etag": '"1"', "content-type": "t", "cache-control": "new", "date": "21"}
    assert warc.resolve(records(spark, rows[:1])).count() == 0
    assert warc.resolve(records(spark, rows).limit(0)).count() == 0


def test_a_hot_url_in_time_blocks(spark):
    rows = [(i, "http://hot.com/", i, "response" if i % 7 == 0 else "revisit", None, None, f"d{i}", 1, None) for i in range(600)]
    got = {r.record_id: r.matched_id for r in warc.resolve(records(spark, rows), 16).collect()}
    assert got == {i: i - i % 7 for i in range(600) if i % 7}


def test_a_bad_clock_and_many_records_of_one_time(spark):
    rows = [(1, "http://a.com/", 0, "response", None, None, "d", 1, None), (2, "http://a.com/", 2**60, "revisit", None, None, None, 0, None)]
    rows += [(10 + i, "http://a.com/", 10**9 + i // 50, "response" if i % 50 < 3 else "revisit", None, None, f"d{i}", 1, None) for i in range(1000)]
    got = {r.record_id: r.matched_id for r in warc.resolve(records(spark, rows), 8).collect()}
    want = {10 + i: 10 + (i // 50 - 1) * 50 + 2 if i >= 50 else 1 for i in range(1000) if i % 50 >= 3} | {2: 962}
    assert got == want


def test_block_of_is_the_number_of_bounds_reached(spark):
    from pyspark.sql import functions as F

    for bounds in ([], [5], [1, 4, 9], list(range(0, 37, 3))):
        got = [(r.id, r.b) for r in spark.range(-2, 40).select("id", warc.block_of(F.col("id"), bounds).alias("b")).collect()]
        assert got == [(i, sum(x <= i for x in bounds)) for i in range(-2, 40)]


def test_weak_tags_and_null_ids(spark):
    rows = [
        (1, "http://a.com/", 1, "response", 'W/"v"', None, "d", 1, None), (2, "http://a.com/", 2, "revisit", '"v"', None, None, 0, None), (3, "http://a.com/", 3, "revisit", 'W/"v"', None, None, 0, None),
        (4, "http://a.com/", 4, "revisit", 'W/"w"', None, None, 0, None), (None, "http://a.com/" + "x" * 300_000, 4, "revisit", None, None, None, 0, None), (None, "http://a.com/", 5, "revisit", '"v"', None, None, 0, {"ETag": None}),
    ]
    got = sorted(((r.record_id or 0, r.status) for r in warc.resolve(records(spark, rows)).collect()))
    assert got == [(0, "no_response"), (0, "resolved"), (2, "resolved"), (3, "resolved"), (4, "mismatch")]
    pages = spark.createDataFrame([(None, "http://x.net/es/"), (None, "http://x.net/es/"), (1, "http://x.net/" + "es/" * 100_000)], "page_id long, url string")
    got = [(r.page_id, r.rule) for r in U.judge(pages, U.rules_frame(spark, Q.URL_RULES)).collect()]
    assert sorted(got, key=str) == [(1, "net/es/"), (None, "net/es/"), (None, "net/es/")]


def test_many_rules_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_BYTES", 0)
    test_rules(spark)
