import duckdb

from plumbline.llm import url_filter

URLS = ["http://EXAMPLE.org/es/1", "http://a.example.org/en/12?x", "https://b.org", "https://b.org/", "http://x.com/fr/1#t", "http://x.com/de/", "http://www.casino-win.example.net/a", "http://adult-x.com/en", None, "", "nourl", "ftp://spam-farm.example.org/es/1", "http://h?q/://z", "http://free-bets:80/x", "a://b://c/d", "http://xcom/fr/"] + [f"http://h{i % 70}.net/{i}" for i in range(300)]


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_like_sql_by_cascade_and_by_join(spark):
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(URLS)] + [(None, URLS[0], 0), (0, URLS[0], 0)], "page_id long, url string, host int")
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    expected = sorted(con.execute(url_filter.ORACLE_SQL).fetchall(), key=str)
    assert rows(url_filter.judge(pages, url_filter.hosts_with(pages))) == expected
    assert rows(url_filter.judge(pages, url_filter.hosts_with(pages), most_bytes=0)) == expected
    assert url_filter.judge(pages.limit(0), url_filter.hosts_with(pages)).count() == 0


def test_cascade_is_exact_though_its_filters_err(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_A_KEY", 2)
    hosts = spark.range(3000).selectExpr("concat('h', id) as host", "id % 3 = 0 as listed")
    cascade = url_filter.Cascade(hosts)
    assert cascade.whole and len(cascade.levels) > 2
    got = cascade.listed(hosts.withColumnRenamed("listed", "truth"))
    assert got.filter("truth <> listed").count() == 0


def test_a_list_of_any_hosts(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.net/") for i in range(200)] + [(200, None)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.net", 1) for i in range(0, 400, 2)] + [("h0.net", 1), (None, 1)], "host string, listed int")
    for most in (url_filter.MOST_BYTES, 0):
        got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, listed, most_bytes=most).collect()}
        assert got == {i: "block" if i < 200 and i % 2 == 0 else "allow" for i in range(201)}
    assert {r["verdict"] for r in url_filter.judge(pages, listed.limit(0)).collect()} == {"allow"}
