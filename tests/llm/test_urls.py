from vitaframe.llm import urls


def test_a_rare_verdict_is_learned(spark):
    odd = "%20%20%20-12345678901234567890"
    rows = [(i, f"http://h{i}.com/fr/{i}") for i in range(3000)] + [(5000 + i, f"http://h{i}.com/de/{odd}{i}") for i in range(6)]
    asked = [(9000, f"http://q.com/zz/{odd}7"), (9001, "http://h7.com/zz/7")]
    df = spark.createDataFrame(rows + asked, "page_id long, url string")
    got = {r.id: r for r in urls.judge(df, train_rows=50).collect()}
    assert got[9000].rule is None and got[9000].verdict == "block" and got[9001].verdict == "allow"


def test_odd_tables(spark):
    rows = [(1, "http://h.com/fr/a", "h", 0.5)] * 3 + [(None, None, "h", 0.5), (2, "no scheme", "h", 0.5), (3, "http://x.example.org/es/" + "a" * 50_000, "h", 0.5), (4, "HTTP://A.COM/de/b", "h", 0.5)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, prediction double")
    got = [tuple(r)[:5] for r in urls.judge(df).select("id", "host", "rule", "verdict", "path").collect()]
    assert len(got) == 7 and len({r for r in got if r[0] == 1}) == 1
    by_id = {r[0]: r for r in got}
    assert by_id[None][1] == "" and by_id[2][1:3] == ("", None) and by_id[3][2:4] == ("example.org/es/", "block") and len(by_id[3][4]) == 50_004
    assert by_id[4][1:4] == ("a.com", "com/de/", "block") and by_id[1][2:4] == ("com/fr/", "allow")
    assert urls.judge(df.limit(0)).count() == 0
