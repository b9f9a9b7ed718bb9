"""Trust and distrust over the host graph: one scale, no fixed reach."""

from tavolo.llm import urls


def verdicts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.verdict for r in urls.judge_urls(df).collect()}


def test_unconnected_hosts_change_no_verdict(spark):
    rows = [(1, "http://a.com/y", ""), (2, "http://a.com/fr/1", ""), (3, "http://a.com/fr/2", ""), (4, "http://a.com/de/1", ""),
            (5, "http://b.com/x", '<a href="http://c.com/">'), (6, "http://c.com/de/", ""), (7, "http://d.com/fr/", "<a href=//e.net/>"),
            (8, "http://e.net/1", "")]
    alone = verdicts(spark, rows)
    assert alone[1] == "allow" and alone[5] == "block" and alone[8] == "allow"
    far = [(100 + i, f"http://z{i % 3}.org/{i}", "") for i in range(50)]
    far += [(200 + i, f"http://y{i % 3}.com/de/{i}", "") for i in range(50)]
    assert {k: v for k, v in verdicts(spark, rows + far).items() if k < 100} == alone


def test_distrust_reaches_along_a_long_chain(spark):
    """30 hosts, each linking the next, the last one blocked: all point at it in the end."""
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">') for i in range(30)]
    rows += [(30, "http://h30.net/", '<a href="http://bad.com/">'), (31, "http://bad.com/de/", "")]
    got = verdicts(spark, rows)
    assert all(got[i] == "block" for i in range(32))


def test_equal_trust_and_distrust_allow(spark):
    assert verdicts(spark, [(1, "http://a.com/fr/", ""), (2, "http://a.com/de/", ""), (3, "http://a.com/", "")])[3] == "allow"
    assert verdicts(spark, [(1, "http://a.net/", ""), (2, None, None)]) == {1: "allow", 2: "allow"}
