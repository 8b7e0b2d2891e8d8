"""op9: amounts go as far as links lead."""

from cliplens.llm import linkgraph as g
from cliplens.llm.q_linkgraph import RULES
from tests.llm.test_linkgraph import link


def test_chain_of_ten_hosts_is_walked_to_its_end(spark):
    pages = [(i, f"http://h{i}.net/", link(f"h{i + 1}.net")) for i in range(10)]
    pages += [(10, "http://h10.net/", link("bad.com")), (11, "http://bad.com/de/", "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows = {r["page_id"]: r["judged"] for r in g.judge_urls(df, RULES).collect()}
    assert all(r["verdict"] == "block" for r in rows.values())
    for i in range(11):
        assert abs(rows[i]["distrust"] - 0.15 * 0.85 ** (11 - i)) < 1e-12


def test_small_amounts_pass_a_chain_of_hubs(spark):
    hubs = [(0, "http://end.net/", link("hub1.net")),
            (1, "http://hub1.net/", link("hub2.net")), (2, "http://hub2.net/", link("bad.com")),
            (3, "http://bad.com/de/", "")]
    many = 40_000  # distrust goes to each that links to a hub, so the hub divides by this
    crowd = [(10 + i, f"http://crowd{i}.net/", link(*["hub1.net", "hub2.net", "bad.com"] * many))
             for i in range(2)]
    df = spark.createDataFrame(hubs + crowd, "page_id bigint, url string, html string")
    rows = {r["page_id"]: r["judged"] for r in g.judge_urls(df, RULES).collect()}
    want = 0.15
    for _ in range(3):
        want *= 0.85 / (2 * many + 1)
    assert rows[0]["distrust"] > 0 and abs(rows[0]["distrust"] / want - 1) < 1e-6
    assert rows[0]["verdict"] == "block"


def test_circle_settles(spark):
    pages = [(1, "http://a.net/", link("b.net")), (2, "http://b.net/", link("a.net", "bad.com")),
             (3, "http://bad.com/de/", "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows = {r["page_id"]: r["judged"] for r in g.judge_urls(df, RULES).collect()}
    b = 0.85 * 0.15 / (1 - 0.85 ** 2)  # all that links to a.net is b.net, and the other way round
    assert abs(rows[2]["distrust"] - b) < 1e-5 and abs(rows[1]["distrust"] - 0.85 * b) < 1e-5
