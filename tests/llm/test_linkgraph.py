"""op9: rules and propagated amounts against plain Python."""

import re
from collections import Counter, defaultdict

from cliplens.llm import linkgraph as g
from cliplens.llm.q_linkgraph import RULES


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def parse(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (lower(m[1]), m[2]) if m else ("", "")


def brute(pages):
    parsed, good, bad, links = [], Counter(), Counter(), Counter()
    for _, url, html in pages:
        host, path = parse(url)
        fit = [(len(r), v, r) for r, v in RULES for n, s, p in [r.partition("/")]
               if (host == n or host.endswith("." + n)) and path.startswith(s + p)]
        rule = max(fit)[1:] if fit else (None, None)
        parsed.append((host, path, rule[1], rule[0]))
        good[host] += rule[0] == "allow"
        bad[host] += rule[0] == "block"
        for target in re.findall(g.LINK, html or ""):
            if host and lower(target) not in ("", host):
                links[host, lower(target)] += 1
    seeds = {h: (g.UNIT * good[h] // max(1, good[h] + bad[h]), g.UNIT * bad[h] // max(1, good[h] + bad[h]))
             for h, _, _, _ in parsed}
    out, into = Counter(), Counter()
    for (a, b), n in links.items():
        out[a] += n
        into[b] += n
    state = dict(seeds)
    for _ in range(g.ROUNDS):
        sent = defaultdict(lambda: [0, 0])
        for (a, b), n in links.items():
            sent[b][0] += state.get(a, (0, 0))[0] * n // out[a]
            sent[a][1] += state.get(b, (0, 0))[1] * n // into[b]
        state = {h: tuple((15 * seeds.get(h, (0, 0))[i] + 85 * sent[h][i]) // 100 for i in (0, 1))
                 for h in {*seeds, *sent}}
    return sorted((str(p[0]), h, path, str(rule), verdict or (
        "block" if state[h][1] > state[h][0] else "allow")) for p, (h, path, rule, verdict) in zip(pages, parsed))


def link(*hosts):
    return "".join(f'<a HREF = "https://{h}/x">y</a>' for h in hosts)


def test_equals_plain_propagation(spark):
    pages = [(1, "https://good.org/a", link("mid.net", "mid.net", "other.net")),
             (2, "http://Bad.com/de/1", link("bad.com")), (3, "http://mid.net/z?x#y", link("far.net")),
             (4, "http://shady.net", link("bad.com", "BAD.com", "good.org")), (5, None, link("mid.net")),
             (6, "no scheme", None), (7, "http://example.org/en/12", ""), (8, "http://m.example.org/es/", ""),
             (9, "http://far.net/q", "<a href='//shady.net/1'>"), (10, "http://com/fr/", None),
             (11, "x://a://b/c", ""), (12, "http://org", ""), (12, "http://org", ""), (13, "://", ""),
             (14, "http://loner.net/", link("shady.net", "shady.net", "mid.net"))]
    pages += [(100 + i, f"http://hot.net/{i}", link("shady.net", f"t{i}.net")) for i in range(200)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(5)
    got = g.judge_urls(df.selectExpr("*", "'mine' AS host"), RULES)
    rows = got.select("page_id", "judged.*", "host").collect()
    assert sorted((str(r[0]), r[1], r[2], str(r["rule"]), r["verdict"]) for r in rows) == brute(pages)
    verdict = {r[0]: r["verdict"] for r in rows}
    assert verdict[4] == "block" and verdict[3] == "allow" and verdict[100] == "block"
    assert {r[-1] for r in rows} == {"mine"}


def test_empty(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert g.judge_urls(df, RULES).count() == 0
