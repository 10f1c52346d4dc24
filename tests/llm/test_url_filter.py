import re

from docsift.llm import url_filter as uf

SCHEMA = "page_id long, url string, html string, host string, verdict int"
URLS = [
    None, "", "nothing", "https://a.example.net/en/1", "https://A.Example.NET/de/1", "http://net/x", "http://notnet/x", "http://x.net?q=/",
    "http://example.com/de/2#x", "http://b.example.com/en/", "http://org/fr/", "http://x.org/fr", "http://x.org/fr/?a", "s://h.com", "a://b://c/d",
    "http://dexample.com/de/", "http://z.example.net/en/a?b#c", "//x.net/", "http://x.net#f", "http://u@x.net:80/",
]


def plain(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fit = [(h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit, key=lambda f: len(f[0])) if fit else (None, None))


def test_rules(spark):
    rows = [(i, u, None, "x", 1) for i, u in enumerate(URLS)] + [(3, URLS[3], "", "x", 1)]
    got = uf.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = plain(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") if verdict is None else r.verdict == verdict
        if host in ("", "notnet", "h.com"):
            assert r.verdict == "allow"


def test_links_spread_scores(spark):
    link = lambda *hs: "".join(f'<a href="https://{h}/x">x</a>' for h in hs)
    rows = [
        (1, "http://spam.net/a", link("x.com"), None, None), (2, "http://feeds.com/a", link("spam.net", "spam.net"), None, None),
        (3, "http://good.org/fr/a", link("liked.com", "HUB.com"), None, None), (4, "http://liked.com/a", "<a href=/own>", None, None),
        (5, "http://hub.com/a", link("liked.com", "spam.net", "good.org", "x.com"), None, None), (6, "http://x.com/b", None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r for r in uf.judge(df).collect()}
    hosts = ["spam.net", "feeds.com", "good.org", "liked.com", "hub.com", "x.com"]
    n = {(a, b): c for a, b, c in uf.host_links(df).collect()}
    trust, dis = dict.fromkeys(hosts, 0.0), dict.fromkeys(hosts, 0.0)
    a, b = dict(trust, **{"good.org": 1.0}), dict(dis, **{"spam.net": 1.0})
    for _ in range(100):
        trust = {h: 0.15 * a[h] + 0.85 * sum(trust[u] * c / sum(x for (s, _), x in n.items() if s == u) for (u, v), c in n.items() if v == h) for h in hosts}
        dis = {h: 0.15 * b[h] + 0.85 * sum(dis[v] * c / sum(x for (_, t), x in n.items() if t == v) for (u, v), c in n.items() if u == h) for h in hosts}
    for r in got.values():
        assert abs(r.trust - trust[r.host]) < 1e-2 and abs(r.distrust - dis[r.host]) < 1e-2
    assert got[2].verdict == "block" and got[4].verdict == "allow" and got[6].verdict == "allow"


def test_empty(spark):
    assert uf.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_farm_of_hosts_linking_to_one_blocked_host(spark):
    link = lambda *hs: "".join(f'<a href="https://{h}/x">x</a>' for h in hs)
    rows = [(0, "http://spam.net/a", "", None, None)]
    rows += [(i, f"http://farm{i}.com/a", link("spam.net"), None, None) for i in range(1, 41)]
    rows += [(100 + i, f"http://fair{i}.com/a", link("spam.net", "a.com", "b.com", "c.com"), None, None) for i in range(10)]
    got = {r.page_id: r.verdict for r in uf.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == "block" for i in range(41)) and all(got[100 + i] == "allow" for i in range(10))
