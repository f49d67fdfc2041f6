"""URL filters: parts of URLs, rules, and propagation against brute force."""

import re

import duckdb
import pytest

from millrace.llm import urlfilter
from millrace.llm.queries import OP6_SQL, URL_RULES


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def brute_rule(host, path, rules):
    fits = []
    for kind, text in rules:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(text), len(name), text, kind))
    return max(fits)[2:] if fits else (None, None)


def brute_judge(pages, rules):
    ruled, links = [], {}
    for page, url, html in pages:
        host, path = brute_parts(url)
        ruled.append((page, host, path, *brute_rule(host, path, rules)))
        for target in re.findall(r"(?:https?:)?//([^/?#\"'\s>]*)", " ".join(re.findall(r"href=\"[^\"]*", html or ""))):
            target = target.lower()
            if host and target and target != host:
                links[host, target] = links.get((host, target), 0) + 1
    hosts = {h for _, h, *_ in ruled} - {""} | {x for pair in links for x in pair}
    share = lambda h, kind: (lambda r: sum(v == kind for v in r) / len(r) if r else 0)([v for _, x, _, _, v in ruled if x == h])
    base = {h: (share(h, "allow"), share(h, "block")) for h in hosts}
    whole = {h: sum(n for (a, _), n in links.items() if a == h) for h in hosts}
    now = dict(base)
    for _ in range(200):
        after = {h: list(v) for h, v in base.items()}
        for (a, b), n in links.items():
            after[b][0] += 0.85 * now[a][0] * n / whole[a]
            after[a][1] += 0.85 * now[b][1] * n / whole[a] * (1 - sum(base[a]))
        now = {h: tuple(v) for h, v in after.items()}
    bad = {h for h, (t, d) in now.items() if d - t > 0.5 + 1e-6}
    return sorted(((p, h, path, r, v or ("block" if h in bad else "allow")) for p, h, path, r, v in ruled), key=repr)


def judged(spark, pages, rules):
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, host string, trust int")
    return sorted((tuple(r) for r in urlfilter.judge(frame, rules).collect()), key=repr)


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?q#f", "http://example.net/en/", "http://example.net/en",
    "http://net/", "http://net", "http://xnet/", "ftp://u@ÄB.org:80/fr/a", "x://y://z/p", "http://a.org?x=/fr/", "http://a.org#b",
    "http://sub.example.com/de/1\n2", "https://example.com/de", "//example.com/de/", "http://a.example.com/fr/?u=http://b.net/",
]


def test_rules_and_parts(spark):
    pages = [(i, url, None) for i, url in enumerate(URLS)] + [(None, URLS[4], ""), (3, URLS[4], "x"), (3, URLS[4], "x")]
    assert judged(spark, pages, URL_RULES) == brute_judge(pages, URL_RULES)


RULES = [("block", "bad.org/"), ("block", "worse.org/"), ("allow", "good.org/"), ("allow", "bad.org/fine/"), ("block", "spam/"), ("allow", "fair/")]


def link_graph():
    """Pages by name: (verdict that the method has to reach, or None where a rule decides; url; html)."""
    link = lambda *hosts: " ".join(f'<a href="http://{h}/x">' for h in hosts) + '<a href="/own">'
    pages = [("block", "http://bad.org/", link("near.org")), ("allow", "http://good.org/", link("fan.org", "near.org"))]
    pages += [("allow", "http://fan.org/", link("bad.org")), ("block", "http://farm.org/1", link("1.spam", "1.spam", "farm2.org"))]
    pages += [("block", "http://farm2.org/1", link("farm.org")), ("allow", "http://near.org/", link())]
    pages += [("allow", "http://bad.org/fine/", None), ("allow", "http://alone.org/", "<a href='#'>")]
    pages += [("block", "http://bad2.bad.org/", link("bad.org", "worse.org")), ("block", "http://worse.org/", link("bad.org", "bad2.bad.org"))]
    for count in (1, 2, 100):  # farms around one host
        pages.append(("block", f"http://{count}.spam/", None))
        pages += [("block", f"http://m{k}.farm{count}/", link(f"{count}.spam")) for k in range(count)]
    # Links to nine good hosts and to one whose blocked hosts link to each other.
    pages.append(("allow", "http://honest.org/", link("worse.org", *(f"h{k}.fair" for k in range(9)))))
    pages += [("allow", f"http://h{k}.fair/", None) for k in range(9)]
    # Reached over others, vouched for by a trusted host, and half of a mixed host.
    pages += [("block", "http://second.org/", link("m0.farm100")), ("allow", "http://vouched.org/", link("2.spam"))]
    pages += [("allow", "http://voucher.fair/", link("vouched.org")), ("allow", "http://mixed.org/", link("bad.org", "h1.fair"))]
    return pages


def test_propagation(spark):
    pages = link_graph()
    rows = [(i, url, html) for i, (_, url, html) in enumerate(pages)]
    found = judged(spark, rows, RULES)
    assert found == brute_judge(rows, RULES)
    verdicts = {row[0]: row[4] for row in found}
    assert {pages[i][1]: v for i, v in verdicts.items()} == {url: v for v, url, _ in pages}


def test_values_reach_their_limit(spark):
    seeds = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 0.0), ("s", 0.0, 1.0), ("t", 1.0, 0.0)], "host string, trust double, distrust double")
    links = spark.createDataFrame([("a", "b", 3), ("b", "a", 1), ("a", "s", 1), ("t", "a", 2)], "source string, target string, n long")
    found = {r.host: (r.trust, r.distrust) for r in urlfilter.propagate(seeds, links).collect()}
    into = 0.85 / (1 - 0.85 * 0.85 * 0.75)
    away = 0.85 * 0.25 / (1 - 0.85 * 0.75 * 0.85)
    limits = {"a": (into, away), "b": (into * 0.85 * 0.75, 0.85 * away), "s": (into * 0.85 * 0.25, 1.0), "t": (1.0, 0.0)}
    for host, limit in limits.items():
        assert found[host] == pytest.approx(limit, abs=urlfilter.RESIDUAL)


def test_sql_on_a_link_graph():
    """The SQL text with the rules of the query, on pages that link between hosts."""
    pages = [(1, "http://x.net/", None), (2, "http://example.net/en/", None)]
    pages += [(3 + k, f"http://f{k}.io/", '<a href="//x.net/">' + f'<a href="//f{1 - k}.io">') for k in range(2)]
    pages += [(5, "http://ok.io/", '<a href="//x.net">' + '<a href="//example.net">' * 3)]
    base = duckdb.connect()
    base.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    base.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    assert sorted(base.execute(OP6_SQL).fetchall(), key=repr) == brute_judge(pages, URL_RULES)
    assert {r[0]: r[4] for r in brute_judge(pages, URL_RULES)} == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow"}


def test_empty_table(spark):
    assert judged(spark, [], URL_RULES) == []


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_pages(spark, name):
    frame = spark.read.parquet(f"/root/testdata/{name}/pages.parquet")
    pages = [(r.page_id, r.url, r.html) for r in frame.collect()]
    assert sorted((tuple(r) for r in urlfilter.judge(frame, URL_RULES).collect()), key=repr) == brute_judge(pages, URL_RULES)
