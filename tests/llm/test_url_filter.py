import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import url_filter as U


def plain_rule(host, path):
    fitting = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fitting, key=lambda r: len(r.text), default=None)


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.COM/en/7?x", "https://b.example.net/de/80#t", "ftp://x.org/es/", "no url", None, "http://h", "http://h?q://z/p", "a://B.com/en/1://y", "http://example.net/de/1", "http://notexample.com/en/70", "http://org/es/x", "http://h/\n/p"]
    frame = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in U.judge_pages(frame).collect()}
    assert len(got) == len(urls)
    want = [("a.example.com", "/en/7"), ("b.example.net", "/de/80"), ("x.org", "/es/"), ("", ""), ("", ""), ("h", ""), ("h", ""), ("b.com", "/en/1://y"), ("example.net", "/de/1"), ("notexample.com", "/en/70"), ("org", "/es/x"), ("h", "/\n/p")]
    for i, (host, path) in enumerate(want):
        rule = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.text), urls[i]
        assert got[i].verdict == (rule.verdict if rule else got[i].graph_verdict)
    assert got[3].verdict == got[4].verdict == "allow"
    assert U.judge_pages(frame.limit(0)).count() == 0


@pytest.mark.parametrize("hub", [10_000, 1])
def test_propagation_equals_the_dense_solution(spark, monkeypatch, hub):
    monkeypatch.setattr(U, "HUB_EDGES", hub)
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("c", "d", 1.0), ("e", "d", 3.0), ("d", "a", 1.0)]
    names = sorted({x for e in edges for x in e[:2]})
    weight = np.zeros((5, 5))
    for s, d, w in edges:
        weight[names.index(s), names.index(d)] = w

    def walk(m, seed):
        m = np.divide(m, m.sum(1, keepdims=True), out=np.zeros_like(m), where=m.sum(1, keepdims=True) > 0)
        return np.linalg.solve(np.eye(5) - 0.85 * m.T, 0.15 * seed)

    trust, distrust = walk(weight, np.array([1.0, 0, 0, 0, 0])), walk(weight.T, np.array([0, 0, 0, 1.0, 0]))
    frame = spark.createDataFrame(edges, "src string, dst string, weight double")
    seeds = spark.createDataFrame([("t", "a", 1.0), ("d", "d", 1.0)], "kind string, host string, seed double")
    got = {(r.kind, r.host): r.score for r in U.propagate(frame, seeds, 0.85, 1e-4).collect()}
    for i, name in enumerate(names):
        assert abs(got.get(("t", name), 0) - trust[i]) < 1e-3 and abs(got.get(("d", name), 0) - distrust[i]) < 1e-3


def test_links_of_pages_and_verdicts(spark, monkeypatch):
    pages = [(1, "http://bad.com/en/1", ""), (2, "http://near.site.io/x", '<a href="http://bad.com/z">q</a>'), (3, "http://good.net/de/1", '<a href="//fine.site.io/">f</a>'), (4, "http://fine.site.io/x", "text"), (5, "http://near.site.io/y", None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for limit in (100_000, 0):
        monkeypatch.setattr(U, "BROADCAST_HOSTS", limit)
        got = {r.page_id: r.verdict for r in U.judge_pages(frame, tolerance=0.3).collect()}
        assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block"}


def test_copies_of_a_host_graph_leave_every_verdict(spark):
    pages = [("http://bad{}.com/en/1", ""), ("http://bad{}.com/plain", ""), ("http://near{}.io/x", '<a href="http://bad{}.com/z">q</a>'), ("http://far{}.io/x", '<a href="//near{}.io/">n</a><a href="//good{}.net/">g</a>'), ("http://good{}.net/de/1", '<a href="//fine{}.io/">f</a>'), ("http://fine{}.io/x", "")]
    for copies in (1, 60_000):
        numbers, parts = spark.range(copies).withColumn("at", F.col("id").cast("string")), []
        for place, (url, html) in enumerate(pages):
            parts.append(F.struct(F.lit(place).cast("long").alias("page_id"), F.replace(F.lit(url), F.lit("{}"), F.col("at")).alias("url"), F.replace(F.lit(html), F.lit("{}"), F.col("at")).alias("html")))
        frame = numbers.select(F.inline(F.array(*parts)))
        got = {(r.page_id, r.verdict): r["count"] for r in U.judge_pages(frame, tolerance=0.3).groupBy("page_id", "verdict").count().collect()}
        assert got == {(0, "block"): copies, (1, "block"): copies, (2, "block"): copies, (3, "block"): copies, (4, "allow"): copies, (5, "allow"): copies}


def test_trust_reaches_hosts_far_from_every_seed(spark):
    pages = [("http://bad.com/en/1", '<a href="http://h0.io/">x</a>')] + [(f"http://h{i}.io/", f'<a href="http://h{i + 1}.io/">x</a>') for i in range(20)] + [("http://h20.io/", '<a href="http://bad.com/">x</a>')]
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in U.judge_pages(frame).collect()}
    assert set(got.values()) == {"block"} and len(got) == 22


@pytest.mark.parametrize("others", [1, 50_000])
def test_a_long_chain_among_unrelated_seeds(spark, others):
    chain = [(f"http://h{i}.io/", f'<a href="http://h{i + 1}.io/">x</a>') for i in range(60)]
    pages = [*chain, ("http://h60.io/", '<a href="http://bad.com/">x</a>'), ("http://bad.com/en/1", "")]
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    more = spark.range(others).select((F.col("id") + 1_000).alias("page_id"), F.concat(F.lit("http://other"), F.col("id").cast("string"), F.lit(".com/en/1")).alias("url"), F.lit("").alias("html"))
    got = U.judge_pages(frame.unionByName(more)).where("page_id < 1000").collect()
    assert len(got) == 62 and {r.verdict for r in got} == {"block"}


def test_tasks_and_hubs_leave_the_scores(spark, monkeypatch):
    rng = np.random.default_rng(8)
    edges = sorted({(f"h{a}", f"h{b}", float(w)) for a, b, w in zip(rng.integers(0, 40, 150) // 2, rng.integers(0, 40, 150), rng.integers(1, 4, 150)) if a != b})
    frame = spark.createDataFrame(edges, "src string, dst string, weight double").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    seeds = spark.createDataFrame([("t", "h1", 1.0), ("d", "h2", 0.5), ("d", "h3", 1.0)], "kind string, host string, seed double")
    found = []
    for limit, hub in ((250_000, 100_000), (0, 100_000), (0, 3), (250_000, 3)):
        monkeypatch.setattr(U, "TASK_EDGES", limit)
        monkeypatch.setattr(U, "HUB_EDGES", hub)
        found.append({(r.kind, r.host): round(r.score, 12) for r in U.propagate(frame, seeds, 0.85, 1e-3).collect()})
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) > 40


def test_very_long_html(spark):
    html = "<p>filler</p>" * 200_000 + '<a href="http://bad.com/">x</a>'
    frame = spark.createDataFrame([(1, "http://near.io/", html), (2, "http://bad.com/en/1", None)], "page_id long, url string, html string")
    assert {r.verdict for r in U.judge_pages(frame).collect()} == {"block"}


def test_host_edges_against_plain_python(spark):
    pages = [
        ("a.com", '<a href="http://B.com/x">b</a> <a href=\'//c.b.com?q\'>c</a> see www.d.org, and e.org; <img src=https://b.com/2>'),
        ("a.com", '<a href="http://b.com/">again</a> <a href="/own">own</a> <a href="http://a.com/1">self</a>'),
        ("x.y.example.org", None), ("x.y.example.org", "no links"), ("", '<a href="http://b.com/">lost</a>'), ("solo", "mail me@www.f.net now"),
    ]
    frame = spark.createDataFrame(pages, "host string, html string")
    got = {(r.src, r.dst): r.weight for r in U.host_edges(frame).collect()}
    want: Counter = Counter()
    label = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
    for host, html in pages:
        found = {m.lower() for m in re.findall(r"""(?:href|src)=["']?(?:https?:)?//([^/?#"'\s>]+)""", html or "")}
        found |= {w.lower() for w in re.findall(rf"(?<=[\s>;@])((?:{label}\.){{2,}}[A-Za-z]+)(?=[\s<,;/?#]|$)", html or "")}
        for dst in found - {host}:
            if host:
                want[host, dst] += 1
    for host in {h for h, _ in pages}:
        if host.count(".") >= 2:
            up = host.split(".", 1)[1]
            want[host, up] += 1
            want[up, host] += 1
    assert got == dict(want) and want["a.com", "b.com"] == 2 and ("a.com", "www.d.org") in want and ("a.com", "e.org") not in want
