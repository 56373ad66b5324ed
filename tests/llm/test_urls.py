"""Url verdicts against a plain computation."""

import re

import pytest

from tuneprep.llm import url_filter as U

PAGES = [
    (1, "http://Good.Example.COM/de/x?y", "see http://hub.org/ and www.good.example.com // hub2.org"),
    (2, "https://good.example.com/en/1", None),
    (3, "https://www.example.com/en/1#t", ""),
    (4, "https://m.www.example.com/en", "<a href='http://bad.net/fr/'>"),
    (5, "http://bad.net/fr/1", "http://bad.net src = '//bad.net'"),
    (6, "http://bad.net/en/1", "no link"),
    (7, "http://farm.org/a", "<A HREF=//bad.net/x> HTTPS://bad.net www.bad.net."),
    (8, "http://hub.org", 'href="//farm.org"'),
    (9, "http://hub.org?x://y.com/", "https://other.org"),
    (10, "ftp://notnet/es/", None),
    (11, None, "http://bad.net"),
    (12, "no scheme", "http://bad.net"),
    (13, "http:///es/", "http://bad.net"),
    (14, "http://net/es/", "src=//farm.org"),
    (1, "http://com/", "http://com"),
]


def expected(pages):
    rows = []
    for key, url, html in pages:
        m = re.search("://([^/?#]*)([^?#]*)", url or "")
        host = m[1].translate(str.maketrans(U._UPPER, U._LOWER)) if m else ""
        path = m[2] if m else ""
        fits = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, None)
        rows.append((key, host, path, rule, verdict, html or ""))
    weight, seeds = {}, {"allow": {}, "block": {}}
    for _, host, _, _, verdict, html in rows:
        if host and verdict:
            seeds[verdict][host] = seeds[verdict].get(host, 0) + 1
        for name in re.findall(U._LINK, html):
            name = name.rpartition("//")[2].lower()
            if host and name != host:
                weight[host, name] = weight.get((host, name), 0) + 1
    scores = {}
    for verdict, forward in (("allow", True), ("block", False)):
        total = sum(seeds[verdict].values())
        start = {h: (1 - U.DAMPING) * n / total for h, n in seeds[verdict].items()}
        flow = weight if forward else {(b, a): w for (a, b), w in weight.items()}
        out = {}
        for (a, _), w in flow.items():
            out[a] = out.get(a, 0) + w
        scores[verdict] = start, flow, out
    # Both are moved on for the same number of steps, until what is left of each is small.
    total = {v: dict(start) for v, (start, _, _) in scores.items()}
    new = {v: dict(start) for v, (start, _, _) in scores.items()}
    while True:
        for _ in range(U.STEPS_PER_TABLE):
            for verdict, (_, flow, out) in scores.items():
                after = {}
                for (a, b), w in flow.items():
                    after[b] = after.get(b, 0) + U.DAMPING * new[verdict].get(a, 0) * w / out[a]
                for b, w in after.items():
                    total[verdict][b] = total[verdict].get(b, 0) + w
                new[verdict] = after
        if max(sum(x.values()) for x in new.values()) / (1 - U.DAMPING) <= U.TOLERANCE:
            break
    scores = total
    result = []
    for key, host, path, rule, verdict, _ in rows:
        trust, distrust = scores["allow"].get(host, 0.0), scores["block"].get(host, 0.0)
        result.append((key, host, path, rule, verdict or ("block" if distrust > trust * U.MARGIN else "allow"), trust, distrust))
    return result


def compare(rows, wanted):
    rows, wanted = sorted(map(tuple, rows), key=str), sorted(wanted, key=str)
    assert [r[:5] for r in rows] == [w[:5] for w in wanted]
    for r, w in zip(rows, wanted):
        assert r[5:] == pytest.approx(w[5:], abs=1e-12)


def test_cases(spark):
    df = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "id long, url string, html string, host string, verdict string")
    rows = U.judge(df).collect()
    compare(rows, expected(PAGES))
    verdicts = {r["host"]: r["verdict"] for r in rows}
    assert verdicts["farm.org"] == "block" and verdicts["hub.org"] == "allow"
    assert U.judge(df.limit(0)).count() == 0


def test_whole_table(spark, folder):
    df = spark.read.parquet(f"{folder}/pages.parquet")
    pages = [(r["page_id"], r["url"], r["html"]) for r in df.collect()]
    compare(U.judge(df.withColumnRenamed("page_id", "id")).collect(), expected(pages))


def test_what_is_a_link(spark):
    html = """<a href = "//One.org/x"> <IMG SRC='//two.org'> // three.org //four.org/ http://five.org:80 //six
      see www.seven.org. data-x="//eight.org" https://nine.org"""
    df = spark.createDataFrame([("me.org", html)], "host string, html string")
    assert {r["target"] for r in U.host_links(df).collect()} == {"one.org", "two.org", "five.org", "www.seven.org", "nine.org"}


def test_hubs_beyond_the_broadcast_bound_give_the_same(spark, monkeypatch):
    pages = [(i, f"http://h{i}.net/{'es' if i % 7 == 0 else 'x'}/", "http://hub.com " + f"http://h{i * 3 % 50}.net") for i in range(50)]
    pages += [(100 + i, "http://hub.com/", f"http://h{i}.net") for i in range(50)]
    df = spark.createDataFrame(pages, "id long, url string, html string")
    wanted = expected(pages)
    compare(U.judge(df).collect(), wanted)
    monkeypatch.setattr(U, "fits_broadcast", lambda table: False)
    monkeypatch.setattr(U, "STEPS_PER_TABLE", 3)
    monkeypatch.setattr(U, "TOLERANCE", 0.2)
    links = U.host_links(df.select(U.parts(df["url"])[0].alias("host"), "html"))
    seeds = spark.createDataFrame([("hub.com", 1.0, 0.0), ("h0.net", 0.0, 1.0)], "host string, trust double, distrust double")
    spread = {r["host"]: r[1:] for r in U.propagate(links, seeds, tolerance=0.2).collect()}
    monkeypatch.setattr(U, "fits_broadcast", lambda table: True)
    usual = {r["host"]: r[1:] for r in U.propagate(links, seeds, tolerance=0.2).collect()}
    assert spread.keys() == usual.keys()
    for host, values in usual.items():
        assert spread[host] == pytest.approx(values, abs=1e-12)
