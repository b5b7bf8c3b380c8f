import random
import time

import pytest
from pyspark.sql import functions as F

from tickloom.llm.url_filter import Cascade, url_filter


def judge(url, rules, default="allow"):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith(f".{h}")) and path.startswith(f"/{p}") and len(rule) > len(best or ""):
            best = rule
    return host, path, best, rules[best] if best else default


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow", "a.b.org/": "block"}


def urls():
    rng = random.Random(2)
    hosts = ["example.net", "EXAMPLE.com", "x.example.com", "notexample.com", "net", "a.b.org", "b.org", "org", "xa.b.org", "", ".net", "q.net:80"]
    paths = ["", "/", "/de/", "/de", "/en/x", "/fr/y?z", "?q=/de/", "#/en/", "/EN/", "/en/#f"]
    out = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    return [*out, None, "", "no scheme", "http:/example.net/", "http://" + "a." * 5_000 + "net/" + "x" * 50_000, "a://b://example.net/", out[0]]


def test_equals_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls())], "page_id long, url string, keys string").withColumn("rule", F.lit("old"))
    got = {r.page_id: r for r in url_filter(pages, RULES).collect()}
    assert len(got) == len(urls()) and all(r["keys"] == "z" for r in got.values())
    for i, u in enumerate(urls()):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == judge(u, RULES), u
    assert url_filter(pages.limit(0), RULES).count() == 0
    with pytest.raises(ValueError, match="max_words"):
        url_filter(pages, RULES, max_words=0)


def test_cascade_is_exact(spark):
    universe = spark.range(4_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("hash(key) % 7 = 0")
    cascade = Cascade.build(listed, universe)
    got = universe.where(cascade.contains(F.col("key")))
    assert got.exceptAll(listed).isEmpty() and listed.exceptAll(got).isEmpty()
    assert len(cascade.levels) >= 2
    assert universe.where(Cascade.build(listed.limit(0), universe).contains(F.col("key"))).isEmpty()


def test_hundreds_of_rule_shapes(spark):
    """300 shapes over 20,000 urls: one expression for all of them, and every rule found."""
    rng = random.Random(9)
    hosts = ["a.org", "b.a.org", "c.b.a.org", "d.c.b.a.org"]
    path = lambda n: "/" + "".join(rng.choice("xy") for _ in range(n - 1))
    shapes = rng.sample([(h, n) for h in range(1, 5) for n in range(1, 101)], 300)
    rules = {f"{'.'.join(hosts[3].split('.')[-h:]) if h > 1 else 'org'}{path(n)}": rng.choice(["block", "allow"]) for h, n in shapes}
    assert len({(r.partition("/")[0].count("."), len(r) - r.index("/")) for r in rules}) == 300
    listed = sorted(rules)
    urls = []
    for _ in range(20_000):
        rule = rng.choice(listed)
        host, tail = rule.split("/", 1)
        sub = rng.choice(["", "", "www.", "q.r."])
        cut = tail if rng.random() < 0.7 else tail[: rng.randrange(len(tail) + 1)]
        urls.append(f"http://{sub}{host}/{cut}{rng.choice(['', 'xyxy', '?q', 'x' * 60])}")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    began = time.time()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, rules).collect()}
    took = time.time() - began
    for i in range(0, 20_000, 7):
        host, way, best, verdict = judge(urls[i], rules)
        assert got[i][:2] == (host, way) and len(got[i][2] or "") == len(best or ""), urls[i]
        if best is None or [r for r in rules if len(r) == len(best) and judge(urls[i], {r: ""})[2]] == [best]:
            assert got[i][2:] == (best, verdict)
    assert took < 25
