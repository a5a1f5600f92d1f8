import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidewire.llm import urls
from tidewire.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string"


def brute_rule(url):
    m = re.search(r"://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def brute_scores(examples):
    """examples: text -> (accepted, rejected)"""
    order, out = urls.ORDER, {}
    grams = lambda t: [(urls._START * order + t + urls._END)[i : i + order + 1] for i in range(len(t) + 1)]
    counts = [Counter(), Counter()]
    for text, pair in examples.items():
        for c, n in zip(counts, pair):
            for g in grams(text):
                for k in range(order + 1):
                    c[g[order - k :]] += n
    letters = len({g[-1] for t in examples for g in grams(t)}) + 1
    after = [defaultdict(set), defaultdict(set)]
    for c, a in zip(counts, after):
        for g, n in c.items():
            if n:
                a[g[:-1]].add(g[-1])
    total = []
    for c in counts:
        sums = Counter()
        for g, n in c.items():
            sums[g[:-1]] += n
        total.append((c, sums))

    def p(side, gram):
        value = 1 / letters
        for k in range(1, len(gram) + 1):
            g = gram[-k:]
            c, sums = total[side]
            n, t = sums[g[:-1]], len(after[side][g[:-1]])
            if n:
                value = (c[g] + t * value) / (n + t)
        return value

    for text in examples:
        all_ = grams(text)
        out[text] = sum(math.log(p(0, g) / p(1, g)) for g in all_) / len(all_)
    return out


def test_scores_equal_brute_force(spark):
    rng = random.Random(1)
    examples = {"".join(rng.choices("ab./é🙂1", k=rng.randint(1, 12))): (rng.randint(0, 2), rng.randint(0, 2)) for _ in range(120)}
    rows = [(t, a, r) for t, (a, r) in examples.items()]
    got = {r["text"]: r["score"] for r in urls.score(spark.createDataFrame(rows, "text string, accepted long, rejected long")).collect()}
    expected = brute_scores(examples)
    assert got.keys() == expected.keys() and all(math.isclose(got[t], expected[t], rel_tol=1e-9, abs_tol=1e-9) for t in got)


def test_rules(spark):
    cases = [None, "", "no scheme", "http://a.NET/", "http://a.net", "https://x.example.net/en/1?q#f", "http://example.net/EN/", "http://notexample.com/de/", "http://example.com/de/x", "http://m.example.com/de", "http://w.org/fr/?a", "http://w.org?x=/fr/", "a://b://c/d", "://", "http://É.net/ü#:// ", "http://x.org/fr/" + "y" * 20000]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(cases)] * 2, PAGES).withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    rows = urls.judge(pages, URL_RULES).collect()
    assert len(rows) == 2 * len(cases)
    for r in rows:
        host, path, rule, verdict = brute_rule(cases[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert urls.judge(pages.limit(0), URL_RULES).count() == 0


def test_models_tell_unruled_urls_apart(spark):
    rng = random.Random(2)
    word = lambda s: "".join(rng.choices(s, k=8))
    rows = [(i, f"http://{word('aeiou')}.good/{i}", None) if i % 2 else (i, f"http://{word('xyzw')}.bad/{i}", None) for i in range(400)]
    rows += [(1000 + i, f"http://{word('aeiou')}.new/{i}", None) if i % 2 else (1000 + i, f"http://{word('xyzw')}.new/{i}", None) for i in range(100)]
    rules = [("allow", "good", "/"), ("block", "bad", "/")]
    found = [r for r in urls.judge(spark.createDataFrame(rows, PAGES), rules).collect() if r["page_id"] >= 1000]
    assert sum((r["verdict"] == "allow") == (r["page_id"] % 2 == 1) for r in found) >= 95
