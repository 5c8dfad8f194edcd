import math
import re
from collections import Counter, defaultdict

import pytest

from corpuslens.llm.queries import op2_urls
from corpuslens.llm.urls import ALPHABET, ORDER, RULES, UNIT, judge, keep_allowed, model, threshold

from ..conftest import SF


def parts(url):
    _, there, rest = (url or "").partition("://")
    host = re.split("[/?#]", rest)[0]
    return (re.sub("[A-Z]", lambda x: x[0].lower(), host), re.split("[?#]", rest[len(host) :])[0]) if there else ("", "")


def rule(host, path):
    fits = [r for r, _ in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits, key=len, default=None)


class Markov:
    """Witten-Bell by its recursion."""

    def __init__(self, texts):
        self.n, self.follow = Counter(), defaultdict(Counter)
        for t in texts:
            s = "\x02" * ORDER + t + "\x03"
            for i in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    self.follow[s[i - k : i]][s[i]] += 1

    def p(self, context, c):
        lower = 1 / ALPHABET if not context else self.p(context[1:], c)
        if context is None:
            return lower
        seen = self.follow.get(context, {})
        n, t = sum(seen.values()), len(seen)
        return (seen.get(c, 0) + t * lower) / (n + t) if n + t else lower


def test_model_against_recursion(spark):
    rows = [("ab.com/en/1", 3, 0), ("abc.com/en/22", 1, 0), ("zz.net/q", 0, 1), ("zz.net/ab", 0, 2), ("other/é", 0, 0), ("", 0, 0)]
    found = model(spark.createDataFrame([(t, 3, x, y) for t, x, y in rows], "text string, n long, accepted long, rejected long")).collect()
    got = {r.gram: r.ratio for r in found}
    assert {r.gram: r.n for r in found}["m/en/"] == 6
    a, b = Markov([t for t, x, _ in rows for _ in range(x)]), Markov([t for t, _, x in rows for _ in range(x)])
    want = {}
    for t, _, _ in rows:
        s = "\x02" * ORDER + t + "\x03"
        for i in range(ORDER, len(s)):
            g = s[i - ORDER : i + 1]
            want[g] = math.log(a.p(g[:-1], g[-1])) - math.log(b.p(g[:-1], g[-1]))
    assert got.keys() == want.keys()
    assert all(abs(got[g] / UNIT - want[g]) < 2e-6 for g in want)


def test_query(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op2_urls(spark, SF).collect()
    assert len(rows) == len(urls)
    kinds = dict(RULES)
    for r in rows:
        host, path = parts(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule(host, path))
        if r.rule:
            assert r.verdict == kinds[r.rule]
    assert {r.verdict for r in rows if not r.rule} == {"allow", "block"}
    # the models tell rule-decided URLs apart without the rules
    mean = {v: [r.score for r in rows if r.rule and kinds[r.rule] == v] for v in ("allow", "block")}
    assert min(map(len, mean.values())) > 5
    cut = sorted(r.score for r in rows if not r.rule and r.verdict == "allow")[0]
    right = [(r.score >= cut) == (kinds[r.rule] == "allow") for r in rows if r.rule]
    assert sum(right) / len(right) > 0.9


PARTS = [
    ("HTTP://A.Example.COM/en/7#x", ("a.example.com", "/en/7", "example.com/en/7", "allow")),
    ("x://net/de/", ("net", "/de/", "net/de/", "allow")),
    ("x://notnet/de/", ("notnet", "/de/", None, None)),
    ("x://example.net/de/8?q", ("example.net", "/de/8", "example.net/de/8", "block")),
    ("a/b", ("", "", None, None)),
    ("x://h?p=/en/", ("h", "", None, None)),
    ("a://b://c/d", ("b:", "//c/d", None, None)),
    (None, ("", "", None, None)),
    ("http://example.net?r=https://x.org/de/8", ("example.net", "", None, None)),
    ("http://a.com#http://b.net/de/8", ("a.com", "", None, None)),
    ("x://a.com\n://b.net/de/8", ("a.com\n:", "//b.net/de/8", None, None)),
    ("x://É.com/en/", ("É.com", "/en/", "com/en/", "block")),
]


def test_parts(spark):
    got = {r.url: r for r in judge(spark.createDataFrame([(u, 1) for u, _ in PARTS], "url string, gram int")).collect()}
    for url, want in PARTS:
        r = got[url]
        assert (r.host, r.path, r.rule) == want[:3] and (want[3] is None or r.verdict == want[3]) and r.verdict in ("allow", "block"), url


def test_edges(spark):
    df = spark.createDataFrame([("http://a.com/en/" + "x" * 20000, 1), (None, 1), (None, 1), ("", 2)], "url string, n int")
    got = judge(df).collect()
    assert len(got) == 4 and len({r.verdict for r in got if not r.rule}) == 1
    assert judge(df.limit(0)).count() == 0
    clash = spark.createDataFrame([("http://a.com/en/", "own", 0.5, 1)], "url string, host string, score double, __0 int")
    with pytest.raises(ValueError, match="host, score"):
        judge(clash)
    assert keep_allowed(clash, rules=(("com/en/", "allow"),)).collect() == clash.collect()
    assert keep_allowed(df).count() == sum(r.verdict == "allow" for r in got) and keep_allowed(df).columns == df.columns


def test_threshold(spark):
    rows = [(-3000, "block", 1), (-1000, "block", 2), (2000, "allow", 1), (5000, "allow", 1), (9, None, 7)]
    assert -1000 < threshold(spark.createDataFrame(rows, "mean long, said string, n long")) <= 2000
    assert threshold(spark.createDataFrame(rows[:2], "mean long, said string, n long")) == 0


def test_unruled_urls_against_brute_force(spark):
    """Verdicts and scores of the models by recursion, with repeated URLs and a hot one, queries and fragments."""
    good = [f"https://s{i}.net/de/{i}?id={i * 7}" for i in range(60)]
    bad = [f"http://s{i}.org/es/buy-{i}#casino" for i in range(60)]
    other = ["https://s3.fr/de/9?id=21", "http://shop.it/es/buy-4#casino", "casino", "id=7", None, ""] + ["http://hot.it/x#casino"] * 100
    urls = good + bad + bad[:30] + other
    got = judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(3)).collect()
    assert len(got) == len(urls)
    hashes = {r.url or "": r.v for r in spark.createDataFrame([(u or "",) for u in set(urls)], "url string").selectExpr("url", "pmod(xxhash64('v', url), 5) AS v").collect()}
    a, b = (Markov([u for u in urls if u and u in kind and hashes[u]]) for kind in (good, bad))

    def mean(text):
        s = "\x02" * ORDER + text + "\x03"
        each = [round((math.log(a.p(s[i - ORDER : i], s[i])) - math.log(b.p(s[i - ORDER : i], s[i]))) * UNIT) for i in range(ORDER, len(s))]
        return int(sum(each) / len(each)) / UNIT  # towards zero

    assert all(abs(r.score - mean(r.url or "")) < 3 / UNIT for r in got)
    verdicts = {r.url or "": r.verdict for r in got if not r.rule}
    assert verdicts["https://s3.fr/de/9?id=21"] == verdicts["id=7"] == "allow" and verdicts["http://shop.it/es/buy-4#casino"] == verdicts["casino"] == verdicts["http://hot.it/x#casino"] == "block"
    # one cut parts all URLs that no rule decides
    assert max(r.score for r in got if not r.rule and r.verdict == "block") < min(r.score for r in got if not r.rule and r.verdict == "allow")
