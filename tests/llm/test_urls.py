"""URL rules beside plain string handling; the trees by held-out URLs."""

import math
import random
import re
from collections import Counter

import pytest

from veilwork.llm import urls
from veilwork.llm.queries import URL_RULES

KINDS = "page_id long, url string, host string, key int, u string, fold int"
RULES = [*URL_RULES, ("co.uk/", "block"), ("a.b.example.com/", "block"), ("/x", "block"), ("net:80/p", "allow")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def ruled(url, rules):
    host, path = split(url)
    fits = []
    for rule, verdict in rules:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), len(name), rule, verdict))
    return max(fits)[2:] if fits else (None, None)


CASES = [
    "http://www.example.com/en/1", "HTTP://Www.Example.COM/en/1", "http://example.com/en/", "http://example.com/en",
    "http://notexample.com/en/x", "http://x.www.example.com/en/", "http://a.b.example.com/en/", "http://net/es/",
    "http://x.net/fr/?q=/es/", "http://x.net?/es/", "http://x.net#/es/", "http://com/", "http://com", "com/x", None, "",
    "://net/es/x", "a://b://net/es/", "http:///x", "http://.com/x", "http://x.com./x", "http://u@x.net:80/p",
    "http://net:80/path", "http://ü.co.uk/é\n/x", "http://x.co.uk//?a=1&b=2&&c", "http://É.COM/" + "a" * 50_000,
    "http://" + "a." * 9_000 + "net/es/" + "b?" * 10, "no scheme here", "http://example.org/en/1",
]


def judged(spark, found, rules=RULES, **more):
    rows = [(i, u, "mine", 1, "mine", 3) for i, u in enumerate(found)]
    got = urls.judge_urls(spark.createDataFrame(rows, KINDS).repartition(3), rules, **more)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_rules_as_plain(spark):
    got = judged(spark, CASES)
    assert len(got) == len(CASES)
    for (i, host, path, rule, verdict, score), url in zip(got, CASES):
        assert ((host, path), rule) == (split(url), ruled(url, RULES)[0]), url
        assert verdict == (ruled(url, RULES)[1] or ("block" if score >= 0.5 else "allow"))


def test_features_as_plain(spark):
    df = spark.createDataFrame([(i, u, "", 1, "", 3) for i, u in enumerate(CASES)], KINDS)
    for r in urls.described(df, RULES, "page_id", "url").collect():
        url = CASES[r["key"]] or ""
        host, path = split(url)
        asked = re.match(r"[^?#]*\?([^#]*)", url.split("://", 1)[1]) if "://" in url else None
        entropy = -sum(n / len(url) * math.log2(n / len(url)) for n in Counter(url).values())
        assert r["entropy"] == pytest.approx(entropy, abs=1e-9)
        assert r["digit_ratio"] == pytest.approx(sum(c in "0123456789" for c in url) / max(len(url), 1))
        assert r["depth"] == len([p for p in path.split("/") if p])
        assert r["parameters"] == len([p for p in (asked[1] if asked else "").split("&") if p])
        assert r["hyphens"] == host.count("-")
        labels = host.split(".") if host else []
        for n in (1, 2, 3):
            assert r[f"suffix_{n}"] == (".".join(labels[-n:]) if len(labels) >= n else None)


def addresses(seed, n):
    """Half of the URLs are long, full of digits and parameters, whatever their host."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = rng.random() < 0.4
        host = rng.choice(["good.test", "other.org", "third.org"] if not bad else ["bad.test", "other.org", "third.org"])
        if bad:
            path = "".join(rng.choices("0123456789abcdef-", k=rng.randint(25, 60))) + "?" + "&".join(f"a{k}={i}{k}" for k in range(rng.randint(2, 6)))
        else:
            path = "/".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(rng.randint(1, 3))) + f"/{i}"
        out.append((f"http://{host}/{path}", bad))
    return out


def test_trees_on_held_out_hosts(spark):
    # rules label two hosts; URLs of the others are told by their look
    known = addresses(5, 900)
    rules = [("good.test/", "allow"), ("bad.test/", "block")]
    got = judged(spark, [u for u, _ in known], rules)
    rest = [(verdict == "block", bad) for (_, _, _, rule, verdict, _), (_, bad) in zip(got, known) if rule is None]
    assert len(rest) > 500
    assert sum(a == b for a, b in rest) / len(rest) > 0.97


def test_bounded_sample(spark):
    known = [u for u, _ in addresses(6, 400)]
    rules = [("good.test/", "allow"), ("bad.test/", "block")]
    df = spark.createDataFrame([(i, u, "", 1, "", 3) for i, u in enumerate(known + known)], KINDS)
    found = urls.described(df, rules, "page_id", "url")
    rows = urls.training_rows(found, urls.suffix_statistics(found), 0.4, 20).collect()
    # as many as allowed of either verdict, each URL once, none of the held-out fold
    assert sorted(r["y"] for r in rows) == [0] * 20 + [1] * 20
    assert len({r["u"] for r in rows}) == 40 and all(r["fold"] > 0 for r in rows)


@pytest.mark.parametrize("found, verdict", [
    (["http://x.org/", None], {"allow"}), (["http://x.net/es/1"] * 9 + ["http://x.org/"], {"block"}),
    ([f"http://x{i}.com/" for i in range(9)] + ["http://y.org/"], {"allow"}), ([], set()),
])
def test_one_verdict_or_none(spark, found, verdict):
    assert {r[4] for r in judged(spark, found, URL_RULES)} == verdict


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, u, "", 1, "", 3) for u in CASES], KINDS)
    plan = urls.judge_urls(df, RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_bad_rule(spark):
    with pytest.raises(ValueError):
        urls.fitting_rule([("example.com", "allow")])
    assert urls.described(spark.createDataFrame([], KINDS), [], "page_id", "url").count() == 0
