import math
import random
import re

from paperloom.llm import urls as urls_module
from paperloom.llm.urls import RULES, judge


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def urls():
    draw = random.Random(4)
    out = [None, "", "no scheme", "http://", "https://NET/de/x", "http://EXAMPLE.com/en/7", "http://a.example.com/en/71?x#y", "http://b.example.net/de/8", "http://xnet/de/1", "ftp://é.org/es/\n2", "http://org?/es/", "x" * 20000 + "://com/en/"]
    for _ in range(600):
        host = draw.choice(["www.", "", "m."]) + draw.choice(["alpha", "beta"]) + ".example." + draw.choice(["com", "net", "org"])
        out.append(f"http://{host}/{draw.choice(['en', 'de', 'es', 'fr'])}/{draw.randrange(9000)}{draw.choice(['', '?a=b', '#top', '/', '.html'])}")
    return out


def test_parts_rules_and_ratio(spark):
    rows = [(i, u, "h", "p") for i, u in enumerate(urls())]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id bigint, url string, host string, label string")).collect()}
    assert len(got) == len(rows)
    for i, url, *_ in rows:
        host, path, rule, verdict = brute(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    # what looks like allowed urls is allowed, and the other way round
    free = [(u, got[i]) for i, u, *_ in rows if u and got[i].rule is None and got[i].host.endswith(("net", "com", "org"))]
    like = [r.acceptance for u, r in free if ".net/" in u and "/fr/" in u]
    unlike = [r.acceptance for u, r in free if ".org/" in u and "/en/" in u]
    assert sum(like) / len(like) > sum(unlike) / len(unlike)


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([(1, "http://a.b/c"), (2, None)], "page_id bigint, url string")
    assert {r.verdict for r in judge(df).collect()} == {"allow"}
    assert judge(df.limit(0)).count() == 0


def test_contexts_are_exact(spark, monkeypatch):
    """Differences are those of models over real contexts, by broadcast and by join, when contexts are many."""
    draw = random.Random(9)
    word = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789é") for _ in range(n))
    rows = [(i, f"http://{word(6)}.{draw.choice(['com/en/', 'net/de/', 'org/fr/'])}{word(24)}") for i in range(700)] + [(1000, None), (1001, ""), (1002, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    counts = ({}, {})
    for i, url in rows:
        verdict = brute(url)[3]
        if verdict:
            data = [256] * urls_module.ORDER + list(url.encode())
            for at in range(urls_module.ORDER, len(data)):
                for k in range(urls_module.ORDER + 1):
                    held = counts[verdict == "allow"].setdefault(tuple(data[at - k : at]), {})
                    held[data[at]] = held.get(data[at], 0) + 1
    assert len({c for model in counts for c in model}) > 20_000

    def log_likelihood(url, model):
        data, total = [256] * urls_module.ORDER + list(url.encode()), 0.0
        for at in range(urls_module.ORDER, len(data)):
            p = 1 / 256
            for k in range(urls_module.ORDER + 1):
                held = model.get(tuple(data[at - k : at]))
                if held:
                    p = (held.get(data[at], 0) + len(held) * p) / (sum(held.values()) + len(held))
            total += math.log(p)
        return total

    want = {i: (log_likelihood(u, counts[1]) - log_likelihood(u, counts[0])) / len(u.encode()) if u else 0.0 for i, u in rows}
    for most in (1_000_000, 0):
        monkeypatch.setattr(urls_module, "BROADCAST_GRAMS", most)
        got = judge(df).collect()
        assert len(got) == len(rows) and all(abs(r.difference - want[r.page_id]) < 1e-9 for r in got)


def test_a_class_that_lies_in_the_calibration_fold(spark):
    found = spark.range(100).selectExpr("concat('http://a.net/de/', id) url").where("pmod(xxhash64('calibration', url), 5) = 0").first().url
    rows = [(i, found) for i in range(5)] + [(10 + i, f"http://b.org/es/{i}") for i in range(20)] + [(50, "http://b.org/fs/7")]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert got[50].rule is None and got[50].difference < 0 and got[50].verdict == "block"


def test_held_out_verdicts(spark):
    """URLs whose rules are hidden from the method get the verdict that their rule would give, mostly."""
    draw = random.Random(12)
    def made(kind):
        allowed = [f"docs.{draw.choice(['alpha', 'beta'])}.net/de/guide/{draw.choice(['intro', 'setup', 'usage'])}-{draw.randrange(99)}"]
        blocked = [f"win.{draw.choice(['prize', 'casino'])}.org/es/bonus?id={draw.randrange(9999)}"]
        return draw.choice(allowed if kind else blocked)

    labelled = [(i, "http://" + made(i % 2)) for i in range(400)]
    hidden = [(1000 + i, "http://" + made(i % 2).replace(".net/de/", ".info/xx/").replace(".org/es/", ".info/xx/")) for i in range(200)]
    got = {r.page_id: r for r in judge(spark.createDataFrame(labelled + hidden, "page_id bigint, url string")).collect()}
    assert all(got[i].rule is None for i, _ in hidden)
    assert sum(got[i].verdict == ("allow" if i % 2 else "block") for i, _ in hidden) >= 190
