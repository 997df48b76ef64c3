"""URL rules and the propagation of trust against plain definitions."""

import random

import pytest

from lorekeep.llm import queries, urls

PAGES = "page_id long, url string, html string"
RULES = queries.RULES


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def plain_rule(host, path, rules=RULES):
    fit = []
    for verdict, rule in rules:
        h, _, q = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + q):
            fit.append((len(rule), rule, verdict))
    return max(fit)[1:] if fit else (None, None)


def link(host):
    return random.Random(host).choice(['<a href="//{}/x">', "<A class=q HREF = 'https://{}?q'>", "<a\nhref=http://{}>"]).format(host)


@pytest.mark.parametrize("seed", [1])
def test_verdicts_equal_plain_power_series(spark, seed):
    rng = random.Random(seed)
    hosts = [f"h{k}.{rng.choice(['example.com', 'a.net', 'b.org', 'www.example.com', 'org'])}" for k in range(25)]
    pages = []
    for k in range(160):
        host = rng.choice(hosts[: rng.choice([3, 25])])
        tail = rng.choice(["/en/1", "/es/2?x", "/fr/3#t", "/de/", "", "?en/"])
        targets = rng.choices(hosts, k=rng.randint(0, 4))
        pages.append((k, f"HTTP://{host.upper()}{tail}", "text".join(link(t) for t in targets) + '<a href="/own">'))
    pages += [(200, None, link(hosts[0])), (201, "no scheme", None), (202, "", ""), (203, "x://", "<a href"), pages[0], (None, pages[1][1], None)]
    parts = [plain_parts(u) for _, u, _ in pages]
    ruled = [plain_rule(*p) for p in parts]
    good, bad, out = {}, {}, {}
    for (h, _), (_, verdict) in zip(parts, ruled, strict=True):
        for mass, name in ((good, "allow"), (bad, "block")):
            mass.setdefault(h, []).append(verdict == name)
    for (h, _), (_, _, html) in zip(parts, pages, strict=True):
        for t in hosts:
            n = (html or "").count(link(t)) if h and t != h else 0
            if n:
                out[h, t] = out.get((h, t), 0) + n

    def series(mass, edges):
        now = {h: sum(v) / len(v) for h, v in mass.items() if h}
        total = dict(now)
        for _ in range(200):
            own = {}
            for (a, _), n in edges.items():
                own[a] = own.get(a, 0) + n
            then = {}
            for (a, b), n in edges.items():
                then[b] = then.get(b, 0) + 0.85 * now.get(a, 0) * n / own[a]
            now = then
            for h, m in now.items():
                total[h] = total.get(h, 0) + m
        return total

    trust, distrust = series(good, out), series(bad, {(b, a): n for (a, b), n in out.items()})
    df = spark.createDataFrame(pages, PAGES).selectExpr("*", "'clash' as Host", "7 as rule", "1 as n", "'k' as labels")
    got = urls.judge(df, urls.rule_rows(spark, RULES), tolerance=1e-2).collect()
    assert len(got) == len(pages)
    want = []
    for (k, _, _), (h, q), (rule, verdict) in zip(pages, parts, ruled, strict=True):
        t, d = trust.get(h, 0) if h else 0, distrust.get(h, 0) if h else 0
        assert abs(d - t - 0.5) > 1e-2 or verdict
        want.append((k, h, q, rule, verdict or ("block" if d - t > 0.5 else "allow")))
    assert all(abs(r.trust - trust.get(r.host, 0)) < 1e-2 and abs(r.distrust - distrust.get(r.host, 0)) < 1e-2 for r in got if r.host)
    assert sorted((r.page_id or -1, r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted((w[0] or -1, *w[1:3], w[3] or "", w[4]) for w in want)
    by_host = {r.verdict for r in got if r.rule is None}
    assert "allow" in by_host and (seed != 1 or "block" in by_host)


def test_longest_rule_and_suffixes(spark):
    rules = [("allow", "com/"), ("block", "a.com/x"), ("allow", "a.com/xy"), ("block", "dup.org/"), ("allow", "dup.org/"), ("block", "whole.net")]
    urls_ = ["http://a.com/xyz", "http://b.a.com/x", "http://ba.com/x", "http://a.com", "http://dup.org/1", "q://S.Whole.net", "http://whole.net.com/", "://com/"]
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls_)], PAGES)
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, urls.rule_rows(spark, rules)).collect()}
    assert got == {
        0: ("a.com/xy", "allow"), 1: ("a.com/x", "block"), 2: ("com/", "allow"), 3: (None, "allow"), 4: ("dup.org/", "block"),
        5: ("whole.net", "block"), 6: ("com/", "allow"), 7: ("com/", "allow"),
    }


def test_no_pages_no_rules_and_long_urls(spark):
    assert urls.judge(spark.createDataFrame([], PAGES), urls.rule_rows(spark, RULES)).count() == 0
    long = [(1, "http://" + "a." * 30_000 + "net/fr/" + "x" * 100_000, "<a " * 50_000 + "<a href='//b.org'>" * 2000), (2, "http://b.org/", None)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(long, PAGES), urls.rule_rows(spark, RULES)).collect()}
    assert got == {1: ("net/fr/", "block"), 2: (None, "allow")}
    none = urls.judge(spark.createDataFrame(long, PAGES), urls.rule_rows(spark, [])).collect()
    assert {(r.rule, r.verdict, r.trust, r.distrust) for r in none} == {(None, "allow", 0.0, 0.0)}
