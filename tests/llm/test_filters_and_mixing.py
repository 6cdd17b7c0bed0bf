import re
from collections import defaultdict

from pangrove.llm.mixing import mix_sources
from pangrove.llm.queries import RULES
from pangrove.llm.url_filters import judge_urls

URLS = [
    None, "", "no scheme", "http://", "http://com/en/1", "HTTP://WWW.Example.COM/en/71?x=/en/7", "https://a.b.example.com/en/6#z", "https://example.com/en/7",
    "https://notexample.com/en/7", "https://net/de/8", "https://x.example.net/de/81", "https://example.net/DE/8", "https://org?/es/", "https://a.org/es/#", "http://org./es/1",
    "http://.com/en/", "http://com\x01x/en/", "x://y://z.com/en/", "http://a.com:80/en/", "https://x.org/es/1",
]


def brute(url, rules=RULES):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_urls(spark):
    rows = [(k if k % 5 else None, u, "x", 1) for k, u in enumerate(URLS * 3 + ["https://hot.example.com/en/7"] * 300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, key int")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = sorted((str(r.page_id), *map(str, (r.host, r.path, r.rule, r.verdict))) for r in judge_urls(pages, rules).collect())
    assert got == sorted((str(i), *map(str, brute(u))) for i, u, _, _ in rows)
    assert judge_urls(pages, rules.limit(0)).where("rule is not null or verdict <> 'allow'").count() == 0
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_nested_rules(spark):
    rules = [("com", "", "block"), ("b.com", "/x", "allow"), ("a.b.com", "/x/y", "block"), ("a.b.com", "/x/z", "allow"), ("c.com", "/", "allow")]
    urls = [f"http://{h}{p}" for h in ("com", "b.com", "a.b.com", "z.a.b.com", "bb.com", "c.com", "d.c.com", "org") for p in ("", "/", "/x", "/x/y", "/x/zz", "/w")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    assert got == {k: brute(u, rules) for k, u in enumerate(urls)}


def test_mix(spark):
    rows = [(d, f"s{d % 4}" if d % 4 < 3 else None, "w " * (d * 37 % 50 + 1)) for d in range(400)]
    rows += [(1000 + d, "big", "a b\tc\nd") for d in range(3000)] + [(5000, "none", None), (5001, "none", ""), (None, "s1", "x y"), (7, "s3", "q"), (7, "s3", "q")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, source string, text string, size int, at int")
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own = defaultdict(int)
    for _, s, t in rows:
        own[s] += size(t)
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, targets = set(), {}
    while True:  # share the excess again until none is above
        left = sum(own.values()) - sum(3 * own[s] for s in full)
        level = left / sum(weight[s] for s in order if s not in full)
        targets = {s: 3 * own[s] if s in full else level * weight[s] for s in order}
        over = {s for s in order if targets[s] > 3 * own[s]}
        if not over:
            break
        full |= over
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == own[r.source] and abs(r.target - targets[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - targets[s]) <= 2 * largest[s] for s in order)
    key = lambda rows: sorted(map(str, rows))
    assert key(mix_sources(docs.repartition(3)).collect()) == key(got)
    assert mix_sources(docs.limit(0)).count() == 0
