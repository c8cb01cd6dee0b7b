from itertools import combinations

from evidara.llm import urls

URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.org/es/x", "https://a.example.org/en/12?x#y", "https://example.org/en/2", "ftp://b.com/fr/a/b", "http://x.com/de/", "http://notorg/x", "http://xorg", "a://b://c.org/", "http://x.org", "http://x.net/fr/9#t", "http://x.net/de/9", "http://x.net/fr/9#t", "http://ü.NET/\n/p?q"]
PAGES = "page_id long, url string, host string, tokens string"


def spec(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, after = rest[:cut], rest[cut:]
    path = after[: min([after.find(c) for c in "?#" if c in after], default=len(after))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def base(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def tokens(host, path):
    return sorted({f"h:{x}" for x in host.split(".") if x} | {"p:" + (x[0] if x[0] in "0123456789" else x) for x in path.split("/") if x})


def brute(pages, support, confidence):
    rows = [(i, *spec(u)) for i, u in pages]
    known = [(tokens(h, p), base(h, p)[1]) for _, h, p in rows if base(h, p)[1]]
    counts = {}
    for t, v in known:
        for n in range(1, len(t) + 1):
            for c in combinations(t, n):
                counts.setdefault(c, {"allow": 0, "block": 0})[v] += 1
    least = -(-support * len(known) // 1)
    rules = {(c, v): (n / sum(d.values()), n / len(known)) for c, d in counts.items() for v, n in d.items() if n and n >= least and n / sum(d.values()) >= confidence}
    kept = {k: x for k, x in rules.items() if not any((c, k[1]) in rules and rules[c, k[1]][0] >= x[0] for c in combinations(k[0], len(k[0]) - 1))}
    out = []
    for i, h, p in rows:
        rule, verdict = base(h, p)
        if not verdict:
            t = set(tokens(h, p))
            hits = sorted((-x[0], -x[1], len(c), c, v) for (c, v), x in kept.items() if set(c) <= t)
            verdict = hits[0][-1] if hits else "allow"
        out.append((i, h, p, rule, verdict))
    return out


def test_against_all_combinations(spark):
    hosts = ["a.example.org", "b.com", "www.b.com", "c.net", "x.org", "spam.net", "spam.example.org"]
    pages = list(enumerate(URLS)) + [(100 + i, f"http://{hosts[i % 7]}/{('en', 'es', 'fr', 'de')[i * 5 % 4]}/{i * 37 % 300}") for i in range(160)]
    frame = spark.createDataFrame([(i, u, "h", "t") for i, u in pages], PAGES)
    got = urls.judge(frame, support=0.05, confidence=0.7).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(pages, 0.05, 0.7), key=repr)


def test_no_labelled_urls_and_empty_tables(spark):
    got = urls.judge(spark.createDataFrame([(1, "http://x.net/a", "h", "t"), (None, None, None, None)], PAGES)).collect()
    assert sorted(((r.page_id, r.verdict) for r in got), key=repr) == [(1, "allow"), (None, "allow")]
    assert urls.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_templates_of_many_constant_segments(spark):
    long = "/".join(f"part{i}" for i in range(40))
    pages = [(i, f"http://a.example.org/es/{long}/{i}") for i in range(30)] + [(100 + i, f"http://b.org/{i}") for i in range(30)]
    pages += [(200, "http://x.net/part7/z"), (201, f"http://x.net/{long}/q"), (202, "http://x.net/none")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame([(i, u, "h", "t") for i, u in pages], PAGES), support=0.1).collect()}
    assert (got[0], got[100], got[200], got[201], got[202]) == ("block", "allow", "block", "block", "allow")
