import random

import xxhash

from tessera.llm import url_filter as U


def brute(url, rules, default="allow"):
    import re

    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans(U.UPPER, U.LOWER))
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    hits = [(len(h + p), h + p, a) for a, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(hits, default=None)
    return host, path, best[1] if best else None, best[2] if best else default


def test_against_brute_force(spark):
    rng = random.Random(1)
    urls = [None, "", "no scheme", "http://", "https://?x", "HTTP://Example.COM/en/7?q#f", "ftp://com/en/", "x://com", "http://example.net/de/812#a", "http://a.b.org/es/", "http://xcom/en/", "http://net/de"]
    urls += [f"http://{rng.choice(['', 'a.', 'WWW.'])}{rng.choice(['example.com', 'example.net', 'example.org', 'com', 'net'])}/{rng.choice(['en', 'de', 'es', 'fr'])}{rng.choice(['/', ''])}{rng.randint(0, 900)}{rng.choice(['', '?a=b', '#top'])}" for _ in range(300)]
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    want = [(i, *brute(u, U.RULES)) for i, u in enumerate(urls)]
    for limit in (U.BLOCK_BYTES, 40):  # one block, several blocks
        assert sorted(map(tuple, U.judge(frame, limit=limit).collect())) == want
    assert U.judge(frame.limit(0)).count() == 0
    assert {r.verdict for r in U.judge(frame, rules=[]).collect()} == {"allow"}


def test_colliding_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s: 7)
    (block,) = U.pack([("block", "a.b", "/x"), ("allow", "c.d", "/y")])
    d = U.Digests(block)
    got = d.find(["a.b/x", "c.d/y", "e.f/z"])
    assert [d.actions[i] if i >= 0 else None for i in got] == [1, 0, None]
