import random

import numpy as np
import xxhash

from tidelog.llm import simhash


def plain(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    rng = random.Random(1)
    for n in [*range(9), 50, 400]:
        t = rng.choice(["", "\n "]) + " \t".join(rng.choice(["Ab", "é", "cd", "ÀB", "x\x85y"]) for _ in range(n))
        assert simhash.fingerprint(t) == plain(t)
    assert simhash.fingerprint(None) == 0


def planted():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 60, dtype=np.uint64) * 2
    out = [centres]
    for c in centres[:20]:
        x = c
        for _ in range(40):
            x = x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 8), dtype=np.uint64))
            out.append(np.array([x]))
    return np.concatenate(out)


def test_links_equal_brute_force(spark, monkeypatch):
    fps = planted()
    df = spark.createDataFrame([(int(x),) for x in np.unique(fps).view("<i8")], "fp long")
    every = np.unique(fps)
    want = brute(every)
    for most, n in ((40_000, 900), (6, 900), (40_000, 1 << 27), (40_000, 1 << 40)):
        monkeypatch.setattr(simhash, "BLOCK_MOST", most)
        monkeypatch.setattr(simhash, "SMALL", 5 if most == 6 else 48)
        got = {r.node: r.root for r in simhash.components(simhash.near_links(df, n)).collect()}
        groups = {}
        for x, w in zip(every.view("<i8").tolist(), want, strict=True):
            groups.setdefault(w, set()).add(got.get(x, x))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_fields():
    assert [len(simhash.fields_for(n)) for n in (0, 10**6, 10**8, 10**9, 10**12)] == [6, 6, 7, 7, 8]
    assert all(sum(simhash.fields_for(n)) == 64 for n in (1, 1 << 27, 1 << 40))


def test_cluster_odd_rows(spark):
    rows = [(3, None, 1), (1, "", 2), (2, "A b c d e", 3), (9, "a B c d e", 4), (None, "a b c d e", 5), (5, "other words are here now", 6)]
    got = {r.doc_id: r.component_id for r in simhash.cluster(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()}
    assert got == {3: 1, 1: 1, 2: 2, 9: 2, None: 2, 5: 5}
    assert simhash.cluster(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force(spark):
    from tidelog.llm import queries

    path = "/root/testdata/sf0.01"
    docs = sorted(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect())
    fps = np.array([plain(r.text) for r in docs], dtype=np.uint64)
    ids = [r.doc_id for r in docs]
    want = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps.tolist(), brute(fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op2_simhash"](spark, path).collect()} == want
