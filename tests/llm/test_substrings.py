import hashlib
import random

import pytest

from tidelog.llm import substrings


def brute(rows):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def planted():
    rng = random.Random(2)
    words = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xyz") for _ in range(n)]
    passages = [words(n) for n in (49, 50, 51, 70, 130)]
    rows = [(0, None), (1, ""), (2, "x " * 300), (3, "y x " * 100 + "x " * 60), (None, "x " * 99), (3, "y x " * 100 + "x " * 60)]
    for d in range(10, 70):
        w = words(rng.randint(0, 90))
        for p in rng.sample(passages, rng.randint(0, 3)):
            w += p + words(rng.randint(0, 40))
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(100 + i, rows[12 + i][1]) for i in range(5)] + [(7, rows[14][1])]
    return rows


@pytest.mark.parametrize("most, step, ids", [(60_000, 400_000, 2_000_000), (150, 500, 0), (1, 500, 2_000_000)])
def test_planted(spark, monkeypatch, most, step, ids):
    from tidelog.llm import queries

    for name, value in (("GROUP_WORDS", most), ("STEP", step), ("IDS_MOST", ids)):
        monkeypatch.setattr(substrings, name, value)
    rows = planted()
    got = queries.substring_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows)


def test_nodes_equal_brute_force():
    rng = random.Random(6)
    base = [rng.choice("ab").encode() for _ in range(200)]
    lists = [base[i : i + n] for i, n in ((0, 92), (10, 60), (10, 90), (150, 50), (0, 49))] + [[b"x"] * 70, [b"x"] * 55, [b"y"] + [b"x"] * 64]
    segment, place, node, depth, _ = substrings.suffix_nodes(lists)
    suffixes = [lists[s][p:] for s, p in zip(segment.tolist(), place.tolist(), strict=True)]
    every = [w[i:] for w in lists for i in range(len(w) - 49)]
    assert sorted(suffixes) == sorted(every) and suffixes == sorted(suffixes, key=lambda w: [substring_code(lists, x) for x in w])
    groups = {}
    for w, n in zip(suffixes, node.tolist(), strict=True):
        groups.setdefault(n, []).append(w)
    assert len({tuple(g[0][:50]) for g in groups.values()}) == len(groups)
    for n, g in groups.items():
        assert len({tuple(w[:50]) for w in g}) == 1
        assert depth[n] == next((i for i in range(92) if any(i >= len(w) for w in g) or len({w[i] for w in g}) > 1), 92)


def substring_code(lists, word):
    """Words count in the order of their first use, as the suffixes are sorted."""
    return list(dict.fromkeys(x for w in lists for x in w)).index(word)


@pytest.mark.parametrize("most", [200_000, 150, 1])
def test_repeats_are_shared_and_cover_what_is_removed(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "GROUP_WORDS", most)
    rows = planted()
    docs = {}
    for d, t in rows:
        if d is not None:
            docs.setdefault(tuple((t or "").split()), []).append(d)
    texts = {min(ids): w for w, ids in docs.items()}  # of equal texts the first
    found = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {d: [False] * len(w) for d, w in texts.items()}
    for r in found:
        words = tuple(r.words.split(" "))
        holders = []
        assert len(words) == r.n_words >= 50
        for d, w in texts.items():
            at = [i for i in range(len(w) - len(words) + 1) if w[i : i + len(words)] == words]
            holders += [d] if at else []
            for i in at if d > r.least else ():
                covered[d][i : i + len(words)] = [True] * len(words)
        assert {r.least, r.most} <= set(holders) and r.least < r.most
    removed = {d: n for d, _, n, _ in brute([(d, " ".join(w)) for d, w in texts.items()])}
    if most > 1:  # whole windows need no left neighbour to be told
        assert {n for n in (r.n_words for r in found)} - {50}
    assert {d: sum(c) for d, c in covered.items()} == removed


def test_empty(spark):
    from tidelog.llm import queries

    assert queries.substring_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    from tidelog.llm import queries

    path = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = queries.QUERIES["op5_substrings"](spark, path).collect()
    want = brute(rows)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == want
    assert sum(x[2] for x in want)
