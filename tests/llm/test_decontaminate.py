import random
import re
from collections import Counter

import pytest

from tidelog.llm import decontaminate


def plain(text, k=None):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = k or min(5, len(w))
    return w, [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if k else []


def brute(docs, items, least=0.8):
    out = {}
    for j, t in items:
        w, s = plain(t)
        if not w:
            continue
        known, k = Counter(s), min(5, len(w))
        for d, text in docs:
            _, own = plain(text, k)
            if not set(own) & set(known):
                continue
            width = min(len(s), len(own))
            for start in range(len(own) - width + 1):
                win = Counter(own[start : start + width])
                both = sum((win & known).values())
                sim = both / (len(s) + width - both)
                if sim >= least and sim > out.get((d, j), (0,))[0]:
                    out[d, j] = (sim, start)
    return out


def compare(spark, docs, items):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.matches(a, b).collect()
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in rows}
    assert len(rows) == len(got)
    assert got == {k: (round(s, 9), n) for k, (s, n) in brute(docs, items).items()}
    return got


@pytest.mark.parametrize("bits, broadcast", [(None, None), (0, 0), (1 << 12, 0)])
def test_planted_and_odd(spark, monkeypatch, bits, broadcast):
    if bits is not None:
        monkeypatch.setattr(decontaminate, "GATE_BITS", bits)
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 15, 15, 20, 40, 5, 60])] + [(90, ""), (91, None), (92, "x x x x x x x x x x x x x x x")]
    docs = [(0, None), (1, ""), (2, "one two"), (3, "x " * 400)]
    for i, t in items[:7]:
        w = t.split()
        for n in range(6):
            c = list(w)
            for _ in range(n // 2):
                c[rng.randrange(len(c))] = word()
            if n == 5:
                c = c[1:] + [word()]
            docs.append((100 + 10 * i + n, " ".join([word() for _ in range(rng.randint(0, 80))] + [x.upper() if n % 2 else x for x in c] + [word() for _ in range(rng.randint(0, 80))])))
    docs += [docs[-1], (500, items[6][1].rsplit(" ", 6)[0]), (None, items[2][1])]
    items += [items[3], (items[3][0], items[4][1]), (None, items[2][1])]
    assert len(compare(spark, docs, items)) > 15
    assert compare(spark, [], items) == {} and compare(spark, docs, []) == {}


def test_query(spark):
    from tidelog.llm import queries

    path = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in queries.QUERIES["op9_decontamination"](spark, path).collect()}
    assert got == {k: round(s, 9) for k, (s, _) in brute(docs, items).items()} and got
