import random

import numpy as np

from tidelog.llm import components as c


def plain(edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


def cases():
    rng = random.Random(4)
    path = [*range(-60, 60)]
    rng.shuffle(path)
    yield [*zip(path, path[1:], strict=False)]
    yield [(1 << 62, i) for i in range(80)] + [(-(1 << 63), 79), (5, 5), (900, 900)]
    yield [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    yield [(7, 7)]
    yield []


def test_a_short_list_needs_no_rounds(spark):
    for i, edges in enumerate(cases()):
        want = plain(edges)
        frame = spark.createDataFrame(edges, "a long, b long").repartition(3)
        spark.sparkContext.setJobGroup(f"components-{i}", "")
        found = c.components(frame)
        short = {r.node: r.root for r in found.collect()}
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{i}")
        spark.sparkContext.setJobGroup("none", "")
        assert short == want and found.count() == len(want)
        assert len(jobs) <= 5  # the list, its count and the roots; a round of contraction is eight shuffles or so
    for edges in [*cases()][:3]:
        assert {r.node: r.root for r in c.components(spark.createDataFrame(edges, "a long, b long"), few=10).collect()} == plain(edges)


def test_roots_of_many_edges():
    rng = np.random.default_rng(3)
    u = rng.permutation(100_000).astype(np.int64)
    node, root = c.roots(np.r_[u[:-1], u[::7]], np.r_[u[1:], u[::-7]])
    assert len(node) == 100_000 and not root.any()
