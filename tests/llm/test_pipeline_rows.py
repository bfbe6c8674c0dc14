"""The stages that drop rows, against plain versions that judge row by row."""

from collections import Counter

import corpus_pipeline
import numpy as np
from tidelog.llm import language

from .test_decontaminate import brute as leaks
from .test_simhash import brute as groups
from .test_simhash import plain

PATH = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def counted(rows):
    return Counter((r[0], r[1]) for r in rows)


def known_language(spark, rows):
    model = language.learn(spark.createDataFrame(rows, SCHEMA))
    by_place = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], SCHEMA)
    return [rows[r.doc_id] for r in language.identify(by_place, model).where("kept").collect()]


def one_of_each_group(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    names = groups(np.array([plain(r[1]) for r in rows], dtype=np.uint64))
    return [r for i, r in enumerate(rows) if names[i] == i]


def without_leaks(rows, items):
    found = {i for i, _ in leaks([(i, r[1]) for i, r in enumerate(rows)], items)}
    return [r for i, r in enumerate(rows) if i not in found]


def follow(spark, rows):
    """Runs the first three stages, each on what the one before kept, and returns what each had and kept."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
    plain_stages = [lambda x: known_language(spark, x), one_of_each_group, lambda x: without_leaks(x, items)]
    docs, steps = spark.createDataFrame(rows, SCHEMA), []
    for (name, stage), expected in zip(corpus_pipeline.STAGES, plain_stages, strict=False):
        docs = corpus_pipeline.stored(stage(spark, docs, PATH))
        assert docs.columns == corpus_pipeline.COLUMNS
        got = [tuple(r) for r in docs.collect()]
        assert counted(got) == counted(expected(rows)), name
        steps.append((counted(rows), counted(got)))
        rows = got
    return steps


def test_null_and_repeated_ids(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{PATH}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    item = max((r.text for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()), key=len)
    lone = [f"{w} " + " ".join(f"{w}{i}the" for i in range(40)) for w in ("quiet", "harbour", "lantern")]
    made = lambda i, text: (i, text, "en", "made", len(text))
    rows += [made(None, "12 34 !!"), made(9001, "56 78 !!"), made(9001, lone[0])]
    rows += [made(9002, lone[1])] * 3 + [made(None, lone[1])] + [made(None, lone[2])] * 2
    rows += [made(None, item), made(9001, item)]
    first, second, third = follow(spark, rows)
    assert not {(None, "12 34 !!"), (9001, "56 78 !!")} & set(first[1]) and first[1][9001, lone[0]] == 1
    assert second[0][9002, lone[1]] == 3 and second[1][9002, lone[1]] == 1 and second[1][None, lone[1]] == 0 and second[1][None, lone[2]] == 1
    assert not {(None, item), (9001, item)} & set(third[1]) and third[1][9001, lone[0]] == 1


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    steps = follow(spark, [tuple(r) for r in docs.collect()])
    assert all(steps[i][1] < steps[i][0] for i in (1, 2)) and steps[2][1]
