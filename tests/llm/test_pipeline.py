import corpus_pipeline
from tidelog.llm import pii

PATH = "/root/testdata/sf0.001"


def test_stages_follow_plain_decisions(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, PATH))
        assert out.columns == corpus_pipeline.COLUMNS
        kept.append({r.doc_id for r in out.collect()})
        docs = out
    assert kept[0] >= kept[1] >= kept[2] == kept[3]
    for r in docs.collect():
        assert r.text == pii.redacted(text[r.doc_id], pii.spans(text[r.doc_id]))
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, PATH).collect()} == kept[3]


def written(spark, path, docs, benchmark):
    docs.write.parquet(f"{path}/documents.parquet")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    return sorted(map(tuple, corpus_pipeline.run(spark, str(path)).collect()), key=repr)


def test_extra_columns_change_nothing(spark, tmp_path):
    source = spark.read.parquet(f"{PATH}/documents.parquet")
    benchmark = spark.read.parquet(f"{PATH}/benchmark.parquet")
    few = source.where("doc_id < 60").unionByName(source.limit(1).selectExpr("cast(null AS bigint) AS doc_id", "cast(null AS string) AS text", "cast(null AS string) AS lang", "cast(null AS string) AS source", "cast(null AS bigint) AS n_chars"))
    plain = written(spark, tmp_path / "plain", few, benchmark)
    names = ["row_id", "key", "fp", "words", "pii_spans", "redacted", "token_ids", "n_tokens", "decoded", "text_language", "_metadata"]
    more = few.selectExpr("*", *[f"'x' AS {n}" for n in names])
    assert plain and written(spark, tmp_path / "more", more, benchmark.selectExpr("*", "1 AS k", "2 AS own")) == plain


def test_empty_tables(spark, tmp_path):
    source, benchmark = spark.read.parquet(f"{PATH}/documents.parquet"), spark.read.parquet(f"{PATH}/benchmark.parquet")
    assert written(spark, tmp_path / "none", source.limit(0), benchmark) == []
    few = source.where("doc_id < 20")
    assert written(spark, tmp_path / "no_items", few, benchmark.limit(0))


def test_what_stages_store_is_deleted(spark, tmp_path):
    import glob

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/tidelog-*"))
    source, benchmark = spark.read.parquet(f"{PATH}/documents.parquet"), spark.read.parquet(f"{PATH}/benchmark.parquet")
    assert written(spark, tmp_path / "t", source.where("doc_id < 20"), benchmark)
    assert len(set(glob.glob(f"{folder}/tidelog-*")) - before) == 1  # what the last stage reads


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    import types

    import pytest
    from tidelog.llm import common

    def fake(master):
        return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None, set=lambda *_: None), sparkContext=types.SimpleNamespace(master=master))

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            common.shared_dir(fake(master))
    assert common.shared_dir(fake("local[4]"))
