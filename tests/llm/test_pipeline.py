import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from mergeloom.llm import decontamination, toxicity  # noqa: E402

from .test_jaccard import brute, shingle_set  # noqa: E402
from .test_packing import verify  # noqa: E402
from .test_pii import base  # noqa: E402


def test_stages(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    from mergeloom.llm import packing

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        new = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, new)
        if name != "best_fit_packing":
            assert new.columns == columns
        docs = new
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    a, b = seen["toxicity"]
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(a, marks).collect()}
    assert ids(b) == {k for k, v in scores.items() if not v}
    a, b = seen["ngram_jaccard_join"]
    assert ids(b) == {c for _, _, c in brute([(r.doc_id, r.text) for r in a.collect()])} and b.count() == len(ids(b))
    a, b = seen["benchmark_decontamination"]
    assert ids(a) - ids(b) == ids(decontamination.decontaminate(a, spark.read.parquet(f"{sf}/benchmark.parquet")))
    a, b = seen["personal_data"]
    before, after = ({r.doc_id: r for r in x.collect()} for x in (a, b))
    assert set(before) == set(after) and all(not base(r.text)[0] and r.n_chars == len(r.text) for r in after.values())
    assert all(after[k].text == before[k].text for k in before if not base(before[k].text)[0])
    a, b = seen["best_fit_packing"]
    verify(b.collect(), {r.doc_id: r.text for r in a.collect()}, Tokenizer.from_file(packing.vocabulary()), 1024)
    assert all(shingle_set(r.text) for r in a.collect())


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and "sequence_id" in got.columns


def test_odd(spark, odd, tmp_path, sf):
    df = odd
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
    assert {r.doc_id for r in df.collect()} >= {0, 1, 2, 3}  # texts without words, and short ones, reach the sequences


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_nothing_and_clashing_names(spark, odd, empty, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, empty, sf).count() == 0
    names = {"toxicity": {"node": "offending", "rank": "toxic"}, "ngram_jaccard_join": {"node": "keeps", "rank": "shingle_set"}, "benchmark_decontamination": {"node": "text_key0", "rank": "k1"}}
    strange = odd.withColumnsRenamed(names.get(name, {"node": "spans", "rank": "piece"}))
    got = stage(spark, strange, sf)
    if name == "best_fit_packing":
        assert sorted(str(r.doc_id) for r in got.where("piece = 0").collect()) == sorted(str(r.doc_id) for r in odd.collect())
        return
    rows = got.collect()
    assert got.columns == strange.columns and {0, 1, 2} <= {r.doc_id for r in rows}
    assert all(r.text is None for r in rows if r.doc_id == 0)
    if name in ("toxicity", "benchmark_decontamination", "personal_data"):
        assert len(rows) == odd.count()  # nothing toxic, no item, and none is dropped
