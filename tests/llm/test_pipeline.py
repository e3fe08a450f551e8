import zlib

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from riskloom.llm import queries, quality
from riskloom.llm.staging import stage

from .helpers import awkward, empty
from .test_decontaminate import brute as contaminated
from .test_links import check_near
from .test_secrets import brute as found_secrets

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, function in corpus_pipeline.STAGES:
        steps.append(stage(function(spark, steps[-1], SF), "step"))
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    gone = set(rows[0]) - set(rows[1])
    known = [i for i in rows[0] if i in labels]
    assert np.mean([(i in gone) == (labels[i] == 0) for i in known]) > 0.9
    from riskloom.llm.neardup import near_duplicates
    result = near_duplicates(steps[1]).collect()
    check_near([(i, r.text) for i, r in rows[1].items()], result, 5, 80)
    assert set(rows[2]) == {r.doc_id for r in result if r.kept}
    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    assert set(rows[3]) == {i for i, r in rows[2].items() if not contaminated(r.text, bench)[1]}
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        assert (r.text == rows[3][i].text) == (not found_secrets(rows[3][i].text)) and r.n_chars == len(r.text)
    assert {r.doc_id: r.decoded_sha256 for r in rows[5].values()} == {
        i: __import__("hashlib").sha256(r.text.encode()).hexdigest() for i, r in rows[4].items()}


def test_stages_take_awkward_and_empty_tables(spark):
    for docs in (awkward(spark), empty(spark)):
        for name, function in corpus_pipeline.STAGES:
            out = stage(function(spark, docs, SF), "step")
            assert out.count() <= docs.count(), name


def test_registered_queries_cover_their_tables(spark):
    registered = queries.queries()
    assert "pipeline" in registered and sorted({int(n[2:].split("_")[0]) for n in registered if n.startswith("op")}) == list(range(1, 14))
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id"]).num_rows
    for name in ("op1_toxicity", "op10_quality"):
        rows = registered[name](spark, SF).collect()
        assert len(rows) == docs
        mod, hit = (3, 1) if name == "op1_toxicity" else (5, 0)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == hit) for r in rows)


def test_training_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    p = quality.FtrlParams(max_train=10)
    assert quality.train_quality(docs, labels, queries.id_fold(5) != 0, p=p).params.max_train == 10
