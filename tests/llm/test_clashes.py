"""Own columns that are named like the operators' inner ones come back as they were; a lost file is an error."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, neardup, secrets, token_files
from riskloom.llm.staging import set_aside

from .helpers import awkward

NAMES = ["findings", "_blob", "_f", "blob", "part", "n_words", "items", "n_hit", "hit_spans", "longest_words", "longest_item", "longest_at",
         "_key", "_copies", "_doc_id", "_text_key", "node", "signature", "component_id", "kept", "root", "text_key", "_score", "_accepted", "SCORE"]
SF = "/root/testdata/sf0.001"
STAGES = {
    "redact": lambda spark, docs: secrets.redact(docs),
    "drop_contaminated": lambda spark, docs: decontaminate.drop_contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")),
    "drop_near_duplicates": lambda spark, docs: neardup.drop_near_duplicates(docs),
    "keep_quality": lambda spark, docs: corpus_pipeline.keep_quality(spark, docs, SF),
}


@pytest.mark.parametrize("name", STAGES)
def test_clashing_columns_come_back(spark, name):
    docs = awkward(spark).where("length(text) < 5000 or text is null")
    plain = STAGES[name](spark, docs)
    more = docs
    for c in NAMES:
        more = more.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    got = STAGES[name](spark, more)
    assert got.columns == more.columns
    rows = got.collect()
    assert sorted(map(str, (tuple(r[c] for c in docs.columns) for r in rows))) == sorted(map(str, map(tuple, plain.collect())))
    for r in rows:
        assert all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for c in NAMES)


def test_set_aside_restores_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, `a_` int, B int")
    inner, own = set_aside(df, ["A", "b"])
    assert not {"a", "b"} & {c.lower() for c in inner.columns}
    assert inner.select(own).columns == ["a", "a_", "B"] and tuple(inner.select(own).head()) == (1, 2, 3)


def test_a_missing_shard_is_an_error(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, "some words of a text " * 20) for i in range(40)], "doc_id bigint, text string")
    shards, folder, dictionary = token_files.write_token_files(docs, path)
    assert "://" in folder
    more = shards.unionByName(spark.createDataFrame([("shard-000099-000000.tokens", 1, 5)], "shard string, docs bigint, tokens bigint"))
    with pytest.raises(FileNotFoundError, match="shard-000099"):
        token_files.read_token_files(spark, more, folder, dictionary, token_files.tokenizer(path).dtype)
