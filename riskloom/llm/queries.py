"""Registered queries of the pipeline operators, each over its whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (bpe, decontaminate, neardup, negatives, pieces, quality, secrets, sharding, spans, token_files,
                          toxicity, trie, vectors)
from riskloom.llm.staging import bounded_batches

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(n: int):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.train_toxicity(docs, labels, id_fold(3) != 1)
    return toxicity.score_toxicity(docs.select("doc_id", "text"), net, 0.7).select(
        "doc_id", (id_fold(3) == 1).alias("held_out"), "score", "predicted")


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, ranks, pattern).drop("text")
    return bpe.decode(encoded, ranks, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Two increments: the second one scans what the ledger of the first lacks; findings join back to all rows.
    found = secrets.findings_by_row(history, secrets.ledger_of(secrets.halves(history)))
    return found.select(
        "doc_id", *[secrets.count_of(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.span_digest().cast("binary"), 256).alias("base_sha256"), secrets.span_digest().alias("spans"))


_ASSIGN_SQL = r"""'(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
SQL["op3_secret_ledger"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT r, 1 AS rank, 'assign' AS kind, 6 AS least, list_transform(regexp_extract_all(text, PAT, 0), lambda x: length(x)) AS n,
    list_transform(regexp_extract_all(text, PAT, 2), lambda x: length(x)) AS v,
    list_transform(string_split_regex(text, PAT), lambda x: length(x)) AS gap FROM d
  UNION ALL
  SELECT r, 2, 'access', 20, list_transform(regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), lambda x: length(x)), NULL,
    list_transform(string_split_regex(text, 'AKIA[A-Z0-9]+'), lambda x: length(x)) FROM d
  UNION ALL
  SELECT r, 3, 'hex', 24, list_transform(regexp_extract_all(text, '[0-9a-f]+', 0), lambda x: length(x)), NULL,
    list_transform(string_split_regex(text, '[0-9a-f]+'), lambda x: length(x)) FROM d),
e AS (
  SELECT r, rank, kind, least, unnest(range(1, len(n) + 1)) AS i, unnest(n) AS n, unnest(coalesce(v, n)) AS v,
    unnest(gap[1:len(n)]) AS gap FROM m),
s AS (
  SELECT r, rank, kind, v >= least AS kept, n,
    CAST(sum(gap + n) OVER (PARTITION BY r, rank ORDER BY i) AS BIGINT) AS stop FROM e),
g AS (
  SELECT r, count(*) FILTER (rank = 1) AS a, count(*) FILTER (rank = 2) AS b, count(*) FILTER (rank = 3) AS c,
    string_agg(kind || ':' || (stop - n) || ':' || stop, ',' ORDER BY stop - n, rank) AS spans FROM s WHERE kept GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
""".replace("PAT", _ASSIGN_SQL)


@query
def op4_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "text", "n_sentences", "n_removed", "removed")


@query
def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, neardup.ForestParams(shingle=3, percent=85)).select(
        "doc_id", "n_shingles", "component_id", "kept")


SQL["op6_lsh_forest"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards, folder, dictionary = token_files.write_token_files(
        table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return token_files.read_token_files(spark, shards, folder, dictionary, token_files.tokenizer(path).dtype)


@query
def op8_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.match_documents(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


SQL["op8_suffix_decontamination"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, ws[i:i + least(10, len(ws)) - 1] AS v
  FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT k FROM win),
occ AS (
  SELECT doc_id, i, k, ws[i:i + k - 1] AS v FROM w, sizes, unnest(range(1, len(ws) - k + 2)) AS t(i) WHERE len(ws) >= k),
m AS (SELECT o.doc_id, o.i, o.k, win.item_id FROM occ o JOIN win ON o.k = win.k AND o.v = win.v),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query
def op9_collision_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL["op9_collision_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
  WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train_quality(docs, labels, id_fold(5) != 0)
    return quality.score_quality(docs.select("doc_id", "text"), model, 0.3).select(
        "doc_id", (id_fold(5) == 0).alias("held_out"), "score", "predicted")


@query
def op11_agenda_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, model, decoded="decoded").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op12_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


SQL["op12_threshold_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*trie.share_heads(trie.order_turns(table(spark, sf_dir, "conversations"))))


SQL["op13_prefix_trie"] = """
WITH steps AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)),
    lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n))),
turns AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS n_bytes,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS content
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'c': content, 'n': n_bytes} ORDER BY turn NULLS FIRST, content) AS l FROM turns GROUP BY conv_id),
headed AS (SELECT conv_id, l, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(
      range(1, length(conv_id::VARCHAR) + 1), lambda i: ord((conv_id::VARCHAR)[i]))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h FROM own, steps),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS r
  FROM headed a LEFT JOIN own b ON b.conv_id = a.base),
pre AS (SELECT conv_id AS member, d, list_transform(r[1:d], lambda x: x.c) AS k, coalesce(r[d].n, 0) AS n_bytes, len(r) AS n_turns
  FROM rebuilt, unnest(range(0, len(r) + 1)) x(d)),
named AS (SELECT member, d, n_turns, n_bytes, min(member) OVER (PARTITION BY d, k) AS conv_id FROM pre),
nodes AS (SELECT conv_id, d, count(*) AS n_convs, max(n_bytes) AS n_bytes,
    string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (d = n_turns) AS ends FROM named GROUP BY conv_id, d),
up AS (SELECT n.conv_id, n.d, p.conv_id AS parent FROM nodes n JOIN named p ON p.member = n.conv_id AND p.d = n.d - 1),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM up GROUP BY ALL),
valued AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (conv_id, d)),
sums AS (SELECT p.conv_id, p.d, sum((v.n_children = 0)::INT) AS n_leaves, sum((v.n_convs - 1) * v.n_bytes) AS saved
  FROM valued v JOIN named p ON p.member = v.conv_id AND p.d <= v.d GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, up.parent AS parent_conv_id, v.n_convs, v.n_children, n_leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v JOIN sums USING (conv_id, d) LEFT JOIN up USING (conv_id, d)
"""


def queries():
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    import corpus_pipeline

    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
