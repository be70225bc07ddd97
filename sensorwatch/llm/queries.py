"""Registered queries of the text operators and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorwatch.llm import bpe as BP
from sensorwatch.llm import common as C
from sensorwatch.llm import hamming as HM
from sensorwatch.llm import hnsw as HN
from sensorwatch.llm import mixing as MX
from sensorwatch.llm import neardup as ND
from sensorwatch.llm import negatives as NG
from sensorwatch.llm import prefix_trie as PT
from sensorwatch.llm import quality as QU
from sensorwatch.llm import secrets as SE
from sensorwatch.llm import sharding as SH
from sensorwatch.llm import spotsigs as SP
from sensorwatch.llm import toxicity as TX
from sensorwatch.llm import wrapper as WR

Query = Callable[[SparkSession, str], DataFrame]


def remainder(modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def op1_spot_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return SP.edited_fingerprints(C.table(spark, d, "documents"))


def op2_multi_index_hamming(spark: SparkSession, d: str) -> DataFrame:
    return HM.nearest(C.table(spark, d, "embeddings"), F.col("id") % 20 == 0, k=10)


OP2_SQL = r"""
WITH c AS (SELECT vec_id, [x > 0 FOR x IN embedding] AS b FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
p AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, list_sum([(q.b[i] <> r.b[i])::INT FOR i IN range(1, len(q.b) + 1)])::INT AS distance
      FROM c q JOIN c r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id AND len(q.b) = len(r.b)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM k WHERE rank <= 10
"""


def op3_convolutional_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = C.table(spark, d, "documents").select("doc_id", "text")
    model = TX.fit(docs, C.table(spark, d, "labels"), remainder(5) != 0)
    rows = TX.scored(docs, model)
    return rows.select("doc_id", (remainder(5) == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "language")


def op4_wrapper_main_text(spark: SparkSession, d: str) -> DataFrame:
    return WR.page_texts(C.table(spark, d, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_weighted_fair_mix(spark: SparkSession, d: str) -> DataFrame:
    rows = MX.mixed(C.table(spark, d, "documents"), weights=(3, 1, 2), share=1.5, repeats=2)
    return rows.select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH r AS (
  SELECT doc_id, md5('mix:' || CASE WHEN doc_id IS NULL THEN '' ELSE doc_id::VARCHAR || ':' END || md5(coalesce(text, ''))) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s FROM documents),
g AS (SELECT s, sum(size)::BIGINT AS source_size FROM r GROUP BY s),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::INT] AS w, sum(source_size) OVER () * 1.5 AS b FROM g),
l AS (SELECT *, (2 * source_size)::DOUBLE / w AS level, (2 * source_size)::DOUBLE AS cap FROM w),
o AS (SELECT *, (b - coalesce(sum(cap) OVER (ORDER BY level, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY level, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS own FROM l),
t AS (SELECT s, source_size, least(w * (SELECT coalesce(max(own) FILTER (WHERE own <= level), 0) FROM o), cap) AS target FROM o),
q AS (SELECT doc_id, k, s, size, source_size, target,
             sum(size) OVER (PARTITION BY s ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS served,
             row_number() OVER () AS id FROM r JOIN t USING (s)),
p AS (SELECT *, (source_size * turn + served)::DOUBLE / target AS f FROM q, (VALUES (0), (1)) v(turn) WHERE target > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY f, s, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p),
m AS (SELECT id, sum(size)::BIGINT AS taken FROM c WHERE upto <= (SELECT sum(target) FROM t) GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN m USING (id)
"""


def op8_secret_ownership(spark: SparkSession, d: str) -> DataFrame:
    rows = SE.secrets(C.table(spark, d, "documents"))
    one = lambda f: F.concat_ws(":", f["name"], f["start"], f["end"])
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.concat_ws(",", F.transform("found", one)).alias("spans"),
        F.size(F.filter("found", lambda f: f["live"])).alias("n_live"), F.size(F.filter("found", lambda f: ~f["live"])).alias("n_copied"),
    )


def op9_external_shuffle(spark: SparkSession, d: str) -> DataFrame:
    shuffled = SH.external_shuffle(C.table(spark, d, "documents"))
    text = F.coalesce(F.col("document.text"), F.lit(""))
    rows = shuffled.select(F.col("document.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "bucket", "place")
    rows = SH.dealt(rows, 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_bpe_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = BP.tokenised(C.table(spark, d, "documents").select("doc_id", "text"), vocabulary())
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_additive_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = C.table(spark, d, "documents").select("doc_id", "text")
    model = QU.fit(docs, C.table(spark, d, "labels"), remainder(4) != 2)
    rows = QU.scored(docs, model)
    return rows.select("doc_id", (remainder(4) == 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op7_chosen_path_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = ND.near_duplicates(C.table(spark, d, "documents"), ND.NearDup(shingle=2, percent=80))
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
         ELSE [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
hit AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM hit JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(x, y) AS (SELECT x, y FROM edge UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(m.y, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY 1) m ON m.x = d.doc_id
"""



def rebuilt(seqs: DataFrame, others: int = 5, turns: int = 9) -> DataFrame:
    """Every conversation c with the first crc32(c) % ``turns`` turns of conversation c - c % ``others`` in place of its own."""
    heads = seqs.where(F.col("conv_id") % others == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, turns - 1).alias("head"))
    own = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % others).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % turns).cast("int"))
    rows = own.join(heads, "base", "left")
    head = F.coalesce("head", F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(F.slice(head, F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def op11_burst_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return PT.trie(rebuilt(PT.sequences(C.table(spark, d, "conversations"))))


OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
crc(conv_id, i, bits, value) AS (
  SELECT DISTINCT conv_id, 1, 8, xor(4294967295::BIGINT, ascii(substr(conv_id::VARCHAR, 1, 1))::BIGINT) FROM t
  UNION ALL
  SELECT conv_id, CASE WHEN bits = 0 THEN i + 1 ELSE i END, CASE WHEN bits = 0 THEN 8 ELSE bits - 1 END,
         CASE WHEN bits = 0 THEN xor(value, ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT) WHEN value % 2 = 1 THEN xor(value // 2, 3988292384::BIGINT) ELSE value // 2 END
  FROM crc WHERE bits > 0 OR i < length(conv_id::VARCHAR)),
h AS (SELECT conv_id, xor(value, 4294967295::BIGINT) % 9 AS h FROM crc WHERE bits = 0 AND i = length(conv_id::VARCHAR)),
r AS (
  SELECT h.conv_id, b.p, b.role, b.text, 0 AS own FROM h JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5 AND b.p <= h.h
  UNION ALL SELECT h.conv_id, t.p, t.role, t.text, 1 FROM h JOIN t ON t.conv_id = h.conv_id AND t.p > h.h),
s AS (
  SELECT conv_id, d, chain, size FROM (
    SELECT conv_id, row_number() OVER w AS d, list({'r': role, 't': text}) OVER w AS chain, strlen(text) AS size FROM r
    WINDOW w AS (PARTITION BY conv_id ORDER BY own, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  UNION ALL SELECT conv_id, 0, [], 0 FROM h),
m AS (SELECT s.*, d = max(d) OVER (PARTITION BY conv_id) AS last FROM s),
n AS (
  SELECT chain, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM m GROUP BY chain),
c AS (SELECT n.*, p.conv_id AS parent_conv_id, p.chain AS up FROM n LEFT JOIN n p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.chain = n.chain[1:n.depth - 1]),
k AS (SELECT chain, (SELECT count(*) FROM c x WHERE x.up = n.chain) AS n_children FROM n),
sub AS (SELECT a.chain, sum(b.own)::BIGINT AS saved_tokens, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves
        FROM n a JOIN n b ON b.depth >= a.depth AND b.chain[1:a.depth] = a.chain JOIN k ON k.chain = b.chain GROUP BY a.chain)
SELECT c.conv_id, c.depth::BIGINT AS depth, c.parent_conv_id, c.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children, sub.n_leaves::BIGINT AS n_leaves, sub.saved_tokens, c.ends_sha256
FROM c JOIN k USING (chain) JOIN sub USING (chain)
"""


def op12_strassen_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = C.table(spark, d, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return NG.hard_negatives(rows.withColumn("label", label), F.col("id") % 50 == 0, NG.Mining(positives=5, negatives=3, low=50, high=95, scale=256))


OP12_SQL = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
g AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM g JOIN p USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""


def op13_sharded_hnsw(spark: SparkSession, d: str) -> DataFrame:
    return HN.nearest(C.table(spark, d, "embeddings"), F.col("id") % 50 == 0, k=5)


QUERIES: dict[str, Query] = {
    "op1_spot_fingerprints": op1_spot_fingerprints,
    "op2_multi_index_hamming": op2_multi_index_hamming,
    "op3_convolutional_toxicity": op3_convolutional_toxicity,
    "op4_wrapper_main_text": op4_wrapper_main_text,
    "op5_weighted_fair_mix": op5_weighted_fair_mix,
    "op6_additive_quality": op6_additive_quality,
    "op8_secret_ownership": op8_secret_ownership,
    "op9_external_shuffle": op9_external_shuffle,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op7_chosen_path_near_duplicates": op7_chosen_path_near_duplicates,
    "op11_burst_prefix_trie": op11_burst_prefix_trie,
    "op12_strassen_hard_negatives": op12_strassen_hard_negatives,
    "op13_sharded_hnsw": op13_sharded_hnsw,
}
CHECKS: dict[str, str] = {
    "op2_multi_index_hamming": OP2_SQL, "op5_weighted_fair_mix": OP5_SQL, "op7_chosen_path_near_duplicates": OP7_SQL,
    "op11_burst_prefix_trie": OP11_SQL, "op12_strassen_hard_negatives": OP12_SQL,
}
