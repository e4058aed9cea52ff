"""One named query per operator of this subpackage, with SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import byte_bpe, conversation_repair, html_extract, language_id, packing, spelling, token_store, toxicity
from gradeloom.llm.embedding_dedup import near_vectors
from gradeloom.llm.exact_dedup import exact_groups
from gradeloom.llm.minhash_dedup import near_groups
from gradeloom.llm.sharding import assign_shards, numbered
from gradeloom.llm.substring_dedup import repeats
from gradeloom.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``folds``."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(fold(4) != 2))
    out = language_id.identify(docs, model)
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@query("op2_minhash_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), size=4, percent=80)


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold(5) != 0).select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    out = toxicity.score_ids(docs, model)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_exact_dedup", """
WITH rows AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), groups AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY norm)
SELECT r.doc_id, g.keep_id, g.group_size, r.doc_id = g.keep_id AS kept, r.text_sha256
FROM rows r JOIN groups g ON r.norm = g.norm
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


@query("op6_html_extract")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


@query("op8_token_store")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-store")
    token_store.write_tokens(table(spark, sf_dir, "documents"), folder)
    return token_store.read_tokens(spark, folder)


@query("op9_embedding_dedup", """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reached(node, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       (SELECT min(other) FROM reached r WHERE r.node = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(other) FROM reached r WHERE r.node = e.vec_id) AS kept
FROM embeddings e
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.byte_bpe(table(spark, sf_dir, "documents"), with_ids=False)


@query("op11_sharding")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = {i: 1.0 for i in range(24)}
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("key").alias("law"))
    return numbered(assign_shards(assign_shards(rows, shards), {**shards, 24: 1.0}, out="grown_shard"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.conversation_digests(turns, conversation_repair.damaged(turns))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Errors only shorten a run, so shorter runs make no word of seven letters.
    runs = spelling.word_runs(table(spark, sf_dir, "documents"), least=7)
    return spelling.variants(spelling.vocabulary(spelling.misspelt(runs), least_length=7, least_n=2), factor=10)
