"""A corpus from raw documents to token ids, in five stages.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written and read again as the next stage's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buswright.llm import common, exact_dedup, mixing, ngram_join, piece_bpe, toxicity

#: Doc_ids to drop up to this many are sent to all tasks (16 MB); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Documents that go to Python at a time: whole rows, of which some are very long.
BATCH_ROWS = 1_000


def _short_batches(spark: SparkSession) -> None:
    """Workers are kept from stage to stage, and so is the memory that their largest batch took."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic: those of a score under a half.

    Each row is judged by its text alone: rows that repeat are kept or dropped
    alike, null and empty texts and rows without doc_id are judged like others. An
    empty table stays empty; without labels nothing is dropped.
    """
    _short_batches(spark)
    tagger, name = toxicity.train(docs, common.table(spark, sf_dir, "labels")), common.fresh(docs, "toxic_score")
    return toxicity.score(docs, tagger, spans=False, name=name).where(F.col(name) < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts.

    Null, empty and blank texts are one group. The longest original text stays,
    then the smallest doc_id, then one of rows that repeat it; a row without doc_id
    stays where its group has no other.
    """
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked texts, that of the smallest doc_id.

    Rows without doc_id and texts without words link with nothing and stay. Rows
    that repeat a doc_id are documents of their own.
    """
    _short_batches(spark)
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if repeated.limit(1).count():
        return _without_near_copies_by_row(docs)
    out = common.materialise(ngram_join.linked(docs.select("doc_id", "text")).where("component_id != doc_id").select("doc_id"), "near-copies")
    return docs.join(F.broadcast(out) if out.count() <= BROADCAST_ROWS else out, "doc_id", "left_anti").select(*docs.columns)


def _without_near_copies_by_row(docs: DataFrame) -> DataFrame:
    """:func:`drop_near_copies` by numbers of rows: in a component the row of the smallest doc_id and then number stays."""
    rows = common.materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "near-rows")
    known = rows.where("doc.doc_id IS NOT NULL")
    found = ngram_join.linked(known.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")))
    found = found.select(F.col("doc_id").alias("row"), "component_id").join(known.select("row", F.col("doc.doc_id").alias("doc_id")), "row")
    found = common.materialise(found, "near-found")
    best = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    out = common.looked_up(found, best, ["component_id"], "size", found.count()).where("row != best.row").select("row")
    out = common.materialise(out, "near-copies")
    return rows.join(F.broadcast(out) if out.count() <= BROADCAST_ROWS else out, "row", "left_anti").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in training order.

    Null is a source like others. Texts without words are never taken. Rows without
    doc_id and rows that repeat one are documents like others, and reruns agree.
    """
    return mixing.training_order(docs).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and digests of them and of what they decode to: one row a row.

    Null and empty texts have no ids; rows that repeat repeat their results.
    """
    _short_batches(spark)
    return piece_bpe.encode_decode(docs, piece_bpe.model_content()).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: The stages learn and tokenize, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all of ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialise(docs, f"pipeline-{k}")
            common.release(before)
    return docs
