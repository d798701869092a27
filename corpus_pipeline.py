"""A training corpus from raw documents: language, quality, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and gives a frame that is written as Parquet and read as the next one's docs.  All
but the last return the columns of ``documents``.

    language    drops texts without letters and those whose best language has less than half of the probability
    quality     drops what importance resampling towards the well-labelled documents doesn't draw
    near_dedup  keeps the smallest doc_id of each group of near copies (five-word shingles, similarity 0.8)
    mixture     repeats or drops documents so that sources come near their target weights
    tokens      byte-level BPE ids, decoded again as a check

Edge cases, beyond those that the operators state: rows with a null doc_id are never near copies of anything, and quality,
which rejects by doc_id, keeps them; of rows that repeat a doc_id, quality rejects all or none and near_dedup keeps one; extra
columns are handed on, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pipespark.llm import bpe, langid, mixing, quality, queries, similar
from pipespark.llm.common import Workspace, id_crc, spare, table
from pipespark.scratch import scope
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of the probability that a text's language needs.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs, id_crc() % 5 != 0)
    pred, sure = spare(docs, "pred"), spare(docs, "sure")
    found = langid.identify(docs, model, pred=pred, score=sure)
    return found.filter((F.col(pred) != "und") & (F.col(sure) >= SURE)).select(*docs.columns)


def quality_draw(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    drawn = quality.resample(docs, table(spark, sf_dir, "labels"), work, evidence=quality.EVIDENCE)
    out = work.keep(drawn.filter(~F.col("selected") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "rejected")
    return similar.near_some(docs, out, "doc_id", "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    groups = work.keep(similar.similar_groups(docs, work), "groups")
    copies = work.keep(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "copies")
    left = similar.near_some(docs, copies, "doc_id", "left_anti")
    repeated = work.keep(groups.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if not repeated.limit(1).count():
        return left
    once = similar.near_some(left, repeated, "doc_id", "left_anti")
    return once.unionByName(similar.near_some(left, repeated, "doc_id").dropDuplicates(["doc_id"]))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    row, times = spare(docs, "row"), spare(docs, "times")
    # A number made at each read would depend on how the read is dealt to tasks; a row's place in its file doesn't.
    try:
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        rows = docs.select("*", place.alias(row))
    except AnalysisException:  # docs isn't read from files
        rows = work.keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    copies = mixing.mix(rows, work, key=row, mark="doc_id").filter("copies > 0").select(row, F.col("copies").alias(times))
    copies = work.keep(copies, "copies")
    small = copies.count() <= similar.BROADCAST_ROWS
    taken = rows.join(F.broadcast(copies) if small else copies, row)
    copy = spare(taken, "copy")
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = queries.tokenizer_files()
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern, whole="round_trip", keep_text=False)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality_draw),
    ("near_dedup", near_dedup),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Trained models, Gumbel noise and byte-pair merges have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark)
    for name, stage in STAGES[:-1]:
        with scope():
            docs = work.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
