"""The corpus pipeline: quality classifier, line dedup, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet to the shared folder and reads it again as
the next one's docs. All stages but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard_join, line_dedup, packing, quality_model
from plumbline.llm.core import BROADCAST_ROWS, drop_scratch, materialize, scratch_made, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality model does not reject (score at least 0.5). It learns from labels outside the held-out third."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = quality_model.train(docs, labels, may_learn=~held_out)
    return quality_model.score(docs, model, score_col="plumbline_score").where("plumbline_score >= 0.5").select(*COLUMNS)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines are cut out; documents with nothing else go, those with a word left stay. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs).where(~F.col("emptied"))
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a Jaccard similarity of 0.8 or more over five-word shingles, one stays: that with the least doc_id, null last.

    A row is told by its doc_id and text, so of rows that repeat both one stays, and rows that repeat an id with other texts have their own fates.
    Texts without words stay."""
    d = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    groups = jaccard_join.similar_groups(d.select("row", "text"), "row")
    own = materialize(groups.where("n_shingles > 0").groupBy("row").agg(F.min("component_id").alias("component_id"), F.count("*").alias("times")), "rows")
    named = own.join(d.select("row", "doc_id").distinct(), "row")
    best = named.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "row"))["row"].alias("row")).select("row")
    best = materialize(best, "best")
    gone = materialize(own.join(best, "row", "left_anti").select("row"), "near")
    twice = materialize(own.where("times > 1").join(best, "row", "left_semi").select("row"), "twice")
    left = d.join(_small(gone), "row", "left_anti")
    if twice.isEmpty():
        return left.select(*COLUMNS)
    # partial before the exchange, so a row that is repeated very often is no burden
    once = left.join(_small(twice), "row", "left_semi").groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return left.join(_small(twice), "row", "left_anti").select(*COLUMNS).unionByName(once)


def _small(rows: DataFrame) -> DataFrame:
    """To be broadcast if there are few rows."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return decontaminate.remove_copies(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs, _tokenizer(), 1024, 2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", cut_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", pack_sequences),
]
#: The first stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote to the shared folder besides its result goes as soon as that is written, and its result when the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before = set(scratch_made())
        docs = materialize(stage(spark, docs, sf_dir), f"stage{i}")
        made = [x for x in scratch_made() if x not in before]
        drop_scratch([x for x in made[:-1] if x != shared_dir(spark)])
        if i:
            drop_scratch([last])
        last = made[-1]
    return docs
