"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

1. language: documents whose language cannot be told go (no text, no letter, or
   a best language that is not 1.5 times as likely as a guess among those learned).
2. lines: boilerplate lines go, wherever they are not at their first document.
3. near_duplicates: of each group of documents linked at 0.8 on five-word
   shingles, the one with the smallest doc_id stays.
4. mixing: sources are brought to their target weights; documents come in
   training order, those read twice come twice, those not read go.
5. packing: token pieces in sequences.

Rows with equal doc_id stay or go together; rows with a null doc_id are no
near duplicates and are mixed as one document; empty tables pass through; extra
columns stay as they are, whatever their names.  SQL cannot express stage 1, so
ORACLE_SQL is None; a test runs all stages over a small table against plain Python,
given the languages that stage 1 finds.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geosluice.llm import language_id, line_dedup, mixing, ngram_join, packing
from geosluice.llm.common import fresh, scratch, table

ORACLE_SQL = None
#: The best language's mean probability must be this many times that of a guess among the languages.
LEAST_LEAD = 1.5


def _like(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, n_chars made anew."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    network = language_id.learned(docs, ~language_id.held_out())
    pred, score = fresh(docs.columns, "lang_pred", "score")
    least = LEAST_LEAD / len(network.languages) if network is not None and len(network.languages) > 1 else 0.0
    out = language_id.identify(docs, network=network)
    return out.where((F.col(pred) != language_id.UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like(line_dedup.line_dedup(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    parts = ngram_join.ngram_components(docs, k=5, percent=80)
    gone = parts.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    due, mixed_id = fresh(docs.columns, "due", "mixed_id")
    mixed = mixing.mix(docs).select(F.col("doc_id").alias(mixed_id), F.array_compact(F.array("position_1", "position_2")).alias(due))
    mixed = mixed.groupBy(mixed_id).agg(F.max(due).alias(due))
    out = docs.join(mixed, F.col("doc_id").eqNullSafe(F.col(mixed_id))).withColumn(due, F.explode(due))
    return out.repartitionByRange(due, "doc_id").sortWithinPartitions(due, "doc_id").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
