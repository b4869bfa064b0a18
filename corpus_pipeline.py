"""From raw documents to a training mixture: languages, lines, copies, benchmarks, weights."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortis.llm import decontam, langid, line_dedup, mixing, neardup
from cohortis.session import cut

LEAST_SCORE = 0.35  # mean share that a word gives to the best language; below, a document has no recognisable language


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the languages that the labelled rows teach; texts without a letter go."""
    model = langid.train(docs.where(~langid.held_out()).select("doc_id", "text", "lang"), seed=F.col("doc_id"))
    judged = langid.predict(docs, model, lang="_lang", score="_score")
    return judged.where((F.col("_lang") != langid.NONE) & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated lines out of the texts; a document of which no line is left goes."""
    out = line_dedup.without_repeated_lines(docs)
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where("n_dropped = 0 or n_dropped < n_lines").withColumn("n_chars", length).select(*docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    gone = neardup.near_duplicates(docs.select("doc_id", "text")).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row per use of a document, with its domain, epoch and tokens."""
    return mixing.mix(docs.withColumn("domain", mixing.domain_of(F.col("source"))))


STAGES = [("language", language), ("lines", lines), ("copies", copies), ("benchmarks", benchmarks), ("weights", weights)]

# The language stage has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages, tables are written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    folder = f"{shared.rstrip('/')}/corpus-{uuid4().hex}" if shared else None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            break
        if folder:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
        else:
            docs = cut(docs)
    return docs
