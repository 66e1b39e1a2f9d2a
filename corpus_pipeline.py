"""Corpus pipeline: clean documents, then pack them into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each
result as Parquet to the shared folder and reads it again. All stages but the last return documents
with all their columns.

1. toxicity: documents that the classifier flags go (op 4; fitted on labels outside the held-out fold,
   thresholds by language).
2. language ID: documents without an identified language go (op 9): no letter at all, or no language
   that costs clearly less than the others together (score below ``SURE``).
3. SimHash near-dedup: of each group of near duplicates the document with the smallest id stays (op 1).
4. best-fit packing: pieces of the remaining documents in sequences of 1024 tokens (op 5).

Trained models and tokenizers have no SQL form, so there is no oracle; the run is tested against
brute-force versions of its stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import langid, packing, query_langid, query_packing, query_toxicity, simhash, toxicity
from tidewatch.plans.lineage import stored

ORACLE_SQL = None
SURE = 0.5


def _packed(docs: DataFrame) -> DataFrame:
    """Whole rows as one column, so that no column of theirs meets one of a model."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", "lang")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(_packed(docs), query_toxicity.model(docs, labels))
    return scored.where(~F.col("flagged")).select("row.*")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = langid.identify(_packed(docs), query_langid.model(docs))
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("row.*")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, words=3, budget=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, query_packing.TOKENIZER, capacity=1024, end_id=2)


STAGES = [("toxicity", keep_clean), ("language ID", keep_identified), ("SimHash near-dedup", keep_distinct), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
