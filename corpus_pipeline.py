"""The corpus pipeline: toxicity, quality rules, n-gram Jaccard join, substring dedup, packing.

Each stage gets what its predecessor kept, as rows of documents, and its decisions take effect: toxic and
low-quality documents go, one document of each component of similar ones stays, repeated passages are cut out
of the texts (n_chars follows), and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.llm import common, jaccard, packing, quality, substring, toxicity

#: Stages that no SQL expresses (learned models, tokenisers).
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    columns = [F.col(f"`{x}`") for x in docs.columns]
    return toxicity.classify(docs, labels).where("__df_toxic = 0").select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return quality.apply(docs, public_tokenizers.path("piece_bpe_32k.model"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring.dedup(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), lean=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("ngram_jaccard", jaccard_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what only a stage needed is removed."""
    docs = common.documents(spark, sf_dir)
    before = common.mark()
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.drop_since(before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
