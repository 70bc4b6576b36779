"""The corpus pipeline: line-first cleaning, toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir); `docs` is what the stage before kept, with all its columns, and all stages but the
last return those columns. Stages pass rows through as structs, so columns of any name do no harm. Null texts are empty
texts; an empty table passes through all stages as one; equal rows are copies, of which the third stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import bound_batches, shared_dir, table
from marlstone.llm.jaccard_join import representatives
from marlstone.llm.packing import pack, pieces
from marlstone.llm.quality_rules import judge
from marlstone.llm.secrets import redact
from marlstone.llm.toxicity import fit, rate

#: Near duplicates: words a shingle, and the least similarity in percent.
SHINGLE, SIMILARITY = 5, 80


def _whole(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("_row"), F.col("text"))


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, if there is one, as the length of the text, where there is a text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their failing and repeated lines; n_chars follows the text."""
    bound_batches(spark)
    kept = judge(_whole(docs), ["_row"], clean=True).where("kept")
    return _counted(kept.select(F.col("_row").withField("text", F.col("cleaned")).alias("_row")).select("_row.*"))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic."""
    bound_batches(spark)
    scorer = fit(docs, table(spark, sf_dir, "labels"))
    return rate(_whole(docs), ["_row"], scorer).where("predicted = 0").select("_row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id."""
    bound_batches(spark)
    return representatives(docs, SHINGLE, SIMILARITY)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and linked parts of credentials replaced; n_chars follows the text."""
    return _counted(redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    import public_tokenizers

    bound_batches(spark)
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("line_first_cleaning", clean),
    ("noisy_channel_toxicity", harmless),
    ("multi_order_jaccard", distinct),
    ("credential_linking", redacted),
    ("exact_complement_packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table of documents, each written to the shared folder and read again."""
    import uuid

    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/marlstone-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{home}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{home}/{i}-{name}")
    return docs
