"""From raw documents to packed sequences: toxicity, near-copies, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns a DataFrame; the result is
written and read again before the next stage. All stages but the last return the columns of `docs`.

Defined cases: a null text is scored, compared and packed as an empty one and stays null; rows without an id are
documents of their own, except that rows equal in id and text are repeats of one document and leave the near-copy stage once;
very long texts are read whole; further columns of any name pass unchanged, but n_chars follows a redacted text;
empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm import decontamination, packing, secrets, simhash, toxicity
from formline.llm.common import drop_folder, shared_folder, table

# Near-copies: a five-word similarity of LEAST (a fraction) or more. Candidates by 256 fingerprint bits: at 0.8 about
# 39 bits differ, at 0.5 about 68, and unrelated texts differ in 128 or so. Keys are TABLES pairs of least hashes, of
# which a pair at 0.8 shares none with a probability of 0.36 to the power of TABLES.
SHINGLE, LANES, BUDGET, TABLES = 5, 4, 52, 6
LEAST = 4, 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the scorer learns from all labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda doc_id: doc_id.isNotNull())
    return docs.filter(toxicity.scorer(spark, model)(F.col("text")) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays, that with the smallest id."""
    groups = simhash.near_copy_groups(docs, SHINGLE, LANES, BUDGET, TABLES, LEAST)
    return simhash.keep_first(docs, groups)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars follows where a text has changed. Columns of any other name stay."""
    before = next(name for name in iter(lambda: f"before_{uuid.uuid4().hex}", None) if name not in docs.columns)
    cleaned = secrets.redact(docs.withColumn(before, F.length("text")))
    if "n_chars" in docs.columns:
        after = F.length("text")
        cleaned = cleaned.withColumn(
            "n_chars", F.when(F.col(before) == after, F.col("n_chars")).otherwise(after.cast(docs.schema["n_chars"].dataType)))
    return cleaned.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences, places and token ids."""
    import public_tokenizers
    # Fewer words than a run of its own remembers: the workers of the stages before still hold memory.
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=120_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            # Its rows have been written on by then.
            drop_folder(spark, f"{folder}/{number - 1}")
    return docs
