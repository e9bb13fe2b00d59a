"""A corpus pipeline of five stages: quality, near copies, benchmark passages, secrets, packing.

Every stage but the last returns the columns that it gets, whatever their names; names that start with __seam are the
stages' own. Defined results: a null text counts as empty and stays null where it is kept; very long texts are handled
whole; rows with the same id count as one document for near copies and are packed apart otherwise; rows with a null id
are never near copies; an empty table gives an empty result; without labels every document is kept, and without
benchmark items none is dropped for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    from seamline.llm.quality import accepted, fit, training_rows

    return accepted(docs, fit(training_rows(docs, table(spark, sf_dir, "labels"))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    from seamline.llm.minhash import near_duplicates

    gone = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("__seam_id"))
    return docs.join(gone, F.col("doc_id") == F.col("__seam_id"), "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    from seamline.llm.decontamination import without_benchmark

    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text; n_chars follows."""
    from seamline.llm.secrets import masked

    found = masked(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most 2048."""
    import public_tokenizers

    from seamline.llm.packing import added_tokens, pack

    return pack(docs, (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added_tokens(public_tokenizers.path("byte_bpe_50k.json"))))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("secret scans", secrets),
    ("packing", packing),
]

#: SQL can't express the learned stages; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on a stored table of what the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs.drop("ids")
