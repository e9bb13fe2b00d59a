"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.common import fold_of, table
from seamline.llm.oracles import ORACLES as ORACLES


# fixed values: the rules of the url query
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.suffix_dedup import repeats_removed

    return repeats_removed(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from seamline.llm.packing import added_tokens, pack

    tokenizer = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(table(spark, sf_dir, "documents"), tokenizer).drop("ids")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.secrets import BASE, find_secrets, listed

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in BASE]
    base = F.filter("found", lambda x: x["kind"].isin(kinds))

    def count_of(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind))

    counts = [count_of(k).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.url_filter import judge_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.language_model import score

    return score(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.quality import classify, fit, training_rows

    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), fold_of("doc_id", 4) == 2
    ensemble = fit(training_rows(docs, table(spark, sf_dir, "labels"), usable=~held_out))
    return classify(docs, ensemble).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.flac import features, store_texts

    found = features(store_texts(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_seek_points")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from seamline.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.filter_audit import audit, failure_masks

    return audit(failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, label=moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_packing": op2_packing,
    "op3_html_extraction": op3_html_extraction,
    "op4_secret_scans": op4_secret_scans,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_url_filters": op6_url_filters,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_flac_media": op10_flac_media,
    "op11_token_counts": op11_token_counts,
    "op12_filter_audit": op12_filter_audit,
    "op13_hard_negatives": op13_hard_negatives,
}
