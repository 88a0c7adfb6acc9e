"""The queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sextant.llm import decontaminate, language, near, packing, prefix_trie, quality, quality_rules, spelling, substring, token_counts, topk, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.strip_repeats(table(spark, sf_dir, "documents"), window=20, start=5, keep_text=False)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = token_counts.trees(token_counts.revision(table(spark, sf_dir, "documents")), edits="edits")
    out = token_counts.edited(built)
    return out.selectExpr("doc_id", "n_before as n_tokens", "n_tokens as n_tokens_edited", "n_pretokens as n_pretokens_edited", "n_reencoded")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_archives(index, folder).drop("url")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), percent=75)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=4096, per_source=4)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(quality_rules.ledger(table(spark, sf_dir, "documents")), version=2)


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.feed_list(pages))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), shortest=5, often=3, factor=2)


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), family=20, heads=4).drop("node", "parent")


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_warc": op3_warc,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filters": op8_url_filters,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_exact_topk": op12_exact_topk,
    "op13_prefix_trie": op13_prefix_trie,
    "quality_ablations": quality_ablations,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring.ORACLE,
    "op3_warc": warc.ORACLE,
    "op4_minhash_near_dedup": near.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op8_url_filters": url_filter.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op12_exact_topk": topk.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
    "quality_ablations": quality_rules.ABLATIONS,
}
