"""The registered queries: thin wrappers that give the digest columns."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counts, decontam, extraction, neardup, neighbours, pieces, rules, secrets, substrings, unigram, urls
from .common import table

URL_RULES = [
    urls.Rule("com", "/en/", "block"),
    urls.Rule("example.com", "/en/7", "allow"),
    urls.Rule("net", "/de/", "allow"),
    urls.Rule("example.net", "/de/8", "block"),
    urls.Rule("org", "/es/", "block"),
]
#: Vocabulary file of the unigram tokenizer.
VOCABULARY = os.environ.get("VISTAQ_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
#: A page whose host has a label with one of these words is put on the list of urls.
LISTED_WORDS = r"(^|[.-])(casino|poker|bet|win|pills|xxx)([.-]|$)"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(urls.host(F.col("url")).rlike(LISTED_WORDS)).select("url")
    return urls.filter_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"), unigram.Vocabulary.load(VOCABULARY))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a source is the owner; its part in one language stands for a repository
    docs = table(spark, sf_dir, "documents").withColumn("repository", F.concat_ws("/", "source", "lang"))
    return secrets.report(secrets.find_secrets(docs, ["doc_id"], repository="repository"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"), digest=True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    distances = {c: F.round(c, 6) for c in ("char_distance", "word_distance")}
    return rules.judge(docs).drop("text", "lang").withColumns(distances)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digest(pieces.encode(docs, unigram.Vocabulary.load(VOCABULARY), ["doc_id"]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
