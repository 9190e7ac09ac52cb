"""The training-corpus pipeline: five operators in a row, each stage written and read again.

Quality rules drop what they reject; of each group of near duplicates one
document stays; contaminated documents go; secrets are masked in the text; what
is left is encoded and decoded again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaq.llm import decontam, neardup, pieces, rules, secrets, unigram
from vistaq.llm.common import own_folder, stored, table
from vistaq.llm.queries import VOCABULARY


def _apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """The rows with all columns but the used ones under names that no operator adds, and the columns that give them back."""
    names = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c not in used}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near their language's reference."""
    plain, own = _apart(docs, "text", "lang")
    return rules.judge(plain).where("kept").select(*own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of links, that of the smallest doc_id; where doc_id is no key, rows are numbered and linked by number."""
    plain, own = _apart(docs, "doc_id", "text")
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count():
        gone = neardup.link(docs).where("not kept").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    rows = stored(plain.withColumn("__n", F.monotonically_increasing_id()))
    linked = neardup.link(rows, key="__n").select(F.col("doc_id").alias("__n"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__n")
    first = linked.join(rows.select("__n", "doc_id"), "__n").groupBy("component_id").agg(F.min(order).getField("__n").alias("__n"))
    return rows.join(first, "__n", "left_semi").select(*own)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the contamination rule allows."""
    plain, own = _apart(docs, "text")
    return decontam.decontaminate(plain, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*own)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and their length counted anew."""
    plain, own = _apart(docs, "doc_id", "text", "source", "n_chars")
    return secrets.redact(plain).withColumn("n_chars", F.length("text").cast("long")).select(*own)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids (little-endian 32-bit numbers), their number and hash, and whether they decode to the text."""
    encoded = pieces.encode(docs, unigram.Vocabulary.load(VOCABULARY), ["doc_id", "lang", "source"])
    return encoded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids", F.col("same").alias("round_trip"))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_masking),
    ("sentencepiece", encoding),
]

#: The stages hold statistics of floating point, sketches and a tokenizer, which SQL can't express; brute force tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read as the next one's input.

    ``common.release`` removes the folders when the result has been used.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{own_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
