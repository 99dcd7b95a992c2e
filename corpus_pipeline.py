"""Corpus pipeline: language ID, near-duplicates, repeated passages, benchmark leaks, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which :func:`run` writes as Parquet and rereads as the next one's documents.
Counted as part of the ``llm`` subpackage.

Rows and columns: all stages but the last return the columns of their input.  Null and
empty texts are rejected by the first stage (no letter, hence no language).  A row
without ``doc_id`` can't be linked or ordered: it is kept as it is by stages 2 to 4.
Input columns may have any names beside those of ``documents``.  Rows that repeat are
documents of their own; texts of any length are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoclass.llm.common import cut

# A document is rejected where no language is found, or where the best one is not even
# twice as likely as all others together.
MIN_LANGUAGE_SCORE = 2 / 3

SHINGLE_WORDS = 5       # near-duplicate and leak stages
NEAR_PERCENT = 80
LEAK_PERCENT = 80


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names of its own, so that no column of it meets an operator's."""
    tag = uuid.uuid4().hex[:8]
    own = {c: f"_{i}_{tag}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), own


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language (learned from their own labelled rows)."""
    from duoclass.llm.langid import predict_language, train

    model = train(docs, "text", "lang")
    apart, own = _apart(docs)
    seen = predict_language(apart, model, own["text"])
    return (seen.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= MIN_LANGUAGE_SCORE))
            .select(*own.values()).toDF(*docs.columns))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose id isn't in ``gone`` (one column); those without an id stay."""
    apart, own = _apart(docs)
    return apart.join(gone.toDF("gone_id"), F.col(own["doc_id"]) == F.col("gone_id"), "left_anti").toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    from duoclass.llm.minhash import near_duplicate_groups

    groups = near_duplicate_groups(docs.select("doc_id", "text"), "doc_id", "text", shingle_words=SHINGLE_WORDS, percent=NEAR_PERCENT)
    return _without(docs, groups.where(~F.col("kept")).select("doc_id").distinct())


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that also start earlier; characters cut in half go as a whole.

    ``n_chars`` follows the text.  Documents of which nothing is left go.
    """
    from duoclass.llm.suffix import dedup_passages

    apart, own = _apart(docs)
    out = dedup_passages(apart, own["doc_id"], own["text"], as_text=True)
    changed = F.col("sa_removed") > 0
    left = out.where(~changed | (F.trim("sa_kept") != ""))
    new = {"text": F.when(changed, F.col("sa_kept")).otherwise(F.col(own["text"])),
           "n_chars": F.when(changed, F.char_length("sa_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own["n_chars"]))}
    return left.select(*(new[c].alias(c) if c in new else F.col(own[c]).alias(c) for c in docs.columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    from duoclass.llm.contain import contained_items

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    hits = contained_items(docs, items, shingle_words=SHINGLE_WORDS, percent=LEAK_PERCENT)
    return _without(docs, hits.select("doc_id").distinct())


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes it again: token count and digests of both."""
    from duoclass.llm.bpe import digests, encode_decode

    return digests(encode_decode(docs.select("doc_id", "text"), "text"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("bpe_tokens", bpe_tokens),
]

# Training, suffix sorting and BPE can't be written in SQL; tests hold run() against
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's output is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
