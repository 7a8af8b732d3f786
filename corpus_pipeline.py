"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last
return the columns of ``documents``, also where one has the name of a measure; empty tables pass through, null texts
fail the first stage. Ties and repeats: of rows with one doc_id, or near copies, one stays (see ``ngram_join.keep_one``); very long
texts are read whole. Each stage's table is in the shared folder, so a lost executor costs its tasks alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe, decontaminate, ngram_join, quality_rules, secrets
from tracewright.llm.common import fresh, load, quoted, shared_dir


def beside(docs: DataFrame, made: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work(docs)`` with the columns of ``docs``, unchanged where a column's name, in any case, is one that ``work`` makes."""
    low = {m.lower() for m in made}
    clash = [c for c in docs.columns if c.lower() in low]
    away = dict(zip(clash, fresh([*docs.columns, *made], *clash), strict=True))
    done = work(docs.withColumnsRenamed(away) if clash else docs)
    return done.select(*[quoted(away[c]).alias(c) if c in away else quoted(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy rejects go."""
    return beside(docs, [*quality_rules.MEASURES, "n_lines", "fail_bits"], lambda d: quality_rules.ledger(d).where(quality_rules.kept()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the test items' windows cover by a twentieth or more go."""
    items = load(spark, sf_dir, "benchmark")
    return beside(docs, ["n_words", "hits", "items"], lambda d: decontaminate.mark(d, items).where(~decontaminate.contaminated()))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; all documents stay."""
    clean = beside(docs, ["spans_found"], lambda d: secrets.redact(secrets.scan(d)))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*map(quoted, docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document. Workers share their executor with those of the stages before, so they hold a smaller table of words."""
    return bpe.encode(docs, bpe.vocabulary_file(), share=0.25).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("BPE encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{n}")
        docs = spark.read.parquet(f"{root}/{n}")
    return docs


#: Near-duplicate groups and BPE are beyond SQL; the test compares with brute force.
ORACLE_SQL = None
