"""Corpus preparation: a chain of training-data operators over ``documents``.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir), where
``docs`` is what the stage before kept, and returns its result. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.llm.common import free_name, table, written
from gridspark.llm.decontaminate import drop_contaminated
from gridspark.llm.line_dedup import drop_shared_lines
from gridspark.llm.packing import pack
from gridspark.llm.queries import tokenizer_path
from gridspark.llm.simhash import keep_one_per_group
from gridspark.llm.toxicity import fit, with_score

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score is at least 0.5."""
    score = free_name(docs, "_score")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return with_score(docs, model, score).where(F.col(score) < 0.5).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that at least three documents share, but in the largest id;
    ``n_chars`` is that of the text left."""
    out = drop_shared_lines(docs, min_length=20, min_docs=3)
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)
                        for c in docs.columns])


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the smallest id."""
    return keep_one_per_group(docs, shingle=3, max_bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that overlap a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, as ``op3_packing`` returns them."""
    return pack(docs, tokenizer_path(), max_len=2048, end_id=1).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash", simhash),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained scores, near-duplicate components and tokens have no SQL form;
#: tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
