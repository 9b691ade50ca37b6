"""A corpus from raw documents to packed sequences, stage by stage.

Every stage reads what the stage before it wrote and gives the columns of `documents`; the
last gives the pieces of packed sequences.

`run` owns the tables that its stages stage on the way and deletes each when the next stage's
input is written; what its result still reads stays until `discard(result)`. Two runs share
nothing. A stage of `STAGES` that is called by itself deletes what the stage called before
it staged, so write each stage's result before you call the next stage; the first stage
deletes nothing, and so starts anew.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sessionmine.llm import langid, mixing, neardup, packing, quality
from sessionmine.llm.common import release, stage, staging, table
from sessionmine.llm.queries import MIX, domains

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles at a similarity of 0.8."""
    return neardup.filter_documents(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All of the clean domain stays; the others come down to their shares."""
    return mixing.filter_documents(docs, domains(table(spark, sf_dir, "labels")), MIX, anchor="clean")


def packing_to_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and places in sequences of 2048 tokens."""
    return packing.place(packing.cut(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1))


_STEPS: list[tuple[str, Stage]] = [
    ("quality", quality_rules), ("language", language_id), ("near duplicates", near_duplicates),
    ("mixing", mixing_to_targets), ("packing", packing_to_windows)]
_left: list[str] = []  # staged by the stage called last, outside of `run`


def _by_itself(apply: Stage, first: bool) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        stay = [] if first else release(spark, _left, docs)
        with staging() as made:
            out = apply(spark, docs, sf_dir)
        _left[:] = stay + made
        return out

    return run_stage


STAGES = [(name, _by_itself(apply, i == 0)) for i, (name, apply) in enumerate(_STEPS)]

#: The learned references, models and sketches have no SQL form; tests/llm compares each
#: stage with a version that loops over the documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet and read again."""
    docs, left = table(spark, sf_dir, "documents"), []
    for i, (_name, apply) in enumerate(_STEPS):
        with staging() as made:
            docs = apply(spark, docs, sf_dir)
            if i + 1 < len(_STEPS):
                docs = stage(docs)
        left += made
        if i + 1 < len(_STEPS):
            left = release(spark, left, docs)
    _owned.append((docs, left))
    return docs


_owned: list[tuple[DataFrame, list[str]]] = []


def discard(result: DataFrame) -> None:
    """Delete what a result of `run` reads, when it isn't needed any more."""
    for pair in [p for p in _owned if p[0] is result]:
        _owned.remove(pair)
        release(result.sparkSession, pair[1])
