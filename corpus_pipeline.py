"""A training corpus from raw documents, stage by stage.

Every stage takes the documents its predecessor kept and returns documents with the same
columns; the last returns the packed pieces. Between stages the documents are written as
Parquet to the session's shared folder, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dwops.llm import cotraining, decontaminate, near_dedup, packing, substring_dedup
from dwops.llm.queries import ready
from dwops.session import stored
from dwops.sources.tables import load

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects (quality below one half) go."""
    return cotraining.keep_good(docs, cotraining.fit(docs, load(ready(spark), sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    ready(spark)
    return near_dedup.keep_first(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out; emptied documents go."""
    ready(spark)
    return substring_dedup.cut_repeats(docs, size_col="n_chars")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.clean(docs, load(ready(spark), sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token pieces placed in sequences."""
    ready(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", drop_poor),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# The stages train a model and tokenize, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``."""
    docs = load(ready(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
