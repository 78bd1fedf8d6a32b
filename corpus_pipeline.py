"""A corpus in five stages: junk goes, near copies go, repeated passages go, sources are mixed, and what
is left is packed into sequences. Each stage gets what its predecessor kept as a table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from leafworks.llm import mixing, packing, quality, shingles, substring
from leafworks.llm._base import drop, recorded, settle, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Tables that the stages before the next one have settled, by Spark context.
_left: dict[int, list[str]] = {}


def _stage(place: int, last: bool = False):
    """A stage that deletes what its predecessors settled, once their results are tables of their own (or else
    among the inputs of ``docs``, and so kept). What the last stage settles stays for its reader."""

    def wrap(f):
        @functools.wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            key = id(spark.sparkContext)
            before = _left.pop(key, []) if place else []
            stays = drop(spark, before, docs)
            with recorded() as paths:
                out = f(spark, docs, sf_dir)
            _left[key] = stays + ([] if last else paths)
            return out

        return run_stage

    return wrap


@_stage(0)
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.classify(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).filter("predicted = 1").select(*COLUMNS)


@_stage(1)
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the links of the SimHash
    trie first, each verified on whole sets, then what fingerprints miss."""
    return shingles.one_of_similar(docs.select(*COLUMNS), words=5, similarity=0.8)


@_stage(2)
def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier as well; n_chars follows the text."""
    return substring.cleaned(docs)


@_stage(3)
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


@_stage(4, last=True)
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good),
    ("SimHash near-dedup", distinct),
    ("substring dedup", unrepeated),
    ("mixing", mixed),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        with recorded() as own:
            docs = settle(made, f"pipeline-{name.split()[0]}")
        drop(spark, before)
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
