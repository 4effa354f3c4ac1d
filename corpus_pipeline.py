"""From raw documents to packed training sequences: each stage's rows are written as Parquet and read by the next stage.

Null, empty and very long texts, ties, repeated rows, empty tables and extra columns fare as the stages' operators say: blank
texts fail the quality rules, of equal rows one stays, extra columns stay up to packing, and no documents make no sequences.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from addrloom.llm.common import drop, home, staging, table
from addrloom.llm.line_templates import deduped_documents as drop_template_lines
from addrloom.llm.ngram_join import kept_documents as one_of_each_group
from addrloom.llm.packing import pack, tokenizer_path
from addrloom.llm.quality import kept_documents as pass_rules
from addrloom.llm.substring_dedup import deduped_documents as drop_repeated_spans

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGED = "staged"


def _reads(docs: DataFrame, folder: str) -> bool:
    """Whether files of a folder are among those that the rows come from."""
    own = folder.partition(":")[2].lstrip("/") or folder
    return any(own in unquote(file) for file in docs.inputFiles())


def stage(work: Stage) -> Stage:
    """Names, in the metadata of the text column, the folder that a stage's rows are computed from. Parquet keeps metadata, so
    the next stage reads which folder its input came from, and deletes just that folder, once the rows are written: not if it
    is given rows that are still to be computed from there, nor if a table has the name of another application's folder."""
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        done = docs.schema["text"].metadata.get(STAGED) if "text" in docs.columns else None
        if done and done.startswith(home(spark) + "/") and not _reads(docs, done):
            drop(spark, done)
        with staging(spark) as folder:
            found = work(spark, docs, sf_dir)
        return found.withMetadata("text", {STAGED: folder}) if "text" in found.columns else found

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the policy go."""
    return pass_rules(docs, "strict-2")


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go; every document stays."""
    return drop_template_lines(docs)


@stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard similarity of 0.8 or more) the first document stays."""
    return one_of_each_group(docs, 5, 80)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a window of 35 words that starts anywhere else go."""
    return drop_repeated_spans(docs, 35)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, as pieces with their token ids."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]
#: Packing runs a public tokenizer, which SQL cannot express; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' outputs are deleted once the next stage has written its own, the last one when the driver's interpreter ends."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, work in STAGES:
        path = f"{home(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        work(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
