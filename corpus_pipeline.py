"""A training-data pipeline over ``documents``: rules, lines, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but
the last return the columns of ``documents``.  ``run`` writes each stage's rows to the shared folder and reads them again;
who calls the stages must do so too, since a stage that begins deletes the working tables of the one before.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.decontaminate import clean_documents
from quarry.llm.line_dedup import documents_with_lines
from quarry.llm.ngram_join import one_of_each
from quarry.llm.packing import best_two_fit
from quarry.llm.quality import keep_documents
from quarry.llm.queries import tokenizer_path
from quarry.llm.workspace import Workspace, recorded


_spaces: list[Workspace] = []


def _stage(f: Callable) -> Callable:
    """``f`` as a stage: when it begins, the rows of the stage before are written, so that one's own tables go."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _spaces:
            _spaces.pop().drop()
        with recorded() as opened:
            out = f(spark, docs, sf_dir)
        _spaces.extend(opened)
        return out

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules on hosts that do not mostly fail.

    Null, empty and short texts fail; very long texts are judged whole; repeated rows are judged each; there is nothing to tie;
    an empty table gives no rows; all columns come back, whatever their names.
    """
    return keep_documents(docs)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus; a document that loses all its words goes.

    Null, empty and wordless texts lose nothing and stay; very long texts and lines are taken whole; of equal lines the one
    of the least (doc_id, row hash, line number) stays; rows alike in doc_id and text keep the same lines; an empty table gives
    no rows; all columns come back, whatever their names, and ``n_chars`` follows the text.
    """
    return documents_with_lines(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by word shingles.

    Null and wordless texts link with nothing and stay; very long texts are compared whole; a tie in doc_id goes to the least row
    hash, and of rows alike in doc_id and text one stays; an empty table gives no rows; all columns come back, whatever their names.
    """
    return one_of_each(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null, empty and wordless texts hold no window and stay; very long texts are scanned whole; repeated rows are judged each; an empty
    table gives no rows; all columns come back, whatever their names.
    """
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row a piece, no longer the columns of ``documents``.

    A null or empty text is the end id alone; very long texts are cut into pieces; repeated rows are packed each; equal lengths
    are taken by doc_id, then piece; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    return best_two_fit(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram join", near_copies), ("decontamination", decontaminate), ("best-fit packing", packing)]

#: No SQL: token packing and the tokenizer are beyond it.  Tested stage by stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = space.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            space.drop(f"stage-{k - 1}")
    return docs
