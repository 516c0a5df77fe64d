"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing and packing, each stage on what the last one kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landheat.llm import mixing, packing, secrets, simhash, toxicity
from landheat.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go.

    Null and empty texts have the labels' prior share as score and stay; each row is judged by its own text, whatever
    rows share its id, and repeated rows alike; examples that are equally near count in a fixed order; a text of any
    length is judged whole; an empty table stays empty; further columns are kept.
    """
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; rows without an id count as the last.

    Rows that share an id are judged each by its own text, and of those that tie the one with the smallest hash of its
    text, then the smallest values, stays; null and empty texts are one group; rows that repeat leave one; a text of any
    length has one fingerprint; an empty table stays empty; further columns are kept.
    """
    return simhash.deduplicated(docs, keep_unnamed=False)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark, and n_chars follows; no document goes.

    Null texts stay null; rows that repeat are masked alike, and spans that overlap by one mark; a text of any length is
    scanned whole; an empty table stays empty; further columns are kept, whatever their names.
    """
    return secrets.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: a row per document and pass, with the words that were drawn.

    Rows without words do not appear, null sources are one source, repeated rows are documents of their own; rows that
    tie in id and text take adjoining places in no fixed order, which changes no sum; a long text is cut into blocks like
    any other; an empty table mixes to nothing; further columns are kept, whatever their names.
    """
    return mixing.Mix(docs).documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix is packed into sequences; a row per piece.

    Null ids and repeated rows keep their rows, long texts are cut at the capacity, an empty table gives no rows.
    """
    return packing.best_fit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express SimHash groups, k-nearest votes or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
