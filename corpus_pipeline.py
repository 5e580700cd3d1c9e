"""A corpus pipeline of the training-data operators: each stage works on all rows that the one before kept.

Defined results, as those of the operators: null and blank texts are never toxic nor near-duplicates and hold no passages;
mixing takes none of them, as they have no words, so they end there; rows with a null doc_id pass all stages and are first
in the record files; a null source is a source of its own; rows repeated in doc_id and text are one document and stay
together in near-dedup, and share in mixing what the plan gives them; texts of any length are handled whole; ties are broken
by doc_id, then by a hash of the text; columns beside those of documents are kept, whatever their names; empty tables make
empty results, and without a toxic label or a benchmark item nothing is dropped or cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontam, mixing, near_dedup, token_io, toxicity
from plumbline.llm.common import stored, table


#: Near-duplicates of the pipeline are alike from this percentage of their shingles on; op4's contract has another.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text isn't called toxic; learnt from the labels of rows that aren't held out."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id."""
    return near_dedup.drop_duplicates(docs, NEAR_PERCENT)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the words that benchmark windows cover."""
    return decontam.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's budget takes them, the last time in part where the budget ends inside."""
    return mixing.apply_mix(docs)


def write_token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the record files that hold all rows' token ids."""
    import public_tokenizers

    return token_io.records_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark_passages),
    ("mixing", mix_sources),
    ("token_records", write_token_records),
]

#: Neither the classifier nor the tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
