"""Queries over documents: token ids, source mixes, sentence units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm.mixing import mix_sources, shuffled_copies
from frameloom.llm.sentences import split_sentences
from frameloom.llm.tokens import count_tokens, encode_corpus
from frameloom.session import cut
from frameloom.sources.tables import read_table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return encode_corpus(read_table(spark, folder, "documents"))


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The number of tokens of every document."""
    return count_tokens(read_table(spark, folder, "documents"), ["doc_id"])


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = cut(count_tokens(read_table(spark, folder, "documents"), ["doc_id", "source"]))
    return mix_sources(sizes, read_table(spark, folder, "mix_plans"), read_table(spark, folder, "mix_targets"))


def p7_mix_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents of every mix with their repeats."""
    return _mix(spark, folder)[0]


def p7_mix_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source of every mix."""
    return _mix(spark, folder)[1]


def p7_mix_stream(spark: SparkSession, folder: str) -> DataFrame:
    """All copies of the chosen documents, globally shuffled within each mix."""
    return shuffled_copies(_mix(spark, folder)[0])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentence units of every document with their positions."""
    return split_sentences(read_table(spark, folder, "documents"))


QUERIES = {
    "p6_ids": p6_ids,
    "p6_counts": p6_counts,
    "p7_mix_documents": p7_mix_documents,
    "p7_mix_shares": p7_mix_shares,
    "p7_mix_stream": p7_mix_stream,
    "p8_found": p8_found,
}
ORACLES: dict[str, str] = {}
