"""Queries of the corpus problems p6 to p8, each over its whole tables. SQL can express none of the methods; tests hold them against brute force and held-out labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import encode, mixing, subjects
from weftgraph.session import read_table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(read_table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    targets = read_table(spark, d, "mix_targets")
    return mixing.mix(mixing.sized(read_table(spark, d, "documents"), targets), targets)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, d), read_table(spark, d, "mix_targets"))


def _classifier(spark: SparkSession, d: str) -> subjects.Classifier:
    return subjects.train(*(read_table(spark, d, t) for t in ("documents", "subject_labels", "subjects")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign(read_table(spark, d, "documents"), _classifier(spark, d))


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(subjects.areas(read_table(spark, d, "documents"), _classifier(spark, d)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p6_ids, p7_mix, p7_shares, p8_found, p8_composition)}
SQL: dict[str, str] = {}
