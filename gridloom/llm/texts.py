"""Queries p6, p7 and p8: documents, whole texts of the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.leakage import find_leaks
from gridloom.llm.packing import pack_texts
from gridloom.llm.truncation import find_truncated, truncation_by_source
from gridloom.tables import table


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one container of each kind: where it lies and how many tokens it takes."""
    capacities = {r.container_kind: r.capacity_tokens for r in table(spark, sf_dir, "pack_capacity").collect()}  # 3 rows
    return pack_texts(table(spark, sf_dir, "documents"), capacities)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_truncated(table(spark, sf_dir, "documents")).where("cut is not null").select("doc_id")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many and what share of each source's documents are cut off."""
    return truncation_by_source(find_truncated(table(spark, sf_dir, "documents")))


QUERIES = {"p6_pack": p6_pack, "p7_found": p7_found, "p8_found": p8_found, "p8_sources": p8_sources}
ORACLES: dict[str, str] = {}
