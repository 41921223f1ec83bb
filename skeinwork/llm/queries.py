"""Queries of the training-text operators, by name, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm import boilerplate_lines, leakage, main_text, near_duplicates, repetition, residue, survivors, tokenise
from skeinwork.session import cut, read_table


def _page_clusters(items: DataFrame) -> DataFrame:
    """(id, group_id) of problem 2's clusters of pages: the groups of problem 3 over all items, those of problem 4 too."""
    return near_duplicates.groups(*near_duplicates.classes(near_duplicates.item_texts(items), *near_duplicates.ITEMS)).select("id", "group_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.found(read_table(spark, sf_dir, "raw_items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, sources = (read_table(spark, sf_dir, t) for t in ("raw_items", "sources"))
    return boilerplate_lines.found(items, sources, _page_clusters(items))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, events = (read_table(spark, sf_dir, t) for t in ("raw_items", "event_clusters"))
    return near_duplicates.found(items, events, residue.residue(items, fields=("raw_content",)).select("id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.found(read_table(spark, sf_dir, "raw_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.found(*[read_table(spark, sf_dir, t) for t in ("processed_items", "raw_items", "sources")])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise.encode_corpus(read_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.found(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.found(read_table(spark, sf_dir, "documents"))


def p2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated lines of problem 2 that also stand in eight clusters of near-duplicate pages and on three days: no article that is merely published again."""
    items, sources = (read_table(spark, sf_dir, t) for t in ("raw_items", "sources"))
    return boilerplate_lines.repeated_lines(cut(boilerplate_lines.hashed_lines(items, sources, _page_clusters(items))), pages=8, days=3)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's near-duplicate group and the number of classes its own is linked to: a row an item, whatever the number of pairs."""
    items = read_table(spark, sf_dir, "raw_items")
    left_out = residue.residue(items, fields=("raw_content",)).select("id")
    return near_duplicates.groups(*near_duplicates.classes(near_duplicates.item_texts(items), *near_duplicates.ITEMS, left_out))


def p6_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's author, kind of source and importance by votes of trust that halve every 30 days."""
    processed, raw, sources = (read_table(spark, sf_dir, t) for t in ("processed_items", "raw_items", "sources"))
    return survivors.voted(processed, raw, sources, 30.0)


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and proximity matches of all test items, with their lengths."""
    return leakage.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each document under multinomials of hashed n-grams."""
    return repetition.ngram_scores(read_table(spark, sf_dir, "documents"))


_ALL = (p1_found, p2_found, p2_lines, p3_found, p3_groups, p4_found, p6_found, p6_votes, p7_ids, p8_found, p8_passages, p9_found, p9_scores)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
#: No SQL: folding is NFKC, which DuckDB lacks, and the rest is learned or tokenised; the tests hold each against brute force.
SQL: dict[str, str] = {}
