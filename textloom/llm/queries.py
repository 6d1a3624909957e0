"""The queries of this package, by name; each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import leaks, look_alikes, mixture, near_duplicates, pieces, pii, split_overlap, term_counts
from textloom.sources.tables import table

FIELDS = ("subject_key", "role", "qualifier", "reference")


def p1_term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return term_counts.term_frequencies(table(spark, sf, "element_semantic_fields_v4"), "element_id", FIELDS, "loaded_at")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_term_frequencies(spark, sf).where("mark is not null").select("field_name", "term", "mark")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = near_duplicates.near_duplicate_pairs(table(spark, sf, "elements"), "element_id", "text", ("title", "contract_scope", "text"))
    return pairs.select(F.col("a").alias("element_id_a"), F.col("b").alias("element_id_b"))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row an element: its class of equal texts and the number of other classes nearly the same."""
    return near_duplicates.near_duplicate_records(table(spark, sf, "elements"), "element_id", "text", ("title", "contract_scope", "text")).withColumnRenamed("key", "element_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    e = look_alikes.look_alike_pairs(table(spark, sf, "elements"), "element_id", ["text"])
    d = look_alikes.look_alike_pairs(table(spark, sf, "doc_facts"), "doc_id", ["rel_path", "filename"])
    return e.select(F.lit("elements").alias("table_name"), "*").unionByName(d.select(F.lit("doc_facts").alias("table_name"), "*"))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row a record that looks like another: its group and how many spellings the group has."""
    e = look_alikes.look_alike_groups(table(spark, sf, "elements"), "element_id", ["text"])
    d = look_alikes.look_alike_groups(table(spark, sf, "doc_facts"), "doc_id", ["rel_path", "filename"])
    return e.select(F.lit("elements").alias("table_name"), "*").unionByName(d.select(F.lit("doc_facts").alias("table_name"), "*"))


def p5_consistent_forms(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "elements").select(F.lit("elements").alias("table_name"), F.col("element_id").alias("key"), F.lit("text").alias("field_name"), F.col("text").alias("v"))
    d = table(spark, sf, "doc_facts")
    parts = [d.select(F.lit("doc_facts").alias("table_name"), F.col("doc_id").alias("key"), F.lit(c).alias("field_name"), F.col(c).alias("v")) for c in ("rel_path", "filename")]
    rows = e.unionByName(parts[0]).unionByName(parts[1])
    return rows.withColumn("consistent", look_alikes.consistent_form("v")).withColumn("changed", F.col("v") != F.col("consistent")).drop("v")


def _limits(spark: SparkSession, sf: str) -> DataFrame:
    """``chunkset, size, overlap``: one row for each struct column of the one row of chunk_stats."""
    t = table(spark, sf, "chunk_stats")
    kinds = [c for c, kind in t.dtypes if kind.startswith("struct")]
    sets = [F.struct(F.lit(c).alias("chunkset"), F.col(c)["size"].alias("size"), F.col(c)["overlap"].alias("overlap")) for c in kinds]
    return t.select(F.explode(F.array(*sets)).alias("x")).select("x.*").where("size is not null").distinct()


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunks").select("chunk_id", "text", "chunkset").join(F.broadcast(_limits(spark, sf)), "chunkset")  # as many rows as chunk_stats has columns
    return pieces.pieces(chunks, "chunk_id", "text", F.col("size"), F.col("overlap")).withColumnRenamed("id", "chunk_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_pieces(spark, sf).select("chunk_id").distinct()


def p4_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return split_overlap.overlaps(*(table(spark, sf, t) for t in ("results", "train350_gold", "config", "doc_facts", "chunks")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_overlaps(spark, sf).select("split", "source", "key_a", "key_b").distinct()


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return p4_overlaps(spark, sf).groupBy("split", "source", "reason").agg(F.count("*").alias("pairs"), F.count_distinct("key_a").alias("keys_a"), F.count_distinct("key_b").alias("keys_b"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id").distinct()


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), paraphrases=True)


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    tokens = mixture.counted(table(spark, sf, "documents"), "doc_id", "text", "source")
    return mixture.mix(tokens, table(spark, sf, "mix_targets"))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.shares(_mixed(spark, sf), table(spark, sf, "mix_targets"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.mentions(table(spark, sf, "documents")).select("doc_id", "kind", "char_start").distinct()


def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redacted(table(spark, sf, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}
