"""Problem 1: frequency of every distinct term, in a vertical layout of compressed record bitmaps.

Records get dense numbers inside hash buckets, so numbering needs one shuffle and no global sort. A term's
record set is kept as its non-zero 64-bit words, each with a parallel counter of occurrences; words of different
buckets are disjoint, so partial sets are merged by union without moving rows, and the document frequency is the
cardinality of the union. A term held by a third of all rows is combined before the shuffle like any other.

Nulls: rows without a key and null or blank members are ignored. A repeated key counts once, with the row of the
latest ``order_by`` (ties: by a hash of the lists). An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 64


def normal_term(c: Column) -> Column:
    """Lower case, outer white space removed, inner runs made one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def numbered(df: DataFrame, key: str, fields: Sequence[str], order_by: str, buckets: int = 4096) -> DataFrame:
    """One row a key with ``bucket`` and the record number ``rec`` inside it."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    rows = df.select(F.col(key).alias("key"), F.col(order_by).alias("at"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    rows = rows.where(F.col("key").isNotNull()).withColumn("bucket", bucket)
    tie = F.xxhash64(*[f"f{i}" for i in range(len(fields))])
    w = Window.partitionBy("bucket").orderBy("key", F.col("at").desc_nulls_last(), tie)
    rows = rows.withColumn("rec", F.dense_rank().over(w) - 1).withColumn("before", F.lag("key").over(w))
    return rows.where(F.col("before").isNull() | (F.col("before") != F.col("key"))).drop("before", "at")


def term_bitmaps(df: DataFrame, key: str, fields: Sequence[str], order_by: str, buckets: int = 4096) -> DataFrame:
    """``field, term, bucket, word_no, bits, occurrences``: the non-zero words of every term's record set."""
    rows = numbered(df, key, fields, order_by, buckets)
    lists = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f{i}").alias("members")) for i, f in enumerate(fields)])
    rows = rows.select("bucket", "rec", F.explode(lists).alias("x")).select("bucket", "rec", "x.field", F.explode("x.members").alias("m"))
    rows = rows.select("bucket", "rec", "field", normal_term(F.col("m")).alias("term")).where("term != ''")
    bit = F.expr(f"shiftleft(1L, rec % {WORD})")
    return rows.groupBy("field", "term", "bucket", F.expr(f"rec div {WORD}").alias("word_no")).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("occurrences"))


def term_frequencies(df: DataFrame, key: str, fields: Sequence[str], order_by: str, rare_records: int = 2, common_share: float = 0.05, buckets: int = 4096) -> DataFrame:
    """Every ``field_name, term`` with ``occurrences``, ``records`` and ``mark`` ('rare', 'common' or null).

    A term is rare with at most ``rare_records`` records, else common with more than ``common_share`` of all keys.
    """
    words = term_bitmaps(df, key, fields, order_by, buckets)
    terms = words.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum(F.bit_count("bits").cast("long")).alias("records"))
    total = df.select(F.col(key).alias("key")).agg(F.count_distinct("key").alias("n"))  # one row
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > common_share * F.col("n"), "common")
    return terms.crossJoin(F.broadcast(total)).select(F.col("field").alias("field_name"), "term", "occurrences", "records", mark.alias("mark"))
