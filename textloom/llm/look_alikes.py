"""Problem 5: one consistent form of visually identical text, by confusable skeletons.

A text is decomposed, every character replaced by its prototype (full-width forms, invisible characters, blanks,
look-alike letters inside words that may be read as Latin) and decomposed again; originals are grouped by equal
skeleton. Case, punctuation, circled digits and the number of blanks stay.

Nulls: a row with a null key or a null in any compared column is left out; empty texts are equal to each other and
never differ in characters. Repeated rows count once. Exact copies never meet: a look is kept only if it has two
spellings, spellings are paired, and only then are pairs expanded to records.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import text as X
from textloom.plans.lineage import cut


@F.pandas_udf(T.StringType())
def consistent_form(s: pd.Series) -> pd.Series:
    """The skeleton of a text; null stays null."""
    return s.map(X.skeleton, na_action="ignore")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [c.to_pylist() for c in b.columns[1:]]
        look, raw = [], []
        for vs in zip(*cols, strict=True):
            s = "\0".join(vs)
            k = "\0".join(map(X.skeleton, vs))
            look.append(X.digest(k))
            raw.append(look[-1] if k == s else X.digest(s))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(look, pa.binary()), pa.array(raw, pa.binary())], ["key", "look", "raw"])


def fingerprints(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, look, raw``: digests of the skeleton and of the characters of ``columns`` together."""
    rows = df.select(F.col(key).cast("string").alias("key"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    return rows.mapInArrow(_fingerprints, "key string, look binary, raw binary")


def look_alike_records(seen: DataFrame) -> DataFrame:
    """``look, raw, key`` of records whose look occurs in more than one spelling."""
    spellings = seen.groupBy("look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo != hi").select("look")
    return seen.join(spellings, "look", "left_semi").select("look", "raw", "key").distinct()


def look_alike_pairs(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key_a, key_b``: different records, a < b, that look the same and differ in characters."""
    r = look_alike_records(cut(fingerprints(df, key, columns)))
    one = r.select("look", "raw").distinct()
    pairs = one.toDF("look", "raw_a").join(one.toDF("look", "raw_b"), "look").where("raw_a < raw_b").drop("look")
    keys = r.select("raw", "key")
    x = pairs.join(keys.toDF("raw_a", "ka"), "raw_a").join(keys.toDF("raw_b", "kb"), "raw_b").where("ka != kb")
    return x.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def look_alike_groups(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, group, spellings``: one row a record in a group of equal looks with two spellings or more.

    The form without pairs, linear in the records; ``group`` is the group's smallest key.
    """
    seen = cut(fingerprints(df, key, columns))
    groups = seen.groupBy("look").agg(F.min("key").alias("group"), F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo != hi")
    n = seen.select("look", "raw").distinct().groupBy("look").agg(F.count("*").alias("spellings"))
    return seen.join(groups, "look").join(n, "look").select("key", "group", "spellings").distinct()
