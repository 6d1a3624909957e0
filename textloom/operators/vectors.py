"""Similarity over ``vec_id, embedding`` columns. Queries are a stated set of rows, scored in blocks against all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.lexical import ranked
from textloom.operators.scoring import Best


def dot(a: Column | str, b: Column | str) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def unit(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: vectors of length 1; those without a length are left out."""
    n = norm("embedding")
    return vectors.where(n > 0).select("vec_id", F.transform("embedding", lambda x: x.cast("double") / n).alias("v"))


def _matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that are vectors of ``width`` (of the first one, if none is given) with a length,
    divided by it; and which rows those are."""
    rows = column.to_pylist()
    width = next((len(r) for r in rows if r), 0) if width is None else width
    fit = np.array([r is not None and len(r) == width > 0 and None not in r for r in rows], bool)
    m = np.array([r for r, ok in zip(rows, fit, strict=True) if ok], np.float64).reshape(-1, max(width, 1))
    n = np.sqrt((m * m).sum(1))
    live = n > 0
    at = np.flatnonzero(fit)[live]
    return m[live] / n[live, None], at


def _products(shared, top: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best, keys, base = Best(len(ids), top) if top else None, [], 0
        if best:
            best.bound[:] = -np.inf
        for b in batches:
            m, at = _matrix(b.column(1), q.shape[1])
            own = b.column(0).to_numpy()[at]
            for lo in range(0, len(own), 4096):
                part = own[lo : lo + 4096]
                s = np.round(q @ m[lo : lo + 4096].T, 6)
                keep = ids[:, None] != part[None]
                if best:
                    keep &= s >= best.bound[:, None]
                i, j = np.nonzero(keep)
                if best:
                    best.add(i, j + lo + base, s[i, j])
                elif len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(part[j]), pa.array(s[i, j])], ["query_id", "doc_id", "score"])
            if best:
                keys.append(own)
                base += len(own)
        if best and base:
            i, place, score = best.prune()
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(np.concatenate(keys)[place]), pa.array(score)], ["query_id", "doc_id", "score"])

    return run


def similarities(vectors: DataFrame, queries: DataFrame, top: int | None = None, block: int = 1 << 22) -> DataFrame:
    """``query_id, doc_id, score``: cosines of every query with all other vectors, or at least the ``top`` best of each.

    Queries are broadcast in blocks of at most ``block`` numbers and met by batches of vectors in one matrix product;
    with ``top`` a task keeps what reaches its present bound. Vectors of another width, with nulls or without a
    length are left out.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    out, rows = None, []
    q = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")

    def held(rows: list) -> DataFrame:
        m, at = _matrix(pa.array([r.embedding for r in rows]))
        shared = spark.sparkContext.broadcast((np.array([rows[i].vec_id for i in at], np.int64), m))
        return v.mapInArrow(_products(shared, top), "query_id long, doc_id long, score double")

    for r in q.toLocalIterator():
        rows.append(r)
        if len(rows) * len(r.embedding) >= block:
            out = held(rows) if out is None else out.unionByName(held(rows))
            rows = []
    if rows:
        out = held(rows) if out is None else out.unionByName(held(rows))
    return spark.createDataFrame([], "query_id long, doc_id long, score double") if out is None else out


def nearest(vectors: DataFrame, queries: DataFrame, top: int | None) -> DataFrame:
    """``query_id, doc_id, score, rank``: the ``top`` highest cosines of every query against all other vectors."""
    return ranked(similarities(vectors, queries, top), top)


def backfill(ranking: DataFrame, excluded: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of a full ranking that are not excluded; ranks keep referring to the whole."""
    left = ranking.join(excluded, ["query_id", "doc_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("rank")
    return left.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def audit(vectors: DataFrame) -> DataFrame:
    """One row: vectors, widths, vectors with NaN, without length, and the norms' range."""
    n = norm("embedding")
    bad = F.exists("embedding", lambda x: F.isnan(x) | x.isNull())
    return vectors.agg(
        F.count("*").alias("n"), F.min(F.size("embedding")).alias("min_width"), F.max(F.size("embedding")).alias("max_width"),
        F.count_if(bad).alias("with_nan"), F.count_if(n == 0).alias("zero"),
        F.round(F.min(n), 6).alias("norm_min"), F.round(F.max(n), 6).alias("norm_max"), F.round(F.avg(n), 6).alias("norm_mean"),
    )
