"""BM25 of a stated query set against all documents, in Arrow batches of documents and blocks of queries.

Rows of postings times queries are never made. Each task looks the tokens of its documents up in the block's terms,
adds weights into a dense block of documents by queries, and keeps for each query what reaches its present
``top``-th best score; the rest is pruned by that bound before it leaves the task. A pass before counts document
frequencies and lengths. Queries are broadcast in blocks of at most ``QUERIES`` queries and ``TERMS`` term entries.

Scores are rounded to six digits before they are compared, as everywhere; ties at the bound are all kept and decided
by the final ranking, so the result does not depend on how documents are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES, TERMS = 4096, 1_000_000
#: Cells of documents by queries scored at a time.
CELLS = 2_000_000


class Block:
    """Queries of one block: their ids, and for every term the queries that have it, with its count there."""

    def __init__(self, ids: list, query: np.ndarray, terms: list[str], count: np.ndarray):
        self.ids = ids
        vocabulary, number = np.unique(np.array(terms, object).astype(str), return_inverse=True) if terms else (np.array([], str), np.zeros(0, int))
        order = np.argsort(number, kind="stable")
        self.vocabulary = pa.array(vocabulary.tolist(), pa.string())
        self.query, self.count = query[order], count[order]
        self.first = np.searchsorted(number[order], np.arange(len(vocabulary) + 1))
        self.df = np.zeros(len(vocabulary), np.int64)
        self.n, self.mean = 0, 1.0

    def frequencies(self, b: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, term and count of what the documents of a batch hold of the vocabulary, and all lengths."""
        tokens = b.column("tokens")
        size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = pc.index_in(tokens.flatten(), value_set=vocabulary)
        doc = np.repeat(np.arange(len(size)), size)
        hit = pc.is_valid(found).to_numpy(zero_copy_only=False)
        term = pc.fill_null(found, 0).to_numpy(zero_copy_only=False)[hit].astype(np.int64)
        cell, tf = np.unique(doc[hit] * max(1, len(vocabulary)) + term, return_counts=True)
        return cell // max(1, len(vocabulary)), cell % max(1, len(vocabulary)), tf, size


def query_blocks(queries: DataFrame, cap: int | None) -> Iterator[Block]:
    """The queries (``query_id, tokens``) in blocks; ``cap`` limits the counted repeats of a term."""
    ids, query, terms, count = [], [], [], []
    for r in queries.select("query_id", "tokens").where("query_id is not null and tokens is not null").toLocalIterator():
        own: dict[str, int] = {}
        for t in r.tokens:
            if t is not None:
                own[t] = own.get(t, 0) + 1
        if ids and (len(ids) >= QUERIES or len(terms) + len(own) > TERMS):
            yield Block(ids, np.array(query, np.int64), terms, np.array(count, np.int64))
            ids, query, terms, count = [], [], [], []
        query += [len(ids)] * len(own)
        terms += own
        count += [c if cap is None else min(c, cap) for c in own.values()]
        ids.append(r.query_id)
    if ids:
        yield Block(ids, np.array(query, np.int64), terms, np.array(count, np.int64))


def _count(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = block.value
        df, n, total = np.zeros(len(m.vocabulary), np.int64), 0, 0
        for b in batches:
            _, term, _, size = m.frequencies(b, m.vocabulary)
            df += np.bincount(term, minlength=len(df))
            n, total = n + b.num_rows, total + int(size.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1, -2], pa.int64()), pa.array([*df[some].tolist(), n, total], pa.int64())], ["term", "n"])

    return run


class Best:
    """The best scores of each query so far: (query, place of the document, score)."""

    def __init__(self, n: int, top: int):
        self.top, self.bound = top, np.full(n, 1e-9)  # scores below the bound can be dropped
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, q: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((q, place, score))
        self.size += len(q)
        if self.size > 64 * self.top * len(self.bound):
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, place, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((-score, q))
        q, place, score = q[order], place[order], score[order]
        begin = np.searchsorted(q, np.arange(len(self.bound)))
        last = begin + self.top - 1
        full = last < np.searchsorted(q, np.arange(len(self.bound)), "right")
        self.bound[full] = np.maximum(self.bound[full], score[last[full]])
        keep = score >= self.bound[q]
        self.parts = [(q[keep], place[keep], score[keep])]
        self.size = int(keep.sum())
        return self.parts[0]


def _score(block, k1: float, b: float, boost: bool, top: int, key: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = block.value
        n_queries = len(m.ids)
        best, keys, base = Best(n_queries, top), [], 0
        idf = np.log(1 + (m.n - m.df + 0.5) / (m.df + 0.5))
        each = np.diff(m.first)
        step = max(1, CELLS // max(1, n_queries))
        for batch in batches:
            keys.append(batch.column("doc_id"))
            doc, term, tf, size = m.frequencies(batch, m.vocabulary)
            weight = idf[term] * tf * ((k1 + 1) if boost else 1.0) / (tf + k1 * (1 - b + b * size[doc] / m.mean))
            for lo in range(0, batch.num_rows, step):
                a, z = np.searchsorted(doc, [lo, lo + step])
                if a == z:
                    continue
                times = each[term[a:z]]
                owner = np.repeat(np.arange(a, z), times)
                entry = np.repeat(m.first[term[a:z]], times) + np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
                rows = min(step, batch.num_rows - lo)
                total = np.bincount(m.query[entry] * rows + doc[owner] - lo, m.count[entry] * weight[owner], n_queries * rows).round(6).reshape(n_queries, rows)
                q, d = np.nonzero(total >= best.bound[:, None])
                best.add(q, d + lo + base, total[q, d])
            base += batch.num_rows
        q, place, score = best.prune()
        ids = pa.chunked_array(keys, key).take(pa.array(place)) if keys else pa.chunked_array([pa.array([], key)])
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], key), pa.array(score, pa.float64())], ["q", "doc_id", "score"])

    return run


def top_scores(docs: DataFrame, queries: DataFrame, k1: float, b: float, boost: bool, cap: int | None, top: int) -> DataFrame:
    """``query_id, doc_id, score``: of each query at least its ``top`` best matching documents, ties included."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    docs = docs.select("doc_id", "tokens")
    kind = docs.schema["doc_id"].dataType
    name = queries.schema["query_id"].dataType.simpleString()
    out = None
    for block in query_blocks(queries, cap):
        counts = docs.mapInArrow(_count(spark.sparkContext.broadcast(block)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        total = 0
        for r in counts.toLocalIterator():  # a row a term of the block
            if r.term == -1:
                block.n = r.n
            elif r.term == -2:
                total = r.n
            else:
                block.df[r.term] = r.n
        block.mean = total / block.n if total else 1.0
        found = docs.mapInArrow(_score(spark.sparkContext.broadcast(block), k1, b, boost, top, to_arrow_type(kind)), f"q int, doc_id {kind.simpleString()}, score double")
        names = spark.createDataFrame(list(enumerate(block.ids)), f"q int, query_id {name}")
        found = found.join(F.broadcast(names), "q").select("query_id", "doc_id", "score")  # at most QUERIES rows
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"query_id {name}, doc_id {kind.simpleString()}, score double") if out is None else out
