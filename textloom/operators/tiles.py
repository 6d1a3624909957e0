"""The best documents of many queries: tiles of queries by documents, queries spread over tasks.

Documents are sorted by id and packed once into compressed batches of term numbers, which stay in the checkpoint folder:
each task holds its part of the queries against all of them, read one by one, so that what it returns is final, no
partial ranks are moved and the driver sees no documents, only the counts of each batch.
Inside a tile the common terms are one matrix product and the rare ones are added by their postings. Both are float32
and only choose what may reach a query's present ``top``-th best score, with their error bound added; those few are
summed again in float64. Nothing is left out by it: the result equals that of scoring every pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.lineage import cut

#: Documents of a batch; queries and documents of a tile; queries of a task.
PACK, ROWS, COLUMNS, SHARE = 16_384, 512, 8192, 16_384
#: A term is in the matrix product if it would meet in more than this part of all pairs.
COMMON, MOST_COMMON = 0.001, 1024


@dataclass
class Corpus:
    """What is known of the documents: their batches with the number of documents before each, and how many have a term."""

    vocabulary: list[str]
    fields: int
    df: np.ndarray
    lengths: np.ndarray
    n: int = 0
    packs: DataFrame | None = None
    base: dict[int, int] = field(default_factory=dict)


def _pack(vocabulary, fields: int):
    def out(ids: list, hits: list, sizes: list, lengths: list, size: int) -> pa.RecordBatch:
        """Numbers of the terms found, one after the other by document and field; how many each has; all lengths."""
        key, counts = pa.chunked_array(ids), np.concatenate(sizes)
        sink = pa.BufferOutputStream()
        t = pa.table({"doc_id": key})
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        terms, length = np.concatenate(hits).astype(np.int32), np.concatenate(lengths)
        doc = np.repeat(np.arange(len(counts)), counts.sum(1))
        df = np.bincount(np.unique(doc * size + terms) % size, minlength=size).astype(np.int32)
        blob = [zlib.compress(x, 1) for x in (sink.getvalue().to_pybytes(), terms.tobytes(), counts.astype(np.int32).tobytes(), length.astype(np.int32).tobytes(), df.tobytes())]
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.binary()) for x in blob], pa.array([len(counts)], pa.int64()), pa.array([length.sum(0).tolist()], pa.list_(pa.int64()))], ["ids", "terms", "counts", "lengths", "df", "n", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.string())
        size, parts, n = max(1, len(known)), ([], [], [], []), 0
        for b in batches:
            owners, terms, counts, lengths = [], [], [], []
            for f in range(fields):
                c = b.column(f"f{f}")
                length = pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                found = pc.fill_null(pc.index_in(c.flatten(), value_set=known, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                hit, owner = found >= 0, np.repeat(np.arange(len(length)), length)
                owners.append(owner[hit] * fields + f)
                terms.append(found[hit])
                counts.append(np.bincount(owner[hit], minlength=len(length)))
                lengths.append(length)
            order = np.argsort(np.concatenate(owners), kind="stable")
            for p, x in zip(parts, (b.column("doc_id"), np.concatenate(terms)[order], np.stack(counts, 1), np.stack(lengths, 1)), strict=True):
                p.append(x)
            n += b.num_rows
            if n >= PACK:
                yield out(*parts, size)
                parts, n = ([], [], [], []), 0
        if n:
            yield out(*parts, size)

    return run


def corpus(docs: DataFrame, queries: DataFrame, fields: int) -> Corpus:
    """Documents ``doc_id, f0, f1, ...`` (tokens of each field) packed by the terms of ``queries`` (``tokens``)."""
    sc = docs.sparkSession.sparkContext
    words = queries.select(F.explode("tokens").alias("t")).where("t is not null").distinct()
    known = sorted(r.t for r in words.toLocalIterator())
    c = Corpus(known, fields, np.zeros(max(1, len(known)), np.int64), np.zeros(fields, np.int64))
    rows = docs.where("doc_id is not null").orderBy("doc_id").mapInArrow(_pack(sc.broadcast(known), fields), "ids binary, terms binary, counts binary, lengths binary, df binary, n long, total array<long>")
    c.packs = cut(rows.withColumn("pack", F.monotonically_increasing_id()))
    for r in c.packs.select("pack", "df", "n", "total").toLocalIterator():  # in the order of the ids
        c.df += np.frombuffer(zlib.decompress(r.df), np.int32)
        c.lengths += np.array(r.total)
        c.base[r.pack] = c.n
        c.n += r.n
    return c


@dataclass
class Weights:
    """A term's weight in a document: ``idf * x / (k1 + x)``, x the sum over its occurrences of the field's weight by its
    normalised length; of an ``extra`` term or without ``k1`` it is ``idf``. A document counts only where it has another
    term than the ``extra`` ones.
    Scores are rounded to ``digits``."""

    idf: np.ndarray
    field: np.ndarray
    b: np.ndarray
    mean: np.ndarray
    k1: float | None
    extra: np.ndarray | None = None
    digits: int = 6

    def of(self, batch: tuple, fields: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Documents of a batch; document, term and weight of each posting."""
        terms, counts, lengths = (np.frombuffer(zlib.decompress(x), np.int32) for x in batch[1:])
        lengths = lengths.reshape(-1, fields)
        n, v = len(lengths), len(self.idf)
        share = self.field / (1 - self.b + self.b * lengths / self.mean)
        key, at = np.unique(np.repeat(np.arange(n), counts.reshape(-1, fields).sum(1)) * v + terms, return_inverse=True)
        doc, term = key // v, key % v
        if self.k1 is None:
            return n, doc, term, self.idf[term]
        x = np.bincount(at, np.repeat(share.ravel(), counts), len(key))
        x = self.idf[term] * x / (self.k1 + x)
        return n, doc, term, x if self.extra is None else np.where(self.extra[term], self.idf[term], x)


class Part:
    """The queries of a tile: rare entries by term, the matrix of the common ones, and the best scores so far."""

    def __init__(self, query: np.ndarray, term: np.ndarray, count: np.ndarray, rows: int, w: Weights, slot: np.ndarray, common: int, top: int):
        v = len(w.idf)
        self.rows, self.top, self.digits, self.query, self.count = rows, top, w.digits, query, count.astype(np.float32)
        self.terms, self.local = np.unique(term, return_inverse=True)
        self.remap = np.full(v, len(self.terms))
        self.remap[self.terms] = np.arange(len(self.terms))
        self.dense = np.zeros((rows, common), np.float32)
        dense = slot[term] >= 0
        self.dense[query[dense], slot[term[dense]]] = count[dense]
        order = np.argsort(term[~dense], kind="stable")
        self.rare, self.rare_count = query[~dense][order], self.count[~dense][order]
        self.first = np.searchsorted(term[~dense][order], np.arange(v + 1))
        self.each = np.diff(self.first)
        # of a sum in float32: a rounding for each term and of each weight
        self.error = np.bincount(query, count * w.idf[term], rows) * (np.bincount(query, minlength=rows) + 8) * 1.2e-7 + 10.0**-w.digits
        self.bound, self.seen = np.full(rows, 1e-9), 0
        self.best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def table(self) -> np.ndarray:
        x = np.zeros((self.rows, len(self.terms) + 1), np.float32)
        x[self.query, self.local] = self.count
        return x

    def add(self, q: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        new = np.zeros(self.rows, bool)
        new[q] = True
        old = new[self.best[0]]
        rest = [x[~old] for x in self.best]
        q, place, score = (np.concatenate([x[old], y]) for x, y in zip(self.best, (q, place, score), strict=True))
        order = np.lexsort((place, -score, q))
        q, place, score = q[order], place[order], score[order]
        nth = np.arange(len(q)) - np.searchsorted(q, np.arange(self.rows))[q]
        last = nth == self.top - 1
        self.bound[q[last]] = score[last]
        keep = nth < self.top
        self.best = tuple(np.concatenate([x, y[keep]]) for x, y in zip(rest, (q, place, score), strict=True))


def _add(c: np.ndarray, p: Part, rare: tuple, only: bool = False) -> None:
    # ``only``: to what has something already; weights are positive, so zero is exact
    doc, term, weight = rare
    some = np.flatnonzero(p.each[term])
    if len(some):
        times = p.each[term[some]]
        owner = np.repeat(some, times)
        entry = np.repeat(p.first[term[some]] - np.cumsum(times) + times, times) + np.arange(len(owner))
        flat, cell, x = c.reshape(-1), p.rare[entry] * c.shape[1] + doc[owner], weight[owner] * p.rare_count[entry]
        if only:
            some = flat[cell] > 0
            cell, x = cell[some], x[some]
        np.add.at(flat, cell, x)


def _tile(p: Part, table: np.ndarray, plain: int, dense: np.ndarray, rare: tuple, extra: tuple, whole: tuple, columns: int, base: int) -> None:
    c = p.dense[:, :plain] @ dense[:plain]
    _add(c, p, rare)
    if plain < len(dense):
        c += (p.dense[:, plain:] @ dense[plain:]) * (c > 0)
    _add(c, p, extra, only=True)
    low = p.bound - p.error
    hit = c > np.maximum(low, 1e-12).astype(np.float32)[:, None]
    many = np.flatnonzero(np.count_nonzero(hit, 1) > 2 * p.top)
    if len(many):
        x = c[many]
        nth = np.partition(x, columns - p.top, axis=1)[:, columns - p.top]
        hit[many] &= x >= (nth - 2 * p.error[many])[:, None]
    at = np.flatnonzero(hit)
    if not len(at):
        return
    q, d = at // columns, at % columns
    first, term, weight = whole
    times = first[d + 1] - first[d]
    owner = np.repeat(np.arange(len(at)), times)
    entry = np.repeat(first[d] - np.cumsum(times) + times, times) + np.arange(len(owner))
    w = table[q[owner], p.remap[term[entry]]] * weight[entry]
    score = np.bincount(owner, w, len(at)).round(p.digits)
    keep = score >= p.bound[q] if base < p.seen else score > p.bound[q]  # ties go to the smaller id, as batches mostly come in order
    if keep.any():
        p.add(q[keep], d[keep] + base, score[keep])


class Share:
    """A task's queries: their ids, the common terms in the order of the matrix (``plain`` of them not extra), and the parts."""

    def __init__(self, ids: pa.Array, query: np.ndarray, term: np.ndarray, count: np.ndarray, w: Weights, df: np.ndarray, n: int, top: int):
        v = len(w.idf)
        pairs = np.bincount(term, minlength=v) * df.astype(float)
        common = np.flatnonzero(pairs > COMMON * len(ids) * n)
        common = common[np.argsort(-pairs[common], kind="stable")][:MOST_COMMON]
        extra = np.zeros(v, bool) if w.extra is None else w.extra
        common = common[np.argsort(extra[common], kind="stable")]
        self.ids, self.extra, self.common, self.plain = ids, extra, len(common), len(common) - int(extra[common].sum())
        self.slot = np.full(v, -1)
        self.slot[common] = np.arange(len(common))
        self.parts = []
        for lo in range(0, len(ids), ROWS):
            a, z = np.searchsorted(query, [lo, lo + ROWS])
            self.parts.append(Part(query[a:z] - lo, term[a:z], count[a:z], min(ROWS, len(ids) - lo), w, self.slot, len(common), top))

    def tiles(self, size: int, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, base: int) -> Iterator[tuple]:
        """Of a batch's postings, ``COLUMNS`` documents at a time: the matrix, the rare postings, the extra ones, all by document."""
        for lo in range(0, size, COLUMNS):
            columns = min(COLUMNS, size - lo)
            a, z = np.searchsorted(doc, [lo, lo + columns])
            d, m, x = doc[a:z] - lo, term[a:z], weight[a:z]
            s = self.slot[m]
            dense = np.zeros((self.common, columns), np.float32)
            dense[s[s >= 0], d[s >= 0]] = x[s >= 0]
            rare, more = (s < 0) & ~self.extra[m], (s < 0) & self.extra[m]
            yield self.plain, dense, *[(d[r], m[r], x[r].astype(np.float32)) for r in (rare, more)], (np.searchsorted(d, np.arange(columns + 1)), m, x), columns, base + lo


def _shares(known, cap: int | None):
    """A task's queries as one row: their ids, and query, term and count of what they have of the known terms."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = [b for b in frames if b.num_rows]
        if not frames:
            return
        t = pa.Table.from_batches(frames).combine_chunks()
        v = max(1, len(known.value))
        tokens = t.column("tokens").combine_chunks()
        tokens = tokens.chunk(0) if isinstance(tokens, pa.ChunkedArray) else tokens
        length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = pc.fill_null(pc.index_in(tokens.flatten(), value_set=pa.array(known.value, pa.string()), skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        cell, count = np.unique((np.repeat(np.arange(len(length)), length) * v + found)[found >= 0], return_counts=True)
        sink = pa.BufferOutputStream()
        names = t.select(["query_id"])
        with pa.ipc.new_stream(sink, names.schema) as w:
            w.write_table(names)
        blob = [zlib.compress(x, 1) for x in (sink.getvalue().to_pybytes(), cell.tobytes(), (count if cap is None else np.minimum(count, cap)).astype(np.int32).tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), *[pa.array([x], pa.binary()) for x in blob]], ["share", "names", "cells", "times"])

    return run


def _met(frames: Iterator[pa.RecordBatch], weights, base: dict[int, int], df: np.ndarray, n: int, fields: int, top: int, shares: dict[int, Share]) -> Iterator[tuple[Share, pa.Array, Iterator[tuple], int]]:
    """Each share with each batch of documents: the share, the batch's ids, its tiles, the documents before it."""
    w = weights.value
    for b in frames:
        for i in range(b.num_rows):
            r = {c: b.column(c)[i].as_py() for c in ("share", "pack", "ids", "terms", "counts", "lengths")}
            if r["share"] not in shares:
                names, cells, times = (zlib.decompress(b.column(c)[i].as_py()) for c in ("names", "cells", "times"))
                names = pa.ipc.open_stream(names).read_all().column(0).combine_chunks()
                cells = np.frombuffer(cells, np.int64)
                shares[r["share"]] = Share(names.chunk(0) if isinstance(names, pa.ChunkedArray) else names, cells // len(w.idf), cells % len(w.idf), np.frombuffer(times, np.int32), w, df, n, top)
            share = shares[r["share"]]
            ids = pa.ipc.open_stream(zlib.decompress(r["ids"])).read_all().column(0).combine_chunks()
            first = base[r["pack"]]
            yield share, ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids, share.tiles(*w.of(tuple(r[c] for c in ("ids", "terms", "counts", "lengths")), fields), first), first


def _against(c: Corpus, queries: DataFrame, cap: int | None, run, schema: str) -> DataFrame:
    """``run`` on every share of the queries with every batch of the documents; a task has one share."""
    queries = queries.select("query_id", "tokens").where("query_id is not null and tokens is not null")
    sc = queries.sparkSession.sparkContext
    parts = max(sc.defaultParallelism, -(-queries.count() // SHARE))
    shares = queries.repartition(parts).mapInArrow(_shares(sc.broadcast(c.vocabulary), cap), "share long, names binary, cells binary, times binary")
    packs = c.packs.select("pack", "ids", "terms", "counts", "lengths").coalesce(1).hint("shuffle_replicate_nl")  # read by every task, not broadcast
    return shares.crossJoin(packs).mapInArrow(run, schema)


def _best(weights, base: dict[int, int], df: np.ndarray, n: int, fields: int, top: int, key: pa.DataType):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares: dict[int, Share] = {}
        every: dict[int, pa.Array] = {}
        for share, ids, tiles, first in _met(frames, weights, base, df, n, fields, top, shares):
            every[first] = ids
            tiles = list(tiles)
            for p in share.parts:
                table = p.table()
                for tile in tiles:
                    _tile(p, table, *tile)
                p.seen = max(p.seen, first + len(ids))
        ids = pa.chunked_array([every[k] for k in sorted(every)], key)
        for share in shares.values():
            for i, p in enumerate(share.parts):
                q, place, score = p.best
                yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (share.ids.take(pa.array(q + i * ROWS)), ids.take(pa.array(place)), pa.array(score, pa.float64()))], ["query_id", "doc_id", "score"])

    return run


def best(c: Corpus, weights: Weights, docs: DataFrame, queries: DataFrame, cap: int | None, top: int) -> DataFrame:
    """``query_id, doc_id, score``: the ``top`` best documents with a score of each query, ties by the smaller id."""
    from pyspark.sql.pandas.types import to_arrow_type

    sc = docs.sparkSession.sparkContext
    kind, name = docs.schema["doc_id"].dataType, queries.schema["query_id"].dataType.simpleString()
    run = _best(sc.broadcast(weights), c.base, c.df, c.n, c.fields, top, to_arrow_type(kind))
    return _against(c, queries, cap, run, f"query_id {name}, doc_id {kind.simpleString()}, score double")


#: Pairs that are summed at a time.
PAIRS = 200_000


def _overlap(weights, base: dict[int, int], df: np.ndarray, n: int, size: int, least: int, share: float, factor: float):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = lambda x: np.floor(x * 1e5 + 0.5) / 1e5
        w = weights.value
        for own, ids, tiles, first in _met(frames, weights, base, df, n, 1, 1, {}):
            for _, dense, rare, _, (at, term, weight), columns, place in tiles:
                each = np.diff(at)
                total = np.bincount(np.repeat(np.arange(columns), each), weight, columns)
                low = np.where(each >= size, share * total * (1 - 1e-5), np.inf).astype(np.float32)
                for i, p in enumerate(own.parts):
                    c = p.dense @ dense
                    _add(c, p, rare)
                    c -= low
                    met = np.flatnonzero(c >= -p.error.astype(np.float32)[:, None])
                    del c
                    whole = np.bincount(p.query, w.idf[p.terms[p.local]], p.rows)
                    table = p.table()
                    for lo in range(0, len(met), PAIRS):
                        q, d = np.divmod(met[lo : lo + PAIRS], columns)
                        times = each[d]
                        begin = np.cumsum(times) - times
                        entry = np.repeat(at[d] - begin, times) + np.arange(times.sum())
                        has = table[np.repeat(q, times), p.remap[term[entry]]]
                        matches = np.add.reduceat(has, begin).astype(np.int64)
                        s = np.add.reduceat(has * weight[entry], begin)
                        x = s / total[d]
                        keep = (matches >= least) & (np.floor(x * 1e9 + 0.5) / 1e9 >= share)
                        q, d, x, s = q[keep], d[keep], x[keep], s[keep]
                        yield pa.RecordBatch.from_arrays([own.ids.take(pa.array(q + i * ROWS)), ids.take(pa.array(d + place - first)), pa.array(matches[keep]), *[pa.array(nearest(y)) for y in (x, 2 * s / (total[d] + whole[q]), factor * x * x)]], ["query_id", "doc_id", "matches", "coverage", "dice", "bonus"])

    return run


def overlaps(docs: DataFrame, queries: DataFrame, size: int, least: int, share: float, factor: float) -> DataFrame:
    """``query_id, doc_id, matches, coverage, dice, bonus`` where a document of ``size`` different tokens has ``least`` in
    common with a query and ``share`` of their weight; ``bonus`` is ``factor`` times the square of the coverage.

    A token of ``df`` of ``n`` documents (``doc_id``, ``f0``) weighs ``log(1 + n / df)``; documents without tokens do not count.
    """
    sc = docs.sparkSession.sparkContext
    c = corpus(docs.where("size(f0) > 0"), docs.select(F.col("f0").alias("tokens")), 1)
    kind, name = (x.schema[k].dataType.simpleString() for x, k in ((docs, "doc_id"), (queries, "query_id")))
    one = np.ones(1)
    w = Weights(np.log(1 + c.n / np.maximum(1, c.df)), one, one * 0, one, None)
    run = _overlap(sc.broadcast(w), c.base, c.df, c.n, size, least, share, factor)
    return _against(c, queries, 1, run, f"query_id {name}, doc_id {kind}, matches long, coverage double, dice double, bonus double")


def bm25f(docs: DataFrame, queries: DataFrame, weights: list[float], bs: list[float], k1: float, cap: int | None, top: int, boost: float = 1.0) -> DataFrame:
    """Field-weighted BM25 of ``doc_id, f0, f1, ...`` as ``lexical.bm25f`` has it, with one field that of ``lexical.bm25``."""
    c = corpus(docs, queries, len(weights))
    mean = np.where(c.lengths > 0, c.lengths / max(1, c.n), 1.0)
    idf = boost * np.log(1 + (c.n - c.df + 0.5) / (c.df + 0.5))
    return best(c, Weights(idf, np.array(weights, float), np.array(bs, float), mean, k1), docs, queries, cap, top)
