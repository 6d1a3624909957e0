"""Problem 6: evaluation texts leaking into training text, by latent semantic retrieval.

Terms are the 6-character substrings of the plain form. Evaluation passages are TF-IDF vectors with document
frequencies counted over the whole corpus. Passages are taken in latent spaces of at most ``SPACE`` each; a randomised
SVD of every space runs in a task of its own and keeps ``RANK`` directions. A corpus document is read as windows of 90
plain characters, one every 30, so that 60 consecutive characters always lie within one window. A window is folded
into a space through its products with the space's passages, as the directions are combinations of them; no matrix of
terms by rank is ever made. Its cosine with a passage there, together with what the truncation may hide at most (the
product of the two residuals, by Cauchy-Schwarz), must reach what the weakest 60 characters of the passage would give;
so no rank loses a pair, a lower one only leaves more to check. Candidates are checked exactly: a common run of
``least`` plain characters is a leak.

A paraphrase is a stretch of a document whose cosine with a passage in the latent space is ``COSINE`` or more, that has
a common subsequence of 0.8 of the passage within one and a quarter of its length, in a document that holds half of
the passage's codes and amounts (its answer).

The passages are the stated query set: they are broadcast in blocks of at most ``PASS_CHARS`` characters, each of which
is held against all documents; there is no limit to their number. Nulls: rows with a null id or text, and passages
under ``least`` plain characters, match nothing. Repeated items and documents count once. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import text as X

#: Characters of passages held by every task at a time.
PASS_CHARS = 2_000_000
SPACE, RANK = 128, 96
#: The least cosine of a paraphrase's window with its passage.
COSINE = 0.08
N, WINDOW, STRIDE = 6, 90, 30
SLOTS = 1 << 20


class Vocabulary:
    """The terms of the passages: sorted hashes, found through a table of ``SLOTS`` flags."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.flags = np.zeros(SLOTS, bool)
        self.flags[terms & np.uint32(SLOTS - 1)] = True

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``g`` that hold a term, and the terms' numbers."""
        at = np.flatnonzero(self.flags[g & np.uint32(SLOTS - 1)])
        if not len(self.terms):
            return at[:0], at[:0]
        n = np.minimum(np.searchsorted(self.terms, g[at]), len(self.terms) - 1)
        hit = self.terms[n] == g[at]
        return at[hit], n[hit]


def _document_frequencies(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(terms.value)
        df, n = np.zeros(len(v.terms), np.int64), 0
        for b in batches:
            g, starts = X.grams([X.plain_form(s) for s in b.column(0).to_pylist()], N)
            at, term = v.find(g)
            doc = np.searchsorted(starts, at, "right") - 1
            pairs = np.unique(doc.astype(np.int64) * max(1, len(v.terms)) + term)
            df += np.bincount(pairs % max(1, len(v.terms)), minlength=len(v.terms))
            n += b.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1], pa.int64()), pa.array([*df[some].tolist(), n], pa.int64())], ["term", "n"])

    return run


def _times(row: np.ndarray, column: np.ndarray, weight: np.ndarray, m: np.ndarray, n_rows: int) -> np.ndarray:
    """The sparse matrix of (row, column, weight) times ``m``."""
    out = np.zeros((n_rows, m.shape[1]))
    order = np.argsort(row, kind="stable")
    row = row[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    if len(first):
        out[row[first]] = np.add.reduceat(weight[order][:, None] * m[column[order]], first, axis=0)
    return out


def randomised_svd(item: np.ndarray, term: np.ndarray, weight: np.ndarray, n_items: int, rank: int, power: int = 2, oversample: int = 10, seed: int = 5) -> np.ndarray:
    """``n_items x rank``: left singular vectors over singular values of the sparse matrix; its transpose times the
    result are the latent directions."""
    q = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((n_items, min(n_items, rank + oversample))))[0]
    _, column = np.unique(term, return_inverse=True)
    n_terms = int(column.max()) + 1 if len(column) else 0
    product = lambda q: _times(item, column, weight, _times(column, item, weight, q, n_terms), n_items)
    for _ in range(power):
        q = np.linalg.qr(product(q))[0]
    values, vectors = np.linalg.eigh(q.T @ product(q))
    best = np.argsort(-values)[:rank]
    best = best[values[best] > 1e-6 * max(values.max(), 1e-30)]
    return q @ vectors[:, best] / np.sqrt(values[best])


def _latent_space(rank: int):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        n = int(p.item.max()) + 1
        m = randomised_svd(p.item.to_numpy(), p.term.to_numpy(), p.weight.to_numpy(), n, rank)
        # the products of passages with each other, folded in like those of a window
        _, column = np.unique(p.term, return_inverse=True)
        a = np.zeros((n, m.shape[1]))
        step = 4096
        for lo in range(0, int(column.max()) + 1, step):
            mine = (column >= lo) & (column < lo + step)
            part = np.zeros((n, step))
            part[p.item[mine], column[mine] - lo] = p.weight[mine]
            a += part @ (part.T @ m)
        return pd.DataFrame({"space": [int(p.space.iloc[0])], "rank": [m.shape[1]], "fold": [m.astype(np.float32).tobytes()], "latent": [a.astype(np.float32).tobytes()]})

    return run


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    all_ones = (1 << len(a)) - 1
    v = all_ones
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & all_ones
    return len(a) - v.bit_count()


def common_run(p: str, s: str, least: int) -> bool:
    """True if ``least`` consecutive characters of ``p`` are in ``s``: such a run holds a whole piece of half of it."""
    half = max(1, least // 2)
    for i in range(0, len(p) - half + 1, half):
        piece = p[i : i + half]
        at = s.find(piece)
        while at >= 0:
            lo, hi = 0, half
            while lo < i and lo < at and p[i - lo - 1] == s[at - lo - 1]:
                lo += 1
            while i + hi < len(p) and at + hi < len(s) and p[i + hi] == s[at + hi]:
                hi += 1
            if lo + hi >= least:
                return True
            at = s.find(piece, at + 1)
    return False


def local_subsequence(p: str, s: str, starts: list[int]) -> float:
    """The greatest share of ``p`` that is a common subsequence with a stretch of a quarter more than its length.

    Stretches begin every eighth of ``p`` about the windows at ``starts``.
    """
    n, wide, best = len(p), len(p) + len(p) // 4, 0
    step = max(1, n // 8)
    froms = {max(0, f) for a in starts for f in range(a - n, a + WINDOW, step)}
    have = Counter(p)
    for f in sorted(froms):
        stretch = s[f : f + wide]
        if (have & Counter(stretch)).total() > best:  # no common subsequence is longer
            best = max(best, lcs_length(p, stretch))
    return best / n


_ANSWER = re.compile(r"[A-Z]{2,4}-?\d{4,6}|\d[\d,.]*\d(?:만)?|\d+%")


class Model:
    """The passages of one pass with their latent spaces; what every task holds."""

    def __init__(self, ids: list[int], plains: list[str], answers: list[list[str]], terms: np.ndarray, starts: np.ndarray, number: np.ndarray, least: int):
        self.ids, self.plains, self.answers, self.terms, self.least = ids, plains, answers, terms, least
        own = [np.unique(number[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
        self.item = np.repeat(np.arange(len(own)), [len(u) for u in own])
        self.term = np.concatenate(own)
        order = np.lexsort((self.item, self.term))
        self.item, self.term = self.item[order], self.term[order]
        self.first = np.searchsorted(self.term, np.arange(len(terms) + 1))
        n_spaces = -(-len(ids) // SPACE)
        self.edges = np.arange(n_spaces + 1) * len(ids) // n_spaces
        self.space = np.searchsorted(self.edges, np.arange(len(ids)), "right") - 1

    def weigh(self, idf: np.ndarray, starts: np.ndarray, number: np.ndarray) -> None:
        """Weights of terms, and the least product with a passage that ``least`` characters of it give."""
        self.idf = idf
        self.bar = np.zeros(len(self.ids))
        length = self.least - N + 1
        for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            t = number[a:b]
            if len(np.unique(t)) == len(t):
                run = np.concatenate([[0.0], np.cumsum(idf[t] ** 2)])
                self.bar[i] = (run[length:] - run[:-length]).min()
            else:  # a term that occurs twice in a run counts once
                self.bar[i] = min((idf[np.unique(t[j : j + length])] ** 2).sum() for j in range(len(t) - length + 1))

    def entries(self) -> pd.DataFrame:
        return pd.DataFrame({"space": self.space[self.item], "item": self.item - self.edges[self.space[self.item]], "term": self.term, "weight": self.idf[self.term]})

    def add_spaces(self, rows) -> None:
        self.fold, self.latent = {}, {}
        energy = np.bincount(self.item, self.idf[self.term] ** 2, len(self.ids))
        self.norm = np.sqrt(energy)
        self.residual = np.zeros(len(self.ids))
        for r in rows:
            lo, hi = self.edges[r.space], self.edges[r.space + 1]
            self.fold[r.space] = np.frombuffer(r.fold, np.float32).reshape(hi - lo, r["rank"])
            self.latent[r.space] = np.frombuffer(r.latent, np.float32).reshape(hi - lo, r["rank"])
            self.residual[lo:hi] = np.sqrt(np.maximum(energy[lo:hi] - (self.latent[r.space].astype(np.float64) ** 2).sum(1), 0))


def candidates(m: Model, v: Vocabulary, g: np.ndarray, starts: np.ndarray, cosine: float | None) -> tuple[set[tuple[int, int]], dict[tuple[int, int], list[int]]]:
    """Pairs of a text and a passage that may share a run, and the windows of those that may be paraphrases."""
    exact: set[tuple[int, int]] = set()
    para: dict[tuple[int, int], list[int]] = {}
    at, term = v.find(g)
    if not len(at):
        return exact, para
    w2 = (m.idf**2).astype(np.float64)
    k = WINDOW // STRIDE
    doc = np.searchsorted(starts, at, "right") - 1
    first = np.zeros(len(starts), np.int64)
    np.cumsum(-(-np.diff(starts) // STRIDE), out=first[1:])
    block = first[doc] + (at - starts[doc]) // STRIDE
    energy = np.bincount(block, w2[term], minlength=first[-1])
    whole = energy.copy()
    for i in range(1, k):
        whole[:-i] += energy[i:]
    floor = m.bar.min() if cosine is None else min(m.bar.min(), 5 * w2.mean())
    live = whole >= floor * (1 - 1e-6)
    # occurrences of the windows that start at their block or one of those before, in the same text
    win, what = [], []
    for i in range(k):
        w = block - i
        ok = (w >= first[doc]) & live[np.maximum(w, 0)]
        win.append(w[ok])
        what.append(term[ok])
    pair = np.unique(np.concatenate(win) * len(m.terms) + np.concatenate(what))
    if not len(pair):
        return exact, para
    win, what = pair // len(m.terms), pair % len(m.terms)
    windows, win = np.unique(win, return_inverse=True)
    # every passage that holds a term of a window
    count = m.first[what + 1] - m.first[what]
    owner = np.repeat(np.arange(len(what)), count)
    item = m.item[np.repeat(m.first[what], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    space = m.space[item]
    own_doc = np.searchsorted(first, windows, "right") - 1
    for s in np.unique(space).tolist():
        lo, hi = int(m.edges[s]), int(m.edges[s + 1])
        mine = np.flatnonzero(space == s)
        o = owner[mine]
        fresh = np.diff(o, prepend=-1) != 0  # a term counts once for the window's energy
        e = np.bincount(win[o[fresh]], w2[what[o[fresh]]], len(windows))
        bar, floor = m.bar[lo:hi], m.bar[lo:hi].min() if cosine is None else min(m.bar[lo:hi].min(), 5 * w2.mean())
        some = np.flatnonzero(e >= floor * (1 - 1e-6))
        if not len(some):
            continue
        row = np.full(len(windows), -1)
        row[some] = np.arange(len(some))
        keep = row[win[o]] >= 0
        cell = row[win[o[keep]]] * (hi - lo) + item[mine[keep]] - lo
        for a in range(0, len(some), 4096):
            b = min(len(some), a + 4096)
            inside = (cell >= a * (hi - lo)) & (cell < b * (hi - lo))
            y = np.bincount(cell[inside] - a * (hi - lo), w2[what[o[keep][inside]]], (b - a) * (hi - lo)).reshape(b - a, hi - lo)
            z = y.astype(np.float32) @ m.fold[s]
            estimate = (z @ m.latent[s].T).astype(np.float64)
            hidden = np.sqrt(np.maximum(e[some[a:b]] - (z.astype(np.float64) ** 2).sum(1), 0))
            bound = estimate + hidden[:, None] * m.residual[lo:hi][None] + 1e-3 * bar[None]
            r, i = np.nonzero(bound >= bar[None])
            exact.update(zip(own_doc[some[a + r]].tolist(), (i + lo).tolist(), strict=True))
            if cosine is not None:
                # terms of the window that no passage has weigh as much as the rarest
                size = np.minimum(starts[own_doc[some[a:b]] + 1] - starts[own_doc[some[a:b]]] - (windows[some[a:b]] - first[own_doc[some[a:b]]]) * STRIDE, WINDOW)
                full = np.sqrt(size * float(m.idf.max()) ** 2)
                r, i = np.nonzero(estimate >= cosine * full[:, None] * m.norm[lo:hi][None])
                for x, y in zip(some[a + r].tolist(), (i + lo).tolist(), strict=True):
                    d = int(own_doc[x])
                    para.setdefault((d, y), []).append(int(windows[x] - first[d]) * STRIDE)
    return exact, para


def _search(model, paraphrases: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        v = Vocabulary(m.terms)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                keys, raw = (c.to_pylist() for c in b.slice(lo, 1024).columns)
                texts = [X.plain_form(s) for s in raw]
                g, starts = X.grams(texts, N)
                exact, para = candidates(m, v, g, starts, COSINE if paraphrases else None)
                rows = [(keys[d], m.ids[i], "exact", 1.0, 1.0) for d, i in sorted(exact) if common_run(m.plains[i], texts[d], m.least)]
                told = {(k, i) for k, i, *_ in rows}
                for (d, i), at in sorted(para.items()):
                    own = m.answers[i]
                    share = sum(a in raw[d] for a in own) / len(own) if own else 0.0
                    if share >= 0.5 and (keys[d], m.ids[i]) not in told:
                        like = local_subsequence(m.plains[i], texts[d], at)
                        if like >= 0.8:
                            rows.append((keys[d], m.ids[i], "paraphrase", like, share))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = (b.column(0).type, pa.int64(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "kind", "common", "answer"])

    return run


def _passes(items: DataFrame, least: int) -> Iterator[list[tuple[int, str, str]]]:
    """The passages with a plain form of ``least`` characters, in blocks of at most ``PASS_CHARS`` (or one passage)."""
    kept = items.where("item_id is not null and passage is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("passage").alias("passage"))
    out, size = [], 0
    for r in kept.orderBy("item_id").toLocalIterator():
        plain = X.plain_form(r.passage)
        if len(plain) < least:
            continue
        if out and size + len(plain) > PASS_CHARS:
            yield out
            out, size = [], 0
        out.append((r.item_id, r.passage, plain))
        size += len(plain)
    if out:
        yield out


def _model(docs: DataFrame, kept: list[tuple[int, str, str]], least: int, rank: int) -> Model:
    spark = docs.sparkSession
    sc = spark.sparkContext
    plains = [p for _, _, p in kept]
    g, starts = X.grams(plains, N)
    terms, number = np.unique(g, return_inverse=True)
    m = Model([i for i, _, _ in kept], plains, [sorted(set(_ANSWER.findall(p))) for _, p, _ in kept], terms, starts, number, least)
    counts = docs.select("text").mapInArrow(_document_frequencies(sc.broadcast(terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df, total = np.zeros(len(terms), np.int64), 0
    for r in counts.toLocalIterator():  # at most one row a term of the block
        if r.term < 0:
            total = r.n
        else:
            df[r.term] = r.n
    m.weigh(np.log((total + 1) / (df + 1)) + 0.01, starts, number)
    entries = spark.createDataFrame(m.entries())
    m.add_spaces(entries.groupBy("space").applyInPandas(_latent_space(rank), "space int, rank int, fold binary, latent binary").toLocalIterator())
    return m


def leaks(documents: DataFrame, items: DataFrame, least: int = 60, rank: int = RANK, paraphrases: bool = False) -> DataFrame:
    """``doc_id, item_id, kind, common, answer``: documents with a passage, 'exact' or (if asked) 'paraphrase'."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    schema = "doc_id long, item_id long, kind string, common double, answer double"
    out = None
    for kept in _passes(items, least):
        model = spark.sparkContext.broadcast(_model(docs, kept, least, rank))
        found = docs.mapInArrow(_search(model, paraphrases), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out.distinct()
