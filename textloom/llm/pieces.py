"""Problem 3: cutting oversized texts at natural boundaries, by byte ranges.

Every text, short or long, from a column or from a file, is taken in ranges of its bytes with halos on both sides.
Workers count the characters of their range and find its boundaries; what kind a boundary has depends on the 16
characters before it and the one after, so every worker that sees a position agrees on it. The last cut of a range, its
anchor, is the best boundary in the last half piece before the range's end; the halo lets the next range find the same
anchor. From anchor to anchor a range is cut greedily: the next cut is the latest boundary of the best kind (paragraph,
line, sentence, word) within the size limit, or the limit where there is none. A prefix sum over the ranges' counts
turns local offsets and numbers into global ones, and every range emits its own pieces with the overlap before them.
No range reads more than its halos beyond itself, and nothing is carried from range to range but two counts.

Pieces have at most size characters and the overlap, exactly ``overlap`` characters but at the text's start. Nulls: rows
with a null id, text or size are left out, a null overlap is 0. Empty texts and texts of at most size + overlap
characters have no pieces. A repeated id is cut once (its smallest text, if they differ). Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_BYTES = 1 << 14
#: Characters before a boundary that decide its kind; of a longer run of white space only the end counts.
CONTEXT = 16
RANGE = "id string, size int, overlap int, range_no int, last boolean, data binary, skip int, width int"
PIECE = "id string, piece_no long, char_start long, char_end long, core_start long, text string"
WORD, SENTENCE, LINE, PARAGRAPH = 1, 2, 3, 4

_SPACES = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_STOPS = np.array([*map(ord, ".!?…。！？")], np.uint32)
_WIDE_STOPS = np.array([*map(ord, "。！？")], np.uint32)
_CLOSERS = np.array([*map(ord, "\"'”’)]」』")], np.uint32)


def boundaries(s: str) -> np.ndarray:
    """For every offset 0..len(s) the kind of boundary there is between its two characters, 0 for none."""
    a = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(a)
    kind = np.zeros(n + 1, np.int8)
    if n < 2:
        return kind
    space = np.isin(a, _SPACES)
    stop, closer = np.isin(a, _STOPS), np.isin(a, _CLOSERS)
    wide = np.isin(a, _WIDE_STOPS)
    newline = np.isin(a, np.array([10, 11, 12, 0x85, 0x2028, 0x2029], np.uint32))
    newline |= (a == 13) & np.append(a[1:] != 10, True)
    kind[1:n][wide[:-1] & ~stop[1:] & ~closer[1:] & ~space[1:]] = SENTENCE
    at = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if len(at):
        lines = np.concatenate([[0], np.cumsum(newline)])
        solid = np.maximum.accumulate(np.where(space, -1, np.arange(n)))[at - 1]  # the last character that is no blank
        begin = np.maximum(solid + 1, at - CONTEXT)
        n_lines = lines[at] - lines[begin]
        near = (solid >= 0) & (solid >= at - CONTEXT)
        before = np.maximum(solid, 0)
        ends = near & (stop[before] | (closer[before] & stop[np.maximum(before - 1, 0)] & (before > 0)))
        kind[at] = np.where(n_lines > 1, PARAGRAPH, np.where(n_lines == 1, LINE, np.where(ends, SENTENCE, WORD)))
    return kind


def best_cut(kind: np.ndarray, lo: int, hi: int) -> int:
    """The latest offset of the best kind in lo < offset <= hi; ``hi`` if there is no boundary."""
    part = kind[lo + 1 : hi + 1][::-1]
    i = int(part.argmax()) if len(part) else 0
    return hi - i


def cuts(kind: np.ndarray, start: int, end: int, size: int) -> list[int]:
    """The cuts strictly between ``start`` and ``end``."""
    out, at = [], start
    while end - at > size:
        at = best_cut(kind, at, at + size)
        out.append(at)
    return out


def oversized(df: DataFrame, id_col: str, text_col: str, size: Column, overlap: Column) -> DataFrame:
    """``id, text, size, overlap`` of the texts over their limit, once an id."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), size.cast("int").alias("size"), F.coalesce(overlap.cast("int"), F.lit(0)).alias("overlap"))
    rows = rows.where("id is not null and text is not null and size > 0 and char_length(text) > size + overlap")
    return rows.groupBy("id").agg(F.min(F.struct("text", "size", "overlap")).alias("x")).select("id", "x.*")


def halo(size: int, overlap: int) -> int:
    """Bytes that a range must see on either side: half a piece, the overlap and the context, of four bytes each."""
    return 4 * (size + overlap + CONTEXT + 2)


def range_width(size: int, overlap: int, range_bytes: int) -> int:
    """Bytes of a range: wide enough that its anchor lies behind the one before it, whatever the characters."""
    return max(range_bytes, 4 * halo(size, overlap))


def byte_ranges(rows: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The ranges of texts given as ``id, text, size, overlap``; each byte is sent once and with the halos of others."""
    names = [c.split()[0] for c in RANGE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.int32()]
        out, held = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        for b in batches:
            for i, s, size, overlap in zip(*(b.column(c).to_pylist() for c in ("id", "text", "size", "overlap")), strict=True):
                data = s.encode("utf-8", "surrogatepass")
                h, width = halo(size, overlap), range_width(size, overlap, range_bytes)
                for no in range(-(-len(data) // width)):
                    start = max(0, no * width - h)
                    part = data[start : (no + 1) * width + h]
                    out.append((i, size, overlap, no, (no + 1) * width >= len(data), part, no * width - start, width))
                    held += len(part)
                    if held > 1 << 22:
                        yield pack()
                        out, held = [], 0
        if out:
            yield pack()

    return rows.select("id", "text", "size", "overlap").mapInArrow(run, RANGE)


def file_ranges(spark: SparkSession, files: DataFrame, range_bytes: int = 1 << 22) -> DataFrame:
    """The ranges of files, ``id, path, n_bytes, size, overlap``, each read by offset on its own.

    ``path``: a path or URI of a file system that pyarrow knows and all workers reach.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for p in batches:
            for x in p.itertuples(index=False):
                h = halo(x.size_, x.overlap)
                start = max(0, x.range_no * x.width - h)
                system, path = fs.FileSystem.from_uri(x.path)
                with system.open_input_file(path) as f:
                    data = f.read_at(min((x.range_no + 1) * x.width + h, x.n_bytes) - start, start)
                yield pd.DataFrame([(x.id, x.size_, x.overlap, x.range_no, (x.range_no + 1) * x.width >= x.n_bytes, data, x.range_no * x.width - start, x.width)])

    r = files.where("n_bytes > 0 and size > 0").select(F.col("id").cast("string").alias("id"), "path", "n_bytes", F.col("size").cast("int").alias("size_"), F.coalesce(F.col("overlap").cast("int"), F.lit(0)).alias("overlap"))
    r = r.withColumn("width", F.expr(f"greatest({range_bytes}, 16 * (size_ + overlap + {CONTEXT + 2}))").cast("int"))
    r = r.withColumn("range_no", F.explode(F.expr("sequence(0, cast((n_bytes - 1) div width as int))"))).repartition("id", "range_no")
    return r.mapInPandas(read, RANGE)


def _own(data: bytes, skip: int, width: int) -> tuple[str, int, int]:
    """The decoded range with its halos, and where its own characters begin and end.

    A character belongs to the range in which its first byte lies.
    """
    lead = lambda i: i >= len(data) or data[i] & 0xC0 != 0x80
    begin, end = skip, min(skip + width, len(data))
    while not lead(begin):
        begin += 1
    while not lead(end):
        end += 1
    head = 0
    while head < begin and not lead(head):
        head += 1
    before, own = data[head:begin].decode("utf-8", "replace"), data[begin:end].decode("utf-8", "replace")
    after = data[end:].decode("utf-8", "ignore")
    return before + own + after, len(before), len(before) + len(own)


def _cores(x) -> tuple[str, int, list[int]]:
    """The range's text, where its own characters begin in it, and the edges of its cores."""
    s, a, b = _own(x.data, x.skip, x.width)
    kind = boundaries(s)
    half = max(1, x[1] // 2)
    start = best_cut(kind, a - half, a) if x.range_no else a
    end = b if x.last else best_cut(kind, b - half, b)
    return s, a, [start, *cuts(kind, start, end, x[1]), end], b - a


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        rows = []
        for x in p.itertuples(index=False):
            _, _, edges, chars = _cores(x)
            rows.append((x.id, x.range_no, x[1], x.overlap, chars, len(edges) - 1))
        yield pd.DataFrame(rows, columns=["id", "range_no", "size", "overlap", "chars", "pieces"])


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PIECE.split(", ")]
    for p in batches:
        rows = []
        for x in p.itertuples(index=False):
            s, a, edges, _ = _cores(x)
            for n, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                first = max(lo - x.overlap, a - x.base)  # the text's start
                rows.append((x.id, x.first_no + n, first - a + x.base, hi - a + x.base, lo - a + x.base, s[first:hi]))
        yield pd.DataFrame(rows, columns=names)


def cut_ranges(ranges: DataFrame) -> DataFrame:
    """Pieces of texts given as byte ranges; texts of at most size + overlap characters have none."""
    t = ranges.mapInPandas(_counts, "id string, range_no int, size int, overlap int, chars long, pieces long")
    one = Window.partitionBy("id")
    upto = one.orderBy("range_no")
    base = t.withColumn("base", F.sum("chars").over(upto) - F.col("chars")).withColumn("first_no", F.sum("pieces").over(upto) - F.col("pieces"))
    base = base.withColumn("length", F.sum("chars").over(one)).where("length > size + overlap").select("id", "range_no", "base", "first_no")
    return ranges.join(base, ["id", "range_no"]).select("id", "size", "overlap", "range_no", "last", "data", "skip", "width", "base", "first_no").mapInPandas(_emit, PIECE)


def pieces(df: DataFrame, id_col: str, text_col: str, size: Column, overlap: Column, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``id, piece_no, char_start, char_end, core_start, text`` of every text over size + overlap characters."""
    return cut_ranges(byte_ranges(oversized(df, id_col, text_col, size, overlap), range_bytes))
