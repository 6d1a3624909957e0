"""Cutting documents into units: paragraphs, lines, sections, tables, sentence chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paragraphs(docs: DataFrame, least: int = 20) -> DataFrame:
    """``doc_id, no, paragraph``: blank-line paragraphs; those under ``least`` characters join the one before."""
    p = docs.select("doc_id", F.posexplode(F.split("text", r"\n[ \t\r]*\n")).alias("pos", "p")).select("doc_id", "pos", F.trim("p").alias("p")).where("p != ''")
    w = Window.partitionBy("doc_id").orderBy("pos")
    p = p.withColumn("no", F.sum(F.when((F.char_length("p") >= least) | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("pos", "p")))
    return p.groupBy("doc_id", "no").agg(F.array_join(F.transform(parts, lambda x: x["p"]), "\n").alias("paragraph"))


def sections(docs: DataFrame, heading: str = r"^#{1,6} ") -> DataFrame:
    """``doc_id, section, title, n_lines, n_chars``: lines under each heading; 0 is what comes before the first."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    head = F.col("line").rlike(heading)
    w = Window.partitionBy("doc_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("section", F.sum(head.cast("int")).over(w)).withColumn("title", F.when(head, F.trim(F.regexp_replace("line", heading, ""))))
    return x.groupBy("doc_id", "section").agg(F.max("title").alias("title"), F.count("*").alias("n_lines"), F.sum(F.char_length("line")).alias("n_chars"))


def table_rows(elements: DataFrame) -> DataFrame:
    """``element_id, row_no, key, cells``: data rows of pipe tables; the key is column 1, or 2 where 1 never changes."""
    lines = elements.select("element_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^[\s|:-]+$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    w = Window.partitionBy("element_id").orderBy("line_no")
    rows = lines.withColumn("cells", cells).withColumn("row_no", F.row_number().over(w) - 1).where("row_no > 0")
    one = rows.groupBy("element_id").agg((F.count_distinct(F.get("cells", F.lit(0))) > 1).alias("varies"), F.count("*").alias("n"))
    key = F.when(F.col("varies") | (F.col("n") == 1), F.get("cells", F.lit(0))).otherwise(F.coalesce(F.get("cells", F.lit(1)), F.get("cells", F.lit(0))))
    return rows.join(one, "element_id").select("element_id", "row_no", key.alias("key"), F.array_join("cells", " | ").alias("cells"))


def noise_runs(docs: DataFrame, least: int = 3) -> DataFrame:
    """``doc_id, start, lines``: runs of at least ``least`` lines that hold nothing but blanks, dashes or page marks."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("noise", F.col("line").rlike(r"^[\s=\-0-9]*$"))
    w = Window.partitionBy("doc_id").orderBy("no")
    x = lines.where("noise").withColumn("island", F.col("no") - F.row_number().over(w))
    return x.groupBy("doc_id", "island").agg(F.min("no").alias("start"), F.count("*").alias("lines")).where(F.col("lines") >= least).drop("island")


_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+|\n|$)")


def sentence_spans(s: str, limit: int, least: int) -> list[tuple[int, int]]:
    """Sentences packed to ``limit`` characters; longer sentences are sliced, pieces under ``least`` dropped."""
    out: list[tuple[int, int]] = []
    begin = end = 0
    for m in _SENTENCE.finditer(s):
        a, b = m.span()
        if a == b:
            continue
        if b - begin > limit and end > begin:
            out.append((begin, end))
            begin = a
        while b - begin > limit:
            out.append((begin, begin + limit))
            begin += limit
        end = b
    if end > begin:
        out.append((begin, end))
    return [(a, b) for a, b in out if b - a >= least]


def sentence_chunks(docs: DataFrame, limit: int = 512, least: int = 80) -> DataFrame:
    """``doc_id, no, char_start, char_end, text``; sequential within a text, so a batch function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [(i, n, a, b, s[a:b]) for i, s in zip(p.doc_id, p.text, strict=True) for n, (a, b) in enumerate(sentence_spans(s, limit, least))]
            yield pd.DataFrame(rows, columns=["doc_id", "no", "char_start", "char_end", "text"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, f"doc_id {kind}, no int, char_start int, char_end int, text string")


def boundary_spans(s: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Cuts at the latest separator beyond a third of the window; the next begins ``overlap`` before, at a blank."""
    out, begin = [], 0
    while begin < len(s):
        end = min(len(s), begin + limit)
        if end < len(s):
            for sep in ("\n\n", "\n", ". ", " "):
                at = s.rfind(sep, begin + limit // 3, end)
                if at >= 0:
                    end = at + len(sep)
                    break
        out.append((begin, end))
        if end == len(s):
            break
        back = s.rfind(" ", begin + 1, end - overlap + 1)
        begin = max(begin + 1, back + 1 if back >= 0 else end - overlap)
    return out


def boundary_chunks(docs: DataFrame, limit: int = 600, overlap: int = 100) -> DataFrame:
    """``doc_id, no, char_start, char_end``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [(i, n, a, b) for i, s in zip(p.doc_id, p.text, strict=True) for n, (a, b) in enumerate(boundary_spans(s, limit, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "no", "char_start", "char_end"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").where("text is not null and text != ''").mapInPandas(run, f"doc_id {kind}, no int, char_start int, char_end int")
