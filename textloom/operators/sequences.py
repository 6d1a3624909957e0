"""Operators that are sequential inside one text, one document or one query's ranking, in Arrow batches.

Each group is bounded: a text, the units of one document, or a ranking's few rows. Nulls give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Part = tuple[int, int, str]


def split_texts(df: DataFrame, key: str, text: str, cut: Callable[[str], list[Part]]) -> DataFrame:
    """``key, no, char_start, char_end, kind, part`` of every text that ``cut`` divides."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [(k, n, a, b, what, s[a:b]) for k, s in zip(p.key, p.text, strict=True) for n, (a, b, what) in enumerate(cut(s))]
            yield pd.DataFrame(rows, columns=["key", "no", "char_start", "char_end", "kind", "part"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    return rows.mapInPandas(run, f"key {kind}, no int, char_start int, char_end int, kind string, part string").withColumnRenamed("key", key)


# ---- chunks

_CUTS = (re.compile(r"\n\s*\n"), re.compile(r"\n"), re.compile(r"[.!?。]\s"), re.compile(r"\s"))


def _last_cut(s: str, lo: int, hi: int) -> int:
    """After the last separator of the best kind in s[lo:hi]; ``hi`` if there is none."""
    for p in _CUTS:
        ends = [m.end() for m in p.finditer(s, lo, hi)]
        if ends:
            return ends[-1]
    return hi


def recursive_ranges(s: str, most: int = 600, least: int = 300) -> list[Part]:
    """Ranges of at most ``most`` characters, cut at the best separator beyond ``least``; a short tail is balanced."""
    out, at, n = [], 0, len(s)
    while n - at > most:
        if n - at < most + least:  # two halves instead of a full range and a short tail
            half = (n - at) // 2
            to = _last_cut(s, at + max(1, half - least // 3), min(at + most, at + half + least // 3))
        else:
            to = _last_cut(s, at + least, at + most)
        out.append((at, to, "chunk"))
        at = to
    return [*out, (at, n, "chunk")] if n > at else out


def with_overlap(parts: Sequence[Part], overlap: int = 100) -> list[Part]:
    """The same ranges, each begun up to ``overlap`` characters earlier, though not before the text."""
    return [(max(0, a - overlap), b, k) for a, b, k in parts]


_HEAD = re.compile(r"(?m)^\s*#*\s*제\s?\d+조")


def limit_heads(s: str, parts: Sequence[Part], most: int = 2) -> list[Part]:
    """Ranges cut again before a head so that none holds more than ``most`` heads of articles."""
    out = []
    for a, b, k in parts:
        heads = [m.start() for m in _HEAD.finditer(s, a, b)]
        edges = [a, *(h for i, h in enumerate(heads) if i and i % most == 0 and h > a), b]
        out += [(x, y, k) for x, y in zip(edges, edges[1:], strict=False) if y > x]
    return out


# ---- elements

_PAGE = re.compile(r"^\s*(?:-\s*\d+\s*-|=====+|\[?\s*p(?:age)?\.?\s*\d+\s*\]?)\s*$", re.I)


def _line_kind(line: str) -> str:
    t = line.strip()
    if not t:
        return "blank"
    if _PAGE.match(line):
        return "page"
    if t.startswith("|") or re.match(r"</?(?:table|tr|td|th)\b", t, re.I):
        return "table"
    if re.match(r"#{1,6}\s", t) or re.match(r"제\s?\d+조(?:의\d+)?(?:\s*\(|\s*$)", t):
        return "heading"
    if t.startswith("```"):
        return "fence"
    return "formula" if t.startswith("$$") else "paragraph"


def markdown_blocks(s: str, most: int = 4000, clean: bool = True) -> list[Part]:
    """Headings, tables, fences, formulas and paragraphs, none over ``most`` characters.

    With ``clean`` a page mark is dropped, and a paragraph that it breaks in mid-sentence goes on behind it.
    """
    blocks: list[list] = []
    at, fence, open_page = 0, "", False
    for line in s.splitlines(keepends=True):
        a, b = at, at + len(line)
        at = b
        kind = fence or _line_kind(line)
        if fence:
            blocks[-1][1] = b
            if line.strip().startswith("```" if fence == "fence" else "$$") or (fence == "formula" and line.strip().endswith("$$")):
                fence = ""
            continue
        if kind in ("fence", "formula"):
            blocks.append([a, b, kind])
            t = line.strip()
            mark = "```" if kind == "fence" else "$$"
            fence = "" if len(t) > len(mark) and t.endswith(mark) else kind
        elif kind == "page" and clean:
            open_page = True
            continue
        elif kind == "blank":
            if blocks and not open_page:
                blocks[-1][2] += "."  # closed
            continue
        else:
            last = blocks[-1] if blocks else None
            goes_on = last is not None and last[2] == kind and kind != "heading"
            broken = open_page and last is not None and last[2].rstrip(".") == "paragraph" == kind and not re.search(r"[.!?다]\s*$", s[last[0] : last[1]])
            if goes_on or broken:
                last[1], last[2] = b, kind
            else:
                blocks.append([a, b, kind])
        open_page = False
    out: list[Part] = []
    for a, b, kind in blocks:
        out += capped(s, a, b, kind.rstrip("."), most)
    return out


def capped(s: str, a: int, b: int, kind: str, most: int) -> list[Part]:
    """s[a:b] in parts of at most ``most`` characters: tables between rows, other text at the best separator."""
    out = []
    while b - a > most:
        if kind == "table":
            rows = [m.end() for m in re.finditer(r"\n|</tr>\s*", s[a : a + most])]
            to = a + rows[-1] if rows else a + most
        else:
            to = _last_cut(s, a + 1, a + most)
        out.append((a, to, kind))
        a = to
    return [*out, (a, b, kind)] if b > a else out


_MARK = re.compile(r"(?m)^\s*(?:#+\s|제\s?\d+조|[①-⑮]|\d+\.\s)")
_STOP = re.compile(r"[.!?。]\s+")


def sections(s: str, least: int = 80, most: int = 2000, sentences: int = 5) -> list[Part]:
    """Parts from marker to marker, small ones joined to the one before; without markers, groups of sentences."""
    marks = [m.start() for m in _MARK.finditer(s)]
    if marks:
        edges, kind = sorted({0, *marks, len(s)}), "section"
    else:
        ends = [m.end() for m in _STOP.finditer(s)]
        edges, kind = sorted({0, *ends[sentences - 1 :: sentences], len(s)}), "sentences"
    joined: list[list[int]] = []
    for a, b in zip(edges, edges[1:], strict=False):
        if joined and (b - a < least or joined[-1][1] - joined[-1][0] < least):
            joined[-1][1] = b
        else:
            joined.append([a, b])
    return [x for a, b in joined for x in capped(s, a, b, kind, most)]


def repaired(s: str, most: int = 4000) -> list[Part]:
    """An oversized or mixed element cut before every head, then to size, tables between rows; others stay whole."""
    heads = [m.start() for m in _HEAD.finditer(s)]
    if len(s) <= most and len(heads) < 3:
        return [(0, len(s), "whole")] if s else []
    edges = sorted({0, *heads, len(s)})
    table = lambda a, b: "table" if re.search(r"<table|^\s*\|", s[a:b], re.I) else "part"
    return [x for a, b in zip(edges, edges[1:], strict=False) for x in capped(s, a, b, table(a, b), most)]


# ---- units of a document in order


def packed(units: DataFrame, most: int = 4000) -> DataFrame:
    """``document_key, pack, units, chars``: units (``document_key, scope, kind, at, chars``) packed in order.

    A pack ends before a unit that would take it over ``most``, before a heading and where the scope changes.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows, scope = [], object()
        for x in p.sort_values("at", kind="stable").itertuples(index=False):
            if not rows or rows[-1][3] + x.chars > most or x.scope != scope or x.kind == "heading":
                rows.append([x.document_key, len(rows), 0, 0])
            rows[-1][2] += 1
            rows[-1][3] += x.chars
            scope = x.scope
        return pd.DataFrame(rows, columns=["document_key", "pack", "units", "chars"])

    return units.groupBy("document_key").applyInPandas(run, "document_key string, pack int, units int, chars long")


def labelled_tables(lines: DataFrame, gap: int = 8) -> DataFrame:
    """``element_id, label`` of tables: the last label before them that only tables and small gaps lie between.

    ``lines``: ``document_key, element_id, kind, label, line_start, line_end``. A table is labelled if it begins 0 to
    ``gap`` lines after the label or the last labelled table ended; each document begins anew.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows, label, frontier = [], None, None
        for x in p.sort_values(["line_start", "element_id"], kind="stable").itertuples(index=False):
            if isinstance(x.label, str):
                label, frontier = x.label, x.line_end
            elif x.kind == "table" and label is not None and 0 <= x.line_start - frontier <= gap:
                rows.append((x.element_id, label))
                frontier = max(frontier, x.line_end)
            elif x.kind == "table":
                label = None
        return pd.DataFrame(rows, columns=["element_id", "label"])

    return lines.groupBy("document_key").applyInPandas(run, "element_id string, label string")


# ---- rankings of one query


def _grams(s: str) -> set[str]:
    t = re.sub(r"\s+", "", s or "")
    return {t[i : i + 2] for i in range(len(t) - 1)}


def _shared(a: set[str], b: set[str], dice: bool) -> float:
    both = len(a & b)
    whole = (len(a) + len(b)) / 2 if dice else len(a | b)
    return both / whole if whole else 0.0


def reorder(ranking: DataFrame, order: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    """``query_id, doc_id, rank`` after ``order``, which gets a query's rows by rank and gives their new order."""
    q, d = (dict(ranking.dtypes)[c] for c in ("query_id", "doc_id"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rank", kind="stable").reset_index(drop=True)
        p = p.iloc[order(p)]
        return pd.DataFrame({"query_id": p.query_id, "doc_id": p.doc_id, "rank": np.arange(1, len(p) + 1)})

    return ranking.groupBy("query_id").applyInPandas(run, f"query_id {q}, doc_id {d}, rank int")


def family_last(least: float = 0.9) -> Callable[[pd.DataFrame], list[int]]:
    """Later members of a family (equal ``family``, texts alike) go to the tail unless the question tells them apart.

    Rows have ``family, text, question``; a word of the question that the member has and the kept one lacks tells.
    """

    def order(p: pd.DataFrame) -> list[int]:
        kept, tail = [], []
        grams = [_grams(t) for t in p.text]
        for i in range(len(p)):
            told = set(re.findall(r"\w+", p.question.iloc[i] or ""))
            twin = next((j for j in kept if p.family.iloc[j] == p.family.iloc[i] and _shared(grams[i], grams[j], False) >= least), None)
            own = told & set(re.findall(r"\w+", p.text.iloc[i] or ""))
            if twin is None or own - set(re.findall(r"\w+", p.text.iloc[twin] or "")):
                kept.append(i)
            else:
                tail.append(i)
        return kept + tail

    return order


def cover_top(top: int = 5, most: int = 2, least: float = 0.85) -> Callable[[pd.DataFrame], list[int]]:
    """At most ``most`` near copies among the first ``top``: equal ``base`` and title, or the first 200 characters alike."""

    def order(p: pd.DataFrame) -> list[int]:
        grams = [_grams((t or "")[:200]) for t in p.text]
        near = lambda i, j: p.base.iloc[i] == p.base.iloc[j] and ((p.title.iloc[i] and p.title.iloc[i] == p.title.iloc[j]) or _shared(grams[i], grams[j], True) >= least)
        head: list[int] = []
        rest: list[int] = []
        for i in range(len(p)):
            full = len(head) >= top or sum(bool(near(i, j)) for j in head) >= most
            (rest if full else head).append(i)
        return head + rest

    return order


def quota(quotas: Sequence[int], limit: int = 10) -> Callable[[pd.DataFrame], list[int]]:
    """The first q distinct units of each ranking (``source`` 0, 1, ...) in turn, then whatever is next in any.

    Rows have ``source, unit, place``; neither a document nor a unit comes twice.
    """

    def order(p: pd.DataFrame) -> list[int]:
        docs, units, out = set(), set(), []

        def take(rows, n: int) -> None:
            for i in rows:
                if n <= 0 or len(out) >= limit:
                    return
                if p.doc_id.iloc[i] not in docs and p.unit.iloc[i] not in units:
                    docs.add(p.doc_id.iloc[i])
                    units.add(p.unit.iloc[i])
                    out.append(i)
                    n -= 1

        for s, q in enumerate(quotas):
            take([i for i in range(len(p)) if p.source.iloc[i] == s], q)
        take(sorted(range(len(p)), key=lambda i: (p.place.iloc[i], p.source.iloc[i])), limit)
        return out

    return order


# ---- resampling


def paired_bootstrap(deltas: np.ndarray, seed: int, draws: int) -> np.ndarray:
    """Means of ``draws`` index resamples, by PCG64."""
    r = np.random.Generator(np.random.PCG64(seed))
    return deltas[r.integers(0, len(deltas), (draws, len(deltas)))].mean(1)


def bca(deltas: np.ndarray, seed: int = 7, draws: int = 2000, alpha: float = 0.05) -> tuple[float, float]:
    """Bias-corrected and accelerated interval of the mean; the point itself where all values are equal."""
    from statistics import NormalDist

    point = float(deltas.mean())
    if len(deltas) < 2 or np.ptp(deltas) == 0:
        return point, point
    normal = NormalDist()
    means = np.sort(paired_bootstrap(deltas, seed, draws))
    below = min(max(float((means < point).mean() + (means == point).mean() / 2), 0.5 / draws), 1 - 0.5 / draws)
    z0 = normal.inv_cdf(below)
    left_out = (deltas.sum() - deltas) / (len(deltas) - 1)
    d = left_out.mean() - left_out
    spread = (d**2).sum() ** 1.5
    a = float((d**3).sum() / (6 * spread)) if spread else 0.0
    ends = []
    for q in (alpha / 2, 1 - alpha / 2):
        z = z0 + normal.inv_cdf(q)
        ends.append(float(np.quantile(means, normal.cdf(z0 + z / (1 - a * z)))))
    return ends[0], ends[1]


def intervals(df: DataFrame, draws: int = 2000, seed: int = 7) -> DataFrame:
    """``arm, n, mean, low, high, bca_low, bca_high`` of the paired differences ``arm, pair, delta`` of each arm."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x = p.sort_values("pair").delta.to_numpy(float)
        low, high = np.quantile(paired_bootstrap(x, seed, draws), [0.025, 0.975])
        b = bca(x, seed, draws)
        values = [round(float(v), 6) for v in (x.mean(), low, high, *b)]
        return pd.DataFrame([(p.arm.iloc[0], len(x), *values)], columns=["arm", "n", "mean", "low", "high", "bca_low", "bca_high"])

    return df.where("arm is not null and delta is not null").groupBy("arm").applyInPandas(run, "arm string, n int, mean double, low double, high double, bca_low double, bca_high double")
