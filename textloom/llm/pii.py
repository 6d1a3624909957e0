"""Problem 8: personal information inside free text, found by a character-level BiLSTM with CRF transitions.

The tagger is trained in numpy, once a process, from ``SNIPPETS`` labelled spans written by a seeded generator (the
bound on labelled rows; neither it nor its sentences depend on the tables). Every text is read whole, as overlapping
windows; each character takes its emission from the window in which it lies farther from an edge, and the stitched
emissions are decoded along the text. Only characters that no span of the best path can cover are left out of the
decoding (``covered`` proves it), so the result is that of decoding everything. Every span is then checked against the
form of its kind, which also sets its exact edges; a span that meets no such form is dropped, and nothing is found
that the tagger did not mark.

Full-width forms, invisible characters and decomposed letters are folded before, with offsets into the original.
Nulls: rows with a null id or text are left out; empty and blank texts have no mentions. Offsets count code points.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import text as X
from textloom.llm.carriers import KINDS, SURNAMES, Writer, own_characters
from textloom.llm.tagger import Tagger

SNIPPETS, STEPS, HIDDEN = 60_000, 2200, 20
WINDOW, OVERLAP = 800, 32
#: Added to the score of a begin of the kinds that have a form, as the form is checked after.
BIAS = 1.5
#: The same for names, which a redaction should rather find once too often.
NAME_BIAS = 1.0


@functools.cache
def alphabet() -> np.ndarray:
    """A number for every code point: printable ASCII, the syllables of the carriers, and classes for the rest."""
    table = np.full(0x110000, 1, np.uint16)
    own = own_characters()
    table[0xAC00:0xD7A4] = 2
    table[0xC0:0x250] = 3
    for i, c in enumerate(own):
        table[ord(c)] = 4 + i
    for code in range(0x660, 0x1FBFA):  # digits of other scripts
        if chr(code).isdecimal():
            table[code] = table[ord("0") + unicodedata.decimal(chr(code))]
    return table


@functools.cache
def trained(snippets: int = SNIPPETS, steps: int = STEPS, seed: int = 11, length: int = 96) -> Tagger:
    """The tagger after ``steps`` batches of the labelled snippets."""
    w, table = Writer(seed), alphabet()
    batch = 96
    made = [w.passage(length) for _ in range(min(snippets, steps * batch))]  # more steps see them again
    ids = np.stack([table[X.codes([s])[0]] for s, _ in made]).astype(np.int64)
    tags = np.array([t for _, t in made])
    # a span cut by the window's begin has no B; its first character becomes one
    first = tags[:, 0]
    tags[:, 0] = np.where((first > 0) & (first % 2 == 0), first - 1, first)
    model = Tagger(int(table.max()) + 1, 2 * len(KINDS) + 1, HIDDEN)
    r = np.random.Generator(np.random.PCG64(seed))

    def batches():
        for _ in range(steps):
            rows = r.integers(0, len(made), batch)
            x = ids[rows].T.copy()
            rare = (r.random(x.shape) < 0.03) & (x > 130)  # syllables of no carrier
            x[rare] = 2
            yield x, tags[rows].T

    model.fit(batches(), steps=steps)
    return model


# Fixed forms: what a mention of each kind looks like.
FORMS = {
    "email": re.compile(r"(?<![A-Za-z0-9._+-])[A-Za-z0-9](?:[A-Za-z0-9+_-]|(?:\.|\s?[\[(]dot[\])]\s?| dot )(?=[A-Za-z0-9]))*+\s{0,2}(?:@|[\[(]\s?at\s?[\])]|(?<=\s)at(?=\s)|골뱅이)\s{0,2}[A-Za-z0-9-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?| dot )[A-Za-z0-9-]+)+", re.I),
    "phone": re.compile(r"(?<![\dA-Za-z-])(?:\+\s?82[-. ]?\(?0?\)?1?\d{1,2}[-. ]?\d{3,4}[-. ]?\d{4}|\(0\d{1,2}\)[-. ]?\d{3,4}[-. ]?\d{4}|0\d{1,2}[-. ]?\d{3,4}[-. ]?\d{4}|(?:\+\s?1[-. ]?)?(?:\(\d{3}\)[-. ]?|\d{3}[-. ])\d{3}[-. ]\d{4})(?![\d-])"),
    "id_number": re.compile(r"(?<![\dA-Za-z-])(?:\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\s?[-–—·./]?\s?\d{7}|\d{3}[-–—·. ]?\d{2}[-–—·. ]?\d{4})(?!\d)"),
    "address": re.compile(r"[가-힣]{1,8}(?:특별시|광역시|도|시)\s+(?:[가-힣]{1,6}[시군구읍면]\s+){1,3}[가-힣]{1,8}(?:로|길|동|리)\s?(?:산\s?)?\d{1,4}(?:-\d{1,4})?|(?<![\w-])\d{1,5} (?:[^\W\d_]+ ){1,3}(?:Lane|Road|Street|Drive|Avenue|Court|Way|Place|Square|Close|Terrace|Boulevard|Row|St|Rd|Ave|Dr|Ln|Blvd)\b", re.I),
    "name": re.compile(r"(?:남궁|황보|제갈|사공|선우|서문|독고|동방)[가-힣]{2}|[가-힣](?: ?[가-힣]){2}|[가-힣] ?[가-힣]|(?:[A-Z]\.|[A-Z][^\W\d_]*(?:['-][^\W\d_]+)*) (?:[A-Z]\. )?[A-Z][^\W\d_]*(?:['-][^\W\d_]+)*"),
}
_AFTER_NAME = re.compile(r"(?:은|는|이|가|을|를|의|와|과|도|만|께|에게|한테|씨|님|께서|이?(?:고|며|다|나|라|라고|라는|라며)|인|인데|입니다|이었다|였다)?(?![가-힣])")
_TITLE_AFTER = re.compile(r" ?(?:씨|님|군|양|여사|선생|고객|과장|부장|팀장|대리|대표|교수|기사|원장)")
_TITLES = re.compile(r"(?:(?:Mr|Ms|Mrs|Dr|Prof)\.? |(?:성명|이름|고객|계약자|신청인|설계사|보낸이|증인|피보험자|받는 분)[ :]*)", re.I)


def folded(s: str, wanted: np.ndarray | None = None) -> tuple[str, np.ndarray | None]:
    """One code point a letter, with offsets into ``s`` (null if they are the same).

    Only clusters (a character with the marks and jamo after it) at the flagged offsets ``wanted`` are looked at.
    """
    if wanted is None:
        wanted = np.flatnonzero(_to_fold()[X.codes([s])[0]])
    if not len(wanted):
        return s, None
    table = X._maps()[0]
    n, last = len(s), 0
    out, at = [], []
    for w in wanted.tolist():
        if w < last:
            continue
        i = w
        while i > last and _joins(s[i]):
            i -= 1
        j = i + 1
        while j < n and _joins(s[j]):
            j += 1
        new = unicodedata.normalize("NFC", s[i:j].translate(table)).translate(X._FOREIGN)
        out += [s[last:i], new]
        at += [np.arange(last, i), np.full(len(new), i)]
        last = j
    out.append(s[last:])
    at.append(np.arange(last, n + 1))
    return "".join(out), np.concatenate(at)


def _joins(c: str) -> bool:
    """True for what belongs to the character before it: marks, and the vowels and final consonants of syllables."""
    return "ᅠ" <= c <= "ᇿ" or unicodedata.combining(c) > 0


@functools.cache
def _to_fold() -> np.ndarray:
    """True for every code point that may make a text need folding: own prototypes, marks, jamo, uncomposed forms."""
    flags = np.zeros(0x110000, bool)
    flags[[*X._maps()[0], *map(ord, X.LOOK_ALIKE), *range(0x1100, 0x1200), *range(0x2F800, 0x2FA20)]] = True
    for code in [*range(0x300, 0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x1F000), *range(0xE0000, 0xE0200)]:
        c = chr(code)
        if unicodedata.category(c)[0] == "M" or not unicodedata.is_normalized("NFC", c):
            flags[code] = True
    return flags


def folded_all(texts: list[str]) -> list[tuple[str, np.ndarray | None]]:
    """``folded`` of each text; only texts with a character that needs it are looked at one by one."""
    a, ends = X.codes(texts)
    out: list[tuple[str, np.ndarray | None]] = [(s, None) for s in texts]
    where = np.flatnonzero(_to_fold()[a])
    owner = np.searchsorted(ends, where, "right") - 1
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    for d, wanted in zip(owner[first].tolist(), np.split(where, first[1:]), strict=False):
        out[d] = folded(texts[d], wanted - ends[d])
    return out


def checked(s: str, kind: str, a: int, b: int, forms) -> tuple[int, int] | None:
    """The exact edges of a marked span, or nothing if no form of its kind (``forms`` of the whole text) meets it."""
    if kind == "name":
        while m := _TITLES.match(s, a, b):
            a = m.end()
        m = FORMS[kind].fullmatch(s, a, b) or FORMS[kind].search(s, a, b)
        if not m:
            return None
        i, j = m.span()
        if "가" <= s[i] <= "힣" and (s[i] not in SURNAMES or "가" <= s[i - 1 : i] <= "힣" or not _AFTER_NAME.match(s, j)):
            return None
        if j - i == 2 and not _TITLE_AFTER.match(s, j):  # a surname and one syllable: too many words look so
            return None
        return i, j
    best = None
    for x, y in forms(kind):
        both = min(b, y) - max(a, x)
        if both > 0 and (best is None or both > best[0]):
            best = (both, x, y)
    return best and best[1:]


def covered(e: np.ndarray, begins: np.ndarray, a: np.ndarray) -> np.ndarray:
    """True for every character that may lie in a span of the best path; all others are outside on it.

    A span gains over staying outside what its emissions and transitions add. Spans never touch, so the gains of a path
    add up, and a span that gains less than nothing is on no best path: without it the path would be better. The best
    span over a character is the best begin up to it and the best end from it on, two running maxima a kind.
    """
    out = np.zeros(len(e), bool)
    # in parts of whole texts that fit the CPU's cache
    edges = np.append(begins[np.diff(begins >> 15, prepend=-1) > 0], len(e))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = begins[np.searchsorted(begins, lo) : np.searchsorted(begins, hi)] - lo
        t = np.ascontiguousarray(e[lo:hi].T, np.float64)
        t[1:] -= t[0]
        for k in range(1, len(t), 2):
            start = t[k] + (a[0, k] - a[0, 0])
            go_on = t[k + 1] + (a[k + 1, k + 1] - a[0, 0])
            np.maximum(go_on, -60, out=go_on)
            go_on[own] = -1e3  # no span runs from one text into the next
            total = np.cumsum(go_on)
            first, end = a[k, k + 1] - a[k + 1, k + 1], a[k + 1, 0] - a[0, 0]
            # the best sum of a span that is open at a character, begun there or before, and of what may follow it
            open_at = start + first
            np.maximum(open_at[1:], total[1:] + np.maximum.accumulate(open_at - total)[:-1], out=open_at[1:])
            after = np.maximum.accumulate(total[::-1])[::-1] - total + end
            out[lo:hi] |= np.maximum(open_at + after, start + (a[k, 0] - a[0, 0])) >= 0
    return out


def spans_of(texts: list[str], model: Tagger, bias: float = BIAS, name_bias: float = NAME_BIAS, check: bool = True) -> list[list[tuple[str, int, int]]]:
    """Spans of folded texts as the tagger marks them, with their forms checked unless ``check`` is false."""
    table = alphabet()
    a, ends = X.codes(texts)
    ids = table[a].astype(np.int64)
    if not len(ids):
        return [[] for _ in texts]
    size = np.diff(ends)
    # a text is cut evenly into windows of at most WINDOW characters; windows of like lengths run together
    n = np.maximum(1, -(-(size - OVERLAP) // (WINDOW - OVERLAP)))
    step = -(-np.maximum(size - OVERLAP, 1) // n)
    owner = np.repeat(np.arange(len(texts)), np.where(size > 0, n, 0))
    no = np.arange(len(owner)) - np.repeat(np.cumsum(np.where(size > 0, n, 0)) - np.where(size > 0, n, 0), np.where(size > 0, n, 0))
    starts = ends[owner] + no * step[owner]
    lengths = np.minimum(step[owner] + OVERLAP, ends[owner + 1] - starts)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    # a window owns what is farther from its edges than from its neighbours'
    begin = np.where(no == 0, 0, OVERLAP // 2)
    end = np.where(starts + lengths >= ends[owner + 1], lengths, lengths - OVERLAP // 2)
    e = np.empty((len(ids), 2 * len(KINDS) + 1), np.float32)
    for lo in range(0, len(order), 512):
        w = order[lo : lo + 512]
        pos = np.minimum(starts[w][None] + np.arange(lengths[w[-1]])[:, None], len(ids) - 1)
        y = np.ascontiguousarray(model.emissions(ids[pos], lengths[w]).transpose(1, 0, 2))
        for i, (at, b, t) in enumerate(zip(starts[w].tolist(), begin[w].tolist(), end[w].tolist(), strict=True)):
            e[at + b : at + t] = y[i, b:t]
    e[:, 1:-2:2] += np.float32(bias)  # once a span
    e[:, -2] += np.float32(name_bias)
    inside = covered(e, ends[:-1][size > 0], model.transitions())
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    at = np.flatnonzero(inside)
    if not len(at):
        return out
    owner = np.searchsorted(ends, at, "right") - 1
    breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(owner) > 0)) + 1
    parts = [(d, p[0], p[-1] + 1) for p, d in zip(np.split(at, breaks), owner[np.concatenate([[0], breaks])].tolist(), strict=True)]
    known: dict[tuple[int, str], list[tuple[int, int]]] = {}

    def forms(d: int, kind: str) -> list[tuple[int, int]]:
        if (d, kind) not in known:
            known[d, kind] = [m.span() for m in FORMS[kind].finditer(texts[d])]
        return known[d, kind]

    for (d, lo, _), tags in zip(parts, model.decode([e[lo:hi] for _, lo, hi in parts]), strict=True):
        s, base, tags = texts[d], int(lo - ends[d]), tags.tolist()
        i = 0
        while i < len(tags):
            if tags[i] == 0:
                i += 1
                continue
            j, kind = i + 1, (tags[i] - 1) // 2
            while j < len(tags) and tags[j] == 2 * kind + 2:
                j += 1
            name = KINDS[kind]
            got = checked(s, name, base + i, base + j, functools.partial(forms, d)) if check else (base + i, base + j)
            if got:
                out[d].append((name, *got))
            i = j
    return [sorted(set(x), key=lambda t: (t[1], -t[2])) for x in out]


def _found(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                p = b.slice(lo, 2048)
                keys, texts = p.column(0).to_pylist(), p.column(1).to_pylist()
                fold = folded_all(texts)
                rows = []
                for k, (f, at), spans in zip(keys, fold, spans_of([f for f, _ in fold], m), strict=True):
                    rows += [(k, kind, x if at is None else int(at[x]), y if at is None else int(at[y - 1] + 1), f[x:y]) for kind, x, y in spans]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = (b.column(0).type, pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "kind", "char_start", "char_end", "mention"])

    return run


def mentions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kind, char_start, char_end, mention``."""
    model = df.sparkSession.sparkContext.broadcast(trained())  # some 100 KB
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(_found(model), "doc_id long, kind string, char_start long, char_end long, mention string")


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, mentions``: every mention replaced by its kind in square brackets, the rest unchanged."""
    model = df.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            fold = folded_all(p.text.tolist())
            texts, counts = [], []
            for s, (_, at), spans in zip(p.text, fold, spans_of([f for f, _ in fold], model.value), strict=True):
                out, last, n = [], 0, 0
                for kind, x, y in spans:
                    a, b = (x, y) if at is None else (int(at[x]), int(at[y]) if y < len(at) else len(s))
                    if a < last:
                        continue
                    out += [s[last:a], f"[{kind.upper()}]"]
                    last, n = b, n + 1
                texts.append("".join([*out, s[last:]]))
                counts.append(n)
            yield pd.DataFrame({"doc_id": p.doc_id, "text": texts, "mentions": counts})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInPandas(run, "doc_id long, text string, mentions long")
