"""Text forms shared by the operators of this package, written for whole Arrow batches.

``skeleton`` is the one consistent form of look-alike text, ``plain_form`` its
lower-case letters and digits. Both return '' for null.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterable, Sequence

import numpy as np

# Letters of other alphabets with the shape of a Latin letter.
LOOK_ALIKE = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ι": "i", "ν": "v", "ο": "o", "ρ": "p",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y",
    "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    # Armenian
    "Ս": "U", "Օ": "O", "հ": "h", "ո": "n", "ս": "u", "օ": "o", "ց": "g",
}
# The same, only where the word has a Latin letter too.
LOOK_ALIKE_INSIDE = {
    # Greek
    "α": "a", "γ": "y", "υ": "u", "Ϲ": "C", "ϲ": "c", "ϳ": "j", "Ϳ": "J",
    # Cyrillic
    "ү": "y", "Ѵ": "V", "Һ": "H", "Ӏ": "I", "ѡ": "w", "ԍ": "g", "Ԍ": "G", "ӕ": "æ", "Ӕ": "Æ",
    # Armenian
    "Լ": "L", "Տ": "S", "ղ": "n", "յ": "j", "զ": "q", "ժ": "d",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L",
    "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꭹ": "Y", "Ꮓ": "Z",
    # phonetic and small capital letters
    "ɑ": "a", "ɡ": "g", "ı": "i", "ȷ": "j", "ɩ": "i", "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
}
# Characters without width or ink.
INVISIBLE = "".join(map(chr, [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF]))
# Blanks as wide as an ordinary one or less, and blanks as wide as a full-width letter.
NARROW_BLANKS = "".join(map(chr, [0xA0, 0x2000, 0x2002, *range(0x2004, 0x200B), 0x202F, 0x205F]))
WIDE_BLANKS = "".join(map(chr, [0x2001, 0x2003, 0x3000]))


@functools.cache
def _maps() -> tuple[dict[int, str | None], re.Pattern, re.Pattern, re.Pattern]:
    """The table of prototypes (by rule for full- and half-width forms), and the patterns deciding where it applies."""
    table: dict[int, str | None] = {ord(c): None for c in INVISIBLE}
    table |= {ord(c): " " for c in NARROW_BLANKS} | {ord(c): chr(0x3000) for c in WIDE_BLANKS}
    for code in [*range(0x2000, 0x3001), *range(0xFE00, 0xFFFF)]:
        tag, _, to = unicodedata.decomposition(chr(code)).partition(" ")
        if tag in ("<wide>", "<narrow>") and code != 0x3000:
            table[code] = chr(int(to, 16))
    table |= {code: None for code in range(0xFE00, 0xFE10)}
    # letters in other type faces, and letters set as one; neither circled nor raised ones
    for code in [*range(0x2100, 0x2150), *range(0x1D400, 0x1D800), *range(0xFB00, 0xFB07)]:
        tag, _, to = unicodedata.decomposition(chr(code)).partition(" ")
        to = "".join(chr(int(x, 16)) for x in to.split())
        if to.isalnum() and (tag == "<font>" or tag == "<compat>" and code >= 0xFB00):
            table[code] = unicodedata.normalize("NFKC", to)
    # beyond the basic plane one range, as a set of single characters is searched one by one there
    own = "".join(re.escape(chr(c)) for c in table if c < 0x10000) + "\U0001d400-\U0001d7ff"
    foreign = "".join(LOOK_ALIKE) + "".join(LOOK_ALIKE_INSIDE)
    word = re.compile("[A-Za-z\u00c0-\u02af\u0300-\u058f\u13a0-\u13fd\u1d00-\u1d2b\ua730-\ua7ff]+")
    return table, re.compile(f"[{own}]"), re.compile(f"[{foreign}]"), word


_FOREIGN = str.maketrans(LOOK_ALIKE)
_INSIDE = str.maketrans(LOOK_ALIKE | LOOK_ALIKE_INSIDE)
_LATIN = re.compile("[A-Za-z\u00c0-\u00ff]")
_ALL_FOREIGN = re.compile(f"[{''.join(LOOK_ALIKE)}\u0300-\u036f]+")


def _latin_word(m: re.Match) -> str:
    """A word with a Latin letter takes all prototypes; one without only if all of it may be read as Latin."""
    if _LATIN.search(m[0]):
        return m[0].translate(_INSIDE)
    return m[0].translate(_FOREIGN) if _ALL_FOREIGN.fullmatch(m[0]) else m[0]


def skeleton(s: str | None) -> str:
    """Decompose, replace every character by its prototype, decompose again; returned composed, which keeps equality."""
    if not s:
        return ""
    if s.isascii():
        return s
    table, own, foreign, word = _maps()
    nfc = unicodedata.is_normalized("NFC", s)
    if nfc and not own.search(s) and not foreign.search(s):
        return s
    t = unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(table))
    if foreign.search(t):
        t = word.sub(_latin_word, t)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", t))


_NOT_ALNUM = re.compile(r"[\W_]+")


def plain_form(s: str | None) -> str:
    """Skeleton, lower case, letters and digits only."""
    return _NOT_ALNUM.sub("", skeleton(s).lower()) if s else ""


def plain_with_offsets(s: str | None) -> tuple[str, list[int]]:
    """The plain form, and for each of its characters the offset in ``s`` it comes from."""
    out, at = [], []
    for i, c in enumerate(s or ""):
        p = plain_form(c)
        out.append(p)
        at += [i] * len(p)
    return "".join(out), at


def digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and the offsets where each begins (one more at the end)."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    raw = "".join(texts).encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass")
    return np.frombuffer(raw, np.uint32), ends


def grams(texts: Sequence[str], n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the n-character substrings of each text, and the offsets where each text's begin."""
    a, ends = codes(texts)
    size = np.maximum(np.diff(ends) - n + 1, 0)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(size, out=starts[1:])
    if not starts[-1]:
        return np.zeros(0, np.uint32), starts
    h = np.zeros(len(a) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[k : len(a) - n + 1 + k]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    whole = np.ones(len(h), bool)
    for k in range(1, n):  # substrings that run over the end of a text
        cut = ends[1:-1] - k
        whole[cut[(cut >= 0) & (cut < len(h))]] = False
    short = np.diff(ends) < n  # a text shorter than n has none
    if short.any():
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))[: len(h)]
        whole &= ~short[owner]
    return (h[whole] >> np.uint64(32)).astype(np.uint32), starts


def gram_set(s: str, n: int = 3) -> frozenset[str]:
    return frozenset(s[i : i + n] for i in range(len(s) - n + 1))


def likeness(a: Iterable[str], b: Iterable[str]) -> float:
    """Jaccard likeness of two sets; 0 if both are empty."""
    a, b = frozenset(a), frozenset(b)
    both = len(a & b)
    return both / (len(a) + len(b) - both) if both else 0.0


@functools.cache
def _lanes(n: int, seed: int) -> np.ndarray:
    """Odd factors: a product with one permutes the 32-bit hashes, which are mixed already."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**32, n, np.uint32) | np.uint32(1)


def min_hashes(texts: Sequence[str], lanes: int, n: int = 3, seed: int = 7) -> np.ndarray:
    """One row of ``lanes`` 32-bit min-hashes a text; texts without n-grams get 0."""
    g, starts = grams(texts, n)
    out = np.zeros((len(texts), lanes), np.uint32)
    full = np.flatnonzero(np.diff(starts) > 0)
    if not len(full):
        return out
    a = _lanes(lanes, seed)
    at = starts[full]
    # blocks of texts, so that a lane's hashes stay in the CPU's cache
    block = np.searchsorted(starts, np.arange(0, starts[-1], 1 << 15), "right") - 1
    block = np.unique(np.searchsorted(full, block))
    for lo, hi in zip(block, [*block[1:], len(full)], strict=True):
        if lo >= hi:
            continue
        s, e = at[lo], starts[full[hi - 1] + 1]
        part, begin = g[s:e], at[lo:hi] - s
        for k in range(lanes):
            out[full[lo:hi], k] = np.minimum.reduceat(part * a[k], begin)
    return out


def symbols(h: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits of every lane: equal where the lanes are, else by chance of 1 in 2 ** bits."""
    return ((h >> np.uint32(9)) & np.uint32((1 << bits) - 1)).astype(np.uint8)


def bit_planes(h: np.ndarray) -> list[np.ndarray]:
    """The lowest bit of the symbols of the first 128 lanes, in two numbers; two texts differ in a bit with half the
    probability 1 - likeness."""
    bits = symbols(h[:, :128], 1).astype(np.uint64)
    return [(bits[:, i : i + 64] << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64) for i in (0, 64)]


def segment_numbers(code: np.ndarray, width: int, bits: int = 8) -> np.ndarray:
    """Each run of ``width`` symbols of ``bits`` bits as a number, with the run's place in front."""
    parts = code.reshape(code.shape[0], -1, width)
    out = np.arange(parts.shape[1], dtype=np.int64)[None].repeat(code.shape[0], 0)
    for k in range(width):
        out = (out << bits) | parts[:, :, k]
    return out
