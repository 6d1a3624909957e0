"""Text scalars as column expressions; all stay inside the JVM.

Letters and digits are ``\\p{L}`` and ``\\p{N}``. Null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}_]+)"


def words(c: Column) -> Column:
    """Unicode words of the lower-cased text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(1))


def compact(c: Column) -> Column:
    """Lower case, only Hangul syllables, a-z and digits."""
    return F.regexp_replace(F.lower(c), "[^가-힣a-z0-9]", "")


def contract_core(c: Column) -> Column:
    """Compact contract name without markers of its variant, in one spelling."""
    c = F.regexp_replace(c, r"(?U)\(무배당[^)]*\)|\(간편\)|해약환급금\s*미지급형|갱신형|일반형", "")
    c = F.replace(compact(c), F.lit("특약"), F.lit(""))
    return F.replace(F.replace(c, F.lit("허혈성심장질환"), F.lit("허혈심장질환")), F.lit("대상포진진단"), F.lit("대상포진통풍진단"))


def without_space(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", "")


def char_grams(c: Column, n: int, single: bool = False) -> Column:
    """All adjacent substrings of ``n`` characters; a shorter value gives none, or itself with ``single``."""
    short = rf"|\A.{{1,{n - 1}}}\z" if single and n > 1 else ""
    grams = F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}{short}))."), F.lit(1))  # one pass; a lambda would work the text out again for every place
    return F.coalesce(grams, F.array().cast("array<string>"))


def bigrams(c: Column) -> Column:
    """Character bigrams without white space."""
    return F.regexp_extract_all(without_space(c), F.lit("(?s)(?=(..))."), F.lit(1))  # one pass; a lambda would strip the text again for every pair


def compact_bigrams(c: Column) -> Column:
    return char_grams(compact(c), 2, single=True)


def trigrams(c: Column) -> Column:
    """The set of compact trigrams, in order of first occurrence."""
    return F.array_distinct(char_grams(compact(c), 3))


def words_and_bigrams(c: Column) -> Column:
    """Words, each non-ASCII one of three characters or more followed by its bigrams."""
    more = lambda w: F.when((F.char_length(w) >= 3) & w.rlike("[^\\x00-\\x7F]"), F.concat(F.array(w), char_grams(w, 2))).otherwise(F.array(w))
    return F.flatten(F.transform(words(c), more))


def lower_one_blank(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def hangul_share(c: Column) -> Column:
    """Hangul syllables among the characters that are not white space; 1.0 where there are none."""
    dense = F.regexp_replace(c, r"\s+", "")
    hangul = F.char_length(F.regexp_replace(dense, "[^가-힣]", ""))
    return F.when(F.char_length(dense) == 0, F.lit(1.0)).otherwise(hangul / F.char_length(dense))


def strict_date(c: Column) -> Column:
    """The one valid date that all 6- and 8-digit tokens agree on, years 1990 to 2027, as yyyymmdd; else null."""
    tokens = F.regexp_extract_all(c, F.lit(r"(?<![0-9])([0-9]{8}|[0-9]{6})(?![0-9])"), F.lit(1))
    century = lambda t: F.when(F.char_length(t) == 8, t).when(F.substring(t, 1, 2).cast("int") <= 27, F.concat(F.lit("20"), t)).otherwise(F.concat(F.lit("19"), t))
    ok = lambda t: F.substring(t, 1, 4).cast("int").between(1990, 2027) & F.substring(t, 5, 2).cast("int").between(1, 12) & F.substring(t, 7, 2).cast("int").between(1, 31)
    dates = F.array_distinct(F.transform(tokens, century))
    return F.when((F.size(dates) == 1) & ok(F.get(dates, F.lit(0))), F.get(dates, F.lit(0)))


def only_one_of(c: Column, names: tuple[str, ...]) -> Column:
    """The single one of ``names`` that the text contains; null if none or more."""
    hits = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(c, n))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def clean_title(c: Column) -> Column:
    """Without extension, dates, versions and bracketed parts."""
    c = F.regexp_replace(c, r"(?i)\.md$", "")
    c = F.regexp_replace(c, r"\([^)]*\)", " ")
    c = F.regexp_replace(c, r"(?i)ver\.? ?[0-9]+", " ")
    c = F.regexp_replace(c, r"[0-9]{6,8}", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "_", " "), r"\s+", " "))


def stable_id(prefix: str, c: Column) -> Column:
    """``prefix`` and the first 16 hexadecimal digits of the value's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(c.cast("string"), 256), 1, 16))


def question_key(c: Column) -> Column:
    """The question's different words of two letters or more, sorted: equal for reordered questions."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(words(c), lambda w: F.char_length(w) >= 2))), " ")
