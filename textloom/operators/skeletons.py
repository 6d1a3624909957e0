"""What versions of a text have in common, and the slots in which they differ, without loss.

A skeleton is the common subsequence of words that folding over the versions leaves. Each version is the skeleton with
a gap before each of its words and one at the end; gaps that differ between versions are slots. Versions are grouped
by a key; of a key only its different texts count, at most ``most`` of them make the skeleton (the smallest by text),
and every version is then written with it, so no version is dropped.
"""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+|[^\w]")


def words(s: str) -> list[str]:
    return _WORD.findall(s)


def common(a: Sequence[str], b: Sequence[str]) -> list[str]:
    blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    return [w for m in blocks for w in a[m.a : m.a + m.size]]


def skeleton(versions: Sequence[str]) -> list[str]:
    """Words that all versions have in this order (a greedy common subsequence); blanks alone are not kept."""
    out = words(versions[0]) if versions else []
    for v in versions[1:]:
        out = common(out, words(v))
    return [w for w in out if w.strip()]


def gaps(version: str, frame: Sequence[str]) -> list[str] | None:
    """What stands before each word of the frame and after the last; null if the frame's words are not in this order."""
    own, out, at, i = words(version), [], 0, 0
    for w in frame:
        i = next((k for k in range(at, len(own)) if own[k] == w), -1)
        if i < 0:
            return None
        out.append("".join(own[at:i]))
        at = i + 1
    return [*out, "".join(own[at:])]


def filled(frame: Sequence[str], slots: Sequence[str]) -> str:
    return "".join(g + w for g, w in zip(slots, [*frame, ""], strict=True))


def induced(df: DataFrame, key: str, version: str, text: str, most: int = 20) -> DataFrame:
    """``key, version, skeleton, slots, lossless``: skeleton and slots as JSON arrays of every version.

    A version that the skeleton does not fit has an empty skeleton and its whole text as the one slot.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(version).cast("string").alias("version"), F.col(text).alias("text")).where("key is not null and version is not null and text is not null").distinct()
    w = Window.partitionBy("key").orderBy("text")
    first = rows.select("key", "text").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    few = first.groupBy("key").agg(F.array_sort(F.collect_list("text")).alias("texts"))  # most texts a key

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"key": p.key, "frame": [json.dumps(skeleton(list(t)), ensure_ascii=False) for t in p.texts]})

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for k, v, t, f in zip(p.key, p.version, p.text, p.frame, strict=True):
                frame = json.loads(f)
                slots = gaps(t, frame)
                if slots is None:
                    frame, slots = [], [t]
                out.append((k, v, json.dumps(frame, ensure_ascii=False), json.dumps(slots, ensure_ascii=False), filled(frame, slots) == t))
            yield pd.DataFrame(out, columns=["key", "version", "skeleton", "slots", "lossless"])

    made = few.mapInPandas(frames, "key string, frame string")
    return rows.join(made, "key").mapInPandas(apply, "key string, version string, skeleton string, slots string, lossless boolean")


KINDS = (("amount", r"^[0-9][0-9,]*(만원|원)?$"), ("period", r"^[0-9]+(일|개월|년|세)$"), ("share", r"^[0-9.]+%$"), ("article", r"^제[0-9]+조"), ("code", r"^[A-Z]{2,4}-?[0-9]{4,6}$"))


def slot_kind(c: Column) -> Column:
    """The type of a slot's value by its form; 'text' for others."""
    out = F.lit("text")
    for name, p in reversed(KINDS):
        out = F.when(c.rlike(p), name).otherwise(out)
    return out


def key_values(made: DataFrame) -> DataFrame:
    """``key, slot, kind, versions, values``: slots with more than layout, equal ones of a key merged to the first.

    A slot is the sequence of its values over the versions; the type is that of its smallest value.
    """
    v = made.where("lossless").select("key", "version", F.posexplode(F.from_json("slots", "array<string>")).alias("slot", "value"))
    v = v.withColumn("value", F.trim(F.regexp_replace("value", r"\s+", " ")))
    s = v.groupBy("key", "slot").agg(F.count_distinct("version").alias("versions"), F.count_distinct("value").alias("values"), F.min(F.nullif("value", F.lit(""))).alias("least"), F.sum(F.xxhash64("version", "value").cast("decimal(38,0)")).alias("signature"))
    s = s.where(F.col("least").rlike(r"\w") & (F.col("values") > 1))
    one = s.groupBy("key", "signature").agg(F.min("slot").alias("slot"), F.min("least").alias("least"), F.max("versions").alias("versions"), F.max("values").alias("values"))
    return one.select("key", "slot", slot_kind(F.col("least")).alias("kind"), "versions", "values")
