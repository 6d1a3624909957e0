"""Problem 4: the same or nearly the same records across splits, by similarity-hash bit fingerprints.

A question's fingerprint is a similarity hash of its 3-character substrings: 220 lanes of 8 bits, each lane equal in
two questions with a probability of at least their likeness. The fingerprint is cut into 44 blocks of 40 bits; blocks
are joined across the splits. Pairs that meet in a block must lie within the Hamming ``RADIUS`` on the fingerprint's
lowest bit plane (128 bits of it); the exact likeness of the texts decides. A likeness of 0.7 is met with 99.97 % by
the blocks, one of 0.75 but for 7 in 10^6.

Equal questions form one class before blocks are made, so a question that a third of the records ask meets the
other split once; a block held by a large part of all questions is split over tasks (``plans/skew``). Gold lists that
share ``shared`` ids are found by prefixes: equal lists form one class, ids are ordered from rare to common, and two
sets of sizes m, n that share s ids share one of the first m - s + 1 and n - s + 1; an id common to many lists is
split like a block.

Nulls: records without a qid are left out; null questions, lists and members match nothing. Repeated rows count
once. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import text as X
from textloom.plans.lineage import cut
from textloom.plans.skew import LIMIT, hot_buckets, join_blocks

BLOCKS, LANES = 44, 5
#: Expected differences of 128 bits at likeness 0.7: 19.2, deviation 4.0.
RADIUS = 33


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        q, l, r = (c.to_pylist() for c in b.columns)
        texts = [X.plain_form(s) for s in q]
        ids = [int.from_bytes(X.digest(t)[:6], "big") for t in texts]
        h = X.min_hashes(texts, BLOCKS * LANES)
        code = X.symbols(h, 8)
        columns = [(q, pa.string()), (l, pa.bool_()), (r, pa.bool_()), (texts, pa.string()), (ids, pa.int64()), *((x, pa.int64()) for x in X.bit_planes(h)), ([x.tobytes() for x in code], pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["q", "left", "right", "plain", "id", "plane0", "plane1", "code"])


def fingerprints(left: DataFrame, right: DataFrame) -> DataFrame:
    """``q, left, right, plain, id, plane0, plane1, code`` of each different question of either side, computed once.

    ``id``: 48 bits of a digest of the plain form; plain forms that share one cost a needless check.
    """
    sides = left.select("q", F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(right.select("q", F.lit(False).alias("l"), F.lit(True).alias("r")))
    one = sides.where("q is not null").groupBy("q").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    made = one.mapInArrow(_prints, "q string, left boolean, right boolean, plain string, id long, plane0 long, plane1 long, code binary")
    return cut(made.where("char_length(plain) >= 3"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        code = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, BLOCKS * LANES)
        own = [pa.array(np.repeat(b.column(i).to_numpy(), BLOCKS)) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*own, pa.array(X.segment_numbers(code, LANES).ravel())], ["id", "plane0", "plane1", "block"])


def blocks(prints: DataFrame) -> DataFrame:
    """``id, plane0, plane1, block``: a row for every block of 40 bits of a fingerprint, the block's number in front."""
    return prints.select("id", "plane0", "plane1", "code").mapInArrow(_blocks, "id long, plane0 long, plane1 long, block long")


def _verify(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = [X.likeness(X.gram_set(a), X.gram_set(b)) >= least for a, b in zip(p.pa, p.pb, strict=True)]
            yield p.loc[keep, ["qa", "qb"]]

    return run


def alike_texts(left: DataFrame, right: DataFrame, least: float = 0.7, limit: int = LIMIT) -> DataFrame:
    """``qa, qb``: texts of column ``q`` of either side whose likeness is ``least`` or more."""
    prints = fingerprints(left, right)
    l, r = prints.where("left"), prints.where("right")
    within = F.bit_count(F.col("a.plane0").bitwiseXOR(F.col("b.plane0"))) + F.bit_count(F.col("a.plane1").bitwiseXOR(F.col("b.plane1"))) <= RADIUS
    hot = hot_buckets(blocks(prints).select("block"), "block", limit)
    one = lambda d: blocks(d.groupBy("id").agg(F.min(F.struct("plane0", "plane1", "code")).alias("s")).select("id", "s.*"))
    met = join_blocks(one(l), one(r), "block", "id", hot, within).select(F.col("a.id").alias("qa"), F.col("b.id").alias("qb")).distinct()
    named = met.join(l.select(F.col("id").alias("qa"), F.col("plain").alias("pa")).distinct(), "qa").join(r.select(F.col("id").alias("qb"), F.col("plain").alias("pb")).distinct(), "qb")
    alike = named.mapInPandas(_verify(least), "qa long, qb long").distinct()
    x = alike.join(l.select(F.col("id").alias("qa"), F.col("q").alias("ta")), "qa").join(r.select(F.col("id").alias("qb"), F.col("q").alias("tb")), "qb")
    return x.select(F.col("ta").alias("qa"), F.col("tb").alias("qb"))


def sharing_sets(left: DataFrame, right: DataFrame, shared: int = 3, limit: int = LIMIT) -> DataFrame:
    """``ka, kb`` of sets (columns ``k, ids``) that have ``shared`` different ids in common."""
    clean = lambda d: d.select("k", F.array_sort(F.array_compact(F.array_distinct("ids"))).alias("ids")).where(F.size("ids") >= shared)
    l, r = clean(left), clean(right)
    sets = l.select("ids").distinct().select(F.lit("a").alias("side"), "ids").unionByName(r.select("ids").distinct().select(F.lit("b").alias("side"), "ids"))
    sets = sets.select("side", "ids", F.xxhash64("ids").alias("no"))
    members = sets.select("side", "no", F.explode("ids").alias("id"))
    freq = members.groupBy("id").count()
    ranked = members.join(freq, "id").groupBy("side", "no").agg(F.array_sort(F.collect_list(F.struct("count", "id"))).alias("o"))  # a set is one record's list
    ranked = ranked.select("side", "no", F.array_distinct(F.transform("o", lambda x: x["id"])).alias("ids"))
    prefix = ranked.select("side", "no", "ids", F.explode(F.slice("ids", 1, F.size("ids") - shared + 1)).alias("id"))
    hot = hot_buckets(l.select(F.explode("ids").alias("id")).unionByName(r.select(F.explode("ids").alias("id"))), "id", limit)
    many = F.size(F.array_intersect("a.ids", "b.ids")) >= shared
    met = join_blocks(prefix.where("side = 'a'"), prefix.where("side = 'b'"), "id", "no", hot, many).select(F.col("a.no").alias("na"), F.col("b.no").alias("nb")).distinct()
    x = met.join(l.select(F.col("k").alias("ka"), F.col("ids").alias("ia"), F.xxhash64("ids").alias("na")), "na").join(r.select(F.col("k").alias("kb"), F.col("ids").alias("ib"), F.xxhash64("ids").alias("nb")), "nb")
    return x.where(F.size(F.array_intersect("ia", "ib")) >= shared).select("ka", "kb").distinct()


def _pair(split: str, source: str, a: str, b: str) -> list[Column]:
    return [F.col(split).alias("split"), F.col(source).alias("source"), F.least(a, b).alias("key_a"), F.greatest(a, b).alias("key_b")]


def overlaps(results: DataFrame, train: DataFrame, config: DataFrame, doc_facts: DataFrame, chunks: DataFrame, least: float = 0.7, shared: int = 3) -> DataFrame:
    """``split, source, key_a, key_b, reason`` of every overlap of training with evaluation records and reserved documents.

    Reasons: 'qid', 'question', 'gold_ids', 'reserved_document'.
    """
    ev = results.where("qid is not null").select("split", "source", "qid", F.col("query_text").alias("q"), "gold_chunk_ids").distinct()
    tr = train.where("qid is not null").select(F.col("qid").alias("tqid"), F.col("question").alias("q"), F.col("gold_chunk_ids").alias("gold")).distinct()
    keys = ev.select("split", "source", "qid").distinct()
    same = keys.join(tr.select(F.col("tqid").alias("qid")).distinct(), "qid", "left_semi").select(*_pair("split", "source", "qid", "qid"), F.lit("qid").alias("reason"))
    alike = alike_texts(ev, tr, least)
    worded = ev.select("split", "source", "qid", F.col("q").alias("qa")).join(alike, "qa").join(tr.select("tqid", F.col("q").alias("qb")), "qb")
    worded = worded.select(*_pair("split", "source", "qid", "tqid"), F.lit("question").alias("reason"))
    sets = sharing_sets(ev.select(F.struct("split", "source", "qid").alias("k"), F.col("gold_chunk_ids").alias("ids")), tr.select(F.struct(F.lit(None).cast("string").alias("split"), F.lit(None).cast("string").alias("source"), F.col("tqid").alias("qid")).alias("k"), F.col("gold").alias("ids")), shared)
    gold = sets.select("ka.*", F.col("kb.qid").alias("tqid")).select(*_pair("split", "source", "qid", "tqid"), F.lit("gold_ids").alias("reason"))
    known = doc_facts.where("doc_id is not null").select("doc_id", F.lower(F.trim("doc_id")).alias("d")).distinct()
    named = config.select("split", "source", F.explode("exclude_doc_ids").alias("x")).select("split", "source", F.lower(F.trim(F.regexp_replace("x", r"(?U)^\s+|\s+$", ""))).alias("d")).distinct()
    homes = chunks.where("chunk_id is not null and document_key is not null").select(F.col("chunk_id").alias("c"), F.lower(F.trim("document_key")).alias("d")).distinct()
    reserved = named.join(known, "d").join(homes, "d").join(tr.select("tqid", F.explode("gold").alias("c")).distinct(), "c")
    reserved = reserved.select(*_pair("split", "source", "doc_id", "tqid"), F.lit("reserved_document").alias("reason"))
    return same.unionByName(worded).unionByName(gold).unionByName(reserved).distinct()
