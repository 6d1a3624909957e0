"""Problem 7: mixing sources to target weights by capped water-filling.

Sizes are tokens of a public tokenizer. Every source with a target gets its share of the total; a source that would
need more than ``max_repeats`` passes is clamped there, and the excess goes to the others in proportion to their
shares until no more are clamped. A source then takes whole passes, and for the fraction the records first in a
seeded order: hash buckets whose prefix sum fits are taken whole, only the bucket at the edge is ordered record by
record, so no source is ever sorted as a whole, and the fraction is met to within one record.

The total defaults to the tokens that listed sources hold, one pass each. Nulls: null, empty and blank texts have no
tokens and are left out, as are records of sources without a positive target or a null source; null max_repeats is 1.
A target listed twice counts with its largest share. Only totals of listed sources reach the driver, at most
``MAX_SOURCES``. A repeated doc_id is another record.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.lineage import cut

MAX_SOURCES = 100_000
BUCKETS = 4096


@functools.cache
def _tokenizer(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> tuple[str, str]:
    """Path and pattern of the multilingual byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers as P

    return str(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN


def counted(df: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id, source, n_tokens`` of records with a text; whole texts are counted."""
    path, pattern = tokenizer or default_tokenizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = _tokenizer(path, pattern)
        for p in batches:
            yield p[["doc_id", "source"]].assign(n_tokens=[len(e.encode_ordinary(s)) for s in p.text])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    rows = rows.where(r"source is not null and text is not null and text rlike '(?U)\\S'")
    return rows.mapInPandas(run, f"doc_id {kind}, source string, n_tokens long")


def water_fill(sizes: Mapping[str, int], targets: Mapping[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens that each source gives; ``targets``: share and greatest number of passes."""
    live = {s: t for s, t in targets.items() if t[0] > 0 and t[1] > 0 and sizes.get(s, 0) > 0}
    total = sum(sizes[s] for s in live) if total is None else total
    got: dict[str, float] = {}
    while live:
        left = total - sum(got.values())
        weight = sum(share for share, _ in live.values())
        over = [s for s, (share, most) in live.items() if left * share / weight >= sizes[s] * most]
        for s in over:
            got[s] = float(sizes[s] * live.pop(s)[1])
        if not over:
            got |= {s: left * share / weight for s, (share, _) in live.items()}
            break
    return got


def plan(tokens: DataFrame, targets: DataFrame, total: float | None = None) -> dict[str, dict]:
    """Share, passes and tokens of each listed source; sizes are summed before they reach the driver."""
    t = targets.where("source is not null").groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("most"))).alias("t"))
    sums = tokens.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    rows = t.join(sums, "source", "left").select("source", "t.*", F.coalesce("n", F.lit(0)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    got = water_fill({r.source: r.n for r in rows}, {r.source: (r.share, r.most) for r in rows}, total)
    return {r.source: {"share": r.share, "most": r.most, "n": r.n, "take": got.get(r.source, 0.0)} for r in rows}


def mix(tokens: DataFrame, targets: DataFrame, seed: int = 17, total: float | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, repeats`` of the records in the mixture."""
    spark = tokens.sparkSession
    tokens = cut(tokens)  # tokenized once
    sources = plan(tokens, targets, total)
    rows = []
    for s, x in sources.items():
        whole = int(x["take"] // x["n"]) if x["n"] else 0
        rows.append((s, whole, x["take"] - whole * x["n"], x["most"]))
    want = spark.createDataFrame(rows, "source string, whole int, rest double, most int")
    docs = tokens.where("n_tokens > 0").withColumn("u", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source")))
    docs = docs.withColumn("bucket", F.pmod("u", F.lit(BUCKETS)).cast("int")).join(F.broadcast(want), "source")  # at most MAX_SOURCES rows
    by = Window.partitionBy("source").orderBy("bucket")
    sums = docs.groupBy("source", "bucket", "rest").agg(F.sum("n_tokens").alias("n")).withColumn("end", F.sum("n").over(by))
    edge = sums.where("end > rest and end - n <= rest").select(F.col("source").alias("es"), F.col("bucket").alias("edge"), (F.col("rest") - F.col("end") + F.col("n")).alias("room"))
    placed = docs.join(F.broadcast(edge), F.col("source") == F.col("es"), "left")  # a row a source at most
    inside = placed.where("bucket < edge or edge is null").withColumn("more", F.when(F.col("edge").isNull(), F.lit(0)).otherwise(1))
    beyond = placed.where("bucket > edge").withColumn("more", F.lit(0))
    order = Window.partitionBy("source").orderBy("u", "doc_id")
    at_edge = placed.where("bucket = edge").withColumn("run", F.sum("n_tokens").over(order)).withColumn("more", (F.col("run") <= F.col("room")).cast("int")).drop("run")
    out = inside.unionByName(beyond).unionByName(at_edge).withColumn("repeats", F.least(F.col("whole") + F.col("more"), F.col("most")))
    return out.where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, documents, tokens, actual_share`` of every listed source."""
    got = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    total = got.agg(F.sum("tokens").alias("total"))
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"))
    out = t.join(got, "source", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"))
