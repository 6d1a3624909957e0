"""Files as frames, and frames as files."""

from __future__ import annotations

import io
import json
import unicodedata
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.plans.shipping import ship_package


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Line-delimited JSON, blank lines skipped; a broken line fails the read, or with ``strict`` off gives nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_qa_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quoted line breaks and perhaps a byte-order mark."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    named = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return named.select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(schema).fields])


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """``rel_path, size_bytes, sha256, doc_id`` of every *.md under ``root``; paths in composed form give the ids."""
    ship_package(spark)
    nfc = F.udf(lambda s: unicodedata.normalize("NFC", s), "string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    rel = nfc(F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), f"^(file:)?/*{root.strip('/')}/", ""))
    out = files.select(rel.alias("rel_path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    return out.withColumn("doc_id", F.concat(F.lit("doc-"), F.substring(F.sha2("rel_path", 256), 1, 16)))


def check_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``; raises where a key occurs twice."""
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} occurs more than once: {twice[0][0]}")
    return df


def read_zip_arrays(spark: SparkSession, path: str, field: str = "data") -> DataFrame:
    """``archive, member, no, record``: the objects of the array ``field`` of each JSON member of zip archives.

    An archive cannot be split, so one is one task's work; its members are read one at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for archive, content in zip(p.path, p.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.namelist():
                        if m.endswith(".json"):
                            rows = json.loads(z.read(m)).get(field) or []
                            out = [(archive, m, i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(rows)]
                            yield pd.DataFrame(out, columns=["archive", "member", "no", "record"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, no int, record string")


def without_repeated_edges(pages: DataFrame, share: float = 0.6, least: int = 3, width: int = 60) -> DataFrame:
    """``doc_id, page, line_no, line`` without page numbers and short edge lines that many pages of a document repeat."""
    edge = (F.col("line_no") == F.col("first")) | (F.col("line_no") == F.col("last"))
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("trim(line) != ''")
    ends = lines.groupBy("doc_id", "page").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"))
    n = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    x = lines.join(ends, ["doc_id", "page"]).withColumn("edge", edge & (F.char_length("line") < width))
    often = x.where("edge").groupBy("doc_id", "line").agg(F.count_distinct("page").alias("on")).join(n, "doc_id")
    often = often.where(F.col("on") >= F.greatest(F.lit(float(least)), F.col("pages") * share)).select("doc_id", "line", F.lit(True).alias("edge"))
    kept = x.join(often, ["doc_id", "line", "edge"], "left_anti").where(~F.col("line").rlike(r"^\s*-?\s*[0-9]+\s*-?\s*$"))
    return kept.select("doc_id", "page", "line_no", "line")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the Parquet folder does not hold yet; the number of rows appended."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
        df = df.join(done, key, "left_anti")
    except Exception as e:  # nothing has been written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df = df.dropDuplicates([key]).persist()
    n = df.count()
    if n:
        df.write.mode("append").parquet(path)
    df.unpersist()
    return n


def publish(df: DataFrame, path: str, identity: str) -> bool:
    """Write once: False if the same identity is there already; another identity is refused."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        was = spark.read.json(f"{path}/_identity").first().identity
        if was != identity:
            raise ValueError(f"{path} holds {was}, not {identity}")
        return False
    staging = path.rstrip("/") + "._staging"
    df.write.mode("overwrite").parquet(f"{staging}/data")
    spark.createDataFrame([(identity,)], "identity string").coalesce(1).write.mode("overwrite").json(f"{staging}/_identity")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        raise OSError(f"could not publish {path}")
    return True


def manifest(df: DataFrame, name: str, key: str, **facts: str) -> DataFrame:
    """One row on a result: rows, columns, an order-free checksum of the keys, and given facts."""
    h = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    row = df.agg(F.count("*").alias("rows"), F.sum(h).cast("string").alias("checksum"))
    return row.select(F.lit(name).alias("name"), F.lit(",".join(sorted(df.columns))).alias("columns"), "rows", "checksum", *[F.lit(v).alias(k) for k, v in facts.items()])
