import json
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.sources import files
from textloom.streaming import ingest


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    files.write_jsonl(df, str(tmp_path / "x"))
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "x"), "id string, n int").collect())) == [("a", 1), ("b", None)]
    (tmp_path / "y.jsonl").write_text('{"id":"a","n":1}\n\n{"id":"b"\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "y.jsonl"), "id string, n int").collect()
    assert files.read_jsonl(spark, str(tmp_path / "y.jsonl"), "id string, n int", strict=False).where("id = 'a'").count() == 1


def test_csv_with_mark(spark, tmp_path):
    (tmp_path / "q.csv").write_text('﻿qid,question\n1,"a\nb"\n2,c\n', encoding="utf-8")
    assert sorted(map(tuple, files.read_qa_csv(spark, str(tmp_path / "q.csv"), "qid int, question string").collect())) == [(1, "a\nb"), (2, "c")]


def test_markdown_tree(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "a.md").write_text("# x")
    (tmp_path / "b.md").write_text("y")
    (tmp_path / "c.txt").write_text("z")
    got = {r.rel_path: r.size_bytes for r in files.scan_markdown(spark, str(tmp_path)).collect()}
    assert got == {"sub dir/a.md": 3, "b.md": 1}
    with pytest.raises(ValueError, match="more than once"):
        files.check_unique(spark.createDataFrame([("a",), ("a",)], "k string"), "k")


def test_zip_arrays(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.json", json.dumps({"data": [{"x": 1}, {"x": "가"}]}))
        z.writestr("n.json", json.dumps({"other": 1}))
        z.writestr("o.txt", "no")
    got = [(r.member, r.no, r.record) for r in files.read_zip_arrays(spark, str(tmp_path)).orderBy("no").collect()]
    assert got == [("m.json", 0, '{"x": 1}'), ("m.json", 1, '{"x": "가"}')]


def test_repeated_edges(spark):
    pages = spark.createDataFrame([("d", i, f"Head\nbody {i}\n- {i} -") for i in range(4)], "doc_id string, page int, text string")
    assert sorted(r.line for r in files.without_repeated_edges(pages).collect()) == [f"body {i}" for i in range(4)]


def test_append_publish_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    path = str(tmp_path / "t")
    assert files.append_new(df, path, "id") == 2 and files.append_new(df, path, "id") == 0
    assert spark.read.parquet(path).count() == 2
    out = str(tmp_path / "p")
    assert files.publish(df, out, "v1") and not files.publish(df, out, "v1")
    with pytest.raises(ValueError, match="not v2"):
        files.publish(df, out, "v2")
    assert spark.read.parquet(f"{out}/data").count() == 3
    m = files.manifest(df, "r", "id", seed="7").first()
    assert (m.rows, m.seed, m.columns) == (3, "7", "id,v") and m.checksum == files.manifest(df.orderBy(F.desc("id")), "r", "id", seed="7").first().checksum


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(i % 5, i) for i in range(20)], "id int, v int")
    df.repartition(3).write.parquet(src)
    for _ in range(2):
        q = ingest.append_stream(spark.readStream.schema(df.schema).parquet(src), out, "id", str(tmp_path / "ck"))
        q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]
    runs = spark.sql("select timestamp'2024-01-01 01:00:00' + make_interval(0,0,0,id) as run_ts, 'r' as run_id, cast(id % 2 as int) as error, array('a') as submitted, cast(id as double) as elapsed from range(4)")
    runs.write.parquet(str(tmp_path / "runs"))
    s = ingest.run_health(spark.readStream.schema(runs.schema).parquet(str(tmp_path / "runs")))
    q = s.writeStream.format("memory").queryName("health").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.records, r.failures) for r in spark.sql("select * from health order by start").collect()] == [(1, 0), (1, 1), (1, 0), (1, 1)]
