"""Files and streams: round trips and edge rows."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import files
from tallyforge.streaming import events as S

SF = "/root/testdata/sf0.001"


def test_csv_quotes_and_short_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿ID;NAME;NOTE\n1;"a;b ""q""";"two\nlines"\n\n2;short\n;;\n', encoding="utf-8")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), ["ID", "NAME", "NOTE"]).collect()
    assert [(r.ID, r.NAME, r.NOTE) for r in rows] == [("1", 'a;b "q"', "two\nlines"), ("2", "short", "")]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x;y", ["1", "2"])], "a string, b array<string>")
    files.write_csv(df, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), sep=";", header=True, escape='"').first()
    assert (back.a, back.b) == ("x;y", "1|2")


def test_documents_payload_wins(spark, tmp_path):
    rows = [{"doc_id": "1", "doc_type": "p", "searchable_text": "t", "metadata": {"a": "old", "b": "m"}, "payload": {"a": "new"}}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "skip.jsonl").write_text(json.dumps(rows[0]))
    out = files.read_documents(spark, f"{tmp_path}/*.jsonl", skip=("skip.jsonl",)).collect()
    assert len(out) == 1 and out[0].payload == {"a": "new", "b": "m"}


def test_index_upsert(spark, tmp_path):
    rows = lambda v, ids: spark.createDataFrame([(i, "t", v) for i in ids], "doc_id string, doc_type string, searchable_text string")
    files.write_index(rows("a" * 5000, ["1", "2"]), f"{tmp_path}/v1")
    files.write_index(rows("b", ["2", "3"]), f"{tmp_path}/v2", f"{tmp_path}/v1")
    out = {r.doc_id: len(r.searchable_text) for r in spark.read.parquet(f"{tmp_path}/v2").collect()}
    assert out == {"1": 4000, "2": 1, "3": 1}


def _stream_folder(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


def test_streamed_windows_equal_batch(spark, tmp_path):
    src = _stream_folder(spark, tmp_path)
    stream = S.windowed(S.read_events(spark, src), late="60 days")
    got = S.run_once(stream, "win", "complete", f"{tmp_path}/c1").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, S.windowed(spark.read.parquet(src)).collect()))


@pytest.mark.parametrize("compact", [2, 16])
def test_streamed_upsert_equals_latest(spark, tmp_path, compact):
    spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(7).write.parquet(f"{tmp_path}/in")
    src = f"{tmp_path}/in"
    q = S.upsert_stream(S.read_events(spark, src), f"{tmp_path}/t", ["user_id"], "event_id", f"{tmp_path}/c2", compact)
    q.awaitTermination()
    assert q.exception() is None
    left = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "t").glob("v=*"))
    assert left == (list(range(7)) if compact == 16 else [4, 5, 6])
    got = {r.user_id: r.event_id for r in S.upserted(spark, f"{tmp_path}/t", ["user_id"], "event_id").collect()}
    expected = {r.user_id: r.m for r in spark.read.parquet(src).groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    assert got == expected


def test_markdown_folder_and_documents(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text("# A\n\ntext")
    (tmp_path / "md" / "b.md").write_text("")
    assert sorted(map(tuple, files.read_markdown(spark, f"{tmp_path}/md").collect()))[0] == ("a.md", "# A\n\ntext")
    docs = spark.createDataFrame([("1", "faq", "x"), ("2", "kpi", "y"), ("3", "faq", None)], "doc_id string, doc_type string, searchable_text string")
    counts = files.write_documents(docs, f"{tmp_path}/docs")
    assert counts == {"faq": 2, "kpi": 1}
    back = spark.read.json(f"{tmp_path}/docs")
    assert sorted((r.doc_id, r.doc_type) for r in back.collect()) == [("1", "faq"), ("2", "kpi"), ("3", "faq")]


def test_markdown_report(spark):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "k string, n int").orderBy("n")
    assert files.markdown_table(df) == "| k | n |\n|---|---|\n| a\\|b | 1 |\n|  | 2 |\n"


def test_sitemaps(spark, tmp_path):
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    url = lambda *u: "".join(f"<url><loc> {x} </loc><lastmod>2024-01-01</lastmod></url>" for x in u)
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps" / "a.xml").write_text(f"{head}<urlset {space}>{url('https://x.org/a/b/c/', 'https://x.org/a/b/', 'https://x.org/a/blog/c/d', 'https://x.org/a/b/c?x=/1/2')}</urlset>")
    (tmp_path / "maps" / "b.xml").write_text(f"{head}<s:urlset xmlns:s='http://www.sitemaps.org/schemas/sitemap/0.9'><s:url><s:loc>https://x.org/a/b/c/</s:loc></s:url><s:url/><s:url><s:loc>https://x.org/q/r/s/t</s:loc></s:url></s:urlset>")
    rows = {r.url: (r.path, r.depth, r.file.rsplit("/", 1)[1]) for r in files.read_sitemap(spark, str(tmp_path / "maps")).collect()}
    assert rows == {"https://x.org/a/b/c/": ("/a/b/c/", 3, "a.xml"), "https://x.org/a/b/c?x=/1/2": ("/a/b/c", 3, "a.xml"), "https://x.org/q/r/s/t": ("/q/r/s/t", 4, "b.xml")}
    assert files.read_sitemap(spark, str(tmp_path / "maps"), 2, []).count() == 5
    (tmp_path / "index.xml").write_text(f"{head}<sitemapindex {space}><sitemap><loc>https://x.org/a.xml</loc></sitemap><sitemap><loc>https://x.org/a.xml</loc></sitemap></sitemapindex>")
    assert [r.url for r in files.read_sitemap_index(spark, str(tmp_path / "index.xml")).collect()] == ["https://x.org/a.xml"]
