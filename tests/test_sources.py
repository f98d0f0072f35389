"""Parsers and sinks on landed files."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from riskloom.corpus import ENTITIES
from riskloom.operators import names
from riskloom.sources import documents as src, tables as ref


def test_pack_reader_skips_comments(spark, tmp_path):
    p = tmp_path / "pack.jsonl"
    rows = [{"doc_id": f"x{i}", "source": "s", "source_type": "news", "publisher": "a.example", "published_at": f"2024-01-0{3 - i}T00:00:00Z", "title": "t", "unknown": 1,
             "meta": {"items": ["2.02"], "cik": "1"}} for i in range(2)]
    p.write_text("# head\n\n// note\n" + "\n".join(json.dumps(r) for r in rows) + "\n")
    got = src.ordered(src.read_pack(spark, str(p))).collect()
    assert [r["doc_id"] for r in got] == ["x1", "x0"] and got[0]["items"] == ["2.02"] and got[0]["body"] == ""


def test_filing_feed(spark, tmp_path):
    entry = '<entry><title>{} - Acme Corp (0000000042) (Filer)</title><link rel="a" href="https://h/{}"/><summary type="html">&lt;b&gt;x&lt;/b&gt; Item 2.02: Results of Operations &lt;br&gt;</summary><updated>2024-01-02T10:00:00-05:00</updated><id>urn:accession-number=0001-24-{}</id></entry>'
    (tmp_path / "f.xml").write_text('<?xml version="1.0"?><feed>' + entry.format("8-K", 1, 1) + entry.format("4", 2, 2) + "</feed>")
    known = spark.createDataFrame([("42",)], "cik string")
    r = src.read_filing_feed(spark, str(tmp_path / "f.xml"), known).collect()
    assert len(r) == 1 and r[0]["items"] == ["2.02"] and r[0]["title"].endswith("Item 2.02 Results of Operations") and r[0]["published_at"] == datetime(2024, 1, 2, 15)


def test_social_filters(spark):
    def msg(text, langs=None, op="create"):
        return json.dumps({"did": "d", "time_us": 1704067200000000, "kind": "commit", "commit": {"operation": op, "collection": "app.bsky.feed.post", "rkey": text[:3], "record": {"text": text, "langs": langs}}})
    lines = [msg("thon is a long enough text here"), msg("thon short"), msg("nothing about names in this text"), msg("thon auf deutsch geschrieben", ["de"]), msg("thon $a $b $c $d $e $f spam spam spam"), msg("thon deleted post text here", op="delete")]
    d = src.social_posts(spark.createDataFrame([(x,) for x in lines], "value string"), names.holds_name(ENTITIES))
    assert d.count() == 1 and d.first()["published_at"] == datetime(2024, 1, 1)


def test_contract(spark):
    ok = ("event", 0.1, 0.5, 5, 100, 90, "active", "OTHER")
    rows = [ok, ("event", 1.2, 0.5, 5, 100, 90, "active", "OTHER"), ("story", 0.1, 0.5, 11, 100, 90, "gone", "NOPE")]
    d = spark.createDataFrame(rows, "grain string, sentiment double, sent_conf double, impact int, novelty int, relevance int, status string, event string")
    assert [r["reason"] for r in src.validate(d).collect()] == [None, "sentiment", "impact,grain,status,event"]


def test_large_files_are_digested_in_pieces(spark, tmp_path, monkeypatch):
    """Files larger than a cell, over several splits: any bytes, with and without a last line end or a byte order mark."""
    import gzip
    import hashlib
    import random

    rng = random.Random(5)
    files = {"a.bin": rng.randbytes(70_000), "b.txt": b"\xef\xbb\xbf" + b"line\r\n" * 5_000, "c.txt": b"x\n" * 3_000 + b"no end", "d.txt": b"y" * 20_000, "e.txt": b"\n" * 9_000,
             "f.gz": gzip.compress(rng.randbytes(9_000)), "g.txt": b"small\n", "h.txt": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(ref, "WHOLE", 4_000)
    conf, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(conf, "16384")
    try:
        pieces = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in ref.piecewise_digests(spark, str(tmp_path / "*")).collect()}
        listed = {r["file"]: (r["length"], r["sha256"]) for r in ref.manifest(spark, str(tmp_path / "[!b]*")).select("file", "length", "sha256").collect()}
    finally:
        spark.conf.set(conf, before)
    sha = {k: hashlib.sha256(v).hexdigest() for k, v in files.items()}
    assert pieces == {k: sha[k] for k in ("a.bin", "b.txt", "c.txt", "d.txt", "e.txt")}
    assert listed == {k: (len(v), sha[k]) for k, v in files.items() if k not in ("b.txt", "h.txt")}   # a scan lists no empty file


def test_manifest_and_upserts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h\n1\n2\n")
    (tmp_path / "b.jsonl").write_text("# c\n{}\n")
    m = {r["file"]: r for r in ref.manifest(spark, str(tmp_path / "*")).collect()}
    assert m["a.csv"]["rows"] == 2 and m["b.jsonl"]["rows"] == 1 and len(m["a.csv"]["sha256"]) == 64
    a = spark.createDataFrame([("k", 1, "x"), ("j", 2, "y")], "k string, seq int, v string").withColumn("first", F.col("seq"))
    b = spark.createDataFrame([("k", 5, "z")], "k string, seq int, v string").withColumn("first", F.col("seq"))
    out = {r["k"]: (r["v"], r["first"]) for r in ref.upsert(a, b, ["k"], "seq", ["first"]).collect()}
    assert out == {"k": ("z", 1), "j": ("y", 2)}


def test_labelled_pairs(spark):
    d = spark.createDataFrame([("Sensex gains; Infosys Ltd slides", '{"Sensex": "positive", "Infosys Technologies": "negative", "Wipro": "neutral"}')], "title string, decisions string")
    r = {x["entity"]: x for x in ref.labelled_pairs(d).collect()}
    assert set(r) == {"Sensex", "Infosys Technologies"} and r["Sensex"]["conflict"] and r["Infosys Technologies"]["target"][0]["s"] == 14


def test_registry():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 130
