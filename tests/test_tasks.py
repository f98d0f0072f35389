"""Work that is cut into cells and dealt to tasks, against plain code."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.functions.rounds import block_fold
from riskloom.operators import stories as st

T0 = datetime(2024, 1, 1)


def test_denial_overlaps_equal_all_pairs(spark, monkeypatch):
    """Small cells, so that a story needs several; equal times, empty texts and strangers included."""
    monkeypatch.setattr(st, "CELL_TEXTS", 7)
    monkeypatch.setattr(st, "CELL_DENIALS", 4)
    rng = random.Random(3)
    some = lambda n: sorted(rng.sample([f"w{i}" for i in range(60)], rng.randrange(n)))
    at = lambda: T0 + timedelta(minutes=rng.randrange(300))
    stories = [("e0", "s0"), ("e0", "s1"), ("e1", "s2")]
    texts = [(*rng.choice(stories), f"k{i}", (at(), f"t{i:03d}"), some(9)) for i in range(90)]
    asked = [(e, f"t{i:03d}", t, w, s) for i in range(40) for t, w in [(at(), some(25))] for e, s in rng.sample(stories, 2)]
    t = spark.createDataFrame(texts, "entity_id string, start_doc string, key_tokens string, first struct<published_at:timestamp,doc_id:string>, words array<string>")
    a = spark.createDataFrame(asked, "entity_id string, doc_id string, published_at timestamp, denial_words array<string>, start_doc string")
    got = st.denial_overlaps(a, t).select("entity_id", "start_doc", "doc_id", "published_at", "overlap", "first")
    want = a.join(t, ["entity_id", "start_doc"]).filter(F.col("first") < F.struct("published_at", "doc_id")).withColumn(
        "overlap", tx.jaccard(F.col("denial_words"), F.col("words"))).filter(F.col("overlap") >= st.DENIAL_OVERLAP).groupBy(
        "entity_id", "start_doc", "doc_id", "published_at").agg(F.max("overlap").alias("overlap"), F.min(F.unix_seconds("first.published_at")).alias("first"))
    want = sorted(want.collect())
    assert len(want) > 20 and sorted(got.collect()) == want


def test_denials_meet_texts_without_pairs(spark):
    """A denial and the texts of a story are rows of one exchange; a join would make a row of every pair."""
    t = spark.range(400).select(F.lit("e").alias("entity_id"), F.lit("s").alias("start_doc"), F.col("id").cast("string").alias("key_tokens"), F.struct(F.timestamp_seconds("id").alias("published_at"), F.col("id").cast("string").alias("doc_id")).alias("first"), F.array(F.lit("common")).alias("words"))
    a = t.select("entity_id", F.concat(F.lit("d"), "key_tokens").alias("doc_id"), F.timestamp_seconds(F.lit(1000)).alias("published_at"), F.col("words").alias("denial_words"), "start_doc")
    out = st.denial_overlaps(a, t)
    assert out.agg(F.count("*"), F.min("overlap"), F.max("first")).first() == (400, 1.0, 0)
    assert "MapInArrow" in out._jdf.queryExecution().toString() and "array_intersect" not in out._jdf.queryExecution().toString()


def test_denials_go_once_to_the_stories_they_can_reach(spark, monkeypatch):
    """A denial of many stories is one row of the cell, not one a story; one too long for every text is none."""
    seen = []
    real = st.in_tasks
    monkeypatch.setattr(st, "in_tasks", lambda df, keys: seen.append(df) or real(df, keys))
    texts = [("e", f"s{i}", f"k{i}", (T0, f"t{i}"), [f"w{i}", "common"]) for i in range(9)]
    later = T0 + timedelta(hours=1)
    asked = [("e", d, later, words, f"s{i}") for i in range(9) for d, words in (("d0", ["common", "more"]), ("d1", ["common", *[f"x{k}" for k in range(40)]]))]
    t = spark.createDataFrame(texts, "entity_id string, start_doc string, key_tokens string, first struct<published_at:timestamp,doc_id:string>, words array<string>")
    a = spark.createDataFrame(asked, "entity_id string, doc_id string, published_at timestamp, denial_words array<string>, start_doc string")
    got = st.denial_overlaps(a, t).collect()
    assert sorted((r.start_doc, r.doc_id, round(r.overlap, 6)) for r in got) == [(f"s{i}", "d0", 0.333333) for i in range(9)]
    (dealt,) = seen
    assert dealt.filter("_kind = 0").count() == 1 and dealt.filter("_kind = 1").count() == 9


def test_stories_without_retractions_are_matched_once(spark, monkeypatch):
    """Where no closing row moves, a second round would repeat the first."""
    from riskloom.dims.text_rules import FINANCE

    calls = []
    real = st.match_denials
    monkeypatch.setattr(st, "match_denials", lambda *a: calls.append(1) or real(*a))
    label = "struct<primary:string,confidence:double,subtype:string>"
    kinds = {"entity_id": "string", "doc_id": "string", "published_at": "timestamp", "key_text": "string", "source_type": "string", "own_key": "string", "author": "string", "label": label,
             "sentiment": "double", "relevance": "int", "lookalike": "boolean", "authoritative": "boolean", "denial": "boolean", "denial_words": "array<string>"}

    def mention(i, denial):
        words = ["plant", "fire", "halted", "output"]
        return ("E", f"d{i}", T0 + timedelta(minutes=i), " ".join(words), "news", f"v{i}", None, ("OPERATIONAL_ESG", 0.9, None), -0.5, 80, False, True, denial, words if denial else None)

    m = spark.createDataFrame([mention(i, i == 3) for i in range(4)], ", ".join(f"{k} {v}" for k, v in kinds.items()))
    s = st.build_stories(m, FINANCE)
    assert [(r.doc_id, r.kind) for r in s.denials.collect()] == [("d3", "contested")] and s.members.count() == 3
    assert len(calls) == 1


def test_kept_rows_are_small_on_disk_and_whole(spark, tmp_path):
    """Wide rows lie compressed in the scratch folder, as they were; rows no table can hold are cut as before."""
    import os

    from riskloom import session

    before = spark.conf.get(session.CLEANUP, None)
    df = spark.range(20_000).select("id", F.repeat(F.lit("word "), 200).alias("text"), F.timestamp_micros(F.col("id") + 1).alias("at"), F.when(F.col("id") % 2 == 0, F.struct("id")).alias("some"))
    scratch = session.scratch_dir(spark).removeprefix("file:")
    was = set(os.listdir(scratch))
    back = session.kept(df)
    (new,) = set(os.listdir(scratch)) - was
    size = sum(os.path.getsize(os.path.join(scratch, new, f)) for f in os.listdir(os.path.join(scratch, new)))
    assert size < 2_000_000 and back.schema.simpleString() == df.schema.simpleString() and back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    assert spark.conf.get(session.CLEANUP, None) == before
    odd = df.select("id", F.lit(None).alias("nothing"), F.col("id").alias("ID"))
    assert session.kept(odd).count() == 20_000 and session.kept(df.filter("id < 0")).count() == 0


def test_blocks_are_dealt_to_tasks(spark):
    """Few bytes may be much work: the blocks of a fold do not share one task."""
    rows = spark.range(64).select(F.col("id").cast("string").alias("k"), F.lit(1).cast("bigint").alias("block"))

    def fold(state, pdf):
        from pyspark import TaskContext

        return pdf[["k", "block"]].assign(part=TaskContext.get().partitionId()), "done"

    out = block_fold(rows, ["k"], "block", fold, "k string, block bigint, part int", "none")
    assert out.count() == 64 and out.select("part").distinct().count() > 4


def test_a_fold_reads_its_rows_once_a_round(spark):
    """Rows that are dear to make are made once a round, and again only for the blocks that run again; no block, no row."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(k, b, b * 10 + i) for k in ("x", "y") for b in range(3) for i in range(4)] + [(None, 1, 5), ("x", None, 6)], "k string, block bigint, v bigint").coalesce(1)

    def fold(state, pdf):
        out = pdf.sort_values("v")
        return out[["k", "block", "v"]].assign(run=(int(state) + out["v"].cumsum()).astype(int)), str(int(state) + int(out["v"].sum()))

    got = sorted(tuple(r) for r in block_fold(rows.mapInArrow(counted, rows.schema), ["k"], "block", fold, "k string, block bigint, v bigint, run bigint", "0").collect())
    want, total = [], {}
    for k, b, v in sorted((k, b, b * 10 + i) for k in ("x", "y") for b in range(3) for i in range(4)):
        total[k] = total.get(k, 0) + v
        want.append((k, b, v, total[k]))
    assert got == want and made.value <= 3 * 26


def test_spread_bounds_the_rows_of_a_task(spark):
    """Splits as many as cores, each of more rows than a task should compute."""
    from riskloom.session import ROWS_A_TASK, spread

    df = spark.range(0, 5 * ROWS_A_TASK * 4, 1, 4)
    dealt = spread(df)
    assert max(dealt.rdd.glom().map(len).collect()) <= ROWS_A_TASK * 1.1
    assert sorted(r[0] for r in dealt.collect()) == list(range(5 * ROWS_A_TASK * 4))
    few = spark.range(0, 100, 1, 8)
    assert spread(few).rdd.getNumPartitions() == 8
