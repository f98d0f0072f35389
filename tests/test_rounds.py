"""Scans, folds and stories against plain sequential code on small random data."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.functions.scan import Carry, asof_last, hours, prefix_scan
from riskloom.operators import neardup, signals as sg, stories as st
from riskloom.sources.documents import archive_pack
from riskloom.streaming import jobs

T0 = datetime(2024, 1, 1)


def feed(seed, n=160, entities=3, classes=("CREDIT_EVENT", "MACROECONOMIC", "OTHER", "OTHER"), step=90):
    rng = random.Random(seed)
    t, rows = T0, []
    for i in range(n):
        t += timedelta(minutes=rng.choice([1, 7, step, 400]) + rng.random())
        rows.append((f"e{rng.randrange(entities)}", t, f"d{i:04d}", rng.choice(classes)))
    return rows


def sequential(rows):
    """The story rule, one document at a time."""
    open_, out = {}, {}
    for ent, t, doc, ev in sorted(rows, key=lambda r: (r[1], r[2])):
        live = [s for s in open_.get(ent, []) if t - s["seen"] <= timedelta(hours=24)]
        live.sort(key=lambda s: s["seen"], reverse=True)
        recent = [s for s in live if t - s["seen"] <= timedelta(hours=6)]
        if ev == "OTHER":
            hit = recent[0] if recent else None
        else:
            hit = next((s for s in live if ev in s["cls"]), None) or next((s for s in recent if s["cls"] == {"OTHER"}), None)
        if hit is None:
            hit = {"id": doc, "cls": set(), "seen": t}
            open_.setdefault(ent, []).append(hit)
        hit["cls"].add(ev)
        hit["seen"] = t
        out[ent, doc] = hit["id"]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, published_at timestamp, doc_id string, event string")


def test_scan_equals_plain_windows(spark):
    """Null keys, null order values and null values included."""
    rows = feed(1) + [(None, t, d + "n", e) for _, t, d, e in feed(5, n=40)] + [("e0", None, f"z{k}", "OTHER") for k in range(3)]
    df = frame(spark, rows).withColumn("x", F.length("doc_id") + F.ascii(F.substring("doc_id", 5, 1)))
    x, even = F.col("x"), F.when(F.col("x") % 2 == 0, F.col("x"))
    c = [Carry("s", "sum", x), Carry("p", "last", even, inclusive=False), Carry("m", "max", x), Carry("f", "first", F.col("doc_id"))]
    got = prefix_scan(df, ["entity_id"], ["published_at", "doc_id"], hours("published_at", 6), c, split=True)
    w = Window.partitionBy("entity_id").orderBy("published_at", "doc_id")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.sum(x).over(upto).alias("s"), F.last(even, ignorenulls=True).over(before).alias("p"), F.max(x).over(upto).alias("m"), F.first("doc_id").over(upto).alias("f"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_asof_equals_all_pairs(spark):
    rows = feed(2) + [(None, t, d + "n", e) for _, t, d, e in feed(6, n=40)]
    df = frame(spark, rows)
    facts = df.filter("event <> 'OTHER'").select("entity_id", "published_at", F.col("event").alias("e"))
    got = asof_last(df.select("entity_id", "published_at", "doc_id"), facts, ["entity_id"], "published_at", hours("published_at", 6), ["e"], split=True).collect()
    for r in got:
        past = [(t, e) for ent, t, _, e in rows if ent == r["entity_id"] and t <= r["published_at"] and e != "OTHER"]
        assert r["e"] == (max(past)[1] if past else None)
    assert len(got) == len(rows) and any(r["e"] for r in got)


def test_story_chains_equal_sequential_rule(spark):
    for seed, split in ((3, False), (4, True)):
        rows = feed(seed)
        got = {(r["entity_id"], r["doc_id"]): r["start_doc"] for r in st.assign(frame(spark, rows), spark.createDataFrame([], st.RESET), split).collect()}
        assert got == sequential(rows)


def member(i, minutes, title, publisher, kind="news", author=None, event="CREDIT_EVENT", denial=False, words=None, auth=False):
    return ("E", f"d{i:02d}", T0 + timedelta(minutes=minutes), kind, publisher, author, None, title, title, (event, "BANK_RUN", 0.9, [event], "x"), 0.95, 100, "s", title,
            -0.8, 0.9, 0.8, auth, False, f"{kind}:{author or publisher}", words, denial)


SCHEMA = ("entity_id string, doc_id string, published_at timestamp, source_type string, publisher string, author string, url string, title string, key_text string, "
          "label struct<primary:string,subtype:string,confidence:double,labels:array<string>,method:string>, ned double, relevance int, surface string, span string, sentiment double, sent_conf double, "
          "credibility double, authoritative boolean, lookalike boolean, own_key string, denial_words array<string>, denial boolean")


def build(spark, rows):
    from riskloom.dims.text_rules import FINANCE

    m = spark.createDataFrame(rows, SCHEMA)
    for c in ("windows", "spans", "probs", "kinds"):
        m = m.withColumn(c, F.lit(None).cast("string"))
    return st.build_stories(m, FINANCE)


W = ["bank", "halts", "withdrawals", "harbor", "customers"]


def test_unconfirmed_story_is_retracted_and_a_new_one_opens(spark):
    s = build(spark, [member(1, 0, "Harbor bank halts withdrawals", "a.example"), member(2, 30, "Harbor bank customers halted withdrawals today", "b.example"),
                      member(3, 60, "Denial", "sec.gov", denial=True, words=W), member(4, 90, "Harbor bank halts withdrawals again says paper", "c.example")])
    d = s.denials.collect()
    assert [(x["doc_id"], x["kind"], x["start_doc"]) for x in d] == [("d03", "retracted", "d01")]
    assert {r["doc_id"]: r["start_doc"] for r in s.members.collect()} == {"d01": "d01", "d02": "d01", "d04": "d04"}
    e = sg.event_signals(s).orderBy("as_of").collect()
    assert [x["status"] for x in e] == ["active", "active", "retracted", "active"]
    assert e[2]["publishers"] == 2 and "official_denial" in e[2]["flags"]


def test_confirmed_story_is_contested(spark):
    rows = [member(i, i, f"Harbor bank halts withdrawals number {i} unique{i}", f"p{i}.example") for i in range(1, 4)]
    s = build(spark, [*rows, member(9, 60, "Denial", "sec.gov", denial=True, words=W), member(10, 70, "Harbor bank halts withdrawals once more", "z.example")])
    assert [x["kind"] for x in s.denials.collect()] == ["contested"]
    assert {r["start_doc"] for r in s.members.collect()} == {"d01"}
    last = sg.event_signals(s).orderBy("as_of").collect()[-1]
    assert last["status"] == "active" and "contested" in last["flags"] and last["publishers"] == 4


def test_swarm_counts_once_and_hourly_voices(spark):
    from riskloom.dims.text_rules import FINANCE

    posts = [member(i, i, "Harbor bank is collapsing get out now", "x.example", "social", f"u{i}") for i in range(1, 8)]
    press = [member(20, 10, "Paper one reports harbor bank story", "a.example"), member(21, 40, "Second view entirely different words here", "b.example"), member(22, 85, "Third outlet other wording", "c.example")]
    s = build(spark, [*posts, *press])
    g = st.social_groups(s.members, FINANCE)
    assert g.select("group_id").distinct().count() == 1 and g.count() == 7
    e = {r["doc_id"]: r for r in sg.event_signals(s, g).collect()}
    assert e["d07"]["coordinated"] and e["d07"]["social_authors"] == 7 and not e["d04"]["coordinated"]
    assert [e[d]["publishers_60m"] for d in ("d20", "d21", "d22")] == [1, 2, 2]
    rows = {r["doc_id"]: r for r in s.members.collect()}
    w = lambda d: rows[d]["relevance"] / 100 * max(rows[d]["credibility"], .05) * rows[d]["sent_conf"]
    group = sum(w(f"d0{i}") for i in range(1, 8)) / 7
    den = group + sum(w(d) for d in ("d20", "d21", "d22"))
    assert abs(e["d22"]["sent_conf"] - round(den / (den + 0.25), 4)) < 1e-3


def test_copies_keep_the_first_voice(spark):
    rows = [member(1, 0, "Harbor bank halts customer withdrawals after rumours spread", "a.example"), member(2, 5, "Harbor bank halts customer withdrawals after rumours spread", "b.example"),
            member(3, 9, "Harbor bank halts customer withdrawals after rumours spread", "c.example")]
    m = {r["doc_id"]: r for r in build(spark, rows).members.collect()}
    assert {m[d]["voice"] for d in m} == {"news:a.example"} and [m[d]["novelty"] for d in ("d01", "d02", "d03")] == [100, 50, 33]


def test_rate_limit_blocks_equal_sequential(spark):
    rng = random.Random(5)
    rows, t = [], T0
    for i in range(300):
        t += timedelta(minutes=rng.choice([1, 3, 9, 200]))
        rows.append((rng.choice("ab"), f"p{i:04d}", t))
    want, times = set(), {}
    for a, p, t in rows:
        live = [x for x in times.get(a, []) if (t - x).total_seconds() <= 3600]
        if len(live) < 5:
            live.append(t)
            want.add(p)
        times[a] = live
    df = spark.createDataFrame(rows, "a string, id string, ts timestamp")
    assert {r["row_id"] for r in jobs.rate_limited_batch(df, "a", "ts", "id").collect()} == want


def test_archive_pack_equals_greedy(spark):
    rng = random.Random(6)
    words = ["alpha beta gamma", "delta epsilon zeta", "eta theta iota", "kappa lambda nu", "omega sigma tau", "rho phi chi"]
    rows = [(f"20240101{rng.randrange(4):02d}{rng.choice((0, 15)):02d}00", f"https://www.{rng.choice('xy')}.example/{rng.choice(words).replace(' ', '-')}?q={i}", "0") for i in range(120)]
    kept, seen, slots = set(), set(), {}
    for when, url, _ in sorted(rows):
        dom, title = url.split("/")[2][4:], url.split("/")[3].split("?")[0]
        if (dom, title) in seen or slots.get((dom, when), 0) >= 3:
            continue
        seen.add((dom, title))
        slots[dom, when] = slots.get((dom, when), 0) + 1
        kept.add(url)
    got = archive_pack(spark.createDataFrame(rows, "date_added string, url string, tone string"), "p", frozenset())
    assert {r["url"] for r in got.collect()} == kept


def test_gap_chains(spark):
    rows = [("k", T0, 1), ("k", T0 + timedelta(hours=23), 2), ("k", T0 + timedelta(hours=48), 3)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int")
    assert [r["chain"] for r in neardup.gap_chains(df, ["k"], "ts", "id").orderBy("id").collect()] == [0, 0, 1]


def test_rows_of_a_large_key_come_in_order_and_in_chunks():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": "x", "t": rng.integers(0, 50, 1000), "id": [f"{i:04d}" for i in rng.permutation(1000)]})
    want = pdf.sort_values(["t", "id"]).reset_index(drop=True)
    parts = list(jobs.in_order(iter([pdf.iloc[i:i + 70] for i in range(0, 1000, 70)]), ["t", "id"], chunk=128))
    assert max(map(len, parts)) == 128
    pd.testing.assert_frame_equal(pd.concat(parts, ignore_index=True), want)
    fold, state, kept = jobs.rate_fold(2, 1, "id"), [], []
    for p in parts:
        out, state = fold(state, p.assign(t=p["t"] * 400_000))
        kept += list(out["id"])
    assert kept == list(jobs.rate_fold(2, 1, "id")([], want.assign(t=want["t"] * 400_000))[0]["id"])
