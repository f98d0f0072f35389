from pyspark.sql import functions as F

from riskloom.llm import links, neardup, passages, sketch

from .helpers import by, components, named, near, prose, rows, shingles, similar


def test_components_of_near_copies_equal_all_pairs(docs):
    got = neardup.near_duplicates(docs).collect()
    table = {r[0]: r[1] for r in named(rows())}
    sets = {k: shingles(t, 4) for k, t in table.items()}
    want = components(sorted(table), lambda a, b: similar(sets[a], sets[b]))
    assert len(got) == len(named(rows()))
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_a_large_group_with_stragglers(spark, monkeypatch):
    """Chains and stragglers of one group: small blocks and few first candidates send it through all rounds."""
    monkeypatch.setattr(links, "BLOCK", 16)
    monkeypatch.setattr(links, "BEST", 1)
    base = prose(1, 120)
    table = [(k, near(base, k, k % 9)) for k in range(120)] + [(1000 + k, near(near(base, 7, 9), k, k % 4)) for k in range(40)]
    sets = {k: shingles(t, 4) for k, t in table}
    want = components(sorted(sets), lambda a, b: similar(sets[a], sets[b]))
    assert 1 < len(set(want.values())) < 120
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(table, "doc_id bigint, text string")).collect()}
    assert got == want


def test_long_paths_have_one_component(spark):
    table = [(k + 1, k) for k in range(60)] + [(500, 499), (499, 501)]
    got = {r.id: r.component for r in links.components(spark.createDataFrame(table, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 499: 499, 500: 499, 501: 499}


def test_deduplicated_keeps_columns_and_one_of_each(docs, none):
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    got = neardup.near_duplicates(docs).where("kept").select("doc_id").distinct().count()
    assert kept.count() == got == kept.select("doc_id").distinct().count()
    assert neardup.deduplicated(none).count() == 0 and neardup.near_duplicates(none).count() == 0


def test_the_stage_takes_five_words_and_the_query_four(spark):
    import corpus_pipeline

    base = prose(1, 44)
    table = [(k, base if k == 0 else near(base, k, 1)) for k in range(6)]
    keeps = {w: set(components(range(6), lambda a, b: similar(shingles(table[a][1], w), shingles(table[b][1], w))).values()) for w in (4, 5)}
    assert keeps[4] < keeps[5]
    d = spark.createDataFrame(table, "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, d, "").collect()} == keeps[5]
    assert {r.doc_id for r in neardup.near_duplicates(d).where("kept").collect()} == keeps[4]


def test_bands_reach_the_recall():
    bands, width = passages.tuned_bands(0.8)
    assert (1 - 0.8 ** width) ** bands <= 1e-4 and bands <= passages.MAX_BANDS


def test_repeated_paragraphs_equal_all_pairs(docs):
    places = {}
    for r in named(rows()):
        for k, line in enumerate((r[1] or "").split("\n")):
            if len(line.encode().split()) >= passages.MIN_WORDS:
                places[r[0], k] = shingles(line, 5)
    cluster = components(sorted(places), lambda a, b: similar(places[a], places[b]))
    spread = {c: {p[0] for p in m} for c, m in by(places, lambda p: cluster[p]).items()}
    want = {(p, cluster[p]) for p in places if cluster[p] != p and len(spread[cluster[p]]) > 1}
    got = passages.repeated_paragraphs(docs).collect()
    assert {((r.doc_id, r.line), (r.kept_doc_id, r.kept_line)) for r in got} == want
    texts = {r[0]: r[1] for r in named(rows())}
    for r in got:
        assert texts[r.doc_id][r.start:r.end] == texts[r.doc_id].split("\n")[r.line]


def test_cleaned_documents_lose_repeats_only(docs, none):
    out = passages.cleaned(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    passage = prose(70, 55)
    holders = [k for k, r in got.items() if passage in (r.text or "")]
    assert len(holders) == 1
    for r in named(rows()):
        if r[1] and passage in r[1] and r[0] != holders[0]:
            assert got[r[0]].text == r[1].replace("\n" + passage, "") and got[r[0]].n_chars == len(got[r[0]].text)
    assert got[0].text is None and got[10].text == ""
    assert passages.cleaned(none).count() == 0


def test_passages_inside_lines_and_over_line_ends_go(spark, none):
    passage, wrapped, edited = prose(71, 60), prose(72, 60), prose(73, 60)
    fold = lambda t: "\n".join(" ".join(t.split(" ")[k: k + 12]) for k in range(0, 60, 12))
    inside = lambda seed, t: prose(seed, 220) + " " + t + " " + prose(seed + 1, 220)
    other = " ".join(w if k != 30 else "zz" for k, w in enumerate(edited.split(" ")))
    texts = [inside(500, passage), inside(510, passage), prose(520, 15) + "\n" + fold(wrapped) + "\n" + prose(521, 15), inside(530, wrapped),
             inside(540, edited), inside(550, other), inside(560, " ".join(passage.split(" ")[:25])), prose(580, 50) + " " + prose(580, 50)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.kept_doc_id): texts[r.doc_id][r.start:r.end] for r in passages.repeated_paragraphs(d).collect()}
    assert got == {(1, 0): passage, (3, 2): wrapped, (5, 4): other}
    want = dict(enumerate(texts)) | {k: prose(s, 220) + " " + prose(s + 1, 220) for k, s in ((1, 510), (3, 530), (5, 550))}
    assert {r.doc_id: r.text for r in passages.cleaned(d).collect()} == want
    turned = spark.createDataFrame([(k, texts[5 - k]) for k in range(6)], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in passages.cleaned(turned).collect()}[3] == prose(520, 15) + "\n" + prose(521, 15)


def test_edited_texts_and_equal_fingerprints(docs, none):
    got = sketch.edited_fingerprints(docs).withColumn("fp", sketch.fingerprint(F.col("sketch"))).withColumn("near", sketch.likeness(F.col("sketch"), F.col("edited_sketch"))).collect()
    table = named(rows())
    texts = {r[0]: r[1] or "" for r in table}
    order = sorted(texts)
    assert len(got) == len(table)
    for r in got:
        t, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        q = len(t) // 4
        assert (r.n_chars, r.edited) == (len(t), t[:len(t) - q] + after[:q]) and 0 <= r.near <= 1
    prints = by(got, lambda r: texts[r.doc_id])
    assert all(len({r.fp for r in g}) == 1 for g in prints.values())
    assert sketch.edited_fingerprints(none).count() == 0


def test_sketch_estimates_containment_and_merges(spark):
    whole, part, other = prose(1, 9000), " ".join(prose(1, 9000).split(" ")[:900]), prose(2, 4000)
    d = spark.createDataFrame([(whole, part, other)], "w string, p string, o string")
    d = d.select(*[sketch.sketch(F.col(c)).alias(c) for c in "wpo"])
    r = d.select(sketch.containment(F.col("p"), F.col("w")).alias("inside"), sketch.containment(F.col("w"), F.col("p")).alias("back"), sketch.likeness(F.col("w"), F.col("o")).alias("unlike"),
                 sketch.merge(F.col("p"), F.col("o")).alias("m"), "p", "o").first()
    exact = len(shingles(part, 5) & shingles(whole, 5)) / len(shingles(whole, 5))
    assert r.inside == 1.0 and abs(r.back - exact) < 0.05 and r.unlike < 0.2
    low = -(1 << 63) + (1 << 64) // sketch.PART
    assert set(r.m) == {h for h in set(r.p) | set(r.o) if h < low or h == min(r.p + r.o)}
    assert min(r.p) < low


def test_texts_that_share_a_doc_id_stay_apart(spark):
    a, b = prose(31, 90), prose(32, 90)
    table = [(1, a), (1, b), (2, near(a, 1, 2)), (3, near(b, 2, 2)), (4, prose(33, 90)), (1, a), (5, None), (5, "")]
    d = spark.createDataFrame(table, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(d).collect()) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (5, 5)]
    moved = spark.createDataFrame([(7, a), (7, b), (2, near(a, 1, 2)), (9, near(b, 2, 2))], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(moved).collect()) == [(2, 2), (7, 2), (7, 7), (9, 7)]
    assert sorted((r.doc_id, r.text) for r in neardup.deduplicated(moved).collect()) == [(2, near(a, 1, 2)), (7, b)]


def test_blocks_return_forests(spark):
    """Joined pairs of a block equal the components of all pairs, and there is one fewer than members at most."""
    import numpy as np

    r = np.random.default_rng(8)
    for _ in range(40):
        n = int(r.integers(2, 30))
        sets = [np.unique(r.integers(0, 14, r.integers(1, 14)).astype(np.uint64)) for _ in range(n)]
        main = r.random(n) < 0.3
        comp = np.where(main, 1000, np.arange(n))
        out = links._joined(comp, main, sets, 80)
        assert len(out) < n and all(links.alike(sets[x], sets[y], 80) for x, y in out)
        want = components(list(range(n)), lambda a, b: (main[a] and main[b]) or links.alike(sets[a], sets[b], 80))
        got = components(list(range(n)), lambda a, b: (main[a] and main[b]) or (a, b) in out or (b, a) in out)
        assert got == want


def test_unlinked_near_misses_make_no_pairs(spark):
    """Documents at about 0.7: candidates by signature, none linked; what leaves the blocks grows with the members."""
    base, found = prose(77, 400), []
    for n in (60, 120):
        d = spark.createDataFrame([(k, near(base, k, 16)) for k in range(n)], "doc_id bigint, text string")
        light = neardup.signed(d).select(F.col("doc_id").alias("id"), "keys")
        lists = neardup.prefix_lists(light).cache()
        sets = neardup.shingle_sets(d).select(F.col("doc_id").alias("id"), F.lit(1).alias("weight"), "hashes").cache()
        alone = lists.select("id", F.col("id").alias("component")).distinct()
        flagged = links._flagged(links._blocks(lists, alone, links._signatures(sets, lists)), 0, 80)
        assert links._forest(flagged, sets, 80).count() == 0
        found.append((flagged.count(), lists.count()))
        assert found[-1][0] <= 2 * found[-1][1]
    assert found[1][0] < 3.5 * max(1, found[0][0])
