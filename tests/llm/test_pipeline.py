"""The pipeline's stages one after the other, each held against a plain version over its own input."""

import collections

import corpus_pipeline
from riskloom.llm import mixing
from riskloom.llm.queries import vocabulary

from .helpers import components, shingles, similar

SF = "/root/testdata/sf0.001"


def test_stages_on_an_empty_table(spark, none):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == docs.columns


def test_each_stage_on_all_that_its_predecessor_kept(spark):
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = stages["quality rules"](spark, docs, SF).cache()
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) < {r.doc_id for r in docs.select("doc_id").collect()}

    # near copies: the smallest doc_id of every component of five-word shingles
    sets = {k: shingles(t, 5) for k, t in texts.items()}
    first = set(components(sorted(sets), lambda a, b: similar(sets[a], sets[b])).values())
    near = stages["MinHash near-dedup"](spark, kept, SF).cache()
    left = {r.doc_id: r.text for r in near.collect()}
    assert set(left) == first and all(left[k] == texts[k] for k in left)

    # passages: no run of 40 equal words is left in two documents, and what is left stood there before, in order
    cut = stages["substring dedup"](spark, near, SF).cache()
    rest = {r.doc_id: r.text or "" for r in cut.collect()}
    runs = collections.defaultdict(set)
    for k, t in rest.items():
        w = t.lower().split()
        for i in range(len(w) - 39):
            runs[tuple(w[i: i + 40])].add(k)
    assert all(len(v) == 1 for v in runs.values())
    for k, t in rest.items():
        words = iter((left[k] or "").split())
        assert all(any(w == x for x in words) for w in t.split())

    # the mix: every document as often as its share says
    mixed = stages["mixing sources to target weights"](spark, cut, SF).cache()
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(cut).collect()}
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert all(copies[k] == (t // s if s else copies[k]) for k, (t, s) in taken.items()) and sum(copies.values()) > 0

    # packing: the pieces of all copies give back the ids of the plain tokenizer, and windows are full but few
    packed = stages["packing"](spark, mixed, SF).collect()
    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    sizes = {k: len(plain.encode(t, add_special_tokens=False).ids) + 1 for k, t in rest.items()}
    held = collections.Counter()
    for r in packed:
        assert r.doc_tokens == sizes[r.doc_id]
        held[r.doc_id] += r.length
    assert all(held[k] == copies[k] * sizes[k] for k in copies)
