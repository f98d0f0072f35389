import collections
import hashlib

import numpy as np
import pytest

from riskloom.llm import alignment, queries

from .helpers import SCHEMA, named, prose, rows

HARD = ["", " ", "a", "  two  spaces ", "▁ is no space", "tab\tand\r\nline", "<|endoftext|><s></s><unk>", "é你好\U0001f600" * 3, "\u0000nul", "=" * 300, "ﬁ ligature ① ½", "é combining", "<0x0A>",
        "x" * 50 + " " * 40 + "y", prose(3, 9000)]


@pytest.fixture(scope="module")
def sides():
    return alignment.ByteLevel(queries.vocabulary("byte_bpe_50k.json")), alignment.Pieces(queries.vocabulary("piece_bpe_32k.model"))


def plain(t):
    """Ids by the unaltered libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a.encode(" " + t, add_special_tokens=False).ids, sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model")).encode(t)


def test_encoders_equal_the_libraries(sides):
    import random

    import sentencepiece
    from tokenizers import Tokenizer

    r = random.Random(4)
    bits = ["a", "it's", "don't", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "9", "42", "!", "é", "e\u0301", "你好", "\U0001f600", "<|endoftext|>", "<s>", "WORD", "\x00", "▁", "\ufb01", "\u3000", "the", "ing"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(4000)] + HARD
    a = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    for _ in range(2):      # the second time from the memo
        assert [x.tolist() for x in sides[0].encode(texts)] == [e.ids for e in a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        assert [x.tolist() for x in sides[1].encode(texts)] == b.encode(texts)


def brute(texts, a, b):
    """Per text: (a ids, b ids, groups, links), by sets of byte ends."""
    out = []
    for t in texts:
        whole = (" " + (t or "")).encode()
        ids = plain(t or "")
        if not t or any(b"".join(s.bytes[k] for k in x) != whole for s, x in zip((a, b), ids)):
            out.append(([], [], [], []))
            continue
        spans = []
        for s, x in zip((a, b), ids):
            at, spans_ = 0, []
            for k in x:
                spans_.append((at, at + len(s.bytes[k]), k))
                at += len(s.bytes[k])
            spans.append(spans_)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [([k for _, e, k in spans[0] if lo < e <= hi], [k for _, e, k in spans[1] if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)] if len(whole) < 3000 else None
        by_end = {e: k for _, e, k in spans[1]}
        out.append((ids[0], ids[1], groups, [(k, by_end[e]) for _, e, k in spans[0] if e in by_end]))
    return out


def test_counts_equal_brute_force(spark, sides, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_ROWS", 7)
    table = [r for r in rows() if len(r[1] or "") < 20_000] + [(1000 + k, t, "en", "s", 1, 7, "x", "y", "z") for k, t in enumerate(HARD)]
    docs = spark.createDataFrame(table, SCHEMA).repartition(3)
    got = collections.Counter(tuple(r) for r in alignment.alignment_counts(docs, queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model"))
                              .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    kept = named(table)
    said = brute([r[1] for r in kept], *sides)
    counts = collections.Counter(p for s in said for p in s[3])
    most: dict[int, int] = {}
    for (_, y), c in counts.items():
        most[y] = max(most.get(y, 0), c)
    want = collections.Counter()
    for r, (x, y, groups, links) in zip(kept, said):
        if groups is None:
            continue
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        want[(r[0], len(x), len(y), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if x else "")] += 1
    assert not want - got and sum(got.values()) == len(kept)
    assert sum(1 for g in got if g[1] == 0) >= 3     # null, empty, texts that are not spelt


def test_groups_as_spans(spark, sides):
    text = "Cross-tokenizer alignments, naïvely coalesced 12345 times"
    docs = spark.createDataFrame([(1, text), (2, None), (3, text[::-1])], "doc_id bigint, text string").coalesce(1)
    got = alignment.aligned_groups(docs, queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")).orderBy("doc_id", "group").collect()
    for doc_id, t in ((1, text), (3, text[::-1])):
        (x, y, groups, links), = brute([t], *sides)
        mine = [g for g in got if g.doc_id == doc_id]
        assert [(g.a_ids, g.b_ids) for g in mine] == groups and [g.group for g in mine] == list(range(len(groups)))
        whole = (" " + t).encode()
        assert [whole[g.start:g.end] for g in mine] == [b"".join(sides[0].bytes[k] for k in g.a_ids) for g in mine]
        assert [(g.a_ids[o.a], g.b_ids[o.b]) for g in mine for o in g.overlaps if o.together] == links
        for g in mine:      # every token overlaps one of the other side
            assert {o.a for o in g.overlaps} == set(range(len(g.a_ids))) and {o.b for o in g.overlaps} == set(range(len(g.b_ids)))


def test_overlaps_by_all_pairs():
    r = np.random.default_rng(3)
    for _ in range(30):
        n = int(r.integers(1, 60))
        ends = [np.unique(np.append(r.integers(1, n + 1, r.integers(1, 20)), n)) for _ in range(2)]
        spans = [list(zip(np.append(0, e[:-1]).tolist(), e.tolist())) for e in ends]
        i, j = alignment.overlaps(*ends)
        want = [(x, y) for x, (s, e) in enumerate(spans[0]) for y, (u, v) in enumerate(spans[1]) if s < v and u < e]
        assert list(zip(i.tolist(), j.tolist())) == want and len(want) < len(ends[0]) + len(ends[1])


def test_no_documents(spark, none):
    assert alignment.alignment_counts(none, queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")).collect() == []
