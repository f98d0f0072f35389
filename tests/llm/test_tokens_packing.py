import random

import numpy as np
import pytest

from riskloom.llm import packing, tokens
from riskloom.session import new_path

from .helpers import by, named, rows

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def plain(path, texts, special_as_text=False):
    """The unaltered library; ``special_as_text`` is its one switch."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    if special_as_text:
        t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("special_as_text", [False, True])
@pytest.mark.parametrize("path, spaces", [(WORD, "dropped"), (BYTE, "leading")])
def test_memoised_encoding_equals_the_tokenizer(path, spaces, special_as_text):
    from riskloom.llm.common import TextEncoder

    r = random.Random(5)
    bits = ["a.", ",b", "._", ".9", "\u0301.", "\u0130", "a", "it's", "don't", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "\x1c", " ", "9", "42", "!", "?!", "é", "é", "你好", "\U0001f600", "ΣΣ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "WORD", "\x00", "'s"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    texts += [" x", "x ", "\nx", "x\n", " ", "", "\n", "a b c", "a\nb", "a \nb", "a\n b"]
    enc = TextEncoder(path, spaces, 4, special_as_text)
    want = plain(path, texts, special_as_text)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == want   # from the memo


def test_full_memo_still_encodes(monkeypatch):
    from riskloom.llm import common

    monkeypatch.setattr(common, "MEMO_BYTES", 600)
    enc = common.TextEncoder(BYTE, "leading", 4)
    texts = ["one two three four five", "one two six"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == plain(BYTE, texts)


def test_ranks_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (r.integers(0, 2**32, n, dtype=np.uint64) >> r.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = tokens.pack_ranks(x)
        assert len(control) == -(-n // 4)
        assert tokens.unpack_ranks(control, data, n).tolist() == x.tolist()
    assert tokens.unpack_block(tokens.pack_block([5, -1], [0, 2], np.array([1, 70_000], np.uint32)))[2].tolist() == [1, 70_000]


def test_files_give_back_every_id(spark, docs):
    path = new_path(spark, "t")
    tokens.write_ranked(docs, path, WORD, 2, "dropped", 2)
    got = sorted((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in tokens.read_ranked(spark, path).collect())
    table = named(rows())
    ids = sorted((r[0], x + [2]) for r, x in zip(table, plain(WORD, [r[1] or "" for r in table]), strict=True))
    at = 0
    for (doc, start, n, raw), (want_doc, want) in zip(got, ids, strict=True):
        assert (doc, start, n, np.frombuffer(raw, "<u4").tolist()) == (want_doc, at, len(want), want)
        at += n
    ranks = {r["id"]: r["rank"] for r in spark.read.parquet(f"{path}/ranks").collect()}
    assert ranks[max(ranks, key=lambda i: sum(x.count(i) for _, x in ids))] == 0


def test_empty_tables(spark, none):
    path = new_path(spark, "t")
    tokens.write_ranked(none, path, WORD, 2, "dropped", 2)
    assert tokens.read_ranked(spark, path).count() == 0
    assert packing.pack(none, BYTE, 0, spaces="leading").count() == 0


def test_levels_minimise_the_sum_of_squares():
    p, r = packing.LevelPacker(64), random.Random(3)

    def total(levels):
        return int((levels[1:64] ** 2).sum())

    for k in range(400):
        size = r.randint(1, 63)
        options = []
        for g in range(64 - size + 1):
            if g == 0 or p.levels[g]:
                n = p.levels.copy()
                n[g] -= bool(g)
                n[g + size] += g + size < 64
                options.append(total(n))
        list(p.place((k, 0, size, b"\0" * 4 * size)))
        assert total(p.levels) == min(options)
        assert sum(len(x) for x in p.open) == p.n_open == p.levels.sum()


@pytest.mark.parametrize("max_open", [4, 8192])
def test_every_id_lies_in_one_piece(docs, max_open):
    got = packing.pack(docs, BYTE, 0, window=64, spaces="leading", width=2, max_open=max_open).collect()
    table = named(rows())
    want = by(zip(table, plain(BYTE, [r[1] or "" for r in table]), strict=True), lambda x: x[0][0])
    for doc, pieces in by(got, lambda r: r.doc_id).items():
        ids = want[doc][0][1] + [0]
        copies = len(want[doc])
        assert sum(r.length for r in pieces) == copies * len(ids)
        for r in pieces:
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids[r.start: r.start + r.length] and r.doc_tokens == len(ids)
    assert len(by(got, lambda r: r.doc_id)) == len(want)
    fills = []
    for pieces in by(got, lambda r: r.sequence_id).values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        fills.append(at)
    assert max(fills) <= 64
    if max_open > 4:
        assert sum(f < 64 for f in fills) <= 3   # one for each task
