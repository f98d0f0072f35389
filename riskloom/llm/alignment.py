"""Alignment of two tokenizers by interval coalescing over byte offsets.

A text is encoded twice and each token becomes the range of bytes that it covers. All ranges of both sides are sorted by
start; the running maximum of their ends tells where a start reaches it, and there a group ends: the smallest spans that
whole tokens of both sides fill. Inside a group the overlapping pairs are expanded (at most as many as there are
tokens), and the pairs whose ranges end together are links.

Documents are taken in chunks; all of a chunk's documents are aligned in one pass over arrays, since a document's end is
an end on both sides. Pairs of ids are counted inside the chunk first, then over the corpus by a grouped sum. A chunk
writes its dictionary of pairs and each document's links as places in it, so what comes back to the documents is one
row for each pair of a chunk, not one for each link.

Defined cases: null and empty texts, and texts whose tokens do not spell space + text on both sides, have no tokens:
zeros, and '' in place of groups; strings of special tokens are plain text; rows that repeat a doc_id are documents each,
and rows without one are left out and not counted; texts of any length are aligned whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ENTRY_BYTES, MEMO_BYTES, encoder, identified, released, written

#: Characters and documents of a chunk at most (a longer text is a chunk of its own); characters encoded at a time.
CHUNK_CHARS, CHUNK_ROWS, ENCODE_CHARS = 1_000_000, 2048, 100_000


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library, over space + text; strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.encoder = encoder(path, "leading", 4, special_as_text=True)
        letters, vocabulary = byte_of_letter(), self.encoder.tokenizer.get_vocab()
        self.bytes = [b""] * (1 + max(vocabulary.values()))
        for entry, k in vocabulary.items():
            self.bytes[k] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4").astype(np.int32) for x in self.encoder.encode([" " + t for t in texts])]


class Pieces:
    """A sentencepiece model, which puts the space before a text itself.

    Where no piece holds a space behind another character, nothing joins over the start of a word, so words between
    single spaces are encoded apart, each once as far as the memo reaches; other texts go to the model whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.memo, self.memo_bytes = {}, 0

    def _model(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, "<i4").tobytes() for x in self.model.encode(texts, num_threads=1)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # U+2581 in a text is what the model writes for a space
        cut = [t.split(" ") if self.apart and not self.WHOLE.search(t) else None for t in texts]
        new = list({w: None for ws in cut if ws for w in ws if w not in self.memo})
        fresh = dict(zip(new, self._model(new), strict=True))
        size = sum(len(w) + len(x) + ENTRY_BYTES for w, x in fresh.items())
        if self.memo_bytes + size <= MEMO_BYTES:
            self.memo.update(fresh)
            self.memo_bytes += size
        get = lambda w: self.memo.get(w) or fresh[w]
        whole = iter(self._model([t for t, ws in zip(texts, cut, strict=True) if ws is None]))
        return [np.frombuffer(next(whole) if ws is None else b"".join(map(get, ws)), "<i4") for ws in cut]

    #: Texts that words between single spaces do not make up, or in which a character may change its neighbours.
    WHOLE = re.compile(r"^$|^ | $|  |[^\S \n]|▁")


@lru_cache(maxsize=1)
def sides(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    """The Python worker's two encoders; their memos are bounded."""
    return ByteLevel(a_path), Pieces(b_path)


def coalesced(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A and every B token; both sides cover the same bytes from 0 without gaps."""
    ends = np.concatenate([a_ends, b_ends])
    starts = np.concatenate([_starts(a_ends), _starts(b_ends)])
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    opens = np.ones(len(order), bool)
    opens[1:] = starts[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    return group[: len(a_ends)], group[len(a_ends):]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all A and B tokens that share a byte, by i then j."""
    low = np.searchsorted(b_ends, _starts(a_ends), side="right")
    high = np.searchsorted(_starts(b_ends), a_ends, side="left")
    many = high - low
    i = np.repeat(np.arange(len(a_ends)), many)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + low[i]


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1]])


@dataclass
class Aligned:
    """A chunk: the documents that have tokens (``ok``), their tokens end to end, and what belongs together."""

    ok: np.ndarray            # of the chunk's documents
    a: np.ndarray             # ids
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    a_doc: np.ndarray         # document of a token, among those that are ok
    b_doc: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    i: np.ndarray             # overlapping pairs of places
    j: np.ndarray

    @property
    def together(self) -> np.ndarray:
        """Of the overlapping pairs: whether both end at the same byte."""
        return self.a_ends[self.i] == self.b_ends[self.j]


def spelt(ids: np.ndarray, table: list[bytes], raw: np.ndarray) -> np.ndarray:
    """Places where the bytes of the tokens, end to end, differ from ``raw`` of the same length."""
    lengths = np.fromiter(map(len, table), np.int64, len(table))
    letters = np.frombuffer(b"".join(table), np.uint8)
    n = lengths[ids]
    at = np.repeat((np.cumsum(lengths) - lengths)[ids] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return np.flatnonzero(letters[at] != raw)


def align(texts: list[str], a: ByteLevel, b: Pieces) -> Aligned:
    ids: tuple[list, list] = ([], [])
    for part in parts_of(texts, ENCODE_CHARS, len(texts)):
        for side, s in zip(ids, (a, b), strict=True):
            side += s.encode(texts[part])
    raw = [(" " + t).encode() for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    lengths = [np.fromiter(map(len, s.bytes), np.int64, len(s.bytes)) for s in (a, b)]
    ok = sizes > 1
    for side, n in zip(ids, lengths, strict=True):
        ok &= np.array([int(n[x].sum()) for x in side], np.int64) == sizes
    for side, s in zip(ids, (a, b), strict=True):
        at = np.flatnonzero(ok)
        if len(at):
            wrong = spelt(np.concatenate([side[k] for k in at]), s.bytes, np.frombuffer(b"".join(raw[k] for k in at), np.uint8))
            ok[at[np.searchsorted(np.cumsum(sizes[at]), wrong, side="right")]] = False
    parts = []
    for side, n in zip(ids, lengths, strict=True):
        kept = [side[k] for k in np.flatnonzero(ok)]
        flat = np.concatenate(kept) if kept else np.zeros(0, np.int32)
        parts.append((flat, np.cumsum(n[flat]), np.repeat(np.arange(len(kept), dtype=np.int32), [len(x) for x in kept])))
    (x, x_ends, x_doc), (y, y_ends, y_doc) = parts
    return Aligned(ok, x, y, x_ends, y_ends, x_doc, y_doc, *coalesced(x_ends, y_ends), *overlaps(x_ends, y_ends))


def parts_of(texts: list[str], most_chars: int, most_rows: int):
    """Slices of texts of bounded size (a longer text is one of its own)."""
    at = 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and to - at < most_rows and (to == at or chars + len(texts[to]) <= most_chars):
            chars += len(texts[to])
            to += 1
        yield slice(at, to)
        at = to


def group_texts(c: Aligned, names: list[str], shift: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each document that has tokens. ``names``: ``name_table``; ``shift``: ids on side A."""
    groups = int(c.a_group[-1]) + 1 if len(c.a_group) else 0
    in_a, in_b = np.bincount(c.a_group, minlength=groups), np.bincount(c.b_group, minlength=groups)
    code = np.empty(len(c.a) + len(c.b), np.int64)
    last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
    code[np.arange(len(c.a)) + (np.cumsum(in_b) - in_b)[c.a_group]] = 2 * c.a + last(c.a_group)
    code[np.arange(len(c.b)) + np.cumsum(in_a)[c.b_group]] = 2 * (shift + c.b) + last(c.b_group)
    docs = int(c.ok.sum())
    ends = np.cumsum(np.bincount(c.a_doc, minlength=docs) + np.bincount(c.b_doc, minlength=docs))
    return ["".join(map(names.__getitem__, code[lo:hi].tolist()))[:-1] for lo, hi in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]


def name_table(a: int, b: int) -> list[str]:
    """Decimal ids with what follows them: inside a side, or at its end."""
    return [f"{k}{s}" for k in range(a) for s in ",|"] + [f"{k}{s}" for k in range(b) for s in ",;"]


def chunks(batches):
    """(doc_ids, texts) of bounded size."""
    for t in (b.slice(at, CHUNK_ROWS) for b in released(batches) for at in range(0, b.num_rows, CHUNK_ROWS)):
        ids, texts = t.column(0).to_pylist(), [x or "" for x in t.column(1).to_pylist()]
        for part in parts_of(texts, CHUNK_CHARS, CHUNK_ROWS):
            yield ids[part], texts[part]


def aligned_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Groups of all documents: doc_id, group, start and end byte of space + text, a_ids, b_ids, and the places of the
    tokens that overlap (``a``, ``b`` from 0 inside the group, whether they end ``together``)."""

    def run(batches):
        import pyarrow as pa

        a, b = sides(a_path, b_path)
        for ids, texts in chunks(batches):
            c = align(texts, a, b)
            named = np.array(ids, np.int64)[c.ok]
            base = np.append(0, c.a_ends)[np.searchsorted(c.a_doc, np.arange(len(named)))] if len(named) else np.zeros(0, np.int64)
            groups = int(c.a_group[-1]) + 1 if len(c.a_group) else 0
            a_at, b_at = np.searchsorted(c.a_group, np.arange(groups + 1)), np.searchsorted(c.b_group, np.arange(groups + 1))
            o_at = np.searchsorted(c.a_group[c.i], np.arange(groups + 1))
            doc = c.a_doc[a_at[:-1]]
            first = np.searchsorted(doc, doc)
            edge = np.append(0, c.a_ends[a_at[1:] - 1])
            lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))
            pair_group = c.a_group[c.i]
            links = pa.StructArray.from_arrays(
                [pa.array((c.i - a_at[pair_group]).astype(np.int32)), pa.array((c.j - b_at[pair_group]).astype(np.int32)), pa.array(c.together)], names=["a", "b", "together"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(named[doc]), pa.array(np.arange(groups) - first), pa.array(edge[:-1] - base[doc]), pa.array(edge[1:] - base[doc]), lists(a_at, c.a), lists(b_at, c.b),
                 pa.ListArray.from_arrays(pa.array(o_at.astype(np.int32)), links)], names=["doc_id", "group", "start", "end", "a_ids", "b_ids", "overlaps"])

    return identified(docs).mapInArrow(run, "doc_id bigint, group bigint, start bigint, end bigint, a_ids array<int>, b_ids array<int>, overlaps array<struct<a:int,b:int,together:boolean>>")


SUMMARY = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, chunk bigint, links binary, pairs array<bigint>, counts array<bigint>"


def summaries(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Two kinds of rows: a document's counts, digest and links (places in its chunk's dictionary), and a chunk's
    dictionary (``pairs``: A id * 2^32 + B id, and how many links of the chunk hold each)."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        a, b = sides(a_path, b_path)
        names, shift = name_table(len(a.bytes), len(b.bytes)), len(a.bytes)
        schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("chunk", pa.int64()), ("links", pa.binary()),
                            ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
        task = TaskContext.get()
        # written once with the table, so that the number need only be unlike those of the other tasks
        base = (task.partitionId() if task else 0) << 32
        for number, (ids, texts) in enumerate(chunks(batches)):
            c = align(texts, a, b)
            kept, full = int(c.ok.sum()), len(ids)
            together = c.together
            i, j = c.i[together], c.j[together]
            pairs, place, counts = np.unique(c.a[i].astype(np.int64) << 32 | c.b[j], return_inverse=True, return_counts=True)
            place = place.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
            per = lambda doc: np.bincount(doc, minlength=kept)
            group_doc = c.a_doc[np.flatnonzero(np.append(True, c.a_group[1:] != c.a_group[:-1])[: len(c.a_group)])]
            n_links = per(c.a_doc[i])
            ends = np.cumsum(n_links)
            blobs = [place[hi - n: hi].tobytes() for n, hi in zip(n_links.tolist(), ends.tolist(), strict=True)]
            digests = [hashlib.sha256(s.encode()).hexdigest() for s in group_texts(c, names, shift)]
            wide = {}
            for n, v in (("n_a", per(c.a_doc)), ("n_b", per(c.b_doc)), ("n_groups", per(group_doc)), ("n_links", n_links)):
                wide[n] = np.zeros(full, np.int64)
                wide[n][c.ok] = v
            at = np.cumsum(c.ok) - 1
            pick = lambda values, none: [values[k] if o else none for k, o in zip(at.tolist(), c.ok.tolist(), strict=True)]
            chunk, nothing = base + number, [None] * full
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(v) for v in wide.values()), pa.array(pick(digests, "")), pa.array([chunk] * full, pa.int64()), pa.array(pick(blobs, b""), pa.binary()),
                 pa.array(nothing, pa.list_(pa.int64())), pa.array(nothing, pa.list_(pa.int64()))], schema=schema)
            only = {"chunk": chunk, "pairs": pairs, "counts": counts}
            yield pa.RecordBatch.from_arrays([pa.array([only.get(f.name)], f.type) for f in schema], schema=schema)

    return identified(docs).mapInArrow(run, SUMMARY)


def pair_counts(dictionaries: DataFrame) -> DataFrame:
    """pair, count (links corpus-wide), best (no pair of the same B id counts more); ``dictionaries``: chunk, place, pair, n."""
    totals = dictionaries.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = totals.groupBy("b").agg(F.max("count").alias("most"))
    return totals.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    import pyarrow as pa

    done = written(summaries(docs, a_path, b_path), "alignment")
    entries = done.where("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "e")).select("chunk", "place", F.col("e.pairs").alias("pair"), F.col("e.counts").alias("n"))
    judged = written(pair_counts(entries), "pair-counts")
    back = entries.join(judged, "pair").select("chunk", "place", "count", "best")
    rows = done.where("doc_id IS NOT NULL").drop("pairs", "counts")

    def run(docs_, marks):
        count, best = np.zeros(marks.num_rows, np.int64), np.zeros(marks.num_rows, np.int64)
        at = marks.column("place").to_numpy()
        count[at], best[at] = marks.column("count").to_numpy(), marks.column("best").to_numpy()
        wide = "<u2" if marks.num_rows <= 1 << 16 else "<u4"
        links = [np.frombuffer(x, wide) for x in docs_.column("links").to_pylist()]
        sums = {"n_best": [int(best[x].sum()) for x in links], "count_sum": [int(count[x].sum()) for x in links]}
        for name, v in sums.items():
            docs_ = docs_.append_column(name, pa.array(v, pa.int64()))
        return docs_.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    back = back.withColumnsRenamed({"chunk": "of"}).select("of", "place", "count", "best")   # another name: both sides come from one table
    return rows.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(
        run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
