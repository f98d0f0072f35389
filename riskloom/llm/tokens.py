"""Token ids on disk: frequency-ranked ids in byte-aligned variable-length coding.

Every text is encoded once and written; the ids are counted (at most one row per vocabulary entry), and the more
frequent an id, the smaller the rank that is stored for it. A block codes ranks in one to four bytes each: two bits per
id in separate control bytes, the data bytes after them, so a reader looks lengths up in a table of 256 rows and never
branches per id. Blocks are rows of Parquet files in ascending doc_id order (any store Spark can write, and task
attempts commit as usual); the rank table is written beside them.

Defined cases: strings of special tokens are what the tokenizers library's plain call makes of them; a null text counts as empty and gives the end id alone; an empty table gives no rows; rows that repeat a
doc_id are kept, ordered by their ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import encoder, identified, released, written

BLOCK_IDS = 65_536   # a block is closed by the document that passes this
MAGIC = b"RLT1"
HEAD = "<4sIQ"   # mark, documents, ids
#: Byte lengths of the four ids of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    r = ranks.astype("<u4")
    size = (1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)).astype(np.uint8)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    used = np.arange(4) < size[:, None]
    return control.tobytes(), r.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers again: lengths by table lookup, places by a running sum, bytes gathered by length."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if len(longer):
            out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_block(doc_ids: list[int], lengths: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack_ranks(ranks)
    return b"".join((struct.pack(HEAD, MAGIC, len(doc_ids), len(ranks)), np.array(doc_ids, "<i8").tobytes(), np.array(lengths, "<u8").tobytes(), control, data))


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ranks of a block."""
    magic, docs, n = struct.unpack_from(HEAD, block)
    if magic != MAGIC:
        raise ValueError("not a block of ranked ids")
    at = struct.calcsize(HEAD)
    doc_ids = np.frombuffer(block, "<i8", docs, at)
    lengths = np.frombuffer(block, "<u8", docs, at + 8 * docs).astype(np.int64)
    at += 16 * docs
    end = at + -(-n // 4)
    return doc_ids, lengths, unpack_ranks(block[at:end], block[end:], n)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, spaces: str = "whole", width: int = 4, memo_bytes: int | None = None) -> DataFrame:
    """doc_id and ids (binary, ``width`` bytes each, the end id last) of every whole text; no shuffle."""
    end = np.array([end_id], f"<u{width}").tobytes()

    def run(batches):
        import pyarrow as pa

        enc = encoder(tokenizer, spaces, width, memo_bytes=memo_bytes)
        for b in released(batches):
            ids = [x + end for x in enc.encode([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return identified(docs).mapInArrow(run, "doc_id bigint, ids binary")


def count_ids(encoded: DataFrame, width: int) -> DataFrame:
    """id and n: how often each id occurs; a task sends one row per id it has seen."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 512):   # documents counted at a time
                n = np.bincount(np.frombuffer(b"".join(b.column(0).slice(at, 512).to_pylist()), f"<u{width}"))
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_ranked(docs: DataFrame, path: str, tokenizer: str, end_id: int, spaces: str = "whole", width: int = 4, memo_bytes: int | None = None) -> None:
    """Write ``path``/ranks and ``path``/blocks; ``width`` 2 holds vocabularies of up to 65,536 entries in between."""
    spark = docs.sparkSession
    encoded = written(encode_documents(docs, tokenizer, end_id, spaces, width, memo_bytes), "ids")
    # one row per vocabulary entry at most: the driver orders the table that every task needs
    counted = sorted(count_ids(encoded, width).collect(), key=lambda r: (-r["n"], r["id"]))
    order = np.array([r["id"] for r in counted], np.int64)
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(order)], "rank bigint, id bigint").write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        held: list[tuple[int, np.ndarray]] = []
        n = 0

        def close():
            nonlocal start, held, n
            ids = np.concatenate([x for _, x in held])
            block = pack_block([d for d, _ in held], [len(x) for _, x in held], rank_of[ids])
            row = pa.RecordBatch.from_pylist([{"part": part, "start": start, "n_ids": len(ids), "block": block}], schema=schema)
            start, held, n = start + len(ids), [], 0
            return row

        schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("block", pa.binary())])
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((doc, np.frombuffer(ids, f"<u{width}")))
                n += len(held[-1][1])
                if n >= BLOCK_IDS:
                    yield close()
        if held:
            yield close()

    (encoded.repartitionByRange("doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", "ids")
        .mapInArrow(run, "part int, start bigint, n_ids bigint, block binary").write.parquet(f"{path}/blocks"))


def read_ranked(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from the files."""
    rows = spark.read.parquet(f"{path}/ranks").collect()   # one row per vocabulary entry at most
    id_of = np.zeros(max(1, len(rows)), "<u4")
    for r in rows:
        id_of[r["rank"]] = r["id"]
    blocks = spark.read.parquet(f"{path}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row per written partition
    bases = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            for first, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs, lengths, ranks = unpack_block(block)
                ids = id_of[ranks]
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array([ids[e - k:e].tobytes() for e, k in zip(ends, lengths, strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    placed = blocks.join(bases, "part").select((F.col("base") + F.col("start")).alias("first"), "block")
    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
