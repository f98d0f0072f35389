"""Sum-of-squares online packing of documents into windows of a fixed number of tokens.

Each task packs the documents it reads, in the order it reads them, so nothing is shuffled. Full windows are cut off a
document first. Its rest goes to the fill level that keeps the sum of squares of the counts of partially filled windows
smallest: N[g] counts the windows filled to g, and moving one from g to g + s changes the sum by 2 (N[g+s] - N[g]) + 2,
or one less where a window is opened or filled up. At the end of the task (or when a task holds ``max_open`` open windows, which bounds
its memory) the open windows are settled: the emptiest ones are cut up to fill the fullest, so at most one window per
settling stays partly empty.

Defined cases: a null text is empty and gives its end id alone; strings of special tokens are what the tokenizers library's
plain call makes of them; rows that repeat a document are packed each; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from riskloom.llm.common import encoder, identified, released

Piece = tuple[int, int, int, bytes]   # document, its ids before the piece, ids of the document, the piece's ids (4 bytes each)


class LevelPacker:
    """One task's windows; ``place`` and ``settle`` yield closed windows as lists of pieces."""

    def __init__(self, window: int, max_open: int = 8192):
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1, np.int64)              # N[g]; level 0 and the full level stay 0
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        size = len(piece[3]) // 4
        if size == self.window:
            yield [piece]
            return
        room = self.window - size
        change = 2 * (self.levels[size:] - self.levels[: room + 1])   # from level g to g + size, for g = 0 .. room
        change[[0, -1]] -= 1                                      # a new window leaves no level, a full one joins none
        change[1:][self.levels[1: room + 1] == 0] = np.iinfo(np.int64).max
        level = len(change) - 1 - int(np.argmin(change[::-1]))    # ties go to the fullest
        pieces = self.open[level].pop() if level else []
        self.levels[level] -= bool(level)
        pieces.append(piece)
        if level + size == self.window:
            self.n_open -= 1
            yield pieces
            return
        self.n_open += not level
        self.levels[level + size] += 1
        self.open[level + size].append(pieces)
        if self.n_open >= self.max_open:
            yield from self.settle()

    def settle(self) -> Iterator[list[Piece]]:
        """Close all open windows; the emptiest are cut up to fill the fullest."""
        left = [w for level in self.open for w in level]          # ascending fill
        fills = [g for g, level in enumerate(self.open) for _ in level]
        low, spare = 0, []                                        # spare: pieces of the window that is being cut up
        for k in range(len(left) - 1, -1, -1):
            if k < low:
                break
            pieces, room = left[k], self.window - fills[k]
            while room and (spare or low < k):
                if not spare:
                    spare, low = left[low], low + 1
                doc, start, total, ids = spare.pop()
                if len(ids) // 4 > room:
                    keep = len(ids) - 4 * room
                    spare.append((doc, start, total, ids[:keep]))
                    start, ids = start + keep // 4, ids[keep:]
                pieces.append((doc, start, total, ids))
                room -= len(ids) // 4
            yield pieces
        if spare:
            yield spare
        self.levels[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        self.n_open = 0


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 1024, spaces: str = "whole", width: int = 4, max_open: int = 8192, memo_bytes: int | None = None) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset per piece."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, packer = encoder(tokenizer, spaces, width, memo_bytes=memo_bytes), LevelPacker(window, max_open)
        sequence = TaskContext.get().partitionId() << 40
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        rows: list[tuple] = []

        def closed(windows: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for pieces in windows:
                at = 0
                for doc, start, total, ids in pieces:
                    n = len(ids) // 4
                    rows.append((doc, start, n, ids, total, sequence, at))
                    at += n
                sequence += 1

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return out

        for b in released(batches):
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                whole = np.append(np.frombuffer(ids, f"<u{width}").astype("<u4"), np.uint32(end_id)).astype("<u4")
                raw = whole.tobytes()
                for start in range(0, len(whole), window):
                    closed(packer.place((doc, start, len(whole), raw[4 * start: 4 * (start + window)])))
                if len(rows) >= 2048:
                    yield flush()
        closed(packer.settle())
        if rows:
            yield flush()

    return identified(docs).mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
