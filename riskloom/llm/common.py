"""What the training-data operators share: table access, written cuts, word splitting, memoised encoding.

All ten operators read a documents table by its ``doc_id`` and ``text``. Rows without a ``doc_id`` cannot be named in a
result and are left out; other columns, whatever their names, are ignored unless an operator says otherwise.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import new_path

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes that a memo of encoded words takes at most, and those of an entry beside its letters and ids; more words are
#: computed again, never dropped.
MEMO_BYTES, ENTRY_BYTES = 32 << 20, 120
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Characters of text that are cut into pieces at a time, and new pieces that are encoded at a time.
GROUP_CHARS, GROUP_PIECES = 1 << 20, 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def identified(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), text (string) and the named further columns of the rows that have a doc_id."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).where("doc_id IS NOT NULL")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared scratch folder, which any executor can read again.

    ``df`` is run here only, so its shuffle files go with the end of the write, not when the driver next collects garbage.
    """
    path, conf = new_path(df.sparkSession, f"llm-{name}"), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(batches: Iterator) -> Iterator:
    """The batches; after the last one, memory that a Python worker no longer uses goes back to the machine."""
    yield from batches
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):   # another C library
        pass


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once (lambda bodies would evaluate a plain expression at each use)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


ODD_ASCII = ("  ", " \n", "\n ", "\n\n", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")


class TextEncoder:
    """Whole texts to token ids by a tokenizer file, through a memo of the pieces between white space.

    ``spaces`` says what the tokenizer does with white space, which is what makes pieces independent of their
    neighbours: ``dropped`` (pieces never hold it, letters are taken in lower case, and runs of letters, digits and other
    characters are apart), ``leading`` (a single space belongs to the word after it; texts with other white space go to
    the tokenizer whole) or ``whole`` (nothing is known: every text goes to it whole). Strings of special tokens are
    what the library's plain call makes of them, one id each; with ``special_as_text`` they are ordinary text.
    """

    def __init__(self, path: str, spaces: str, width: int, special_as_text: bool = False, memo_bytes: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        special = [] if special_as_text else [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None   # texts that hold one, in whatever case, go whole
        self.mark = re.match(r"[^a-z]*", os.path.commonprefix(special)).group()               # what all of them begin with
        self.spaces, self.dtype, self.memo, self.memo_bytes = spaces, f"<u{width}", {}, 0
        self.most_bytes = MEMO_BYTES if memo_bytes is None else memo_bytes
        # white space that is no single space or line end; or that, and letters whose lower case depends on their place
        self.odd = re.compile(r"[ \n][ \n]|[^\S \n]") if spaces == "leading" else re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u03a3\u0130]")
        self.runs = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s][.,])|(?<=_[.,]))")   # stops and commas that belong to a longer run

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _fresh(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces: many are encoded as one string and told apart by where each token starts."""
        import numpy as np

        out: list[bytes] = []
        for at in range(0, len(pieces), GROUP_PIECES):
            group = pieces[at: at + GROUP_PIECES]
            apart = [self._apart(p) for p in group]
            raw = [r for r, _ in apart]
            e = self.tokenizer.encode("".join(raw), add_special_tokens=False)
            ids, starts = np.array(e.ids, self.dtype), np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            ends = np.cumsum([len(r) for r in raw])
            low = np.searchsorted(starts, ends - [len(r) - skip for r, skip in apart])
            high = np.searchsorted(starts, ends)
            out += [ids[x:y].tobytes() for x, y in zip(low.tolist(), high.tolist(), strict=True)]
        return out

    def _odd(self, text: str) -> bool:
        """Whether the text holds white space that pieces cannot be cut at."""
        if self.spaces == "leading" and text.isascii():
            return any(s in text for s in ODD_ASCII)   # the same as the pattern, at the speed of a search
        return bool(self.odd.search(text))

    def _pieces(self, text: str) -> list[str] | None:
        if self.spaces == "whole" or self._odd(text) or (self.special and self.mark in text and self.special.search(text.lower())):
            return None
        if self.spaces == "dropped":
            text = text.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ")
            return (text if self.runs.search(text) else text.replace(".", " . ").replace(",", " , ")).split(" ")
        first, *rest = text.replace("\n", " \n").split(" ")
        return ["\r" + first, *rest]   # \r marks the piece without a space before it; texts that hold one are odd

    def _apart(self, piece: str) -> tuple[str, int]:
        """The piece as it stands between others, and how many characters of that come before it."""
        if self.spaces == "dropped":
            return piece + " ", 0
        if piece[:1] == "\n":
            return piece, 0
        return ("\n" + piece[1:], 1) if piece[:1] == "\r" else (" " + piece, 0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of the chosen width."""
        out: list[bytes] = []
        group: list[str] = []
        chars = 0
        for t in texts:
            group.append(t)
            chars += len(t)
            if chars >= GROUP_CHARS:
                out += self._group(group)
                group, chars = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        cut = [self._pieces(t) for t in texts]
        found = [None if c is None else list(map(self.memo.get, c)) for c in cut]
        missing: dict[str, None] = {}
        for c, f in zip(cut, found, strict=True):
            if f is not None and None in f:
                missing.update((p, None) for p, x in zip(c, f, strict=True) if x is None)
        fresh: dict[str, bytes] = {}
        if missing:
            # pieces of white space alone only end a text
            blank = [p for p in missing if p in ("", "\n", "\r")]
            fresh = {p: b"" if p == "\r" or self.spaces == "dropped" else self._whole(p or " ") for p in blank}
            new = [p for p in missing if p not in fresh]
            fresh.update(zip(new, self._fresh(new), strict=True))
            size = sum(len(p) + len(x) + ENTRY_BYTES for p, x in fresh.items())
            if self.memo_bytes + size <= self.most_bytes:
                self.memo.update(fresh)
                self.memo_bytes += size
        return [self._whole(t) if f is None else b"".join([fresh[p] if x is None else x for p, x in zip(c, f, strict=True)] if None in f else f)
                for t, c, f in zip(texts, cut, found, strict=True)]


@lru_cache(maxsize=1)
def encoder(path: str, spaces: str, width: int, special_as_text: bool = False, memo_bytes: int | None = None) -> TextEncoder:
    """The Python worker's encoder for a file; its memo is bounded, and another file's takes its place."""
    return TextEncoder(path, spaces, width, special_as_text, memo_bytes)
