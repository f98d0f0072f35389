"""Substring dedup: repeated paragraphs by MinHash banding, exact Jaccard and components.

Paragraphs are the lines of a text with at least ``MIN_WORDS`` words. Equal ones (A-Z in lower case, white space runs
alike) are one class, which the first in order of (doc_id, line) stands for. Classes are posted under the hashes of
their bands; lists of one are dropped; the others are compared as in ``links`` (leaders, then what is still apart) and
verified by exact Jaccard similarity of five-word shingles. Components are the clusters; in a cluster that reaches over
several documents the first paragraph stays and the others are removed.

Passages need not be lines. A window of ``RUN`` words (over line ends) that an earlier document holds too is repeated;
repeated windows that overlap, touch or leave at most ``GAP`` words between them are one passage, which goes by its
characters from ``PASSAGE`` words on. So every run of ``PASSAGE`` equal words goes as a whole, and a passage with single
changed words as far as its equal parts have ``RUN`` words. The smallest hash of ``SEED`` words in a window is posted:
equal windows have the same. Only windows whose smallest hash several documents hold are hashed themselves, where one
does not lie in a line that goes anyway; a window's first document is found by its hash.

Defined cases: a null text has no paragraphs; repeats inside one document alone stay; rows that repeat a doc_id are one
document, whose paragraphs stay or go together by their place; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import identified, released, written
from riskloom.llm.links import maybe_in, similar_components
from riskloom.llm.shingles import CHUNK, minhash, mixed, permutations, rolled, shingle_set, split_words, word_places

MIN_WORDS = 20
WIDTH = 5
PERCENT = 80
RECALL = 0.9999   # of pairs at the similarity itself
MAX_BANDS = 16
RUN, SEED = 20, 10      # words of a window, of a posted hash
SLICE = 1 << 19         # characters of texts read together
GAP, PASSAGE = 5, 40    # words between windows of one passage at most, of a passage at least


def tuned_bands(similarity: float, recall: float = RECALL, most: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows): the most selective rows per band that reach the recall within ``most`` bands."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))
        if bands <= most:
            return bands, rows
    return most, 1


class Slice:
    """The words and lines of some texts as arrays: ``hashes`` of words, their ``starts`` and ``ends`` in bytes and the line
    of each; of text ``k`` the words ``words[k]`` to ``words[k + 1]`` and the lines from ``lines[k]`` on."""

    def __init__(self, texts: list):
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
        self.data = b"\n".join(raw).lower()
        self.offsets = np.cumsum([0] + [len(x) + 1 for x in raw])
        self.hashes, self.starts, self.ends = word_places(self.data)
        self.breaks = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 10)
        self.lines = np.searchsorted(self.breaks, self.offsets[:-1])
        self.words = np.searchsorted(self.starts, self.offsets)
        self.line = np.searchsorted(self.breaks, self.starts)
        self.line -= np.repeat(self.lines, np.diff(self.words))

    def code_points(self) -> np.ndarray | None:
        """Code points before each byte; None if all are of one byte."""
        if self.data.isascii():
            return None
        return np.cumsum(np.append(False, (np.frombuffer(self.data, np.uint8) & 0xC0) != 0x80), dtype=np.int32)


def slices(batches):
    """Batches of about ``SLICE`` characters at most, or of one longer text; ``text`` is the second column."""
    for t in released(batches):
        sizes = pc.fill_null(pc.utf8_length(t.column(1)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // SLICE
        for rows in np.split(np.arange(t.num_rows), np.flatnonzero(np.diff(part)) + 1):
            if len(rows):
                yield t.slice(int(rows[0]), len(rows))


def paragraphs(docs: DataFrame, bands: int, rows: int, min_words: int = MIN_WORDS, width: int = WIDTH) -> DataFrame:
    """doc_id, line, start, end (code points in the text), n_words, id (of the place), class_id (16 bytes), keys (one a band)."""
    a, b = permutations(bands * rows)

    def run(batches):
        for t in slices(batches):
            at = Slice(t.column(1).to_pylist())
            first, last = np.append(0, at.breaks + 1), np.append(at.breaks, len(at.data))     # of lines, in bytes
            low = np.searchsorted(at.starts, first)
            n_words = np.diff(np.append(low, len(at.starts)))
            long = np.flatnonzero(n_words >= min_words)
            if not len(long):
                continue
            first, last, low, n_words = (c[long] for c in (first, last, low, n_words))
            of = np.searchsorted(at.offsets, first, "right") - 1
            chars = at.code_points()
            start, end, zero = (c if chars is None else chars[c].astype(np.int64) for c in (first, last, at.offsets[of]))
            classes = [xxhash.xxh3_128_digest(at.hashes[x: x + n].tobytes()) for x, n in zip(low.tolist(), n_words.tolist(), strict=True)]
            keys = band_keys(line_minhashes(at.hashes, low, n_words, width, a, b), bands, rows).view(np.int64)
            ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands)
            columns = [t.column(0).take(pa.array(of)), pa.array((long - at.lines[of]).astype(np.int32)), pa.array(start - zero), pa.array(end - zero),
                       pa.array(n_words), pa.array(classes, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "start", "end", "n_words", "class_id", "keys"])

    found = identified(docs).mapInArrow(run, "doc_id bigint, line int, start bigint, end bigint, n_words bigint, class_id binary, keys array<bigint>")
    return found.withColumn("id", F.xxhash64("doc_id", "line"))


def line_minhashes(hashes: np.ndarray, low: np.ndarray, n_words: np.ndarray, width: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation over the shingles of each line, which has the words from ``low`` on, ``width`` or
    more; about ``CHUNK`` shingles at a time."""
    grams, n = rolled(hashes, width), n_words - width + 1
    out = np.empty((len(low), len(a)), np.uint64)
    for rows in np.split(np.arange(len(low)), np.flatnonzero(np.diff(np.cumsum(n) // CHUNK)) + 1):
        if len(rows) == 1 and n[rows[0]] > CHUNK:      # one long line
            k = rows[0]
            out[k] = minhash(grams[low[k]: low[k] + n[k]], a, b)
            continue
        many = n[rows]
        first = np.cumsum(many) - many
        x = grams[np.repeat(low[rows] - first, many) + np.arange(many.sum())]
        out[rows] = np.minimum.reduceat(a[:, None] * x + b[:, None], first, axis=1).T
    return out


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of a line's smallest values."""
    low = low.reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), low.shape[:2])
    for r in range(rows):
        key = mixed(key + low[:, :, r])
    return key


def paragraph_sets(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """id, hashes of the paragraphs' full sets; ``rows``: id, text."""

    def run(batches):
        for t in released(batches):
            sets = [shingle_set(split_words(x), width).tobytes() for x in t.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(sets, pa.binary())], names=["id", "hashes"])

    return rows.select("id", "text").mapInArrow(run, "id bigint, hashes binary")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, line, start, end, n_words, kept_doc_id, kept_line of every line to remove."""
    bands, rows = tuned_bands(percent / 100)
    found = written(paragraphs(docs, bands, rows, min_words), "paragraphs")      # rows that repeat a document repeat its lines
    first = F.struct("doc_id", "line", "id")
    classes = written(found.groupBy("class_id").agg(
        F.min(first).alias("first"), F.max("doc_id").alias("last_doc"), F.count("*").alias("weight")), "classes")
    reps = found.join(classes.select(F.col("class_id").alias("of"), F.col("first.id").alias("rep")), (F.col("id") == F.col("rep")) & (F.col("class_id") == F.col("of"))).dropDuplicates(["id", "class_id"])
    posted = reps.select("id", F.explode("keys").alias("key"))
    common = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    lists = written(posted.join(common, "key").select("key", "id").distinct(), "lists")
    ids = lists.select("id").distinct()
    lines = identified(docs).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    full = paragraph_sets(maybe_in(lines.withColumn("id", F.xxhash64("doc_id", "line")), "id", ids))
    weights = classes.select(F.col("first.id").alias("id"), "weight")
    sets = written(full.join(weights.join(ids, "id"), "id").dropDuplicates(["id"]).select("id", "weight", "hashes"), "sets")
    found_in = similar_components(lists, sets, percent)
    linked = classes.join(found_in, F.col("first.id") == F.col("id"), "left").select(
        "class_id", "first", "last_doc", "weight", F.coalesce("component", F.col("first.id")).alias("component"))
    linked = written(linked.where((F.col("weight") > 1) | F.col("component").isNotNull()), "linked")
    clusters = linked.groupBy("component").agg(F.min("first").alias("stays"), F.max("last_doc").alias("last_doc"), F.sum("weight").alias("n"))
    wide = clusters.where("n > 1 AND last_doc <> stays.doc_id").select("component", "stays")
    members = linked.join(wide, "component").select(F.col("class_id").alias("of"), "stays")
    gone = found.join(members, F.col("class_id") == F.col("of")).where((F.col("doc_id") != F.col("stays.doc_id")) | (F.col("line") != F.col("stays.line"))).dropDuplicates(["doc_id", "line", "class_id"])
    return gone.select("doc_id", "line", "start", "end", "n_words", F.col("stays.doc_id").alias("kept_doc_id"), F.col("stays.line").alias("kept_line"))


def _seeds(at: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``RUN`` words inside one text, the place of each one's smallest hash of ``SEED`` words (the first of equal
    ones), and that hash."""
    if len(at.hashes) < RUN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = rolled(at.hashes, SEED)
    place, k, most = np.arange(len(value)), 1, RUN - SEED + 1
    while k < most:      # the smallest of k, then of twice as many
        step = min(k, most - k)
        place = np.where(value[:-step] <= value[step:], place[:-step], place[step:])
        value = np.minimum(value[:-step], value[step:])
        k += step
    word = np.arange(len(value))
    inside = word + RUN <= np.repeat(at.words[1:], np.diff(at.words))[:len(word)]
    return word[inside], place[inside], value[inside].view(np.int64)


def _runs(place: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.flatnonzero(np.append(True, place[1:] != place[:-1])[:len(place)])


def _lists(values: np.ndarray, of: np.ndarray, n: int) -> pa.ListArray:
    """Values as one list a text; ``of``: the text of each, in order."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=n))).astype(np.int32)), pa.array(values))


def posted_seeds(docs: DataFrame) -> DataFrame:
    """doc_id, keys, lines (that hold all windows about a hash; -1 if none does)."""

    def run(batches):
        for t in slices(batches):
            at = Slice(t.column(1).to_pylist())
            _, place, key = _seeds(at)
            one = _runs(place)
            place, key = place[one], key[one]
            of = np.searchsorted(at.words, place, "right") - 1
            first = at.line[np.maximum(place - (RUN - SEED), at.words[of])]
            last = at.line[np.minimum(place + RUN, at.words[of + 1]) - 1]
            lines = np.where(first == last, first, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([t.column(0), _lists(key, of, t.num_rows), _lists(lines, of, t.num_rows)], names=["doc_id", "keys", "lines"])

    return identified(docs).mapInArrow(run, "doc_id bigint, keys array<bigint>, lines array<int>")


def _own(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Ends of the lists and their values, from 0 on."""
    ends = lists.offsets.to_numpy()
    return ends - ends[0], lists.flatten()


def windows(rows: DataFrame) -> DataFrame:
    """doc_id, hash, line (it begins in) of the windows with the given smallest hashes; ``rows``: doc_id, text, keys."""

    def run(batches):
        for t in slices(batches):
            at = Slice(t.column(1).to_pylist())
            word, place, key = _seeds(at)
            if not len(word):
                continue
            ends, keys = _own(t.column(2))
            keys, one = keys.to_numpy(zero_copy_only=False), _runs(place)
            low = np.append(np.searchsorted(at.words, place[one], "right") - 1, t.num_rows)
            to = np.searchsorted(low, np.arange(t.num_rows + 1))      # each text's hashes, met by its own keys
            asked = np.concatenate([np.isin(key[one[to[k]: to[k + 1]]], keys[ends[k]: ends[k + 1]]) for k in range(t.num_rows)])
            word = word[np.repeat(asked, np.diff(np.append(one, len(word))))]
            of = np.searchsorted(at.words, word, "right") - 1
            found = rolled(at.hashes, RUN)[word].view(np.int64)
            order = np.lexsort((found, of))      # a text's first window of a hash
            order = order[np.append(True, (found[order][1:] != found[order][:-1]) | (of[order][1:] != of[order][:-1]))[:len(order)]]
            if len(order):
                yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(of[order])), pa.array(found[order]), pa.array(at.line[word[order]].astype(np.int32))],
                                                 names=["doc_id", "hash", "line"])

    return rows.select("doc_id", "text", "keys").mapInArrow(run, "doc_id bigint, hash bigint, line int")


def _joined(rows: DataFrame) -> DataFrame:
    """Passages of repeated windows; ``rows``: doc_id, text, windows (hash, kept_doc_id), gone (lines)."""

    def run(batches):
        names = ["doc_id", "text_id", "line", "start", "end", "n_words", "kept_doc_id", "hash"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for t in slices(batches):
            at = Slice(t.column(1).to_pylist())
            if len(at.hashes) < RUN:
                continue
            hashes = rolled(at.hashes, RUN).view(np.int64)
            ends, found = _own(t.column(3))
            known, first = (found.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            chars, out = at.code_points(), []
            for k, (doc, text_id, gone) in enumerate(zip(*(t.column(c).to_pylist() for c in (0, 2, 4)), strict=True)):
                x, y = int(at.words[k]), int(at.words[k + 1])
                order = ends[k] + np.argsort(known[ends[k]: ends[k + 1]])
                if y - x < RUN or not len(order):
                    continue
                mine, seen = hashes[x: y - RUN + 1], known[order]
                near = np.minimum(np.searchsorted(seen, mine), len(seen) - 1)
                word = np.flatnonzero(seen[near] == mine)
                if not len(word):
                    continue
                stays = ~np.isin(at.line[x:y], np.array(gone or [-1], np.int64))
                for part in np.split(word, np.flatnonzero(np.diff(word) > RUN + GAP) + 1):
                    a, b = int(part[0]), int(part[-1]) + RUN
                    if b - a >= PASSAGE and stays[a:b].any():
                        start, end, zero = (int(p if chars is None else chars[p]) for p in (at.starts[x + a], at.ends[x + b - 1], at.offsets[k]))
                        out.append((doc, text_id, int(at.line[x + a]), start - zero, end - zero, b - a, int(first[order[near[a]]]), int(mine[a])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.select("doc_id", "text", F.xxhash64("text").alias("text_id"), "windows", "gone").mapInArrow(
        run, "doc_id bigint, text_id bigint, line int, start bigint, end bigint, n_words bigint, kept_doc_id bigint, hash bigint")


def repeated_spans(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """doc_id, text_id, line, start, end, n_words, kept_doc_id, kept_line of passages that do not lie in ``gone`` lines (doc_id, line)."""
    posted = written(posted_seeds(docs), "seeds")
    lines = gone.groupBy("doc_id").agg(F.collect_set("line").alias("gone"))      # at most the document's own
    goes = lambda line: F.coalesce(F.array_contains("gone", line), F.lit(False))
    seeds = posted.join(lines, "doc_id", "left").select("doc_id", F.explode(F.zip_with("keys", "lines", lambda k, n: F.struct(k.alias("key"), goes(n).alias("goes")))).alias("s")).select("doc_id", "s.*")
    # hashes that a document after the first one holds outside of lines that go
    live = seeds.groupBy("key").agg(F.min("doc_id").alias("first"), F.max(F.when(~F.col("goes"), F.col("doc_id"))).alias("last")).where("last > first").select("key")
    keys = posted.select("doc_id", F.explode("keys").alias("key")).join(live, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    keys = written(keys, "live")   # at most the document's own
    rows = maybe_in(identified(docs), "doc_id", keys.select("doc_id")).join(keys, "doc_id")
    found = written(windows(rows), "windows")
    first = found.groupBy("hash").agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("last_doc")).where("kept_doc_id <> last_doc").select("hash", "kept_doc_id")
    again = found.select("doc_id", "hash").join(first, "hash").where("doc_id <> kept_doc_id")
    each = written(again.groupBy("doc_id").agg(F.collect_set(F.struct("hash", "kept_doc_id")).alias("windows")), "repeated")   # at most one a word
    each = each.join(lines, "doc_id", "left")
    spans = written(_joined(maybe_in(identified(docs), "doc_id", each.select("doc_id")).join(each, "doc_id")).distinct(), "spans")
    at = maybe_in(found, "hash", spans.select("hash").distinct()).groupBy(F.col("doc_id").alias("kept_doc_id"), "hash").agg(F.min("line").alias("kept_line"))
    return spans.join(at, ["kept_doc_id", "hash"]).select("doc_id", "text_id", "line", "start", "end", "n_words", "kept_doc_id", "kept_line")


def repeated(docs: DataFrame, **parameters) -> tuple[DataFrame, DataFrame]:
    """Lines to remove, and passages to remove besides."""
    lines = written(repeated_lines(docs, **parameters), "gone-lines")
    return lines, written(repeated_spans(docs, lines), "gone-spans")


def repeated_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, line, start, end, n_words, kept_doc_id, kept_line of every line and of every other passage to remove."""
    lines, spans = repeated(docs, min_words=min_words, percent=percent)
    return lines.unionByName(spans.drop("text_id"))


def without(text: str, lines: list[int], spans: list) -> str:
    """The text without the lines, and without the spans of characters in the others; lines that spans empty go too."""
    out, at, gone, spans = [], 0, set(lines or ()), sorted((s["start"], s["end"]) for s in spans)
    for k, line in enumerate(text.split("\n")):
        left, done, cut = "", 0, False
        for start, end in spans:
            a, b = max(start - at, 0), min(end - at, len(line))
            if a < b:
                piece, done, cut = line[done:a], b, True
                left += piece[1:] if left[-1:] == " " == piece[:1] else piece
        piece = line[done:]
        left += piece[1:] if cut and left[-1:] == " " == piece[:1] else piece
        at += len(line) + 1
        if k not in gone and not (cut and not left.encode("utf-8", "surrogatepass").split()):
            out.append(left)
    return "\n".join(out)


def cleaned(docs: DataFrame, **parameters) -> DataFrame:
    """The documents without their repeated paragraphs; those that nothing is left of go. Columns as given, n_chars anew."""
    lines, spans = repeated(docs, **parameters)
    gone = lines.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line").alias("__gone"))
    cuts = spans.groupBy(F.col("doc_id").alias("__of"), F.col("text_id").alias("__text")).agg(F.collect_list(F.struct("start", "end")).alias("__cuts"))
    cut_out = F.udf(lambda text, lines, spans: None if text is None else without(text, lines, spans), "string")
    ident = F.col("doc_id").cast("bigint")
    rows = docs.where("doc_id IS NOT NULL").join(gone, ident == F.col("__id"), "left")
    rows = rows.join(cuts, (ident == F.col("__of")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__text")), "left")
    by_line = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    by_span = cut_out(F.when(F.col("__cuts").isNotNull(), F.col("text")), F.col("__gone"), F.col("__cuts"))   # other texts do not go to Python
    untouched = F.col("__gone").isNull() & F.col("__cuts").isNull()
    rows = rows.withColumn("__span", by_span)
    text = F.when(F.col("__cuts").isNotNull(), F.col("__span")).when(F.col("__gone").isNotNull(), by_line).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).where(untouched | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
