"""Words hashed as arrays, and tables written without what their shuffles leave."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import passages, shingles
from riskloom.llm.common import written


def test_words_hashed_as_arrays_are_the_words_hashed_one_by_one():
    r = random.Random(5)
    for _ in range(300):
        data = "".join(r.choice("abé\n\t\x1c\x85\x0b xyz0123456789\U0001d4b3") for _ in range(r.randrange(0, 90))).encode()
        hashes, starts, ends = shingles.word_places(data)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        assert (hashes == shingles.word_hashes(data.split())).all()
        for width in range(1, min(len(hashes), 25)):
            plain = np.array([0] * (len(hashes) - width + 1), np.uint64) + np.uint64(width)
            for k in range(width):
                plain = plain * shingles.ODD + hashes[k: k + len(plain)]
            assert (shingles.rolled(hashes, width) == shingles.mixed(plain)).all()


def test_seeds_are_the_first_smallest_hash_of_each_window():
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdef") * r.randrange(1, 4) + r.choice(["", "\n"]) for _ in range(n)) for n in (0, 5, 20, 61, 19, 300)] + [None, "x " * 50]
    at = passages.Slice(texts)
    word, place, key = passages._seeds(at)
    want = []
    for k, text in enumerate(texts):
        ws = shingles.split_words(text or "")
        assert at.words[k + 1] - at.words[k] == len(ws)
        if len(ws) >= passages.RUN:
            grams = shingles.rolled(shingles.word_hashes(ws), passages.SEED)
            for x in range(len(ws) - passages.RUN + 1):
                near = grams[x: x + passages.RUN - passages.SEED + 1]
                want.append((at.words[k] + x, at.words[k] + x + near.argmin(), near.min().view(np.int64)))
    assert list(zip(word, place, key, strict=True)) == want


def test_a_written_table_leaves_no_shuffle_files(spark):
    blocks = lambda: set(re.findall(r"shuffle_\d+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(",")))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_ = blocks(), spark.conf.get(key, None)
    table = written(spark.range(5000).groupBy(F.xxhash64("id").alias("k")).agg(F.count("*").alias("n")), "left")
    until = time.monotonic() + 5
    while blocks() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not blocks() - before
    assert table.count() == 5000 and spark.conf.get(key, None) == set_
