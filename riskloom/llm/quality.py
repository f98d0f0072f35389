"""Quality rules with cross-document line frequency, by DataFrame functions only.

Lines are normalised (lower case, digit runs as 0, white space runs as one space) and hashed; for each host (the
source) and line the distinct documents that hold it are counted. A line held by more than ``least`` documents and more
than ``part`` of the host's documents (or by more than ``many``, whatever the host's size) is boilerplate: it is removed
from all documents of the host but the one with the smallest doc_id. A document is rejected when it fails the base rules (too few words, too much of it in repeated windows)
or is depleted: too few words, or too small a part of its words, are left.

Defined cases: a null text has no words and fails; a null source is a host of its own; rows that repeat a doc_id count
as one document where documents are counted, and each of its texts has its own verdict; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import SPACE, identified, let, words, written

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
LEAST, PART = 20, 0.01         # a line is boilerplate above both
MANY = 100                     # with a line above this its host's size does not matter
LEFT_WORDS, LEFT_PART = 20, 0.3  # less left is depleted


def text_id(text: Column) -> Column:
    """Tells texts apart that share a doc_id."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows found twice or more in the text, the first one included."""

    def covered(pos: Column) -> Column:
        step = F.transform(pos, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(pos, j + 1) - p, F.lit(window))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        again = F.filter(s, lambda x, j: same(x, j + 1) | same(x, j - 1))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

    def counted(hashes: Column) -> Column:
        places = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(places), twice))

    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - F.lit(window - 1)), lambda i: F.xxhash64(F.slice(ws, i, F.lit(window))))
    return F.when(F.size(ws) > window, let(hashes, counted)).otherwise(F.lit(0))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, " "), "[0-9]+", "0"))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def base_stats(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_id, the base counts, base_failed, and of every line with a word: number, hash, words."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def counts(ws: Column) -> Column:
        return F.struct(F.size(ws).alias("n_words"), F.length(F.array_join(ws, "")).alias("word_chars"), repeated_words(ws).alias("n_repeat_words"))

    def lines(all_lines: Column) -> Column:
        with_words = F.filter(F.transform(all_lines, lambda x, i: F.struct(x.alias("line"), i.alias("i"))), lambda x: has_word(x["line"]))
        return let(with_words, lambda ls: F.struct(
            (F.size(ls) - F.size(F.array_distinct(F.transform(ls, lambda x: x["line"])))).alias("n_dup_lines"),
            F.transform(ls, lambda x: F.struct(x["i"].alias("i"), F.xxhash64(normalised(x["line"])).alias("hash"), F.size(words(x["line"])).alias("n"))).alias("lines")))

    found = identified(docs, F.col("source").cast("string").alias("host")).select(
        "doc_id", "host", text_id(F.col("text")).alias("text_id"), let(words(text), counts).alias("w"), let(F.split(text, "\n"), lines).alias("l"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).alias("n_symbols"))
    big = lambda c: F.col(c).cast("bigint")
    return found.select(
        "doc_id", "host", "text_id", big("w.n_words").alias("n_words"), big("w.word_chars").alias("word_chars"), big("n_symbols").alias("n_symbols"),
        big("l.n_dup_lines").alias("n_dup_lines"), big("w.n_repeat_words").alias("n_repeat_words"),
        ((F.col("w.n_words") < MIN_WORDS) | (100 * big("w.n_repeat_words") > REPEAT_PERCENT * big("w.n_words"))).alias("base_failed"),
        F.col("l.lines").alias("lines"))


def boilerplate(stats: DataFrame, least: int = LEAST, part: float = PART, many: int | None = None) -> DataFrame:
    """host, hash, first_doc of the lines above both limits, or above ``least`` and ``many``; counts are combined before they are shuffled."""
    size = stats.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    held = stats.select("host", "doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("hash")).distinct()
    counted = held.groupBy("host", "hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") > least)
    same = counted["host"].eqNullSafe(size["host"])
    enough = F.col("n") > F.lit(part) * F.col("host_docs")
    if many is not None:
        enough = enough | (F.col("n") > many)
    return counted.join(size, same).where(enough).select(counted["host"], "hash", "first_doc")


def verdicts(docs: DataFrame, least: int = LEAST, part: float = PART, many: int | None = None) -> DataFrame:
    """doc_id, text_id, the base counts, base_failed, removed (line numbers), n_removed_words, depleted, kept."""
    stats = written(base_stats(docs), "quality")
    hot = boilerplate(stats, least, part, many)
    each = stats.select("doc_id", "host", "text_id", F.explode("lines").alias("x")).select("doc_id", "text_id", "host", F.col("x.i").alias("i"), F.col("x.hash").alias("hash"), F.col("x.n").alias("n"))
    gone = each.join(hot, each["host"].eqNullSafe(hot["host"]) & (each["hash"] == hot["hash"])).where("doc_id <> first_doc")
    by_doc = gone.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_set("i")).alias("removed"), F.collect_set(F.struct("i", "n")).alias("cut"))
    lost = by_doc.select("doc_id", "text_id", "removed", F.aggregate("cut", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("lost"))
    out = stats.drop("lines", "host").join(lost, ["doc_id", "text_id"], "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    left = F.col("n_words") - F.col("lost")
    return (out.withColumn("depleted", (F.col("lost") > 0) & ((left < LEFT_WORDS) | (left < LEFT_PART * F.col("n_words"))))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")).withColumnRenamed("lost", "n_removed_words"))


def cleaned(docs: DataFrame, many: int | None = None) -> DataFrame:
    """The kept documents without their boilerplate lines; columns as given, n_chars (if there) of the new text."""
    kept = verdicts(docs, many=many).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text"), F.col("removed").alias("__gone")).dropDuplicates(["__id", "__text"])
    rows = docs.join(kept, (F.col("doc_id").cast("bigint") == F.col("__id")) & (text_id(F.col("text")) == F.col("__text")))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
