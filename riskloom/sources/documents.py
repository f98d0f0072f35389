"""Document sources: JSON lines, news lists, filing feeds, social posts, event exports, filing histories.

Every parser takes landed text as a DataFrame (batch or streaming) and returns document rows, so
the same expression serves ``read`` and ``readStream``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import text as tx

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("source_type", T.StringType()),
    T.StructField("publisher", T.StringType()), T.StructField("author", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("published_at", T.TimestampType()), T.StructField("ingested_at", T.TimestampType()), T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("engagement", T.MapType(T.StringType(), T.LongType())),
    T.StructField("meta", T.StructType([
        T.StructField("cik", T.StringType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("form", T.StringType()),
        T.StructField("accession", T.StringType()), T.StructField("official", T.BooleanType()), T.StructField("pack", T.StringType())])),
    T.StructField("synthetic", T.BooleanType()),
])


def document_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines -> documents. Blank lines and lines starting with # or // are skipped."""
    text = F.trim(F.col(column))
    kept = lines.filter((text != "") & ~text.startswith("#") & ~text.startswith("//"))
    d = kept.select(F.from_json(column, DOCUMENT, {"mode": "PERMISSIVE"}).alias("d")).select("d.*")
    return d.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", "source", "source_type", "publisher", "author", "url", "published_at", F.coalesce("ingested_at", "published_at").alias("ingested_at"),
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"), F.coalesce("language", F.lit("en")).alias("language"),
        F.col("meta.cik").alias("cik"), F.col("meta.items").alias("items"), F.coalesce("meta.official", F.lit(False)).alias("official"),
        F.col("meta.pack").alias("pack"), F.coalesce("synthetic", F.lit(False)).alias("synthetic"))


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    return document_lines(spark.read.text(path))


def stream_pack(spark: SparkSession, path: str) -> DataFrame:
    return document_lines(spark.readStream.text(path))


ORDER = ["published_at", "doc_id"]   # total order of a feed


def ordered(docs: DataFrame) -> DataFrame:
    return docs.orderBy(*ORDER)


# ------------------------------------------------------------------ news list
ARTICLES = "struct<articles:array<struct<url:string,title:string,seendate:string,domain:string,language:string,sourcecountry:string>>>"


def news_list(payloads: DataFrame, column: str = "value") -> DataFrame:
    a = payloads.select(F.explode(F.from_json(column, ARTICLES)["articles"]).alias("a")).select("a.*")
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))
    when = F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'"))
    lang = F.lower(F.coalesce(F.nullif("language", F.lit("")), F.lit("English")))
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return a.filter((F.coalesce("url", F.lit("")) != "") & (title != "") & (lang == "english") & when.isNotNull()).select(
        tx.stable_id("d", F.lit("gdelt"), F.col("url")).alias("doc_id"), F.lit("gdelt").alias("source"), F.lit("news").alias("source_type"),
        F.coalesce(F.nullif("domain", F.lit("")), host).alias("publisher"), "url", when.alias("published_at"), title.alias("title"),
        F.lit("").alias("body"), "sourcecountry")


# ------------------------------------------------------------------ filing feed
FEED_ENTRY = "title string, link struct<_href:string>, summary string, updated string, id string"


def filing_entries(entries: DataFrame, known_ciks: DataFrame | None = None) -> DataFrame:
    """Feed entries (title, href, summary, updated, id) -> 8-K documents of known filers."""
    t = F.trim("title")
    pattern = r"^(\S+) - (.+?) \((\d{10})\)"
    form, company, cik = (F.regexp_extract(t, pattern, i) for i in (1, 2, 3))
    e = entries.withColumn("form", form).withColumn("company", F.trim(company)).withColumn("cik", cik).filter(
        F.upper("form").startswith("8-K") & (F.col("cik") != ""))
    if known_ciks is not None:
        keys = known_ciks.select(F.ltrim(F.col("cik"), F.lit("0")).alias("_k")).filter("_k is not null").distinct()
        e = e.withColumn("_k", F.ltrim(F.col("cik"), F.lit("0"))).join(keys, "_k", "left_semi").drop("_k")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("summary", "&lt;", "<"), "&gt;", ">"), "&amp;", "&")
    rule = r"Item\s+(\d\.\d{2})\s*:\s*([^<\n]+)"
    codes = F.regexp_extract_all(plain, F.lit(rule), F.lit(1))
    names = F.transform(F.regexp_extract_all(plain, F.lit(rule), F.lit(2)), lambda n: F.trim(n))
    items = F.concat_ws("; ", F.zip_with(codes, names, lambda c, n: F.concat(F.lit("Item "), c, F.lit(" "), n)))
    acc = F.regexp_extract("id", r"accession-number=([\d-]+)", 1)
    e = e.withColumn("items", codes).withColumn("item_text", items).withColumn(
        "accession", F.coalesce(F.nullif(acc, F.lit("")), F.col("href"), F.lit(""))).withColumn("published_at", F.try_to_timestamp("updated"))
    head = F.concat(F.col("company"), F.lit(" files "), F.col("form"))
    return e.filter(F.col("published_at").isNotNull()).select(
        tx.stable_id("d", F.lit("edgar"), F.col("accession")).alias("doc_id"), F.lit("edgar").alias("source"), F.lit("filing").alias("source_type"),
        F.lit("sec.gov").alias("publisher"), F.col("href").alias("url"), "published_at",
        F.when(F.col("item_text") != "", F.concat(head, F.lit(": "), F.col("item_text"))).otherwise(head).alias("title"), F.lit("").alias("body"),
        "cik", "form", "items", "accession")


def read_filing_feed(spark: SparkSession, path: str, known_ciks: DataFrame | None = None) -> DataFrame:
    """Landed Atom files."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema(FEED_ENTRY).load(path)
    return filing_entries(raw.select("title", F.col("link._href").alias("href"), "summary", "updated", "id"), known_ciks)


def filing_xml(rows: DataFrame, column: str = "value", known_ciks: DataFrame | None = None) -> DataFrame:
    """One XML entry per row."""
    e = rows.select(F.from_xml(F.col(column), FEED_ENTRY).alias("e"))
    return filing_entries(e.select("e.title", F.col("e.link._href").alias("href"), "e.summary", "e.updated", "e.id"), known_ciks)


# ------------------------------------------------------------------ social posts
POST = ("struct<did:string,time_us:bigint,kind:string,commit:struct<operation:string,collection:string,rkey:string,cid:string,"
        "record:struct<createdAt:string,langs:array<string>,text:string>>>")


def social_posts(rows: DataFrame, prefilter: Callable[[Column], Column] | None, column: str = "value", max_cashtags: int = 5, min_chars: int = 20) -> DataFrame:
    m = rows.select(F.from_json(column, POST).alias("m")).select("m.*")
    c, r = F.col("commit"), F.col("commit.record")
    text = F.trim(F.regexp_replace(F.coalesce(r["text"], F.lit("")), r"(?U)\s+", " "))
    langs = r["langs"]
    english = langs.isNull() | (F.size(langs) == 0) | F.exists(langs, lambda x: F.lower(F.substring_index(x, "-", 1)) == "en")
    kept = m.filter((F.col("kind") == "commit") & (c["operation"] == "create") & (c["collection"] == "app.bsky.feed.post") & english).withColumn("text", text)
    kept = kept.filter((F.length("text") >= min_chars) & (F.regexp_count("text", F.lit(r"\$[A-Za-z]{1,5}\b")) <= max_cashtags))
    if prefilter:
        kept = kept.filter(prefilter(F.col("text")))
    when = F.coalesce(F.try_to_timestamp(F.col("commit.record.createdAt")), F.timestamp_micros("time_us"))
    return kept.select(
        tx.stable_id("d", F.lit("bluesky"), F.col("did"), F.col("commit.rkey")).alias("doc_id"), F.lit("bluesky").alias("source"),
        F.lit("social").alias("source_type"), F.lit("bsky.app").alias("publisher"), F.col("did").alias("author"),
        F.concat(F.lit("https://bsky.app/profile/"), "did", F.lit("/post/"), "commit.rkey").alias("url"), when.alias("published_at"),
        F.lit("").alias("title"), F.col("text").alias("body"), F.col("commit.cid").alias("cid"))


# ------------------------------------------------------------------ archives
def event_export(rows: DataFrame, terms: str, column: str = "value") -> DataFrame:
    """61-column tab-separated export lines -> earliest (added, tone) per matching address."""
    cols = F.split(F.col(column), "\t", -1)
    e = rows.filter(F.size(cols) >= 61).select(F.trim(F.get(cols, F.lit(59))).alias("added"), F.trim(F.get(cols, F.lit(60))).alias("url"),
                                               F.trim(F.get(cols, F.lit(34))).alias("tone"))
    hit = e.filter((F.col("url") != "") & F.lower("url").rlike(terms))
    return hit.groupBy("url").agg(F.min("added").alias("added"), F.min_by("tone", F.struct("added", "tone")).alias("tone"))


FILING_BLOCK = ("struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>,acceptanceDateTime:array<string>,"
                "items:array<string>,primaryDocument:array<string>>")


def filing_history(blocks: DataFrame, start: str, column: str = "value") -> DataFrame:
    """Parallel arrays per filer -> one row per 8-K or 8-K/A since ``start``. Needs ticker, cik."""
    b = blocks.select("ticker", "cik", F.from_json(column, FILING_BLOCK).alias("b"))
    z = b.select("ticker", "cik", F.explode(F.arrays_zip(
        F.col("b.form").alias("form"), F.col("b.accessionNumber").alias("accession"), F.col("b.filingDate").alias("filing_date"),
        F.col("b.acceptanceDateTime").alias("acceptance_datetime"), F.col("b.items").alias("items"), F.col("b.primaryDocument").alias("doc"))).alias("r"))
    r = z.select("ticker", "cik", "r.*").filter(F.col("form").isin("8-K", "8-K/A") & (F.col("filing_date") >= start))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.ltrim(F.col("cik"), F.lit("0")), F.lit("/"),
                   F.regexp_replace("accession", "-", ""), F.lit("/"), F.coalesce("doc", F.lit("")))
    return r.select("ticker", "cik", "form", "filing_date", F.coalesce("acceptance_datetime", F.lit("")).alias("acceptance_datetime"),
                    F.coalesce("items", F.lit("")).alias("items"), "accession", url.alias("url"))


def archive_pack(rows: DataFrame, pack: str, acronyms: frozenset[str], max_per_slot: int = 3) -> DataFrame:
    """Archived addresses (date_added, url, tone) -> documents with rebuilt headlines.

    Per domain a title is kept once and at most three articles per 15-minute slot; a title dropped
    by the slot limit may be kept later. Which titles were already kept is settled in rounds.
    """
    from pyspark.sql import Window

    from riskloom.functions.rounds import settle

    base = rows.select(F.try_to_timestamp("date_added", F.lit("yyyyMMddHHmmss")).alias("published_at"), "url", "tone",
                       tx.headline_from_url(F.col("url"), acronyms).alias("title"), tx.url_host(F.col("url")).alias("publisher")).filter(
        F.col("title").isNotNull() & F.col("published_at").isNotNull()).withColumn("low", F.lower("title"))
    # within a slot the first address of a title stands for it
    order = F.struct("url", "title", "tone")
    titles = base.groupBy("publisher", "published_at", "low").agg(F.min(order).alias("o"))
    w = Window.partitionBy("publisher", "published_at").orderBy("o")

    def step(kept: DataFrame) -> DataFrame:
        earlier = kept.groupBy("publisher", "low").agg(F.min("published_at").alias("kept_at"))
        free = titles.join(earlier, ["publisher", "low"], "left").filter(F.col("kept_at").isNull() | (F.col("kept_at") >= F.col("published_at")))
        return free.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= max_per_slot).select("publisher", "published_at", "low", "o")

    start = titles.limit(0).select("publisher", "published_at", "low", "o")
    kept, _ = settle(step, start)
    return kept.select(
        tx.stable_id(pack, F.col("publisher"), F.col("published_at").cast("string"), F.col("o.url")).alias("doc_id"), F.lit("gdelt").alias("source"),
        F.lit("news").alias("source_type"), "publisher", "published_at", F.col("o.title").alias("title"), F.lit("").alias("body"),
        F.col("o.url").alias("url"), F.lit(pack).alias("pack"), F.col("o.tone").alias("tone"))


def validate(signals: DataFrame) -> DataFrame:
    """Contract check of signal rows: adds ``reason`` (null when valid)."""
    def between(c: str, lo: float, hi: float) -> Column:
        return F.when(F.col(c).isNull() | (F.col(c) < lo) | (F.col(c) > hi), F.lit(c))

    grains = F.when(~F.col("grain").isin("document", "event", "entity"), F.lit("grain"))
    status = F.when(~F.col("status").isin("active", "disputed", "retracted"), F.lit("status"))
    from riskloom.dims.text_rules import PRIORITY

    event = F.when(~F.col("event").isin(*PRIORITY), F.lit("event"))
    bad = F.array(between("sentiment", -1, 1), between("sent_conf", 0, 1), between("impact", 1, 10), between("novelty", 0, 100),
                  between("relevance", 0, 100), grains, status, event)
    names = F.filter(bad, lambda b: b.isNotNull())
    return signals.withColumn("reason", F.nullif(F.concat_ws(",", names), F.lit("")))
