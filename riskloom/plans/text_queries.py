"""Sources, scalar text, labels, links and sentiment over ``documents``, ``pages``, ``conversations`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import corpus
from riskloom.dims.publishers import AUTHORITATIVE, BRANDS, CREDIBILITY, OWNERS, PUBLISHERS
from riskloom.dims.text_rules import FILING_ITEMS, FINANCE, FINGERPRINT_STOP_WORDS, PRIORITY, STOP_WORDS
from riskloom.functions import minhash as mh, risk, text as tx, voices
from riskloom.functions.scan import Carry, hours, prefix_scan
from riskloom.operators import evaluate, labels, mentions, names, train
from riskloom.plans.registry import big, joined, query, r6, secs, staged
from riskloom.session import cut, new_path, spread
from riskloom.sources import documents as src, tables as ref

DIMS, FEED = corpus.DIMS, corpus.FEED_SQL


def words(ws) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"


STOPS, FPSTOPS = words(STOP_WORDS.split()), words(FINGERPRINT_STOP_WORDS.split())
TOKENS_SQL = f"""toks AS (
  SELECT *, list_filter(regexp_extract_all(lower(key_text), '[a-z0-9$][a-z0-9''$-]*'), lambda t: NOT list_contains({STOPS}, t)) AS tk FROM feed_text
), tok2 AS (
  SELECT *, list_sort(list_distinct(list_filter(tk, lambda t: length(t) > 2 AND NOT regexp_full_match(t, '[0-9]+')))) AS cw,
    CASE WHEN len(tk) >= 3 THEN list_distinct(list_transform(range(1, len(tk) - 1), lambda i: array_to_string(tk[i:i+2], ' ')))
         WHEN len(tk) > 0 THEN [array_to_string(tk, ' ')] ELSE [] END AS sh FROM toks
)"""
DOMAINS = "(VALUES " + ", ".join(f"('{d}', {s}, {str(d in AUTHORITATIVE).lower()}, {repr(OWNERS[d]) if d in OWNERS else 'NULL'})" for d, s in CREDIBILITY.items()) + \
    "".join(f", ('{d}', NULL, {str(d in AUTHORITATIVE).lower()}, '{OWNERS[d]}')" for d in OWNERS if d not in CREDIBILITY) + ") AS dom(domain, score, auth, owner)"


def feed(spark, sf):
    return corpus.feed(spark, sf)


def feed_text(spark, sf):
    return mentions.with_text(feed(spark, sf))


# ------------------------------------------------------------------ sources
@query("s01_document_lines", f"""WITH {FEED}
SELECT doc_id, source_type, publisher, coalesce(author, '') AS author, t + {corpus.EPOCH_2024} AS at, length(title) AS n_title, length(body) AS n_body FROM feed""")
def s01(spark, sf):
    """Landed JSON lines (with comment and blank lines) -> documents."""
    f = feed(spark, sf)
    line = F.to_json(F.struct("doc_id", "source", "source_type", "publisher", "author", "url", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), "title", "body"))
    noise = F.when(F.col("n") % 50 == 0, F.array(F.lit("# header"), F.lit(""), F.lit("  // note"))).otherwise(F.array().cast("array<string>"))
    lines = f.select(F.explode(F.concat(F.array(line), noise)).alias("value"))
    d = src.document_lines(lines)
    return d.select("doc_id", "source_type", "publisher", F.coalesce("author", F.lit("")).alias("author"), secs("published_at").alias("at"),
                    big(F.length("title")).alias("n_title"), big(F.length("body")).alias("n_body"))


@query("s03_news_list", """WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw FROM pages), q AS (
  SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g'), ' ') AS title, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM p)
SELECT 'd_' || substr(sha1('gdelt|' || url), 1, 16) AS doc_id, CASE WHEN page_id % 3 = 0 THEN host ELSE 'outlet' || CAST(page_id % 7 AS VARCHAR) || '.example' END AS publisher,
  1704067200 + page_id * 900 AS at, title FROM q WHERE title <> '' AND page_id % 5 <> 4 AND page_id % 11 <> 10""")
def s03(spark, sf):
    """News-list payloads built from ``pages``: explode, English only, titled, parseable dates."""
    p = corpus.table(spark, sf, "pages").withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    n = F.col("page_id")
    art = F.struct("url", "title", F.when(n % 11 == 10, "bad").otherwise(F.date_format(F.timestamp_seconds(F.lit(corpus.EPOCH_2024) + n * 900), "yyyyMMdd'T'HHmmss'Z'")).alias("seendate"),
                   F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("outlet"), (n % 7).cast("string"), F.lit(".example"))).alias("domain"),
                   F.when(n % 5 == 4, "French").when(n % 5 == 3, "").otherwise("English").alias("language"), F.lit("US").alias("sourcecountry"))
    payload = p.groupBy(F.floor(n / 25).alias("g")).agg(F.to_json(F.struct(F.collect_list(art).alias("articles"))).alias("value"))
    return src.news_list(payload).select("doc_id", "publisher", secs("published_at").alias("at"), "title")


ORDER_ITEMS = "[" + ", ".join(f"'{i[0]}'" for i in FILING_ITEMS) + ", '8.01', '9.01']"


@query("s04_filing_feed", f"""SELECT 'd_' || substr(sha1('edgar|' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-24-' || lpad(CAST(o_custkey % 1000000 AS VARCHAR), 6, '0')), 1, 16) AS doc_id,
  lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, epoch(o_orderdate)::BIGINT AS at,
  'Customer ' || CAST(o_custkey AS VARCHAR) || ' files 8-K' || CASE WHEN o_orderkey % 7 = 6 THEN '/A' ELSE '' END || ': Item ' || {ORDER_ITEMS}[o_orderkey % 17 + 1] || ' Event; Item ' || {ORDER_ITEMS}[o_orderkey % 5 + 13] || ' Other' AS title
FROM orders WHERE o_orderkey % 4 <> 3 AND o_custkey % 3 <> 0 AND o_custkey <> 0""")
def s04(spark, sf):
    """Filing-feed entries (XML) built from ``orders``; only filers present in ``customer`` are kept."""
    o = corpus.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    codes = F.array(*[F.lit(i[0]) for i in FILING_ITEMS], F.lit("8.01"), F.lit("9.01"))
    form = F.when(k % 4 == 3, "4").when(k % 7 == 6, "8-K/A").otherwise("8-K")
    cik = F.lpad(c.cast("string"), 10, "0")
    acc = F.concat(F.lpad(k.cast("string"), 10, "0"), F.lit("-24-"), F.lpad((c % 1000000).cast("string"), 6, "0"))
    xml = F.concat(
        F.lit("<entry><title>"), form, F.lit(" - Customer "), c.cast("string"), F.lit(" ("), cik, F.lit(") (Filer)</title><link href=\"https://www.sec.gov/"), acc,
        F.lit("\"/><summary>&lt;b&gt;Filed&lt;/b&gt; Item "), F.element_at(codes, (k % 17 + 1).cast("int")), F.lit(": Event &lt;br&gt; Item "),
        F.element_at(codes, (k % 5 + 13).cast("int")), F.lit(": Other</summary><updated>"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("+00:00</updated><id>urn:tag:sec.gov,2008:accession-number="), acc, F.lit("</id></entry>"))
    known = corpus.table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"))
    out = src.filing_xml(o.select(xml.alias("value")), known_ciks=known)
    return out.select("doc_id", "cik", secs("published_at").alias("at"), "title")


@query("s05_social_posts", """WITH c AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS body FROM conversations)
SELECT 'd_' || substr(sha1('bluesky|did:' || CAST(conv_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR)), 1, 16) AS doc_id, 'did:' || CAST(conv_id AS VARCHAR) AS author,
  CASE WHEN turn % 2 = 0 THEN 1704067200 + conv_id * 60 + turn ELSE 1704100000 + conv_id END AS at, length(body) AS n
FROM c WHERE role = 'user' AND conv_id % 6 <> 5 AND length(body) >= 20 AND len(regexp_extract_all(body, '\\$[A-Za-z]{1,5}\\b')) <= 5""")
def s05(spark, sf):
    """Post messages built from ``conversations``: create commits, English or unmarked, length and cashtag limits."""
    c = corpus.table(spark, sf, "conversations")
    i, t = F.col("conv_id"), F.col("turn")
    langs = F.when(i % 6 == 5, F.array(F.lit("fr"))).when(i % 6 == 4, F.array(F.lit("de"), F.lit("en-US"))).when(i % 6 == 3, F.array().cast("array<string>"))
    rec = F.struct(F.when(t % 2 == 0, F.date_format(F.timestamp_seconds(F.lit(corpus.EPOCH_2024) + i * 60 + t), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("not a date").alias("createdAt"), langs.alias("langs"), "text")
    msg = F.to_json(F.struct(
        F.concat(F.lit("did:"), i.cast("string")).alias("did"), ((F.lit(1704100000) + i) * 1000000).alias("time_us"), F.lit("commit").alias("kind"),
        F.struct(F.when(F.col("role") == "user", "create").otherwise("delete").alias("operation"), F.lit("app.bsky.feed.post").alias("collection"),
                 t.cast("string").alias("rkey"), F.lit("c").alias("cid"), rec.alias("record")).alias("commit")))
    return src.social_posts(c.select(msg.alias("value")), None).select("doc_id", "author", secs("published_at").alias("at"), big(F.length("body")).alias("n"))


@query("s05_post_prefilter", f"""WITH {FEED}, p AS (SELECT doc_id, regexp_replace(text, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') AS t FROM feed_text)
SELECT doc_id FROM p WHERE """ + " OR ".join(
    "regexp_matches(t, '(?i)(^|[^\\p{L}\\p{N}_])" + a.replace(" ", "  ") + "($|[^\\p{L}\\p{N}_])')" for e in corpus.ENTITIES for a in (*e.aliases, *e.ambiguous_aliases)))
def s05b(spark, sf):
    """Keyword prefilter: any alias in any case, or a company's tag, over whole texts."""
    return feed_text(spark, sf).filter(names.holds_name(corpus.ENTITIES)(F.col("text"))).select("doc_id")


@query("s06_event_export", """WITH e AS (SELECT 'https://' || event_type || '.example.com/' || CAST(user_id AS VARCHAR) AS url, strftime(ts, '%Y%m%d%H%M%S') AS added, CAST(event_id AS VARCHAR) AS tone FROM events WHERE event_id % 9 <> 8)
SELECT url, min(added) AS added, arg_min(tone, (added, tone)) AS tone FROM e WHERE regexp_matches(lower(url), 'error|purchase') GROUP BY url""")
def s06(spark, sf):
    """61-column export lines built from ``events``: earliest row per matching address."""
    e = corpus.table(spark, sf, "events")
    url = F.concat(F.lit("https://"), "event_type", F.lit(".example.com/"), F.col("user_id").cast("string"))
    pad = lambda n: F.array_repeat(F.lit("x"), n)
    full = F.concat(pad(34), F.array(F.col("event_id").cast("string")), pad(24), F.array(F.date_format("ts", "yyyyMMddHHmmss"), url))
    line = F.array_join(F.when(F.col("event_id") % 9 == 8, F.slice(full, 1, 60)).otherwise(full), "\t")
    return src.event_export(e.select(line.alias("value")), "error|purchase")


@query("s07_filing_history", """SELECT 'T' || CAST(o_custkey AS VARCHAR) AS ticker, CASE WHEN o_orderkey % 3 = 0 THEN '8-K' ELSE '8-K/A' END AS form, strftime(o_orderdate, '%Y-%m-%d') AS filing_date,
  o_orderpriority AS items, CAST(o_orderkey AS VARCHAR) || '-1' AS accession,
  'https://www.sec.gov/Archives/edgar/data/' || ltrim(lpad(CAST(o_custkey AS VARCHAR), 10, '0'), '0') || '/' || CAST(o_orderkey AS VARCHAR) || '1/d.htm' AS url
FROM orders WHERE o_orderkey % 3 <> 2 AND o_orderdate >= TIMESTAMP '1997-01-01'""")
def s07(spark, sf):
    """Parallel-array filing blocks per filer built from ``orders`` -> one row per filing since 1997."""
    o = corpus.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    rows = F.collect_list(F.struct(
        F.when(k % 3 == 0, "8-K").when(k % 3 == 1, "8-K/A").otherwise("10-Q").alias("form"), F.concat(k.cast("string"), F.lit("-1")).alias("acc"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_orderpriority").alias("items")))
    b = o.groupBy("o_custkey").agg(rows.alias("r")).select(
        F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("ticker"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"),
        F.to_json(F.struct(F.col("r.form").alias("form"), F.col("r.acc").alias("accessionNumber"), F.col("r.d").alias("filingDate"), F.col("r.d").alias("acceptanceDateTime"),
                           F.col("r.items").alias("items"), F.transform("r.d", lambda x: F.lit("d.htm")).alias("primaryDocument"))).alias("value"))
    return src.filing_history(b, "1997-01-01").select("ticker", "form", "filing_date", "items", "accession", "url")


@query("s09_universe", """WITH s AS (SELECT 'E' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, 1 AS f, s_suppkey AS k FROM supplier UNION ALL
  SELECT 'E' || CAST(c_custkey AS VARCHAR), c_name, 2, c_custkey FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY f) AS n FROM s)
SELECT id AS entity_id, name, CASE WHEN f = 1 THEN 'US' ELSE 'IN' END AS index_name, CASE WHEN k % 2 = 0 THEN lpad(CAST(k AS VARCHAR), 10, '0') END AS cik,
  CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE k % 3 END AS BIGINT) AS n_aliases, 1 + CAST(k % 2 AS BIGINT) AS n_tags FROM r WHERE n = 1""")
def s09(spark, sf):
    """Entity files built from ``supplier`` and ``customer``: pipe lists, padded ids, first file wins."""
    u = ref.universe(entity_files(spark, sf))
    return u.select("entity_id", "name", "index_name", "cik", big(F.size("aliases")).alias("n_aliases"), big(F.size("cashtags")).alias("n_tags"))


def entity_files(spark, sf):
    def file(t, key, name):
        d = corpus.table(spark, sf, t)
        k = F.col(key)
        return d.select(
            F.concat(F.lit(" e"), k.cast("string")).alias("ticker"), F.col(name).alias("name"), F.when(k % 2 == 0, k.cast("string")).alias("cik"), F.lit("Energy").alias("sector"),
            F.when(k % 3 == 1, "a").when(k % 3 == 2, "a | b |").otherwise("").alias("aliases"), F.lit("").alias("ambiguous_aliases"),
            F.when(k % 2 == 1, "TAG").alias("extra_cashtags"), F.lit("x.example|y.example").alias("domains"))
    return [(file("supplier", "s_suppkey", "s_name"), "US"), (file("customer", "c_custkey", "c_name"), "IN")]


@query("s09_macro_universe", "WITH s AS (SELECT DISTINCT 'E' || CAST(k AS VARCHAR) AS id FROM (SELECT s_suppkey AS k FROM supplier UNION ALL SELECT c_custkey FROM customer)) SELECT 'company' AS entity_type, count(*) AS n, CAST(NULL AS VARCHAR) AS entity_id, CAST(NULL AS BIGINT) AS n_aliases FROM s UNION ALL SELECT 'macro', 1, id, n FROM (VALUES "
       + ", ".join(f"('{e}', {len(a)})" for e, _, a in ref.MACRO_ENTITIES) + ") m(id, n)")
def s09m(spark, sf):
    """The universe with its macro entities: how many companies, and each macro entity with its aliases."""
    u = ref.universe(entity_files(spark, sf), ref.macro_entities(spark))
    macro = F.col("entity_type") == "macro"
    g = u.groupBy("entity_type", F.when(macro, F.col("entity_id")).alias("entity_id"), F.when(macro, F.size("aliases")).alias("n_aliases")).agg(F.count("*").alias("n"))
    return g.select("entity_type", "n", "entity_id", big("n_aliases").alias("n_aliases"))


@query("p19_universe_slices", """WITH s AS (SELECT 'E' || CAST(s_suppkey AS VARCHAR) AS id, 1 AS f FROM supplier UNION ALL SELECT 'E' || CAST(c_custkey AS VARCHAR), 2 FROM customer),
 r AS (SELECT id, min(f) AS f FROM s GROUP BY id) SELECT CASE WHEN f = 1 THEN 'US' ELSE 'IN' END AS index_name, count(*) AS members FROM r GROUP BY 1""")
def p19(spark, sf):
    a = corpus.table(spark, sf, "supplier").select(F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.lit("US").alias("index_name"))
    b = corpus.table(spark, sf, "customer").select(F.concat(F.lit("E"), F.col("c_custkey").cast("string")).alias("entity_id"), F.lit("IN").alias("index_name"))
    u = a.unionByName(b.join(a.select("entity_id"), "entity_id", "left_anti"))
    return ref.index_members(u, "US").unionByName(ref.index_members(u, "IN")).groupBy("index_name").agg(F.count("*").alias("members"))


@query("s12_caps", """WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE s_acctbal END AS v FROM supplier)
SELECT 'E' || CAST(s_suppkey AS VARCHAR) AS ticker, v AS market_cap FROM s WHERE v > 0""")
def s12(spark, sf):
    """Caps table with unreadable and non-positive cells dropped."""
    s = corpus.table(spark, sf, "supplier").select(F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("ticker"),
                                                   F.when(F.col("s_suppkey") % 10 == 9, "n/a").otherwise(F.col("s_acctbal").cast("string")).alias("market_cap"))
    return ref.positive(s, "ticker", "market_cap")


@query("s15_manifest")
def s15(spark, sf):
    """Inventory of the table files: rows by text scan, size, digest."""
    return ref.manifest(spark, f"{sf}/*.parquet").select("file", "length", "rows", "sha256")


TABLE_FILES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("s15_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS file, count(*) AS rows FROM {t}" for t in TABLE_FILES))
def s15n(spark, sf):
    """Rows per table of the inventory (a table may be a folder of files)."""
    m = ref.manifest(spark, f"{sf}/*.parquet")
    table = F.regexp_extract("path", r"/([a-z]+)\.parquet", 1)
    return m.groupBy(table.alias("file")).agg(F.sum("rows").alias("rows"))


PAIR_LABELS = ("negative", "neutral", "positive")


def labelled_rows(spark, sf):
    """Titles with an {entity: label} map built from their first and last long words."""
    f = feed(spark, sf).filter(F.col("title") != "")
    ws = F.filter(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 3)
    f = f.withColumn("ws", F.array_distinct(ws)).filter(F.size("ws") >= 2)
    lab = lambda x: F.element_at(F.array(*[F.lit(v) for v in PAIR_LABELS]), (x % 3 + 1).cast("int"))
    last = F.element_at("ws", -1)
    m = F.create_map(F.element_at("ws", 1), lab(F.col("n")), last, lab(F.floor(F.col("n") / 3)))
    return f.select("doc_id", "n", "title", F.to_json(m).alias("decisions"))


@query("s02_recorded_feed", f"WITH {FEED} SELECT doc_id, source_type, title, {corpus.EPOCH_2024} + t::BIGINT AS at FROM feed")
def s02(spark, sf):
    """The feed recorded as JSON lines in two appends, read back."""
    path = new_path(spark, "recorded")
    f = feed(spark, sf).select("doc_id", "source_type", "title", "published_at")
    for k in range(2):
        ref.record_feed(f.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == k), path)
    r = spark.read.schema(f.schema).json(path)
    return r.select("doc_id", "source_type", "title", secs("published_at").alias("at"))


@query("s14_report_files", f"WITH {FEED}, r AS (SELECT source_type, publisher, count(*) AS n FROM feed GROUP BY 1, 2) SELECT fmt, source_type, publisher, n FROM r, (VALUES ('csv'), ('json')) AS f(fmt)")
def s14(spark, sf):
    """A report (documents by outlet) written as one CSV and one JSON file, both read back."""
    report = feed(spark, sf).groupBy("source_type", "publisher").agg(F.count("*").alias("n"))
    parts = []
    for fmt in ("csv", "json"):
        path = new_path(spark, f"report-{fmt}")
        ref.write_report(report, path, fmt)
        read = spark.read.schema(report.schema)
        parts.append((read.option("header", "true").csv(path) if fmt == "csv" else read.json(path)).select(F.lit(fmt).alias("fmt"), "source_type", "publisher", "n"))
    return parts[0].unionByName(parts[1])


@query("k01_feed_order", f"WITH {FEED} SELECT doc_id, row_number() OVER (ORDER BY t, doc_id) AS place FROM feed")
def k01(spark, sf):
    """Places in the feed's total order: counted day by day, so no task orders the whole feed."""
    f = feed(spark, sf).select("doc_id", "published_at", F.lit(1).alias("feed"))
    one = F.lit(1).cast("bigint")
    return prefix_scan(f, ["feed"], src.ORDER, hours("published_at", 1), [Carry("place", "sum", one)], split=True).select("doc_id", "place")


@query("s16_labelled_pairs", f"""WITH {FEED}, w AS (SELECT doc_id, n, title, list_filter(regexp_extract_all(lower(title), '[a-z]+'), lambda w: length(w) > 3) AS ws FROM feed WHERE title <> ''),
 p AS (SELECT doc_id, n, title, list_distinct(ws) AS d, ws FROM w), q AS (SELECT *, ws[1] AS a, ws[len(ws)] AS z0 FROM p WHERE len(d) >= 2),
 o AS (SELECT *, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS firsts FROM q), r AS (SELECT *, firsts[len(firsts)] AS z FROM o),
 pairs AS (SELECT doc_id, title, a AS entity, n % 3 AS l, n % 3 <> (n // 3) % 3 AS conflict FROM r UNION ALL SELECT doc_id, title, z, (n // 3) % 3, n % 3 <> (n // 3) % 3 FROM r),
 found AS (SELECT *, len(list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+'), lambda t: t = entity)) AS hits FROM pairs)
SELECT doc_id, entity, ['negative', 'neutral', 'positive'][CAST(l + 1 AS INTEGER)] AS label, hits, CAST(2 AS BIGINT) AS n_entities, CAST(conflict AS BIGINT) AS conflict FROM found WHERE hits > 0""")
def s16(spark, sf):
    """Labelled headlines -> one row per (headline, entity) with whole-word spans and the conflict flag."""
    p = ref.labelled_pairs(labelled_rows(spark, sf))
    return p.select("doc_id", "entity", "label", big(F.size("target")).alias("hits"), big("n_entities").alias("n_entities"), big(F.col("conflict").cast("int")).alias("conflict"))


@query("s17_archive_pack")
def s17(spark, sf):
    """Archive addresses rebuilt from document titles -> deduplicated, slot-limited pack (settled in rounds)."""
    f = feed(spark, sf).filter(F.col("title") != "")
    slug = F.concat_ws("-", F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0)))
    rows = f.select(F.date_format(F.window("published_at", "15 minutes")["start"], "yyyyMMddHHmmss").alias("date_added"),
                    F.concat(F.lit("https://www.d"), (F.col("n") % 5).cast("string"), F.lit(".example/2024/"), slug, F.lit(".html")).alias("url"), F.lit("0").alias("tone"))
    return src.archive_pack(rows, "corpus", frozenset(corpus.ACRONYMS)).select("doc_id", "publisher", secs("published_at").alias("at"), "title")


# ------------------------------------------------------------------ projections and scalar text
@query("p01_document_text", f"WITH {FEED} SELECT doc_id, length(text) AS n, md5(text) AS h FROM feed_text")
def p01(spark, sf):
    return feed_text(spark, sf).select("doc_id", big(F.length("text")).alias("n"), F.md5("text").alias("h"))


@query("p02_story_key", f"WITH {FEED} SELECT doc_id, md5(key_text) AS h, length(key_text) AS n FROM feed_text")
def p02(spark, sf):
    return feed_text(spark, sf).select("doc_id", F.md5("key_text").alias("h"), big(F.length("key_text")).alias("n"))


@query("p03_source_predicates", f"""WITH {FEED} SELECT doc_id, CAST(lang = 'en' AS BIGINT) AS english, CAST(length(text) >= 20 AS BIGINT) AS long_enough,
  CAST(len(regexp_extract_all(text, '\\$[A-Za-z]{{1,5}}\\b')) <= 5 AS BIGINT) AS few_tags FROM feed_text""")
def p03(spark, sf):
    return feed_text(spark, sf).select(
        "doc_id", big((F.col("language") == "en").cast("int")).alias("english"), big((F.length("text") >= 20).cast("int")).alias("long_enough"),
        big((F.regexp_count("text", F.lit(r"\$[A-Za-z]{1,5}\b")) <= 5).cast("int")).alias("few_tags"))


VOICE_SQL = f"""src AS (SELECT DISTINCT publisher, source_type, author, regexp_replace(lower(publisher), '^www\\.', '') AS host, lower(coalesce(author, '')) AS handle FROM feed),
suf AS (SELECT DISTINCT h.host, i, array_to_string(string_split(h.host, '.')[i:], '.') AS s FROM (SELECT host FROM src UNION SELECT handle FROM src) h, range(1, 10) r(i) WHERE i < len(string_split(h.host, '.'))),
best AS (SELECT host, arg_min(score, i) FILTER (WHERE score IS NOT NULL) AS score, bool_or(coalesce(auth, false)) AS auth, arg_min(owner, i) FILTER (WHERE owner IS NOT NULL) AS owner FROM suf JOIN {DOMAINS} ON s = domain GROUP BY host),
v AS (SELECT src.*, b.score, coalesce(b.auth, false) AS auth, b.owner,
  (b.score IS NULL AND host <> '' AND len(list_filter({words(BRANDS)}, lambda x: contains(regexp_replace(host, '[-_.]', '', 'g'), x))) > 0)
  OR (handle <> '' AND bh.score IS NULL AND len(list_filter({words(BRANDS)}, lambda x: contains(regexp_replace(handle, '[-_.]', '', 'g'), x))) > 0) AS look
  FROM src LEFT JOIN best b USING (host) LEFT JOIN best bh ON bh.host = src.handle),
voice AS (SELECT publisher, source_type, author, look, CASE WHEN look THEN 0.15 WHEN source_type <> 'social' AND score IS NOT NULL THEN score
    WHEN source_type = 'news' THEN 0.6 WHEN source_type = 'social' THEN 0.3 ELSE 1.0 END AS cred,
  CASE source_type WHEN 'filing' THEN true WHEN 'social' THEN false ELSE auth END AS auth,
  CASE source_type WHEN 'filing' THEN 'filing:' || host WHEN 'social' THEN 'social:' || coalesce(author, host) ELSE 'news:' || coalesce(owner, host) END AS vkey FROM v)"""


@query("f05_source_checks", f"""WITH {FEED}, {VOICE_SQL} SELECT publisher, source_type, coalesce(author, '') AS author, CAST(look AS BIGINT) AS lookalike, cred AS credibility, CAST(auth AS BIGINT) AS authoritative, vkey AS independence_key FROM voice""")
def f05(spark, sf):
    """Credibility, authority, impersonation and independence per distinct voice (J06 suffix lookup)."""
    v = feed(spark, sf).select("publisher", "source_type", "author").distinct()
    p, k, a = F.col("publisher"), F.col("source_type"), F.col("author")
    return v.select("publisher", "source_type", F.coalesce("author", F.lit("")).alias("author"), big(voices.is_lookalike(p, a, PUBLISHERS).cast("int")).alias("lookalike"),
                    voices.credibility(p, k, a, PUBLISHERS).alias("credibility"), big(voices.is_authoritative(p, k, PUBLISHERS).cast("int")).alias("authoritative"),
                    voices.independence_key(p, k, a, PUBLISHERS).alias("independence_key"))


@query("p08_issuer_official", f"""WITH {FEED}, d AS (SELECT DISTINCT regexp_replace(lower(publisher), '^www\\.', '') AS host FROM feed),
 e AS (SELECT * FROM (VALUES {", ".join(f"('{e.entity_id}', '{d}')" for e in corpus.ENTITIES for d in e.domains)}) t(entity_id, domain))
SELECT DISTINCT host, entity_id FROM d JOIN e ON host = domain OR ends_with(host, '.' || domain)""")
def p08(spark, sf):
    d = feed(spark, sf).select(voices.base_domain(F.col("publisher")).alias("host")).distinct()
    hits = F.array(*[F.when(voices.is_official(F.col("host"), F.array(*[F.lit(x) for x in e.domains])), F.lit(e.entity_id)) for e in corpus.ENTITIES if e.domains])
    return d.select("host", F.explode_outer(F.filter(hits, lambda h: h.isNotNull())).alias("entity_id")).filter("entity_id is not null")


@query("p05_denials", f"""WITH {FEED}, {VOICE_SQL} SELECT doc_id FROM feed_text JOIN voice USING (publisher, source_type)
WHERE voice.author IS NOT DISTINCT FROM feed_text.author AND auth AND NOT look AND len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda t: list_contains({words(corpus.CORPUS_DENIALS)}, t))) > 0""")
def p05(spark, sf):
    """Denial wording from an authoritative, genuine source."""
    f = feed_text(spark, sf)
    return f.filter(voices.is_denial(F.col("text"), F.col("publisher"), F.col("source_type"), F.col("author"), F.array().cast("array<string>"), DIMS.denial, PUBLISHERS)).select("doc_id")


@query("f01_content_ids", f"WITH {FEED} SELECT doc_id, 'd_' || substr(sha1(source || '|' || publisher || '|' || coalesce(author, 'None')), 1, 16) AS cid FROM feed")
def f01(spark, sf):
    return feed(spark, sf).select("doc_id", tx.stable_id("d", F.col("source"), F.col("publisher"), F.col("author")).alias("cid"))


@query("f04_url_domains", "SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':.*$', ''), '^www\\.', '') AS domain FROM pages")
def f04(spark, sf):
    return corpus.table(spark, sf, "pages").select("page_id", tx.url_host(F.col("url")).alias("domain"))


@query("f08_content_words", f"WITH {FEED}, {TOKENS_SQL} SELECT doc_id, len(tk) AS tokens, array_to_string(cw, ' ') AS words FROM tok2")
def f08(spark, sf):
    t = spread(feed_text(spark, sf)).select("doc_id", tx.tokens(F.col("key_text"), FINANCE.stop).alias("tk"))
    return t.select("doc_id", big(F.size("tk")).alias("tokens"), F.concat_ws(" ", tx.content_words(F.col("tk"))).alias("words"))


@query("f09_shingles", f"WITH {FEED}, {TOKENS_SQL} SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), '|')) AS h FROM tok2")
def f09(spark, sf):
    t = spread(feed_text(spark, sf)).select("doc_id", tx.tokens(F.col("key_text"), FINANCE.stop).alias("tk")).select("doc_id", tx.shingles(F.col("tk")).alias("sh"))
    return t.select("doc_id", big(F.size("sh")).alias("n"), F.md5(F.concat_ws("|", F.array_sort("sh"))).alias("h"))


PERM = "[" + ", ".join(f"{{'a': {a}::BIGINT, 'b': {b}::BIGINT}}" for a, b in mh.permutations()) + "]"
SIG_SQL = f"""hs AS (SELECT *, list_transform(sh, lambda s: ('0x' || substr(md5(s), 1, 8))::BIGINT) AS hh FROM tok2),
sig AS MATERIALIZED (SELECT *, CASE WHEN len(hh) = 0 THEN list_transform(range(64), lambda i: {mh.MASK}::BIGINT) ELSE
  list_transform({PERM}, lambda p: list_min(list_transform(hh, lambda h: ((p.a * h + p.b) % {mh.PRIME}) & {mh.MASK}))) END AS s FROM hs)"""


@query("f10_minhash", f"WITH {FEED}, {TOKENS_SQL}, {SIG_SQL} SELECT doc_id, md5(array_to_string(s, ',')) AS h, s[1] AS first_slot FROM sig")
def f10(spark, sf):
    t = spread(feed_text(spark, sf)).select("doc_id", tx.tokens(F.col("key_text"), FINANCE.stop).alias("tk")).select("doc_id", mh.signature(tx.shingles(F.col("tk"))).alias("s"))
    return t.select("doc_id", F.md5(joined(F.col("s"))).alias("h"), F.get("s", F.lit(0)).alias("first_slot"))


@query("f12_band_candidates", f"""WITH {FEED}, {TOKENS_SQL}, {SIG_SQL}, b AS MATERIALIZED (SELECT DISTINCT i AS band, array_to_string(s[i*4+1:i*4+4], ',') AS k, array_to_string(tk, ' ') AS txt FROM sig, range(16) r(i) WHERE len(tk) > 0)
SELECT count(*) AS pairs FROM (SELECT DISTINCT x.txt, y.txt FROM b x JOIN b y USING (band, k) WHERE x.txt < y.txt)""")
def f12(spark, sf):
    """Banded candidate pairs between distinct key texts (16 bands of 4 slots)."""
    t = feed_text(spark, sf).select(F.concat_ws(" ", tx.tokens(F.col("key_text"), FINANCE.stop)).alias("txt")).distinct().filter("txt <> ''")
    signed = cut(t.withColumn("tk", F.split("txt", " ")).select("txt", mh.signature(tx.shingles(F.col("tk"))).alias("sig")))
    b = signed.select("txt", F.explode(mh.band_keys(F.col("sig"))).alias("k"))
    pairs = b.alias("x").join(b.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.txt") < F.col("y.txt"))).select("x.txt", F.col("y.txt").alias("other")).distinct()
    return pairs.agg(F.count("*").alias("pairs"))


@query("f13_fingerprints", f"""WITH {FEED} SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(CASE WHEN title <> '' THEN title ELSE body END), '[a-z0-9]+'), lambda t: NOT list_contains({FPSTOPS}, t))[1:10], ' ') AS fp FROM feed""")
def f13(spark, sf):
    return feed(spark, sf).select("doc_id", tx.fingerprint(F.col("title"), F.col("body"), FINANCE.fingerprint_stop).alias("fp"))


@query("f20_url_headlines", f"""WITH {FEED}, u AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(title), '[a-z]+'), '-') AS slug FROM feed WHERE title <> ''),
 w AS (SELECT doc_id, list_filter(string_split_regex(slug, '[-_+]+'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(?:[0-9]+|[0-9a-f]{{8,}}|[a-z]?[0-9]{{5,}}[a-z0-9]*|index|amp|story|news|article|articleshow)$')) AS ws FROM u)
SELECT doc_id, CASE WHEN len(ws) >= 3 THEN array_to_string(list_transform(ws[1:24], lambda x, i: CASE WHEN list_contains({words(corpus.ACRONYMS)}, upper(x)) THEN upper(x)
  WHEN i > 1 AND list_contains({words(tx.SMALL_WORDS.split())}, x) THEN x ELSE upper(substr(x, 1, 1)) || substr(x, 2) END), ' ') END AS headline FROM w""")
def f20(spark, sf):
    """Headlines rebuilt from address slugs (acronyms keep their capitals)."""
    f = feed(spark, sf).filter(F.col("title") != "")
    slug = F.concat_ws("-", F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0)))
    url = F.concat(F.lit("https://www.example.com/2024/01/"), slug, F.lit("-12345678.html?x=1"))
    return f.select("doc_id", tx.headline_from_url(url, frozenset(corpus.ACRONYMS)).alias("headline"))


@query("f21_acronyms", """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) SELECT w AS acronym FROM w WHERE w = upper(w) AND length(w) >= 2""")
def f21(spark, sf):
    """All-capital words of a text column."""
    d = corpus.table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    return d.filter((F.col("w") == F.upper("w")) & (F.length("w") >= 2)).select(F.col("w").alias("acronym")).distinct()


# ------------------------------------------------------------------ labels
RULES_SQL = "(VALUES " + ", ".join(f"({i}, '{c}', '{s}', {w}, {words(ws)})" for i, (c, s, w, ws) in enumerate(corpus.CORPUS_RULES)) + ") AS r(i, cls, subtype, w, ws)"
PRIO = "[" + ", ".join(f"'{c}'" for c in PRIORITY) + "]"
LABEL_SQL = f"""wd AS (SELECT doc_id, n, source, source_type, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws0, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+') AS ts0 FROM feed_text),
fired AS (SELECT doc_id, i, cls, subtype, w, len(list_filter(ws0, lambda x: list_contains(r.ws, x))) AS hits, len(list_filter(ts0, lambda x: list_contains(r.ws, x))) AS th FROM wd, {RULES_SQL}),
sc AS (SELECT *, w * (1 + 0.5 * least(hits - 1, 2)) * CASE WHEN th > 0 THEN 1.5 ELSE 1.0 END AS s FROM fired WHERE hits > 0),
cl AS (SELECT doc_id, cls, sum(s) AS score, arg_max(subtype, (s, -i)) AS sub, list_position({PRIO}, cls) AS prio FROM sc GROUP BY doc_id, cls),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, prio) AS rn, sum(score) OVER (PARTITION BY doc_id) AS total, max(score) OVER (PARTITION BY doc_id) AS top FROM cl),
lab AS (SELECT wd.doc_id, wd.n, wd.source, wd.source_type, coalesce(max(cls) FILTER (WHERE rn = 1), 'OTHER') AS rule_cls, max(sub) FILTER (WHERE rn = 1) AS rule_sub,
  coalesce(max(round_even(0.3 + 0.65 * (score / total) * least(1.0, score / 3.0), 3)) FILTER (WHERE rn = 1), 0.3) AS rule_conf, count(*) FILTER (WHERE score >= 0.5 * top - 1e-12) AS n_lab FROM wd LEFT JOIN rk USING (doc_id) GROUP BY ALL),
itm AS (SELECT doc_id, arg_max(cls, (rank, -pos)) AS cls, arg_max(subtype, (rank, -pos)) AS sub FROM (SELECT doc_id, unnest([1, 2]) AS pos, unnest([{ORDER_ITEMS}[n % 17 + 1], {ORDER_ITEMS}[n % 5 + 13]]) AS code FROM wd WHERE source_type = 'filing') x
  JOIN (VALUES {", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in FILING_ITEMS)}) m(code, cls, subtype, rank) USING (code) GROUP BY doc_id),
label AS (SELECT lab.*, coalesce(itm.cls, rule_cls) AS cls, CASE WHEN itm.cls IS NOT NULL THEN itm.sub ELSE rule_sub END AS sub, CASE WHEN itm.cls IS NOT NULL THEN 0.95 ELSE rule_conf END AS conf FROM lab LEFT JOIN itm USING (doc_id))"""


@query("a01_rule_scores", f"WITH {FEED}, {LABEL_SQL} SELECT doc_id, cls, subtype, hits, s FROM sc")
def a01(spark, sf):
    return labels.rule_scores(spread(feed_text(spark, sf)), DIMS).select("doc_id", "cls", "subtype", big("hits").alias("hits"), "s")


def labelled(spark, sf):
    return staged(spark, sf, "labels", lambda: labels.with_label(spread(feed_text(spark, sf)), DIMS).select(
        "doc_id", "n", "source", "source_type", "publisher", "title", "label"))


@query("a02_event_labels", f"WITH {FEED}, {LABEL_SQL} SELECT doc_id, cls, coalesce(sub, '') AS sub, conf FROM label")
def a02(spark, sf):
    """Class, subtype and confidence per document."""
    return labelled(spark, sf).select("doc_id", F.col("label.primary").alias("cls"), F.coalesce("label.subtype", F.lit("")).alias("sub"), F.col("label.confidence").alias("conf"))


@query("a02_label_counts", f"WITH {FEED}, {LABEL_SQL} SELECT source, cls, count(*) AS n, round(avg(conf), 6) AS mean_conf FROM label GROUP BY source, cls")
def a02_counts(spark, sf):
    """Flagship slice: documents -> labels -> counts per source and class."""
    rows = labels.with_label(spread(feed_text(spark, sf)), DIMS)
    return rows.groupBy("source", F.col("label.primary").alias("cls")).agg(F.count("*").alias("n"), r6(F.avg("label.confidence")).alias("mean_conf"))


@query("u04_label_unions", f"WITH {FEED}, {LABEL_SQL} SELECT doc_id, n_lab FROM lab WHERE source_type <> 'filing' AND rule_cls <> 'OTHER'")
def u04(spark, sf):
    """Labels within half of the top score, in ranked order without duplicates."""
    return labelled(spark, sf).filter((F.col("source_type") != "filing") & (F.col("label.primary") != "OTHER")).select("doc_id", big(F.size("label.labels")).alias("n_lab"))


@query("k09_severe_items", f"WITH {FEED}, {LABEL_SQL} SELECT doc_id, cls, sub FROM itm")
def k09(spark, sf):
    f = feed(spark, sf).filter("source_type = 'filing'").withColumn("ms", labels.most_severe_item(F.col("items"), DIMS))
    top = F.get(F.array_sort(F.transform("ms", lambda m, i: F.struct((-m["rank"]).alias("r"), i.alias("i"), m["cls"].alias("cls"), m["subtype"].alias("sub")))), F.lit(0))
    return f.filter(F.size("ms") > 0).select("doc_id", top["cls"].alias("cls"), top["sub"].alias("sub"))


# ------------------------------------------------------------------ links
ALIASES_SQL = "(VALUES " + ", ".join(
    f"('{e.entity_id}', '{k}', {words(a.split(' '))}, {str(any(c.isupper() for c in a)).lower()}, {len(a)})" for e in corpus.ENTITIES for k, al in (("alias", e.aliases), ("ambiguous", e.ambiguous_aliases)) for a in al) + ") AS al(ent, kind, parts, cs, len)"
HITS_SQL = f"""pc AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]')) AS tok, generate_subscripts(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]'), 1) AS i FROM feed_text),
pos AS (SELECT *, coalesce(sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s,
  lag(tok) OVER (PARTITION BY doc_id ORDER BY i) AS before, lead(tok) OVER (PARTITION BY doc_id ORDER BY i) AS n1, lead(tok, 2) OVER (PARTITION BY doc_id ORDER BY i) AS n2 FROM pc),
h0 AS (SELECT doc_id, ent, kind, s, s + al.len AS e FROM pos JOIN {ALIASES_SQL} ON CASE WHEN cs THEN tok ELSE lower(tok) END = parts[1] AND (len(parts) = 1 OR (n1 = ' ' AND CASE WHEN cs THEN n2 ELSE lower(n2) END = parts[2])) WHERE coalesce(before, '') <> '$'),
h1 AS (SELECT * FROM h0 h WHERE NOT EXISTS (SELECT 1 FROM h0 o WHERE o.doc_id = h.doc_id AND o.ent <> h.ent AND o.s <= h.s AND h.e <= o.e AND o.e - o.s > h.e - h.s)),
h2 AS (SELECT * FROM h1 h WHERE NOT EXISTS (SELECT 1 FROM h1 o WHERE o.doc_id = h.doc_id AND o.ent = h.ent AND ((o.s < h.s AND h.s < o.e) OR (o.s = h.s AND o.e > h.e))))"""


def raw_hits(d, lk, nested=True):
    """``hits`` of the texts, filings aside."""
    return d.withColumn("hits", lk.hits(F.col("text"), F.col("title"), F.lit("news"), F.lit(None).cast("string"), nested))


@query("j03_alias_hits", f"WITH {FEED}, {HITS_SQL} SELECT doc_id, ent, kind, s, e FROM h0 h WHERE NOT EXISTS (SELECT 1 FROM h0 o WHERE o.doc_id = h.doc_id AND o.s = h.s AND o.e > h.e)")
def j03(spark, sf):
    """Alias matches with character spans (the longest alias at each start)."""
    d = spread(feed_text(spark, sf))
    lk = mentions.Linker(corpus.ENTITIES, DIMS)
    h = raw_hits(d, lk).select("doc_id", F.explode_outer("hits").alias("h")).filter("h is not null")
    return h.filter(F.col("h.kind").isin("alias", "ambiguous")).select("doc_id", "h.ent", "h.kind", big("h.s").alias("s"), big("h.e").alias("e"))


@query("j04_longest_names", f"WITH {FEED}, {HITS_SQL} SELECT doc_id, ent, count(*) AS hits, min(s) AS first FROM h2 GROUP BY doc_id, ent")
def j04(spark, sf):
    """Names inside longer names of other entities dropped, overlaps within an entity merged."""
    d = spread(feed_text(spark, sf))
    lk = mentions.Linker([e for e in corpus.ENTITIES], DIMS, min_score=0.0)
    h = raw_hits(d, lk, nested=False)
    m = h.select("doc_id", F.explode_outer(lk.mentions(F.col("text"), F.col("title"), F.col("source_type"), F.col("hits"))).alias("m")).filter("m is not null")
    return m.select("doc_id", "m.ent", big(F.size("m.spans")).alias("hits"), big(F.get("m.spans", F.lit(0))["s"]).alias("first"))


MENTION_SQL = f"""amb AS (SELECT h2.*, len(list_filter(list_distinct(regexp_extract_all(lower(substr(f.text, greatest(0, s - 160)::BIGINT + 1, (e + 160 - greatest(0, s - 160))::BIGINT)), '[a-z][a-z''-]*')), lambda w: list_contains({words(corpus.CORPUS_CONTEXT)}, w))) AS ctx
  FROM h2 JOIN feed_text f USING (doc_id)),
sure AS (SELECT DISTINCT doc_id, ent FROM h1 WHERE kind <> 'ambiguous'),
men AS (SELECT doc_id, ent, count(*) AS hits, min(s) AS first, bool_and(kind = 'ambiguous') AS soft, max(CASE WHEN ctx >= 2 THEN 0.9 WHEN ctx >= 1 THEN 0.75 ELSE 0.35 END) AS amb FROM amb GROUP BY doc_id, ent),
men2 AS (SELECT men.*, CASE WHEN NOT soft THEN 0.95 WHEN EXISTS (SELECT 1 FROM sure x WHERE x.doc_id = men.doc_id AND x.ent <> men.ent) THEN greatest(amb, 0.8) ELSE amb END AS ned FROM men),
mention AS (SELECT men2.*, f.source_type, round_even(CASE WHEN f.source_type = 'social' THEN 70 + 10 * least(hits - 1, 2)
   ELSE 20.0 + CASE WHEN f.title <> '' AND first < length(f.title) THEN 45 ELSE 0 END + 20.0 * (1.0 - first / greatest(length(f.text), 1)::DOUBLE) + 5 * least(hits, 3) END, 0) AS rel0
  FROM men2 JOIN feed_text f USING (doc_id) WHERE ned >= 0.6)"""


@query("a03_mentions", f"WITH {FEED}, {HITS_SQL}, {MENTION_SQL} SELECT doc_id, ent, hits, ned, least(100, greatest(0, rel0))::BIGINT AS relevance FROM mention")
def a03(spark, sf):
    """Mention rows: hits, link score with ambiguity context, relevance."""
    d = mentions.Linker(corpus.ENTITIES, DIMS).link(spread(feed_text(spark, sf)))
    m = d.select("doc_id", F.explode_outer("mentions").alias("m")).filter("m is not null")
    return m.select("doc_id", "m.ent", big(F.size("m.spans")).alias("hits"), "m.ned", big("m.relevance").alias("relevance"))


@query("k02_ranked_mentions", f"WITH {FEED}, {HITS_SQL}, {MENTION_SQL} SELECT doc_id, ent, row_number() OVER (PARTITION BY doc_id ORDER BY least(100, greatest(0, rel0)) DESC, ent) AS rank FROM mention")
def k02(spark, sf):
    d = mentions.Linker(corpus.ENTITIES, DIMS).link(spread(feed_text(spark, sf)))
    ranked = F.array_sort(F.transform("mentions", lambda m: F.struct((-m["relevance"]).alias("neg"), m["ent"].alias("ent"))))
    r = d.select("doc_id", F.posexplode_outer(ranked).alias("i", "m")).filter("m is not null")
    return r.select("doc_id", "m.ent", big(F.col("i") + 1).alias("rank"))


@query("j01_filer_links", """SELECT o_orderkey, o_custkey AS cik FROM orders JOIN customer ON ltrim(lpad(CAST(o_custkey AS VARCHAR), 10, '0'), '0') = CAST(c_custkey AS VARCHAR)""")
def j01(spark, sf):
    """Filings x filers on the id without leading zeros."""
    o = corpus.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.ltrim(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("0")).alias("k"))
    c = corpus.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    return o.join(c, "k").select("o_orderkey", F.col("o_custkey").alias("cik"))


@query("j02_cashtag_links", f"""WITH {FEED}, t AS (SELECT doc_id, source_type, upper(unnest(regexp_extract_all(text || ' $than and $THON', '\\$([A-Za-z]{{1,5}})\\b', 1))) AS tag FROM feed_text)
SELECT doc_id, ent, count(*) AS hits FROM t JOIN (VALUES ('THAN', 'THANEA'), ('THON', 'THON'), ('ANEA', 'ANEA'), ('EREN', 'EREN')) m(tag, ent) USING (tag) GROUP BY doc_id, ent""")
def j02(spark, sf):
    """Cashtags of all documents (a fixed tail is appended) through the linker."""
    f = feed_text(spark, sf).select("doc_id", F.concat("text", F.lit(" $than and $THON")).alias("text"), "title")
    h = raw_hits(f, mentions.Linker(corpus.ENTITIES, DIMS)).select("doc_id", F.explode("hits").alias("h"))
    return h.filter("h.kind = 'cashtag'").groupBy("doc_id", "h.ent").agg(F.count("*").alias("hits"))


@query("j01_customer_filings", """WITH d AS (SELECT o_orderkey, o_custkey, 'Report of ' || c_name || ' and ' || lower(s_name) || 'x' AS text FROM orders JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = o_orderkey % (SELECT count(*) FROM supplier))
SELECT o_orderkey, c_name AS ent, 'filer' AS kind, 0::BIGINT AS s FROM d JOIN customer ON c_custkey = o_custkey UNION ALL SELECT o_orderkey, c_name, 'alias', 10 FROM d JOIN customer ON c_custkey = o_custkey""")
def j01c(spark, sf):
    """Filings through the linker, with every customer and supplier as a filer of the universe: by number and by name."""
    t = lambda name: corpus.table(spark, sf, name)
    # the universe grows with its tables, so names and texts meet by a join
    none = F.array().cast("array<string>")
    rows = t("customer").select(F.col("c_name").alias("n"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik")).unionByName(
        t("supplier").select(F.col("s_name").alias("n"), F.lit(None).cast("string").alias("cik")))
    lk = mentions.Linker(rows.select(F.col("n").alias("entity_id"), F.array("n").alias("aliases"), none.alias("ambiguous_aliases"), none.alias("cashtags"), "cik"), DIMS)
    n = t("supplier").agg(F.count("*").alias("suppliers"))   # one row
    o = t("orders").join(F.broadcast(n)).withColumn("k", F.col("o_orderkey") % F.col("suppliers"))
    d = o.join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier"), F.col("s_suppkey") == F.col("k"))
    d = d.select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.concat(F.lit("Report of "), "c_name", F.lit(" and "), F.lower("s_name"), F.lit("x")).alias("text"))
    h = lk.hit_rows(d, ["o_orderkey"], F.col("text"), F.lit("Report"), F.lit("filing"), F.col("cik"))
    return h.select("o_orderkey", "ent", "kind", big("s").alias("s"))


# ------------------------------------------------------------------ sentiment
def in_list(ws, t):
    return f"list_contains({words(ws)}, {t})" if ws else "false"


LEX_SQL = f"""lt AS (SELECT doc_id, key_text AS t, regexp_extract_all(lower(key_text), '[a-z][a-z''-]*') AS k FROM feed_text),
ls AS (SELECT doc_id, list_transform(k, lambda x, i: CASE WHEN {in_list(corpus.CORPUS_POSITIVE, 'x')} THEN 1.0 WHEN {in_list(corpus.CORPUS_NEGATIVE + corpus.CORPUS_STRONG, 'x')} THEN -1.0 ELSE 0.0 END
  * CASE WHEN {in_list(corpus.CORPUS_STRONG, 'x')} THEN 2.0 ELSE 1.0 END * CASE WHEN i > 1 AND list_has_any(k[greatest(i-2, 1):i-1], {words(corpus.CORPUS_INTENSIFIERS)}) THEN 1.5 ELSE 1.0 END
  * CASE WHEN i > 1 AND list_has_any(k[greatest(i-3, 1):i-1], {words(corpus.CORPUS_NEGATORS)}) THEN -1.0 ELSE 1.0 END) AS v FROM lt),
lp AS (SELECT doc_id, coalesce(list_sum(list_transform(v, lambda x: greatest(x, 0.0))), 0.0) AS pos, coalesce(list_sum(list_transform(v, lambda x: greatest(-x, 0.0))), 0.0) AS neg FROM ls),
lex AS (SELECT doc_id, CASE WHEN pos + neg = 0 THEN 0.1 ELSE 0.5 * 0.95 * least(1.0, (pos + neg) / 3.0) * (1 - (pos - neg) / (pos + neg)) END AS p_neg,
  CASE WHEN pos + neg = 0 THEN 0.1 ELSE 0.5 * 0.95 * least(1.0, (pos + neg) / 3.0) * (1 + (pos - neg) / (pos + neg)) END AS p_pos FROM lp)"""


@query("f16_lexicon", f"WITH {FEED}, {LEX_SQL} SELECT doc_id, round(p_neg, 6) AS neg, round(1.0 - p_neg - p_pos, 6) AS neu, round(p_pos, 6) AS pos FROM lex")
def f16(spark, sf):
    """Lexicon probabilities of the story key text."""
    f = spread(feed_text(spark, sf)).select("doc_id", tx.lexicon_probs(F.col("key_text"), DIMS).alias("p"))
    return f.select("doc_id", r6("p.neg").alias("neg"), r6("p.neu").alias("neu"), r6("p.pos").alias("pos"))


@query("f17_confidence", f"""WITH {FEED}, {LEX_SQL} SELECT doc_id, round(greatest(0.0, least(1.0, 1.0 + (CASE WHEN p_neg > 0 THEN p_neg * ln(p_neg) ELSE 0 END + CASE WHEN p_pos > 0 THEN p_pos * ln(p_pos) ELSE 0 END
  + CASE WHEN 1.0 - p_neg - p_pos > 0 THEN (1.0 - p_neg - p_pos) * ln(1.0 - p_neg - p_pos) ELSE 0 END) / ln(3.0))), 6) AS conf FROM lex""")
def f17(spark, sf):
    f = spread(feed_text(spark, sf)).select("doc_id", tx.lexicon_probs(F.col("key_text"), DIMS).alias("p"))
    return f.select("doc_id", r6(tx.entropy_confidence(F.col("p"))).alias("conf"))


@query("f43_signs", f"WITH {FEED}, {LEX_SQL} SELECT CASE WHEN abs(p_pos - p_neg) < 0.1 THEN 0 WHEN p_pos > p_neg THEN 1 ELSE -1 END::BIGINT AS sign, count(*) AS n FROM lex GROUP BY 1")
def f43(spark, sf):
    f = spread(feed_text(spark, sf)).select(tx.lexicon_probs(F.col("key_text"), DIMS).alias("p"))
    return f.groupBy(big(risk.sign_of(F.col("p.pos") - F.col("p.neg"))).alias("sign")).agg(F.count("*").alias("n"))


def mention_rows(spark, sf):
    return staged(spark, sf, "mentions", lambda: mentions.document_mentions(feed(spark, sf), corpus.ENTITIES, DIMS))


@query("m01_document_drafts")
def m01(spark, sf):
    """The narrow front half of the pipeline: labels, links, windows, sentiment, source checks per (document, entity)."""
    m = mention_rows(spark, sf)
    return m.select("doc_id", "entity_id", F.col("label.primary").alias("event"), "relevance", r6("ned").alias("ned"), r6("sentiment").alias("sentiment"),
                    r6("sent_conf").alias("sent_conf"), "credibility", big(F.size("windows")).alias("windows"), big(F.col("denial").cast("int")).alias("denial"))


@query("a04_window_means", f"""WITH {FEED}, {HITS_SQL}, {MENTION_SQL}, {LABEL_SQL},
 fb AS (SELECT 'MACRO:MARKET' AS ent, label.doc_id FROM label WHERE cls IN ('MACROECONOMIC', 'GEOPOLITICAL') AND conf >= 0.5 AND doc_id NOT IN (SELECT doc_id FROM mention))
SELECT doc_id, ent AS entity_id FROM mention UNION ALL SELECT doc_id, ent FROM fb""")
def a04(spark, sf):
    """(document, entity) rows that carry a sentiment, macro fallback included."""
    return mention_rows(spark, sf).select("doc_id", "entity_id")


@query("p18_evidence_contract", "SELECT CAST(0 AS BIGINT) AS broken")
def p18(spark, sf):
    """Audit: evidence spans that are not a substring of their document or exceed 280 characters."""
    m = mention_rows(spark, sf).select("doc_id", "span")
    t = feed_text(spark, sf).select("doc_id", "text")
    return m.join(t, "doc_id").agg(F.sum((~F.col("text").contains(F.col("span")) | (F.length("span") > 280)).cast("bigint")).alias("broken"))


@query("f18_windows")
def f18(spark, sf):
    """Sentence and clause windows per mention."""
    m = mention_rows(spark, sf)
    return m.select("doc_id", "entity_id", F.posexplode("windows").alias("i", "w")).select("doc_id", "entity_id", big("i").alias("i"), big("w.s").alias("s"), big("w.e").alias("e"))


@query("f19_masked_text", f"""WITH {FEED}, w AS (SELECT doc_id, title, list_filter(regexp_extract_all(lower(title), '[a-z]+'), lambda w: length(w) > 3) AS ws FROM feed WHERE title <> ''),
 o AS (SELECT *, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS f1 FROM w), q AS (SELECT *, f1[1] AS a, f1[len(f1)] AS z FROM o WHERE len(f1) >= 2),
 d AS (SELECT *, regexp_replace(title, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') AS dd FROM q), p AS (SELECT doc_id, a AS entity, z AS other, dd FROM d UNION ALL SELECT doc_id, z, a, dd FROM d),
 k AS (SELECT *, list_transform(regexp_extract_all(dd, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]'), lambda t: t) AS tt, len(list_filter(regexp_extract_all(lower(dd), '[\\p{{L}}\\p{{N}}_]+'), lambda t: t = entity)) AS hits FROM p)
SELECT doc_id, entity, hits AS targets FROM k WHERE hits > 0""")
def f19(spark, sf):
    """Target masking: the number of TGT marks equals the whole-word hits of the target."""
    p = ref.labelled_pairs(labelled_rows(spark, sf)).withColumn("masked", train.mask(F.col("title"), F.col("target"), F.col("others")))
    return p.select("doc_id", "entity", big(F.regexp_count("masked", F.lit(r"\bTGT\b"))).alias("targets"))


# ------------------------------------------------------------------ classification scorecards on labelled data
@query("a25_class_scores", f"""WITH {FEED}, {LEX_SQL}, g AS (SELECT 'doc_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS doc_id, quality FROM labels),
 x AS (SELECT CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS y, CASE WHEN abs(p_pos - p_neg) < 0.1 THEN 'neutral' WHEN p_pos > p_neg THEN 'positive' ELSE 'negative' END AS p FROM g JOIN lex USING (doc_id)),
 l AS (SELECT y AS label FROM x UNION SELECT p FROM x), f AS (SELECT label, (SELECT count(*) FROM x WHERE y = label AND p = label) AS tp, (SELECT count(*) FROM x WHERE y <> label AND p = label) AS fp, (SELECT count(*) FROM x WHERE y = label AND p <> label) AS fn FROM l)
SELECT round((SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) FROM x), 6) AS accuracy, round(avg(CASE WHEN 2*tp+fp+fn > 0 THEN 2.0*tp/(2*tp+fp+fn) ELSE 0 END), 6) AS macro_f1, (SELECT count(*) FROM x) AS n FROM f""")
def a25(spark, sf):
    """Accuracy and macro-F1 of the lexicon against the quality labels."""
    g = corpus.table(spark, sf, "labels").select(F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("doc_id"),
                                                 F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("y"))
    f = spread(feed_text(spark, sf)).select("doc_id", tx.lexicon_probs(F.col("key_text"), DIMS).alias("p")).withColumn("s", F.col("p.pos") - F.col("p.neg"))
    p = f.select("doc_id", F.when(F.abs("s") < 0.1, "neutral").when(F.col("s") > 0, "positive").otherwise("negative").alias("p"))
    s = evaluate.classification_scores(g.join(p, "doc_id"), [], "y", "p")
    return s.select(r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"), big("n").alias("n"))


@query("a26_label_mix", f"WITH {FEED}, {LABEL_SQL} SELECT source_type, cls, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source_type), 6) AS share FROM label GROUP BY source_type, cls")
def a26(spark, sf):
    m = evaluate.label_mix(labelled(spark, sf).withColumn("cls", F.col("label.primary")), ["source_type"], "cls")
    return m.select("source_type", "cls", "n", r6("share").alias("share"))


@query("a27_link_scores", f"""WITH {FEED}, {HITS_SQL}, {MENTION_SQL}, p AS (SELECT DISTINCT doc_id, ent FROM mention WHERE NOT starts_with(ent, 'MACRO')), g AS (SELECT DISTINCT doc_id, ent FROM h0 WHERE kind = 'alias' AND NOT starts_with(ent, 'MACRO'))
SELECT count(*) FILTER (WHERE g.ent IS NOT NULL AND p.ent IS NOT NULL) AS tp, count(*) FILTER (WHERE g.ent IS NULL) AS fp, count(*) FILTER (WHERE p.ent IS NULL) AS fn,
  round(count(*) FILTER (WHERE g.ent IS NOT NULL AND p.ent IS NOT NULL) / greatest(1, count(*) FILTER (WHERE p.ent IS NOT NULL)), 6) AS precision,
  round(count(*) FILTER (WHERE g.ent IS NOT NULL AND p.ent IS NOT NULL) / greatest(1, count(*) FILTER (WHERE g.ent IS NOT NULL)), 6) AS recall FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.ent = p.ent""")
def a27(spark, sf):
    """Linker output against plain alias hits (micro precision and recall; U02)."""
    d = spread(feed_text(spark, sf))
    lk = mentions.Linker(corpus.ENTITIES, DIMS)
    company = ~F.col("entity_id").startswith("MACRO")
    pred = lk.link(d).select("doc_id", F.explode_outer("mentions.ent").alias("entity_id")).filter("entity_id is not null").filter(company)
    gold = raw_hits(d, lk).select("doc_id", F.explode_outer("hits").alias("h")).filter(
        F.col("h.kind") == "alias").select("doc_id", F.col("h.ent").alias("entity_id")).filter(company)
    s = evaluate.pair_scores(gold, pred, ["doc_id", "entity_id"])
    return s.select("tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("a27_alias_baseline", f"WITH {FEED} SELECT doc_id, ent AS entity_id FROM feed_text, (VALUES " + ", ".join(
    f"('{e.entity_id}', {words([a.lower() for a in (*e.aliases, *e.ambiguous_aliases)])})" for e in corpus.ENTITIES if e.entity_type == "company") + ") b(ent, al) WHERE len(list_filter(al, lambda a: contains(lower(text), a))) > 0")
def a27b(spark, sf):
    return evaluate.alias_baseline(spread(feed_text(spark, sf)), list(corpus.ENTITIES))


@query("u02_pair_sets", f"""WITH {FEED}, {HITS_SQL}, {MENTION_SQL}, p AS (SELECT DISTINCT doc_id, ent FROM mention), g AS (SELECT DISTINCT doc_id, ent FROM h0)
SELECT (SELECT count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM p)) AS both_sets, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM p)) AS dropped""")
def u02(spark, sf):
    """Intersect and except of (document, entity) sets."""
    d = spread(feed_text(spark, sf))
    lk = mentions.Linker(corpus.ENTITIES, DIMS)
    pred = lk.link(d).select("doc_id", F.explode_outer("mentions.ent").alias("ent")).filter("ent is not null")
    raw = raw_hits(d, lk).select("doc_id", F.explode_outer("hits").alias("h")).filter("h is not null").select("doc_id", "h.ent")
    both = raw.intersect(pred).agg(F.count("*").alias("both_sets"))
    gone = raw.distinct().exceptAll(pred.distinct()).agg(F.count("*").alias("dropped"))
    return both.join(F.broadcast(gone))


@query("u01_feed_union", f"WITH {FEED} SELECT src, count(*) AS n FROM (SELECT 'feed' AS src FROM feed UNION ALL SELECT 'pages' FROM pages UNION ALL SELECT 'posts' FROM conversations) GROUP BY src")
def u01(spark, sf):
    a = feed(spark, sf).select(F.lit("feed").alias("src"))
    b = corpus.table(spark, sf, "pages").select(F.lit("pages").alias("src"), "url")
    c = corpus.table(spark, sf, "conversations").select(F.lit("posts").alias("src"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True).groupBy("src").agg(F.count("*").alias("n"))


@query("k08_earliest_per_url", "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, arg_min(page_id, (length(url), page_id)) AS page_id FROM pages GROUP BY 1")
def k08(spark, sf):
    """First row per key."""
    p = corpus.table(spark, sf, "pages").withColumn("host", F.regexp_extract("url", "://([^/?#]*)", 1))
    return p.groupBy("host").agg(F.min_by("page_id", F.struct(F.length("url"), "page_id")).alias("page_id"))


# pairs of the held-out fifth of the headlines, as the split by content hash deals them
PAIR_SQL = f"""w AS (SELECT doc_id, n, title, list_filter(regexp_extract_all(lower(title), '[a-z]+'), lambda w: length(w) > 3) AS ws FROM feed WHERE title <> ''),
 q AS (SELECT *, ws[1] AS a, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS firsts FROM w WHERE len(list_distinct(ws)) >= 2),
 pairs AS (SELECT doc_id, title, a AS entity, n % 3 AS l, n % 3 <> (n // 3) % 3 AS conflict FROM q UNION ALL SELECT doc_id, title, firsts[len(firsts)], (n // 3) % 3, n % 3 <> (n // 3) % 3 FROM q),
 held AS (SELECT doc_id, entity, ['negative', 'neutral', 'positive'][CAST(l + 1 AS INTEGER)] AS label, conflict FROM pairs
  WHERE len(list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+'), lambda t: t = entity)) > 0 AND CAST('0x' || substr(md5(doc_id), 1, 8) AS BIGINT) % 5 = 0)"""
SLICE_SQL = "sl AS (SELECT *, unnest(['all', 'multi'] || CASE WHEN conflict THEN ['conflicting'] ELSE [] END) AS slice FROM held)"


def target_pairs(spark, sf):
    """Labelled (headline, entity) pairs with their fold: 0 is held out."""
    pairs = ref.labelled_pairs(labelled_rows(spark, sf)).select(
        F.concat_ws("|", "doc_id", "entity").alias("row_id"), F.col("doc_id").alias("group"), F.col("title").alias("text"), "target", "others", "label", "n_entities", "conflict")
    return staged(spark, sf, "target_pairs", lambda: pairs.withColumn("fold", train.fold_of(F.col("group"))))


def target_rows(spark, sf):
    return staged(spark, sf, "target_rows", lambda: train.with_features(target_pairs(spark, sf), DIMS))


def target_model(spark, sf):
    """The masked model of the training folds, as the mention stage uses it."""
    return staged(spark, sf, "target_model", lambda: train.fit(target_rows(spark, sf).filter("fold <> 0"), 8.0))


@query("m18_target_training")
def m18(spark, sf):
    """Train the masked-target classifier on the labelled pairs (grouped split) and score the held-out part."""
    got = train.predict(target_rows(spark, sf).filter("fold = 0"), target_model(spark, sf))
    s = evaluate.classification_scores(train.slices(got), ["slice"], "label", "predicted")
    return s.select("slice", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"), big("n").alias("n"))


@query("m18_choose_c")
def m18c(spark, sf):
    """Grouped five-fold cross-validation on the training headlines: macro-F1 per C, and the C taken."""
    scores = staged(spark, sf, "c_scores", lambda: train.choose_c(target_rows(spark, sf).filter("fold <> 0")))
    best = train.best_c(scores)
    return spark.createDataFrame([(c, round(f, 6), int(c == best)) for c, f in scores], "c double, macro_f1 double, chosen bigint")


@query("m18_four_systems")
def m18f(spark, sf):
    """Lexicon over the text and over windows, trained without and with masking (C by cross-validation), by slice."""
    pairs = target_pairs(spark, sf)
    scores = staged(spark, sf, "c_scores", lambda: train.choose_c(target_rows(spark, sf).filter("fold <> 0")))
    r = train.report(pairs.filter("fold <> 0"), pairs.filter("fold = 0"), DIMS, train.best_c(scores))
    return r.select("system", "slice", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"), big("n").alias("n"))


@query("m18_slices", f"WITH {FEED}, {PAIR_SQL}, {SLICE_SQL} SELECT slice, label, count(*) AS n FROM sl GROUP BY slice, label")
def m18s(spark, sf):
    """Label mix of the held-out pairs by slice."""
    return train.slices(target_pairs(spark, sf).filter("fold = 0")).groupBy("slice", "label").agg(F.count("*").alias("n"))


@query("m18_lexicon_whole", f"""WITH {FEED}, {LEX_SQL}, {PAIR_SQL}, {SLICE_SQL},
 g AS (SELECT slice, label, CASE WHEN abs(p_pos - p_neg) < 0.1 THEN 'neutral' WHEN p_pos > p_neg THEN 'positive' ELSE 'negative' END AS said FROM sl JOIN lex USING (doc_id)),
 k AS (SELECT DISTINCT slice, label AS c FROM g UNION SELECT DISTINCT slice, said FROM g),
 f AS (SELECT k.slice, c, 2.0 * count(*) FILTER (WHERE label = c AND said = c) / (2 * count(*) FILTER (WHERE label = c AND said = c) + count(*) FILTER (WHERE label <> c AND said = c) + count(*) FILTER (WHERE label = c AND said <> c)) AS f1 FROM k JOIN g ON g.slice = k.slice GROUP BY k.slice, c)
SELECT slice, round(avg(CAST(label = said AS INTEGER)), 6) AS accuracy, any_value(m) AS macro_f1, count(*) AS n FROM g JOIN (SELECT slice, round(avg(f1), 6) AS m FROM f GROUP BY slice) USING (slice) GROUP BY slice""")
def m18l(spark, sf):
    """The naive system of the report by slice: the lexicon over the whole headline."""
    rows = train.slices(train.lexicon_systems(target_pairs(spark, sf).filter("fold = 0"), DIMS))
    s = evaluate.classification_scores(rows, ["slice"], "label", "whole")
    return s.select("slice", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"), "n")


def trained_mentions(spark, sf):
    """The mention stage with the trained model as its scorer."""
    def build():
        scorer = train.TargetScorer(train.weights(target_model(spark, sf)), DIMS)
        return mentions.document_mentions(feed(spark, sf), corpus.ENTITIES, DIMS, scorer=scorer)
    return staged(spark, sf, "trained_mentions", build)


@query("m19_trained_mentions")
def m19(spark, sf):
    """(document, entity) sentiment by the fitted target-aware model inside the mention stage."""
    m = trained_mentions(spark, sf)
    return m.select("doc_id", "entity_id", r6("probs.neg").alias("neg"), r6("probs.neu").alias("neu"), r6("probs.pos").alias("pos"), r6("sentiment").alias("sentiment"), r6("sent_conf").alias("sent_conf"),
                    big(F.size("windows")).alias("windows"))
