"""Driver tables -> model inputs.

The tables hold invented prose and a star schema, so the columns the model needs (event time,
publisher, author, title, trades, prices) are derived row by row with fixed rules. The
dimensions below play the role of the finance dimensions for that prose.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.dims.text_rules import FILING_ITEMS, TextDims
from riskloom.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# ---- dimensions of the test prose -------------------------------------------------------------
PUBLISHER_OF_SOURCE = (
    "reuters.com", "www.wsj.com", "marketwatch.com", "barrons.com", "markets.ft.com", "cnbc.com", "bloomberg-news.co",
    "finance.yahoo.com", "livemint.com", "hindustantimes.com", "moneycontrol.com", "cnbctv18.com", "bbc.co.uk",
    "bbc.com", "axios.com", "local-paper.example", "wire-one.example", "street-journal.example",
    "street-journal-markets.example", "tech-ledger.example",
)
CORPUS_RULES = (
    ("CREDIT_EVENT", "BANK_RUN", 3.0, ("antion", "retion")),
    ("CREDIT_EVENT", "LIQUIDITY_STRESS", 2.0, ("onst",)),
    ("GEOPOLITICAL", "SANCTIONS", 2.5, ("erti",)),
    ("MACROECONOMIC", "MONETARY_POLICY", 2.5, ("onha", "reou")),
    ("EARNINGS_GUIDANCE", "RESULTS", 2.0, ("oned", "oner")),
    ("PRODUCT_STRATEGY", "COMPETITIVE_THREAT", 2.0, ("anin",)),
    ("LEGAL_REGULATORY", "LITIGATION", 2.0, ("reen",)),
    ("OPERATIONAL_ESG", "OUTAGE_ACCIDENT", 2.5, ("erou", "keit")),
    ("MANAGEMENT_GOVERNANCE", "FRAUD_ALLEGATION", 3.0, ("anre",)),
    ("MA_CORPORATE_ACTION", "IPO", 2.0, ("onti", "elle")),
)
CORPUS_POSITIVE = ("ering", "onth", "thing", "then", "eau")
CORPUS_NEGATIVE = ("thnt", "erth", "ered", "ther", "que")
CORPUS_STRONG = ("erth",)
CORPUS_INTENSIFIERS = ("thes", "les")
CORPUS_NEGATORS = ("with", "pas")
CORPUS_CONTEXT = ("onre", "enat", "ingor", "erin", "eron", "ertion")
CORPUS_DENIALS = ("erble", "under")
DIMS = TextDims(
    rules=tuple((c, s, w, r"\b(?:" + "|".join(words) + r")\b") for c, s, w, words in CORPUS_RULES),
    positive=frozenset(CORPUS_POSITIVE), negative=frozenset(CORPUS_NEGATIVE),
    strong_positive=frozenset(), strong_negative=frozenset(CORPUS_STRONG), question=frozenset(),
    intensifiers=frozenset(CORPUS_INTENSIFIERS), negators=frozenset(CORPUS_NEGATORS),
    context=frozenset(CORPUS_CONTEXT), denial=r"\b(?:" + "|".join(CORPUS_DENIALS) + r")\b",
)


@dataclass(frozen=True)
class Entity:
    entity_id: str
    entity_type: str
    name: str
    aliases: tuple[str, ...] = ()
    ambiguous_aliases: tuple[str, ...] = ()
    cik: str | None = None
    sector: str | None = None
    cashtags: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    index_name: str | None = None
    group: str = ""


ENTITIES = (
    Entity("THON", "company", "Thon Holdings", ("thon", "thth"), (), "0000000011", "Financials", ("THON",), ("bbc.com", "axios.com"), "US"),
    Entity("THANEA", "company", "Thanea", ("thanea",), (), "0000000012", "Energy", ("THAN",), ("thanea.example",), "US"),
    Entity("ERINER", "company", "Eriner Thanea", ("eriner thanea",), (), None, "Energy", (), (), "US", "Eriner"),
    Entity("ATTION", "company", "Attion", ("and attion", "attion to"), (), None, "Industrials", (), (), "US"),
    Entity("ANEA", "company", "Anea", ("anea", "the anea"), (), "0000000016", "Materials", ("ANEA",), (), "US"),
    Entity("THERHEAN", "company", "Therhean", ("therhean",), (), None, "Utilities", (), ("livemint.com",), "IN"),
    Entity("ONBLEEA", "company", "Onbleea", ("in onbleea", "onbleea"), (), None, "Financials", (), (), "IN"),
    Entity("EREN", "company", "Eren", ("Eren", "Anon"), (), None, "Financials", ("EREN",), (), None),
    Entity("REOU", "company", "Reon", (), ("reon", "anou"), None, "Health Care", (), (), None),
    Entity("THLY", "company", "Thly", ("thlys",), ("Thly",), None, "Real Estate", (), (), None),
    Entity("ELLE", "company", "Elle", ("elle",), (), None, "Consumer Staples", (), (), "IN"),
    Entity("LICH", "company", "Lich", ("lich", "der ung"), (), None, "Consumer Discretionary", (), (), None),
    Entity("DOCI", "company", "Doci", ("doci", "nado"), (), None, "Information Technology", (), (), None),
    Entity("MACRO:MARKET", "macro", "Equity market", ("onth the",)),
    Entity("MACRO:RATES", "macro", "Rates", ("than the", "thre")),
)

ACRONYMS = ("CH", "TH", "TION")

# ------------------------------------------------------------------ document feed
FEED_SQL = f"""
feed0 AS (
  SELECT doc_id AS n, text AS raw, lang, source, doc_id // 10 % 10 AS k FROM documents
), feed1 AS (
  SELECT *, CASE WHEN k < 6 THEN 'news' WHEN k < 9 THEN 'social' ELSE 'filing' END AS source_type FROM feed0
), feed2 AS (
  SELECT *, CASE WHEN source_type = 'social' THEN '' ELSE regexp_extract(raw, '^[^.!?\\n]+[.!?]*') END AS head FROM feed1
), feed AS (
  SELECT n, 'doc_' || lpad(CAST(n AS VARCHAR), 12, '0') AS doc_id, lang, source, source_type,
    CASE source_type WHEN 'filing' THEN 'sec.gov' WHEN 'social' THEN 'posts.example'
         ELSE [{", ".join(f"'{p}'" for p in PUBLISHER_OF_SOURCE)}][CAST(substr(source, 4) AS INTEGER) % 20 + 1] END AS publisher,
    CASE WHEN source_type = 'social' THEN CASE WHEN n % 211 = 0 THEN 'reuters_desk' ELSE 'acct_' || CAST(n % 37 AS VARCHAR) END END AS author,
    n * 60 AS t, trim(head, ' ') AS title,
    CASE WHEN source_type = 'social' THEN raw ELSE trim(substr(raw, length(head) + 1), ' ' || chr(10)) END AS body
  FROM feed2
), feed_text AS (
  SELECT *, CASE WHEN title <> '' AND body <> '' THEN title || chr(10) || body ELSE title || body END AS text,
    CASE WHEN title <> '' THEN title ELSE substr(body, 1, 300) END AS key_text
  FROM feed
)"""
EPOCH_2024 = 1704067200


def source_type_of(n: Column) -> Column:
    k = F.floor(n / 10) % 10
    return F.when(k < 6, "news").when(k < 9, "social").otherwise("filing")


def items_of(n: Column) -> Column:
    """Two filing item codes per filing; one filing in five carries none that is mapped."""
    codes = F.array(*[F.lit(i[0]) for i in FILING_ITEMS], F.lit("8.01"), F.lit("9.01"))
    size = len(FILING_ITEMS) + 2
    return F.array(F.element_at(codes, (n % size + 1).cast("int")), F.element_at(codes, (n % 5 + 13).cast("int")))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as the normalised document stream."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("n"), F.col("text").alias("raw"), F.col("lang").alias("language"), "source")
    d = d.withColumn("source_type", source_type_of(F.col("n")))
    head = F.when(F.col("source_type") == "social", "").otherwise(
        F.regexp_extract("raw", r"^[^.!?\n]+[.!?]*", 0))
    d = d.withColumn("head", head)
    outlets = F.array(*[F.lit(p) for p in PUBLISHER_OF_SOURCE])
    publisher = (
        F.when(F.col("source_type") == "filing", "sec.gov").when(F.col("source_type") == "social", "posts.example")
        .otherwise(F.element_at(outlets, F.substring("source", 4, 9).cast("int") % 20 + 1))
    )
    author = F.when(F.col("source_type") == "social", F.when(F.col("n") % 211 == 0, "reuters_desk").otherwise(
        F.concat(F.lit("acct_"), (F.col("n") % 37).cast("string"))))
    body = F.when(F.col("source_type") == "social", F.col("raw")).otherwise(
        F.btrim(F.substring("raw", F.length("head") + 1, F.length("raw")), F.lit(" \n")))
    return d.select(
        F.concat(F.lit("doc_"), F.lpad(F.col("n").cast("string"), 12, "0")).alias("doc_id"), "n", "source", "source_type",
        publisher.alias("publisher"), author.alias("author"),
        F.concat(F.lit("https://"), publisher, F.lit("/item/"), F.col("n").cast("string")).alias("url"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("n") * 60).alias("published_at"),
        F.btrim("head", F.lit(" ")).alias("title"), body.alias("body"), "language",
        F.when(F.col("source_type") == "filing", items_of(F.col("n"))).alias("items"),
        F.lit(None).cast("string").alias("cik"), F.lit(False).alias("official"),
    )


# ------------------------------------------------------------------ signal stream
EVENT_CLASSES = ("CREDIT_EVENT", "GEOPOLITICAL", "MACROECONOMIC", "PRODUCT_STRATEGY", "OTHER")
EVENT_SUBTYPES = ("BANK_RUN", "SANCTIONS", "INFLATION", "LAUNCH", None)
SIGNALS_SQL = """
sig0 AS (
  SELECT event_id AS seq, epoch(ts) AS t, ts, user_id, event_type, value, CAST(props->>'$.k' AS INTEGER) AS k,
    CASE event_type WHEN 'error' THEN 'CREDIT_EVENT' WHEN 'click' THEN 'GEOPOLITICAL' WHEN 'view' THEN 'MACROECONOMIC'
         WHEN 'signup' THEN 'PRODUCT_STRATEGY' ELSE 'OTHER' END AS cls,
    CASE event_type WHEN 'error' THEN 'BANK_RUN' WHEN 'click' THEN 'SANCTIONS' WHEN 'view' THEN 'INFLATION'
         WHEN 'signup' THEN 'LAUNCH' END AS subtype
  FROM events
), signals AS (
  SELECT seq, CAST(floor(t) AS BIGINT) AS t, 'sig_' || CAST(seq AS VARCHAR) AS signal_id,
    CASE WHEN seq % 4 = 0 THEN 'document' ELSE 'event' END AS grain,
    'U' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS entity_id, 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) AS ticker,
    'clu_' || CAST(user_id AS VARCHAR) || '_' || event_type AS cluster_id, cls, subtype,
    greatest(-1.0, least(1.0, (value - 50.0) / 50.0)) AS sentiment, 0.05 + (seq % 19) / 20.0 AS sent_conf,
    CASE WHEN k % 4 = 3 THEN k ELSE 60 + k % 41 END AS relevance, CASE WHEN k % 3 = 0 THEN 33 ELSE 100 END AS novelty,
    1 + (k + seq) % 10 AS impact, 0.4 + (seq % 13) / 20.0 AS event_conf, seq % 5 AS publishers, seq % 4 AS publishers_60m,
    k % 17 = 0 AS authoritative, (k + seq) % 23 = 0 AS retracted, seq % 3 AS social_authors,
    seq % 29 / 10.0 AS engine_ms
  FROM sig0
)"""


def signals(spark: SparkSession, sf_dir: str, frame: DataFrame | None = None) -> DataFrame:
    """``events`` as a stream of document and event signals (one story per user and type)."""
    e = frame if frame is not None else table(spark, sf_dir, "events")
    seq, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    kinds = {"error": 0, "click": 1, "view": 2, "signup": 3}

    def by_type(values: tuple) -> Column:
        out = F.when(F.col("event_type") == "error", F.lit(values[0]))
        for name, i in list(kinds.items())[1:]:
            out = out.when(F.col("event_type") == name, F.lit(values[i]))
        return out.otherwise(F.lit(values[4]))

    e = e.withColumn("k", k)
    k = F.col("k")
    return e.select(
        seq.alias("seq"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("as_of"),
        F.concat(F.lit("sig_"), seq.cast("string")).alias("signal_id"),
        F.when(seq % 4 == 0, "document").otherwise("event").alias("grain"),
        F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("entity_id"),
        F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("ticker"),
        F.concat(F.lit("clu_"), F.col("user_id").cast("string"), F.lit("_"), F.col("event_type")).alias("cluster_id"),
        by_type(EVENT_CLASSES).alias("event"), by_type(EVENT_SUBTYPES).alias("subtype"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50.0) / 50.0)).alias("sentiment"),
        (0.05 + (seq % 19) / 20.0).alias("sent_conf"),
        F.when(k % 4 == 3, k).otherwise(60 + k % 41).alias("relevance"),
        F.when(k % 3 == 0, 33).otherwise(100).alias("novelty"), (1 + (k + seq) % 10).cast("int").alias("impact"),
        (0.4 + (seq % 13) / 20.0).alias("event_conf"), (seq % 5).cast("int").alias("publishers"),
        (seq % 4).cast("int").alias("publishers_60m"), (k % 17 == 0).alias("authoritative"),
        F.when((k + seq) % 23 == 0, "retracted").otherwise("active").alias("status"),
        (seq % 3).cast("int").alias("social_authors"), (seq % 29 / 10.0).alias("engine_ms"),
    )


# ------------------------------------------------------------------ market series
MARKET_SQL = """
li AS (SELECT CAST(l_shipdate AS DATE) AS date, l_partkey, l_linenumber, l_extendedprice AS p, l_discount AS d, l_quantity AS q FROM lineitem),
lp AS (SELECT li.*, p_brand, p_type FROM li JOIN part ON l_partkey = p_partkey),
px AS (SELECT date, p_brand AS series, round(sum(p), 2) AS value, round(sum(p * (1 - d)), 4) AS open FROM lp GROUP BY ALL
  UNION ALL SELECT date, 'TYPE_' || p_type, round(sum(p), 2), round(sum(p * (1 - d)), 4) FROM lp GROUP BY ALL
  UNION ALL SELECT date, 'MKT', round(sum(p), 2), round(sum(p * (1 - d)), 4) FROM li GROUP BY ALL
  UNION ALL SELECT date, 'RATE_' || CAST(l_linenumber AS VARCHAR), round(100 * sum(d) / count(*), 6), NULL FROM li GROUP BY ALL
  UNION ALL SELECT date, 'VIX', round(sum(q) / count(*), 6), NULL FROM li GROUP BY ALL)"""


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series in long form: value per brand, part type and in total, rate-like and volatility-like series."""
    d = table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"), "l_partkey", "l_linenumber", F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"), F.col("l_quantity").alias("q"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    one = d.join(part, "l_partkey").withColumn("net", F.col("p") * (1 - F.col("d")))
    names = F.array(F.col("p_brand"), F.concat(F.lit("TYPE_"), "p_type"), F.lit("MKT"))
    priced = one.select("date", "p", "net", F.explode(names).alias("series")).groupBy("date", "series").agg(
        F.round(F.sum("p"), 2).alias("value"), F.round(F.sum("net"), 4).alias("open"))
    none = F.lit(None).cast("double").alias("open")
    rates = d.groupBy("date", F.concat(F.lit("RATE_"), F.col("l_linenumber").cast("string")).alias("series")).agg(
        F.round(100 * F.sum("d") / F.count("*"), 6).alias("value")).select("date", "series", "value", none)
    vix = d.groupBy("date").agg(F.round(F.sum("q") / F.count("*"), 6).alias("value")).select("date", F.lit("VIX").alias("series"), "value", none)
    return priced.unionByName(rates).unionByName(vix)


CORPUS_FACTORS = (
    ("EQ:MKT", "ret", (("MKT", 1.0),)), ("EQ:IT", "ret", (("Brand#1", 1.0), ("MKT", 1.0))), ("EQ:FIN", "ret", (("Brand#2", 1.0), ("MKT", 1.0))),
    ("EQ:IND", "ret", (("Brand#3", 1.0), ("MKT", 1.0))), ("EQ:CS", "ret", (("Brand#4", 1.0), ("MKT", 1.0))), ("EQ:CD", "ret", (("NONE", 1.0), ("TYPE_PROMO", 1.0))),
    ("EQ:MAT", "ret", (("TYPE_SMALL", 1.0),)), ("EQ:IN", "ret", (("TYPE_LARGE", 1.0),)), ("EQ:IN_BANKS", "ret", (("NONE", 1.0), ("TYPE_LARGE", 1.0))),
    ("IR:3M", "bp", (("RATE_1", 1.0),)), ("IR:2Y", "bp", (("RATE_2", 1.0),)), ("IR:5Y", "bp", (("RATE_3", 1.0),)), ("IR:10Y", "bp", (("RATE_4", 1.0),)),
    ("IR:30Y", "bp", (("NONE", 1.0), ("RATE_5", 0.5))), ("IR:IN10Y", "bp", (("RATE_5", 1.0),)), ("CR:IG", "bp", (("RATE_6", 1.0),)),
    ("CR:BBB", "bp", (("RATE_7", 1.0),)), ("CR:HY", "bp", (("NONE", 1.0), ("RATE_7", 3.0))), ("FX:USDINR", "ret", (("TYPE_MEDIUM", 1.0),)),
    ("FX:EURUSD", "ret", (("TYPE_STANDARD", 1.0),)), ("VOL:VIX", "pts", (("VIX", 1.0),)),
)
CORPUS_SCENARIOS = (
    ("russia_ukraine_2022", "invasion", "1996-02-18", "1996-03-08", (), "global"), ("tariff_2025", "tariff", "1999-04-02", "1999-04-08", (), "global"),
    ("svb_2023", "bank run", "1997-03-08", "1997-03-17", (), "global"), ("lehman_2008", "systemic", "1998-09-12", "1998-10-10", (), "global"),
    ("rate_shock_2022", "rates", "1996-06-09", "1996-06-16", (), "global"), ("covid_2020", "pandemic", "2000-02-19", "2000-03-23", (), "global"),
    ("deepseek_2025", "competitor", "1999-01-24", "1999-01-27", (), "global"), ("adani_2023", "governance", "1997-01-24", "1997-02-03", ("C000000022",), "india"),
)
BOOK_DATE = "2001-12-31"
STUDY_SPLITS = (("train", "1995-01-01", "1998-12-31"), ("valid", "1999-01-01", "1999-12-31"), ("test", "2000-01-01", "2000-12-31"), ("post", "2001-01-01", "2002-12-31"))


# ------------------------------------------------------------------ book
INSTRUMENTS = ("TERM_LOAN", "REVOLVER", "BOND", "IRS", "FX_FWD", "CDS", "EQ_OPTION", "EQUITY")
OBLIGOR_SQL = """
obl AS (SELECT 'C' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS obligor_id, CASE WHEN c_custkey % 10 = 3 THEN 'Financials' ELSE CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Consumer Discretionary' WHEN 'BUILDING' THEN 'Materials'
  WHEN 'MACHINERY' THEN 'Industrials' WHEN 'HOUSEHOLD' THEN 'Consumer Staples' ELSE 'Information Technology' END END AS sector, CASE WHEN c_nationkey % 5 = 0 THEN 'IN' ELSE 'US' END AS country,
  least(16, greatest(0, CAST(floor((c_acctbal + 1000) / 650) AS INTEGER))) AS notch, c_custkey % 10 = 3 AS bank, CASE WHEN c_custkey % 11 = 0 THEN 'G' || CAST(c_nationkey % 3 AS VARCHAR) ELSE '' END AS grp, c_custkey FROM customer),
obligors AS (SELECT *, greatest(0, notch - c_custkey % 4)::INTEGER AS orig_notch FROM obl)"""
TRADES_SQL = """
trades AS (SELECT 'F' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS facility_id, ['TERM_LOAN', 'REVOLVER', 'BOND', 'IRS', 'FX_FWD', 'CDS', 'EQ_OPTION', 'EQUITY'][o_orderkey % 8 + 1] AS inst,
  CAST(l_shipdate AS DATE) AS trade_date, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 4, '0') || '-' || lpad(CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR), 3, '0') AS trade_id,
  'C' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS cust, o_custkey, o_orderkey, l_returnflag AS rf, l_linestatus AS ls, l_linenumber AS ln, l_extendedprice AS notional, l_discount AS d,
  DATE '2001-12-31' + CAST(o_orderkey % 3650 + 30 AS INTEGER) AS maturity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def obligors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    segment = F.create_map(*[F.lit(x) for kv in (("AUTOMOBILE", "Consumer Discretionary"), ("BUILDING", "Materials"), ("MACHINERY", "Industrials"), ("HOUSEHOLD", "Consumer Staples")) for x in kv])
    notch = F.least(F.lit(16), F.greatest(F.lit(0), F.floor((F.col("c_acctbal") + 1000) / 650).cast("int")))
    return c.select(
        F.concat(F.lit("C"), F.lpad(k.cast("string"), 9, "0")).alias("obligor_id"), F.col("c_name").alias("name"),
        F.when(k % 10 == 3, "Financials").otherwise(F.coalesce(F.try_element_at(segment, F.col("c_mktsegment")), F.lit("Information Technology"))).alias("sector"),
        F.when(F.col("c_nationkey") % 5 == 0, "IN").otherwise("US").alias("country"), notch.alias("notch"),
        F.greatest(F.lit(0), notch - (k % 4).cast("int")).alias("orig_notch"), (k % 10 == 3).alias("bank"),
        F.when(k % 11 == 0, F.concat(F.lit("G"), (F.col("c_nationkey") % 3).cast("string"))).otherwise("").alias("group"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` + ``orders`` as a trade blotter: an order is a facility, its lines are trades."""
    l = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    cust, rf, d = F.col("o_custkey"), F.col("l_returnflag"), F.col("l_discount")
    j = j.withColumn("instrument", F.element_at(F.array(*[F.lit(i) for i in INSTRUMENTS]), (F.col("o_orderkey") % 8 + 1).cast("int")))
    inst = F.col("instrument")
    name = F.concat(F.lit("C"), F.lpad(cust.cast("string"), 9, "0"))
    party = F.when((inst == "BOND") & (cust % 9 == 0), "UST").when((inst == "BOND") & (cust % 9 == 1), "GSEC").otherwise(name)
    direction = (
        F.when(inst.isin("TERM_LOAN", "REVOLVER"), F.when(rf == "A", "COMMIT").when(rf == "N", "DRAW").otherwise("REPAY"))
        .when(inst == "BOND", F.when(rf == "R", "SELL").otherwise("BUY")).when(inst == "IRS", F.when(rf == "A", "RECEIVE_FIXED").otherwise("PAY_FIXED"))
        .when(inst == "FX_FWD", F.when(rf == "N", "BUY_USD").otherwise("SELL_USD")).when(inst == "CDS", F.when(rf == "A", "BUY_PROTECTION").otherwise("SELL_PROTECTION"))
        .when(inst == "EQ_OPTION", F.when(rf == "R", "SHORT").otherwise("LONG")).otherwise("LONG"))
    rate = F.when(inst == "EQ_OPTION", 0.8 + d * 4).when(inst == "CDS", 0.005 + d / 10).otherwise(0.01 + d)
    extra = (
        F.when(inst == "FX_FWD", F.when(cust % 2 == 1, "pair=USDINR").otherwise("pair=EURUSD")).when(inst == "CDS", F.concat(F.lit("reference="), name))
        .when(inst == "EQ_OPTION", F.when(cust % 2 == 1, "underlying=EQ:IT;type=CALL").otherwise("underlying=EQ:MKT;type=PUT")))
    pad = lambda c, n: F.lpad(F.col(c).cast("bigint").cast("string"), n, "0")
    return j.select(
        F.concat(F.lit("F"), pad("l_orderkey", 12)).alias("facility_id"), "instrument", F.to_date("l_shipdate").alias("trade_date"),
        F.concat_ws("-", pad("l_linenumber", 2), pad("l_partkey", 12), pad("l_suppkey", 12), pad("l_quantity", 4), F.lpad(F.round(d * 100).cast("int").cast("string"), 3, "0")).alias("trade_id"),
        party.alias("counterparty"), direction.alias("direction"), F.col("l_extendedprice").alias("notional"), rate.alias("rate"),
        F.date_add(F.to_date(F.lit(BOOK_DATE)), (F.col("o_orderkey") % 3650 + 30).cast("int")).alias("maturity"),
        F.when(F.col("l_linestatus") == "F", "SECURED").when(F.col("l_linenumber") % 2 == 1, "SENIOR_UNSECURED").otherwise("SUBORDINATED").alias("collateral"),
        F.when(party == "UST", "USD").when((party == "GSEC") | (cust % 5 == 0), "INR").otherwise("USD").alias("currency"), extra.alias("extra"))
