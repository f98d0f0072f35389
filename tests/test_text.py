"""Labels, links, windows and sentiment on literal finance headlines."""

from datetime import datetime

from pyspark.sql import functions as F

from riskloom.corpus import Entity
from riskloom.dims.text_rules import FINANCE
from riskloom.functions import text as tx
from riskloom.operators import mentions, train

UNIVERSE = (
    Entity("AAPL", "company", "Apple Inc.", ("Apple Inc", "iPhone"), ("Apple",), "0000320193", "Information Technology", ("AAPL",), ("apple.com",)),
    Entity("MSFT", "company", "Microsoft", ("Microsoft",), (), None, "Information Technology", ("MSFT",)),
    Entity("GOOGL", "company", "Google", ("Google",), (), None, None, ("GOOGL",)),
    Entity("PORTS", "company", "Acme Ports", ("Acme Ports",)),
    Entity("ACME", "company", "Acme", ("Acme",)),
    Entity("MACRO:MARKET", "macro", "Market", ("Wall Street",)),
)


def docs(spark, *rows):
    data = [(f"d{i}", kind, pub, author, datetime(2024, 1, 1, 0, i), title, body, cik, items) for i, (kind, pub, author, title, body, cik, items) in enumerate(rows)]
    d = spark.createDataFrame(data, "doc_id string, source_type string, publisher string, author string, published_at timestamp, title string, body string, cik string, items array<string>")
    return d.withColumn("url", F.lit(None).cast("string"))


def run(spark, *rows):
    out = mentions.document_mentions(docs(spark, *rows), UNIVERSE, FINANCE).collect()
    return {(r["doc_id"], r["entity_id"]): r for r in out}


def news(title, body=""):
    return ("news", "reuters.com", None, title, body, None, None)


def test_two_companies_get_their_own_clause(spark):
    r = run(spark, news("Microsoft surges on strong results while Google plunges after weak outlook"))
    assert r["d0", "MSFT"]["sentiment"] > 0.3
    assert r["d0", "GOOGL"]["sentiment"] < -0.3


def test_ambiguous_names_need_context(spark):
    r = run(spark, news("An apple a day"), news("Apple pie recipe"), news("Apple shares jump after earnings"), news("Microsoft and Apple meet"))
    assert ("d0", "AAPL") not in r and ("d1", "AAPL") not in r
    assert r["d2", "AAPL"]["ned"] == 0.9
    assert r["d3", "AAPL"]["ned"] == 0.8


def test_longest_name_wins_and_strong_kinds(spark):
    r = run(spark, news("Acme Ports wins deal"), ("social", "x.example", "a1", "", "Buying $AAPL today, not $AAPLX", None, None),
            ("filing", "sec.gov", None, "Apple Inc. files 8-K: Item 2.02", "", "320193", ["2.02"]))
    assert ("d0", "PORTS") in r and ("d0", "ACME") not in r
    assert r["d1", "AAPL"]["kinds"] == ["cashtag"] and r["d1", "AAPL"]["relevance"] == 80
    f = r["d2", "AAPL"]
    assert f["relevance"] == 100 and f["authoritative"] and f["label"]["confidence"] == 0.95 and f["label"]["subtype"] == "RESULTS"


def test_macro_fallback_and_evidence(spark):
    r = run(spark, news("Tariffs and sanctions escalate as trade war fears grow", "Embargo talks continue."))
    row = r["d0", "MACRO:MARKET"]
    assert row["relevance"] == 50 and row["label"]["primary"] == "GEOPOLITICAL"


def test_event_rules(spark):
    d = mentions.with_text(docs(spark, news("Bank run fears: customers pull deposits"), news("CEO steps down after fraud report"), news("A quiet day")))
    from riskloom.operators.labels import with_label

    got = [(x["label"]["primary"], x["label"]["subtype"]) for x in with_label(d, FINANCE).orderBy("doc_id").collect()]
    assert got[0] == ("CREDIT_EVENT", "BANK_RUN")
    assert got[1][0] == "MANAGEMENT_GOVERNANCE"
    assert got[2] == ("OTHER", None)


def test_lexicon(spark):
    rows = ["Shares fell 17% in early trading", "profit not strong", "sharp losses", "nothing here", "stock down about 5 %", "up 3%"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", tx.lexicon_probs(F.col("t"), FINANCE).alias("p"))
    s = [round(r["p"]["pos"] - r["p"]["neg"], 4) for r in d.orderBy("i").collect()]
    assert s[0] == round(-0.95 * 2 / 3, 4)      # the move counts two, its verb is part of it
    assert s[1] < 0 and s[2] == round(-0.95 * 0.5, 4) and s[3] == 0
    assert s[4] < 0 < s[5]


def test_denials_need_authority(spark):
    txt = "Microsoft denies report of data breach; the claim is false"
    r = run(spark, news(txt), ("social", "x.example", "bob", "", txt, None, None), ("news", "reuters-news.co", None, txt, "", None, None))
    assert r["d0", "MSFT"]["denial"] and not r["d1", "MSFT"]["denial"] and not r["d2", "MSFT"]["denial"]
    assert r["d2", "MSFT"]["credibility"] == 0.15


def test_masking_and_near_tokens(spark):
    d = spark.createDataFrame([("Sensex gains; Infosys slides again", [(14, 21)], [(0, 6)])], "t string, a array<struct<s:int,e:int>>, b array<struct<s:int,e:int>>")
    r = d.select(train.mask(F.col("t"), F.col("a"), F.col("b")).alias("m")).withColumn("k", train.augmented_tokens(F.col("m"))).first()
    assert r["m"] == "OTH gains; TGT slides again"
    assert "near_slides" in r["k"] and "near_gains" in r["k"] and "near_oth" not in r["k"]


def test_headlines_from_addresses(spark):
    urls = ["https://www.x.com/2023/01/acme-group-stocks-fall-after-short-seller-report-12345678.html", "https://x.com/a/b", "https://x.com/news/svb-and-the-fed-2023.html"]
    d = spark.createDataFrame([(u,) for u in urls], "u string").select(tx.headline_from_url(F.col("u"), frozenset({"SVB"})).alias("h"))
    assert [r["h"] for r in d.collect()] == ["Acme Group Stocks Fall after Short Seller Report", None, "SVB and the Fed"]


def test_archive_addresses_hold_all_words_of_a_title(spark, monkeypatch):
    from riskloom.plans import text_queries

    same = "one two three four five six seven eight nine ten eleven twelve "
    rows = spark.createDataFrame([(0, same + "rises"), (5, same + "falls")], "n bigint, title string").withColumn("published_at", F.lit("2024-01-01 00:05:00").cast("timestamp"))
    monkeypatch.setattr(text_queries, "feed", lambda spark, sf: rows)
    assert sorted(r.title.split(" ")[-1] for r in text_queries.s17(spark, "").collect()) == ["Falls", "Rises"]
