"""Event labels per document: weighted pattern rules, filing items, one narrow stage (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.dims.text_rules import PRIORITY, TextDims
from riskloom.functions.text import let

LABEL = "struct<primary:string,subtype:string,confidence:double,labels:array<string>,method:string>"


def fired_rules(text: Column, title: Column, dims: TextDims) -> Column:
    """array<struct<cls, subtype, hits, s, i>> of the rules that match, in rule order."""
    def one(i: int, cls: str, subtype: str, weight: float, pattern: str) -> Column:
        p = f"(?iU){pattern}"
        in_title = (title != "") & title.rlike(p)
        return let(F.regexp_count(text, F.lit(p)), lambda n: F.when(n > 0, F.struct(
            F.lit(cls).alias("cls"), F.lit(subtype).alias("subtype"), n.alias("hits"),
            (weight * (1.0 + 0.5 * F.least(n - 1, F.lit(2))) * F.when(in_title, 1.5).otherwise(1.0)).alias("s"),
            F.lit(i).alias("i"))))

    parts = [one(i, *rule) for i, rule in enumerate(dims.rules)]
    return F.filter(F.array(*parts), lambda r: r.isNotNull())


def rule_scores(docs: DataFrame, dims: TextDims) -> DataFrame:
    """One row per (document, rule) that fired."""
    return docs.select("doc_id", F.explode_outer(fired_rules(F.col("text"), F.col("title"), dims)).alias("r")).filter(
        F.col("r").isNotNull()).select(
        "doc_id", "r.cls", "r.subtype", "r.hits", "r.s")


def _ranked(fired: Column) -> Column:
    """Classes by score, ties by severity order."""
    order = F.array(*[F.struct(F.lit(c).alias("cls"), F.lit(i).alias("prio")) for i, c in enumerate(PRIORITY)])
    totals = F.transform(order, lambda o: F.struct(
        (-F.aggregate(F.filter(fired, lambda r: r["cls"] == o["cls"]), F.lit(0.0), lambda a, r: a + r["s"])).alias("neg"),
        o["prio"].alias("prio"), o["cls"].alias("cls")))
    return F.array_sort(F.filter(totals, lambda t: t["neg"] < 0))


def _from_rules(fired: Column) -> Column:
    def pick(v: Column) -> Column:
        ranked, fired_ = v["ranked"], v["fired"]
        top = F.get(ranked, F.lit(0))
        total = -F.aggregate(ranked, F.lit(0.0), lambda a, r: a + r["neg"])
        best = F.array_sort(F.transform(
            F.filter(fired_, lambda r: r["cls"] == top["cls"]),
            lambda r: F.struct((-r["s"]).alias("neg"), r["i"].alias("i"), r["subtype"].alias("subtype"))))
        conf = F.bround(0.3 + 0.65 * (-top["neg"] / total) * F.least(F.lit(1.0), -top["neg"] / 3.0), 3)
        labels = F.transform(F.filter(ranked, lambda r: r["neg"] <= 0.5 * top["neg"]), lambda r: r["cls"])
        found = F.struct(
            top["cls"].alias("primary"), F.get(best, F.lit(0))["subtype"].alias("subtype"), conf.alias("confidence"),
            labels.alias("labels"), F.lit("rules").alias("method"))
        none = F.struct(
            F.lit("OTHER").alias("primary"), F.lit(None).cast("string").alias("subtype"), F.lit(0.3).alias("confidence"),
            F.array(F.lit("OTHER")).alias("labels"), F.lit("rules").alias("method"))
        return F.when(F.size(ranked) > 0, found).otherwise(none)

    return let(fired, lambda f: let(F.struct(_ranked(f).alias("ranked"), f.alias("fired")), pick))


def most_severe_item(items: Column, dims: TextDims) -> Column:
    """struct<cls, subtype, rank> of the highest-ranked mapped item; the first wins a tie."""
    table = F.create_map(*[x for code, cls, sub, rank in dims.items for x in (
        F.lit(code), F.struct(F.lit(cls).alias("cls"), F.lit(sub).alias("subtype"), F.lit(rank).alias("rank")))])
    mapped = F.filter(F.transform(items, lambda c: F.try_element_at(table, c)), lambda m: m.isNotNull())
    return F.when(items.isNotNull(), mapped).otherwise(
        F.array().cast("array<struct<cls:string,subtype:string,rank:int>>"))


def with_label(docs: DataFrame, dims: TextDims) -> DataFrame:
    """Add ``label`` (LABEL struct). Filings with mapped items take the most severe item's class."""
    out = docs.withColumn("_rule", _from_rules(fired_rules(F.col("text"), F.col("title"), dims)))
    items = F.when(F.col("source_type") == "filing", F.col("items"))
    out = out.withColumn("_items", most_severe_item(items, dims))

    def from_items(ms: Column) -> Column:
        top = F.get(F.array_sort(F.transform(ms, lambda m, i: F.struct(
            (-m["rank"]).alias("neg"), i.alias("i"), m["cls"].alias("cls"), m["subtype"].alias("subtype")))), F.lit(0))
        union = F.array_distinct(F.concat(F.transform(ms, lambda m: m["cls"]), F.col("_rule.labels")))
        real = F.filter(union, lambda c: c != "OTHER")
        return F.struct(
            top["cls"].alias("primary"), top["subtype"].alias("subtype"), F.lit(0.95).alias("confidence"),
            F.when(F.size(real) > 0, real).otherwise(F.array(top["cls"])).alias("labels"),
            F.lit("items+rules").alias("method"))

    label = F.when(F.size("_items") > 0, from_items(F.col("_items"))).otherwise(F.col("_rule"))
    return out.withColumn("label", label).drop("_rule", "_items")
