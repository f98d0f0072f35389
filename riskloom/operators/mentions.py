"""Documents -> one row per (document, entity): links, windows, sentiment, impact.

Everything up to the mention row is narrow, so the stage scales with the scan: names are found by one Arrow batch function
(``names``), the rest are column expressions; there is no shuffle, and the text leaves with the last projection.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.dims.publishers import PUBLISHERS, PublisherDims
from riskloom.dims.text_rules import TextDims
from riskloom.functions import risk, text as tx, voices
from riskloom.operators.labels import with_label
from riskloom.operators.names import Names, hit_column, hit_rows, name_table
from riskloom.session import spread

STRONG = ["cashtag", "exchange", "filer"]
MACRO_FALLBACK = "MACRO:MARKET"
SPAN_LIMIT = 280


def with_text(docs: DataFrame) -> DataFrame:
    """Add ``text`` and ``key_text``; drop documents without any text."""
    return (
        docs.withColumn("text", tx.document_text(F.col("title"), F.col("body")))
        .withColumn("key_text", tx.story_key_text(F.col("title"), F.col("body")))
        .filter(F.trim("text") != "")
    )


class Linker:
    """Alias, cashtag, exchange-ticker and filer links of a universe of any size (``names``)."""

    def __init__(self, entities: Iterable | DataFrame, dims: TextDims, min_score: float = 0.6) -> None:
        """``entities`` as a table (``name_table``) serve ``hit_rows``, which no task needs all names for."""
        self.dims = dims
        self.min_score = min_score
        if isinstance(entities, DataFrame):
            self.table = name_table(entities)
        else:
            self.names = Names(entities)

    def hit_rows(self, docs: DataFrame, keep: list[str], text: Column, title: Column, source_type: Column, cik: Column) -> DataFrame:
        """``keep`` with a row per hit, by a join with the table of names."""
        return hit_rows(docs, self.table, keep, text, title, source_type, cik)

    def hits(self, text: Column, title: Column, source_type: Column, cik: Column, nested: bool = True) -> Column:
        """array<HIT>; without ``nested`` the longest name wins across entities: one inside a longer one is dropped."""
        return hit_column(self.names, text, title, source_type, cik, nested)

    @staticmethod
    def _one_per_place(hits: Column) -> Column:
        """Within an entity keep the first, longest hit of overlapping ones; a strong kind replaces."""
        ordered = F.array_sort(F.transform(hits, lambda h: F.struct(
            h["s"].alias("s"), (h["s"] - h["e"]).alias("neg"), h["e"].alias("e"), h["kind"].alias("kind"))))

        def keep(acc: Column, h: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            clash = (F.size(acc) > 0) & (h["s"] < last["e"]) & (h["e"] > last["s"])
            swap = h["kind"].isin(STRONG) & ~last["kind"].isin(STRONG)
            return F.when(F.coalesce(clash, F.lit(False)), F.when(swap, F.concat(
                F.slice(acc, 1, F.size(acc) - 1), F.array(h))).otherwise(acc)).otherwise(F.concat(acc, F.array(h)))

        return F.aggregate(ordered, F.array().cast("array<struct<s:int,neg:int,e:int,kind:string>>"), keep)

    def mentions(self, text: Column, title: Column, source_type: Column, hits: Column) -> Column:
        """array<struct<ent, kinds, spans, ner, ned, relevance, surface>> for ``hits`` after nesting."""
        context = sorted(self.dims.context)
        n_text = F.length(text)

        def ambiguity(h: Column, others: Column) -> Column:
            start = F.greatest(F.lit(0), h["s"] - 160)
            words = F.array_distinct(F.regexp_extract_all(
                F.lower(F.substring(text, start + 1, h["e"] + 160 - start)), F.lit(r"[a-z][a-z'\-]*"), F.lit(0)))
            n = F.size(F.filter(words, lambda w: w.isin(context))) if context else F.lit(0)
            base = F.when(n >= 2, 0.9).when(n >= 1, 0.75).otherwise(0.35)
            return F.when(others, F.greatest(base, F.lit(0.8))).otherwise(base)

        def mention(ent: Column, hs: Column, sure: Column) -> Column:
            def build(kept: Column) -> Column:
                kinds = F.array_distinct(F.transform(kept, lambda h: h["kind"]))
                only_soft = ~F.exists(kinds, lambda k: k != "ambiguous")
                strong = F.exists(kinds, lambda k: k.isin(STRONG))
                others = F.exists(sure, lambda c: c != ent)
                ned = F.when(only_soft, F.array_max(F.transform(kept, lambda h: ambiguity(h, others)))).when(
                    strong, 1.0).otherwise(0.95)
                count = F.size(kept)
                first = F.get(kept, F.lit(0))
                in_title = (title != "") & F.exists(kept, lambda h: h["s"] < F.length(title))
                social = 70 + 10 * F.least(count - 1, F.lit(2)) + F.when(F.array_contains(kinds, "cashtag"), 10).otherwise(0)
                press = (20.0 + F.when(in_title, 45).otherwise(0)
                         + 20.0 * (1.0 - first["s"] / F.greatest(n_text, F.lit(1))) + 5 * F.least(count, F.lit(3)))
                rel = F.when(F.array_contains(kinds, "filer"), 100.0).when(source_type == "social", social.cast("double")).otherwise(press)
                return F.struct(
                    ent.alias("ent"), F.array_sort(kinds).alias("kinds"),
                    F.transform(kept, lambda h: F.struct(h["s"].alias("s"), h["e"].alias("e"))).alias("spans"),
                    F.when(only_soft, 0.8).when(strong, 0.99).otherwise(0.95).alias("ner"), F.bround(ned, 3).alias("ned"),
                    F.least(F.lit(100), F.greatest(F.lit(0), F.bround(rel, 0).cast("int"))).alias("relevance"),
                    F.substring(text, first["s"] + 1, first["e"] - first["s"]).alias("surface"))

            return tx.let(self._one_per_place(F.filter(hs, lambda h: h["ent"] == ent)), build)

        def all_mentions(v: Column) -> Column:
            hs = v["hits"]
            sure = v["sure"]
            return F.filter(
                F.transform(F.array_distinct(F.transform(hs, lambda h: h["ent"])), lambda ent: mention(ent, hs, sure)),
                lambda m: m["ned"] >= self.min_score)

        def bind(hs: Column) -> Column:
            sure = F.array_distinct(F.transform(F.filter(hs, lambda h: h["kind"] != "ambiguous"), lambda h: h["ent"]))
            return tx.let(F.struct(hs.alias("hits"), sure.alias("sure")), all_mentions)

        return tx.let(hits, bind)

    def link(self, docs: DataFrame) -> DataFrame:
        """Add ``mentions`` to documents with ``text``."""
        found = docs.withColumn("_hits", self.hits(F.col("text"), F.col("title"), F.col("source_type"), F.col("cik"), nested=False))
        return found.withColumn("mentions", self.mentions(
            F.col("text"), F.col("title"), F.col("source_type"), F.col("_hits"))).drop("_hits")


def macro_fallback(docs: DataFrame) -> DataFrame:
    """Macro and geopolitical news without any entity speaks about the market."""
    whole = F.when(F.col("title") != "", F.length("title")).otherwise(F.length("text"))
    pseudo = F.array(F.struct(
        F.lit(MACRO_FALLBACK).alias("ent"), F.array(F.lit("macro")).alias("kinds"),
        F.array(F.struct(F.lit(0).alias("s"), whole.alias("e"))).alias("spans"), F.lit(0.5).alias("ner"), F.lit(0.5).alias("ned"),
        F.lit(50).alias("relevance"), F.substring("text", F.lit(1), F.least(whole, F.lit(60))).alias("surface")))
    use = ((F.size("mentions") == 0) & F.col("label.primary").isin("MACROECONOMIC", "GEOPOLITICAL")
           & (F.col("label.confidence") >= 0.5))
    return docs.withColumn("mentions", F.when(use, pseudo).otherwise(F.col("mentions")))


def windows_of(text: Column, spans: Column, others: Column, limit: int = 3, split: bool = True) -> Column:
    """array<struct<s, e>>: first sentences naming the entity, cut to its clause when others are named."""
    def opens(sp: Column) -> Column:
        return ~F.substring(text, sp["s"] + 1, F.lit(1)).isin(".", "!", "?", "\n", "")

    sentences = F.filter(
        F.array_distinct(F.transform(F.array_sort(spans), lambda p: tx.sentence_at(text, p["s"]))), opens)

    def cut(sentence: Column) -> Column:
        if not split:
            return F.array(sentence)
        shared = F.exists(others, lambda o: (sentence["s"] <= o["s"]) & (o["s"] < sentence["e"]))

        def own(parts: Column) -> Column:
            mine = F.filter(parts, lambda c: F.exists(spans, lambda p: (c["s"] <= p["s"]) & (p["s"] < c["e"])))
            only = F.filter(mine, lambda c: ~F.exists(others, lambda o: (c["s"] <= o["s"]) & (o["s"] < c["e"])))
            return F.when(F.size(only) > 0, only).when(F.size(mine) > 0, mine).otherwise(F.array(sentence))

        return F.when(shared, tx.let(tx.clauses(text, sentence), own)).otherwise(F.array(sentence))

    first = r"[^.!?\n]*[^.!?\n\s][^.!?\n]*[.!?]*"
    at = F.regexp_instr(text, F.lit(first))
    fallback = F.when(at > 0, F.struct((at - 1).alias("s"), (at - 1 + F.length(F.regexp_extract(text, first, 0))).alias("e"))
                      ).otherwise(F.struct(F.lit(0).alias("s"), F.length(text).alias("e")))
    return tx.let(F.slice(F.flatten(F.transform(sentences, cut)), 1, limit),
                  lambda ws: F.when(F.size(ws) > 0, ws).otherwise(F.array(fallback)))


def mean_probs(ps: Column) -> Column:
    """The mean of array<struct<neg, neu, pos>>."""
    def mean(v: Column) -> Column:
        def part(name: str) -> Column:
            return (F.aggregate(v, F.lit(0.0), lambda a, p: a + p[name]) / F.size(v)).alias(name)
        return F.struct(part("neg"), part("neu"), part("pos"))

    return tx.let(ps, mean)


def window_items(text: Column, windows: Column, spans: Column, others: Column) -> Column:
    """array<struct<text, target, others>>: each window with the spans that lie in it, counted from its start."""
    def inside(w: Column, all_spans: Column) -> Column:
        mine = F.filter(all_spans, lambda p: (w["s"] <= p["s"]) & (p["e"] <= w["e"]))
        return F.transform(mine, lambda p: F.struct((p["s"] - w["s"]).alias("s"), (p["e"] - w["s"]).alias("e")))

    return F.transform(windows, lambda w: F.struct(
        F.substring(text, w["s"] + 1, w["e"] - w["s"]).alias("text"), inside(w, spans).alias("target"), inside(w, others).alias("others")))


def lexicon_scorer(dims: TextDims):
    """Built-in scorer. Any callable Column(text) -> struct<neg, neu, pos> can replace it."""
    return lambda window: tx.lexicon_probs(window, dims)


def score_mentions(docs: DataFrame, entities: Iterable, dims: TextDims, publishers: PublisherDims = PUBLISHERS,
                   scorer=None, split_clauses: bool = True) -> DataFrame:
    """Labelled and linked documents -> (document, entity) rows with windows, sentiment and source checks.

    A scorer with ``targeted`` set (``train.TargetScorer``) reads whole sentences with the entities masked.
    """
    scorer = scorer or lexicon_scorer(dims)
    targeted = getattr(scorer, "targeted", False)
    domains = {e.entity_id: list(e.domains) for e in entities if e.domains}
    publisher, kind, author = F.col("publisher"), F.col("source_type"), F.col("author")
    # what depends on the document alone is computed before the rows multiply
    docs = docs.withColumn("_denies", tx.has_denial(F.col("text"), dims.denial)).select(
        "doc_id", "published_at", "source_type", "publisher", "author", "url", "title", "key_text", "label", "text", "mentions",
        voices.credibility(publisher, kind, author, publishers).alias("credibility"),
        voices.is_authoritative(publisher, kind, publishers).alias("authoritative"),
        voices.is_lookalike(publisher, author, publishers).alias("lookalike"),
        voices.independence_key(publisher, kind, author, publishers).alias("own_key"), "_denies",
        F.when(F.col("_denies"), tx.content_words(tx.tokens(F.col("text"), dims.stop))).alias("denial_words"))
    # outer + filter on the result: a plain explode would push "mentions is not empty" below the
    # projection and link every document twice
    one = docs.select("*", F.col("mentions").alias("_all"), F.explode_outer("mentions").alias("m")).filter(
        F.col("m").isNotNull())
    others = F.flatten(F.transform(F.filter("_all", lambda x: x["ent"] != F.col("m.ent")), lambda x: x["spans"]))
    one = one.withColumn("windows", windows_of(F.col("text"), F.col("m.spans"), others, split=split_clauses and not targeted))
    if targeted:
        items = window_items(F.col("text"), F.col("windows"), F.col("m.spans"), others)
        one = scorer.scored(one, items, "_ps")
        probs = mean_probs(F.col("_ps"))
    else:
        probs = mean_probs(F.transform("windows", lambda w: scorer(F.substring("text", w["s"] + 1, w["e"] - w["s"]))))
    first = F.get(F.col("windows"), F.lit(0))
    span = F.substring(F.trim(F.substring(F.col("text"), first["s"] + 1, first["e"] - first["s"])), 1, SPAN_LIMIT)
    own_domains = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in sorted(domains.items()) for x in (
        F.lit(k), F.array(*[F.lit(d) for d in v]))]), F.col("m.ent")), F.array()) if domains else F.array().cast("array<string>")
    one = one.withColumn("probs", probs).withColumn(
        "span", F.when(span != "", span).otherwise(F.substring("text", 1, SPAN_LIMIT)))
    return one.select(
        "doc_id", "published_at", "source_type", "publisher", "author", "url", "title", "key_text", "label",
        F.col("m.ent").alias("entity_id"), "m.kinds", "m.spans", "m.ner", "m.ned", "m.relevance", "m.surface", "windows",
        "probs", "span",
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("probs.pos") - F.col("probs.neg"))).alias("sentiment"),
        tx.entropy_confidence(F.col("probs")).alias("sent_conf"),
        "credibility", "authoritative", "lookalike", "own_key", "denial_words",
        (F.col("_denies") & ~F.col("lookalike") & (F.col("authoritative") | voices.is_official(publisher, own_domains))
         ).alias("denial"),
    )


def document_mentions(docs: DataFrame, entities: Iterable, dims: TextDims, publishers: PublisherDims = PUBLISHERS,
                      scorer=None) -> DataFrame:
    """The whole narrow front half: documents -> scored mention rows."""
    entities = list(entities)
    docs = spread(docs)
    linked = Linker(entities, dims).link(with_label(with_text(docs), dims))
    return score_mentions(macro_fallback(linked), entities, dims, publishers, scorer)


def with_impact(rows: DataFrame, novelty: str = "novelty", model: dict | None = None) -> DataFrame:
    """Document-grain impact: one voice, no reach beyond it."""
    social = F.col("source_type") == "social"
    args = (F.col("label.primary"), F.col("label.subtype"), F.col("sentiment"), F.when(social, 0).otherwise(1),
            F.when(social, 1).otherwise(0), F.col("authoritative"), F.col(novelty), F.col("relevance"))
    if model:
        return rows.withColumn("_i", risk.calibrated_score(model, *args)).withColumn("impact", F.col("_i.impact")).withColumn(
            "impact_p", F.when(F.col("_i.calibrated"), F.col("_i.p"))).drop("_i")
    return rows.withColumn("impact", risk.to_impact(risk.sigmoid(risk.prior_logit(*args)))).withColumn(
        "impact_p", F.lit(None).cast("double"))
