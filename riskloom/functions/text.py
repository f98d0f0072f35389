"""Text as columns: keys, tokens, spans, sentences, lexicon scores. No Python runs per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.dims.text_rules import MOVE_DOWN_VERBS, MOVE_FILLERS, MOVE_UP_VERBS, NEUTRAL_PHRASES, TextDims



def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression; lambdas would otherwise evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


WORD = r"[a-z0-9$][a-z0-9'$-]*"
LEXICON_WORD = r"[a-z][a-z'\-]*"
_AMOUNT = r"\s+\d+(?:\.\d+)?\s?%"
MOVE_SIGN_DOWN = r"[-−]\s?\d+(?:\.\d+)?\s?%"
MOVE_SIGN_UP = r"\+\s?\d+(?:\.\d+)?\s?%"
MOVE_DOWN = rf"(?i)\b(?:{MOVE_DOWN_VERBS})\b(?:\s+(?:{MOVE_FILLERS}))?{_AMOUNT}"
MOVE_UP = rf"(?i)\b(?:{MOVE_UP_VERBS})\b(?:\s+(?:{MOVE_FILLERS}))?{_AMOUNT}"
ANY_MOVE = (
    rf"(?i)[-+−]\s?\d+(?:\.\d+)?\s?%|\b(?:{MOVE_DOWN_VERBS})\b(?:\s+(?:{MOVE_FILLERS}))?{_AMOUNT}"
    rf"|\b(?:{MOVE_UP_VERBS})\b(?:\s+(?:{MOVE_FILLERS}))?{_AMOUNT}"
)
CLAUSE_CUT = r"(?i)\s+(?:while|whereas|as|but|after|even as)\s+|\s*[;,]\s+(?:while|as|but)?\s*"


def stable_id(prefix: str, *parts: Column) -> Column:
    """Content hash id: replays give the same ids, so sinks stay idempotent."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(joined), 1, 16))


def document_text(title: Column, body: Column) -> Column:
    return F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(body, F.lit("")))


def story_key_text(title: Column, body: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.substring(body, 1, 300))


def tokens(text: Column, stop: frozenset[str]) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(sorted(stop)))


def content_words(toks: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(toks, lambda t: (F.length(t) > 2) & ~t.rlike(r"^[0-9]+$"))))


def shingles(toks: Column, k: int = 3) -> Column:
    n = F.size(toks)
    runs = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.concat_ws(" ", F.slice(toks, i, k)))
    return (
        F.when(n >= k, F.array_distinct(runs))
        .when(n > 0, F.array(F.concat_ws(" ", toks)))
        .otherwise(F.array().cast("array<string>"))
    )


def fingerprint(title: Column, body: Column, stop: frozenset[str]) -> Column:
    source = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(body)
    found = F.regexp_extract_all(F.lower(source), F.lit("[a-z0-9]+"), F.lit(0))
    return F.concat_ws(" ", F.slice(F.filter(found, lambda t: ~t.isin(sorted(stop))), 1, 10))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two distinct word arrays; 0 when either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        common / (F.size(a) + F.size(b) - common)
    )


def has_denial(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){pattern}")


# ------------------------------------------------------------------ spans
def _running(lengths: Column) -> Column:
    return F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, 1, i + 1), F.lit(0), lambda a, x: a + x))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<s, e, hit>> of the matches of an ordinary pattern."""
    padded = F.concat(F.lit(" "), text)
    pieces = F.transform(F.split(padded, pattern, -1), lambda p: F.length(p))
    whole = F.transform(F.regexp_extract_all(padded, F.lit(pattern), F.lit(0)), lambda p: F.length(p))
    hits = F.regexp_extract_all(padded, F.lit(pattern), F.lit(group))

    def place(v: Column) -> Column:
        # end of match i = pieces up to i plus matches up to i
        ends = F.zip_with(
            let(F.slice(v["p"], 1, F.size(v["w"])), _running), let(v["w"], _running), lambda a, b: a + b - 1)
        return F.transform(
            F.arrays_zip(ends.alias("e"), v["w"].alias("w"), v["h"].alias("h")),
            lambda z: F.struct((z["e"] - z["w"]).alias("s"), z["e"].alias("e"), z["h"].alias("hit")),
        )

    return let(F.struct(pieces.alias("p"), whole.alias("w"), hits.alias("h")), place)


def sentence_at(text: Column, pos: Column) -> Column:
    """struct<s, e> of the sentence holding offset ``pos``: text up to . ! ? or a line end."""
    left = F.length(F.regexp_extract(F.reverse(F.substring(text, F.lit(1), pos)), r"^[^.!?\n]*", 0))
    right = F.length(F.regexp_extract(F.substring(text, pos + 1, F.length(text)), r"^[^.!?\n]*[.!?]*", 0))
    return F.struct((pos - left).alias("s"), (pos + right).alias("e"))


def clauses(text: Column, span: Column) -> Column:
    """array<struct<s, e>> of the clauses of one sentence span."""
    body = F.substring(text, span["s"] + 1, span["e"] - span["s"])

    def parts(cuts: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["e"]))
        ends = F.concat(F.transform(cuts, lambda c: c["s"]), F.array(span["e"] - span["s"]))
        spans = F.transform(
            F.arrays_zip(starts.alias("a"), ends.alias("b")),
            lambda z: F.struct((span["s"] + z["a"]).alias("s"), (span["s"] + z["b"]).alias("e")),
        )
        return F.filter(spans, lambda p: p["e"] > p["s"])

    return let(
        let(matches(body, CLAUSE_CUT), parts),
        lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.array(F.struct(span["s"].alias("s"), span["e"].alias("e")))),
    )


# ------------------------------------------------------------------ lexicon
def _in(words: frozenset[str], tok: Column) -> Column:
    return tok.isin(sorted(words)) if words else F.lit(False)


def lexicon_probs(text: Column, dims: TextDims) -> Column:
    """struct<neg, neu, pos>: word balance, signed moves, intensifiers (2 back), negators (3 back)."""
    return let(text, lambda t: _lexicon(t, dims))


def _lexicon(text: Column, dims: TextDims) -> Column:
    moved = text.contains("%")
    down = F.when(moved, F.regexp_count(text, F.lit(MOVE_SIGN_DOWN)) + F.regexp_count(text, F.lit(MOVE_DOWN))).otherwise(0)
    up = F.when(moved, F.regexp_count(text, F.lit(MOVE_SIGN_UP)) + F.regexp_count(text, F.lit(MOVE_UP))).otherwise(0)
    plain = F.regexp_replace(text, f"(?i){NEUTRAL_PHRASES}", " ")
    cleaned = F.when(moved, F.regexp_replace(plain, ANY_MOVE, " ")).otherwise(plain)
    found = F.regexp_extract_all(F.lower(cleaned), F.lit(LEXICON_WORD), F.lit(0))

    def scored(toks: Column) -> Column:
        def back(i: Column, n: int) -> Column:
            return F.slice(toks, F.greatest(i - n, F.lit(0)) + 1, F.least(i, F.lit(n)))

        def score(tok: Column, i: Column) -> Column:
            sign = F.when(_in(dims.positive, tok), 1.0).when(_in(dims.negative | dims.question, tok), -1.0).otherwise(0.0)
            weight = F.when(_in(dims.strong_negative | dims.strong_positive, tok), 2.0).otherwise(1.0)
            boost = F.when(F.exists(back(i, 2), lambda t: _in(dims.intensifiers, t)), 1.5).otherwise(1.0)
            flip = F.when(F.exists(back(i, 3), lambda t: _in(dims.negators, t)), -1.0).otherwise(1.0)
            return F.when(sign == 0.0, 0.0).otherwise(sign * weight * boost * flip)

        return F.filter(F.transform(toks, score), lambda x: x != 0.0)

    scores = let(found, scored)
    sides = F.aggregate(
        scores, F.struct(2.0 * up.cast("double"), 2.0 * down.cast("double")),
        lambda acc, x: F.struct(
            (acc["col1"] + F.greatest(x, F.lit(0.0))).alias("col1"), (acc["col2"] + F.greatest(-x, F.lit(0.0))).alias("col2")),
        lambda acc: probs_from_sides(acc["col1"], acc["col2"]),
    )
    return sides


def probs_from_sides(pos: Column, neg: Column) -> Column:
    total = pos + neg
    strength = 0.95 * F.least(F.lit(1.0), total / 3.0)
    share = F.when(total > 0, (pos - neg) / F.when(total > 0, total)).otherwise(0.0)
    p_pos = 0.5 * strength * (1 + share)
    p_neg = 0.5 * strength * (1 - share)
    return F.when(total == 0, F.struct(F.lit(0.1).alias("neg"), F.lit(0.8).alias("neu"), F.lit(0.1).alias("pos"))).otherwise(
        F.struct(p_neg.alias("neg"), (1.0 - p_pos - p_neg).alias("neu"), p_pos.alias("pos"))
    )


def entropy_confidence(p: Column) -> Column:
    def term(x: Column) -> Column:
        return F.when(x > 0, x * F.ln(F.when(x > 0, x))).otherwise(0.0)

    h = -(term(p["neg"]) + term(p["neu"]) + term(p["pos"]))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - h / F.ln(F.lit(3.0))))


# ------------------------------------------------------------------ headlines from addresses
# fixed values: segment filters and small words of a rebuilt headline
_ID_WORD = r"(?i)^(?:[0-9]+|[0-9a-f]{8,}|[a-z]?[0-9]{5,}[a-z0-9]*|index|amp|story|news|article|articleshow)$"
_EXTENSION = r"(?i)\.(?:s?html?|php|aspx?|cms|jsp|ece|story)$"
_DATE_WORD = r"^(?:19|20)\d{2}(?:[01]\d(?:[0-3]\d)?)?$"
_KEPT_WORD = r"^(?:[A-Za-z][A-Za-z0-9'&.]*|\d+(?:\.\d+)?%?)$"
SMALL_WORDS = "a an and as at by for in of on or the to vs with from after over"
BASE_ACRONYMS = (
    "US UK EU IPO FPO CEO CFO AI FDIC SEC RBI SEBI LIC NSE BSE SVB SBI UBS ETF GDP CPI FOMC ECB IMF NYSE LSE"
)
# end of fixed values


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_host(url: Column) -> Column:
    """Host without user, port or a leading www."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(host, r":.*$", ""), r"^www\.", "")


def headline_from_url(url: Column, acronyms: frozenset[str], min_words: int = 3, max_words: int = 24) -> Column:
    """The most word-like path segment in title case; null when no segment carries enough words."""
    segments = F.filter(F.split(url_path(url), "/"), lambda s: s != "")

    def words(segment: Column) -> Column:
        return F.filter(
            F.split(F.regexp_replace(segment, _EXTENSION, ""), "[-_+]+"),
            lambda w: (w != "") & ~w.rlike(_ID_WORD) & ~w.rlike(_DATE_WORD) & w.rlike(_KEPT_WORD),
        )

    def longest(parsed: Column) -> Column:
        most = F.array_max(F.transform(parsed, lambda w: F.size(w)))
        return let(most, lambda m: F.get(F.filter(parsed, lambda w: F.size(w) == m), F.lit(0)))

    best = let(F.transform(segments, words), longest)

    def cased(w: Column, i: Column) -> Column:
        low = F.lower(w)
        return (
            F.when(F.upper(w).isin(sorted(acronyms)), F.upper(w))
            .when((i > 0) & low.isin(SMALL_WORDS.split()), low)
            .otherwise(F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, F.lit(2), F.length(low))))
        )

    return let(best, lambda b: F.when(
        F.size(b) >= min_words, F.concat_ws(" ", F.transform(F.slice(b, 1, max_words), cased))))
