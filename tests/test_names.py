"""Names of a universe in texts, against one pattern of all aliases and against all pairs of hits."""

import random
import re as _re
from types import SimpleNamespace

import regex
from pyspark.sql import functions as F

from riskloom.operators import names


def entity(k, aliases, ambiguous=(), tags=(), cik=None):
    return SimpleNamespace(entity_id=k, entity_type="company", aliases=tuple(aliases), ambiguous_aliases=tuple(ambiguous), cashtags=tuple(tags), cik=cik)


UNIVERSE = [entity("A", ["acme", "acme corp", "Acme Holdings"], tags=["ACM"], cik="0000000042"), entity("B", ["Corp Acme", "at&t", "b.b."], ["target"]), entity("C", ["acme corp europe", "é bank", "straße"], tags=["ACM", "C"]), entity("D", ["acme"], ["gap", "GAP"])]


def by_pattern(table, text):
    """Alternation of all aliases, the longest first, at every start."""
    keys = sorted(table.aliases, key=lambda a: (-len(a), a))
    one = [(k, regex.compile(regex.escape(k) + r"(?!\w)" if any(c.isupper() for c in k) else f"(?i:{regex.escape(k)})" + r"(?!\w)")) for k in keys]
    out = []
    for s in range(len(text)):
        if s and (text[s - 1] == "$" or regex.match(r"\w", text[s - 1])):
            continue
        m = next((m for _, p in one if (m := p.match(text, s))), None)
        if m:
            out.append((s, m.end()))
    return out


def test_spans_equal_one_pattern_of_all_aliases():
    table, r = names.Names(UNIVERSE), random.Random(3)
    bits = ["acme", "Acme", "ACME", " ", " ", "corp", "Corp", "Holdings", "europe", "AT&T", "b.b.", "target", "gap", "GAP", "É BANK", "é bank", "Straße", "$", "x", "_", ".", "́", "²", "-", "acme corp europe"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
        assert table.spans(text) == by_pattern(table, text), text


def test_longest_by_all_pairs():
    r = random.Random(5)
    for _ in range(2000):
        hits = [(r.choice("ABC"), r.choice(["alias", "ambiguous", "cashtag"]), s, s + r.randint(1, 6)) for s in (r.randint(0, 8) for _ in range(r.randint(0, 9)))]
        soft = [h for h in hits if h[1] in names.SOFT]
        want = [h for h in hits if h[1] not in names.SOFT or not any(o[0] != h[0] and o[2] <= h[2] and h[3] <= o[3] and o[3] - o[2] > h[3] - h[2] for o in soft)]
        assert names.longest(hits) == want


def test_tags_exchanges_and_filers():
    table = names.Names(UNIVERSE)
    assert table.hits("$acm (NYSE: C) a$ACM $ACMX", "t", "news", "42") == [("A", "cashtag", 0, 4), ("C", "cashtag", 0, 4), ("C", "exchange", 5, 14)]
    assert table.hits("x", "A title", "filing", "0042") == [("A", "filer", 0, 7)] and table.hits("x", "A title", "filing", None) == []
    assert table.hits(None, None, None, None) == [] and names.Names([]).hits("acme", "", "news", None) == []


def test_a_universe_of_two_hundred_thousand_names(spark):
    """Far beyond what a pattern holds; a text of many hits is read once."""
    many = [entity(f"E{k}", [f"firm number {k}"]) for k in range(200_000)]
    table = names.Names(many)
    text = " and ".join(f"Firm Number {k}" for k in range(0, 200_000, 40))
    d = spark.createDataFrame([(1, text), (2, "firm number 200000"), (3, None)], "id int, text string").repartition(2)
    none = F.lit(None).cast("string")
    got = d.withColumn("h", names.hit_column(table, F.col("text"), none, F.lit("news"), none, nested=False)).collect()
    found = {r.id: r.h for r in got}
    assert len(found[1]) == 5000 and found[2] == [] and found[3] == []
    assert all(text[h.s:h.e].lower() == f"firm number {h.ent[1:]}" for h in found[1])


def test_prefilter_equals_its_pattern(spark):
    r = random.Random(7)
    bits = ["acme", "Corp ACME", " ", " ", "gap", "x", "$", "$ACM", "$c", "at&t", "target", "²", "."]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 7))) for _ in range(600)]
    terms = sorted({a.lower() for e in UNIVERSE for a in (*e.aliases, *e.ambiguous_aliases)}, key=lambda a: (-len(a), a))
    pattern = regex.compile(rf"(?i)(?<!\w)(?:{'|'.join(_re.escape(t) for t in terms)})(?!\w)|\$(?:ACM|C)\b")
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {x.id for x in d.filter(names.holds_name(UNIVERSE)(F.col("text"))).collect()}
    assert got == {k for k, t in enumerate(texts) if pattern.search(t)}


def test_names_as_a_table_give_the_hits_of_the_automaton(spark):
    from riskloom import corpus
    from riskloom.operators import mentions
    from riskloom.plans.text_queries import DIMS
    from pyspark.sql import functions as F

    ents = [corpus.Entity("A", "company", "A", ("Acme", "Acme Holdings", "acme"), (), "0000000011", None, ("ACM",)),
            corpus.Entity("B", "company", "B", ("Holdings", "C&D"), ("acme holdings",)), corpus.Entity("C", "company", "C", ("",), ("Straße",), "11", None, ("acm", "XY"))]
    texts = ["Acme Holdings and acme holdings, ACME; $ACM $Acme xAcme", "C&D's straße Straße (NYSE: XY)", "", None, "Acme Holdings and acme holdings, ACME; $ACM $Acme xAcme"]
    docs = spark.createDataFrame([(i % 3, t, "Title", ("filing", "news")[i % 2], ("011", None)[i % 3 == 2]) for i, t in enumerate(texts)],
                                 "id int, text string, title string, source_type string, cik string")
    args = [F.col(c) for c in ("text", "title", "source_type", "cik")]
    universe = spark.createDataFrame([(e.entity_id, list(e.aliases), list(e.ambiguous_aliases), list(e.cashtags), e.cik) for e in ents],
                                     "entity_id string, aliases array<string>, ambiguous_aliases array<string>, cashtags array<string>, cik string")
    want = docs.select("id", F.explode(mentions.Linker(ents, DIMS).hits(*args)).alias("h")).select("id", "h.*")
    got = mentions.Linker(universe, DIMS).hit_rows(docs, ["id"], *args)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
