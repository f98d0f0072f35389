"""Names of a universe in texts: one pass of an automaton over each text, whatever the number of aliases.

The aliases of all entities are one keyword automaton, built once in a Python worker; a text is read once and its matches
come with their offsets, so neither the alias table nor the hits of a document enter a pattern or a pairwise expression.
The function takes and gives Arrow arrays and sits in the narrow stage before labels and windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIT = "struct<ent:string,kind:string,s:int,e:int>"
CASHTAG = r"(?<![\w$])\$([A-Za-z]{1,5})\b"
EXCHANGE = r"\((?:NASDAQ|Nasdaq|NYSE|NYSE American|NSE|BSE)\s*:\s*([A-Z][A-Z.&]{0,11})\)"
SOFT = ("alias", "ambiguous")

Hit = tuple[str, str, int, int]   # entity, kind, start, end


def fold(text: str) -> str:
    """Lower case character by character, so that offsets stay."""
    if text.isascii():
        return text.lower()
    return "".join(map(_folded, text))


@lru_cache(maxsize=1 << 16)
def _folded(c: str) -> str:
    up = c.upper()
    low = (up if len(up) == 1 else c).lower()
    return low if len(low) == 1 else c


@lru_cache(maxsize=1 << 16)
def _in_word(c: str) -> bool:
    import regex

    return regex.match(r"\w", c) is not None


class Names:
    """Aliases, ticker tags and filer numbers of a universe. An alias with a capital letter counts as it stands, others in
    any case; tags in upper case, filer numbers without leading zeros."""

    def __init__(self, entities: Iterable):
        self.aliases: dict[str, list[tuple[str, str]]] = {}
        self.tags: dict[str, list[str]] = {}
        self.filers: dict[str, list[str]] = {}
        for e in entities:
            for kind, names in (("alias", e.aliases), ("ambiguous", e.ambiguous_aliases)):
                for a in names:
                    self.aliases.setdefault(a if any(c.isupper() for c in a) else a.lower(), []).append((e.entity_id, kind))
            for t in e.cashtags:
                self.tags.setdefault(t.upper(), []).append(e.entity_id)
            if e.cik:
                self.filers.setdefault(e.cik.lstrip("0"), []).append(e.entity_id)
        self.key = hashlib.sha1(repr((sorted(self.aliases.items()), sorted(self.tags.items()), sorted(self.filers.items()))).encode()).hexdigest()

    def automaton(self):
        """Folded aliases, each with the spellings that count (None: any)."""
        import ahocorasick

        words: dict[str, set[str | None]] = {}
        for a in self.aliases:
            if a:
                words.setdefault(fold(a), set()).add(a if any(c.isupper() for c in a) else None)
        found = ahocorasick.Automaton()
        for w, spellings in words.items():
            found.add_word(w, (len(w), frozenset(spellings)))
        found.make_automaton()
        return found

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the longest alias at each start that no word character, nor $ before it, touches."""
        machine = _machine(self)
        if not len(machine):
            return []
        best: dict[int, int] = {}
        for last, (n, spellings) in machine.iter(fold(text)):
            s, e = last + 1 - n, last + 1
            if e <= best.get(s, 0) or (None not in spellings and text[s:e] not in spellings):
                continue
            if (s and (text[s - 1] == "$" or _in_word(text[s - 1]))) or (e < len(text) and _in_word(text[e])):
                continue
            best[s] = e
        return sorted(best.items())

    def hits(self, text: str | None, title: str | None, source_type: str | None, cik: str | None) -> list[Hit]:
        import regex

        text, out = text or "", []
        if source_type == "filing" and cik is not None:
            out += [(ent, "filer", 0, len(title or "")) for ent in self.filers.get(cik.lstrip("0"), ())]
        if self.tags:
            for sign, pattern, kind in (("$", CASHTAG, "cashtag"), ("(", EXCHANGE, "exchange")):
                if sign in text:
                    out += [(ent, kind, m.start(), m.end()) for m in regex.finditer(pattern, text) for ent in self.tags.get(m.group(1).upper(), ())]
        for s, e in self.spans(text):
            name = text[s:e]
            low = name.lower()
            out += [(ent, kind, s, e) for ent, kind in self.aliases.get(name, ())]
            if low != name:
                out += [(ent, kind, s, e) for ent, kind in self.aliases.get(low, ())]
        return out


@lru_cache(maxsize=4)
def _built(key: str, make) -> object:
    return make()


class _Maker:
    """Makes an automaton; equal tables make equal ones."""

    def __init__(self, names: Names):
        self.names = names

    def __eq__(self, other) -> bool:
        return self.names.key == other.names.key

    def __hash__(self) -> int:
        return hash(self.names.key)

    def __call__(self):
        return self.names.automaton()


def _machine(names: Names):
    """The worker's automaton for a table."""
    return _built(names.key, _Maker(names))


def longest(hits: list[Hit]) -> list[Hit]:
    """Without names that lie inside a longer name of another entity: one sweep by start, the longer first."""
    soft = sorted((s, -e, ent) for ent, kind, s, e in hits if kind in SOFT)
    reach: list[tuple[int, str]] = [(-1, ""), (-1, "")]     # the furthest ends so far, of two entities
    gone: set[tuple[str, int, int]] = set()
    at = 0
    while at < len(soft):
        to = at
        while to < len(soft) and soft[to][:2] == soft[at][:2]:
            to += 1
        s, e = soft[at][0], -soft[at][1]
        for _, _, ent in soft[at:to]:
            if max(x for x, owner in reach if owner != ent) >= e:
                gone.add((ent, s, e))
        for _, _, ent in soft[at:to]:
            reach = _furthest([*reach, (e, ent)])
        at = to
    return [h for h in hits if h[1] not in SOFT or (h[0], h[2], h[3]) not in gone]


def _furthest(ends: list[tuple[int, str]]) -> list[tuple[int, str]]:
    top: dict[str, int] = {}
    for e, ent in ends:
        top[ent] = max(top.get(ent, -1), e)
    best = sorted(((e, ent) for ent, e in top.items()), reverse=True)[:2]
    return best + [(-1, "")] * (2 - len(best))


def hit_column(names: Names, text: Column, title: Column, source_type: Column, cik: Column, nested: bool = True) -> Column:
    """array<HIT> of a document; ``nested`` False drops names inside longer ones of other entities."""

    @F.arrow_udf(f"array<{HIT}>")
    def find(texts: pa.Array, titles: pa.Array, types: pa.Array, ciks: pa.Array) -> pa.Array:
        ends, cells = [0], []
        for row in zip(texts.to_pylist(), titles.to_pylist(), types.to_pylist(), ciks.to_pylist(), strict=True):
            found = names.hits(*row)
            cells += found if nested else longest(found)
            ends.append(len(cells))
        columns = list(zip(*cells, strict=True)) if cells else [(), (), (), ()]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
        each = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["ent", "kind", "s", "e"])
        return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), each)

    # so marked, the optimiser evaluates it once, in a column of its own
    return find.asNondeterministic()(text, title, source_type, cik)


# ------------------------------------------------------------------ a universe that is a table
PLACE = "struct<how:string,key:string,name:string,low:string,kind:string,s:int,e:int>"


def name_table(universe: DataFrame) -> DataFrame:
    """(entity_id, aliases, ambiguous_aliases, cashtags, cik) -> the names of ``Names`` as rows: how, key, spelling, cased, ent, sort."""
    @F.arrow_udf("struct<key:string,spelling:string,cased:boolean>")
    def spelled(names: pa.Array) -> pa.Array:
        rows = [(a, any(c.isupper() for c in a)) for a in names.to_pylist()]
        kept = [a if cased else a.lower() for a, cased in rows]
        return pa.StructArray.from_arrays([pa.array([fold(a) for a in kept], pa.string()), pa.array(kept, pa.string()), pa.array([c for _, c in rows], pa.bool_())],
                                          names=["key", "spelling", "cased"])

    def soft(kind: str, column: str) -> DataFrame:
        named = universe.select("entity_id", F.explode(column).alias("a")).filter("a <> ''").withColumn("n", spelled("a").alias("n"))
        return named.select(F.lit("name").alias("how"), "n.key", "n.spelling", "n.cased", F.col("entity_id").alias("ent"), F.lit(kind).alias("sort"))

    def strong(how: str, key: Column, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(how).alias("how"), key.alias("key"), F.lit(None).cast("string").alias("spelling"), F.lit(None).cast("boolean").alias("cased"),
                           F.col("entity_id").alias("ent"), F.lit(None).cast("string").alias("sort"))

    tags = strong("tag", F.upper("t"), universe.select("entity_id", F.explode("cashtags").alias("t")))
    filers = strong("filer", F.ltrim(F.col("cik"), F.lit("0")), universe.filter("cik <> ''"))
    return soft("alias", "aliases").unionByName(soft("ambiguous", "ambiguous_aliases")).unionByName(tags).unionByName(filers)


def places(text: str | None, title: str | None, source_type: str | None, cik: str | None, lengths: tuple[int, ...], tags: bool) -> list[tuple]:
    """(how, key, name, low, kind, start, end) of all that may be a name: what no word character touches, of a length that names have."""
    import regex

    text, out = text or "", []
    if source_type == "filing" and cik is not None:
        out.append(("filer", cik.lstrip("0"), None, None, "filer", 0, len(title or "")))
    if tags:
        for sign, pattern, kind in (("$", CASHTAG, "cashtag"), ("(", EXCHANGE, "exchange")):
            if sign in text:
                out += [("tag", m.group(1).upper(), None, None, kind, m.start(), m.end()) for m in regex.finditer(pattern, text)]
    folded, n = fold(text), len(text)
    ends = {0, n}.union(i for i in range(1, n) if not _in_word(text[i]))
    for s in range(n):
        if s and (text[s - 1] == "$" or _in_word(text[s - 1])):
            continue
        for e in (s + k for k in lengths):
            if e in ends:
                name = text[s:e]
                out.append(("name", folded[s:e], name, name.lower(), None, s, e))
    return out


def hit_rows(docs: DataFrame, table: DataFrame, keep: list[str], text: Column, title: Column, source_type: Column, cik: Column) -> DataFrame:
    """``keep`` with a row per hit (ent, kind, s, e): what ``hit_column`` finds, nested names too, for names that fill a table.

    Texts and names meet by a join, so no task holds the names.
    """
    lengths = tuple(sorted(r[0] for r in table.filter("how = 'name'").select(F.length("key")).distinct().collect()))   # as many as the longest name is long
    tags = not table.filter("how = 'tag'").isEmpty()

    @F.arrow_udf(f"array<{PLACE}>")
    def find(texts: pa.Array, titles: pa.Array, types: pa.Array, ciks: pa.Array) -> pa.Array:
        ends, cells = [0], []
        for row in zip(texts.to_pylist(), titles.to_pylist(), types.to_pylist(), ciks.to_pylist(), strict=True):
            cells += places(*row, lengths, tags)
            ends.append(len(cells))
        columns = list(zip(*cells, strict=True)) if cells else [()] * 7
        kinds = (*[pa.string()] * 5, pa.int32(), pa.int32())
        each = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["how", "key", "name", "low", "kind", "s", "e"])
        return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), each)

    # the longest name of a start counts; names of one length need no such choice, nor the text that tells documents apart
    told = [text.alias("_text")] if len(lengths) > 1 else []
    seen = docs.select(*keep, *told, find.asNondeterministic()(text, title, source_type, cik).alias("_found"))
    seen = seen.select(*keep, *(["_text"] if told else []), F.explode("_found").alias("_p")).select("*", "_p.*").drop("_p")
    met = seen.join(table, ["how", "key"]).filter((F.col("how") != "name") | ~F.col("cased") | (F.col("spelling") == F.col("name")))
    if told:
        place = Window.partitionBy(*keep, "_text", "how", "s")
        met = met.withColumn("_last", F.max("e").over(place)).filter((F.col("how") != "name") | (F.col("e") == F.col("_last")))
    met = met.filter((F.col("how") != "name") | (F.col("spelling") == F.col("name")) | (F.col("spelling") == F.col("low")))
    return met.select(*keep, "ent", F.coalesce("kind", "sort").alias("kind"), "s", "e")


class _AnyCase:
    """An entity whose names all count in any case."""

    def __init__(self, e):
        self.entity_id, self.ambiguous_aliases, self.cashtags, self.cik = e.entity_id, (), (), None
        self.aliases = tuple(a.lower() for a in (*e.aliases, *e.ambiguous_aliases))


def holds_name(entities: Iterable) -> Callable[[Column], Column]:
    """Text -> whether it holds an alias in any case or the tag of a company: the cheap test before a post is parsed."""
    entities = list(entities)
    names = Names([_AnyCase(e) for e in entities])
    tags = frozenset(t.upper() for e in entities if e.entity_type == "company" for t in e.cashtags)

    def test(text: str) -> bool:
        import regex

        machine = _machine(names)
        for last, (n, _) in machine.iter(fold(text)) if len(machine) else ():
            s, e = last + 1 - n, last + 1
            if not ((s and _in_word(text[s - 1])) or (e < len(text) and _in_word(text[e]))):
                return True
        return "$" in text and any(m.group(1).upper() in tags for m in regex.finditer(r"\$(\w+)", text))

    def column(text: Column) -> Column:
        @F.arrow_udf("boolean")
        def holds(texts: pa.Array) -> pa.Array:
            return pa.array([test(t or "") for t in texts.to_pylist()], pa.bool_())

        return holds(text)

    return column
