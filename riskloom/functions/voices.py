"""Who is speaking: domain, credibility, authority, independence, impersonation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.dims.publishers import DEFAULT_CREDIBILITY, LOOKALIKE_CREDIBILITY, PublisherDims


def base_domain(publisher: Column) -> Column:
    host = F.lower(F.trim(F.coalesce(publisher, F.lit(""))))
    host = F.regexp_replace(host, r"^.*://", "")
    return F.regexp_replace(F.regexp_extract(host, r"^[^/]*", 0), r"^www\.", "")


def suffixes(domain: Column) -> Column:
    """The domain and its parents, longest first; a bare last label is left out."""
    parts = F.split(domain, r"\.")
    n = F.size(parts)
    return F.when(
        n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(".", F.slice(parts, i, n)))
    ).otherwise(F.array().cast("array<string>"))


def _known(domain: Column, table: list[str]) -> Column:
    """Longest suffix found in a table, else null."""
    return F.get(F.filter(suffixes(domain), lambda d: d.isin(table)), F.lit(0))


def _value(key: Column, table: dict) -> Column:
    if not table:
        return F.lit(None)
    pairs = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    return F.try_element_at(pairs, key)


def is_lookalike(publisher: Column, author: Column, dims: PublisherDims) -> Column:
    def borrowed(raw: Column) -> Column:
        domain = base_domain(raw)
        squashed = F.regexp_replace(domain, r"[-_.]", "")
        brand = F.lit(False)
        for b in dims.brands:
            brand = brand | squashed.contains(b)
        return (domain != "") & _known(domain, sorted(dims.credibility)).isNull() & brand

    return borrowed(publisher) | borrowed(author)


def credibility(publisher: Column, source_type: Column, author: Column, dims: PublisherDims) -> Column:
    known = _value(_known(base_domain(publisher), sorted(dims.credibility)), dims.credibility)
    default = F.create_map(*[F.lit(x) for kv in DEFAULT_CREDIBILITY.items() for x in kv])
    return (
        F.when(is_lookalike(publisher, author, dims), F.lit(LOOKALIKE_CREDIBILITY))
        .when((source_type != "social") & known.isNotNull(), known)
        .otherwise(F.try_element_at(default, source_type))
    )


def is_authoritative(publisher: Column, source_type: Column, dims: PublisherDims) -> Column:
    return (
        F.when(source_type == "filing", True)
        .when(source_type == "social", False)
        .otherwise(_known(base_domain(publisher), sorted(dims.authoritative)).isNotNull())
    )


def is_official(publisher: Column, domains: Column) -> Column:
    """The issuer's own domain or a sub-domain of it."""
    domain = base_domain(publisher)
    return F.coalesce(
        F.exists(domains, lambda d: (domain == d) | domain.endswith(F.concat(F.lit("."), d))), F.lit(False))


def independence_key(publisher: Column, source_type: Column, author: Column, dims: PublisherDims) -> Column:
    domain = base_domain(publisher)
    owner = _value(_known(domain, sorted(dims.owners)), dims.owners)
    return (
        F.when(source_type == "filing", F.concat(F.lit("filing:"), F.coalesce(F.nullif(domain, F.lit("")), F.lit("sec.gov"))))
        .when(source_type == "social", F.concat(
            F.lit("social:"), F.coalesce(F.nullif(author, F.lit("")), F.nullif(domain, F.lit("")), F.lit("unknown"))))
        .otherwise(F.concat(F.lit("news:"), F.coalesce(owner, domain)))
    )


def is_denial(text: Column, publisher: Column, source_type: Column, author: Column, entity_domains: Column,
              pattern: str, dims: PublisherDims) -> Column:
    """Denial wording from someone entitled to deny; a lookalike never is."""
    from riskloom.functions.text import has_denial

    entitled = is_authoritative(publisher, source_type, dims) | is_official(publisher, entity_domains)
    return has_denial(text, pattern) & ~is_lookalike(publisher, author, dims) & entitled
