"""Publisher dimensions: credibility, authority, ownership and brand tokens."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: credibility by domain ------------------------------------------------------
CREDIBILITY = {
    "sec.gov": 1.0, "federalreserve.gov": 1.0, "rbi.org.in": 1.0, "ecb.europa.eu": 1.0, "treasury.gov": 1.0,
    "fdic.gov": 1.0, "reuters.com": 0.95, "apnews.com": 0.95, "bloomberg.com": 0.95, "wsj.com": 0.9, "ft.com": 0.9,
    "cnbc.com": 0.85, "barrons.com": 0.85, "nytimes.com": 0.85, "marketwatch.com": 0.8, "finance.yahoo.com": 0.75,
    "economictimes.indiatimes.com": 0.8, "livemint.com": 0.8, "business-standard.com": 0.8,
    "thehindubusinessline.com": 0.8, "moneycontrol.com": 0.75, "axios.com": 0.8, "washingtonpost.com": 0.85,
    "bbc.co.uk": 0.85, "bbc.com": 0.85, "theguardian.com": 0.8,
    # stand-in outlets of synthetic packs (reserved .example domains)
    "wire-one.example": 0.95, "wire-two.example": 0.95, "regulator.example": 1.0, "central-bank.example": 1.0,
    "street-journal.example": 0.9, "street-journal-markets.example": 0.85, "biz-times.example": 0.85,
    "markets-tv.example": 0.85, "fin-daily.example": 0.8, "market-daily.example": 0.8, "tech-ledger.example": 0.75,
    "money-post.example": 0.75, "india-wire.example": 0.9, "dalal-desk.example": 0.8,
}
# ---- fixed values: sources that corroborate on their own --------------------------------------
AUTHORITATIVE = (
    "sec.gov", "federalreserve.gov", "rbi.org.in", "ecb.europa.eu", "treasury.gov", "fdic.gov", "reuters.com",
    "apnews.com", "bloomberg.com", "wire-one.example", "wire-two.example", "regulator.example", "central-bank.example",
)
# ---- fixed values: owner of each outlet -------------------------------------------------------
OWNERS = {
    "wsj.com": "dow-jones", "marketwatch.com": "dow-jones", "barrons.com": "dow-jones", "dowjones.com": "dow-jones",
    "cnbc.com": "nbcuniversal", "nbcnews.com": "nbcuniversal", "finance.yahoo.com": "yahoo", "yahoo.com": "yahoo",
    "ft.com": "nikkei", "nikkei.com": "nikkei", "economictimes.indiatimes.com": "times-group",
    "timesofindia.indiatimes.com": "times-group", "livemint.com": "ht-media", "hindustantimes.com": "ht-media",
    "moneycontrol.com": "network18", "cnbctv18.com": "network18", "bbc.co.uk": "bbc", "bbc.com": "bbc",
    "street-journal.example": "street-media", "street-journal-markets.example": "street-media",
}
# ---- fixed values: brand tokens and default scores --------------------------------------------
BRANDS = (
    "reuters", "bloomberg", "apnews", "associatedpress", "wsj", "wallstreetjournal", "cnbc", "marketwatch", "barrons",
    "financialtimes", "nytimes", "federalreserve", "secgov", "wireone", "wiretwo", "streetjournal",
)
DEFAULT_CREDIBILITY = {"news": 0.6, "social": 0.3, "filing": 1.0}
LOOKALIKE_CREDIBILITY = 0.15
# ---- end of fixed values ----------------------------------------------------------------------


@dataclass(frozen=True)
class PublisherDims:
    credibility: dict[str, float] = field(default_factory=lambda: dict(CREDIBILITY))
    authoritative: tuple[str, ...] = AUTHORITATIVE
    owners: dict[str, str] = field(default_factory=lambda: dict(OWNERS))
    brands: tuple[str, ...] = BRANDS


PUBLISHERS = PublisherDims()
