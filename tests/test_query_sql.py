"""Registered queries of this library against their SQL on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = """j01_customer_filings j02_cashtag_links j03_alias_hits j04_longest_names a03_mentions s05_post_prefilter s02_recorded_feed s14_report_files k01_feed_order
t06_tumbling_stream t07_sliding_stream t08_session_stream a09_entity_index a10_top_story a11_story_counts m22_rumour_updates w16_value_paths m18_slices m18_lexicon_whole
w10_log_returns w14_trailing_volatility s08_market_long f20_url_headlines""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(row):
    """Values that sort alike from both engines; numbers to nine digits."""
    return tuple((0, "") if v is None or (isinstance(v, float) and math.isnan(v)) else (1, f"{float(v):.9g}") if isinstance(v, (int, float, Decimal)) else (2, str(v)) for v in row)


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_the_sql(spark, con, name):
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = entry.queries()[name](spark, SF)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(got.columns) == columns
    rows = sorted(plain(r) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    expected = sorted(plain(r) for r in con.sql(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert len(rows) == len(expected) > 0
    for a, b in zip(rows, expected):
        for x, y in zip(a, b):
            assert x == y or (x[0] == y[0] == 1 and math.isclose(float(x[1]), float(y[1]), rel_tol=1e-6, abs_tol=2e-6)), (a, b)
