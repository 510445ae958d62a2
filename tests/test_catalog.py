"""Queries of the engine's own operators against their SQL on the smallest tables."""

import datetime
import math
from collections import Counter
from pathlib import Path

import pytest

from clauseforge.plans import catalog, catalog_records  # noqa: F401 - registers its queries

DATA = Path("/root/testdata/sf0.001")
QUICK = [
    "ret0_term_df", "ret1_bm25_corpus", "ret1_bm25_scoped", "ret2_dense", "ret3_rrf", "ret8_scoped_question", "lbl_locate", "lbl_relevant_chunks",
    "agg2_chunk_stats", "agg4_question_report", "agg6_repeated_margins", "win7_text_blocks", "chk1_fixed", "chk4_roll_up", "txt17_citations",
    "txt10_unsupported_numbers", "smp2_split", "sel3_far_apart", "str1_sessions", "chk3_sections", "src13_reconcile", "src9_parse_html", "jdg5_score_answers", "snk3_rankings", "txt16_messages",
]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    if not DATA.exists():
        pytest.skip("no test tables here")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(catalog.ORACLE[name])
    names = [x[0] for x in res.description]
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert sorted(names) == cols and got == want


def test_every_sql_has_its_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
