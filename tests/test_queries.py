"""Each registered query against its SQL on the smallest tables."""

import os
from pathlib import Path

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = "freq_list assoc_loglik search_seq2 search_gap_range search_quantified search_overlap search_any_last concordance_chunk spans_bio collocates keywords_ttest dispersion_all msttr vocabulary_growth centroid".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF).exists():
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations", "embeddings", "lineitem"):
        p = Path(SF, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return c


def normal(rows):
    return sorted(tuple("-" if v is None or v != v else f"{float(v):.5g}" if isinstance(v, (int, float)) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    from lexiloom.queries import QUERIES, SQL

    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(SQL[name]).to_arrow_table().select(cols).to_pylist()
    assert normal([[r[c] for c in cols] for r in df.collect()]) == normal([[r[c] for c in cols] for r in want])


def test_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {"collocates_loglik", "search_word"} <= set(names) and set(entry.oracle_sql()) <= set(names)
