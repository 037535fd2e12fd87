"""The driver's contract, and queries against their SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from affinis import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["load_sources", "normalize_text", "transliterated_names", "name_variants", "address_city", "soundex_names", "key_frequency", "candidate_rank", "threshold_sweep", "bucket_impact", "validate_submission", "mixed_pool_counts", "conditional_agg", "macro_f05"]


def rows(frame, columns):
    def plain(x):
        if x is None or x != x:
            return "~"
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, sf).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(5).count() == 5
