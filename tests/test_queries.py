"""Every registered general query runs, and equals its DuckDB oracle where it has one."""

import math

import duckdb
import pytest

from tidewell.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
# oracles whose expected verdicts are written out for tables of sf0.01 and above
LARGER = {"check_cardinality", "suggest_transform", "analyst_flags", "drift_report", "drift_consensus", "route_proposals", "suggest_aggregations", "suggest_encoding", "task_type_detect", "detect_model_leakage", "missingness_mechanism", "semantic_types", "analyst_semantic_types"}


def norm(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.7g}")
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.7g}")
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="session")
def duck():
    cache = {}

    def at(folder):
        if folder not in cache:
            c = duckdb.connect()
            c.execute("SET TimeZone='UTC'")
            for t in registry.TABLES:
                c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
            cache[folder] = c
        return cache[folder]

    return at


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    folder = "/root/testdata/sf0.01" if name in LARGER else sf
    df = QUERIES[name](spark, folder)
    assert len(set(df.columns)) == len(df.columns)
    got = sorted((tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name not in ORACLES:
        return
    cur = duck(folder).execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-5, abs_tol=1e-9), (a, b)
