"""Statistics, drift, model and advisor queries give a defined result on tables without rows, values or spread."""

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewell.plans import registry

QUERIES = registry.queries()
NAMES = sorted(n for n, q in QUERIES.items() if q.__module__.rpartition(".")[2] in ("statistics", "drift", "advisors") or n in {"check_auto_iqr", "profile_outliers", "cardinality_tier", "quality_radar", "zscore_anomaly_summary", "impute_knn", "impute_iterative", "smote", "label_encode", "kmeans_clusters", "calibrate_platt", "evaluate_classification", "evaluate_regression"})


def is_key(name):
    return name.endswith(("key", "_id", "linenumber", "turn"))


def constant(column, kind):
    return pa.array([column[0].as_py()] * len(column), kind)


@pytest.fixture(scope="module")
def folders(tmp_path_factory, sf):
    """The given tables: without rows, with every column but the keys constant, and with all of these null."""
    base = tmp_path_factory.mktemp("degenerate")
    for kind in ("empty", "constant", "nulls"):
        os.makedirs(base / kind)
        for path in glob.glob(f"{sf}/*.parquet"):
            t = pq.read_table(path).slice(0, 0 if kind == "empty" else 300)
            if kind != "empty":
                t = pa.table([c if is_key(f.name) else pa.nulls(len(t), f.type) if kind == "nulls" else constant(c, f.type) for f, c in zip(t.schema, t.columns)], schema=t.schema)
            pq.write_table(t, base / kind / os.path.basename(path))
    return base


@pytest.mark.parametrize("kind", ["empty", "constant", "nulls"])
@pytest.mark.parametrize("name", NAMES)
def test_query_is_defined(name, kind, spark, folders):
    df = QUERIES[name](spark, str(folders / kind))
    assert all(len(r) == len(df.columns) for r in df.collect())
