"""The filter audit against SQL, against brute force over documents, and the walk against direct subset sums."""

from itertools import permutations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import filter_audit, oracles, queries


def brute(docs, labels):
    """(doc_id, text, source) and (doc_id, quality, toxic) rows -> the expected rows, by applying each order to the documents."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    parts = {}
    for i, text, source in docs:
        text = text or ""
        words = text.encode().split()
        fails = ""
        fails += "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text))
        fails += "D" * any(c in "#$%&*|" for c in text)
        fails += "E" * (i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs))
        parts.setdefault(source or "", []).append((i, fails))
    out = []
    for part, own in parts.items():
        rows, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                earlier = sum(f in x[1] for x in own) - len(gone)
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                alone = sum(x[1] == f for x in own)
                rows.append((part, "".join(order), step, len(left), len(gone), earlier, alone, sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f))
        out += [(*r[:9], total[r[9]]) for r in rows]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def found(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({oracles.oracle_sql()['op12_filter_audit']})").fetchall()
    got = queries.op12_filter_audit(spark, folder)
    assert dict(got.dtypes) | {"step": "int"} == dict(got.dtypes) and found(got) == sorted(want)


def test_odd_documents_equal_brute_force(spark, odd_docs):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (None, 1, 1), (99, 1, 1), (8, 1, 1)]
    docs = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    odd = odd_docs.selectExpr("*", "doc_id AS part", "doc_id AS mask", "text AS words")
    assert found(filter_audit.audit(odd, marks)) == brute(docs, [x for x in labels if x[0] is not None])


def test_no_documents_and_no_labels(spark, no_docs, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(no_docs, labels).count() == 0
    assert {(r["good_lost"], r["toxic_lost"]) for r in filter_audit.audit(odd_docs, labels).collect()} == {(0, 0)}


def test_walk_equals_subset_sums():
    counts = np.random.default_rng(3).integers(0, 50, (4, 32, 3))
    states = filter_audit.survivors(counts)
    for subset in range(32):
        assert np.array_equal(states[:, subset], counts[:, (np.arange(32) & subset) == 0].sum(axis=1))


def test_filters_of_ones_own(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = filter_audit.audit(odd_docs, labels, {"N": F.size("words") == 0}).where("part = 'a'").collect()
    assert {(r["filter_order"], r["step"]) for r in out} == {("NE", 1), ("NE", 2), ("EN", 1), ("EN", 2)}
