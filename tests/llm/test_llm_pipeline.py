"""The pipeline against a brute-force version of its stages, on a small fixture."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_components, brute_fingerprint, brute_hits, rows
from tokenizers import Tokenizer

import corpus_pipeline
from tidewell.functions.stages import stash
from tidewell.llm import mixing, quality, queries, simhash


def brute_mix(docs, sizes_weights):
    """Earliest deadline first, slot by slot, over blocks of each source."""
    period, block = mixing.PERIOD, mixing.BLOCK
    given, out, t = {s: 0 for s in docs}, [], 0
    while any(given[s] * block < len(docs[s]) for s in docs):
        ready = [(-(-(given[s] + 1) * period // w), s) for s, w in sizes_weights.items() if given[s] * period // w <= t]
        s = min(ready)[1]
        out += docs[s][given[s] * block : (given[s] + 1) * block]
        given[s] += 1
        t += 1
    return out


def test_pipeline(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r["doc_id"]: r for r in table.collect()}
    good = {r["doc_id"] for r in rows(quality.quality(table, ["doc_id"])) if r["kept"]}
    one = {c for _, _, c in brute_components([(d, brute_fingerprint(docs[d]["text"])) for d in sorted(good)])}
    clean = [d for d, _, n, _ in brute_hits([(d, docs[d]["text"]) for d in sorted(one)], bench) if not n]
    assert len(docs) > len(good) > len(one) >= len(clean) > 50

    left = table.where(F.col("doc_id").isin(clean))
    mixed = sorted(rows(mixing.mix(left, ["doc_id", "text"])), key=lambda r: r["mix_position"])
    weights = {r["src"]: r["weight"] for r in mixing.target_weights(left.groupBy(F.concat(F.lit("="), "source").alias("src")).agg(F.count("*").alias("n"))).collect()}
    by_source = {}
    for r in mixed:
        by_source.setdefault("=" + r["source"], []).append(r["doc_id"])
    order = brute_mix(by_source, weights)
    assert order == [r["doc_id"] for r in mixed]

    tokenizer, at, want = Tokenizer.from_file(queries.WORD_TOKENIZER), 0, []
    for d in order:
        ids = np.array(tokenizer.encode(docs[d]["text"], add_special_tokens=False).ids + [queries.END_ID], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r[k] for k in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in rows(corpus_pipeline.run(spark, sf))]
    assert sorted(got) == sorted(want)


def test_stages_take_odd_and_empty_tables(spark, sf, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("empty", no_docs)):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{name}{k}"
            out = stage(spark, docs, sf)
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (name == "odd")


CLASHES = "_c1 _c2 _l _id n m k b a w src s bucket offset share whole left weight _src _h _bucket _rank d0 d1 p_src p_n mix_block mix_position mix_slot l c1 c2 k0 _t _spans _w root node first component_id other0 other9 item win len start spans a.b".split()


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(name, spark, sf):
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    docs = plain.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    stage = dict(corpus_pipeline.STAGES)[name]
    out, want = stage(spark, docs, sf), stage(spark, plain, sf)
    if name == "token-id output":
        assert sorted(rows(out), key=repr) == sorted(rows(want), key=repr)
        return
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in want.select("doc_id").collect())
    assert all(r[c] == f"{c}:{r['doc_id']}" for r in got for c in CLASHES)


@pytest.mark.parametrize("name", ["near-dedup", "decontamination", "mixing", "token-id output"])
def test_each_stage_takes_raw_odd_rows(name, spark, sf, odd_docs):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert 0 < stage(spark, odd_docs, sf).count() <= odd_docs.count()

@pytest.mark.parametrize("few", [True, False])
def test_anchored_rows_are_never_broadcast(spark, monkeypatch, few):
    """Spark sizes them by the fingerprints from which they are exploded, so at some sizes of input it took them for small."""
    monkeypatch.setattr(simhash, "HOT_ANCHOR", 1)
    if not few:
        monkeypatch.setattr(simhash, "BROADCAST_ANCHORS", 0)
    numbers = spark.range(20_000).select(F.when(F.col("id") < 64, F.col("id")).otherwise(F.xxhash64("id")).alias("fp"))
    found = simhash.links(stash(numbers.withColumn("first", F.col("fp")), "classes"))
    assert {r["count"] for r in simhash.components(found.where("a BETWEEN 0 AND 63")).groupBy("root").count().collect()} == {64}
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BuildLeft" not in plan and plan.count("BuildRight") == (2 if few else 0)
