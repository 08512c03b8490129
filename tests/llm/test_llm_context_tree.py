"""Context-tree weighting against a direct recursion over all nodes."""

import math
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest

from tidewell.llm import context_tree, queries
from tidewell.llm.context_tree import DEPTH


def brute_model(texts):
    """The probability of a symbol after DEPTH bytes, by the textbook recursion on every node of every bit's tree."""
    counts = defaultdict(lambda: [0, 0])  # (context from the nearest byte on, node) -> zeros, ones
    children = defaultdict(set)
    for text in texts:
        stream = b"\n" * DEPTH + text
        for i in range(DEPTH, len(stream)):
            context = stream[i - DEPTH : i][::-1]
            for k in range(8):
                node = 1 << k | stream[i] >> (8 - k)
                for d in range(DEPTH + 1):
                    counts[context[:d], node][stream[i] >> (7 - k) & 1] += 1
                    if d:
                        children[context[: d - 1], node].add(context[:d])

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @cache
    def weighted(context, node):
        own = kt(*counts.get((context, node), (0, 0)))
        if len(context) == DEPTH:
            return own
        down = sum(weighted(c, node) for c in children.get((context, node), ()))
        top = max(own, down)
        return top + math.log((math.exp(own - top) + math.exp(down - top)) / 2)

    @cache
    def one(context, node, depth=0):
        own = context[:depth]
        a, b = counts.get((own, node), (0, 0))
        here = (b + 0.5) / (a + b + 1)
        if depth == DEPTH:
            return here
        w = math.exp(kt(a, b) - math.log(2) - weighted(own, node))
        return w * here + (1 - w) * one(context, node, depth + 1)

    def log10(context, symbol):
        p = 0.0
        for k in range(8):
            x = one(context, 1 << k | symbol >> (8 - k))
            p += math.log10(x if symbol >> (7 - k) & 1 else 1 - x)
        return p

    return log10


def brute(rows):
    """(doc_id, text) rows -> the expected result rows."""
    out, words, streams = [], Counter(), []
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    cut = [(i, (t or "").encode().lower().split()) for i, t in rows]
    for i, ws in cut:
        if not held(i):
            words.update(ws)
            words["end"] += 1  # words are bytes, so this string is no word
            streams.append(b" ".join(ws) + b"\n")
    model, total, distinct = brute_model(streams), sum(words.values()), len(words)
    for i, ws in cut:
        stream = b"\n" * DEPTH + b" ".join(ws) + b"\n"
        score = sum(model(stream[k - DEPTH : k][::-1], stream[k]) for k in range(DEPTH, len(stream)))
        tokens = [*ws, "end"]
        out.append((i, held(i), len(tokens), sum(words[w] > 0 for w in tokens), total, sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in tokens), score))
    return out


def same(df, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2:])
    got, want = sorted((tuple(r) for r in df.collect()), key=key), sorted(brute(rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-6), (a, b)


SAMPLE = [
    (1, "the cat sat on the mat"),
    (2, "The  CAT\tsat on\nthe hat"),
    (2, "the cat sat on the mat"),
    (3, None),
    (4, ""),
    (None, "no number here"),
    (5, " \n\t "),
    (6, "ÉÀ ß 中文 😀"),
    (7, "zzz zzz zzz zzz"),
    (8, "abracadabra " * 30),
    *[(i, f"the cat number {i} sat on mat {i % 7}") for i in range(9, 60)],
]


def test_scores_equal_the_recursion(spark):
    docs = spark.createDataFrame(SAMPLE, "doc_id long, text string").selectExpr("*", "doc_id AS block", "text AS gram", "1 AS held_out", "2 AS k0")
    same(context_tree.score_texts(docs, ["doc_id"]), SAMPLE)


def test_blocks_and_pieces_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(SAMPLE, "doc_id long, text string").repartition(3)
    same(context_tree.score_texts(docs, ["doc_id"], block_bytes=100), SAMPLE)


def test_no_documents_and_none_to_learn_from(spark, no_docs):
    assert context_tree.score_texts(no_docs, ["doc_id"]).count() == 0
    kept_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = context_tree.score_texts(spark.createDataFrame([(kept_out, "ab c")], "doc_id long, text string"), ["doc_id"]).first()
    assert (got["n_tokens"], got["n_known"], got["train_tokens"], got["base_score"]) == (3, 0, 0, 0.0)
    assert got["score"] == pytest.approx(5 * 8 * math.log10(0.5))


def test_odd_documents(odd_docs):
    got = context_tree.score_texts(odd_docs, ["doc_id", "c1", "c1"])
    assert got.columns[:3] == ["doc_id", "c1", "c1"]
    rows = got.collect()
    assert len(rows) == odd_docs.count() and all(r["score"] < 0 and r["base_score"] < 0 for r in rows)


def test_pieces_of_a_long_text(monkeypatch):
    import numpy as np

    texts = [[b"ab", b"c"], [b"word"] * 200, [], [b"x"] * 3]
    whole = {i: np.concatenate([k for _, k, _ in context_tree.pieces([t])]) for i, t in enumerate(texts)}
    monkeypatch.setattr(context_tree, "PIECE", 64)
    parts = defaultdict(list)
    for own, keys, starts in context_tree.pieces(texts):
        for i, part in zip(own, np.split(keys, starts[1:])):
            parts[i].append(part)
    for i in whole:
        assert np.array_equal(np.concatenate(parts[i]), whole[i])


def test_probabilities_of_symbols_sum_to_one():
    model = brute_model([b"the cat sat on the mat\n", b"abracadabra\n"])
    assert sum(10 ** model(b"eht \n", s) for s in range(256)) == pytest.approx(1)


def test_code_length_of_kept_out_texts(spark, sf):
    sizes = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "octet_length(text) AS size").distinct()
    got = queries.op13_context_tree(spark, sf).where("held_out").join(sizes, "doc_id").selectExpr("-sum(score) / log10(2) / sum(size) AS bits").first()
    assert got["bits"] < 3  # for each byte
