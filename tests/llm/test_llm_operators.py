"""The training-data operators against brute force, exact round trips and odd inputs."""

import base64
import gzip
import hashlib
import io
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import chat, chunk_levels, decontaminate, langid, line_chunks, mixing, packed_ids, quality, queries, simhash, substrings, warc


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- quality -------------------------------------------------------------------------------------------------------------


def brute_base(text):
    words = [w for part in (text or "").encode().split() for w in [part.decode()]]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


@pytest.mark.parametrize("name", ["documents", "odd_docs"])
def test_quality_counts(name, request):
    docs = request.getfixturevalue(name)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"])
    found = defaultdict(list)
    for r in rows(quality.quality(docs, ["doc_id"])):
        found[r["doc_id"]].append(r)
    for doc, own in texts.items():
        want = sorted((tuple(brute_base(t).values()) for t in own))
        got = sorted(tuple(r[k] for k in brute_base("")) for r in found[doc])
        assert got == want, doc
        for r in found[doc]:
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])


def test_quality_rejects_junk_and_keeps_prose(spark):
    prose = "the cat sat on the mat and it was not for this or that but with the dog in the house to be of use "
    good = [(i, prose * 1 + " ".join(f"word{i}{j} of the" for j in range(60)), "en") for i in range(50)]
    junk = [(100, " ".join("%%% ###" for _ in range(200)) + " x".join(str(i) for i in range(99)), "en")]
    got = {r["doc_id"]: r for r in rows(quality.quality(spark.createDataFrame(good + junk, "doc_id long, text string, lang string"), ["doc_id"]))}
    assert all(got[i]["kept"] for i in range(50)) and not got[100]["kept"]


def test_quality_empty(no_docs):
    assert quality.quality(no_docs, ["doc_id"]).count() == 0


# --- mixing --------------------------------------------------------------------------------------------------------------


def test_mixing_deviates_less_than_a_block(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    weights = {r["src"]: r["weight"] / mixing.PERIOD for r in mixing.target_weights(df.groupBy(F.col("source").alias("src")).agg(F.count("*").alias("n"))).collect()}
    assert sum(weights.values()) == pytest.approx(1)
    got = sorted(rows(mixing.mix(df, ["doc_id"])), key=lambda r: r["mix_position"])
    assert [r["mix_position"] for r in got] == list(range(9000))
    assert len({r["doc_id"] for r in got}) == 9000
    balanced = [r for r in got if r["mix_balanced"]]
    assert balanced == got[: len(balanced)] and len(balanced) > 3000
    given, slot = Counter(), 0
    for r in balanced[:: mixing.BLOCK]:
        given[r["source"]] += 1
        slot += 1
        assert all(abs(given[s] - w * slot) < 1 for s, w in weights.items())


def test_mixing_odd(odd_docs, no_docs):
    got = rows(mixing.mix(odd_docs, ["doc_id", "text"]))
    assert sorted(r["mix_position"] for r in got) == list(range(odd_docs.count()))
    assert mixing.mix(no_docs, ["doc_id"]).count() == 0


def test_mixing_takes_more_sources_than_slots(spark):
    sources = 1100
    df = spark.range(3 * sources).select(F.col("id").alias("doc_id"), F.when(F.col("id") < sources, F.concat(F.lit("s"), F.col("id").cast("string"))).otherwise("hot").alias("source"))
    weights = {r["src"]: r["weight"] for r in mixing.target_weights(df.groupBy(F.col("source").alias("src")).agg(F.count("*").alias("n"))).collect()}
    assert len(weights) == sources + 1 and min(weights.values()) == 1 and sum(weights.values()) == 2 * mixing.PERIOD
    got = rows(mixing.mix(df, ["doc_id"]))
    assert sorted(r["mix_position"] for r in got) == list(range(3 * sources))
    assert len({r["doc_id"] for r in got}) == 3 * sources
    slots = {(r["mix_slot"], r["source"], r["mix_block"]) for r in got}
    assert len({s for s, _, _ in slots}) == len(slots)


def test_mixing_takes_blocks_beyond_a_longer_period(spark):
    df = spark.range(700).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, F.concat(F.lit("s"), (F.col("id") % 20).cast("string"))).otherwise("hot").alias("source"))
    got = sorted(rows(mixing.mix(df, ["doc_id"], block=1, period=10)), key=lambda r: r["mix_position"])
    assert [r["mix_position"] for r in got] == list(range(700))
    assert [r["mix_slot"] for r in got] == sorted({r["mix_slot"] for r in got}) and got[-1]["mix_slot"] > 30


def test_mixing_keeps_sources_without_a_weight(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"))
    for given, period in (([("s0", 600), ("s1", 400)], 1002), ([("s0", 600), ("s1", 100), ("gone", 300)], 1000)):
        weights = spark.createDataFrame(given, "src string, weight int")
        got = sorted(rows(mixing.mix(df, ["doc_id"], weights=weights, block=1)), key=lambda r: r["mix_position"])
        assert [r["mix_position"] for r in got] == list(range(2000))
        slots = [r["mix_slot"] for r in got if r["source"] == "s3"]
        assert {b - a for a, b in zip(slots, slots[1:])} == {period}
    with pytest.raises(Exception, match="weight under 1 of source =s1"):
        mixing.mix(df, ["doc_id"], weights=spark.createDataFrame([("s0", 600), ("s1", 0)], "src string, weight int")).collect()


# --- simhash -------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, size=3):
    words = [w.decode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Of (doc, fingerprint) pairs: the smallest doc reachable, for each pair."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(fps):
        r = find(i)
        least[r] = min([x for x in (least.get(r), doc) if x is not None], default=None)
    return [(doc, fp, least[find(i)]) for i, (doc, fp) in enumerate(fps)]


key = lambda x: tuple((v is not None, v) for v in x)


@pytest.mark.parametrize("name", ["documents", "odd_docs"])
def test_simhash(name, request):
    docs = request.getfixturevalue(name)
    want = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()])
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in rows(simhash.near_duplicates(docs))]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_anchors_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():  # chains of 0 to 3 flipped bits, some of them dense
        at = b
        for _ in range(rng.integers(1, 25)):
            for bit in rng.choice(64, rng.integers(0, 4), replace=False):
                at ^= 1 << int(bit)
            fps.add(at)
    center = int(base[0])  # a dense group around one anchor
    fps |= {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))}
    fps = sorted(fps)
    want = {fp: c for _, fp, c in brute_components(list(zip(range(len(fps)), fps)))}
    frame = spark.createDataFrame([(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in fps], "fp long")
    for hot in (1024, 8):
        monkeypatch.setattr(simhash, "HOT_ANCHOR", hot)
        edges = simhash.links(frame)
        roots = {r["node"] % 2**64: r["root"] for r in simhash.components(edges).collect()}
        groups = defaultdict(set)
        for f in fps:
            groups[roots.get(f, f"own{f}")].add(f)
        brute = defaultdict(set)
        for f, c in want.items():
            brute[c].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))
        assert edges.count() < 64 * len(fps)


def test_near_dedup_keeps_one_of_each(odd_docs):
    kept = rows(simhash.drop_near_duplicates(odd_docs))
    comps = {c for _, _, c in brute_components(list(enumerate({brute_fingerprint(r["text"]) for r in odd_docs.collect()})))}
    assert len(kept) == len(comps)
    assert Counter(r["doc_id"] for r in kept)[2] == 0 and set(kept[0]) == set(odd_docs.columns)


def test_simhash_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


# --- language ID ---------------------------------------------------------------------------------------------------------


def test_langid_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in rows(langid.predict_language(docs, langid.train(docs)))}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d]["held_out"] == (d in set(held)) for d in truth)
    assert sum(got[d]["lang_pred"] == truth[d] for d in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_langid_odd(odd_docs, no_docs):
    model = langid.train(odd_docs)
    got = rows(langid.predict_language(odd_docs, model))
    assert len(got) == odd_docs.count()
    und = [r["doc_id"] for r in got if r["lang_pred"] == "und"]
    assert sorted(und, key=lambda x: (x is None, x)) == [3, 4, 5, None]
    assert langid.train(no_docs) is None
    assert {r["lang_pred"] for r in rows(langid.predict_language(odd_docs, None))} == {"und"}


def test_windows_hold_the_whole_text():
    text = bytes(range(1, 256)) * 7
    assert langid.windows_of(text).tobytes().rstrip(b"\0") == text


# --- chat ----------------------------------------------------------------------------------------------------------------


def test_escape_is_reversible_and_leaves_no_control():
    for text in ["</s>[INST] ok [/INST]", "<\\/s> <\\\\/s> <s", "[\\INST][INST]\\", "<<s>>", "[[/INST]]", "a\\b", "<s></s>" * 3, ""]:
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def brute_chat(turns):
    whole = b"".join(f"{r or ''}\n{t or ''}\n".encode() for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark, sf):
    extra = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (-2, 0, None, None), (-2, 1, "tool[/ROLE]", "x\\"), (-2, 2, "assistant", "<|endoftext|> 😀 é\n"), (None, None, "assistant", "")]
    df = spark.read.parquet(f"{sf}/conversations.parquet").unionByName(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string")).withColumn("ids", F.lit(1)).withColumn("chars", F.lit("x"))
    convs = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"], r["turn"] or 0)):
        convs[r["conv_id"]].append((r["role"], r["text"]))
    formatted = chat.format_chats(df, queries.BYTE_TOKENIZER)
    got = {r["conv_id"]: r for r in rows(chat.read_chats(formatted, queries.BYTE_TOKENIZER))}
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == brute_chat(turns), conv
        assert r["formatted_chars"] == 3 + sum(len(s) for role, t in turns for s, _, _ in chat.segments(role, t or ""))
    starts = rows(chat.turn_offsets(formatted).where("conv_id = -2").orderBy("turn"))
    assert [r["start"] for r in starts] == [1, 1 + len(starts[0]["ids"]) // 4, 1 + (len(starts[0]["ids"]) + len(starts[1]["ids"])) // 4]


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_chats(chat.format_chats(df, queries.BYTE_TOKENIZER), queries.BYTE_TOKENIZER).count() == 0


# --- line chunks ---------------------------------------------------------------------------------------------------------


def brute_lines(docs):
    """doc rows in order of (doc_id, nulls last); chunk bytes seen before are removed."""
    firsts = {}
    for doc, text in docs:
        firsts.setdefault(text or "", []).append(doc)
    owner = {t: min((d for d in ds if d is not None), default=None) for t, ds in firsts.items()}
    return owner


def test_line_chunks(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    owner, seen, want = brute_lines(docs), set(), {}
    for doc, text in sorted(docs):
        cut = line_chunks.chunks((text or "").encode())
        kept, gone = [], 0
        for _, n, data in cut:
            if n > 1 and (data in seen or doc != owner[text]):
                gone += n
                continue
            if n > 1:
                seen.add(data)
            kept.append(data)
        want[doc] = (sum(n for _, n, _ in cut), gone, hashlib.sha256(b"\n".join(kept)).hexdigest())
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in rows(line_chunks.dedup_lines(documents))}
    assert got == want


def test_boundaries_resist_shifts():
    lines = [f"line {i} {i * i}".encode() for i in range(400)]
    a = {d for _, _, d in line_chunks.chunks(b"\n".join(lines))}
    b = {d for _, _, d in line_chunks.chunks(b"\n".join([b"new", *lines[:200], b"more", *lines[200:]]))}
    assert len(a & b) > 0.8 * len(a)
    for text in (b"", b"\n", b"x", b"\n".join(lines), b"a\n" * 100):
        cut = line_chunks.chunks(text)
        assert b"\n".join(d for _, _, d in cut) == text and all(n <= line_chunks.MOST for _, n, _ in cut)


def test_line_chunks_odd(odd_docs, no_docs):
    got = rows(line_chunks.dedup_lines(odd_docs, with_text=True))
    assert len(got) == odd_docs.count()
    assert line_chunks.dedup_lines(no_docs).count() == 0


def removed_pairs(docs):
    """{doc: (lines, removed line numbers)} over distinct texts in order of doc_id, by a set of pairs."""
    firsts, out = {}, {}
    for doc, text in docs:
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - 1):
            at = firsts.setdefault((lines[i], lines[i + 1]), (doc, i))
            if at != (doc, i):
                gone |= {i + 1} if at == (doc, i - 1) else {i, i + 1}
        out[doc] = lines, gone
    return out


def caught_share(cut, least):
    """Of the lines in later occurrences of runs of ``least`` lines and 10 words or more: (removed, all)."""
    seen, caught, total = {}, 0, 0
    for doc, (lines, gone) in cut.items():
        again = set()
        for i in range(len(lines) - least + 1):
            first = seen.setdefault(tuple(lines[i : i + least]), (doc, i))
            if first[0] != doc or first[1] + least <= i:
                again |= set(range(i, i + least))
        starts = [i for i in sorted(again) if i - 1 not in again]
        for i in starts:
            run = range(i, next(j for j in range(i, len(lines) + 1) if j not in again))
            if sum(len(lines[j].split()) for j in run) >= 10:
                caught, total = caught + len(gone.intersection(run)), total + len(run)
    return caught, total


@pytest.fixture(scope="session")
def once(documents):
    """(doc_id, text) of each distinct text, in order."""
    found = {}
    for r in sorted(documents.collect(), key=lambda r: r["doc_id"]):
        found.setdefault(r["text"] or "", r["doc_id"])
    return [(d, t) for t, d in found.items()]


def test_pairs_remove_every_repeated_run_of_lines(spark, documents, once):
    cut, owner = removed_pairs(once), {t: d for d, t in once}
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in rows(line_chunks.dedup_lines(documents, pairs=True))}
    for doc, (lines, gone) in cut.items():
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        assert got[doc] == (len(lines), len(gone), hashlib.sha256(kept.encode()).hexdigest()), doc
    for r in documents.collect():
        n = len((r["text"] or "").split("\n"))
        assert r["doc_id"] == owner[r["text"] or ""] or got[r["doc_id"]][:2] == (n, n if n > 1 else 0)


def removed_lines(lines, kept):
    """Numbers of the lines that are not in ``kept``, a subsequence of ``lines``."""
    gone, at = set(), 0
    for i, x in enumerate(lines):
        if at < len(kept) and kept[at] == x:
            at += 1
        else:
            gone.add(i)
    assert at == len(kept)
    return gone


def test_op6_removes_repeated_runs_of_lines(spark, sf, documents, once):
    """Levels of chunks with growth catch at least 90 % of the lines in repeated runs, and only such lines."""
    exact = removed_pairs(once)
    found = {r["doc_id"]: r for r in rows(chunk_levels.dedup_chunks(documents, with_text=True))}
    digests = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in rows(queries.op6_line_chunks(spark, sf))}
    assert digests == {d: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for d, r in found.items()}
    cut = {}
    for doc, (lines, gone) in exact.items():
        r = found[doc]
        assert r["kept_sha256"] == hashlib.sha256(r["kept_text"].encode()).hexdigest()
        assert r["n_removed"] <= len(gone)
        kept = r["kept_text"].split("\n") if r["n_removed"] < len(lines) else []
        cut[doc] = lines, removed_lines(lines, kept)
    shares = {}
    for least in (2, 4, 6):
        caught, total = caught_share(cut, least)
        shares[least] = caught / total if total else 1.0
    print("share of repeated lines removed", shares)
    assert min(shares.values()) >= 0.9


def test_op6_grows_matches_and_keeps_first_places(spark):
    rng = np.random.default_rng(8)
    line = lambda k: f"line {k} of some words {k * 7919 % 1000}"
    run = [line(k) for k in range(30)]
    texts = ["\n".join([line(100), *run, line(101)]), "\n".join([*run, line(102)]), "\n".join([line(103 + i) for i in range(3)] + run[3:]), "a\na\na\na\na", "one", "one", "\n".join([line(100), *run, line(101)]), None, "", "\n"]
    for _ in range(5):
        texts.append("\n".join(line(int(k)) for k in rng.integers(200, 230, 40)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in rows(chunk_levels.dedup_chunks(docs, with_text=True))}
    assert [got[i] for i in range(10)] == [texts[0], line(102), "\n".join(line(103 + i) for i in range(3)), "a\na", "one", "one", "", "", "", "\n"]
    exact = removed_pairs([(i, t or "") for i, t in enumerate(texts) if i > 9])
    for i, (lines, gone) in exact.items():
        removed_lines(lines, got[i].split("\n"))
        assert len(lines) - len(got[i].split("\n")) <= len(gone)


def test_op6_forced_collisions_remove_nothing(spark, monkeypatch):
    monkeypatch.setattr(chunk_levels, "line_hashes", lambda texts: (np.zeros(sum(t.count(b"\n") + 1 for t in texts), np.uint64), np.concatenate([[0], np.cumsum([t.count(b"\n") + 1 for t in texts])]).astype(np.int64)))
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "d\ne\nf")], "doc_id long, text string")
    assert {r["n_removed"] for r in rows(chunk_levels.dedup_chunks(docs))} == {0}


def test_op6_odd(odd_docs, no_docs):
    assert len(rows(chunk_levels.dedup_chunks(odd_docs, with_text=True))) == odd_docs.count()
    assert chunk_levels.dedup_chunks(no_docs).count() == 0


def test_line_pairs_keep_first_places(spark):
    run = "a longer line\nand the next one"
    texts = [f"x\n{run}\ny", f"{run}\nz", f"new\n{run}", "a\na\na\na", "one", "one", "y\nz\ny\nz", f"x\n{run}\ny", None, "", "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in rows(line_chunks.dedup_lines(docs, with_text=True, pairs=True))}
    assert got == dict(enumerate([texts[0], "z", "new", "a\na", "one", "one", "y\nz", "", "", "", "\n"]))


def test_line_pairs_odd(odd_docs, no_docs):
    assert len(rows(line_chunks.dedup_lines(odd_docs, with_text=True, pairs=True))) == odd_docs.count()
    assert line_chunks.dedup_lines(no_docs, pairs=True).count() == 0


# --- substrings ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["documents", "odd_docs"])
def test_substrings(name, request):
    docs = request.getfixturevalue(name)
    texts = [(r["doc_id"], (r["text"] or "").encode().split()) for r in docs.collect()]
    count = Counter(tuple(w[i : i + 35]) for _, w in texts for i in range(len(w) - 34))
    want = []
    for doc, w in texts:
        gone = {i + j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(35)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substrings.cut_repeats(docs, ["doc_id"]))]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_window_hashes_depend_on_the_window_alone():
    h = np.random.default_rng(0).integers(0, 2**63, 200).astype(np.uint64)
    for size in (1, 2, 8, 28, 35):
        found = substrings.window_hashes(h, size)
        assert len(found) == 200 - size + 1
        assert all(substrings.window_hashes(h[i : i + size], size)[0] == found[i] for i in (0, 77, 200 - size))


def test_substrings_empty(no_docs):
    assert substrings.cut_repeats(no_docs, ["doc_id"]).count() == 0


# --- WARC ----------------------------------------------------------------------------------------------------------------


def test_warc(spark, sf):
    odd = [(1000, "http://x/\r\ny", None), (1001, None, ""), (1002, "u", "same"), (1003, "u", "same"), (1003, "u", "same"), (None, "u", "same"), (None, None, None), (1004, "u", "é" * 100000)]
    pages = spark.read.parquet(f"{sf}/pages.parquet").unionByName(spark.createDataFrame(odd, "page_id long, url string, html string")).withColumn("digest", F.lit(1)).withColumn("path", F.lit("p"))
    table = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    least = {}
    for p, data in table:
        if p is not None:
            least[data] = min(least.get(data, p), p)
    want, seen = [], set()
    for p, data in sorted(table, key=key):
        first = p is None or least[data] == p and (p, data) not in seen
        seen.add((p, data))
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else least[data]))
    manifest = warc.write_warc(pages, roll_bytes=20_000)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(warc.read_warc(manifest))]
    assert sorted(got, key=key) == sorted(want, key=key)
    files = rows(manifest)
    assert len(files) > 4 and sum(f["n_records"] for f in files) == len(table)
    for f in files:
        data = open(f["path"].removeprefix("file:").replace("///", "/"), "rb").read()
        assert hashlib.sha256(data).hexdigest() == f["sha256"] and len(data) == f["n_bytes"]
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") >= f["n_records"]
    again = rows(warc.write_warc(pages, roll_bytes=20_000))
    assert sorted(f["sha256"] for f in again) == sorted(f["sha256"] for f in files)
    assert warc.read_warc(warc.write_warc(pages.where("false"))).count() == 0


def test_warc_reader_refuses_cut_archives():
    data = gzip.compress(warc.record_bytes(1, "u", b"body", None, False, warc.DATE))
    assert [b for _, b in warc.read_records(io.BytesIO(data))][0].endswith(b"body")
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-9])))


# --- decontamination -----------------------------------------------------------------------------------------------------


def norm(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(docs, bench, size=10):
    windows = defaultdict(set)
    for item, text in bench:
        w = norm(text)
        n = min(len(w), size)
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, items = norm(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(items)))
    return out


def test_decontamination(spark, odd_docs, documents, sf):
    bench = spark.createDataFrame([(1, "Word3 WORD4, word5; word6 word7 word8 word9 word10 word11 word12 word13"), (2, "one-two"), (3, None), (4, "..."), (5, "中文"), (6, "word3 word4 word5 word6 word7 word8 word9 word10 word11 word12"), (7, "a b a")], "item_id long, text string")
    for docs, items in ((odd_docs, bench), (documents, spark.read.parquet(f"{sf}/benchmark.parquet")), (documents, bench.where("false"))):
        want = brute_hits([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
        got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows(decontaminate.contamination(docs, items, ["doc_id"]))]
        assert sorted(got, key=key) == sorted(want, key=key)
        clean = rows(decontaminate.drop_contaminated(docs, items))
        assert sorted(((r["doc_id"],) for r in clean), key=key) == sorted(((w[0],) for w in want if not w[2]), key=key)


def test_decontamination_cuts_spans(spark, odd_docs):
    bench = spark.createDataFrame([(1, "word3 word4 word5 word6 word7 word8 word9 word10 word11 word12")], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in rows(decontaminate.remove_spans(odd_docs.where("doc_id in (1, 7)"), bench))}
    assert got[7] == "one two" and got[1].split() == [f"word{i}" for i in range(60) if not 3 <= i <= 12]


# --- packed ids ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("vocabulary", [2, 256, 300, 49408, 50257, 65536, 100000])
def test_bit_packing(vocabulary):
    width = packed_ids.width_of(vocabulary)
    assert (vocabulary - 1).bit_length() == width
    ids = np.random.default_rng(1).integers(0, vocabulary, 1001).astype(np.uint32)
    data = packed_ids.pack(ids, width)
    assert len(data) == -(-1001 * width // 8)
    assert (packed_ids.unpack(data, 1001, width) == ids).all()


def test_shard_random_access():
    out = io.BytesIO()
    out.close, close = lambda: None, out.close
    writer = packed_ids.ShardWriter(out, 17, 64)
    rng = np.random.default_rng(2)
    docs = [(d, rng.integers(0, 2**17, n).astype(np.uint32)) for d, n in [(5, 0), (None, 1), (7, 64), (8, 1000), (8, 3), (9, 0)]]
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    size = out.tell()
    reader = packed_ids.ShardReader(out, size)
    whole = np.concatenate([x for _, x in docs])
    assert [(d, s, x.tolist()) for d, s, x in reader.documents()] == [(d, sum(len(y) for _, y in docs[:i]), x.tolist()) for i, (d, x) in enumerate(docs)]
    for a, b in ((0, 0), (0, 1), (63, 65), (100, 900), (0, len(whole))):
        assert (reader.ids(a, b) == whole[a:b]).all()
    with pytest.raises(ValueError):
        packed_ids.ShardReader(io.BytesIO(out.getvalue()[:-1]), size - 1)
    close()


def test_word_encoder_equals_whole_encoding(documents):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoder = packed_ids.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), memo_words=500)
    odd = ["", " ", "it's I'LL don't' '", "ΟΔΟΣ Σ ς", "é é ́x İI ıß", "<|endoftext|> a<|startoftext|>b", "1234 ½x a1b2", "x y z​", "foo...bar, (baz)! $$$ %%% naïve, ÉCOLE.", "日本語 텍스트 😀👍🏽", "÷x× aªº µ", "a\x00b\x1fc", "ﬁ Ⅷ ǅ"]
    for text in odd + [r["text"] for r in documents.limit(60).collect()]:
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text[:80]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_encoder_on_random_mixes(name):
    """Any tokenizer gets the library's ids, also for control strings in other spellings and letters with loose marks."""
    import random

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    encoder = packed_ids.WordEncoder(public_tokenizers.path(name), memo_words=300)
    assert encoder.by_words == name.startswith("word")
    random.seed(5)
    odd = [*map(chr, range(1, 0x180)), *"ΣςK\u030c\u0301\u0307\u2028\u3000\ufeff日😀½²", "J\u030c", "h\u0331", "<|endoftext|>", "<|ENDOFTEXT|>x", "<|", "'LL", "n't", " ", "\n"]
    for _ in range(4000):
        text = "".join(random.choice(odd) if random.random() < 0.4 else random.choice("abcdeTHE'.,!-<|> é\tüß09") for _ in range(random.randint(0, 30)))
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", ["documents", "odd_docs"])
def test_packed_output(name, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(name)
    whole = Tokenizer.from_file(queries.WORD_TOKENIZER)
    got = sorted(rows(packed_ids.read_packed(packed_ids.write_packed(docs, queries.WORD_TOKENIZER, 1, block_ids=512, shard_ids=3000))), key=lambda r: r["start"])
    coded = defaultdict(list)
    for r in docs.collect():
        ids = np.array(whole.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        coded[r["doc_id"]].append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda x: (x is not None, x))
    at, seen = 0, defaultdict(list)
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        seen[r["doc_id"]].append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in coded.items()}


def test_packed_empty(no_docs):
    assert packed_ids.read_packed(packed_ids.write_packed(no_docs, queries.WORD_TOKENIZER, 1)).count() == 0


def test_decontamination_of_a_very_long_text_takes_linear_time(spark):
    import time

    n = 1_000_000
    text = " ".join(f"u{i % 9973}v{i}" for i in range(n))
    passage = " ".join(f"bench{i}" for i in range(30))
    words = text.split(" ")
    words[n - 5 : n - 5] = passage.split(" ")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, passage + " " + passage), (3, "a short one")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage), (8, "short one")], "item_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench, ["doc_id"]).collect()}
    kept = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert time.time() - began < 60
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) for i in (1, 2, 3)] == [(n + 30, 30, ["7"]), (60, 60, ["7"]), (3, 2, ["8"])]
    assert kept == {1: text, 2: "", 3: "a"}


def test_decontamination_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "STRETCH", 7)
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcd"), int(n))) for n in rng.integers(0, 120, 40)]
    items = [" ".join(rng.choice(list("abcd"), int(n))) for n in (1, 3, 4, 5, 5, 12)][1:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for size in (4, 5):
        got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, bench, ["doc_id"], size).collect()}
        cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench, size).collect()}
        for i, text in enumerate(texts):
            w, hit, found = text.split(), set(), set()
            for k, item in enumerate(items):
                b = item.split()
                n = min(size, len(b))
                wins = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)}
                at = [j for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in wins]
                hit |= {j + d for j in at for d in range(n)}
                found |= {str(k)} if at else set()
            assert got[i] == (len(hit), sorted(found))
            assert cut[i] == (" ".join(x for j, x in enumerate(w) if j not in hit) if hit else text)


def test_mixing_of_twenty_thousand_sources(spark):
    sources = 20_000
    # one large source, some of middling size and very many of a row or three
    many = spark.range(3 * sources).select("id", F.format_string("s%05d", F.col("id") % sources).alias("source"))
    df = many.unionByName(spark.range(100_000, 130_000).select("id", F.format_string("big%02d", F.floor(F.pow(F.rand(4), 3) * 20)).alias("source")))
    n = df.count()
    got = mixing.mix(df, ["id"], block=1).toPandas().sort_values("mix_position")
    assert len(got) == n and list(got["mix_position"]) == list(range(n))
    sizes = df.groupBy(F.col("source").alias("src")).agg(F.count("*").alias("n"))
    weights = {r["src"]: r["weight"] for r in mixing.target_weights(sizes).collect()}
    period = sum(weights.values())
    assert len(weights) == sources + 20 and period == 21 * mixing.PERIOD
    balanced = got[got["mix_balanced"]]
    assert len(balanced) > period
    given = Counter()
    for t, source in zip(balanced["mix_slot"], balanced["source"]):
        assert abs(given[source] - t * weights[source] / period) < 1
        given[source] += 1


def test_byte_cnn_equals_plain_loops():
    rng = np.random.default_rng(4)
    labels = ["de", "en", "fr"]
    total = langid.FILTERS * len(langid.WIDTHS)
    model = langid.ByteCNN(labels, rng.normal(size=(256, langid.DEPTH)).astype(np.float32), [rng.normal(size=(w * langid.DEPTH, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS], rng.normal(size=total).astype(np.float32), rng.normal(size=(total, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    texts = [b"", b"a", bytes(rng.integers(0, 256, 100).tolist()), bytes(rng.integers(0, 256, 700).tolist())]
    for text, (label, score) in zip(texts, model.predict(texts)):
        windows = [text[i : i + langid.WINDOW] for i in range(0, len(text), langid.WINDOW)] or [b""]
        mean, weights = np.zeros(3), 0
        for window in windows:
            e = [model.embed[b] for b in window.ljust(langid.WINDOW, b"\0")]
            pooled = []
            for w, kernel in zip(langid.WIDTHS, model.kernels):
                for f in range(langid.FILTERS):
                    pooled.append(max(sum(float(e[i + j] @ kernel[j * langid.DEPTH : (j + 1) * langid.DEPTH, f]) for j in range(w)) for i in range(langid.WINDOW - w + 1)))
            z = np.maximum(np.array(pooled) + model.bias, 0) @ model.weight + model.offset
            logs = z - z.max() - np.log(np.exp(z - z.max()).sum())
            mean, weights = mean + logs * max(1, len(window)), weights + max(1, len(window))
        prob = np.exp(mean / weights - (mean / weights).max())
        prob /= prob.sum()
        assert label == labels[int(prob.argmax())] and score == pytest.approx(prob.max(), rel=1e-3)
