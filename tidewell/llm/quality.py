"""Quality rules by distribution divergence, in DataFrame functions only.

Each document gets base counts and two histograms: its character classes and the common words of its language.  Languages'
references are the summed histograms of all their documents.  A document that is long enough is rejected when the
Jensen-Shannon distance (base 2, 0 to 1) of a histogram to its language's reference passes that histogram's limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stash

# Frequent function words of the languages that have a common-word histogram.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "des", "im", "ein", "nicht", "auf", "eine"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "was", "for", "on", "with", "be", "this", "not"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "una", "para", "no"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "dans", "qui", "par", "pour"],
}
CHAR_CLASSES = ["upper", "digit", "symbol", "mark", "other", "space", "lower"]
#: The first five classes by pattern; marks are counted with the symbols among them.
PATTERNS = ["[A-Z]", "[0-9]", r"[#*$%&|<>]", r"[!-/:-@\[-`{-~]", r"[^\x00-\x7F]"]
SYMBOL = CHAR_CLASSES.index("symbol")

#: Limits and guards of the verdict.
MIN_CHARS, MIN_WORDS = 200, 50
#: A limit is base + slack / sqrt(length): the distance of a short sample to its own source is larger.
CHAR_LIMIT, WORD_LIMIT = (0.30, 0.4), (0.20, 0.9)


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _pairs(h: Column, apart: int) -> Column:
    """Hashes of ``h[i], h[i + apart]``: doubling these gives the hashes of windows of 2, 4, 8 elements."""
    n = F.greatest(F.size(h) - apart, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(apart + 1), n), lambda a, b: F.xxhash64(a, b))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with w (its words) and the base counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    n_repeat_words compares 8-word windows by 64-bit hashes within one document.  Null text has no words.  All of it is
    computed in the row, so neither long nor frequent documents are shuffled.
    """
    t = F.col("_t")
    out = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("w", word_list(t))
    out = out.withColumn("_h1", F.transform("w", lambda x: F.xxhash64(x)))
    for k, size in ((1, 2), (2, 4), (4, 8)):
        out = out.withColumn(f"_h{size}", _pairs(F.col(f"_h{k}"), k))
    repeats = F.size("_h8") > F.size(F.array_distinct("_h8"))
    out = out.withColumn("_s", F.when(repeats, F.array_sort(F.transform("_h8", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s, last = F.col("_s"), F.size("_s") - 1
    at = lambda i: F.get(s, i)["h"]
    out = out.withColumn("_s", F.filter(s, lambda x, i: F.coalesce(at(i - 1) == x["h"], F.lit(False)) | F.coalesce((i < last) & (at(i + 1) == x["h"]), F.lit(False))))
    out = out.withColumn("_s", F.array_sort(F.transform("_s", lambda x: x["i"])))
    n = F.size("_s")
    gaps = F.zip_with(F.slice("_s", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("_s", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(8)))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # most characters are lower-case letters and blanks: the classes are counted in what is left without them
    out = out.withColumn("_rest", F.regexp_replace(t, "[a-z ]+", ""))
    found = F.array(*[F.char_length("_rest") - F.char_length(F.regexp_replace("_rest", p, "")) for p in PATTERNS])
    out = out.withColumn("_lines", lines).withColumn("_found", found)
    return out.withColumns(
        {
            "n_words": F.size("w").cast("long"),
            "word_chars": F.char_length(F.array_join("w", "")).cast("long"),
            "n_symbols": F.col("_found")[SYMBOL].cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(n > 0, F.aggregate(gaps, F.lit(8), lambda a, b: a + b)).otherwise(0).cast("long"),
        }
    ).drop("_h1", "_h2", "_h4", "_h8", "_s", "_lines", "_rest")


def histograms(counted: DataFrame, lang: str = "lang") -> DataFrame:
    """Adds ``chars`` (counts by CHAR_CLASSES) and ``common`` (counts of the language's common words, then of all others)."""
    found, space = F.col("_found"), F.char_length("_t") - F.col("word_chars")
    classes = [found[0], found[1], found[2], found[3] - found[2], found[4], space]
    lower = F.char_length("_t") - found[0] - found[1] - found[3] - found[4] - space
    chosen = F.lit(None).cast("array<string>")
    for code, words in COMMON_WORDS.items():
        chosen = F.when(F.col(lang) == code, F.array(*map(F.lit, words))).otherwise(chosen)
    wanted = sorted({w for words in COMMON_WORDS.values() for w in words})
    out = counted.withColumn("_list", chosen).withColumn("_c", F.filter("w", lambda x: x.isin(wanted)))
    counts = F.transform("_list", lambda x: (F.size("_c") - F.size(F.array_remove("_c", x))).cast("long"))
    out = out.withColumn("_counts", counts)
    known = F.aggregate("_counts", F.lit(0).cast("long"), lambda a, b: a + b)
    common = F.concat("_counts", F.array(F.col("n_words") - known))
    return out.withColumns({"chars": F.array(*[x.cast("long") for x in [*classes, lower]]), "common": common}).drop("_c", "_list", "_counts")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; null if either is null or sums to zero."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("double"), lambda s, x: s + x)
    pq = F.zip_with(p, q, lambda a, b: F.struct((a / F.nullif(total(p), F.lit(0.0))).alias("a"), (b / F.nullif(total(q), F.lit(0.0))).alias("b")))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    halves = F.transform(pq, lambda x: term(x["a"], (x["a"] + x["b"]) / 2) + term(x["b"], (x["a"] + x["b"]) / 2))
    return F.sqrt(F.greatest(total(halves) / 2, F.lit(0.0)))


def references(histos: DataFrame, lang: str = "lang") -> DataFrame:
    """One row a language: summed ``ref_chars`` and ``ref_common`` of all its documents."""
    n_common = len(next(iter(COMMON_WORDS.values()))) + 1
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(len(CHAR_CLASSES))] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(n_common)]
    ref_common = F.when(F.col("w0").isNotNull(), F.array(*[F.col(f"w{i}") for i in range(n_common)]))
    return histos.groupBy(F.col(lang).alias("ref_lang")).agg(*sums).select("ref_lang", F.array(*[F.col(f"c{i}") for i in range(len(CHAR_CLASSES))]).alias("ref_chars"), ref_common.alias("ref_common"))


def quality(docs: DataFrame, keys: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``keys``, base counts, base_failed, char_distance, word_distance and kept, one row for each row of ``docs``.

    base_failed: under 20 words, or over 30 % of words in repeated 8-word windows.  kept: not base_failed, and neither
    distance passes its limit.  Guards: no distance is judged under MIN_CHARS characters, no word distance under MIN_WORDS
    words, and limits widen for short texts.  A null language is a language of its own, without a word list.  Null text fails the base rules.  ``docs`` may hold any further columns.
    """
    docs = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = [f"k{i}" for i in range(len(keys))]
    rows = stash(histograms(base_counts(docs)).select(*names, "lang", *counts, "chars", "common"), "quality")
    rows = rows.join(references(rows), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, b: a + b)
    rows = rows.withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "char_distance": F.when(n_chars >= MIN_CHARS, js_distance(F.col("chars"), F.col("ref_chars"))),
            "word_distance": F.when((n_chars >= MIN_CHARS) & (F.col("n_words") >= MIN_WORDS), js_distance(F.col("common"), F.col("ref_common"))),
        }
    )
    limit = lambda of, n: of[0] + of[1] / F.sqrt(n)
    fits = (F.coalesce("char_distance", F.lit(0.0)) <= limit(CHAR_LIMIT, n_chars)) & (F.coalesce("word_distance", F.lit(0.0)) <= limit(WORD_LIMIT, F.col("n_words")))
    out = rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(True)))
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *counts, "base_failed", "char_distance", "word_distance", "kept")
