"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Rows of a source form blocks of ``block`` rows in a seeded hash order.  With weights w (integers summing to ``period``), the
k-th block of a source (from 0) is released at floor(k * period / w) and is due at ceil((k + 1) * period / w); each slot
goes to the released block that is due first.  One machine with utilisation 1 is always schedulable so, hence at every slot
each source is within one block of its share.  The schedule repeats after ``period`` slots, so only one period is computed, a
row a slot; a block's slot follows from it, and its place is the sum of the sizes of all blocks in earlier slots, taken
range by range.  No task ever sees more than one (source, bucket) of rows or one range of blocks, and nothing is broadcast but a
single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stash

#: Slots in a period: weights are rounded to multiples of 1/PERIOD (largest remainder), at least one slot a source.  With as
#: many sources or more, a period has the next multiple of PERIOD above their number.
PERIOD = 1000
BLOCK = 32
#: Rows of a source are numbered in hash buckets of about so many rows at most.
BUCKET_ROWS = 1024
#: Slots of a range in which the sizes of blocks are summed, and slots of a period that are scheduled in one inner fold.
RANGE, FOLD = 1 << 16, 256
RESULTS = ["mix_block", "mix_slot", "mix_position", "mix_balanced"]


def target_weights(sizes: DataFrame, power: float = 0.5, period: int = PERIOD) -> DataFrame:
    """src, n, weight: default targets in proportion to n ** power, as integers that sum to ``period``, or to its
    least multiple above the number of sources.

    ``sizes`` (src, n) has one row a source.  Every source gets a slot; the rest go by largest remainder, ties by source.
    """
    # one row a source
    all_ = W.partitionBy()
    share = F.pow(F.col("n").cast("double"), F.lit(power))
    out = sizes.withColumn("s", F.count("*").over(all_))
    out = out.withColumn("free", (F.floor(F.col("s") / period) + 1) * period - F.col("s")).withColumn("share", share / F.sum(share).over(all_) * F.col("free"))
    out = out.withColumn("whole", F.floor("share"))
    left = F.col("free") - F.sum("whole").over(all_)
    out = out.withColumn("left", left)
    rank = F.row_number().over(W.partitionBy().orderBy((F.col("share") - F.col("whole")).desc(), "src"))
    return out.select("src", "n", (1 + F.col("whole") + F.when(rank <= F.col("left"), 1).otherwise(0)).cast("long").alias("weight"))


def schedule(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """src, n, weight, k, slot, period: the slot of each source's k-th block of a period (``period`` slots, or the sum of all
    weights where that is more).

    Earliest deadline first over released blocks, ties to the first source.  ``weights`` (src, n, weight) is one row a source.
    Sources of one weight have the same releases and deadlines, so they take their k-th blocks in turn and the schedule's state is
    one entry a distinct weight: at most the root of twice the period.
    """
    numbered = weights.withColumn("i", F.row_number().over(W.partitionBy().orderBy("src")) - 1)  # one row a source
    kinds = numbered.groupBy("weight").agg(F.array_sort(F.collect_list("i")).alias("members"))
    one = kinds.agg(F.array_sort(F.collect_list(F.struct("weight", "members"))).alias("kinds"), F.greatest(F.lit(period).cast("long"), F.sum(F.col("weight") * F.size("members"))).alias("period"))
    period, size = F.col("period"), F.size("kinds")

    def upcoming(c: Column, k: Column, done: Column) -> Column:
        """The next block of a kind: the k-th of its done-th member; the least (due, i) among the released ones is chosen."""
        weight, i = F.get("kinds", c)["weight"], F.get(F.get("kinds", c)["members"], done)
        release, due = F.floor(k * period / weight), F.ceil((k + 1) * period / weight)
        return F.struct(due.cast("long").alias("due"), i.cast("int").alias("i"), release.cast("long").alias("release"), k.cast("long").alias("k"), done.cast("int").alias("done"), c.cast("int").alias("c"))

    def step(state: Column, t: Column) -> Column:
        chosen = F.array_min(F.filter(state["next"], lambda x: x["release"] <= t))

        def give(x: Column) -> Column:
            last = x["done"] + 1 == F.size(F.get("kinds", x["c"])["members"])
            one = upcoming(x["c"], F.when(last, x["k"] + 1).otherwise(x["k"]), F.when(last, 0).otherwise(x["done"] + 1))
            after = F.concat(F.slice(state["next"], F.lit(1), x["c"]), F.array(one), F.slice(state["next"], x["c"] + 2, size))
            return F.struct(F.when(x.isNull(), state["next"]).otherwise(after).alias("next"), F.concat(state["slots"], F.array(x["i"])).alias("slots"))

        return F.transform(F.array(chosen), give)[0]

    none = F.array().cast("array<int>")

    def fold(state: Column, first: Column) -> Column:
        inner = F.aggregate(F.sequence(first, F.least(first + FOLD, period) - 1), F.struct(state["next"].alias("next"), none.alias("slots")), step)
        return F.transform(F.array(inner), lambda x: F.struct(x["next"].alias("next"), F.concat(state["slots"], x["slots"]).alias("slots")))[0]

    start = F.struct(F.transform("kinds", lambda _, c: upcoming(c, F.lit(0), F.lit(0))).alias("next"), none.alias("slots"))
    slots = F.aggregate(F.sequence(F.lit(0).cast("long"), period - 1, F.lit(FOLD).cast("long")), start, fold, lambda x: x["slots"])
    slots = one.where(size > 0).select("period", F.posexplode(slots).alias("slot", "i")).where("i IS NOT NULL")
    k = F.row_number().over(W.partitionBy("i").orderBy("slot")) - 1  # at most a period's slots
    return slots.withColumn("k", k.cast("long")).join(numbered, "i").select("src", "n", "weight", "k", F.col("slot").cast("long").alias("slot"), "period")


def mix(docs: DataFrame, keys: list[str], source: str = "source", power: float = 0.5, block: int = BLOCK, period: int = PERIOD, seed: str = "mix", weights: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``mix_block`` (its block in its source), ``mix_slot``, ``mix_position`` (its place in the mixture, from 0)
    and ``mix_balanced`` (before any source ran out: up to there each source is within one block of its target).

    No row is dropped: when a source runs out its slots are skipped and the others go on in their proportions.  Rows of a
    source are ordered by md5 of the seed and ``keys``; equal rows are numbered arbitrarily but each once.  A null source is
    a source of its own.  Further columns may have any names; one named like a result column is replaced.  Targets go by ``weights`` (src, weight: integers from 1 summing to ``period``)
    or by :func:`target_weights`.  A source that ``weights`` lacks gets one slot, and the period grows where it has no slot left.
    """
    src = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    order = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    names = docs.columns
    rows = docs.select("*", src, order).toDF(*[f"d{i}" for i in range(len(names))], "_src", "_h")
    digits = 1
    total = docs.count()
    while total > BUCKET_ROWS << 4 * digits:
        digits += 1
    rows = rows.withColumn("_bucket", F.substring("_h", 1, digits))
    counts = stash(rows.groupBy(F.col("_src").alias("src"), F.col("_bucket").alias("bucket")).agg(F.count("*").alias("m")), "counts")
    before = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # a row a bucket
    offsets = counts.withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0)))
    sizes = counts.groupBy("src").agg(F.sum("m").alias("n"))
    if weights is None:
        targets = target_weights(sizes, power, period)
    else:
        given = weights.select(F.coalesce(F.concat(F.lit("="), F.col("src")), F.lit("null")).alias("src"), F.col("weight").cast("long").alias("given"), F.lit(True).alias("named"))
        bad = F.raise_error(F.concat(F.lit("weight under 1 of source "), F.col("src"))).cast("long")
        targets = sizes.join(given, "src", "left").select("src", "n", F.when(F.col("named").isNull(), 1).when(F.col("given") >= 1, F.col("given")).otherwise(bad).alias("weight"))
    plan = stash(schedule(stash(targets, "targets"), period), "plan")
    first = F.floor(F.col("offset") / block)
    held = offsets.select("src", "bucket", F.explode(F.sequence(first, F.floor((F.col("offset") + F.col("m") - 1) / block))).alias("b"))
    held = held.join(block_places(plan, block), ["src", "b"]).groupBy("src", "bucket").agg(F.array_sort(F.collect_list(F.struct("b", "slot", "start"))).alias("places"))
    offsets = stash(offsets.join(held, ["src", "bucket"]).select("src", "bucket", "offset", first.alias("first"), "places"), "places")
    # the first slot of a block that isn't full: up to there each source has given what its target asks
    short = plan.where(F.col("k") == F.pmod(F.floor(F.col("n") / block), F.col("weight")))
    short = short.agg(F.min(F.floor(F.floor(F.col("n") / block) / F.col("weight")) * F.col("period") + F.col("slot")).alias("short"))
    rows = rows.join(offsets, (F.col("_src") == F.col("src")) & (F.col("_bucket") == F.col("bucket")))
    place = F.row_number().over(W.partitionBy("src", "bucket").orderBy("_h")) - 1 + F.col("offset")
    rows = rows.withColumn("_rank", place).withColumn("mix_block", F.floor(F.col("_rank") / block))
    at = F.get("places", (F.col("mix_block") - F.col("first")).cast("int"))  # a bucket's few blocks
    rows = rows.withColumns({"mix_slot": at["slot"], "mix_position": (at["start"] + F.pmod("_rank", F.lit(block))).cast("long")})
    rows = rows.crossJoin(F.broadcast(short)).withColumn("mix_balanced", F.col("mix_slot") < F.col("short"))  # one row
    return rows.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(names) if c not in RESULTS], *RESULTS)


def block_places(plan: DataFrame, block: int) -> DataFrame:
    """src, b, slot, start: of each block of each source its slot and the number of rows in all earlier slots."""
    sizes = plan.select("src", "n", "weight", "period").distinct()
    blocks = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)).alias("b"))
    blocks = blocks.withColumn("k", F.pmod("b", F.col("weight"))).withColumn("size", F.least(F.lit(block).cast("long"), F.col("n") - F.col("b") * block))
    blocks = blocks.join(plan.select("src", "k", F.col("slot").alias("t")), ["src", "k"])
    blocks = blocks.select("src", "b", "size", (F.floor(F.col("b") / F.col("weight")) * F.col("period") + F.col("t")).alias("slot"))
    blocks = stash(blocks.withColumn("range", F.floor(F.col("slot") / RANGE)), "blocks")
    sums = blocks.groupBy("range").agg(F.sum("size").alias("all"))
    base = sums.select("range", F.coalesce(F.sum("all").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row a range
    within = F.coalesce(F.sum("size").over(W.partitionBy("range").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocks.join(base, "range").select("src", "b", "slot", (F.col("base") + within).alias("start"))
