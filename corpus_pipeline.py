"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, token-id output.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, mixing, packed_ids, quality, simhash
from tidewell.llm.common import new_dir, sheltered, stash, table, text_key, unsheltered
from tidewell.llm.queries import END_ID, WORD_TOKENIZER


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep.  The verdict depends on text and lang alone, so it is joined by their key."""
    columns, used = docs.columns, ["text", "lang"]
    docs = sheltered(docs, used)
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null"))
    keyed = docs.select(*text_key(F.col("text")), lang.alias("l"), "text", "lang")
    kept = quality.quality(keyed, ["c1", "c2", "l"]).where("kept").select(F.col("c1").alias("_c1"), F.col("c2").alias("_c2"), F.col("l").alias("_l")).distinct()
    # read from a table: both sides of the join are plain exchanges, so a large group of copies can be split
    kept = stash(kept, "kept")
    c1, c2 = text_key(F.col("text"))
    return unsheltered(docs.join(kept, (c1 == F.col("_c1")) & (c2 == F.col("_c2")) & (lang == F.col("_l")), "left_semi"), columns, used)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mixture: the files, by name, hold it from first to last."""
    used = ["doc_id", "text", "source"]
    mixed = mixing.mix(sheltered(docs, used), ["doc_id", "text"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return unsheltered(mixed.repartitionByRange(parts, "mix_position").sortWithinPartitions("mix_position"), docs.columns, used)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read back from packed shards in the order of the mixture.

    ``docs`` is read from Parquet, whose file names and row indexes carry that order; any other DataFrame goes by doc_id.
    """
    order = None
    if docs.inputFiles():
        order = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    return packed_ids.read_packed(packed_ids.write_packed(docs, WORD_TOKENIZER, END_ID, order))


STAGES = [
    ("quality rules", keep_quality),
    ("near-dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token-id output", write_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = new_dir(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: XXH64 fingerprints, their components and the tokenizer have no SQL form: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
