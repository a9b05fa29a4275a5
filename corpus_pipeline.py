"""A corpus from raw documents to packed training sequences, in five stages.

1. The quality classifier learns from ``labels``; documents that it rejects go.
2. Near copies go by SimHash over shingles of five words; of each group one document stays.
3. Passages of 20 words or more that occurred before are taken out of the texts.
4. Sources are mixed to target weights: rows are written in the order of the schedule.
5. The texts are packed into sequences of at most 1024 tokens, one stretch of the mixed order after
   another, so the sequences in the order of their ids keep to the target weights.

Each stage works on all that the one before has written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm import mixing, packing, phrases, quality, simhash
from corvane.llm.common import materialize, table

#: Target weights of the sources, in whole parts; any other source has one part.
MIX_PARTS = {"src0": 4, "src1": 2, "src2": 2}
SEQUENCE_TOKENS = 1024


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return phrases.remove_from(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the order of the schedule, over the files and within each."""
    mixed = mixing.mix(docs, MIX_PARTS, names=("__block", "__slot", "__position"))
    rows, parts = max(1, docs.count()), max(1, docs.rdd.getNumPartitions())
    file = F.floor(F.col("__position") * parts / rows).cast("int")  # positions have no gaps, so ranges need no sample
    return mixed.repartitionById(parts, file).sortWithinPartitions("__position").select(*docs.columns)


def in_file_order(docs: DataFrame) -> DataFrame:
    """Add __position: each row's place over the files by their names and within each, from 0 without gaps.

    Rows that come from no file are in no order; their places are those of the plan's partitions.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        own = F.monotonically_increasing_id()
        placed = docs.withColumns({"__file": F.lpad(F.shiftright(own, 33).cast("string"), 10, "0"), "__row": own.bitwiseAND(F.lit((1 << 33) - 1))})
    files = placed.groupBy("__file").agg((F.max("__row") + 1).alias("__n"))  # one row per file
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = files.select("__file", before.alias("__before"))
    return placed.join(F.broadcast(ahead), "__file").select(*docs.columns, (F.col("__before") + F.col("__row")).alias("__position"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of each stretch of the order in which the rows were written."""
    return packing.pack_documents(in_file_order(docs), capacity=SEQUENCE_TOKENS, position="__position")


STAGES = [
    ("quality_classifier", select_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The stages learn a model and link fingerprints, which SQL can't express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
