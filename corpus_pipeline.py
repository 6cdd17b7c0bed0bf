"""A corpus in five steps: toxicity, near duplicates, benchmark leaks, mixing, token files.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one
before kept; all but the last return the columns of ``documents``.  A stage's
result is to be written before the next stage begins, as ``run`` does: the
next stage deletes what earlier ones left in the shared folder, but for tables
that its own ``docs`` read.

Every stage takes nulls in any column, empty and very long texts, repeated
rows, empty tables and further columns of any name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pangrove.llm import common, decontaminate, mixing, simhash, tokens, toxicity


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with as many signs in front as it takes to be no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two key columns: the id, null ids last, and a hash of the whole row; and their names.

    Rows with one key are alike in every column; no copy of the texts is
    written to number them.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.xxhash64(*columns, *[c.isNull() for c in columns])
    key = [_free(docs, "key_id"), _free(docs, "key_hash")]
    return docs.withColumns({key[0]: F.coalesce("doc_id", F.lit((1 << 63) - 1)), key[1]: whole}), key


def _one_each(rows: DataFrame, key: list[str], keys: DataFrame, how: str) -> DataFrame:
    """One of the rows of each key that is in ``keys``.

    Like rows are combined before they are shuffled, so a row that is repeated
    a million times is no hot key; texts are shuffled once, at every size.
    """
    return rows.dropDuplicates(key).join(keys.hint("merge"), key, how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier does not reject.

    The model learns from labelled rows outside the held-out fold.  Null and
    empty texts have nothing toxic and stay; repeated rows are judged alike.
    """
    common.release(spark, docs)
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_ordinary(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least id.

    Documents link where their sets of five-word shingles have a Jaccard
    similarity of 0.8 or more; SimHash finds the candidates, which are checked
    on the sets.  Documents with null or empty texts are one group; of rows
    with the least id and unlike columns, the one of the least hash stays.
    """
    common.release(spark, docs)
    rows, key = _keyed(docs)
    named = F.struct(*key).alias("doc_id")
    groups = simhash.near_copy_groups(rows.select(named, "text"), words=5, similarity=0.8)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id.*").distinct()
    return _one_each(rows, key, common.written(first, "stage-first"), "left_semi").drop(*key)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none."""
    common.release(spark, docs)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, at most three times.

    Null sources are one source; null and empty texts have no words and are
    taken as the order of their source has it.
    """
    common.release(spark, docs)
    rows, key = _keyed(docs)
    copies = _free(docs, "copies")
    taken = mixing.mix_sources(rows.select(F.struct(*key).alias("key"), "source", "text"), id_col="key")
    taken = taken.groupBy("key").agg(F.sum("copies").alias(copies)).where(F.col(copies) > 0)
    mixed = _one_each(rows, key, common.written(taken.select("key.*", copies), "stage-copies"), "inner")
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))
    return mixed.withColumn(copies, each).drop(*key, copies)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix in ascending id order; a row for each document read back from them.

    A null text is its end id alone; null ids come first.
    """
    common.release(spark, docs)
    return tokens.token_digest(docs, public_tokenizers.path("byte_bpe_50k.json"), length=1024, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("token_files", write_tokens),
]

#: Tokens, fingerprints and alignments are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
