"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and returns those it keeps
with the columns of documents; the last returns the packed pieces. Decisions are made row by row: within a stage each
row has a key told by the values of all its columns, so that rows of a null or repeated doc_id stay or go by their own
text, and the same rows stay however the input is ordered or partitioned. Of rows that are copies of each other the one
with the least doc_id stays (a null id only where all are null), of those with one doc_id the one with the least key.

Null and empty texts are documents like any other: equal ones are copies of each other, they leak nothing, and one is
packed as its end id. Rows that are equal in all columns are exact copies, of which one stays; an empty table gives an
empty result. Further columns are handed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut, join_by_class, table
from ledgerlens.llm.decontamination import find_leaks
from ledgerlens.llm.exact_dedup import exact_dedup
from ledgerlens.llm.merkle import field_bytes
from ledgerlens.llm.packing import pack_documents
from ledgerlens.llm.quality import fit_on_sample, keep_good
from ledgerlens.llm.queries import tokenizer_path
from ledgerlens.llm.simhash import near_duplicate_groups

_ATOMS = ("string", "bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp", "timestamp_ntz")


def _key(digest: Column, bits: int = 63) -> Column:
    return F.shiftrightunsigned(F.xxhash64(digest), 64 - bits)


def _keyed(docs: DataFrame, bits: int = 63) -> tuple[DataFrame, str]:
    """docs with a key of each row, and the key's column: a number that the values of all columns tell. Only equal rows
    share one: digests that meet in one number get another from more of their bits."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    plain = lambda c, kind: docs[c] if kind in _ATOMS or kind.startswith("decimal") else F.to_json(F.struct(docs[c]), {"ignoreNullFields": "false"})
    digest = F.sha2(field_bytes([plain(c, kind) for c, kind in docs.dtypes]), 256)
    pairs = docs.select(digest.alias("digest")).select(_key(F.col("digest"), bits).alias("key"), "digest")
    met = cut(pairs.groupBy("key").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("key"))
    if met.isEmpty():
        return docs.withColumn(name, _key(digest, bits)), name
    marked = docs.withColumn(name, _key(digest, bits)).join(met.withColumn("_met", F.lit(True)).withColumnRenamed("key", name), name, "left")
    return marked.withColumn(name, F.when(F.col("_met"), _key(F.concat(digest, F.lit("again")))).otherwise(F.col(name))).select(*docs.columns, name), name


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The keyed docs without the rows whose key is the doc_id of `gone`, and without the key."""
    return docs.join(gone.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").drop(key)


def _one_of_each(docs: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """The keyed docs without copies: groups(doc_id, group) tells the group of each key. Of a group the row of the least
    (doc_id, key) stays, once."""
    ids = docs.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("id")).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    members = cut(groups.select(F.col("doc_id").alias("key"), "group").distinct().join(ids, "key"))
    least = members.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least"), F.count("*").alias("n"))
    shared = cut(least.filter("n > 1").select("group", F.col("least.key").alias("stays"), "n"))
    gone = join_by_class(members, shared, ["group"], "n").filter("key <> stays").select(F.col("key").alias(key))
    kept = docs.join(gone, key, "left_anti")
    if not members.filter("rows > 1").isEmpty():
        kept = kept.dropDuplicates([key])
    return kept.drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores 0.3 or more."""
    return keep_good(docs, fit_on_sample(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row."""
    docs, key = _keyed(docs)
    return _one_of_each(docs, key, exact_dedup(docs, id_col=key).select("doc_id", F.col("keep_id").alias("group")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 or more, and what these link), one row."""
    docs, key = _keyed(docs)
    return _one_of_each(docs, key, near_duplicate_groups(docs, id_col=key).select("doc_id", F.col("component_id").alias("group")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no benchmark item."""
    docs, key = _keyed(docs)
    return _without(docs, key, find_leaks(docs, table(spark, sf_dir, "benchmark"), id_col=key))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("pack", pack)]

#: A fitted classifier, SimHash tries and a tokenizer are not SQL; the operators are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
