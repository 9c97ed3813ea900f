"""Readers: files by suffix, invoice documents, answer files, manifests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.schema import from_json_text
from ledgerlens.sources import listing

READABLE = {"pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "tif": "image", "tiff": "image", "bmp": "image", "json": "json"}
MAX_FILE_BYTES, MAX_FILES, MAX_PAGES, MIN_TEXT_CHARS = 25 * 1024 * 1024, 50, 30, 40


def stem(path):
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def route_files(files: DataFrame) -> DataFrame:
    """files(path, length): adds suffix, reader and error. A file that cannot be read is a row with its reason, never an
    exception; `content` is not needed to judge, so the scan can leave it out."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reader = F.try_element_at(F.create_map(*[F.lit(x) for pair in READABLE.items() for x in pair]), suffix)
    error = F.when(reader.isNull(), F.concat(F.lit("unsupported suffix: "), suffix)).when(F.col("length") > MAX_FILE_BYTES, "file too large").when(F.col("length") == 0, "empty file")
    return files.withColumn("suffix", suffix).withColumn("reader", reader).withColumn("error", error)


def reject_surplus(files: DataFrame, most: int = MAX_FILES) -> DataFrame:
    """Routed files; of those that can be read, all beyond the first `most` by path get an error. The limit is the feature: a
    batch takes so many files. Its edge is a top-k of one row."""
    taken = files.filter("error is null").select("path").orderBy("path").limit(most)
    edge = taken.agg(F.max("path").alias("last"), F.count("*").alias("n"))
    late = (F.col("n") >= most) & F.col("error").isNull() & (F.col("path") > F.col("last"))
    return files.withColumn("one", F.lit(1)).join(F.broadcast(edge.withColumn("one", F.lit(1))), "one").withColumn("error", F.when(late, "too many files").otherwise(F.col("error"))).drop("one", "last", "n")


def first_pages(words: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """Words of the pages that are read; a document's further pages are left out."""
    return words.filter(F.col("page") <= most)


def read_files(spark: SparkSession, path: str, pattern: str = "*", content: bool = True, slices: int = 16) -> DataFrame:
    """All files below a path with their route: path, modificationTime, length, content, suffix, reader, error. They are listed
    and read in tasks (`listing.FolderFiles`), so those without bytes and those that cannot be read are rows as well.
    In a store that only Spark can reach they are read by its own scan, which passes over files without bytes."""
    if listing.can_list(path):
        options = {"path": path if ":" in path else os.path.abspath(path), "pattern": pattern, "content": str(content).lower(), "slices": slices, "maxBytes": MAX_FILE_BYTES}
        return routed(spark.read.format(listing.register(spark)).options(**options).load())
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return route_files(files if content else files.withColumn("content", F.lit(None).cast("binary")))


def routed(files: DataFrame) -> DataFrame:
    """Rows of the listing with their route; what kept a file from being read is its error."""
    return route_files(files).withColumn("error", F.coalesce("problem", "error")).drop("problem")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON invoice per file, read permissively; doc_id is the file's stem."""
    text = spark.read.text(path, wholetext=True).select(stem(F.col("_metadata.file_name")).alias("doc_id"), "value")
    return from_json_text(text)


def read_manifest(spark: SparkSession, path: str, rows: str = "facturas") -> DataFrame:
    return spark.read.json(path, multiLine=True).select(F.explode(rows).alias("row")).select("row.*")


def cases(normal: DataFrame, traps: DataFrame, country: str | None = None, with_traps: bool = True) -> DataFrame:
    """Normal documents and traps in one frame, by country where one is given."""
    both = normal.withColumn("trap", F.lit(False))
    if with_traps:
        both = both.unionByName(traps.withColumn("trap", F.lit(True)), allowMissingColumns=True)
    return both.filter(F.col("pais") == country) if country else both


def with_files(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Answers with the sample file of the same stem, where there is one: the file is preferred to the answer itself."""
    paths = files.select(stem(F.col("path")).alias("doc_id"), "path")
    return expected.join(paths, "doc_id", "left").withColumn("input", F.when(F.col("path").isNotNull(), "file").otherwise("record"))
