"""Files and tables as a corpus ``(path, language, src, content_sha)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import scalars as S


def table_corpus(df: DataFrame, path: Column, src: Column, language: Column | None = None):
    """Any table with an id and a text as a corpus."""
    lang = S.language_of(path) if language is None else language
    return df.select(path.alias("path"), lang.alias("language"), src.alias("src")).withColumn(
        "content_sha", S.sha256_hex(F.col("src"))
    )


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def _read_dir(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    """Files below a folder, or only those in it; other folders in it are not listed then.

    Names are chosen when files are listed, before any is read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if recursive:
        return reader.load(path)
    folder, fs = _hadoop(spark, path)
    if not fs.exists(folder):
        raise FileNotFoundError(f"path does not exist: {path}")
    own = [s.getPath().toString() for s in fs.listStatus(folder) if s.isFile()]
    own = [p for p in own if p.rsplit("/", 1)[-1][0] not in "._"]  # as Spark lists a folder
    if not own:
        none = "path string, modificationTime timestamp, length bigint, content binary"
        return reader.schema(none).load(path).where(F.lit(False))
    return spark.read.format("binaryFile").load(own)


def _supported(files: DataFrame) -> DataFrame:
    return files.where(S.is_supported_file(F.col("_metadata.file_name")))


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _reason(path: Column, text: Column) -> Column:
    return F.when(S.language_of(path).isNull(), "unsupported extension").when(
        ~F.is_valid_utf8(text), "not UTF-8"
    )


def _judged(files: DataFrame) -> DataFrame:
    text = F.col("content").cast("string")
    return files.select("path", "length", text.alias("src"), _reason(F.col("path"), text).alias("reason"))


def scan_dir(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Corpus of a folder; files that cannot be scanned are left out (see rejects).

    The extension test comes before the content is read.  Spark packs small files into
    one task and gives a large one a task of its own.
    """
    files = _supported(_read_dir(spark, path, recursive))
    good = _judged(files).where(F.col("reason").isNull())
    return table_corpus(good, F.col("path"), F.col("src"))


def rejects(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Files left out of :func:`scan_dir`, with the reason; content is read only when the
    extension is supported."""
    files = _read_dir(spark, path, recursive)
    other = files.where(~S.is_supported_file(F.col("path"))).select(
        "path", F.lit("unsupported extension").alias("reason")
    )
    bad = _judged(_supported(files)).where("reason is not null")
    return other.unionByName(bad.select("path", "reason"))


def scan_file(spark: SparkSession, path: str) -> DataFrame:
    """Corpus of one file (or of all files a pattern names); a bad one raises."""
    judged = _judged(_read(spark, path))
    message = F.concat(F.col("reason"), F.lit(": "), F.col("path"))
    src = F.when(F.col("reason").isNotNull(), F.raise_error(message)).otherwise(F.col("src"))
    return table_corpus(judged, F.col("path"), src)


def scan_path(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """A file strictly, a folder leniently; a path that does not exist raises."""
    hadoop, fs = _hadoop(spark, path)
    if not fs.exists(hadoop):
        raise FileNotFoundError(f"path does not exist: {path}")
    if fs.getFileStatus(hadoop).isDirectory():
        return scan_dir(spark, path, recursive)
    return scan_file(spark, path)


def text_rejects(corpus: DataFrame) -> DataFrame:
    """Rows of a table corpus that have no known language, with the reason."""
    return corpus.where(F.col("language").isNull()).select(
        "path", F.lit("unsupported extension").alias("reason")
    )


def line_facts(corpus: DataFrame) -> DataFrame:
    """Lines with number, byte length and text."""
    return corpus.select(
        "path", F.posexplode(S.lines_of(F.col("src"))).alias("pos", "line")
    ).select(
        "path",
        (F.col("pos") + 1).alias("line_no"),
        F.octet_length("line").alias("bytes"),
        F.col("line").alias("text"),
    )
