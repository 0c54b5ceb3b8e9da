"""Readers by URI and writers by path.

A resource is a path or URI whose scheme or suffix says how it is read; globs and directories
are read as one table.  ``uri::name`` is the table ``name`` in a database.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Kinds of files by suffix; compressed ones bear one more suffix.
SUFFIXES = {
    ".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet", ".orc": "orc", ".txt": "text", ".xml": "xml", ".xlsx": "xlsx", ".h5": "hdf5", ".hdf5": "hdf5",
}
READERS: dict[str, Callable] = {}
SCHEMES: list[tuple[re.Pattern, Callable]] = []


def reads(kind: str):
    """Register a reader for a kind of file: ``f(spark, path, **options)``."""

    def put(f):
        READERS[kind] = f
        return f

    return put


def opens(pattern: str):
    """Register a reader for URIs that match a pattern: ``f(spark, uri, **options)``."""

    def put(f):
        SCHEMES.append((re.compile(pattern), f))
        return f

    return put


def kind_of(path: str) -> str:
    bare = re.sub(r"\.(gz|bz2|zst|snappy|deflate)$", "", path.partition("::")[0].split("?")[0].rstrip("/").lower())
    for suffix, kind in SUFFIXES.items():
        if bare.endswith(suffix):
            return kind
    raise NotImplementedError(f"no reader for {path!r}")


def takes_schema(uri: str) -> bool:
    """Whether a URI names a text file whose types can be told instead of found out."""
    try:
        return not any(p.match(uri) for p, _ in SCHEMES) and kind_of(uri) in ("csv", "tsv", "json", "jsonl")
    except NotImplementedError:
        return False


def resource(uri: str, spark: SparkSession, **options) -> DataFrame:
    """The table a URI names; nothing but its schema is read."""
    for pattern, f in SCHEMES:
        if pattern.match(uri):
            return f(spark, uri, **options)
    return READERS[kind_of(uri)](spark, uri, **options)


@reads("parquet")
def _parquet(spark, path, **options):
    return spark.read.options(**options).parquet(path)


@reads("orc")
def _orc(spark, path, **options):
    return spark.read.options(**options).orc(path)


@reads("csv")
def _csv(spark, path, schema=None, sep=",", **options):
    """With a header line; without a schema the types are found out in one pass over the file."""
    reader = spark.read.options(header=True, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, **options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


@reads("tsv")
def _tsv(spark, path, **options):
    return _csv(spark, path, sep="\t", **options)


@reads("json")
def _json(spark, path, schema=None, **options):
    """One document, an array of records, or a record a line."""
    reader = spark.read.options(multiLine=True, **options)
    return (reader.schema(schema) if schema else reader).json(path)


@reads("jsonl")
def _jsonl(spark, path, schema=None, **options):
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).json(path)


@reads("text")
def _text(spark, path, **options):
    return spark.read.options(**options).text(path)


@reads("xml")
def _xml(spark, path, row_tag="row", **options):
    return spark.read.options(rowTag=row_tag, **options).xml(path)


@opens(r"^table:")
def _table(spark, uri, **options):
    """A table of the catalog: ``table:schema.name``."""
    return spark.table(uri.partition(":")[2])


@opens(r"^jdbc:")
def _jdbc(spark, uri, **options):
    """A database table: ``jdbc:...::name``; options as of the JDBC reader, with bounds for parallel reading."""
    url, _, name = uri.partition("::")
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


@opens(r"^sqlite://")
def _sqlite(spark, uri, **options):
    from .files import sqlite

    path, _, name = uri.removeprefix("sqlite://").partition("::")
    return sqlite(spark, path, name, **options)


@reads("xlsx")
def _xlsx(spark, path, **options):
    from .files import xlsx

    return xlsx(spark, path, **options)


@reads("hdf5")
def _hdf5(spark, path, **options):
    from .files import hdf5

    return hdf5(spark, path, **options)


@opens(r"^(mongodb|impala|postgresql|mysql)(\+\w+)?://")
def _by_connector(spark, uri, **options):
    """Databases that need a connector on the class path; plain SQL ones go through JDBC."""
    url, _, name = uri.partition("::")
    scheme = re.match(r"\w+", url)[0]
    if scheme == "mongodb":
        base, _, db = url.rpartition("/")
        return spark.read.format("mongodb").options(**{"connection.uri": base, "database": db, "collection": name}, **options).load()
    rest = url.split("://", 1)[1]
    return _jdbc(spark, f"jdbc:{'hive2' if scheme == 'impala' else scheme}://{rest}::{name}", **options)


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: ``spark.checkpoint.dir``; on one machine a temporary one will do."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="millrace-web-")


@opens(r"^(https?|ftp)://.+\.(csv|tsv|json|jsonl|txt)(\.gz)?$")
def _web(spark, uri, **options):
    """A file on the web, fetched once by the driver into the folder that all executors share."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = f"{shared_folder(spark)}/{uuid.uuid4().hex}-{uri.rsplit('/', 1)[1]}"
    at = jvm.org.apache.hadoop.fs.Path(place)
    files = at.getFileSystem(conf)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.java.net.URI.create(uri).toURL().openStream(), files.create(at), conf, True)
    files.deleteOnExit(at)
    return READERS[kind_of(uri)](spark, place, **options)


@opens(r"^millrace://")
def _server(spark, uri, **options):
    from ..server.client import Client

    host, _, table = uri.removeprefix("millrace://").partition("/")
    return Client(f"http://{host}").table(table, spark)


def write(df: DataFrame, to: str, mode: str = "errorifexists", partition_by=(), sort_by=(), **options) -> str:
    """Write rows to a path (by its suffix) or to ``table:name``; sorting within files sharpens their statistics."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if to.startswith("table:"):
        writer.saveAsTable(to.partition(":")[2])
        return to
    if to.startswith("jdbc:"):
        url, _, name = to.partition("::")
        writer.format("jdbc").options(url=url, dbtable=name).save()
        return to
    kind = kind_of(to)
    if kind in ("csv", "tsv"):
        writer = writer.option("header", True).option("sep", "\t" if kind == "tsv" else ",")
    writer.format({"tsv": "csv", "jsonl": "json"}.get(kind, kind)).save(to)
    return to


def append(to: str, df: DataFrame, **options) -> str:
    """Add rows to what is there."""
    return write(df, to, mode="append", **options)


def drop(uri: str, spark: SparkSession) -> None:
    """Remove a table or the files under a path."""
    if uri.startswith("table:"):
        spark.sql(f"DROP TABLE IF EXISTS {uri.partition(':')[2]}")
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
