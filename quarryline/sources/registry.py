"""Registries of declarative documents, chat logs and place files as DataFrames."""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import each
from .tables import durable

#: Limits of a registry, as (documents, bytes of one, bytes of all).
PROFILE_LIMITS = (256, 1 << 20, 32 << 20)
SOURCE_LIMITS = (4096, 256 << 10, 64 << 20)
SCHEMA_VERSION = 3
STATUSES = ("active", "disabled")

GEONAMES = "country_code string, postal_code string, place_name string, state_name string, state_code string, county_name string, county_code string, community_name string, community_code string, latitude double, longitude double, accuracy int"

ENTRY = "type string, version int, id string, parentId string, timestamp string, cwd string, message struct<role:string,content:string>"


def read_registry(spark: SparkSession, paths: list[str], limits: tuple[int, int, int] = SOURCE_LIMITS) -> DataFrame:
    """(file, key, name, status, body, problem): a row a document, with what is wrong with it."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    doc = F.try_parse_json("body")
    field = lambda name: F.try_variant_get(doc, f"$.{name}", "string")
    version = F.try_variant_get(doc, "$.schemaVersion", "int")
    problem = (
        F.when(F.octet_length("body") > limits[1], "document_too_large").when(doc.isNull(), "malformed_json")
        .when(F.coalesce(version, F.lit(-1)) != SCHEMA_VERSION, "unsupported_version")
        .when(F.coalesce(F.trim(field("key")), F.lit("")) == "", "missing_key")
        .when(field("status").isNotNull() & ~field("status").isin(*STATUSES), "invalid_status")
    )
    return rows.select("file", field("key").alias("key"), field("name").alias("name"), F.coalesce(field("status"), F.lit("active")).alias("status"), "body", problem.alias("problem"))


def registry_limits(docs: DataFrame, limits: tuple[int, int, int] = SOURCE_LIMITS) -> DataFrame:
    """Whether a registry is within its limits of documents and bytes."""
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bytes")).withColumn("within", (F.col("documents") <= limits[0]) & (F.col("bytes") <= limits[2]))


def read_geonames(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.csv(list(paths), sep="\t", schema=GEONAMES, quote="")


#: Blocks of files whose counts a broadcast may hold.
BROADCAST_BLOCKS = 400_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, line): the lines of files with their place from 0, each file read by as many tasks as it has splits.

    A split's rows are read in order, so that their running ids count its lines; the lines of the splits before it, known
    from one count a split, make that a place in the file. The lines themselves aren't shuffled.
    """
    raw = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    blocks = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = durable(blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")))
    blocks = F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks
    return raw.join(blocks, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).cast("int").alias("ord"), "line")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Entries of line-based chat logs with their place; a torn last line is dropped, another bad line marked."""
    lines = read_lines(spark, path).where("line != ''").withColumnRenamed("file", "session")
    parsed = lines.select("session", "ord", F.from_json("line", ENTRY).alias("e"), "line")
    bad = F.col("e.type").isNull() | (F.try_parse_json("line").isNull())
    last = lines.groupBy("session").agg(F.max("ord").alias("last"))
    out = parsed.join(last, "session").where(~(bad & (F.col("ord") == F.col("last"))))
    return out.select("session", "ord", "e.type", "e.version", "e.id", F.col("e.parentId").alias("parent_id"), "e.timestamp", "e.message", bad.alias("bad"))


def decoded(body: Column, charset: str) -> Column:
    """Bytes as text, null where they aren't of the charset."""
    return F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")) if charset.lower() == "utf-8" else F.decode(body, charset)


#: Byte order marks, and labels that the web reads as another encoding.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
WEB = {"iso8859-1": "cp1252", "ascii": "cp1252", "latin-1": "cp1252", "utf-16": "utf-16-le", "iso8859-9": "cp1254", "tis-620": "cp874", "gb2312": "gbk"}


def encoding_of(label: str) -> str | None:
    try:
        name = codecs.lookup(label.strip()).name
    except (LookupError, ValueError):
        return None
    return WEB.get(name, name)


def charset_labels(content_type: str | None) -> list[str] | None:
    """The charset parameters of a header; None if one is malformed."""
    out = []
    for parameter in (content_type or "").split(";")[1:]:
        name, eq, value = parameter.partition("=")
        name, value = name.strip().lower(), value.strip()
        if not eq:
            if name == "charset" or (name.startswith("charset") and name[7] in ": \t"):
                return None
        elif name == "charset":
            quoted = value.startswith('"') or value.endswith('"')
            if quoted and (len(value) < 2 or value[0] != '"' or value[-1] != '"' or '"' in value[1:-1]):
                return None
            out.append(value[1:-1] if quoted else value)
    return out


def strict_text(body: bytes | None, authored: str | None, content_type: str | None) -> dict | None:
    """The text of a body whose author, byte order mark and header agree on its charset (UTF-8 if none says), or what is wrong."""
    if body is None:
        return None
    bom = next(((mark, name) for mark, name in MARKS if body.startswith(mark)), None)
    labels = charset_labels(content_type)
    told = None if labels is None else [encoding_of(x) for x in [*([authored] if authored is not None else []), *labels]]
    if told is None or None in told or len({*told, *([bom[1]] if bom else [])}) > 1:
        return {"text": None, "error": "invalid_charset"}
    try:
        return {"text": body[len(bom[0]) if bom else 0 :].decode(told[0] if told else bom[1] if bom else "utf-8"), "error": None}
    except UnicodeDecodeError:
        return {"text": None, "error": "undecodable"}


def decoded_strictly(body: Column, authored: Column, content_type: Column) -> Column:
    """struct(text, error) by `strict_text`."""
    return each(strict_text, pa.struct([("text", pa.string()), ("error", pa.string())]), body, authored, content_type)


#: Folders that a scan of sources doesn't enter.
SKIPPED = ("target", ".git", "node_modules", ".idea", ".vscode")


def source_files(spark: SparkSession, root: str, suffix: str = ".rs", skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, length, text, error) of the files below `root` that end so; an undecodable one has an error and no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    inside = ~F.array_contains(F.transform(F.split("path", "/"), lambda p: p.isin(list(skip))), True)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.where(inside).select("path", "length", text.alias("text"), F.when(text.isNull(), "not UTF-8").alias("error"))


def listed_files(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(path, lines) of the files of a list, as version control gives it."""
    return spark.read.text([f"{root}/{n}" for n in names], wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_count("value", F.lit("\n")).alias("lines"))
