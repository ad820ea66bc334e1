"""Line dedup by range-partitioned hashes, as compressed bitmaps of the lines to keep.

Every line's key (stripped, ASCII lower case) is hashed to 128 bits. The hashes,
and never the texts, are dealt out by range and sorted inside a range by
document and position, so that the first occurrence of a key streams by ahead
of its repeats. What comes back is, for each document that loses lines, a
bitmap of run edges in as few bytes as they need.

A hash that alone would fill a range is told by a frequent-items sketch of all
hashes. Its occurrences aren't shuffled: the least document of each such hash is
a grouped minimum, combined before the shuffle, and at most `HOT` of them are
broadcast back to the lines.

Defined results: a null or empty text is one empty line; a null doc_id comes
after all others; rows that share a doc_id are one document, whose lines don't
drop each other; ties can't arise, as a document keeps all its lines of a key
or none; very long texts are split whole; an empty table yields no rows; other
columns, whatever their names, stay out of the work.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, durable, fresh, written

LEAST_CHARS = 10
BLANK = " \t\n\x0b\x0c\r"
#: Most hashes that are handled apart from the ranges; a range holds a `HOT`th of the lines or a partition's share.
HOT = 1000
#: Groups in which partial sketches meet before the last one.
SKETCHES = 64


def whole(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def address(text: str = "text") -> list[Column]:
    """128 bits that tell the texts of one doc_id apart."""
    return [F.xxhash64(whole(text)), F.xxhash64(F.lit(1), whole(text))]


def line_hashes(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc, a1, a2, pos, h1, h2) of every line whose key is long enough."""
    a1, a2 = address()
    texts = docs.select(F.col(doc_id).alias("doc"), a1.alias("a1"), a2.alias("a2"), whole().alias("text"))  # hashed before there is a row a line
    lines = texts.select("doc", "a1", "a2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = F.btrim("line", F.lit(BLANK))
    # lower() knows all of Unicode, so that only lines of plain ASCII may take it
    key = F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))
    long_enough = lines.where(F.length(bare) >= LEAST_CHARS)
    return long_enough.select("doc", "a1", "a2", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def hot_hashes(lines: DataFrame) -> DataFrame:
    """The h1 that more lines hold than an even range would have: `HOT` at most."""
    k = min(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), HOT)
    some = lines.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("lot"))
    sketches = some.agg(F.expr(f"approx_top_k_accumulate(h1, {10 * k})").alias("sketch"), F.count("*").alias("n"))
    top = sketches.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(sketch, {10 * k})").alias("sketch"), F.sum("n").alias("n"))  # no row for no lines
    found = top.select("n", F.explode(F.expr(f"approx_top_k_estimate(sketch, {k})")).alias("top"))
    return found.where(F.col("top.count") * k > F.col("n")).select(F.col("top.item").alias("h1"))


def repeats(lines: DataFrame) -> DataFrame:
    """(doc, a1, a2, pos) of the lines whose key also stands in a document before."""
    hot = F.broadcast(durable(hot_hashes(lines)))
    often = lines.join(hot, "h1")
    least = durable(often.groupBy("h1", "h2").agg(F.min("doc").alias("first")))  # null only if no number holds the key
    later_often = often.join(F.broadcast(least), ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("first")))

    ranged = lines.join(hot, "h1", "left_anti").repartitionByRange("h1", "h2")
    stream = Window.partitionBy("h1", "h2").orderBy(F.col("doc").asc_nulls_last(), "a1", "a2", "pos")
    later = ranged.withColumn("first", F.first("doc").over(stream)).where(~F.col("doc").eqNullSafe(F.col("first")))
    at = ["doc", "a1", "a2", "pos"]
    return later.select(*at).unionByName(later_often.select(*at))


def packed(gone: DataFrame) -> DataFrame:
    """`gone` with its ascending positions `gone` as `keep`: a byte with the width of a number, then the edges of the
    runs (first position, position behind the last)."""
    at = F.col("gone")
    first = F.filter(at, lambda p, i: (i == 0) | (F.get(at, i - 1) != p - 1))
    behind = F.transform(F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != p + 1)), lambda p: p + 1)
    last = F.element_at(at, -1) + 1
    width = F.when(last < 2**8, 1).when(last < 2**16, 2).otherwise(4)
    digits = F.transform(F.flatten(F.zip_with(first, behind, lambda s, e: F.array(s, e))), lambda e: F.lpad(F.hex(e.cast("long")), 2 * width, F.lit("0")))
    return gone.withColumn("keep", F.unhex(F.concat(F.lit("0"), width.cast("string"), F.array_join(digits, ""))))


def edges(keep: Column) -> Column:
    """The run edges that `packed` holds; none for an empty or null bitmap."""
    digits = F.hex(keep)
    numbers = F.regexp_extract_all(F.substring(digits, F.lit(3), F.length(digits)), F.concat(F.lit(".{"), F.substring(digits, 2, 1).cast("int") * 2, F.lit("}")), F.lit(0))
    return F.when(F.octet_length(keep) > 1, F.transform(numbers, lambda n: F.conv(n, 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def bitmaps(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc, a1, a2, n_dropped, keep) of the documents that lose lines; `a1`, `a2` address the text."""
    lines = written(line_hashes(docs, doc_id))
    gone = repeats(lines).groupBy("doc", "a1", "a2").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    return packed(gone).select("doc", "a1", "a2", F.size("gone").cast("long").alias("n_dropped"), "keep")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """Every row of `docs` with its number of lines, its number of lines dropped and its bitmap, and those columns'
    names (with underscores in front where `docs` has such columns)."""
    n_lines, n_dropped, keep, *own = names = fresh(docs, "n_lines", "n_dropped", "keep", "_doc", "_a1", "_a2")
    found = bitmaps(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    found = found.toDF(*own, n_dropped, keep)
    a1, a2 = address(text)
    same = F.col(doc_id).eqNullSafe(F.col(own[0])) & (a1 == F.col(own[1])) & (a2 == F.col(own[2]))
    counted = F.size(F.split(whole(text), "\n", -1)).cast("long").alias(n_lines)
    out = docs.join(found, same, "left")
    return out.select(*[out[c] for c in docs.columns], counted, F.coalesce(n_dropped, F.lit(0)).alias(n_dropped), F.coalesce(keep, F.unhex(F.lit(""))).alias(keep)), names[:3]


def kept(deduped: DataFrame, keep: str = "keep", text: str = "text") -> DataFrame:
    """`deduped` with the lines of `text` that the bitmap `keep` leaves."""
    (at,) = fresh(deduped, "edges")
    runs = F.floor(F.size(at) / 2).cast("int")
    begin = lambda k: F.when(k == 0, 0).otherwise(F.get(at, 2 * k - 1))
    stays = lambda k: F.array_repeat(F.lit(True), F.get(at, 2 * k) - begin(k))
    goes = lambda k: F.array_repeat(F.lit(False), F.get(at, 2 * k + 1) - F.get(at, 2 * k))
    bits = F.flatten(F.transform(F.sequence(F.lit(0), runs - 1), lambda k: F.concat(stays(k), goes(k))))
    # lines behind the last edge have no bit, and array_join leaves nulls out
    left = F.array_join(F.zip_with(F.split(whole(text), "\n", -1), bits, lambda line, bit: F.when(F.coalesce(bit, F.lit(True)), line)), "\n")
    return deduped.withColumn(at, edges(F.col(keep))).withColumn(text, F.when(F.size(at) > 0, left).otherwise(F.col(text))).drop(at)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept(found).select("doc_id", "n_lines", "n_dropped", F.sha2(whole(), 256).alias("kept_sha256"), F.lower(F.hex("keep")).alias("keep"))
