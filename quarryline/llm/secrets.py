"""Secret scan over an incremental blob ledger, in DataFrame functions.

Every version of every text is addressed by its content. Only pairs of a blob
and a rule version that the ledger does not hold are scanned, each blob at its first path
however many paths carry it; findings then join back to all paths. Rows that
repeat that path and text are scanned with it, which leaves Spark free to split
them, and enter the ledger once.

Positions come from built-in functions alone: the gaps that `split` leaves
between the matches that `regexp_extract_all` returns add up to the offsets.

Defined results: a null text is the empty text and has no findings; repeated
rows each get the findings of their blob; a null path is kept; an empty table
yields no rows; a very long text is scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, documents, durable, fresh

RULE_VERSION = 1
#: Kinds in the order of listing, with pattern, group and least length of that group.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
SPAN = "struct<start:int,ord:int,kind:string,end:int>"


def blob_of(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def spans_of(found: Column, gaps: Column, order: int) -> Column:
    """The spans of the matches `found` of rule `order`, from the gaps around them."""
    kind, pattern, group, least = RULES[order]

    def step(acc, i):
        m = F.get(found, i)
        start = acc["at"] + F.length(F.get(gaps, i))
        end = start + F.length(m)
        kept = F.length(F.regexp_extract(m, pattern, group)) >= least if group else F.length(m) >= least
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(kept, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    folded = F.aggregate(F.sequence(F.lit(0), F.size(gaps) - 2), zero, step, lambda acc: acc["out"])
    return F.when(F.size(gaps) > 1, folded).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, text) -> (blob, rule_version, spans); spans sorted by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = blobs.select("blob", text.alias("text"), *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(k) for k, p, _, _ in RULES])
    # only texts with matches are split; columns of their own, as a fold reads its arrays again and again
    cut = found.select("blob", *[F.col(k) for k, *_ in RULES], *[F.when(F.size(k) > 0, F.split("text", p, -1)).alias(f"{k}_gaps") for k, p, _, _ in RULES])
    spans = F.array_sort(F.concat(*[spans_of(F.col(k), F.col(f"{k}_gaps"), i) for i, (k, *_) in enumerate(RULES)]))
    return cut.select("blob", F.lit(RULE_VERSION).alias("rule_version"), spans.alias("spans"))


def unseen(docs: DataFrame, ledger: DataFrame | None, path: str = "doc_id") -> DataFrame:
    """(blob, text) of each content that the ledger lacks under this rule version, of its first path."""
    texts = docs.select(F.col(path).alias("path"), blob_of().alias("blob"), "text")
    if ledger is not None:
        texts = texts.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    # only a content with several rows has to choose, so that the texts needn't move while such contents are few
    many = texts.groupBy("blob").agg(F.min("path").alias("first"), F.count("*").alias("n")).where("n > 1").select("blob", F.struct("first").alias("many"))
    chosen = F.col("many").isNull() | F.col("path").eqNullSafe(F.col("many.first"))
    return texts.join(bounded(many), "blob", "left").where(chosen).select("blob", "text")


def scan(docs: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(findings by path: `path`, `blob`, `spans`, with underscores in front where `path` has such a name; the ledger grown
    by what was scanned)."""
    blob, spans = fresh(docs.select(path), "blob", "spans")
    # the ledger is written, which also lets Spark split the paths of a hot blob in the join below
    new = durable(scan_blobs(unseen(docs, ledger, path)).dropDuplicates(["blob"]))
    grown = new if ledger is None else ledger.unionByName(new)
    # one row a blob with findings; blobs without any need no row in the join
    hits = (new if ledger is None else grown.where(F.col("rule_version") == RULE_VERSION)).where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    paths = docs.select(F.col(path), blob_of().alias(blob))
    return paths.join(hits, blob, "left").select(path, blob, F.coalesce(spans, F.array().cast(f"array<{SPAN}>")).alias(spans)), grown


def redact(docs: DataFrame, hits: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of `hits` (blob, spans) in their texts replaced by `mark`.

    Overlapping spans become one mark; rows without findings, and all other
    columns, stay as they are.
    """
    blob, spans = fresh(docs, "blob", "spans")
    text = F.col("text")

    def step(acc, s):
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    joined = docs.withColumn(blob, blob_of()).join(hits.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), blob, "left")
    return joined.withColumn("text", F.when(F.size(spans) > 0, done).otherwise(text)).select(*docs.columns)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found, _ = scan(docs)
    line = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[of(k) for k, *_ in RULES], F.sha2(line, 256).alias("base_sha256"), line.alias("spans"))
