"""Secret scans over an incremental blob ledger, with DataFrame functions only.

A text is a version of a path (here a document). Its blob address is the SHA-256 of the text. The ledger holds one row
for each (blob, rule, rule version) that was ever scanned, with the spans found, and is a folder of Parquet files that
scans add to. A scan takes the distinct blobs of the versions at hand, drops the pairs that the ledger has, scans each
remaining blob once, and joins the spans back to every path that holds the blob.

Positions come from two passes of the same pattern: the gaps (`split`) and the matches (`regexp_extract_all`) of a text
alternate, so their running sum gives code point offsets. Only texts with matches are taken apart for it.

Rows: a null text counts as empty; a null or repeated doc_id is a path like any other; extra columns are dropped; an
empty table gives an empty one. Texts are scanned whole, whatever their length and number of matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import write_table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `pattern` finds candidates, leftmost and non-overlapping; a candidate counts if its `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


#: The base kinds, in the order that breaks ties, then kinds that the method adds.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # A shorter run can hold no match, so the run is asked for at its least length; that finds the same spans faster.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

LEDGER_SCHEMA = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"


_SPANS = "array<struct<start:int,end:int>>"


def _parts(text: Column, rule: Rule) -> Column:
    """The gaps and matches of a rule in a text, in order; null without a match."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(kept, F.length).alias("kept"))
    return F.when(text.rlike(rule.pattern), parts)


def _placed(scans: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """`scans` (blob, kind, version, parts) with `spans` in place of parts: running sums over the matches of a blob."""
    least = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.least))])
    hits = scans.where("parts is not null").dropDuplicates(["blob", "kind", "version"])
    x = hits.select("blob", "kind", "version", F.posexplode("parts").alias("no", "p")).where("p.size is not null")
    upto = Window.partitionBy("blob", "kind", "version").orderBy("no")
    x = x.select("blob", "kind", "version", F.sum(F.col("p.gap") + F.col("p.size")).over(upto).cast("int").alias("end"), "p.size", "p.kept")
    x = x.where(F.col("kept") >= least[F.col("kind")])
    found = x.groupBy("blob", "kind", "version").agg(F.array_sort(F.collect_set(F.struct((F.col("end") - F.col("size")).alias("start"), "end"))).cast(_SPANS).alias("spans"))
    # A blob whose candidates were all too short has been scanned as well, and so has one without any.
    nothing = scans.where("parts is null").select("blob", "kind", "version", F.array().cast(_SPANS).alias("spans"))
    return nothing.unionByName(hits.select("blob", "kind", "version", F.array().cast(_SPANS).alias("spans")).join(found.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")).unionByName(found)


def blobs_of(versions: DataFrame) -> DataFrame:
    """(doc_id, blob) of every version."""
    return versions.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob"))


def scan_new_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger rows for the (blob, rule version) pairs of `versions` that `ledger` hasn't.

    Each blob is scanned in the row of its first path alone; only that row's text moves, and the copies of a hot blob
    are combined to one address before they do.
    """
    addressed = versions.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob"))
    blobs = addressed.groupBy("blob").agg(F.min("doc_id").alias("rep"))
    todo_column = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        todo = blobs.select("blob", "rep", todo_column.alias("todo"))
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
        todo = blobs.join(seen, "blob", "left").select("blob", "rep", F.when(F.col("seen").isNull(), todo_column).otherwise(F.array_except(todo_column, "seen")).alias("todo")).where(F.size("todo") > 0)
    first = todo.select(F.col("blob").alias("b"), "rep", "todo")
    texts = addressed.join(first, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("blob") == F.col("b"))).select("blob", "text", "todo")
    def row(r: Rule) -> Column:
        due = F.array_contains("todo", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")))
        return F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), (F.lit(True) if ledger is None else due).alias("due"), _parts(F.col("text"), r).alias("parts"))

    # A path that is repeated brings its blob's rows twice, and alike: the ledger is read as a set.
    scans = texts.select("blob", F.inline(F.filter(F.array(*map(row, rules)), lambda x: x["due"]))).drop("due")
    return _placed(write_table(scans, "secret-scans"), rules)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def scan_increment(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at `path` hasn't, adds it there, and returns the whole ledger. The first scan makes the ledger.

    Rows of a scan that was cut off are there twice after the next one, and alike; the ledger is read as a set.
    """
    spark = versions.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    scan_new_blobs(versions, read_ledger(spark, path) if there else None, rules).write.mode("append").option("compression", "zstd").parquet(path)
    return read_ledger(spark, path)


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, found array<struct<kind,start,end>>): every path with what the ledger holds for its blob under these rules."""
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    hits = ledger.where((F.size("spans") > 0) & F.array_contains(wanted, F.struct("kind", "version")))
    by_blob = (
        hits.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("kind").alias("kind"), s["end"].alias("end"))).alias("found"))
        .groupBy("blob")
        .agg(F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"))
    )
    return blobs_of(versions).join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("found", F.array().cast("array<struct<start:int,kind:string,end:int>>")).alias("found"))


def ordered(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The spans by start, then kind as listed."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    keyed = F.transform(found, lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digests(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    base = [r.kind for r in BASE_RULES]
    s = findings.select("doc_id", ordered(F.col("found"), rules).alias("all"))
    s = s.select("doc_id", "all", F.filter("all", lambda x: x["kind"].isin(base)).alias("base"))
    counts = [F.size(F.array_remove(F.transform("base", lambda x: x["kind"]), k)).alias(k) for k in base]
    counts = [(F.size("base") - c).cast("long").alias(f"n_{k}") for c, k in zip(counts, base)]
    return s.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
