"""Secret scans over an incremental ledger of blobs, with DataFrame functions alone.

A blob is a text under its SHA-256; a path is a document in one of its historical versions. Each
distinct blob is scanned once, and only by the rules in the versions that the ledger hasn't seen it
under; findings then go to every path that has the blob. The ledger is a folder of tables, one for
each scan, that later sessions go on with; a scan that breaks off leaves nothing in it. Blobs are
held against the ledger and the paths by shuffled joins, whose skewed keys Spark can split; nothing
is collected.

Where a regular expression matches, and not only what, follows from two functions that walk the
same leftmost matches: split() gives the text between them and regexp_extract_all() the matches,
so that running lengths give code-point offsets.

Defined results: rows without an id are left out; null text counts as empty and has no finding;
repeated rows are paths of one blob and each get its findings; null versions count as version 0;
other columns are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace


@dataclass(frozen=True)
class Rule:
    """A pattern and, where matches of a least length count only, the group that has to have it. Change the version with any of these.

    hint: text that is in every match; texts without it are spared the pattern.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hint: str = ""
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", hint="AKIA"),  # as AKIA[A-Z0-9]+ of 20 characters and more: a shorter match holds no longer one
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("chat", r"xox[abeprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35,}", hint="AIza"),
)
RULES = BASE + MORE
SPAN = "array<struct<start: int, rank: int, end: int>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of the rule's matches as SPAN, by start. Only texts that match at all are taken apart."""
    hits, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    lengths = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x))
    each = F.arrays_zip(F.transform(between, lambda x: F.length(x)).alias("gap"), F.transform(hits, lambda x: F.length(x)).alias("size"), lengths.alias("held"))
    none = F.lit(None).cast(SPAN)
    walk = F.aggregate(
        each,
        F.struct(F.lit(0).alias("at"), F.coalesce(none, F.array().cast(SPAN)).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(
                x["held"] >= rule.least,
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + x["gap"] + x["size"]).alias("end")))),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    matches = F.contains(text, F.lit(rule.hint)) & text.rlike(rule.pattern) if rule.hint else text.rlike(rule.pattern)
    return F.when(matches, walk).otherwise(F.array().cast(SPAN))


def paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", version_col: str | None = None) -> DataFrame:
    """doc_id, version (0 without a version column), text, blob of every row."""
    text, version = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(version_col).cast("long"), F.lit(0)) if version_col else F.lit(0).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), version.alias("version"), text.alias("text")).filter("doc_id is not null").withColumn("blob", F.sha2("text", 256))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, **columns: str) -> DataFrame:
    """New rows of the ledger: blob and scans, a map from kind:version to SPAN, of the rules that were due.

    ledger: rows of earlier scans (blob, scans). A blob for which nothing is due gets no row and no scan.
    """
    all_paths = paths(docs, **columns)
    pick = all_paths.groupBy("blob").agg(F.min(F.struct("doc_id", "version")).alias("path"))
    if ledger is not None:
        seen = ledger.select("blob", F.map_keys("scans").alias("key")).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("key"))).alias("seen"))
        due = F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))
        pick = pick.join(seen, "blob", "left").select("blob", "path", due.alias("due")).filter(F.size("due") > 0)
    else:
        pick = pick.withColumn("due", F.lit(None).cast("array<string>"))
    pick = pick.select("path.doc_id", "path.version", F.col("blob").alias("picked"), "due")
    blobs = all_paths.select("doc_id", "version", "text").join(pick, ["doc_id", "version"]).withColumn("blob", F.sha2("text", 256)).filter("blob = picked")
    pairs = []
    for rank, rule in enumerate(rules):
        wanted = F.col("due").isNull() | F.array_contains("due", rule.key)
        pairs.append(F.struct(F.lit(rule.key).alias("key"), F.when(wanted, spans(F.col("text"), rule, rank)).alias("value")))
    found = F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull()))
    return blobs.select("blob", found.alias("scans"))


def findings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, **columns: str) -> DataFrame:
    """doc_id, version, blob, spans (SPAN, by start, then rank of the rule) of every path; ledger is what scan() has returned, for all blobs."""
    known = Workspace(docs.sparkSession, "ledger").keep(scan(docs, rules, None, **columns), "scans") if ledger is None else ledger

    def ranked(rule: Rule, rank: int) -> Column:  # as these rules count, whatever others the scan had
        return F.transform(F.coalesce(F.try_element_at("scans", F.lit(rule.key)), F.array().cast(SPAN)), lambda x: x.withField("rank", F.lit(rank)))

    of_rule = [ranked(r, rank) for rank, r in enumerate(rules)]
    hits = known.select("blob", F.array_sort(F.flatten(F.array(*of_rule))).alias("spans")).filter(F.size("spans") > 0)
    if ledger is not None:  # a blob has a row for each scan
        hits = hits.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    else:  # several rows of one path may have picked the same blob
        hits = hits.dropDuplicates(["blob"])
    return paths(docs, **columns).select("doc_id", "version", "blob").join(hits, "blob", "left").select("doc_id", "version", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


class Ledger:
    """The stored ledger: a folder, in a store that all executors reach, with a table for each scan."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def rows(self) -> DataFrame:
        """(blob, scans) of all scans that came to an end."""
        kind = "blob string, scans map<string, " + SPAN + ">"
        there = self._files.listStatus(self._at(self.path)) if self._files.exists(self._at(self.path)) else []
        names = sorted(name for x in there if (name := x.getPath().getName()).startswith("scan-"))
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], kind)

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, **columns: str) -> DataFrame:
        """Scan what is due and add it to the ledger; returns the rows that are new."""
        name = uuid.uuid4().hex
        scan(docs, rules, self.rows(), **columns).write.parquet(f"{self.path}/open-{name}")
        self._files.rename(self._at(f"{self.path}/open-{name}"), self._at(f"{self.path}/scan-{name}"))
        return self.spark.read.parquet(f"{self.path}/scan-{name}")

    def findings(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, **columns: str) -> DataFrame:
        """findings() of paths whose blobs have been scanned by these rules."""
        return findings(docs, rules, self.rows(), **columns)


def listed(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, marker: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The rows of docs with each finding replaced by marker (overlapping ones by one), and the size column, if there is one, made to fit."""
    hits = Workspace(docs.sparkSession, "ledger").keep(scan(docs, rules, None, id_col=id_col, text_col=text_col), "scans")
    merged = F.array_sort(F.flatten(F.map_values("scans")))
    hits = hits.select(F.col("blob").alias("__pw_blob"), merged.alias("__pw_spans")).filter(F.size("__pw_spans") > 0).dropDuplicates(["__pw_blob"])
    text = F.col(text_col).cast("string")
    out = docs.withColumn("__pw_key", F.sha2(F.coalesce(text, F.lit("")), 256)).join(hits, F.col("__pw_key") == F.col("__pw_blob"), "left")
    cut = F.aggregate(
        "__pw_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(marker))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    out = out.withColumn("__pw_text", F.when(F.col("__pw_spans").isNotNull(), cut).otherwise(text))
    cols = [F.col("__pw_text").alias(c) if c == text_col else F.when(F.col("__pw_spans").isNotNull(), F.length("__pw_text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == size_col else F.col(c) for c in docs.columns]
    return out.select(*cols)
