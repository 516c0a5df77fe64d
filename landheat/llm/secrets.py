"""Secret scans over a ledger of blobs: each content is scanned once per rule version, findings go to all its paths.

Only DataFrame functions are used here: no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landheat.llm.common import text_key, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least length of a group (0: the whole match) of a match that counts."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1
    base: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base rules, then those that the method adds. Their order is that of kinds within a start.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, 12, 2, base=True),
    # a run is matched as a whole or not at all, so a least length may stand in the pattern of these two
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)

LEDGER = "blob string, rules array<string>, found array<struct<start: int, place: int, kind: string, end: int>>"
MASK = "[SECRET]"


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, path, blob): every document is a version; a blob is named by the SHA-256 of its content (null: empty)."""
    return docs.select("doc_id", text_key("doc_id").alias("path"), blob_name("text").alias("blob"))


def blob_name(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def scanned(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of blobs (blob, content, todo): scans each content by the rules named in its todo.

    Spark's functions give matches but no places; both follow from the lengths of the matches and of the text between
    them, which one running sum per blob and kind adds up. Only contents with a match get that far.
    """
    content = F.col("content")

    def parts(place: int, rule: Rule) -> Column:
        pattern = F.lit(rule.pattern)
        match, counted = F.regexp_extract_all(content, pattern, F.lit(0)), F.regexp_extract_all(content, pattern, F.lit(rule.group))
        lengths = F.arrays_zip(
            F.transform(F.split(content, rule.pattern, -1), F.length).alias("gap"), F.transform(match, F.length).alias("long"), F.transform(counted, F.length).alias("counted")
        )
        found = F.struct(F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), lengths.alias("lengths"))
        return F.when(F.array_contains("todo", rule.name) & content.rlike(rule.pattern), found)

    hits = blobs.select("blob", F.explode(F.array_compact(F.array(*(parts(k, r) for k, r in enumerate(rules))))).alias("rule"))
    hits = hits.select("blob", "rule.place", "rule.kind", "rule.least", F.posexplode("rule.lengths").alias("turn", "one"))
    so_far = Window.partitionBy("blob", "place").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("one.gap") + F.coalesce("one.long", F.lit(0))).over(so_far).cast("int")
    hits = hits.withColumn("end", end).filter("one.long is not null and one.counted >= least")
    return hits.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("one.long")).alias("start"), "place", "kind", "end"))).alias("found"))


def updated_ledger(docs: DataFrame, known: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger rows to add: blobs of `known` (see versions) that are unseen, alone or under some rule's version.

    Of each such blob one path's text is fetched and scanned; a row tells the rules it was scanned by and what they
    found, also where that is nothing.
    """
    names = F.array(*(F.lit(r.name) for r in rules))
    todo = known.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        todo = todo.withColumn("todo", names)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn("todo", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.filter(F.size("todo") > 0).drop("seen")
    todo = written(todo, "unseen-blobs")
    texts = docs.select(text_key("doc_id").alias("path"), blob_name("text").alias("blob"), F.coalesce("text", F.lit("")).alias("content"))
    # rows that repeat a path and text are one version: each partition hands on one of them, already dealt for the join
    texts = texts.groupBy("path", "blob").agg(F.first("content").alias("content"))
    found = scanned(texts.join(todo, ["path", "blob"]).select("blob", "content", "todo"), rules)
    return todo.join(written(found, "found"), "blob", "left").select("blob", F.col("todo").alias("rules"), F.coalesce("found", F.array().cast("array<struct<start: int, place: int, kind: string, end: int>>")).alias("found"))


def kept_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger that scans have appended to path; empty where there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found) by the rules' present versions, only for blobs in which they found something."""
    names = F.array(*(F.lit(r.name) for r in rules))
    kinds = F.transform(F.array_intersect("rules", names), lambda n: F.substring_index(n, "@", 1))
    now = ledger.filter(F.size("found") > 0).select("blob", F.filter("found", lambda x: F.array_contains(kinds, x.kind)).alias("found"))
    now = now.groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    return now.filter(F.size("found") > 0)


def spans_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, ledger_path: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row per document.

    Null texts are empty; texts of any length are scanned whole; spans that begin together go by kind; null ids and
    repeated rows keep their rows; an empty table gives no rows; other columns are ignored, whatever their names. With
    ledger_path the ledger kept there is read, and what it lacks is scanned and appended to it, so a second run over
    the same versions and rules scans nothing.
    """
    if ledger_path is not None:
        ledger = kept_ledger(docs.sparkSession, ledger_path)
    known = written(versions(docs), "versions")
    rows = written(updated_ledger(docs, known, ledger, rules), "ledger")
    if ledger_path is not None:
        rows.write.mode("append").parquet(ledger_path)
        rows, ledger = kept_ledger(docs.sparkSession, ledger_path), None
    rows = rows if ledger is None else rows.unionByName(ledger)
    now = findings(rows, rules)
    count = lambda kind: F.size(F.filter("found", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = spans_text(F.filter("found", lambda x: x.kind.isin([r.kind for r in rules if r.base])))
    now = now.select("blob", *(count(r.kind) for r in rules if r.base), base.alias("base"), spans_text(F.col("found")).alias("spans"))
    out = known.join(written(now, "findings"), "blob", "left")
    counts = [F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return out.select("doc_id", *counts, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with each secret in their text replaced by a mark, those that overlap by one; the others as they are.

    Null texts stay null; n_chars, if there, follows the text; repeated rows and null ids keep their rows; an empty table
    stays empty; all other columns are kept as they are, whatever their names.
    """
    rows = written(updated_ledger(docs, written(versions(docs), "versions"), None, rules), "ledger")
    cuts = written(kept_parts(findings(rows, rules)), "kept-parts")
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")  # no column of theirs meets one of ours
    out = docs.select(doc, blob_name("text").alias("blob")).join(cuts, "blob", "left")
    hit, text = F.col("parts").isNotNull(), F.col("doc")["text"]
    part = lambda x: F.when(x.stop.isNull(), F.substring(text, x.start + 1, F.length(text))).otherwise(F.substring(text, x.start + 1, x.stop - x.start))
    out = out.select("doc", hit.alias("hit"), F.when(hit, F.array_join(F.transform("parts", part), MASK)).otherwise(text).alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("hit"), F.length("text")).otherwise(F.col("doc")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def kept_parts(found: DataFrame) -> DataFrame:
    """(blob, parts): the stretches of text between a blob's spans, in order; the last has no stop.

    A span that begins before an earlier one ends adds no mark of its own.
    """
    spans = found.select("blob", F.explode("found").alias("x")).select("blob", "x.start", "x.end")
    before = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = spans.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    last = F.struct(F.max("end").alias("start"), F.lit(None).cast("int").alias("stop"))
    inner = F.array_compact(F.collect_list(F.when(F.col("start") >= F.col("from"), F.struct(F.col("from").alias("start"), F.col("start").alias("stop")))))
    return gaps.groupBy("blob").agg(F.concat(F.sort_array(inner), F.array(last)).alias("parts"))
