"""Secret scans over a ledger of content-addressed blobs; DataFrame and SQL functions only.

Every historical version of a path is addressed by the SHA-256 of its text. A blob is scanned once per rule
version, however many paths and versions hold it, and never again while the ledger has the pair.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.staging import set_aside, stage


@dataclass(frozen=True)
class Rule:
    """A pattern without look-around; a match counts if its ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The patterns of the three kinds. Runs of `access` and `hex` are maximal, so their least length
#: can stand in the pattern; a failing `assign` match still uses up its characters and is dropped afterwards.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
LEDGER = "blob binary, rule string, kind string, spans array<struct<start:bigint,end:bigint>>"
MASK = "[SECRET]"


def blob_id(text: Column) -> Column:
    """Content address; a null text is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _matches(rule: Rule) -> Column:
    """(gap before the match, length, kept) of each match, in order."""
    pattern = F.lit(rule.pattern)
    whole = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.char_length)
    gaps = F.transform(F.split("text", rule.pattern, -1), F.char_length)
    if rule.least:
        kept = F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), lambda x: F.char_length(x) >= rule.least)
    else:
        kept = F.transform(whole, lambda x: F.lit(True))
    rows = F.transform(
        F.arrays_zip(whole.alias("n"), F.slice(gaps, 1, F.size(whole)).alias("gap"), kept.alias("kept")),
        lambda x: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), x["kept"].alias("kept")))
    none = F.array().cast("array<struct<gap:int,n:int,kept:boolean>>")
    return F.when(F.col("text").rlike(rule.pattern), rows).otherwise(none)


def scan_blobs(history: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: one for each (blob, rule version) of ``history`` that the ledger lacks.

    ``history`` needs a ``text`` column. A row has the spans of the rule in the blob, an empty list where there is
    none. Copies of a text meet only after each task has dropped its own repeats, so a text that fills a third of the
    rows is one row per task; all that follows stays in the partitioning by blob.
    """
    blobs = (history.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
             .groupBy("blob").agg(F.first("text").alias("text")))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("_seen"))  # at most one per rule version
        blobs = (blobs.join(seen, "blob", "left")
                 .withColumn("_todo", F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<string>"))))
                 .where(F.size("_todo") > 0).drop("_seen"))
    else:
        blobs = blobs.withColumn("_todo", wanted)
    found = F.concat(*[
        F.when(F.array_contains("_todo", r.key),
               F.array(F.struct(F.lit(r.key).alias("rule"), F.lit(r.kind).alias("kind"), _matches(r).alias("m"))))
        .otherwise(F.array().cast("array<struct<rule:string,kind:string,m:array<struct<gap:int,n:int,kept:boolean>>>>"))
        for r in rules])
    pairs = blobs.select("blob", F.explode(found).alias("f")).select("blob", "f.rule", "f.kind", "f.m")
    each = pairs.select("blob", "rule", "kind", F.posexplode_outer("m").alias("i", "m"))
    places = each.selectExpr(
        "blob", "rule", "kind", "m.kept AS kept", "m.n AS n",
        "sum(CAST(m.gap + m.n AS BIGINT)) OVER (PARTITION BY blob, rule ORDER BY i) AS stop")
    span = F.struct((F.col("stop") - F.col("n")).alias("start"), F.col("stop").alias("end"))
    return places.groupBy("blob", "rule").agg(
        F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.when(F.col("kept"), span))).alias("spans"))


def update_ledger(history: DataFrame, ledger: DataFrame | None = None,
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with all pairs of ``history``, as a stored table; what it had is carried over unscanned."""
    fresh = stage(scan_blobs(history, ledger, rules), "ledger")
    return fresh if ledger is None else ledger.unionByName(fresh)


def ledger_of(increments: Iterable[DataFrame], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger after one increment of the history after another: each scans only the pairs that those before it lack."""
    ledger = None
    for part in increments:
        ledger = update_ledger(part, ledger, rules)
    if ledger is None:
        raise ValueError("no increment")
    return ledger


def halves(history: DataFrame) -> list[DataFrame]:
    """The history in two increments, by the middle of its ids; rows without id come with the second one."""
    middle = history.agg((F.min("doc_id") + F.max("doc_id")) / 2).scalar()
    early = F.coalesce(F.col("doc_id") < middle, F.lit(False))
    return [history.where(early), history.where(~early)]


def findings_by_row(history: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``history`` with ``findings``: (start, end, kind) by start, then kind in the order of the rules.

    Reads the ledger's rows of the given rule versions. Rows without text or findings get an empty list; a column
    named ``findings`` is replaced, all others stay. A blob that most rows share is a hot key of a plain join, which
    adaptive execution splits.
    """
    rank = F.array(*[F.lit(r.kind) for r in rules])
    rows = ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0)).select(
        "blob", F.transform("spans", lambda s: F.struct(
            s["start"].alias("start"), F.array_position(rank, F.col("kind")).alias("rank"), s["end"].alias("end"),
            F.col("kind").alias("kind"))).alias("part"))
    by_blob = stage(rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("part"))).alias("_f")), "by_blob")
    kept = [c for c in history.columns if c != "findings"]
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    out = F.transform("_f", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    keyed = history.select(*kept, blob_id(F.col("text")).alias("_blob"))
    return keyed.join(by_blob.withColumnRenamed("blob", "_blob"), "_blob", "left").select(
        *kept, F.coalesce(out, none).alias("findings"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = MASK) -> DataFrame:
    """The documents with every found secret replaced by ``mask``; rows and columns stay.

    Overlapping spans become one mask. Null and clean texts stay as they are.
    """
    docs, own = set_aside(docs, ["findings", "_blob", "_f", "blob", "part"])
    rows = findings_by_row(docs, update_ledger(docs, None, rules), rules)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.col("text").substr(acc["at"].cast("int") + 1, F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        touches = (s["start"] < acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(touches, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mask))).alias("out"))

    def finish(acc):
        return F.concat(acc["out"], F.col("text").substr(acc["at"].cast("int") + 1, F.length("text")))

    clean = F.when(F.size("findings") > 0, F.aggregate("findings", start, step, finish)).otherwise(F.col("text"))
    return rows.select(*[clean.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]).select(own)


def span_digest() -> Column:
    """kind:start:end of the findings, comma-joined."""
    return F.concat_ws(",", F.transform("findings", lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count_of(kind: str) -> Column:
    return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("bigint")
