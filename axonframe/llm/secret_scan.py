"""Secret scans over a content-addressed ledger of blobs, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import new_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of pattern, dropped where group has under `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int


#: The base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),  # a run that is too short has no longer match inside it
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # likewise
)
RULE_VERSION = "base-1"


#: Matches that are walked through together. A list grows by copying, so one of n matches is walked in n / CHUNK short ones.
CHUNK = 512


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it stands in use: the one element of an array."""
    return F.get(F.transform(F.array(value), use), 0)


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, place of the kind, label) of a rule's matches in text; code points, end exclusive.

    Splitting at the matches and taking them out give the pieces of the text in turn; their lengths are the offsets.
    """
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    found = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda x: F.length(x))
    wide = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x))
    place = next((i for i, r in enumerate(BASE_RULES) if r.kind == rule.kind), len(BASE_RULES))
    none = F.array().cast("array<struct<start:int,kind:int,span:string>>")

    def walk(pieces: Column, begin: Column) -> Column:
        """The spans of pieces that begin at a place."""

        def step(state: Column, piece: Column) -> Column:
            start = state["at"] + piece["gap"]
            end = start + piece["found"]
            span = F.struct(start.alias("start"), F.lit(place).alias("kind"), F.concat_ws(":", F.lit(rule.kind), start.cast("string"), end.cast("string")).alias("span"))
            return F.struct(end.alias("at"), F.when(piece["wide"] >= rule.least, F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

        return F.aggregate(pieces, F.struct(begin.alias("at"), none.alias("out")), step, lambda state: state["out"])

    def begins(chunks: Column) -> Column:
        """Where each chunk of pieces begins, and behind them where the last one ends."""
        length = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, piece: n + piece["gap"] + piece["found"]))
        return F.aggregate(length, F.array(F.lit(0)), lambda out, n: F.array_append(out, F.element_at(out, -1) + n))

    def in_chunks(pieces: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int"))
        chunks = F.transform(numbers, lambda c: F.slice(pieces, c * CHUNK + 1, CHUNK))
        return _once(chunks, lambda c: F.flatten(F.zip_with(c, F.slice(begins(c), 1, F.size(c)), walk)))

    pieces = F.zip_with(F.arrays_zip(found.alias("found"), wide.alias("wide")), F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(g.alias("gap"), m["found"].alias("found"), m["wide"].alias("wide")))
    return F.when(text.rlike(rule.pattern), _once(pieces, in_chunks)).otherwise(none)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Findings (blob, found) of blobs (blob, text): found lists (start, kind, span) by start, then kind."""
    return blobs.select("blob", F.array_sort(F.concat(*[spans(F.col("text"), r) for r in rules])).alias("found"))


def blob_of(text: Column) -> Column:
    """Content address of a text; a null text is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan_versions(versions: DataFrame, ledger: str, path_cols: list[str], text: str = "text", rules: tuple[Rule, ...] = BASE_RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings of every version: path_cols, blob and found (null text: that of the empty text).

    versions: one row for each path and version of it. ledger: a folder of Parquet, one folder for each scan, with
    (rule_version, blob, found) of everything scanned before; it may not exist yet. Only blobs that the ledger lacks
    under this rule version are scanned, each once however many paths hold it, and the ledger grows by them, so a
    second call scans nothing. Two calls at once may both add a blob, which is read once. The findings then go back to
    all paths of a blob. Repeated rows give repeated rows,
    null paths are kept, an empty table gives an empty result, and other columns are ignored.
    """
    spark = versions.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    known = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    schema = "rule_version string, blob binary, found array<struct<start:int,kind:int,span:string>>"
    texts = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if known:
        seen = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(ledger).where(F.col("rule_version") == rule_version)
        texts = texts.join(seen.select("blob"), "blob", "left_anti")
    fresh = scan_blobs(texts.dropDuplicates(["blob"]), rules).select(F.lit(rule_version).alias("rule_version"), "blob", "found")
    fresh.write.mode("append").option("compression", "zstd").parquet(ledger)

    found = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(ledger).where((F.col("rule_version") == rule_version) & (F.size("found") > 0)).select("blob", "found").dropDuplicates(["blob"])
    paths = versions.select(*path_cols, blob_of(F.col(text)).alias("blob"))
    empty = F.array().cast("array<struct<start:int,kind:int,span:string>>")
    return paths.join(found, "blob", "left").select(*path_cols, "blob", F.coalesce("found", empty).alias("found"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs, scanned under a new ledger."""
    found = scan_versions(docs, new_path(docs.sparkSession, "ledger"), ["doc_id"])
    joined = F.array_join(F.transform("found", lambda x: x["span"]), ",")
    counts = [_count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(joined.cast("binary"), 256).alias("base_sha256"), joined.alias("spans"))


def _count(place: int) -> Column:
    return F.size(F.filter("found", lambda x: x["kind"] == place)).cast("long")
