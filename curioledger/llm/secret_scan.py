"""Secret scans over an incremental ledger of blobs.

Every version of every text is addressed by its content. The ledger is a table that says which blob
has been scanned under which rule version and what was found; a scan reads the ledger, takes the
blobs that lack some pair, each once, applies the missing rules only, and appends. A span is kept
under the rule version that found it. Findings are those of the rule versions asked for, joined back
to all paths that hold the blob, however many hold the same one.
"""

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import scratch_path, settle
from .joins import spread_join
from .spans import joined, located, matches

MASK = "[secret]"


@dataclass(frozen=True)
class Rule:
    """A pattern under a version; ``cue`` is a text without which it cannot match."""

    name: str
    version: int
    pattern: str
    cue: str | None = None
    value_from: int = 0

    @property
    def id(self) -> str:
        return f"{self.name}@{self.version}"


ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)

# The first three are the base; the order of the list ranks spans that start together.
RULES = (
    Rule("assign", 1, ASSIGN, value_from=6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+", "-----BEGIN "),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", "_"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+", "eyJ"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
    Rule("login", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{6,128}@[A-Za-z0-9]", "://"),
)
BASE = 3

FOUND = "array<struct<rule:string,start:int,end:int>>"
LEDGER = f"blob binary, rules array<string>, found {FOUND}"


def _address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _hits(rule: Rule, text: Column) -> Column:
    hits = matches(text, rule.pattern)
    return F.when(F.contains(text, F.lit(rule.cue)), hits).otherwise(F.array().cast("array<string>")) if rule.cue else hits


def _spans(rule: Rule, text: Column, hits: Column) -> Column:
    spans = located(text, rule.pattern, hits)
    if rule.value_from:
        spans = F.filter(
            spans,
            lambda s: F.length(F.regexp_extract(s["hit"], rule.pattern, 1)) >= rule.value_from,
        )
    return F.transform(
        spans, lambda s: F.struct(F.lit(rule.id).alias("rule"), s["start"].alias("start"), s["end"].alias("end"))
    )


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of ``blobs(blob, text, missing)``: each under the rules it misses."""
    text = F.col("text")
    hits = blobs.select(
        "blob",
        "text",
        "missing",
        *[
            F.when(F.array_contains("missing", r.id), _hits(r, text)).alias(f"hits{k}")
            for k, r in enumerate(rules)
        ],
    )
    none = F.array().cast(FOUND)
    found = [
        F.when(F.size(f"hits{k}") > 0, _spans(r, text, F.col(f"hits{k}"))).otherwise(none)
        for k, r in enumerate(rules)
    ]
    return hits.select("blob", F.col("missing").alias("rules"), F.concat(*found).alias("found"))


def _read(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows; a ledger not begun has none."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _state(rows: DataFrame) -> DataFrame:
    """One row per blob; a blob has at most one ledger row per rule version."""
    merged = rows.groupBy("blob").agg(
        F.flatten(F.collect_list("rules")).alias("rules"),
        F.flatten(F.collect_list("found")).alias("found"),
    )
    return merged


def scan_new(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> int:
    """Scan what ``versions(text)`` holds and the ledger lacks, append it, return the blobs scanned.

    The text of an unseen blob is shuffled once, after equal blobs of a task have been combined.
    """
    spark = versions.sparkSession
    wanted = F.array(*[F.lit(r.id) for r in rules])
    text = F.coalesce(F.col("text"), F.lit(""))
    blobs = versions.select(_address(F.col("text")).alias("blob"), text.alias("text"))
    seen = _read(spark, ledger)
    if seen.isEmpty():
        unseen = blobs.withColumn("missing", wanted)
    else:
        known = _state(seen).select("blob", "rules")
        missing = F.array_except(wanted, F.coalesce("rules", F.array().cast("array<string>")))
        unseen = spread_join(blobs, known, "blob", "left").withColumn("missing", missing)
        unseen = unseen.filter(F.size("missing") > 0).select("blob", "text", "missing")
    once = unseen.groupBy("blob").agg(F.first("text").alias("text"), F.first("missing").alias("missing"))
    fresh = scan_blobs(once, rules)
    at = scratch_path(spark, "scan")
    fresh.write.parquet(at)
    done = spark.read.schema(LEDGER).parquet(at)
    number = done.count()
    if number:
        done.write.mode("append").parquet(ledger)
    return number


def _ranked(found: Column, rules: tuple[Rule, ...]) -> Column:
    """The spans of these rule versions by start, then rank, which is a rule's place in the list."""
    ids = F.array(*[F.lit(r.id) for r in rules])
    own = F.filter(found, lambda s: F.array_contains(ids, s["rule"]))

    def placed(span: Column) -> Column:
        rank = (F.array_position(ids, span["rule"]) - 1).cast("int")
        return F.struct(span["start"].alias("start"), rank.alias("rank"), span["end"].alias("end"))

    return F.array_sort(F.transform(own, placed))


def findings(versions: DataFrame, ledger: str, key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(key, found)`` of every path: the spans of its blob under these rule versions, in text order.

    Spans are ``start, rank, end``; a rule's rank is its place in ``rules``. What other versions have
    found, older ones or rules no longer asked for, stays in the ledger and out of the result.
    """
    order = _ranked(F.coalesce("found", F.array().cast(FOUND)), rules)
    paths = versions.select(key, _address(F.col("text")).alias("blob"))
    # Blobs without a finding need no row here: the join is a left one.
    state = _state(_read(versions.sparkSession, ledger).filter(F.size("found") > 0))
    return spread_join(paths, state.select("blob", "found"), "blob", "left").select(key, order.alias("found"))


def find_secrets(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Secrets of every row of ``docs(doc_id, text)``, by way of the ledger at a path.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``. A null text is an empty one
    and has none; equal texts, repeated rows and null ids each come back with the findings of their
    blob; spans of one start are ordered by rule, then end; an empty table gives no rows. Without a
    path the ledger begins empty. Other columns are not read.
    """
    ledger = ledger or scratch_path(docs.sparkSession, "ledger")
    scan_new(docs, ledger)
    found = findings(docs, ledger)
    names = [r.name for r in RULES]
    base = F.filter("found", lambda s: s["rank"] < BASE)

    def counted(rank: int) -> Column:
        return F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        "doc_id",
        *[counted(k).alias(f"n_{r.name}") for k, r in enumerate(RULES[:BASE])],
        F.sha2(joined(base, names), 256).alias("base_sha256"),
        joined(F.col("found"), names).alias("spans"),
    )


def masked(text: Column, found: Column) -> Column:
    """The text with every run of overlapping spans replaced by a mask."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept"))

    def step(done: Column, span: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, span["start"] - done["at"])
        opened = F.concat(done["kept"], F.array(gap, F.lit(MASK)))
        return F.struct(
            F.greatest(done["at"], span["end"]).alias("at"),
            F.when(span["start"] >= done["at"], opened).otherwise(done["kept"]).alias("kept"),
        )

    def close(done: Column) -> Column:
        rest = F.substring(text, done["at"] + 1, F.length(text))
        return F.concat(F.array_join(done["kept"], ""), rest)

    return F.aggregate(found, first, step, close)


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs``, all rows and columns, with the secrets in their texts masked and n_chars in step.

    Texts without a secret come back as they are, null and empty ones included; very long texts are
    masked whole. Repeated rows and null ids are rows like any other, and rows that share a text share
    its findings. An empty table stays empty.
    """
    ledger = scratch_path(docs.sparkSession, "ledger")
    scan_new(docs, ledger)
    state = _state(_read(docs.sparkSession, ledger).filter(F.size("found") > 0))
    state = settle(state.select("blob", _ranked(F.col("found"), RULES).alias("found")))
    # The table's columns travel as one, so none of theirs can clash with ours.
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    ours = docs.select(whole, _address(docs["text"]).alias("blob"))
    text, found = F.col("row.text"), F.col("found")
    clean = F.when(found.isNull(), text).otherwise(masked(text, found))
    done = spread_join(ours, state, "blob", "left").select("row", "found", clean.alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        chars = F.length("clean").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(found.isNull(), F.col("row.n_chars")).otherwise(chars)
    return done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
