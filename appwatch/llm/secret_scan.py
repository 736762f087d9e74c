"""Secret scans over every historical version of a text, with an incremental ledger of blobs.

Each version is addressed by the SHA-256 of its content. The ledger, Parquet in shared storage, has one
row for each pair of a blob and a rule version that was scanned, with the spans found (none is an empty
list, so a clean blob is not scanned again). A scan reads the texts of blobs that some current rule
version has not seen, each once however many versions share it, appends what it finds, and joins the
ledger back to all versions. A new rule version scans every blob for that rule only.

All of it is DataFrame functions. Matches are the leftmost ones that do not overlap, per rule: the text is
cut at its matches, and running sums over the lengths of the pieces and of the matches give the spans,
in characters, end exclusive. A blob that holds a third of all versions is scanned once and its row
is broadcast to them (:func:`common.spread_join`).

Cases: a null text counts as empty. Empty texts have no spans and are recorded once. Texts of any length
are scanned whole. Repeated rows, and rows that repeat an id, each get a row with the findings of their
own text. An empty table gives an empty result and an empty ledger entry. Other columns are kept by
:func:`scan`, but for those with the name of a new one, which are replaced. If two scans run at the same
time both may record a pair; one of the rows is read, and they are equal. A scan that dies leaves the ledger as it was.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from appwatch.llm import common
from appwatch.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the fewest characters of ``group`` (0: of the whole match).

    Matches that are too short are dropped after matching, so they still use up their characters.
    A change of pattern or length needs a new ``version``.
    """

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0


# Kinds, patterns and lengths of the base rules. Letter cases are spelt out because engines
# differ in what else "ignore case" matches. Runs of one class are maximal, so their least length can
# stand in the pattern and short runs, of which prose is full, are never listed.
KEYWORD = "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")
)
RULES = (
    Rule("assign", 1, rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}", 18),
    Rule("hex", 1, "[0-9a-f]{16,}", 16),
)

LEDGER = "blob string, kind string, version int, spans array<struct<start: bigint, end: bigint>>"


def address(versions: DataFrame, text_col: str = "text", blob: str = "blob") -> DataFrame:
    """``versions`` with the address of their content."""
    text = F.coalesce(common.field(versions, text_col, "string"), F.lit(""))
    return versions.withColumn(blob, F.sha2(text.cast("binary"), 256))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All pairs scanned so far, each once; empty where no ledger is."""
    try:
        rows = spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.range(0).select(F.from_json(F.lit(None).cast("string"), LEDGER).alias("r")).select("r.*")
    return rows.dropDuplicates(["blob", "kind", "version"])


def _cut(text: Column, rule: Rule) -> Column:
    """The matches of a rule in order: length of what lies before each, its own length, and whether it is long enough."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    before = F.transform(F.split(text, rule.pattern, -1), lambda piece: F.length(piece))
    # One piece more than there are matches: what follows the last one.
    zipped = F.arrays_zip(before.alias("before"), found.alias("found"), judged.alias("judged"))
    parts = F.transform(
        F.filter(zipped, lambda m: m["found"].isNotNull()),
        lambda m: F.struct(
            m["before"].cast("long").alias("before"),
            F.length(m["found"]).cast("long").alias("width"),
            (F.length(m["judged"]) >= rule.least).alias("fits"),
        ),
    )
    return F.when(text.rlike(rule.pattern), parts)


def unseen(versions: DataFrame, seen: DataFrame, rules: tuple[Rule, ...], text_col: str = "text") -> DataFrame:
    """One row per blob with a rule version that the ledger lacks: ``blob``, its ``content`` and the rules ``due``.

    Copies are thinned out before the shuffle, to one per task.
    """
    text = F.coalesce(common.field(versions, text_col, "string"), F.lit(""))
    blobs = address(versions, text_col, "_blob").select(F.col("_blob").alias("blob"), text.alias("content")).dropDuplicates(["blob"])
    name = F.concat_ws(":", "kind", F.col("version").cast("string"))
    done = seen.groupBy("blob").agg(F.collect_set(name).alias("done"))
    wanted = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    due = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
    return blobs.join(done, "blob", "left").select("blob", "content", due.alias("due")).where(F.size("due") > 0)


def find(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of the due rules of blobs."""
    cuts = [
        F.when(
            F.array_contains("due", f"{r.kind}:{r.version}"),
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _cut(F.col("content"), r).alias("cut")),
        )
        for r in rules
    ]
    # Everything below stays with its blob: no other shuffle than the one that brought copies together.
    scanned = blobs.select("blob", F.explode(F.array_compact(F.array(*cuts))).alias("r"))
    matches = scanned.select("blob", "r.kind", "r.version", F.posexplode_outer("r.cut").alias("pos", "m"))
    key = ["blob", "kind", "version"]
    upto = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.before") + F.col("m.width")).over(upto)
    placed = matches.select(*key, F.when(F.col("m.fits"), F.struct((end - F.col("m.width")).alias("start"), end.alias("end"))).alias("span"))
    return placed.groupBy(*key).agg(F.array_sort(F.collect_list("span")).alias("spans"))


def record(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
    """Scan what the ledger lacks and append it; the ledger is a folder that all executors reach."""
    seen = read_ledger(versions.sparkSession, ledger)
    find(unseen(versions, seen, rules, text_col), rules).write.mode("append").option("compression", "zstd").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per blob, the spans of current rule versions in order of start and rule: ``found``, structs (start, no, kind, end)."""
    current = reduce(Column.__or__, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules])
    number = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    spans = F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), number.alias("no"), F.col("kind").alias("kind"), s["end"].alias("end"))
    )
    rows = read_ledger(spark, ledger).where(current).select("blob", spans.alias("found")).where(F.size("found") > 0)
    return rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))


def scan(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``versions`` with their ``blob`` and the spans ``found``, scanning only what the ledger lacks.

    Without a ``ledger`` a new one is begun in the shared folder.
    """
    spark = versions.sparkSession
    ledger = ledger or scratch_path(spark, "secret-ledger")
    record(versions, ledger, rules, text_col)
    versions = common.without(versions, ("blob", "found"))
    narrow = address(versions, text_col)
    joined = common.spread_join(narrow, findings(spark, ledger, rules), ["blob"])
    nothing = F.array().cast("array<struct<start: bigint, no: bigint, kind: string, end: bigint>>")
    return joined.withColumn("found", F.coalesce("found", nothing))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = RULES,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, spans of each base rule counted, digest of the base spans, and all spans as text."""
    # Texts are addressed before the findings come, so only ids and addresses meet them.
    texts = docs.select(common.field(docs, id_col, "long").alias("doc_id"), common.field(docs, text_col, "string").alias("text"))
    found = scan(texts, ledger, rules).drop("text")
    kinds = [r.kind for r in base]
    basic = F.filter("found", lambda s: s["kind"].isin(kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, kinds), F.sha2(_listed(basic).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans")
    )
