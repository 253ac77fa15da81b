"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is a blob, named by the SHA-256 of its bytes. The ledger holds, for each blob, the rules (with their
versions) that have scanned it, and what each of them found. A scan takes the pairs of blob and rule version that the ledger
lacks, reads one text for each such blob, adds a part to the ledger, and joins the findings of the rules asked for back to every
path that holds the blob. A ledger's folder can be opened again by a later session: its parts are those that are complete.
What an older version of a rule found stays in the ledger, and is given only when that version is asked for.

Spans come from a rule's matches and the text between them, so they are in code points, leftmost and without overlap in
each kind. Null text is the empty text. A null path is a path like any other; repeated rows each get their findings.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstrata.llm.common import shared_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern of which `group` has at least `least` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


#: The base kinds in the order of their rank. A run of one class is matched whole, so a lower bound in the
#: pattern drops the same runs as a test afterwards; only assign needs the test.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
#: A PEM key from its BEGIN line to its END line, whatever the lines between hold but five dashes in a row; where END is missing,
#: headers, lines that start with 24 base64 characters or more (indented, quoted or with \\n written out), and shorter lines of
#: base64 characters only. Repeats are bounded, as Java's matcher recurses for each
#: (400 lines are more than any key has), and written so that RE2 takes them.
_JOINT = r"""[\x20\t\r\n>#*|"',\\-]"""
_PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:--?-?-?[^-]+){0,400}-----+END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_JOINT}+(?:Proc-Type|DEK-Info):[^\n\\]*){{0,2}}(?:{_JOINT}+{'[A-Za-z0-9+/]' * 24}[A-Za-z0-9+/]*=?=?){{0,400}}"
    rf"(?:[\x20\t]*[\r\n\\]{_JOINT}*[A-Za-z0-9+/]+(?:==?|[\x20\t]*(?:\r|\\n|(?m:$)))){{0,400}})"
)
#: The kinds that this method adds: formats that issuers publish.
MORE = (
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", 2, _PEM),
)
RULES = BASE + MORE

SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Spans in the ledger: of which rule and version.
_FOUND = "array<struct<start:int,end:int,rule:string>>"
_LEDGER = "blob binary, rules array<string>, spans " + _FOUND
#: Matches are added up in chunks of so many, so that a text of very many costs little more than in proportion.
_CHUNK = 256


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _running(sizes: Column) -> Column:
    """The sums before each of the sizes."""
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])


def spans(text: Column, rule: Rule) -> Column:
    """The spans of one rule in a text, as in the ledger."""
    found, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    # each match with the text before it, in chunks
    both = F.zip_with(F.slice(between, 1, F.size(found)), F.arrays_zip(found.alias("m"), value.alias("v")), lambda b, x: F.struct(F.length(b).alias("gap"), F.length(x["m"]).alias("size"), F.length(x["v"]).alias("value")))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x["gap"] + x["size"])
    span = lambda x, at, first: F.when(x["value"] >= rule.least, F.struct((first + at + x["gap"]).alias("start"), (first + at + x["gap"] + x["size"]).alias("end"), F.lit(rule.name).alias("rule")))

    def placed(xs: Column, first: Column) -> Column:
        return F.zip_with(xs, _running(F.transform(xs, lambda x: x["gap"] + x["size"])), lambda x, at: span(x, at, first))

    def chunked(all_: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _CHUNK).cast("int")), lambda k: F.slice(all_, k * _CHUNK + 1, _CHUNK))
        return F.flatten(F.zip_with(chunks, _running(F.transform(chunks, total)), placed))

    # a lambda's argument is computed once, however often it is read
    each = F.flatten(F.transform(F.array(both), lambda xs: F.when(F.size(xs) > _CHUNK, chunked(xs)).otherwise(placed(xs, F.lit(0)))))
    return F.when(text.rlike(rule.pattern), F.filter(each, lambda x: x.isNotNull())).otherwise(F.array().cast(_FOUND))


class Ledger:
    """The ledger's parts, each a table in one folder; a scan adds a part."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or shared_dir(spark, "ledger")).rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/part-*/_SUCCESS")
        done = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        #: What is there already; a part without _SUCCESS is a scan that was ended, and is scanned again.
        self.parts = sorted(x.getPath().getParent().toString() for x in done)

    def seen(self) -> DataFrame | None:
        """blob, rules, spans: one row a blob."""
        if not self.parts:
            return None
        rows = self.spark.read.schema(_LEDGER).parquet(*self.parts)
        if len(self.parts) == 1:
            return rows
        return rows.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("rules"), F.flatten(F.collect_list("spans")).alias("spans"))

    def scan(self, docs: DataFrame, paths: DataFrame, text: str, path: str, rules: tuple[Rule, ...]) -> None:
        """Scan what the ledger lacks. paths: path and blob of each row of docs."""
        names = F.array(*[F.lit(r.name) for r in rules])
        # one path for each blob: pre-aggregated by task, so copies don't meet
        todo = paths.groupBy("blob").agg(F.min(path).alias("_path"))
        if (seen := self.seen()) is not None:
            todo = todo.join(seen.select("blob", "rules"), "blob", "left").withColumn("rules", F.array_except(names, F.coalesce("rules", F.array().cast("array<string>"))))
            todo = todo.where(F.size("rules") > 0)
        else:
            todo = todo.withColumn("rules", names)
        texts = docs.select(F.col(path).alias("_p"), F.coalesce(F.col(text), F.lit("")).alias("t"))
        # the path alone picks the text's row; a path of several versions is settled by the blob
        read = texts.join(todo, F.col("_p").eqNullSafe(F.col("_path"))).where(blob(F.col("t")) == F.col("blob"))
        own = [F.when(F.array_contains("rules", r.name), spans(F.col("t"), r)).otherwise(F.array().cast(_FOUND)) for r in rules]
        found = read.select("blob", "rules", F.concat(*own).alias("spans"))
        found = found.groupBy("blob").agg(F.first("rules").alias("rules"), F.first("spans").alias("spans"))  # repeated rows
        # names rise with time, also where two sessions use one folder
        part = f"{self.folder}/part-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        found.write.parquet(part)
        self.parts.append(part)

    def hits(self, rules: tuple[Rule, ...]) -> DataFrame:
        """blob, spans: of the blobs in which these rules, in these versions, found any; spans in order of start, then of the rules."""
        kinds = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(k).alias("rank"), F.lit(r.kind).alias("kind")) for k, r in enumerate(rules)])
        of = lambda s, r: F.when(s["rule"] == r["rule"], F.struct(s["start"], r["rank"].alias("rank"), s["end"], r["kind"].alias("kind")))
        own = F.filter(F.flatten(F.transform(kinds, lambda r: F.transform("spans", lambda s: of(s, r)))), lambda s: s.isNotNull())
        return self.seen().where(F.size("spans") > 0).select("blob", F.sort_array(own).cast(SPANS).alias("spans")).where(F.size("spans") > 0)

    def findings(self, paths: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """paths with the spans of their blobs; blobs without any don't travel."""
        return paths.join(self.hits(rules), "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def _scan(docs: DataFrame, text: str, path: str, rules: tuple[Rule, ...], ledger: Ledger) -> DataFrame:
    """path and blob of each row of docs, after a scan."""
    at = shared_dir(docs.sparkSession, "paths")
    docs.select(path, blob(F.col(text)).alias("blob")).write.parquet(at)
    paths = docs.sparkSession.read.parquet(at)
    ledger.scan(docs, paths, text, path, rules)
    return paths


def scanned(docs: DataFrame, text: str = "text", path: str = "doc_id", rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None) -> DataFrame:
    """blob, path, spans: of each row of docs; spans in order of start, then of the rules."""
    ledger = ledger or Ledger(docs.sparkSession)
    return ledger.findings(_scan(docs, text, path, rules, ledger), rules)


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text: str = "text", path: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs, with each span of a secret replaced by its kind in brackets; overlapping spans are replaced as one."""
    ledger = Ledger(docs.sparkSession)
    _scan(docs, text, path, rules, ledger)
    # a new ledger has one part, with one row a blob: a plain join, so that a blob with many paths can be split. The document's
    # columns travel as one, so that their names don't matter
    found, t = ledger.hits(rules), F.col("t")
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("t"), blob(F.col(text)).alias("blob")).join(found, "blob", "left")

    redacted_ = F.when(F.col("spans").isNotNull(), _cut(t, F.col("spans"))).otherwise(t)
    return wide.select(*[(redacted_ if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def _cut(text: Column, found: Column) -> Column:
    """The text with each span replaced. Spans, of n, are taken in groups of about sqrt(n): a group's part of the text is cut out once,
    and its spans are cut from that part, so that a span doesn't cost the whole text's length. A lambda's argument is computed once."""
    last = lambda xs: F.coalesce(F.array_max(F.transform(xs, lambda s: s["end"])), F.lit(0))
    once = lambda x, f: F.transform(F.array(x), f)[0]

    def pieces(g: Column) -> Column:
        """What stands before each span, from the end of all earlier ones, and its kind; nothing for a span that overlaps one."""

        def piece(s: Column, i: Column) -> Column:
            return once(F.greatest(g["base"], last(F.slice(g["own"], F.lit(1), i))), lambda at: F.when(s["start"] >= at, F.concat(F.substring(g["part"], at - g["base"] + 1, s["start"] - at), F.lit("["), s["kind"], F.lit("]"))).otherwise(""))

        return F.array_join(F.transform(g["own"], piece), "")

    def grouped(xs: Column, size: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), lambda k: F.slice(xs, k * size + 1, size))
        based = lambda gs, ends: F.transform(gs, lambda own, k: F.struct(own.alias("own"), F.coalesce(F.array_max(F.slice(ends, F.lit(1), k)), F.lit(0)).alias("base")))
        with_base = once(groups, lambda gs: once(F.transform(gs, last), lambda ends: based(gs, ends)))
        part = lambda g: F.substring(text, g["base"] + 1, F.greatest(F.element_at(g["own"], -1)["start"] - g["base"], F.lit(0)))
        return F.transform(F.transform(with_base, lambda g: F.struct(g["own"], g["base"], part(g).alias("part"))), pieces)

    out = once(found, lambda xs: once(F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int"), lambda size: grouped(xs, size)))
    return F.concat(F.array_join(out, ""), F.substring(text, last(found) + 1, F.length(text)))


def _sql_spans(rule: Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, i, length(array_to_string(gaps[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS a, length(m[i]) AS size, length(v[i]) AS value, {rule.least} AS least
FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS v, string_split_regex(t, '{pattern}') AS gaps, unnest(range(1, len(m) + 1)) AS i FROM d)"""


#: DuckDB SQL for the query's columns over documents.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, rank, a, kind, concat_ws(':', kind, a, a + size) AS s FROM ({" UNION ALL ".join(_sql_spans(r, k) for k, r in enumerate(RULES))}) WHERE value >= least)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY a, rank) FILTER (rank < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY a, rank), '') AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""
