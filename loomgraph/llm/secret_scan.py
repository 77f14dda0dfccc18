"""Secret scans over an incremental ledger of blobs.

A text is a blob, named by the SHA-256 of its bytes; the rows of a table are
the paths (or historical versions) that hold blobs. The ledger has a row for
each blob and the rule versions it was scanned with, and its findings. A run
scans only blob and rule-version pairs that the ledger lacks, each once
however many paths hold the blob, and joins findings back to every path.

DataFrame functions only. Texts are not shuffled but where a cheap test shows
that a rule may match: then one copy of the blob goes to its scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """kind, version, the pattern, the group whose length counts and its least length; hint: SQL over `_text` and `_low`, true wherever the pattern can match."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str


def _holds(*words: str, of: str = "_low") -> str:
    return "(" + " or ".join(f"contains({of}, '{w}')" for w in words) + ")"


_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: In the order in which kinds are listed; the base kinds first.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, _holds(*_KEYS)),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, _holds("AKIA", of="_text")),
    Rule("hex", 1, r"[0-9a-f]+", 0, 32, "_text rlike '[0-9a-f]{32}'"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, _holds("PRIVATE KEY-----", of="_text")),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, _holds(*(f"gh{c}_" for c in "pousr"), of="_text")),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, _holds("xox", of="_text")),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, _holds("eyJ", of="_text")),
)
BASE = ("assign", "access", "hex")
LEDGER = "sha string, rules_seen string"
FINDINGS = "sha string, kind string, version int, start bigint, end bigint"


def _rule_key(r: Rule) -> str:
    return f"{r.kind}/{r.version};"


def scan_pattern(r: Rule) -> str:
    """What is searched: for hex, runs that are too short are skipped within the search; the spans are the same."""
    return "[0-9a-f]{32,}" if r.kind == "hex" and r.least == 32 else r.pattern


def blobs(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    """path, sha and text of each row; a null text is the empty blob."""
    return docs.select(F.col(path).alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumn("sha", F.sha2(F.col("_text"), 256))


def scan(docs: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, path: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths with their sha, the new ledger rows, all findings of old and new blobs).

    ledger has the blobs scanned before with their rules (`LEDGER`), findings
    their spans (`FINDINGS`). A changed rule gets a new version, and only it is
    scanned again. Spans are in code points, end exclusive. Paths may be null
    or repeated; columns other than path and text are not read.
    """
    of = blobs(docs, path)
    paths = of.select("path", "sha")
    first = paths.groupBy("sha").agg(F.min("path").alias("path"))
    if ledger is None:
        unseen = first.withColumn("rules_seen", F.lit(""))
    else:
        seen = ledger.groupBy("sha").agg(F.array_join(F.collect_set("rules_seen"), "").alias("rules_seen"))
        unseen = first.join(seen, "sha", "left").withColumn("rules_seen", F.coalesce("rules_seen", F.lit("")))
        unseen = unseen.filter(" or ".join(f"not contains(rules_seen, '{_rule_key(r)}')" for r in RULES))
    new_ledger = unseen.select("sha", F.lit("".join(map(_rule_key, RULES))).alias("rules_seen"))
    hints = F.array(*(F.expr(f"if({r.hint}, {i}, -1)") for i, r in enumerate(RULES)))
    hinted = of.withColumn("_low", F.lower("_text")).select("path", "sha", "_text", F.array_remove(hints, F.lit(-1)).alias("_hints")).filter("size(_hints) > 0")
    # the path of a blob may be null: it holds the blob all the same
    one = unseen.select(F.col("path").alias("_path"), F.col("sha").alias("_sha"), "rules_seen")
    todo = hinted.join(one, (F.col("sha") == F.col("_sha")) & F.col("path").eqNullSafe(F.col("_path")))
    # rows that repeat a path and its text are one blob, scanned once
    todo = todo.select("sha", "_text", "rules_seen", "_hints").dropDuplicates(["sha"])
    todo = todo.select("sha", "_text", "rules_seen", F.explode("_hints").alias("_rule"))
    parts = []
    for i, r in enumerate(RULES):
        parts.append(f"when _rule = {i} and not contains(rules_seen, '{_rule_key(r)}') then {_matches(r)}")
    found = todo.select("sha", "_rule", F.expr(f"case {' '.join(parts)} end").alias("_found"))
    rows = found.selectExpr("sha", "_rule", "posexplode(_found) as (_i, _m)").filter("_m.len is not null")
    placed = rows.withColumn("end", F.expr("sum(cast(_m.gap + _m.len as bigint)) over (partition by sha, _rule order by _i rows unbounded preceding)"))
    least = " ".join(f"when {i} then {r.least}" for i, r in enumerate(RULES))
    kinds = F.array(*(F.lit(r.kind) for r in RULES))
    versions = F.array(*(F.lit(r.version) for r in RULES))
    new = placed.filter(f"_m.key >= case _rule {least} end").select(
        "sha", kinds[F.col("_rule")].alias("kind"), versions[F.col("_rule")].alias("version"), F.expr("end - _m.len").alias("start"), "end"
    )
    if findings is not None:
        now = F.array(*(F.lit(_rule_key(r)) for r in RULES))
        old = findings.filter(F.array_contains(now, F.expr("concat(kind, '/', version, ';')")))
        new = old.select(*new.columns).unionByName(new)
    return paths, new_ledger, new


def _matches(r: Rule) -> str:
    """SQL: an array of (length of the gap before a match, the match's length, the counted group's length); the last gap has no match."""
    p = scan_pattern(r).replace("\\", "\\\\").replace("'", "\\'")
    lengths = lambda group: f"transform(regexp_extract_all(_text, '{p}', {group}), x -> length(x))"
    both = f"zip_with({lengths(0)}, {lengths(r.group)}, (l, k) -> named_struct('len', l, 'key', k))"
    return f"zip_with(split(_text, '{p}', -1), {both}, (g, m) -> named_struct('gap', length(g), 'len', m.len, 'key', m.key))"


def spans_by_blob(findings: DataFrame) -> DataFrame:
    """sha and its spans, sorted by start and then kind as listed."""
    order = F.array_position(F.array(*(F.lit(r.kind) for r in RULES)), F.col("kind")).cast("int")
    listed = findings.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("o"), "end", "kind"))).alias("found"))
    return listed


def by_path(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each path: found, the sorted spans of its blob (empty where it has none)."""
    empty = "cast(array() as array<struct<start:bigint,o:int,end:bigint,kind:string>>)"
    return paths.join(spans_by_blob(findings), "sha", "left").select("path", "sha", F.expr(f"coalesce(found, {empty})").alias("found"))


def _hinted(text: str) -> str:
    """SQL: a rule may match the text."""
    return "(" + " or ".join(r.hint.replace("_text", text).replace("_low", f"lower({text})") for r in RULES) + ")"


#: The text with each run of overlapping spans replaced by its first kind in brackets.
_REDACTED = """
array_join(transform(aggregate(found, cast(array() as array<struct<start:bigint,o:int,end:bigint,kind:string>>),
    (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).end > x.start,
      concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'o', element_at(acc, -1).o, 'end', greatest(element_at(acc, -1).end, x.end), 'kind', element_at(acc, -1).kind))),
      concat(acc, array(x))),
    m -> zip_with(
      concat(array(named_struct('start', 0L, 'o', 0, 'end', 0L, 'kind', '')), m),
      concat(m, array(named_struct('start', cast(length(text) as bigint), 'o', 0, 'end', 0L, 'kind', ''))),
      (a, b) -> concat(if(a.kind = '', '', concat('[', a.kind, ']')), substring(text, cast(a.end + 1 as int), cast(b.start - a.end as int))))),
  x -> x), '')"""


def redact(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    """docs with every span found replaced by [kind], overlapping spans as one; n_chars, where there is one, follows; rows, other columns and null texts stay.

    Only rows whose text may hold a secret move to meet their findings.
    """
    may = F.coalesce(F.expr(_hinted("text")), F.lit(False))
    _, _, findings = scan(docs.filter(may), path=path)
    found = spans_by_blob(findings)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    held = docs.filter(may).select(whole.alias("_row"), F.col("text"), F.sha2("text", 256).alias("sha")).join(found, "sha", "left")
    row = F.col("_row").withField("text", F.expr(_REDACTED))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(F.expr(_REDACTED)).cast(docs.schema["n_chars"].dataType))
    changed = held.select(F.when(F.col("found").isNull(), F.col("_row")).otherwise(row).alias("_row")).select("_row.*")
    return docs.filter(~may).unionByName(changed)


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: counts by base kind, the hash of the base spans, and all spans as text.

    A row for each row of docs: repeated rows are one blob, scanned once, and
    each gets its findings. A null text is the empty blob. Other columns are
    not read.
    """
    paths, _, findings = scan(docs)
    base = F.array(*(F.lit(k) for k in BASE))
    rows = by_path(paths, findings)
    show = "x -> concat(x.kind, ':', x.start, ':', x.end)"
    return rows.select(
        F.col("path").alias("doc_id"),
        *(F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(F.transform(F.filter("found", lambda x: F.array_contains(base, x.kind)), lambda x: F.concat(x.kind, F.lit(":"), x.start, F.lit(":"), x.end)), ","), 256).alias("base_sha256"),
        F.expr(f"array_join(transform(found, {show}), ',')").alias("spans"),
        F.col("sha").alias("blob_sha256"),
    )
