"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements
and one failure bit per rule; a policy is a versioned mask of rules, so a new
policy, or the question what a rule contributes, is bitwise arithmetic over
the ledger and never reads a text again.

Everything is DataFrame functions: no Python runs on the executors, and no
stage shuffles, since each row is judged by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = r"[\\x20\\x09-\\x0D]+"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: str  # SQL over the measurements


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 3 * n_words"),
    Rule("capitals", 3, "n_words >= 20 and 2 * n_capitals > word_chars"),
    Rule("duplicate_lines", 4, "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule("long_words", 5, "word_chars > 40 * n_words"),
    Rule("exclamations", 6, "2 * n_shouts > n_words"),
)
BASE = Policy(1, ("few_words", "repeated_windows"))
DEFAULT = Policy(2, tuple(r.name for r in RULES))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts")

#: Words in repeated windows: sort (hash, place), pair neighbours of equal hash, then add up what each place newly covers. Arrays are bound to lambda variables, so each is made once even where an optimizer moves this into another expression.
_REPEATED = f"""
element_at(transform(array(_words), w -> if(size(w) < {WINDOW}, 0L,
  element_at(transform(array(transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW})))), h ->
    if(size(h) = size(array_distinct(h)), 0L,
      aggregate(
        array_sort(array_distinct(flatten(
          element_at(transform(
            array(array_sort(transform(h, (g, i) -> named_struct('g', g, 'i', i)))),
            s -> zip_with(s, slice(s, 2, size(s)), (a, b) -> if(a.g = b.g, array(a.i, b.i), cast(array() as array<int>)))
          ), 1)))),
        named_struct('end', 0L, 'n', 0L),
        (acc, p) -> named_struct('end', cast(p + {WINDOW} as bigint), 'n', acc.n + least({WINDOW}L, p + {WINDOW} - acc.end)),
        acc -> acc.n))), 1))), 1)"""


def _without(chars: str) -> str:
    return f"length(_text) - length(regexp_replace(_text, '{chars}', ''))"


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: `keep`, the measurements, and fail_bits.

    A null or empty text has no words and measures 0 everywhere, so it fails
    few_words. Windows are compared by a 64-bit hash of their eight words
    within one document. Other columns of docs, whatever their names, are not
    read. Repeated doc_ids give a row each.
    """
    own = docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    words = own.withColumn("_words", F.expr(f"array_remove(split(_text, '{GAP}'), '')")).withColumn(
        "_lines", F.expr(r"filter(split(_text, '\\n'), l -> trim(BOTH ' \t\u000b\u000c\r' FROM l) <> '')")
    )
    measured = words.select(
        *(F.col(f"`{c}`") for c in keep),
        F.expr("cast(size(_words) as bigint)").alias("n_words"),
        F.expr("cast(length(array_join(_words, '')) as bigint)").alias("word_chars"),
        F.expr(f"cast({_without('[#*$%&|<>]')} as bigint)").alias("n_symbols"),
        F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)").alias("n_dup_lines"),
        F.expr(_REPEATED).alias("n_repeat_words"),
        F.expr("cast(size(_lines) as bigint)").alias("n_lines"),
        F.expr(f"cast({_without('[A-ZÀ-ÖØ-Þ]')} as bigint)").alias("n_capitals"),
        F.expr("cast(length(_text) - length(replace(_text, '!!', '!')) as bigint)").alias("n_shouts"),
    )
    bits = " | ".join(f"if({r.fails}, {1 << r.bit}, 0)" for r in RULES)
    return measured.withColumn("fail_bits", F.expr(f"cast({bits} as bigint)"))


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.expr(f"({bits} & {policy.mask}) = 0")


def apply_policy(led: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version."""
    return led.withColumns({"base_failed": ~passes(BASE), "kept": passes(BASE) & passes(policy), "policy_version": F.lit(policy.version)})


def keep_good(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The rows of docs that pass the policy, with all their columns; a scan without a shuffle.

    The filter also looks at a row number, which keeps it above the
    measurements: pushed below, it would make them again.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    led = ledger(docs.select(whole.alias("_row"), F.col("text")), ("_row",)).withColumn("_number", F.monotonically_increasing_id())
    return apply_policy(led, policy).filter("kept and _number >= 0").select("_row.*")


def ablate(led: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """One row per rule of the policy: documents failing it, and documents that only it removes.

    One aggregation over the ledger, whatever the number of rules.
    """
    rules = [r for r in RULES if r.name in policy.rules]
    sums = [F.count_if(F.expr(f"(fail_bits & {1 << r.bit}) <> 0")).alias(f"f{r.bit}") for r in rules]
    sums += [F.count_if(F.expr(f"(fail_bits & {policy.mask}) = {1 << r.bit}")).alias(f"o{r.bit}") for r in rules]
    rows = ", ".join(f"'{r.name}', f{r.bit}, o{r.bit}" for r in rules)
    return led.agg(F.count(F.lit(1)).alias("n_docs"), *sums).selectExpr("n_docs", f"stack({len(rules)}, {rows}) as (rule, n_failed, n_only)")
