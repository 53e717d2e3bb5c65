"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are masks.

``measure`` computes the measurements of a text, ``ledger`` adds ``failures``, a bigint with
one bit per failed rule.  A policy is a named set of rules, so applying another version, or
asking what one rule costs, is bit arithmetic over the ledger and never touches a text again.
Only built-in expressions are used; the work is one map over the rows.

Defined cases: a NULL text measures like an empty one (no words, so it fails ``few_words``);
a NULL id is kept; repeated rows are judged one by one; an empty table gives an empty ledger;
columns named like a measurement or ``failures`` are replaced by ``measure`` and ``ledger``,
all others pass; ``apply_policy`` gives back every column as it came.  Words are compared by
64-bit hashes of three-word windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

SPACE = r"\x20\x09-\x0D"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_upper")

# Rule name -> failing condition over the measurements.  The position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "100 * n_symbols > 10 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "upper_case": "100 * n_upper > 50 * word_chars",
}
BASE = ("few_words", "repeated_windows")

# Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "many_symbols", "word_length", "duplicate_lines"),
    "v3": tuple(RULES),
}


def mask_of(rules: Sequence[str]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(s: Column) -> Column:
        return F.transform(
            s,
            lambda e, k: F.when(
                (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]), e["i"]
            ),
        )

    # An array of one element binds the sorted windows to a name inside the lambda.
    starts = F.filter(
        F.flatten(F.transform(F.array(ordered), twins)), lambda p: p.isNotNull()
    )
    covered = F.array_distinct(
        F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
        F.size(covered)
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``MEASURES`` (bigint), each text read whole."""
    value = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in docs.columns if c.lower() not in MEASURES]
    words, lines, n, hashes = unused(docs, "_words", "_lines", "_n", "_hashes")
    staged = (
        docs.select(*kept)
        .withColumn(words, F.regexp_extract_all(value, F.lit(f"([^{SPACE}]+)")))
        .withColumn(
            lines,
            F.filter(F.split(value, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]")),
        )
        .withColumn(n, F.size(words))
        .withColumn(
            hashes,
            F.when(
                F.col(n) >= 3,
                F.transform(
                    F.sequence(F.lit(0), F.col(n) - 3),
                    lambda i: F.xxhash64(
                        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)
                    ),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        )
    )
    values = {
        "n_words": F.col(n),
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(value, F.lit(r"[#*$%&|<>]")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(F.col(words), F.col(hashes)),
        "n_upper": F.regexp_count(value, F.lit(r"\p{Lu}")),
    }
    # A generator keeps the optimizer from copying these expressions into later filters.
    row = F.struct(*[v.cast("bigint").alias(k) for k, v in values.items()])
    return staged.select(*kept, F.inline(F.array(row)))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with measurements and ``failures``, the bits of the failed rules."""
    measured = measure(docs.drop("failures"), text)
    bits = [
        F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint")
        for bit, condition in enumerate(RULES.values())
    ]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return measured.withColumn("failures", failures)


def passes(policy: str, failures: str = "failures") -> Column:
    """Whether a ledger row passes the policy of that version."""
    return F.col(failures).bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def apply_policy(docs: DataFrame, policy: str = "v3", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with the columns of ``docs``."""
    clash = [c for c in docs.columns if c.lower() in (*MEASURES, "failures")]
    own = dict(zip(clash, unused(docs, *[f"_own_{c}" for c in clash]), strict=True))
    kept = ledger(docs.withColumnsRenamed(own), text).filter(passes(policy))
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def ablation(rows: DataFrame, policy: str = "v3") -> DataFrame:
    """What each rule of a policy costs, from the ledger alone.

    One row per rule: ``failed`` rows fail it, ``only`` rows would be kept without it,
    ``kept_without`` is the size of the result without it.  ``overlap`` is the OR of all
    bits that fail together with it.
    """
    mask = mask_of(POLICIES[policy])
    # Distinct masks are at most 2^rules; everything after this aggregate is tiny.
    masks = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("m")).agg(
        F.count("*").alias("n")
    )
    rules = [
        F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("bigint").alias("bit"))
        for bit, name in enumerate(RULES)
        if name in POLICIES[policy]
    ]
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    fails = F.col("m").bitwiseAND(F.col("bit")) != 0
    return (
        masks.select("m", "n", F.inline(F.array(*rules)))
        .groupBy("rule", "bit")
        .agg(
            count(fails).alias("failed"),
            count(F.col("m") == F.col("bit")).alias("only"),
            count((F.col("m") == 0) | (F.col("m") == F.col("bit"))).alias("kept_without"),
            F.coalesce(F.bit_or(F.when(fails, F.col("m"))), F.lit(0)).alias("overlap"),
        )
        .select("rule", "failed", "only", "kept_without", "overlap")
    )
