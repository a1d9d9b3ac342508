"""Quality rules: a ledger of failure bits and measurements, and versioned policies over it.

Every rule is evaluated once for each document; the ledger keeps its outcome as one bit beside the
measurements. Policies are bit masks, so a verdict, another policy version or an ablation is a bitwise
expression or aggregate over the ledger and never touches the texts again. DataFrame functions only,
no shuffle.

Null text counts as no words. Empty tables give empty ledgers, repeated rows one ledger row each;
extra columns are not read and cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
#: U+0009 to U+000D, as SQL writes them.
TABS = "\\t\\n\\u000b\\u000c\\r"
#: Low bits of a window key that hold its position.
PLACE = 30


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the ledger's measurements, in integers."""

    name: str
    fails: str


#: Bit i of a ledger is rule i's; append only.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 50 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
)
BASE = ("few_words", "repeated_windows")
#: Versions of the policy: the rules that reject.
POLICIES = {"base": BASE, "v1": BASE + ("symbols", "repeated_lines", "short_words", "long_words")}


def mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy's rules."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << [r.name for r in RULES].index(n) for n in names)


def let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


TEXT = "coalesce(cast(text as string), '')"


def _without(chars: str) -> str:
    return f"length(translate({TEXT}, '{chars}', ''))"


def measures() -> str:
    """SQL for a struct of all measurements of the column `text`."""
    blank = f"translate({TEXT}, '{TABS}', '     ')"
    words = f"filter(split({blank}, ' '), x -> x != '')"
    lines = f"filter(split({TEXT}, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    keys = f"sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), {PLACE}) | cast(i as bigint)))"
    near = f"coalesce(shiftright(x, {PLACE}) = shiftright(get(k, i - 1), {PLACE}), false) or coalesce(shiftright(x, {PLACE}) = shiftright(get(k, i + 1), {PLACE}), false)"
    # Windows with equal keys only may be equal; their words decide.
    named = f"sort_array(transform(c, x -> {let(f'cast(x & {(1 << PLACE) - 1} as int)', 'p', 'struct(concat_ws(chr(32), w[p], w[p + 1], w[p + 2]) as t, p as p)')}))"
    equal = "coalesce(x.t = get(s, i - 1).t, false) or coalesce(x.t = get(s, i + 1).t, false)"
    covered = "aggregate(transform(q, (x, i) -> least(3, coalesce(get(q, i + 1) - x, 3))), 0L, (t, x) -> t + x)"
    places = f"sort_array(transform(filter(s, (x, i) -> {equal}), x -> x.p))"
    exact = f"if(size(c) = 0, 0L, {let(named, 's', let(places, 'q', covered))})"
    repeats = f"if(size(w) < 4, 0L, {let(keys, 'k', let(f'filter(k, (x, i) -> {near})', 'c', exact))})"
    fields = {
        "n_words": "cast(size(w) as bigint)",
        "word_chars": f"cast({_without(' ' + TABS)} as bigint)",
        "n_symbols": f"cast(length({TEXT}) - {_without(SYMBOLS)} as bigint)",
        "n_lines": "cast(size(l) as bigint)",
        "n_dup_lines": "cast(size(l) - size(array_distinct(l)) as bigint)",
        "n_repeat_words": repeats,
    }
    return let(words, "w", let(lines, "l", "struct(" + ", ".join(f"{v} as {k}" for k, v in fields.items()) + ")"))


def _bits(of: str = "") -> str:
    """SQL for the failure bits; of: what stands in front of a measurement's name."""
    tests = [re.sub(r"\b(n_\w+|word_chars)\b", rf"{of}\1", r.fails) for r in RULES]
    return " | ".join(f"if({t}, {1 << i}L, 0L)" for i, t in enumerate(tests))


def ledger(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, measurements, fail_bits) of every row; keep: further columns of docs to carry."""
    rows = docs.select("doc_id", *keep, F.expr(measures()).alias("_m")).select("doc_id", *keep, "_m.*")
    return rows.withColumn("fail_bits", F.expr(_bits()))


def failed(policy: str | tuple[str, ...]) -> Column:
    """Whether any rule of the policy fails."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) != 0


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents failing it, documents only it rejects, and documents the
    policy keeps without it. One partially aggregated pass over ledger rows; an empty ledger gives zeros."""
    m, names = mask(policy), POLICIES[policy]
    hit = F.col("fail_bits").bitwiseAND(F.lit(m))
    parts = []
    for n in names:
        b = mask((n,))
        parts += [F.count_if(hit.bitwiseAND(F.lit(b)) != 0).alias(f"f_{n}"), F.count_if(hit == b).alias(f"o_{n}"), F.count_if(hit.bitwiseAND(F.lit(m & ~b)) == 0).alias(f"k_{n}")]
    one = rows.agg(*parts)
    return one.select(F.inline(F.array(*(F.struct(F.lit(policy).alias("policy"), F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only"), F.col(f"k_{n}").alias("n_kept_without")) for n in names))))


def kept(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """Rows of docs, with all their columns, that the policy keeps. Each row is judged by itself and its
    measurements are made once, inside the filter."""
    return docs.where(F.expr(f"({let(measures(), 'm', _bits('m.'))} & {mask(policy)}L) = 0"))
