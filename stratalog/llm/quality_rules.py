"""Quality rules as a bitmask ledger, in DataFrame functions only.

``measure`` evaluates each measurement once per document; ``ledger`` turns the
measurements into one failure bit per rule; policies are named sets of rules,
applied afterwards by masking the stored bits; ``ablations`` counts, by bitwise
aggregation over the ledger, what each rule of a policy rejects and what it
alone rejects.

Nothing is shuffled by ``measure``, ``ledger`` or ``apply_policy``: each text is
measured in its row, however long. Repeated three-word windows are found by
sorting the row's windows with their positions, so the cost of one text is
n log n in its words and its memory linear.

Defined results: a null or empty text has no words, all measurements are 0 and
``too_few_words`` fails; a null doc_id is kept as it is; repeated rows are
measured each for itself; input columns other than the measured ones pass
through ``ledger`` untouched, and a column of the input whose name clashes with
a measurement is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.base import SPACE_CHARS, SPACE_CLASS

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``condition`` holds; its bit is 1 << ``bit``, for ever."""

    bit: int
    name: str
    condition: str


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "few_alphabetic_words", "100 * n_alpha_words < 60 * n_words"),
    Rule(5, "mean_word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
)

#: Policies name their rules; a version, once used, keeps its meaning.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "many_symbols", "repeated_lines", "few_alphabetic_words", "mean_word_length"),
}


def mask_of(names: tuple[str, ...] | list[str]) -> int:
    bits = {rule.name: 1 << rule.bit for rule in RULES}
    return sum(bits[name] for name in set(names))


# Each `let` binds a value by a lambda over a one-element array. A plain
# withColumn would be inlined into the lambdas below it and be evaluated again
# for each element.
def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


# Windows are sorted as "a b c position": words hold no space, so the first
# three fields identify the window and equal windows become neighbours.
_SORTED = "sort_array(transform(sequence(0, size(w) - 3), i -> concat_ws(' ', w[i], w[i + 1], w[i + 2], i)))"
_HIT = "filter(sequence(0, size(s) - 1), i -> coalesce(g[i] = get(g, i - 1), false) OR coalesce(g[i] = get(g, i + 1), false))"
_POSITIONS = f"sort_array(transform({_HIT}, i -> int(substring_index(s[i], ' ', -1))))"
_COVERED = "int(aggregate(sequence(0, size(p) - 1), 0, (a, k) -> a + least(3, coalesce(get(p, k + 1) - p[k], 3))))"
_REPEATS = (
    "CASE WHEN size(w) < 4 THEN 0 WHEN size(array_distinct(transform(sequence(0, size(w) - 3), i -> concat_ws(' ', w[i], w[i + 1], w[i + 2])))) = size(w) - 2 THEN 0 ELSE "
    + _let(_SORTED, "s", _let("transform(s, x -> substring_index(x, ' ', 3))", "g", _let(_POSITIONS, "p", f"CASE WHEN size(p) = 0 THEN 0 ELSE {_COVERED} END")))
    + " END"
)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of each text as bigint columns."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.trim(body, F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))
    lines = F.filter(F.split(body, "\n"), lambda line: F.length(F.trim(line, F.lit(SPACE_CHARS))) > 0)
    counted = docs.withColumn("__words", words).withColumn("__lines", lines)
    of_words = _let("__words", "w", f"named_struct('n', size(w), 'r', {_REPEATS}, 'a', size(filter(w, x -> x RLIKE '\\\\p{{L}}')))")
    of_lines = _let("__lines", "l", "named_struct('n', size(l), 'd', size(l) - size(array_distinct(l)))")
    without = lambda chars: F.length(body) - F.length(F.translate(body, chars, ""))
    counted = counted.withColumns({"__w": F.expr(of_words), "__l": F.expr(of_lines)})
    values: dict[str, Column] = {
        "n_words": F.col("__w.n"),
        "word_chars": F.length(body) - without(SPACE_CHARS),
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": F.col("__l.d"),
        "n_repeat_words": F.col("__w.r"),
        "n_lines": F.col("__l.n"),
        "n_alpha_words": F.col("__w.a"),
    }
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in values]
    return counted.select(*kept, *(v.cast("long").alias(k) for k, v in values.items()))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``fail_mask``: bit r is set where rule r fails."""
    bits = [F.when(F.expr(rule.condition), F.lit(1 << rule.bit)).otherwise(F.lit(0)) for rule in RULES]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return measure(docs, text).withColumn("fail_mask", mask.cast("long"))


def failed(policy: str, mask: str = "fail_mask") -> Column:
    return F.col(mask).bitwiseAND(F.lit(mask_of(POLICIES[policy]))) != 0


def apply_policy(book: DataFrame, policy: str = "v1") -> DataFrame:
    """``kept``: no rule of the policy fails. The text isn't read again."""
    return book.withColumn("kept", ~failed(policy))


def ablations(book: DataFrame, policy: str = "v1", by: str | None = None) -> DataFrame:
    """For each rule of a policy: rows it rejects, rows only it rejects.

    One pass of partial sums over the ledger; ``any_bits`` and ``all_bits`` are
    the bitwise OR and AND of the masks. One row per rule (and value of ``by``).
    """
    whole = mask_of(POLICIES[policy])
    bits = {rule.name: 1 << rule.bit for rule in RULES if rule.name in POLICIES[policy]}
    hit = F.col("fail_mask").bitwiseAND(F.lit(whole))
    keys = [by] if by else []
    sums = [x for name, bit in bits.items() for x in (F.sum((hit.bitwiseAND(F.lit(bit)) != 0).cast("long")).alias(f"r_{name}"), F.sum((hit == bit).cast("long")).alias(f"o_{name}"))]
    totals = book.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"), F.sum((hit == 0).cast("long")).alias("n_kept"), F.bit_or(hit).alias("any_bits"), F.bit_and(hit).alias("all_bits"), *sums)
    rows = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"r_{name}").alias("n_rejected"), F.col(f"o_{name}").alias("n_only_by_it")) for name in bits))
    return totals.select(*keys, "n_docs", "n_kept", "any_bits", "all_bits", F.inline(rows))
