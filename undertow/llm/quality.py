"""Quality rules: a decision list learned by sequential covering, applied as Spark conditional expressions.

Every document gets a few statistics of its whole text. From those of labelled documents, conjunctions of
thresholds are grown one after the other: each adds the threshold with the largest information gain until it
covers no good document, is pruned back to the prefix that is best on rows held out, and takes the bad documents
it covers out of the rows for the next. The list becomes one CASE expression; the first rule that holds decides.

The fit sees a bounded sample, ``SAMPLE`` labelled rows, the smallest by hash of their id; statistics and
verdicts cover all documents. Words are what lies between blanks and the characters 9 to 13.

Defined results: a null text has no words, and fails the base rule like every text of under 50 words; nulls
among labels are no labels; without labels, or with one class only, the list is empty and the base rule alone
decides; documents that come twice are judged twice.

Repeated 3-word windows are found in the row: each window becomes one long of truncated hash and position, the
array is sorted, and neighbours with equal hash and equal words are windows that occur twice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Labelled rows that the fit looks at.
SAMPLE = 20_000
#: A word's complement, as a regular expression.
GAP = r"[\x20\x09-\x0D]"


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) in place of any such."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rest = [c for c in docs.columns if c not in (*names, "_quality_t", "_quality_w", "_quality_s", "_quality_p", "_quality_b", "_quality_n", "_quality_l", "_quality_v")]
    text = F.coalesce("text", F.lit(""))
    words = docs.select(*rest, text.alias("_quality_t"), F.array_remove(F.split(text, f"{GAP}+"), "").alias("_quality_w"))
    words = words.select("*", F.size("_quality_w").alias("_quality_n"), F.length(F.bin(F.size("_quality_w").cast("long"))).cast("int").alias("_quality_b"))
    window = "shiftleft(xxhash64(get(_quality_w, i), get(_quality_w, i + 1), get(_quality_w, i + 2)), _quality_b) | i"
    windows = words.withColumn("_quality_s", F.expr(f"if(_quality_n < 3, cast(array() as array<bigint>), sort_array(transform(sequence(0, greatest(_quality_n - 3, 0)), i -> {window})))"))
    low = "cast({} & (shiftleft(1L, _quality_b) - 1) as int)"

    def equal(a: str, b: str) -> str:
        at = low.format(a), low.format(b)
        return f"shiftright({a}, _quality_b) = shiftright({b}, _quality_b)" + "".join(f" and get(_quality_w, {at[0]} + {k}) = get(_quality_w, {at[1]} + {k})" for k in range(3))

    found = f"filter(_quality_s, (x, i) -> coalesce({equal('x', 'get(_quality_s, i - 1)')}, false) or coalesce({equal('x', 'get(_quality_s, i + 1)')}, false))"
    places = windows.withColumn("_quality_p", F.expr(f"sort_array(transform({found}, x -> {low.format('x')}))"))
    lines = F.filter(F.split("_quality_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    lines = places.withColumn("_quality_l", lines)
    covered = "cast(aggregate(transform(_quality_p, (p, i) -> least(3, coalesce(get(_quality_p, i + 1), p + 3) - p)), 0, (a, x) -> a + x) as bigint)"
    # One struct out of a generator: filters on the statistics stay above it, where they cost nothing. Pushed below,
    # they would put the sorting of all windows into the function of a single word.
    values = F.struct(
        F.col("_quality_n").cast("long").alias("n_words"),
        F.length(F.array_join("_quality_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_quality_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_quality_l") - F.size(F.array_distinct("_quality_l"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
    )
    return lines.select(*rest, F.explode(F.array(values)).alias("_quality_v")).select(*rest, *[F.col(f"_quality_v.{n}").alias(n) for n in names])


def base_failed() -> Column:
    """The base rule, over the statistics."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: What thresholds are laid on, as SQL over the statistics.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines_per_100_words": "100 * n_dup_lines / greatest(n_words, 1)",
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "n_words": "cast(n_words as double)",
}

Literal = tuple[str, str, float]  # feature, > or <=, threshold
Row = tuple[dict[str, float], bool]


def holds(rule: Sequence[Literal], values: dict[str, float]) -> bool:
    return all((values[f] > t) if op == ">" else (values[f] <= t) for f, op, t in rule)


def grow(rows: list[Row], names: Sequence[str], cuts: int = 24, most: int = 4) -> list[Literal]:
    """A conjunction that covers bad rows and no good ones, as far as thresholds at quantiles allow."""
    rule: list[Literal] = []
    while len(rule) < most:
        p, n = sum(bad for _, bad in rows), sum(not bad for _, bad in rows)
        if not p or not n:
            break
        best, gain = None, 1e-9
        for name in names:
            order = sorted((v[name], bad) for v, bad in rows)
            below_p = below_n = 0
            marks = {order[min(len(order) - 1, k * len(order) // cuts)][0] for k in range(cuts)}
            marks |= {a[0] for a, b in zip(order, order[1:]) if a[1] != b[1] and a[0] != b[0]} if len(order) < 2000 else set()
            for k, (value, bad) in enumerate(order):
                below_p, below_n = below_p + bad, below_n + (not bad)
                if k + 1 < len(order) and order[k + 1][0] == value or value not in marks or k + 1 == len(order):
                    continue
                middle = (value + order[k + 1][0]) / 2
                for op, cp, cn in (("<=", below_p, below_n), (">", p - below_p, n - below_n)):
                    if cp and (g := cp * (math.log2(cp / (cp + cn)) - math.log2(p / (p + n)))) > gain:
                        best, gain = (name, op, middle), g
        if best is None:
            break
        rule.append(best)
        rows = [r for r in rows if holds([best], r[0])]
    return rule


def learn(rows: list[Row], names: Sequence[str] = tuple(FEATURES), most: int = 8, precision: float = 0.9) -> list[list[Literal]]:
    """Ordered rules for bad rows. Every third row is held out for pruning; a rule stays only if it is right about
    ``precision`` of the held-out rows it covers."""
    fit, held = [r for k, r in enumerate(rows) if k % 3], rows[::3]
    rules: list[list[Literal]] = []
    while len(rules) < most:
        rule = grow(fit, names)

        def worth(part):
            p = sum(bad for v, bad in held if holds(part, v))
            n = sum(not bad for v, bad in held if holds(part, v))
            return ((p - n) / (p + n) if p + n else -1.0), p, n

        ranked = [(worth(rule[:k])[0], -k) for k in range(1, len(rule) + 1)]
        if not ranked:
            break
        rule = rule[: -max(ranked)[1]]
        _, p, n = worth(rule)
        if p < 1 or p / (p + n) < precision:
            break
        rules.append(rule)
        fit = [r for r in fit if not holds(rule, r[0])]
        held = [r for r in held if not holds(rule, r[0])]
    return rules


def expression(rules: Sequence[Sequence[Literal]]) -> Column:
    """The number of the first rule that holds, from 1; 0 for none."""
    out = None
    for k, rule in enumerate(rules, 1):
        condition = F.lit(True)
        for feature, op, t in rule:
            value = F.expr(FEATURES[feature])
            condition = condition & ((value > t) if op == ">" else (value <= t))
        out = F.when(condition, k) if out is None else out.when(condition, k)
    return (out.otherwise(0) if out is not None else F.lit(0)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Literal]]:
    """Learn the list from labels (doc_id, quality: 0 is bad) of documents that the base rule lets pass. The sample is small enough to be broadcast."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    part = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("text"), "text").limit(sample)  # an id may repeat
    values = statistics(part).where(~base_failed()).select(*[F.expr(e).alias(f) for f, e in FEATURES.items()], "quality", "doc_id")
    rows = sorted((r["doc_id"], r["quality"], [r[f] for f in FEATURES]) for r in values.collect())
    return learn([(dict(zip(FEATURES, v)), q == 0) for _, q, v in rows])


def judge(docs: DataFrame, rules: Sequence[Sequence[Literal]]) -> DataFrame:
    """docs with the statistics, base_failed, rule (the first that holds, or 0) and kept."""
    out = statistics(docs.drop("base_failed", "rule", "kept"))
    out = out.withColumn("base_failed", base_failed()).withColumn("rule", expression(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep(docs: DataFrame, rules: Sequence[Sequence[Literal]]) -> DataFrame:
    """The rows of docs that are kept, with all of their columns, whatever these are called."""
    inner = {c: c if c in ("doc_id", "text") else f"_column_{k}" for k, c in enumerate(docs.columns)}
    held = judge(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]), rules).where("kept")
    return held.select(*[F.col(n).alias(c) for c, n in inner.items()])
