"""Quality rules: text statistics, and a decision list learned from labelled ones.

All statistics are Spark expressions over the whole text. The list is learned by sequential covering:
a rule grows condition by condition on two thirds of the labelled rows, taking the threshold with the
largest information gain, and is pruned on the other third; rows it covers are set aside and the next
rule is learned on the rest. Each step is one aggregate over threshold bins of all labelled rows, so
the driver sees bin counts only. The rules become one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.storage import materialize

from .exprs import WORD, let, words

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Thresholds tried for each statistic, conditions of a rule, rules, least precision, least covered rows to learn from.
BINS, CONDITIONS, RULES, PRECISION, SUPPORT = 24, 3, 8, 0.9, 4
#: The statistics a rule may test, from the columns of ``statistics``.
FEATURES = {
    "words": "double(n_words)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "other_share": "n_other / greatest(n_chars, 1)",
    "upper_share": "n_upper / greatest(n_chars, 1)",
    "digit_share": "n_digits / greatest(n_chars, 1)",
    "shout_share": "n_shouts / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
}


def _paired(step: int):
    return lambda h: F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))


def repeat_words(found: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of eight words found twice or more in the array, the first included.

    Window hashes are built by doubling: of words, pairs, fours, eights. Only a text whose window
    hashes aren't all distinct is sorted for the windows that repeat.
    """
    doubled = F.transform(found, lambda w: F.xxhash64(w))
    step = 1
    while step < window:
        doubled = let(doubled, _paired(step))
        step *= 2
    hashes = F.slice(doubled, 1, F.greatest(F.size(found) - window + 1, F.lit(0)))

    def covered(starts):
        return F.aggregate(F.transform(starts, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(starts, j + 1) - p, F.lit(window)))), F.lit(0), lambda a, x: a + x)

    def repeats(h):
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(s):
            twin = lambda e, j: F.get(s, j - 1)["x"].eqNullSafe(e["x"]) | F.get(s, j + 1)["x"].eqNullSafe(e["x"])
            return F.array_sort(F.transform(F.filter(s, lambda e, j: F.coalesce(twin(e, j), F.lit(False))), lambda e: e["i"]))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(ordered, starts), covered))

    return let(hashes, repeats)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics) of every row, all counted over the whole text; a null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    without = lambda pattern: (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("bigint")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    by_words = let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), F.size(F.array_distinct(w)).alias("distinct"), repeat_words(w).alias("repeat")))
    found = held.select("id", by_words.alias("w"), line_counts.alias("l"), F.length("text").cast("bigint").alias("n_chars"), F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"), without("[A-Z]+").alias("n_upper"), without("[0-9]+").alias("n_digits"), F.length(F.regexp_replace("text", "[\\p{L}\\s]+", "")).cast("bigint").alias("n_other"), F.regexp_count("text", F.lit("\\b[A-Z]{2,}\\b")).cast("bigint").alias("n_shouts"))
    return found.select("id", F.col("w.n").cast("bigint").alias("n_words"), F.col("w.chars").cast("bigint").alias("word_chars"), "n_symbols", F.col("l.dup").cast("bigint").alias("n_dup_lines"), F.col("w.repeat").cast("bigint").alias("n_repeat_words"), "n_chars", "n_upper", "n_digits", "n_other", "n_shouts", F.col("l.n").cast("bigint").alias("n_lines"), F.col("w.distinct").cast("bigint").alias("n_distinct_words"))


@dataclass
class Rule:
    """Drop what meets all conditions (statistic, above, threshold): ``statistic > threshold``, or ``<=`` if not above."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)
    positives: int = 0
    negatives: int = 0

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, threshold in self.conditions:
            value = F.expr(FEATURES[name])
            out = out & ((value > threshold) if above else (value <= threshold))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if above else '<='} {t:.6g}" for n, above, t in self.conditions)


def _counts(rows: DataFrame, names: list[str]) -> dict:
    """Labelled rows by part, and by part, statistic and bin: (bad, good)."""
    each = rows.select("part", "bad", F.posexplode("bins").alias("feature", "bin"))
    return {(r["part"], r["feature"], r["bin"]): (r["bad_"], r["n"] - r["bad_"]) for r in each.groupBy("part", "feature", "bin").agg(F.sum("bad").alias("bad_"), F.count("*").alias("n")).collect()}


def _total(counts: dict, part: int) -> tuple[int, int]:
    found = [v for (p, f, _), v in counts.items() if p == part and f == 0]
    return sum(v[0] for v in found), sum(v[1] for v in found)


def _covered(counts: dict, part: int, feature: int, above: bool, at: int) -> tuple[int, int]:
    found = [v for (p, f, b), v in counts.items() if p == part and f == feature and (b > at) == above]
    return sum(v[0] for v in found), sum(v[1] for v in found)


def learn(labelled: DataFrame) -> list[Rule]:
    """Rules for bad rows of ``labelled``: the columns of ``statistics`` and ``bad`` (0 or 1).

    Every labelled row counts; null labels are left out. Nothing labelled, or one class only, gives no
    rule.
    """
    names = list(FEATURES)
    points = [i / (BINS + 1) for i in range(1, BINS + 1)]
    bad = F.col("bad") == 1
    probes = labelled.agg(*[F.percentile_approx(F.expr(FEATURES[n]), points, 2000).alias(n) for n in names], *[F.percentile_approx(F.when(bad, F.expr(FEATURES[n])), points, 2000).alias(f"bad_{n}") for n in names]).first()
    if probes[f"bad_{names[0]}"] is None:
        return []
    edges = {n: sorted({*probes[n], *probes[f"bad_{n}"]}) for n in names}

    def bin_of(name: str) -> Column:
        value = F.expr(FEATURES[name])
        return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[name]]), lambda e: e < value))

    bins = F.array(*[bin_of(n) for n in names])
    rows = materialize(labelled.select((F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("part"), "bad", bins.alias("bins")), "binned")
    rules: list[Rule] = []
    left = rows
    while len(rules) < RULES:
        held, path, states = left, [], []
        counts = _counts(held, names)
        p, n = _total(counts, 0)
        if p < SUPPORT:
            break
        while n and len(path) < CONDITIONS:
            best = None
            for f, name in enumerate(names):
                for at in range(len(edges[name])):
                    for above in (True, False):
                        if (f, above, at) in path:
                            continue
                        a, b = _covered(counts, 0, f, above, at)
                        if a >= SUPPORT and a + b < p + n:
                            gain = a * (math.log2(a / (a + b)) - math.log2(p / (p + n)))
                            if best is None or gain > best[0] + 1e-12:
                                best = (gain, f, above, at)
            if best is None or best[0] <= 0:
                break
            _, f, above, at = best
            path.append((f, above, at))
            held = held.filter((F.get("bins", F.lit(f)) > at) if above else (F.get("bins", F.lit(f)) <= at))
            counts = _counts(held, names)
            p, n = _total(counts, 0)
            states.append(((p, n), _total(counts, 1)))
        if not path:
            break
        # prune: the shortest prefix that does best on the part kept back, all rows counting where that part is thin
        def worth(k):
            (a, b), (c, d) = states[k]
            return (round((c - d) / (c + d), 9) if c + d >= SUPPORT else (a + c - b - d) / max(1, a + b + c + d))

        cut = max(range(len(path)), key=lambda k: (worth(k), -k))
        (a, b), (c, d) = states[cut]
        if (a + c) / (a + b + c + d) < PRECISION:
            break
        # bin > at means above the at-th edge (from 0)
        rule = Rule([(names[f], above, float(edges[names[f]][at])) for f, above, at in path[: cut + 1]], a + c, b + d)
        rules.append(rule)
        met = F.lit(True)
        for f, above, at in path[: cut + 1]:
            met = met & ((F.get("bins", F.lit(f)) > at) if above else (F.get("bins", F.lit(f)) <= at))
        left = left.filter(~met)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that a row meets, from 1; 0 if none: one ordered conditional expression."""
    if not rules:
        return F.lit(0)
    out = F.when(rules[0].column(), 1)
    for i, rule in enumerate(rules[1:], 2):
        out = out.when(rule.column(), i)
    return out.otherwise(0)


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, the statistics, ``base_failed``, ``rule``, ``kept``.

    ``labels`` has ``id_col`` and ``label_col`` (1 good, 0 bad; null: not labelled). A null or empty
    text has zero words and fails the base rules. Documents with repeated or null ids are judged row
    by row; a null id has no label. Empty tables give empty results, and without labels no rule is
    learned. Further columns are not read.
    """
    stats = materialize(statistics(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("q")).filter("id is not null and q is not null")
    labelled = stats.join(known.groupBy("id").agg(F.min("q").alias("q")), "id").withColumn("bad", (F.col("q") == 0).cast("int"))
    rules = learn(labelled)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).withColumnRenamed("id", id_col)
