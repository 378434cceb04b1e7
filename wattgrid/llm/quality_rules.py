"""Quality rules: text statistics, and a decision list learned from labelled statistics.

Statistics are column expressions over one row. The list is learned by sequential covering: a rule
is a conjunction of thresholds that grows by the condition with the most information gain on two
thirds of the labelled rows, is pruned back on the last third, and takes the rows that it covers
out of both. All counts come from Spark aggregates over the table of labelled statistics; the rules
become one conditional expression, evaluated in order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattgrid.llm.common import GAPS, WHITE, fresh, quoted, squeezed, text_of, without
from wattgrid.session import checkpointed

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Thresholds tried for each feature, rules of a list, conditions of a rule.
BINS = 24
MOST_RULES = 12
MOST_CONDITIONS = 4
#: A rule must be right on this share of what it covers in the pruning rows, and cover so many of them.
LEAST_PRECISION = 0.9
LEAST_COVER = 5


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAPS))


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight words that stand in the text twice or more.

    Window hashes are sorted with their places only if some hash comes twice. The repeated places
    in order, each window covers what its predecessor left: at most eight words.
    """
    def places(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: F.array_sort(F.transform(
            F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(places(hashes), covered))

    def windows(coded: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(coded) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(coded, i, WINDOW)))

    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda coded: let(windows(coded), counted)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five base measures and ``n_upper``, ``n_digits``, ``n_marks``, ``n_lines``, ``n_distinct`` (all long).

    Null texts count as empty. A line counts as repeated if it has a word and equals an earlier one.
    """
    docs = without(docs, *MEASURES, "n_upper", "n_digits", "n_marks", "n_lines", "n_distinct")
    (words,) = fresh(docs, "row_words")
    body = text_of(text)
    lines = F.filter(F.split(body, "\n"), lambda x: squeezed(x) != "")
    long = lambda c: c.cast("long")
    kept = [quoted(c) for c in docs.columns]
    return docs.withColumn(words, words_of(body)).select(
        *kept, long(F.size(words)).alias("n_words"), long(F.length(squeezed(body))).alias("word_chars"),
        long(F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).alias("n_symbols"),
        long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
        repeated_words(F.col(words)).alias("n_repeat_words"),
        long(F.length(body) - F.length(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
        long(F.length(body) - F.length(F.translate(body, "0123456789", ""))).alias("n_digits"),
        long(F.length(body) - F.length(F.translate(body, "!?;:(){}[]\"'/\\_=+~^@", ""))).alias("n_marks"),
        long(F.size(lines)).alias("n_lines"), long(F.size(F.array_distinct(F.col(words)))).alias("n_distinct"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Ratios of the measures; each is defined for an empty text."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "words": F.col("n_words").cast("double"), "word_length": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words, "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars, "marks_per_word": F.col("n_marks") / words,
        "words_per_line": F.col("n_words") / F.greatest("n_lines", F.lit(1)), "distinct_share": F.col("n_distinct") / words,
    }


# ---------------------------------------------------------------- decision list


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] >= self.bound if self.above else values[self.feature] < self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.bound:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, values: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(values)
    return out


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """Information gained about the bad rows that stay covered."""
    if not bad:
        return -math.inf
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def learn(rows: DataFrame, names: list[str]) -> list[Rule]:
    """Rules for bad rows, from ``rows`` with a column per feature, ``bad`` (boolean) and ``part`` (0, 1: grow; 2: prune).

    Deterministic: thresholds are quantiles of the growing rows, ties go to the earlier condition.
    No rows, or rows of one kind, give no rules. The driver sees one count per feature, bin and
    kind, whatever the number of rows.
    """
    quantiles = [q / BINS for q in range(1, BINS)]
    # A sketch for all rows and one for the bad ones: a rare kind gets thresholds of its own.
    asked = [F.percentile_approx(F.when(kind, F.col(n)), F.lit(quantiles), 1000).alias(f"{n}_{k}")
             for n in names for k, kind in enumerate((F.lit(True), F.col("bad")))]
    found = rows.where("part < 2").agg(*asked).first()
    if all(x is None for x in found):
        return []
    bounds = [sorted({*(found[f"{n}_0"] or []), *(found[f"{n}_1"] or [])}) for n in names]

    def bin_of(value: Column, cuts: list[float]) -> Column:
        return F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda x: x <= value))

    binned = checkpointed(rows.select("bad", "part", F.array(*[bin_of(F.col(n), b) for n, b in zip(names, bounds)]).alias("bins")))

    def inside(frame: DataFrame, tests: list[tuple[int, bool, int]]) -> DataFrame:
        for f, above, k in tests:
            frame = frame.where(F.col("bins")[f] >= k if above else F.col("bins")[f] < k)
        return frame

    def outside(frame: DataFrame, tests: list[tuple[int, bool, int]]) -> DataFrame:
        held = F.lit(True)
        for f, above, k in tests:
            held = held & (F.col("bins")[f] >= k if above else F.col("bins")[f] < k)
        return frame.where(~held)

    def histogram(frame: DataFrame) -> dict[tuple[int, int, bool], int]:
        counted = frame.select("bad", F.posexplode("bins").alias("f", "k")).groupBy("f", "k", "bad").count()
        return {(r["f"], r["k"], r["bad"]): r["count"] for r in counted.collect()}

    rules: list[list[tuple[int, bool, int]]] = []
    left = binned
    while len(rules) < MOST_RULES:
        rule: list[tuple[int, bool, int]] = []
        while len(rule) < MOST_CONDITIONS:
            sums = histogram(inside(left.where("part < 2"), rule))
            best, gained = None, 0.0
            for f, cuts in enumerate(bounds):
                whole = [sum(sums.get((f, k, kind), 0) for k in range(len(cuts) + 1)) for kind in (True, False)]
                if not all(whole):
                    break
                below = [0, 0]
                for k in range(1, len(cuts) + 1):
                    below = [below[i] + sums.get((f, k - 1, kind), 0) for i, kind in enumerate((True, False))]
                    for above in (True, False):
                        bad, good = [w - x for w, x in zip(whole, below)] if above else below
                        if (gain := _gain(bad, good, *whole)) > gained + 1e-9:
                            best, gained = (f, above, k), gain
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            counts = {r["bad"]: r["count"] for r in inside(left.where("part = 2"), rule[:k]).groupBy("bad").count().collect()}
            bad, good = counts.get(True, 0), counts.get(False, 0)
            if bad + good >= LEAST_COVER:
                worth.append(((bad - good) / (bad + good), -k, bad / (bad + good)))
        if not worth or max(worth)[2] < LEAST_PRECISION:
            break
        rules.append(rule[:-max(worth)[1]])
        left = outside(left, rules[-1])
    # Of two bounds on the same side of a feature the later one is the tighter.
    tight = [{(f, above): k for f, above, k in rule} for rule in rules]
    return [tuple(Condition(names[f], above, bounds[f][k - 1]) for (f, above), k in rule.items()) for rule in tight]


def judged(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` with measures: base_failed, rule (the first that fits) and kept."""
    values = features()
    rows = without(rows, "base_failed", "rule", "kept")
    verdict = F.lit(None).cast("string")
    for r in reversed(rules):
        verdict = F.when(covers(r, values), F.lit(" and ".join(map(str, r)))).otherwise(verdict)
    return rows.withColumns({"base_failed": base_failed(), "rule": verdict}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def labelled(measures: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of the labelled rows, for ``learn``. A document with several labels is bad if one says so."""
    marks = labels.where("quality is not null").groupBy(F.col("doc_id").alias("labelled_id")).agg((F.min("quality") < 1).alias("bad"))
    joined = measures.join(marks, measures["doc_id"] == F.col("labelled_id"))
    return joined.select(*[c.alias(n) for n, c in features().items()], "bad", F.pmod(F.crc32(F.col("labelled_id").cast("string").cast("binary")), F.lit(3)).alias("part"))


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text") -> tuple[DataFrame, list[Rule]]:
    """``docs`` with measures, base_failed, rule and kept; and the list that was learned.

    The list learns from labelled rows that pass the base rules, since it judges no others.
    """
    rows = checkpointed(measured(docs, text).drop(text) if text in docs.columns else measured(docs, text))
    rules = learn(checkpointed(labelled(rows.where(~base_failed()), labels)), list(features()))
    return judged(rows, rules), rules
