"""Secret scanning through an inverted index of trigrams.

From each rule's regular expression a Boolean query over trigrams is derived: a text that the rule
can match contains all trigrams of at least one of the alternatives. The index has, for each trigram that some
query names, the keys of the texts that contain it (any letter case). A query intersects and unites
postings; the rule's expression runs on its candidates alone. A rule whose expression has no
mandatory trigram is run on every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattgrid.llm.common import fresh, quoted, text_of, without
from wattgrid.session import checkpointed

MARK = "\x01"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``value_group`` (0: the whole) has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    value_group: int = 0


# The kinds asked for and the shortest value that counts, then further well-known token forms.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (Rule("assign", ASSIGN, 8, 2), Rule("access", r"AKIA[A-Z0-9]+", 16), Rule("hex", r"[0-9a-f]+", 32))
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

# ---------------------------------------------------------------- trigram queries


def literal_runs(pattern: str) -> list[list[str]]:
    """Alternatives, each a list of strings that a match contains in this order, in lower case.

    Groups with alternatives, optional single characters and small classes are multiplied out;
    everything else that is not a plain character ends a run.
    """
    import re._parser as parser

    def walk(items, ways: list[list[str]]) -> list[list[str]]:
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                ways = [w[:-1] + [w[-1] + chr(value).lower()] for w in ways]
            elif name == "SUBPATTERN":
                ways = walk(value[3], ways)
            elif name == "BRANCH":
                ways = [x for part in value[1] for x in walk(part, ways)]
            elif name == "IN" and len(value) <= 8 and all(str(o) == "LITERAL" for o, _ in value):
                ways = [w[:-1] + [w[-1] + chr(c).lower()] for w in ways for _, c in value]
            elif name == "MAX_REPEAT" and value[0] == 0 and value[1] == 1 and len(value[2]) == 1 and str(value[2][0][0]) == "LITERAL":
                ways = ways + walk(value[2], ways)
            elif name == "MAX_REPEAT" and value[0] >= 1:
                ways = [w + [""] for w in walk(list(value[2]) * value[0] if value[0] <= 4 else [], [w + [""] for w in ways])]
            else:
                ways = [w + [""] for w in ways]
        return ways

    return [[run for run in way if run] for way in walk(list(parser.parse(pattern)), [[""]])]


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The alternatives as sets of trigrams; None if one of them names no trigram."""
    ways = [frozenset(run[i:i + 3] for run in way for i in range(len(run) - 2)) for way in literal_runs(pattern)]
    if not all(ways):
        return None
    return [w for w in dict.fromkeys(ways) if not any(other < w for other in ways)]


# ---------------------------------------------------------------- index


def row_key(text: str, doc_id: str) -> Column:
    """Rows alike in id and text share a key, and so their result."""
    return F.struct(quoted(doc_id).cast("string").alias("id"), F.xxhash64(text_of(text)).alias("text"))


def trigram_index(docs: DataFrame, trigrams: list[str], text: str, doc_id: str) -> DataFrame:
    """Postings ``gram``, ``key`` of the given trigrams, over every whole text."""
    lower = F.translate(text_of(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    present = F.filter(F.array(*[F.when(F.contains(F.col("lower"), F.lit(g)), F.lit(n)) for n, g in enumerate(trigrams)]), lambda g: g.isNotNull())
    return docs.select(row_key(text, doc_id).alias("key"), lower.alias("lower")).select(F.explode(present).alias("gram"), "key")


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]], trigrams: list[str]) -> DataFrame:
    """``key``, ``rules``: the rules whose query the postings of the key fulfil.

    The postings of a key meet as the bits of a number, so partial results are numbers as well.
    """
    number = {g: n for n, g in enumerate(trigrams)}
    words = [F.bit_or(F.when(F.floor(F.col("gram") / 60) == k, F.expr("shiftleft(1L, gram % 60)")).otherwise(F.lit(0).cast("long"))).alias(f"bits{k}")
             for k in range(-(-len(trigrams) // 60))]
    met = postings.groupBy("key").agg(*words)

    def holds(way: frozenset[str]) -> Column:
        need = [0] * len(words)
        for g in way:
            need[number[g] // 60] |= 1 << (number[g] % 60)
        return _all([F.col(f"bits{k}").bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long") for k, m in enumerate(need) if m])

    found = F.filter(F.array(*[F.when(_any([holds(w) for w in ways]), F.lit(kind)) for kind, ways in queries.items()]), lambda x: x.isNotNull())
    return met.select("key", found.alias("rules")).where(F.size("rules") > 0)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


# ---------------------------------------------------------------- matches


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of the rule's matches, leftmost and non-overlapping; those too short are dropped.

    Matches are set between marks, so that the text splits into what lies between, a match, what
    lies between, and so on; running lengths give the places.
    """
    pattern = rule.pattern
    if rule.value_group == 0 and rule.least and re.fullmatch(r"\[[^\]]+\]\+", pattern):
        pattern = f"{pattern[:-1]}{{{rule.least},}}"  # a run of one class: a shorter run can't hide a longer one
    parts = F.split(F.regexp_replace(F.translate(text, MARK, "�"), F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}")), MARK)
    none = F.array().cast("array<struct<start:int,number:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), none.alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        value = part if rule.value_group == 0 else F.regexp_extract(part, rule.pattern, rule.value_group)
        span = F.struct(acc["at"].alias("start"), F.lit(number).alias("number"), end.alias("end"))
        good = acc["hit"] & (F.length(value) >= rule.least)
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(F.regexp(text, F.lit(pattern)), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(none)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``secret_spans``: array of (start, number, end) in code points, end exclusive, by start, then rule.

    Null and empty texts have none. Rows alike in id and text are looked up together and each keeps
    its result. Columns of any name are kept, but for a former ``secret_spans``.
    """
    docs = without(docs, "secret_spans")
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({g for q in queries.values() for way in q for g in way})
    key, rules_of = fresh(docs, "row_key", "row_rules")
    postings = checkpointed(trigram_index(docs, trigrams, text, doc_id))
    found = candidates(postings, queries, trigrams).withColumnsRenamed({"key": key, "rules": rules_of})
    joined = docs.withColumn(key, row_key(text, doc_id))
    joined = joined.join(found, [joined[key]["text"].eqNullSafe(found[key]["text"]), joined[key]["id"].eqNullSafe(found[key]["id"])], "left").drop(found[key])
    none = F.array().cast("array<struct<start:int,number:int,end:int>>")
    each = [spans_of(text_of(text), r, n) if r.kind not in queries else
            F.when(F.array_contains(rules_of, r.kind), spans_of(text_of(text), r, n)).otherwise(none) for n, r in enumerate(rules)]
    return joined.select(*[quoted(c) for c in docs.columns], F.sort_array(F.concat(*each)).alias("secret_spans"))


def described(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["number"] + 1), s["start"], s["end"])), ",")
