"""Quality rules: learned decision lists, all in DataFrame functions.

Statistics are column expressions over the whole text.  Rules are learnt by sequential covering: a rule
is a conjunction of thresholds that grows by FOIL gain on two thirds of the labelled rows, is pruned on the other third by
(p - n) / (p + n), and is kept while it stays precise there; the rows it covers leave, and the next rule is grown.  Each step
aggregates binned statistics of at most ``fit_rows`` labelled rows (the bounded sample) and fetches only a table of
(feature, bin) counts.  The list is emitted as one ordered CASE WHEN, hence scoring is a narrow projection.

Two windows of a text are taken as equal if their 64-bit hashes are; within a text of a million words two different windows
get one hash with a probability under 3e-8.

Edge cases: a null or blank text has no words and fails the base rules; without labels, or with labels of one kind, there are
no rules and only the base rules decide; repeated rows get the same verdict; texts are read whole; other columns, whatever their
names, aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import frozen, labelled, words_of

FIT_ROWS = 8_000
BINS = 25
MAX_RULES = 12
MAX_CONDITIONS = 4
LEAST_PRECISION = 0.9
LEAST_COVER = 3
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "capital_rate", "digit_rate", "mark_rate", "distinct_rate", "stop_rate")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Number of words in 3-word windows that the text has twice or more."""

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        twice = lambda s, k: (F.get(s, k)["h"] == F.get(s, k + 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k - 1)["h"])
        starts = lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(twice(s, k), F.lit(False))), lambda k: F.get(s, k)["i"])
        covered = lambda p: F.size(F.array_distinct(F.flatten(F.transform(p, lambda i: F.array(i, i + 1, i + 2)))))
        return F.when(F.size(w) < 3, 0).otherwise(let(F.array_sort(windows), lambda s: covered(starts(s))))

    return let(words, of).cast("long")


def statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, the base counts and the rates that rules may use."""
    own = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("long")
    lines = F.filter(F.split("_t", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    by_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("distinct"), F.size(F.filter(w, lambda x: F.length(x) <= 3)).alias("short"))
    out = own.select(
        "doc_id", *keep, let(words_of(F.col("_t")), by_words).alias("w"), (F.length("_t") - count(r"[\x20\x09-\x0D]")).alias("word_chars"), count("[#*$%&|<>]").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"), count(r"\p{Lu}").alias("capitals"), count(r"\d").alias("digits"), count("[.,;:!?]").alias("marks"),
    )
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    out = out.select("doc_id", *keep, "w.n_words", "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), "w.n_repeat_words", "w.distinct", "w.short", F.col("l.n").alias("n_lines"), "capitals", "digits", "marks")
    rates = {"mean_word": ("word_chars", "n_words"), "symbol_rate": ("n_symbols", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words"), "capital_rate": ("capitals", "word_chars"), "digit_rate": ("digits", "word_chars"), "mark_rate": ("marks", "word_chars"), "distinct_rate": ("distinct", "n_words"), "stop_rate": ("short", "n_words")}
    return out.withColumns({k: per(*v) for k, v in rates.items()})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float
    bin: int

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def binned(self) -> Column:
        return F.col("b_" + self.feature) > self.bin if self.above else F.col("b_" + self.feature) <= self.bin


@dataclass
class DecisionList:
    """Rules in order; a row is rejected by the first rule that holds, and kept if none does."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rule_number(self) -> Column:
        """1 and up: the first rule that holds; 0: none."""
        out = F.lit(0)
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(_all([c.column() for c in rule]), i).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(f'{c.feature} {'>' if c.above else '<='} {c.threshold:.4g}' for c in r)}" for r in self.rules)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many of the cuts the value exceeds."""
    above = F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda t: F.col(feature) > t)
    return F.size(above).alias("b_" + feature)


def _candidates(rows: DataFrame, rule: list[Condition], cuts: dict[str, list[float]]) -> list[tuple[Condition, int, int]]:
    """(condition, bad rows, good rows) if the condition were added to the rule; from counts by feature and bin."""
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col("b_" + f).alias("b")) for f in FEATURES])
    counts = rows.where(_all([c.binned() for c in rule])).select(F.explode(pairs).alias("x"), "bad").groupBy("x.f", "x.b").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()
    found = []
    for f in FEATURES:
        own = sorted((r["b"], r["bad"], r["good"]) for r in counts if r["f"] == f)
        for k, t in enumerate(cuts[f]):
            low = [sum(r[j] for r in own if r[0] <= k) for j in (1, 2)]
            high = [sum(r[j] for r in own if r[0] > k) for j in (1, 2)]
            found += [(Condition(f, False, t, k), *low), (Condition(f, True, t, k), *high)]
    return found


def _grow(rows: DataFrame, cuts: dict[str, list[float]], bad: int, good: int) -> list[Condition]:
    rule: list[Condition] = []
    while good and len(rule) < MAX_CONDITIONS:
        had = math.log2(bad / (bad + good))
        gains = [(p * (math.log2(p / (p + n)) - had), -n, c, p, n) for c, p, n in _candidates(rows, rule, cuts) if p >= LEAST_COVER and n < good]
        if not gains or (best := max(gains, key=lambda g: (round(g[0], 9), g[1], g[2].feature)))[0] <= 0:
            break
        rule.append(best[2])
        bad, good = best[3:]
    return rule


def learn(stats: DataFrame, label: str = "label") -> DecisionList:
    """Rules that reject rows like those labelled 0.  ``stats`` is a bounded sample of labelled rows with their statistics."""
    # filtered after writing: a filter on statistics would be moved below the join with the labels, and compute them for all rows
    stats = frozen(stats.select("doc_id", F.col(label).alias("label"), "n_repeat_words", *FEATURES), "quality-stats").where(~base_failed())
    stats = stats.select("doc_id", (1 - F.col("label")).alias("bad"), *[F.col(f).cast("double").alias(f) for f in FEATURES])
    points = [k / BINS for k in range(1, BINS)]
    tails = [0.002, 0.005, 0.01, 0.02, 0.98, 0.99, 0.995, 0.998]
    row = stats.agg(*[F.percentile_approx(f, sorted(points + tails), 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(row[f] or [])) for f in FEATURES}
    binned = stats.select("bad", (F.crc32(F.concat(F.lit("prune"), F.col("doc_id").cast("string"))) % 3 == 0).alias("aside"), *[_bin(f, cuts[f]) for f in FEATURES])
    left = frozen(binned, "quality-bins")
    out = DecisionList()
    while len(out.rules) < MAX_RULES:
        n = {(r["aside"], r["bad"]): r["count"] for r in left.groupBy("aside", "bad").count().collect()}
        if not n.get((False, 1)) or not n.get((False, 0)):
            break
        rule = _grow(left.where("not aside"), cuts, n[False, 1], n[False, 0])
        if not rule:
            break
        aside = left.where("aside")
        sums = aside.agg(*[F.coalesce(F.sum(F.when(_all([c.binned() for c in rule[:k]]), x)), F.lit(0)).alias(f"{w}{k}") for k in range(1, len(rule) + 1) for w, x in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]).first()
        value = lambda k: (sums[f"p{k}"] - sums[f"n{k}"]) / max(sums[f"p{k}"] + sums[f"n{k}"], 1)  # noqa: B023, E731
        best = max(range(1, len(rule) + 1), key=lambda k: (value(k), sums[f"p{k}"], -k))  # noqa: B023
        p, bad = sums[f"p{best}"], sums[f"n{best}"]
        if p < 1 or p / (p + bad) < LEAST_PRECISION:
            break
        out.rules.append(rule[:best])
        left = left.where(~_all([c.binned() for c in rule[:best]]))
    return out


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, text: str = "text", doc_id: str = "doc_id") -> DecisionList:
    picked = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")).where("_id is not null and label is not null")
    return learn(statistics(labelled(docs, picked, fit_rows, text, doc_id), keep=("label",)))


def judge(docs: DataFrame, rules: DecisionList, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the base counts, base_failed, rule (of the first that holds, 0 for none), kept."""
    stats = statistics(docs, text, doc_id).withColumns({"base_failed": base_failed(), "rule": rules.rule_number()})
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))
