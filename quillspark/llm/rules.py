"""Quality rules: base statistics and a learned decision list, all in Spark expressions.

Statistics are native columns of one scan without a shuffle. The list is learned by sequential covering:
on statistics of labelled texts a conjunction of thresholds is grown by information gain on two thirds of
the rows, pruned on the other third, taken if it is precise enough there, and the rows that it covers
leave before the next is grown. The rules come out as one ordered conditional expression (``when`` chain).

Labelled rows are a sample of about ``fit_rows`` ids at most (smallest hash of the id; a documented bound);
the list is applied to every row.

Cases: null texts count as empty (no words, all statistics 0, base_failed); ids may be null or repeated,
each row is judged by itself; labels without id or class are ignored; without labels the list is empty and
keeps all; statistics are of whole texts; extra columns are not read."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import thinned

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FIT_ROWS = 20_000

#: What the rules test: name, and a statistic per thousand of its whole, so that texts of all lengths compare.
RATIOS = {
    "symbol_rate": "1000 * n_symbols div greatest(word_chars, 1)",
    "dup_line_rate": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeat_rate": "1000 * n_repeat_words div greatest(n_words, 1)",
    "upper_rate": "1000 * n_upper div greatest(word_chars, 1)",
    "digit_rate": "1000 * n_digits div greatest(word_chars, 1)",
    "shout_rate": "1000 * n_shouts div greatest(n_words, 1)",
    "word_length": "1000 * word_chars div greatest(n_words, 1)",
    "line_words": "1000 * n_words div greatest(n_lines, 1)",
    "n_words": "n_words",
}
NAMES = list(RATIOS)

# Hashes of all three-word windows. Most texts hold no window twice: as many distinct hashes as windows. Else
# (hash, position) is sorted, so that windows found twice stand side by side, and the words that their union
# covers are counted. A one-element array binds a name to a value computed once.
_REPEATS = """
transform(
    transform(array(words), w -> if(size(w) < 3, cast(array() as array<bigint>),
        transform(sequence(0, greatest(size(w) - 3, 0)), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))))),
    h -> if(size(array_distinct(h)) = size(h), 0L, transform(
        array(sort_array(transform(h, (x, i) -> struct(x as h, i as p)))),
        s -> aggregate(
            sort_array(transform(filter(s, (x, i) -> get(s, i - 1).h <=> x.h or get(s, i + 1).h <=> x.h), x -> x.p)),
            struct(0L as covered, -9 as last),
            (a, p) -> struct(a.covered + least(3, p - a.last) as covered, p as last),
            a -> a.covered))[0]))[0]
"""

_UPPER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Each class of characters stands as one character in ``plain``, so that one pass serves all counts.
_CLASSES = {"A": _UPPER, "0": _DIGITS, "#": SYMBOLS, " ": SPACES}


def _times(text: str, char: str) -> Column:
    """How often an ASCII character occurs."""
    return (F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit(char), F.lit("")))).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the statistics of each row's whole text, by native expressions."""
    texts = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    split = texts.select(
        "doc_id",
        "text",
        F.expr(r"array_remove(split(text, '[ \t-\r]+'), '')").alias("words"),
        F.expr(r"filter(split(text, '\n'), x -> x rlike '[^ \t-\r]')").alias("lines"),
        F.translate("text", "".join(_CLASSES.values()), "".join(k * len(v) for k, v in _CLASSES.items())).alias("plain"),
    )
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - _times("plain", " ")).cast("long").alias("word_chars"),
        _times("plain", "#").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATS).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _times("plain", "A").alias("n_upper"),
        _times("plain", "0").alias("n_digits"),
        _times("text", "!").alias("n_shouts"),
    )


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: int

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, NAMES.index(self.name)]
        return value >= self.threshold if self.above else value < self.threshold

    def column(self) -> Column:
        value = F.expr(RATIOS[self.name])
        return value >= self.threshold if self.above else value < self.threshold


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best_condition(x: np.ndarray, bad: np.ndarray, steps: int) -> Condition | None:
    """The condition with the largest information gain; thresholds are quantiles of the bad rows, ties go to the first."""
    total = int(bad.sum())
    base, best, gain = math.log2(total / len(bad)), None, 1e-9
    for k, name in enumerate(NAMES):
        marked, others = np.sort(x[bad, k]), np.sort(x[~bad, k])
        values = np.unique(marked[np.arange(steps + 1) * (total - 1) // steps])
        for above, cuts in ((True, values), (False, values + 1)):
            p, n = np.searchsorted(marked, cuts), np.searchsorted(others, cuts)
            if above:
                p, n = total - p, len(others) - n
            gains = p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base)
            at = int(np.argmax(gains))
            if gains[at] > gain:
                best, gain = Condition(name, above, int(cuts[at])), float(gains[at])
    return best


def _grow(x: np.ndarray, bad: np.ndarray, most: int, steps: int) -> Rule:
    rule: Rule = ()
    while len(rule) < most and bad.any() and not bad.all():
        best = _best_condition(x, bad, steps)
        if best is None:
            break
        rule += (best,)
        inside = best.holds(x)
        x, bad = x[inside], bad[inside]
    return rule


def _prune(x: np.ndarray, bad: np.ndarray, rule: Rule) -> Rule:
    def worth(r: Rule) -> float:
        inside = covered(r, x)
        p, n = int(bad[inside].sum()), int(inside.sum())
        return (2 * p - n) / n if n else -1

    best = rule
    for end in range(len(rule) - 1, 0, -1):
        if worth(rule[:end]) >= worth(best):
            best = rule[:end]
    return best


def learn(rows: tuple[np.ndarray, np.ndarray], precision: float = 0.97, least: int = 3, most_rules: int = 16, most_conditions: int = 3, steps: int = 24) -> list[Rule]:
    """Ordered rules that mark bad rows. rows: a row of statistics (in the order of ``NAMES``) each, and whether its label is bad."""
    x, bad = rows
    pruning = np.arange(len(x)) % 3 == 0
    rules: list[Rule] = []
    while len(rules) < most_rules and bad[~pruning].any():
        rule = _grow(x[~pruning], bad[~pruning], most_conditions, steps)
        if not rule:
            break
        rule = _prune(x[pruning], bad[pruning], rule)
        inside = covered(rule, x)
        hits = int(bad[inside].sum())
        if hits < least or hits < precision * int(inside.sum()):
            break
        rules.append(rule)
        x, bad, pruning = x[~inside], bad[~inside], pruning[~inside]
    return rules


def labelled_statistics(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Statistics of about ``fit_rows`` labelled ids at most, on the driver, and whether each is bad (label 0)."""
    own = labels.select(labels["doc_id"].cast("long").alias("label_id"), labels["quality"].alias("quality")).filter("label_id is not null and quality is not null")
    # Of several labels, and of several texts, of one id the least counts.
    own = thinned(own.groupBy("label_id").agg(F.min("quality").alias("quality")), fit_rows, "label_id")
    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("label_id"))
    stats = statistics(chosen.select("doc_id", "text")).join(F.broadcast(own), F.col("doc_id") == F.col("label_id"))
    ratios = F.array(*[F.expr(v).cast("long") for v in RATIOS.values()])
    got = stats.filter("n_words >= 50").groupBy("doc_id").agg(F.min(F.struct(ratios.alias("x"), (F.col("quality") == 0).alias("bad"))).alias("row")).collect()
    got = sorted(got, key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"]))
    return np.array([r["row"]["x"] for r in got], np.int64).reshape(-1, len(RATIOS)), np.array([r["row"]["bad"] for r in got], bool)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression: the number of the first rule that holds, or 0."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def apply_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, ``base_failed``, ``rule`` (0: none held) and ``kept`` for each row of docs."""
    stats = statistics(docs, id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
