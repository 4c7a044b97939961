"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A rule says which texts it rejects, in terms of MEASURES. What a rule costs (seconds) and how many texts it rejects is
estimated on a sample; rules then stand in the order of rejections per cost, and a text is tested only until one rejects it. The
sample decides on the order alone: a text is kept if no rule rejects it, so the verdict is the same in any order.

* A null text is an empty one; a text without words is rejected (too few). Repeated rows are judged alike.
* Rows are judged one by one, without a shuffle; other columns pass unread, whatever their names.
* With nothing to sample (an empty table), the rules stay in the order given.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import SPACES, filled, let, settle, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Texts in the sample from which the order is estimated, about.
SAMPLE_ROWS = 2000

Measure = Callable[[Column, Column], Column]


def n_words(text: Column, w: Column) -> Column:
    return F.size(w).cast("long")


def word_chars(text: Column, w: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def n_symbols(text: Column, w: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def n_lines(text: Column, w: Column) -> Column:
    return F.size(lines_of(text)).cast("long")


def n_dup_lines(text: Column, w: Column) -> Column:
    return let(lines_of(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def n_repeat_words(text: Column, w: Column) -> Column:
    """Words in windows of five that occur twice or more. Only if a window repeats at all are the windows sorted; a word is
    counted once, as each such window adds what the one before it does not reach."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda total, x: total + x)

    def repeated(ordered: Column) -> Column:
        again = F.filter(ordered, lambda x, i: (x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"]))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

    def of(hashed: Column) -> Column:
        ordered = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashed)) == F.size(hashed), 0).otherwise(let(ordered, repeated))

    several = let(F.transform(w, lambda x: F.xxhash64(x)), lambda hashes: let(windows(hashes), of))
    return F.when(F.size(w) < WINDOW, 0).otherwise(several).cast("long")


MEASURES: dict[str, Measure] = {f.__name__: f for f in (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


BASE = (
    Rule("few_words", lambda m: m("n_words") < 10),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
)
RULES = (
    *BASE,
    Rule("symbols", lambda m: 100 * m("n_symbols") > 10 * m("n_words")),
    Rule("short_words", lambda m: 2 * m("word_chars") < 5 * m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > 12 * m("n_words")),
    Rule("same_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
)


def _of(text: Column, w: Column) -> Callable[[str], Column]:
    return lambda name: MEASURES[name](text, w)


def first_rejection(rules: Sequence[Rule], measure: Callable[[str], Column]) -> Column:
    """The name of the first rule that rejects, else null. Later branches are not evaluated."""
    out = None
    for rule in rules:
        out = F.when(rule.rejects(measure), rule.name) if out is None else out.when(rule.rejects(measure), rule.name)
    return F.lit(None).cast("string") if out is None else out


def cascade(text: Column, rules: Sequence[Rule]) -> Column:
    """first_rejection straight from the text: its words are split once, a measure is taken when its rule is reached."""
    return let(filled(text), lambda t: let(words(t), lambda w: first_rejection(rules, _of(t, w))))


def estimated(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, int]]:
    """(rule, seconds, rejections) on a sample of about ``sample_rows`` texts."""
    total = docs.count()
    sample = settle(docs.select("text").sample(fraction=min(1.0, sample_rows / max(1, total)), seed=1), "quality-sample")

    def rejected(chosen: Sequence[Rule]) -> int:
        return sample.select(F.count(cascade(F.col("text"), chosen))).first()[0]

    rejected(rules)  # reads and compiles once before anything is timed
    found = []
    for rule in rules:
        begun = time.perf_counter()
        n = rejected([rule])
        found.append((rule, time.perf_counter() - begun, n))
    return found


def ordered(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on the sample, most first."""
    return [r for r, _, _ in sorted(estimated(docs, rules, sample_rows), key=lambda x: -x[2] / max(x[1], 1e-6))]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and all measures of each row."""
    both = let(filled(F.col("text")), lambda t: let(words(t), lambda w: F.struct(*[f(t, w).alias(n) for n, f in MEASURES.items()])))
    return docs.select("doc_id", both.alias("m")).select("doc_id", "m.*")


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The measures, base_failed, rejected_by (the first rule that rejects, in the cascade's order) and kept of each row."""
    base = None
    for rule in BASE:
        base = rule.rejects(F.col) if base is None else base | rule.rejects(F.col)
    reason = first_rejection(ordered(docs, rules), F.col)
    return (measured(docs).withColumn("base_failed", base).withColumn("rejected_by", reason)
            .withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()))


def kept(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    return docs.where(cascade(F.col("text"), ordered(docs, rules)).isNull())
