"""Text to candidate spans: every match of every rule with its position and confidence.

Spark has no expression that returns the offsets of all matches. The construction here stays
inside built-in expressions and reads the text once, in one narrow stage without a shuffle:

1. per rule, ``regexp_replace`` puts a marker around every match and ``split`` cuts there, so
   the odd pieces are the matches and the even ones the gaps between them;
2. the start of a match is the summed length of the pieces before it. Sums go through blocks
   of 64 pieces, so a document with very many matches does not cost the square of their number;
3. validators and context tests score each span, and what falls below the minimum is dropped.

The spans stay in an array next to the document, so nothing has to be joined back.

An expression that a lambda refers to is evaluated once per element when the optimizer copies
it into the lambda. ``let`` and ``stage`` bind a value once and keep that from happening.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from veilscan import fixed_values as fv
from veilscan.config import DEFAULT, Settings
from veilscan.operators import rules as R

MARK = "\u0001"
_BLOCK = 64
SCORE = "decimal(4,3)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the column a function builds, per arguments.

    The large expressions take thousands of calls to the JVM to put together; they only depend
    on rules and settings, so every further query of a session reuses them.
    """
    kept: dict = {}

    @wraps(build)
    def get(*key):
        gateway = SparkContext._gateway
        place = (id(gateway), tuple(k if isinstance(k, (tuple, str, int, float)) else repr(k) for k in key))
        if place not in kept:
            kept[place] = (gateway, build(*key))
        return kept[place][1]

    return get


def stage(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Add a column behind a one-row generator, which the optimizer does not collapse."""
    return df.select("*", F.explode(F.array(value)).alias(column))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, n: a + n)


def _block_sums(numbers: Column) -> Column:
    last = F.floor((F.size(numbers) - 1) / _BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: _total(F.slice(numbers, b * _BLOCK + 1, F.lit(_BLOCK))))


def _block_starts(lengths: Column) -> Column:
    """Summed length in front of every block of ``_BLOCK`` pieces, by way of blocks of blocks."""

    def within(sums: Column, tops: Column) -> Column:
        starts = F.transform(tops, lambda _, t: _total(F.slice(tops, F.lit(1), t)))
        return let(starts, lambda ts: F.transform(sums, lambda _, b: F.element_at(
            ts, F.floor(b / _BLOCK).cast("int") + 1) + _total(F.slice(sums, F.floor(b / _BLOCK).cast("int") * _BLOCK + 1, b % _BLOCK))))

    through = let(_block_sums(lengths), lambda s: let(_block_sums(s), lambda t: within(s, t)))
    return F.when(F.size(lengths) <= _BLOCK, F.array(F.lit(0))).otherwise(through)


def starts(lengths: Column) -> Column:
    """Summed length in front of every piece."""
    return let(_block_starts(lengths), lambda blocks: F.transform(lengths, lambda _, i: F.element_at(
        blocks, F.floor(i / _BLOCK).cast("int") + 1) + _total(F.slice(lengths, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))))


def _spans(parts: Column, windowed: Column) -> Column:
    """Array of (start, end, value, before, after) for the odd pieces of ``parts``."""

    def build(lengths: Column, blocks: Column) -> Column:
        def before(i: Column) -> Column:
            gap = F.element_at(parts, i - 1)
            first = F.greatest(i - 1 - R.BEFORE_CHARS, F.lit(1))
            joined = F.array_join(F.slice(parts, first, i - first), "")
            return F.right(F.when(F.length(gap) >= R.BEFORE_CHARS, gap).otherwise(joined), F.lit(R.BEFORE_CHARS))

        def after(i: Column) -> Column:
            gap = F.element_at(parts, i + 1)
            joined = F.array_join(F.slice(parts, i + 1, F.lit(R.AFTER_CHARS + 1)), "")
            return F.left(F.when(F.length(gap) >= R.AFTER_CHARS, gap).otherwise(joined), F.lit(R.AFTER_CHARS))

        def span(i: Column) -> Column:
            block = F.floor((i - 1) / _BLOCK).cast("int")
            inside = F.slice(lengths, block * _BLOCK + 1, (i - 1) % _BLOCK)
            start = F.element_at(blocks, block + 1) + F.aggregate(inside, F.lit(0), lambda a, n: a + n)
            return F.struct(
                start.alias("start"),
                F.element_at(lengths, i).alias("len"),
                F.element_at(parts, i).alias("value"),
                F.when(windowed, before(i)).alias("before"),
                F.when(windowed, after(i)).alias("after"),
            )

        return F.transform(F.sequence(F.lit(2), F.size(parts), F.lit(2)), span)

    lengths = F.transform(parts, lambda p: F.length(p))
    return let(lengths, lambda ls: let(_block_starts(ls), lambda bs: build(ls, bs)))


def _pieces(text: Column, rule: R.Rule) -> Column:
    cut = F.split(F.regexp_replace(text, rule.pattern, rule.lead + MARK + rule.value + MARK), MARK)
    found = text.rlike(rule.pattern)
    return F.when(F.col("_gate_" + rule.gate) & found if rule.gate else found, cut)


def _judged(verdict: Column, score: Column) -> Column:
    return let(verdict, lambda v: F.when(v.isNull(), score).when(v, F.lit(1.0)))


def _adjusted(rule: R.Rule, before: Column, score: Column) -> Column:
    return let(score, lambda s: rule.adjust(before, s))


def _confidence(rules: tuple[R.Rule, ...], hit: Column, span: Column, boost: float) -> Column:
    """Score of a match, NULL when the rule rejects it."""
    value, before, after = span["value"], span["before"], span["after"]
    chain = None
    for number, rule in enumerate(rules):
        score = F.lit(float(rule.score))
        if rule.validate:
            score = _judged(rule.validate(value), score)
        if rule.adjust:
            score = _adjusted(rule, before, score)
        if rule.context:
            score = F.when(rule.context(before, after), score)
        if boost and rule.boost_words:
            words = F.regexp_extract_all(F.lower(before), F.lit(r"[\p{L}\p{N}/-]+"), F.lit(0))
            recent = F.array_join(F.slice(F.reverse(words), 1, 5), "\n")
            lifted = F.least(F.lit(1.0), score + F.lit(boost))
            near = score.isNotNull() & recent.rlike("|".join(rule.boost_words))
            score = F.when(near, lifted).otherwise(score)
        chain = F.when(hit == number, score) if chain is None else chain.when(hit == number, score)
    return chain


@built_once
def _hits(rules: tuple[R.Rule, ...]) -> Column:
    """Per rule the pieces of the text, NULL where the rule does not match."""
    return F.array(*[_pieces(F.col("_text"), r) for r in rules])


@built_once
def _scored_spans(rules: tuple[R.Rule, ...], boost: float, min_score: float) -> Column:
    """The spans of all rules that hit, from ``_hits``."""
    windowed = [i for i, r in enumerate(rules)
                if r.context or r.adjust or r.entity == "CREDIT_CARD" or (r.boost_words and boost)]
    names = F.array(*[F.lit(r.entity) for r in rules])
    least = F.lit(min_score).cast(SCORE)

    def scored(parts: Column, rule: Column) -> Column:
        def finish(s: Column) -> Column:
            entity = F.get(names, rule)
            weak = F.when(entity == "CREDIT_CARD", R.weak_card(s["before"], s["after"]))
            return F.struct(
                s["start"].alias("start"), (s["start"] + s["len"]).alias("end"), entity.alias("entity_type"),
                _confidence(rules, rule, s, boost).cast(SCORE).alias("score"),
                F.coalesce(weak, F.lit(False)).alias("weak_card"), s["value"].alias("value"))

        spans = F.transform(_spans(parts, rule.isin(*windowed) if windowed else F.lit(False)), finish)
        return F.when(parts.isNotNull(), F.filter(spans, lambda s: s["score"] >= least))

    return F.flatten(F.filter(F.transform(F.col("_hits"), scored), lambda a: a.isNotNull()))


def with_spans(docs: DataFrame, settings: Settings = DEFAULT, text_col: str = "text",
               rules: tuple[R.Rule, ...] | None = None) -> DataFrame:
    """The documents plus ``spans``: scored candidates, overlaps included.

    A span is (start, end, entity_type, score, weak_card, value); offsets count code points
    and the end is exclusive. Filters on entity and score are applied here, before overlaps
    are resolved. Select away the text afterwards and Spark drops it right behind this step.
    """
    wanted = set(settings.entities)
    rules = tuple(r for r in (R.RULES if rules is None else rules) if r.entity in wanted)
    wanted_gates = list(dict.fromkeys(r.gate for r in rules if r.gate and r.gate != "digit"))
    digit, text = F.col("_gate_digit"), F.col("_text")
    gates = [(digit & text.rlike(R.GATES[g]) if g in R.DIGIT_GATES else text.rlike(R.GATES[g])).alias("_gate_" + g)
             for g in wanted_gates]
    cleaned = docs.select("*", F.replace(F.col(text_col), F.lit(MARK), F.lit(" ")).alias("_text"))
    cleaned = cleaned.select("*", text.rlike(R.GATES["digit"]).alias("_gate_digit")).select("*", *gates)
    hits = cleaned.select(*docs.columns, F.explode(F.array(_hits(rules))).alias("_hits"))
    spans = F.explode(F.array(_scored_spans(rules, settings.context_boost, settings.min_score)))
    return hits.select(*docs.columns, spans.alias("spans"))


def candidates(docs: DataFrame, settings: Settings = DEFAULT, id_col: str = "doc_id",
               text_col: str = "text", rules: tuple[R.Rule, ...] | None = None) -> DataFrame:
    """Candidate spans as rows, overlaps included."""
    found = with_spans(docs.select(id_col, text_col), settings, text_col, rules)
    return found.select(id_col, F.inline("spans"))


def is_ner(entity: Column) -> Column:
    return entity.isin(*fv.NER_TYPES)
