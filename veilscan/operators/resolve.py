"""Overlap resolution: from candidate spans to findings that never overlap.

Only spans that overlap, directly or through others, can influence each other. So the spans of
a document are cut into islands (maximal runs of overlapping spans), and each island, usually
one to five spans, is folded on its own. Spans of a document sit in one array, so this needs
no shuffle, and the cost grows with the spans and not with their pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veilscan import fixed_values as fv
from veilscan.operators.spans import is_ner, let

# Generic type -> the more specific type that absorbs it.
GENERIC, SPECIFIC = "PHONE_NUMBER", "IN_PHONE"


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _first(array: Column) -> Column:
    return F.get(array, 0)


def _merge_generic(xs: Column) -> Column:
    """Drop generic phones that overlap a specific one; the first such one takes the higher score."""

    def merge(phones: Column, generics: Column) -> Column:
        def first_hit(g: Column) -> Column:
            return _first(F.filter(phones, lambda p: overlaps(p, g)))["start"]

        def lifted(x: Column) -> Column:
            given = F.filter(generics, lambda g: first_hit(g) == x["start"])
            best = F.coalesce(F.array_max(F.transform(given, lambda g: g["score"])), x["score"])
            return F.when(x["entity_type"] == SPECIFIC, F.greatest(x["score"], best)).otherwise(x["score"])

        kept = F.filter(xs, lambda x: ~((x["entity_type"] == GENERIC)
                                        & F.exists(phones, lambda p: overlaps(p, x))))
        return F.transform(kept, lambda x: x.withField("score", lifted(x)))

    return let(F.filter(xs, lambda x: x["entity_type"] == SPECIFIC),
               lambda phones: let(F.filter(xs, lambda x: x["entity_type"] == GENERIC),
                                  lambda generics: merge(phones, generics)))


def _drop_weak_cards(xs: Column) -> Column:
    """Drop a card number that overlaps an account number and reads like one."""
    return F.filter(xs, lambda x: ~(x["weak_card"] & F.exists(
        xs, lambda a: (a["entity_type"] == "BANK_ACCOUNT") & overlaps(a, x))))


def _ranked(xs: Column) -> Column:
    """Strongest first: score, custom types, length; then position and type for a total order."""
    keyed = F.transform(xs, lambda x: F.struct(
        (-x["score"]).alias("k1"),
        F.when(x["entity_type"].isin(*fv.CUSTOM_TYPES), 0).otherwise(1).alias("k2"),
        (x["start"] - x["end"]).alias("k3"),
        x["start"].alias("start"), x["entity_type"].alias("entity_type"),
        x["end"].alias("end"), x["score"].alias("score"), x["value"].alias("value"),
    ))
    return F.transform(F.array_sort(keyed), lambda k: F.struct(
        k["start"].alias("start"), k["end"].alias("end"), k["entity_type"].alias("entity_type"),
        k["score"].alias("score"), k["value"].alias("value")))


def _greedy(ranked: Column) -> Column:
    """Keep a span unless it overlaps one already kept."""
    return let(ranked, lambda bound: _keep(F.slice(bound, 1, 0), bound))


def _keep(kept: Column, more: Column) -> Column:
    return F.aggregate(
        more, kept,
        lambda acc, x: F.when(F.exists(acc, lambda k: overlaps(k, x)), acc).otherwise(
            F.concat(acc, F.array(x))))


def _trimmed(x: Column, fixed: Column) -> Column:
    """A fuzzy span cut to its longest piece between fixed spans, without separators at its ends."""

    def longest(inside: Column) -> Column:
        starts = F.concat(F.array(x["start"]), F.transform(inside, lambda k: k["end"]))
        ends = F.concat(F.transform(inside, lambda k: k["start"]), F.array(x["end"]))
        pieces = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.struct(
            (z["e"] - z["s"]).alias("n"), (-z["s"]).alias("first"), z["s"].alias("s"), z["e"].alias("e")))
        return F.array_max(pieces)

    def strip(piece: Column) -> Column:
        text = F.substring(x["value"], piece["s"] - x["start"] + 1, piece["n"])
        left = F.regexp_replace(text, r"^[^\p{L}\p{N}]+", "")
        core = F.regexp_replace(left, r"[^\p{L}\p{N}]+$", "")
        start = piece["s"] + F.length(text) - F.length(left)
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"),
                        x["entity_type"].alias("entity_type"), x["score"].alias("score"), core.alias("value"))

    inside = F.filter(fixed, lambda k: overlaps(k, x))
    return let(inside, lambda bound: let(longest(bound), strip))


def _sensible(x: Column) -> Column:
    """At least two characters, and a letter where the type needs one."""
    needs_letter = x["entity_type"].isin("PERSON", "LOCATION")
    return (F.length(x["value"]) >= 2) & (~needs_letter | x["value"].rlike(r"\p{L}"))


def fold_island(xs: Column) -> Column:
    """The spans of one island that survive, in text order."""

    def with_ner(fixed: Column, merged: Column) -> Column:
        fuzzy = _ranked(F.filter(merged, lambda x: is_ner(x["entity_type"])))
        pieces = F.filter(F.transform(fuzzy, lambda x: _trimmed(x, fixed)), _sensible)
        return _keep(fixed, pieces)

    def resolve(merged: Column) -> Column:
        solid = F.filter(merged, lambda x: ~is_ner(x["entity_type"]))
        fixed = F.array_sort(_greedy(_ranked(solid)))
        return let(fixed, lambda f: F.array_sort(with_ner(f, merged)))

    return let(_merge_generic(xs), lambda m: let(_drop_weak_cards(m), resolve))


_BLOCK = 64


def _block_tops(numbers: Column) -> Column:
    last = F.floor((F.size(numbers) - 1) / _BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last),
                       lambda b: F.array_max(F.slice(numbers, b * _BLOCK + 1, F.lit(_BLOCK))))


def _reach(ends: Column) -> Column:
    """For every index the largest end in front of it, through blocks of ``_BLOCK``."""
    def ahead(numbers: Column, starts: Column) -> Column:
        """Per number the largest of its block's start and the block's numbers in front of it."""
        block = lambda i: F.floor(i / _BLOCK).cast("int")
        return F.transform(numbers, lambda _, i: F.greatest(
            F.element_at(starts, block(i) + 1), F.array_max(F.slice(numbers, block(i) * _BLOCK + 1, i % _BLOCK))))

    def starts_of(highest: Column) -> Column:
        return F.transform(highest, lambda _, t: F.coalesce(F.array_max(F.slice(highest, F.lit(1), t)), F.lit(0)))

    # by way of blocks of blocks, so that very many spans do not cost the square of their number
    through = let(_block_tops(ends), lambda tops: let(_block_tops(tops), lambda highest: let(
        starts_of(highest), lambda s: let(ahead(tops, s), lambda prior: ahead(ends, prior)))))
    return F.when(F.size(ends) <= _BLOCK, starts_of(ends)).otherwise(through)


def _islands(xs: Column) -> Column:
    """Sorted spans cut where nothing before reaches over the start of the next one."""

    def cut(reach: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(xs) - 1)
        heads = F.filter(places, lambda i: F.get(xs, i)["start"] >= F.get(reach, i))
        return let(heads, lambda hs: F.transform(hs, lambda h, k: F.slice(
            xs, h + 1, F.coalesce(F.get(hs, k + 1), F.size(xs)) - h)))

    ends = F.transform(xs, lambda x: x["end"])
    return let(ends, lambda bound: let(_reach(bound), cut))


def _as_finding(x: Column) -> Column:
    return F.struct(*[x[f].alias(f) for f in ("start", "end", "entity_type", "score", "value")])


def resolve(spans: Column) -> Column:
    """Findings without overlaps, in text order, from an array of candidate spans.

    In: (start, end, entity_type, score, weak_card, value). Out: the same without weak_card.
    The whole struct is the sort key, so the order is total and results are deterministic.
    """

    def alone(island: Column) -> Column:
        return (F.size(island) == 1) & ~is_ner(F.get(island, 0)["entity_type"])

    def one(island: Column) -> Column:
        return F.when(alone(island), F.transform(island, _as_finding)).otherwise(fold_island(island))

    folded = let(F.array_sort(spans), lambda xs: F.flatten(F.transform(_islands(xs), one)))
    return F.when(alone(spans), F.transform(spans, _as_finding)).when(F.size(spans) > 0, folded).otherwise(F.transform(F.slice(spans, 1, 0), _as_finding))
