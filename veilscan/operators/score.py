"""Document risk: weighted sum, volume bonus, dangerous combinations, level and reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilscan import fixed_values as fv
from veilscan.config import DEFAULT, Settings
from veilscan.operators.spans import built_once, let, stage

_SUM = "decimal(18,3)"


def lookup(entries: dict, key: Column, default) -> Column:
    """Value of a small fixed map, as an expression."""
    table = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def friendly(entity: Column, count: Column) -> Column:
    """Plain-English name of a type; an unknown type is its own name."""
    one = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in fv.FRIENDLY.items()
                                                     for x in (k, v[0])]), entity), entity)
    many = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in fv.FRIENDLY.items()
                                                      for x in (k, v[1])]), entity), entity)
    return F.when(count == 1, one).otherwise(many)


def volume_bonus(records: Column, settings: Settings = DEFAULT) -> Column:
    """Points of the highest tier whose record count is reached."""
    bonus = None
    for least, points in sorted(settings.bonus_tiers, reverse=True):
        bonus = F.when(records >= least, points) if bonus is None else bonus.when(records >= least, points)
    return F.lit(0) if bonus is None else bonus.otherwise(0)


def risk_level(score: Column, settings: Settings = DEFAULT) -> Column:
    return F.when(score >= settings.high, "High").when(score >= settings.medium, "Medium").otherwise("Low")


def type_totals(findings: Column) -> Column:
    """Per type of one document: findings, summed confidence, first position."""
    kinds = F.array_distinct(F.transform(findings, lambda f: f["entity_type"]))

    def total(kind: Column) -> Column:
        own = F.filter(findings, lambda f: f["entity_type"] == kind)
        return let(own, lambda fs: F.struct(
            kind.alias("entity_type"), F.size(fs).alias("n"),
            F.aggregate(fs, F.lit(0).cast(_SUM), lambda a, f: (a + f["confidence"]).cast(_SUM)).alias("sure"),
            F.array_max(F.transform(fs, lambda f: f["confidence"])).alias("top"),
            F.array_min(F.transform(fs, lambda f: f["start"])).alias("first")))

    return F.transform(kinds, total)


def _reason(settings: Settings) -> Column:
    """The sentence that explains a score."""
    label = F.transform("_types", lambda t: F.struct(
        (-lookup(settings.weights, t["entity_type"], 0)).alias("k1"), (-t["n"]).alias("k2"),
        t["first"].alias("k3"),
        F.concat(t["n"].cast("string"), F.lit(" "), friendly(t["entity_type"], t["n"])).alias("label")))
    shown = F.transform(F.slice(F.array_sort(label), 1, 4), lambda x: x["label"])
    others = F.size("_types") - 4
    extra = F.when(others > 0, F.array(F.concat(others.cast("string"), F.lit(" other type(s)")))).otherwise(
        F.array().cast("array<string>"))
    what = F.array_compact(F.array(
        F.when(_any("HEALTH_INFO"), F.lit("health data")),
        F.when(_any("SALARY"), F.lit("salary details")),
        F.when(_any(*fv.ACCOUNT_TYPES), F.lit("financial account data"))))
    who = F.when(_any("PERSON"), "a named person").otherwise("a personal identifier")
    toxic = F.when(F.col("_sums.toxic"), F.concat(
        F.lit("; "), F.array_join(what, " and "), F.lit(" linked to "), who, F.lit(" (toxic combination)")))
    bulk = F.when(F.col("_risk.bonus") > 0, F.concat(
        F.lit("; bulk file with "), F.col("_sums.records").cast("string"), F.lit(" sensitive records (+"),
        F.col("_risk.bonus").cast("string"), F.lit(" volume bonus)")))
    return F.concat(F.array_join(F.concat(shown, extra), " + "), F.coalesce(toxic, F.lit("")),
                    F.coalesce(bulk, F.lit("")))


def _any(*kinds: str) -> Column:
    return F.exists("_types", lambda t: t["entity_type"].isin(*kinds))


@built_once
def _scored_types(settings: Settings) -> Column:
    return F.filter(type_totals(F.col("findings")), lambda t: ~t["entity_type"].isin(*settings.unscored))


@built_once
def _sums(settings: Settings) -> Column:
    """Exact weighted sum and number of sensitive records of one document."""
    weight = F.aggregate("_types", F.lit(0).cast(_SUM), lambda a, t: (
        a + lookup(settings.weights, t["entity_type"], 1) * t["sure"]).cast(_SUM))
    records = F.aggregate("_types", F.lit(0), lambda a, t: a + F.when(
        lookup(settings.weights, t["entity_type"], 0) >= settings.sensitive_weight, t["n"]).otherwise(0))
    toxic = _any(*settings.identity_types) & _any(*settings.sensitive_types)
    return F.struct(weight.alias("weight"), records.alias("records"), toxic.alias("toxic"))


@built_once
def _risk(settings: Settings) -> Column:
    """Points, bonus and level of one document from its sums."""
    bonus = volume_bonus(F.col("_sums.records"), settings)
    capped = F.least(F.lit(settings.max_score), F.col("_sums.weight") + bonus)
    exact = F.when(F.col("_sums.toxic"), F.greatest(capped, F.lit(settings.high))).otherwise(capped).cast(_SUM)
    return F.struct(bonus.alias("bonus"), exact.alias("exact"))


@built_once
def _explained(settings: Settings) -> Column:
    return F.when(F.size("_types") == 0, fv.CLEAN_REASON).otherwise(_reason(settings))


def score_documents(docs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Documents with ``findings`` (see ``detect.with_findings``) plus their risk.

    Adds ``risk_score``, ``risk_level``, ``reason``, ``finding_count``, ``toxic``,
    ``entity_types`` and ``sensitive_records``. A document carries its own findings, so scoring
    is a projection and shuffles nothing. The level is taken from the exact score, which is
    rounded afterwards.
    """
    typed = stage(docs, "_types", _scored_types(settings))
    risky = stage(stage(typed, "_sums", _sums(settings)), "_risk", _risk(settings))
    clean = F.size("_types") == 0
    exact = F.col("_risk.exact")
    return risky.select(
        *docs.columns,
        F.size("findings").alias("finding_count"),
        F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["entity_type"]))).alias("entity_types"),
        F.col("_sums.records").alias("sensitive_records"),
        F.col("_sums.toxic").alias("toxic"),
        F.when(clean, 0).otherwise(F.round(exact, 1)).cast("decimal(5,1)").alias("risk_score"),
        F.when(clean, "Clean").otherwise(risk_level(exact, settings)).alias("risk_level"),
        _explained(settings).alias("reason"),
    )
