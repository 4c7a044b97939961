"""Regulatory mapping, penalty ceilings, exposure index and the summary rows built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from veilscan import fixed_values as fv
from veilscan.config import DEFAULT, Settings
from veilscan.functions import text as T
from veilscan.operators.score import friendly
from veilscan.plans import reports as RP


def regulation(entity: Column) -> Column:
    """The regulatory map's entry of a type, (dpdp, higher, gdpr, money), as a literal: no rows are made for it."""
    def entry(values: tuple) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(("dpdp", "higher", "gdpr", "money"), values, strict=True)])

    known = F.create_map(*[x for k, v in fv.REGULATION.items() for x in (F.lit(k), entry(v))])
    return F.coalesce(F.try_element_at(known, entity), entry(fv.REGULATION_DEFAULT))


def compliance_table(types: DataFrame) -> DataFrame:
    """Types found, with their categories and counts."""
    per = types.groupBy("entity_type").agg(F.sum("n").alias("findings"), F.count("*").alias("documents"))

    def yes(flag: Column) -> Column:
        return F.when(flag, "Yes").otherwise("No")

    return per.withColumn("r", regulation(F.col("entity_type"))).select(
        "entity_type", F.col("r.dpdp").alias("dpdp_category"), yes(F.col("r.higher")).alias("dpdp_higher_risk"),
        F.col("r.gdpr").alias("gdpr_category"),
        yes(F.startswith(F.col("r.gdpr"), F.lit("Special"))).alias("gdpr_special_category"),
        yes(F.col("r.money")).alias("financial"),
        "findings", "documents",
    ).orderBy(F.desc("findings"), "entity_type")


def other_penalties(spark) -> DataFrame:
    return spark.createDataFrame(list(fv.OTHER_PENALTIES_CRORE), "breach string, crore int").withColumn(
        "maximum_penalty", F.concat(F.lit("₹"), F.col("crore").cast("string"), F.lit(" crore")))


def gdpr_ceiling(turnover_eur: Column, settings: Settings = DEFAULT) -> Column:
    """The higher of the fixed cap and a share of worldwide annual turnover, in euros."""
    return F.greatest(F.lit(float(settings.gdpr_fixed_cap_eur)),
                      turnover_eur.cast("double") * settings.gdpr_turnover_pct / 100.0)


def dpdp_ceiling(settings: Settings = DEFAULT) -> Column:
    """Ceiling for missing security safeguards, in rupees."""
    return F.lit(settings.dpdp_cap_crore * 1e7)


def inr_to_eur(amount: Column, settings: Settings = DEFAULT) -> Column:
    return amount / F.lit(float(settings.eur_to_inr))


def exposure(people: Column, high: Column, medium: Column, with_pii: Column,
             settings: Settings = DEFAULT) -> dict[str, Column]:
    """Index of how many people and how severe: columns index, band and the two components."""
    share = F.log10(F.greatest(people, F.lit(0)) + 1) / F.log10(F.lit(settings.exposure_people + 1.0))
    scale = settings.exposure_scale * F.least(F.lit(1.0), share)
    severity = F.coalesce(
        settings.exposure_severity * F.try_divide(high + medium * F.lit(0.5), with_pii), F.lit(0.0))
    index = F.round(scale + severity, 1)
    band = reduce(lambda c, b: c.when(index >= b[0], b[1]), fv.EXPOSURE_BANDS[1:],
                  F.when(index >= fv.EXPOSURE_BANDS[0][0], fv.EXPOSURE_BANDS[0][1])).otherwise("Low")
    return {"exposure_index": index, "exposure_band": band,
            "scale_component": F.round(scale, 1), "severity_component": F.round(severity, 1)}


def beside(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    keyed = [f.withColumn("_one", F.lit(1)) for f in frames]
    return reduce(lambda a, b: a.join(F.broadcast(b), "_one"), keyed).drop("_one")


def kpi_row(docs: DataFrame, unique: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The headline figures of a scan in one row.

    ``unique`` is ``reports.unique_identifiers``. Both inputs are reduced to one row first.
    """
    return _kpi(beside(RP.level_totals(docs), RP.unique_summary(unique)), settings)


def kpi_of(counted: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The same from ``reports.tally``, with one pass over the documents."""
    return _kpi(RP.totals_of_tally(counted), settings)


def _kpi(base: DataFrame, settings: Settings) -> DataFrame:
    people = F.col("unique_individuals_estimate")
    row = base.withColumns(exposure(people, F.col("docs_high"), F.col("docs_medium"), F.col("docs_with_pii"), settings))
    turnover = F.lit(settings.turnover_eur)
    return row.withColumns({
        "pii_share": T.percent(F.col("docs_with_pii"), F.col("docs_scanned")),
        "high_share": T.percent(F.col("docs_high"), F.col("docs_scanned")),
        "dpdp_ceiling": T.format_inr(dpdp_ceiling(settings)),
        "dpdp_ceiling_eur": T.format_eur(inr_to_eur(dpdp_ceiling(settings), settings)),
        "gdpr_ceiling": T.format_eur(gdpr_ceiling(turnover, settings)),
        "turnover": T.format_eur(turnover),
    })


def _count(value: Column) -> Column:
    return F.format_number(value, 0)


def narrative(docs: DataFrame, types: DataFrame, unique: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The summary for leadership as one row with one ``summary`` text.

    Four aggregates read ``docs`` and ``types``; hand in a stored or settled scan.
    """
    widest = RP.widest_types(types, 3, settings)
    entry = F.struct((-F.col("documents")).alias("k"), "entity_type", F.concat(
        friendly(F.col("entity_type"), F.lit(2)), F.lit(" ("), F.col("documents").cast("string"),
        F.lit(" files)")).alias("label"))
    top = widest.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["label"]).alias("top"))
    main = RP.dominant_high_filetype(docs).agg(F.first("file_type").alias("main_type"),
                                               F.first("documents").alias("main_docs"))
    return _sentences(beside(RP.level_totals(docs), RP.unique_summary(unique), top, main))


def narrative_of(counted: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The same from ``reports.tally``, with one pass over the documents."""
    wanted = F.filter("types", lambda t: ~t["entity_type"].isin(*settings.unscored))
    top = F.transform(F.slice(wanted, 1, 3), lambda t: F.concat(
        friendly(t["entity_type"], F.lit(2)), F.lit(" ("), (-t["k"]).cast("string"), F.lit(" files)")))
    return _sentences(RP.totals_of_tally(counted).withColumn("top", top))


def _sentences(row: DataFrame) -> DataFrame:
    # fixed values: the sentences
    n = F.col("docs_scanned")

    def with_share(column: str) -> Column:
        return F.concat(_count(F.col(column)), F.lit(" ("), T.percent(F.col(column), n), F.lit(")"))

    first = F.concat(
        F.lit("Of "), _count(n), F.lit(" documents scanned, "), with_share("docs_high"),
        F.lit(" contain high-risk personal data and a further "), with_share("docs_medium"),
        F.lit(" are medium risk; "), with_share("docs_with_pii"), F.lit(" contain some personal data."))
    size = F.size("top")
    listed = F.when(size > 1, F.concat(F.array_join(F.slice("top", F.lit(1), F.greatest(size - 1, F.lit(1))), ", "),
                                       F.lit(" and "), F.element_at("top", -1))).otherwise(F.get("top", 0))
    second = F.when(size > 0, F.concat(F.lit("The most widespread types are "), listed, F.lit(".")))
    third = F.when(F.col("docs_toxic") > 0, F.concat(
        _count(F.col("docs_toxic")),
        F.lit(" files link a person to health, salary or financial details - the combination that does the most "
              "harm if leaked - and together the scan found identifiers for at least "),
        _count(F.col("unique_individuals_estimate")), F.lit(" distinct people.")))
    fourth = F.when(F.col("docs_high") > 0, F.concat(
        F.lit("High-risk data is concentrated in "), F.upper("main_type"), F.lit(" files ("),
        F.col("main_docs").cast("string"), F.lit(" of "), F.col("docs_high").cast("string"),
        F.lit("), so restricting access to those and masking identifiers is the fastest way to cut exposure.")))
    text = F.when(n == 0, F.lit("The selected scan contains no documents.")).otherwise(
        F.concat_ws(" ", first, second, third, fourth))
    return row.select(text.alias("summary"))
