"""Read-side queries over scored documents and findings.

``docs`` is the frame of ``score.score_documents`` or a stored scan, ``found`` the masked
findings as rows, ``types`` one row per document and type. ``types`` comes out of scored
documents without a shuffle, and counting documents per type on it needs no distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilscan import fixed_values as fv
from veilscan.config import DEFAULT, Settings
from veilscan.functions import masking, text as T
from veilscan.operators.score import friendly, type_totals as totals_of


def type_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, kept columns, entity_type, n, sure, top, first) from documents with ``findings``."""
    return docs.select("doc_id", *keep, F.inline(totals_of(F.col("findings"))))


def type_rows_of(found: DataFrame) -> DataFrame:
    """The same from stored findings."""
    return found.groupBy("doc_id", "entity_type").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("sure"),
        F.max("confidence").alias("top"), F.min("start").alias("first"))


def _mean(total: Column, count: Column) -> Column:
    """Mean of exact decimals, rounded half up to three digits."""
    return F.round(total.cast("decimal(28,6)") / count, 3).cast("decimal(10,3)")


def documents_export(docs: DataFrame, ordered: bool = True) -> DataFrame:
    """Stored documents without the snippet, riskiest first.

    Take ``ordered=False``, here and below, for documents that are not stored: a sort reads its input twice,
    to sample and to sort, and would run the detection behind it twice."""
    kept = [c for c in docs.columns if c not in ("masked_snippet", "sensitive_records", "findings", "digests")]
    rows = docs.select(*kept)
    return rows.orderBy(F.desc("risk_score"), "doc_id") if ordered else rows


def findings_summary(docs: DataFrame, found: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Per document and type: findings, highest and mean confidence.

    Documents that carry their findings need no join; stored findings are joined by id.
    """
    if found is None:
        per = type_rows(docs, "path", "risk_level")
    else:
        per = type_rows_of(found).join(docs.select("doc_id", "path", "risk_level"), "doc_id")
    rows = per.select("doc_id", "path", "risk_level", "entity_type", F.col("n").alias("findings"),
                      F.col("top").alias("max_confidence"), _mean(F.col("sure"), F.col("n")).alias("avg_confidence"))
    return rows.orderBy("doc_id", F.desc("findings"), "entity_type") if ordered else rows


def unique_identifiers(docs: DataFrame) -> DataFrame:
    """Distinct identifiers per group, from the ``digests`` of documents.

    Distinct runs on (group, digest) after a partial one per task, so a group that holds most
    identifiers is spread over all tasks.
    """
    return docs.select(F.inline("digests")).groupBy("id_group").agg(
        F.count_distinct("digest").alias("unique_values"))


#: Logarithm of a sketch's registers; the standard error of its estimate is about 0.8 / sqrt(2 ** SKETCH).
SKETCH = 14


def unique_sketches(docs: DataFrame) -> DataFrame:
    """id_group, sketch: distinct identifiers of a scan as sketches of fixed size, to be merged with those of other scans."""
    return docs.select(F.inline("digests")).groupBy("id_group").agg(F.hll_sketch_agg("digest", F.lit(SKETCH)).alias("sketch"))


def unique_of_sketches(sketches: DataFrame) -> DataFrame:
    """Distinct identifiers per group over any number of scans, about. Scans compare only if they were run with one key."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy("id_group").agg(merged.alias("unique_values"))


def unique_summary(unique: DataFrame) -> DataFrame:
    """One row: all identifiers, and the largest group as a lower bound for people."""
    return unique.agg(
        F.coalesce(F.sum("unique_values"), F.lit(0)).alias("unique_identifiers_total"),
        F.coalesce(F.max("unique_values"), F.lit(0)).alias("unique_individuals_estimate"))


def entity_counts(types: DataFrame, unique: DataFrame | None = None) -> DataFrame:
    """Per type: findings, documents, mean confidence and, given ``unique``, distinct values.

    ``unique`` has one row per identifier group, so its broadcast is bounded by the number of
    types whatever the corpus.
    """
    per = types.groupBy("entity_type").agg(
        F.sum("n").alias("findings"), F.count("*").alias("documents"),
        _mean(F.sum("sure"), F.sum("n")).alias("avg_confidence"))
    if unique is not None:
        per = (per.withColumn("id_group", masking.identifier_group(F.col("entity_type")))
               .join(F.broadcast(unique), "id_group", "left").drop("id_group"))
    return per.orderBy(F.desc("findings"), "entity_type")


def level_counts(docs: DataFrame) -> DataFrame:
    """Documents per level, riskiest first, with zero for a level nobody has."""
    per = [F.struct(F.lit(n).alias("risk_level"), F.count_if(F.col("risk_level") == n).alias("documents")) for n in fv.LEVELS]
    return docs.agg(F.array(*per).alias("levels")).select(F.inline("levels"))


def tally(docs: DataFrame) -> DataFrame:
    """(kind, key, documents, findings, sure, unique_values, toxic) of scored documents with digests, in one pass over them.

    Kinds: a risk level, a file type's High documents, an entity type, an identifier group. Each document gives its rows, which are
    counted per digest and then per key, both times with partial counts, so no key is one task's work.
    There are as many rows as levels, file types, entity types and groups; what a report needs is picked from them."""
    nothing, none = F.lit(0).cast("bigint"), F.lit(None).cast("string")

    def row(kind: str, key: Column, digest: Column = none, n: Column = nothing, sure: Column = nothing, toxic: Column = F.lit(False)) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), digest.alias("digest"), n.cast("bigint").alias("n"),
                        sure.cast("decimal(28,3)").alias("sure"), toxic.alias("toxic"))

    high = F.when(F.col("risk_level") == "High", F.array(row("high file type", F.col("file_type"))))
    rows = F.concat(
        F.array(row("level", F.col("risk_level"), toxic=F.col("toxic"))), F.coalesce(high, F.array()),
        F.transform(totals_of(F.col("findings")), lambda t: row("type", t["entity_type"], n=t["n"], sure=t["sure"])),
        F.transform("digests", lambda d: row("identifier", d["id_group"], d["digest"])))
    per_digest = docs.select(F.inline(rows)).groupBy("kind", "key", "digest").agg(
        F.count("*").alias("documents"), F.sum("n").alias("findings"), F.sum("sure").alias("sure"), F.count_if("toxic").alias("toxic"))
    return per_digest.groupBy("kind", "key").agg(
        F.sum("documents").alias("documents"), F.sum("findings").alias("findings"), F.sum("sure").alias("sure"),
        F.count("digest").alias("unique_values"), F.sum("toxic").alias("toxic"))


def totals_of_tally(counted: DataFrame) -> DataFrame:
    """One row from a tally: the columns of ``level_totals`` and ``unique_summary``, the types by documents, and the main High file type."""

    def documents(*found: str) -> Column:
        return F.coalesce(F.sum(F.when((F.col("kind") == "level") & F.col("key").isin(*found), F.col("documents"))), F.lit(0).cast("bigint"))

    ids = F.when(F.col("kind") == "identifier", F.col("unique_values"))
    ranked = F.struct((-F.col("documents")).alias("k"), F.col("key").alias("entity_type"))
    main = F.min(F.when(F.col("kind") == "high file type", F.struct((-F.col("documents")).alias("k"), F.col("key").alias("file_type"))))
    return counted.agg(
        documents(*fv.LEVELS).alias("docs_scanned"),
        *[documents(n).alias(f"docs_{n.lower()}") for n in fv.LEVELS],
        documents(*[n for n in fv.LEVELS if n != "Clean"]).alias("docs_with_pii"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("docs_toxic"),
        F.coalesce(F.sum(ids), F.lit(0)).alias("unique_identifiers_total"),
        F.coalesce(F.max(ids), F.lit(0)).alias("unique_individuals_estimate"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "type", ranked))).alias("types"),
        main["file_type"].alias("main_type"), (-main["k"]).alias("main_docs"))


def entity_counts_of(counted: DataFrame) -> DataFrame:
    """``entity_counts`` with ``unique_values``, from a tally: its few rows are put into one."""
    of = lambda kind, *names: F.collect_list(F.when(F.col("kind") == kind, F.struct("key", *names)))
    one = counted.agg(of("type", "findings", "documents", "sure").alias("types"), of("identifier", "unique_values").alias("ids"))
    per = one.select("ids", F.inline("types"))
    own = F.filter("ids", lambda i: i["key"] == masking.identifier_group(F.col("key")))
    return per.select(F.col("key").alias("entity_type"), "findings", "documents", _mean(F.col("sure"), F.col("findings")).alias("avg_confidence"),
                      F.get(own, 0)["unique_values"].alias("unique_values")).orderBy(F.desc("findings"), "entity_type")


def level_totals(docs: DataFrame) -> DataFrame:
    """One row with the documents per level, in one pass."""
    def at(level: str) -> Column:
        return F.count_if(F.col("risk_level") == level)

    return docs.agg(
        F.count("*").alias("docs_scanned"),
        at("High").alias("docs_high"), at("Medium").alias("docs_medium"),
        at("Low").alias("docs_low"), at("Clean").alias("docs_clean"),
        F.count_if(F.col("risk_level") != "Clean").alias("docs_with_pii"),
        F.count_if("toxic").alias("docs_toxic"))


def scored_only(types: DataFrame, include_noisy: bool = False, settings: Settings = DEFAULT) -> DataFrame:
    """Rows without the types that are stored but not scored, unless asked for."""
    return types if include_noisy else types.where(~F.col("entity_type").isin(*settings.unscored))


def type_totals(types: DataFrame) -> DataFrame:
    """Findings and documents per type, with a readable label."""
    name = friendly(F.col("entity_type"), F.lit(2))
    label = F.concat(F.upper(F.left(name, F.lit(1))), F.substr(name, F.lit(2)))
    return (types.groupBy("entity_type").agg(F.sum("n").alias("findings"), F.count("*").alias("documents"))
            .withColumn("label", label).orderBy("findings", "entity_type"))


def filetype_levels(docs: DataFrame) -> DataFrame:
    return docs.groupBy("file_type", "risk_level").agg(F.count("*").alias("documents"))


def widest_types(types: DataFrame, n: int = 3, settings: Settings = DEFAULT) -> DataFrame:
    """The types found in most documents."""
    return (scored_only(types, settings=settings).groupBy("entity_type").agg(F.count("*").alias("documents"))
            .orderBy(F.desc("documents"), "entity_type").limit(n))


def dominant_high_filetype(docs: DataFrame) -> DataFrame:
    """The file type most high-risk documents have, and how many they are."""
    per = docs.where(F.col("risk_level") == "High").groupBy("file_type").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), "file_type"))
    return per.agg(best.alias("b"), F.sum("n").alias("docs_high")).where(F.col("b").isNotNull()).select(
        F.col("b.file_type").alias("file_type"), (-F.col("b.neg")).alias("documents"), "docs_high")


def top_senders(docs: DataFrame, n: int = 10) -> DataFrame:
    """The senders of most High and Medium documents, with a count per level.

    One pass: both levels are counted per sender before the shuffle, so a busy sender is one
    partial count per task, and only the ``n`` winners are turned into rows per level.
    """
    ranked = (docs.where(F.col("risk_level").isin("High", "Medium") & (F.coalesce("sender", F.lit("")) != ""))
              .groupBy("sender").agg(F.count("*").alias("total"),
                                     F.count_if(F.col("risk_level") == "High").alias("High"),
                                     F.count_if(F.col("risk_level") == "Medium").alias("Medium"))
              .orderBy(F.desc("total"), "sender").limit(n))
    levels = F.array(*[F.struct(F.lit(x).alias("risk_level"), F.col(x).alias("documents")) for x in ("High", "Medium")])
    return (ranked.select("sender", "total", F.inline(levels)).where(F.col("documents") > 0)
            .orderBy(F.desc("total"), "sender", "risk_level").select("sender", "risk_level", "documents"))


def explorer(docs: DataFrame, levels: tuple[str, ...] = (), entities: tuple[str, ...] = (),
             file_types: tuple[str, ...] = (), sender: str | None = None, query: str = "",
             ordered: bool = True) -> DataFrame:
    """Documents that meet every given choice, riskiest first; an empty choice filters nothing."""
    view = docs
    if levels:
        view = view.where(F.col("risk_level").isin(*levels))
    if entities:
        view = view.where(F.arrays_overlap("entity_types", F.array(*[F.lit(e) for e in entities])))
    if file_types:
        view = view.where(F.col("file_type").isin(*file_types))
    if sender:
        view = view.where(F.col("sender") == sender)
    if query:
        needle = F.lit(query.lower())
        fields = (T.file_name(F.col("path")), F.col("subject"), F.col("reason"))
        hit = F.lit(False)
        for field in fields:
            hit = hit | F.contains(F.lower(F.coalesce(field, F.lit(""))), needle)
        view = view.where(hit)
    rows = view.select("doc_id", "risk_level", "risk_score", T.file_name(F.col("path")).alias("file_name"),
                       "file_type", "sender", F.date_format("date", "yyyy-MM-dd").alias("date"),
                       "finding_count", "reason")
    return rows.orderBy(F.desc("risk_score"), "doc_id") if ordered else rows


def filter_choices(docs: DataFrame) -> DataFrame:
    """Distinct values a reader can filter by: (field, value), in one pass over the documents."""
    values = F.flatten(F.array(
        F.transform("entity_types", lambda t: F.struct(F.lit("entity_type").alias("field"), t.alias("value"))),
        F.array(F.struct(F.lit("file_type").alias("field"), F.col("file_type").alias("value"))),
        F.array(F.struct(F.lit("sender").alias("field"), F.col("sender").alias("value")))))
    return (docs.select(F.inline(values)).where(F.coalesce("value", F.lit("")) != "")
            .distinct().orderBy("field", "value"))


def document_summary(found: DataFrame, doc_id) -> DataFrame:
    """Findings of one document by type."""
    return (found.where(F.col("doc_id") == F.lit(doc_id)).groupBy("entity_type")
            .agg(F.count("*").alias("count"), _mean(F.sum("confidence"), F.count("*")).alias("avg_confidence"))
            .orderBy(F.desc("count"), "entity_type"))


def document_findings(found: DataFrame, doc_id, n: int | None = None) -> DataFrame:
    """The findings of one document in order, or the first ``n`` of them for a preview table."""
    rows = found.where(F.col("doc_id") == F.lit(doc_id)).orderBy("start")
    return (rows if n is None else rows.limit(n)).select("entity_type", "masked_value", "confidence")


def timeline(docs: DataFrame, date_col: str = "date") -> DataFrame:
    """Documents with personal data per period and level, without holes.

    Periods are months, or quarters when the dates span more than 18 months of 30.4 days. The
    documents are read once: their counts per month and level become one row, as long as the
    corpus has months, and that row grows the grid.
    """
    dated = docs.where((F.col("risk_level") != "Clean") & F.col(date_col).isNotNull())
    counted = dated.groupBy(F.date_trunc("month", date_col).alias("month"), "risk_level").agg(
        F.count("*").alias("n"), F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))
    whole_days = F.floor((F.unix_timestamp("hi") - F.unix_timestamp("lo")) / 86400)
    one = counted.agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_set("risk_level").alias("present"),
        F.collect_list(F.struct("month", "risk_level", "n")).alias("counts"),
    ).where(F.col("lo").isNotNull()).withColumn("grain", F.when(whole_days / 30.4 > 18, "quarter").otherwise("month"))

    def start_of(value: Column) -> Column:
        return F.when(F.col("grain") == "quarter", F.date_trunc("quarter", value)).otherwise(F.date_trunc("month", value))

    step = F.when(F.col("grain") == "quarter", F.expr("interval 3 months")).otherwise(F.expr("interval 1 month"))
    grid = one.select("grain", "present", "counts", F.explode(
        F.sequence(start_of(F.col("lo")), start_of(F.col("hi")), step)).alias("period"))
    cell = grid.select("grain", "period", "counts", F.explode("present").alias("risk_level"))
    own = F.filter("counts", lambda c: (c["risk_level"] == F.col("risk_level")) & (start_of(c["month"]) == F.col("period")))
    total = F.aggregate(own, F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
    return cell.select("grain", "period", "risk_level", total.alias("documents")).orderBy("period", "risk_level")


def top_documents(docs: DataFrame, n: int) -> DataFrame:
    """The riskiest documents, one row each."""
    return docs.orderBy(F.desc("risk_score"), "doc_id").limit(n)


def ranked_documents(docs: DataFrame, n: int = 10) -> DataFrame:
    """The riskiest documents that are not Clean, numbered from 1.

    The limit runs first, so the single-partition window sees ``n`` rows.
    """
    best = top_documents(docs.where(F.col("risk_level") != "Clean"), n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("risk_score"), "doc_id")))


def special_counts(docs: DataFrame) -> DataFrame:
    """Documents with health data and with financial data, and their share."""
    money = F.array(*[F.lit(t) for t in fv.ACCOUNT_TYPES + ("SALARY",)])
    one = docs.agg(
        F.count("*").alias("documents"),
        F.count_if(F.array_contains("entity_types", "HEALTH_INFO")).alias("health_documents"),
        F.count_if(F.arrays_overlap("entity_types", money)).alias("financial_documents"))
    return one.withColumns({
        "health_share": T.percent(F.col("health_documents"), F.col("documents")),
        "financial_share": T.percent(F.col("financial_documents"), F.col("documents"))})


def weights_listing(spark, settings: Settings = DEFAULT) -> DataFrame:
    """The weight of every type, heaviest first."""
    rows = [(k, w, k not in settings.unscored) for k, w in settings.weights.items()]
    table = spark.createDataFrame(rows, "entity_type string, weight int, is_scored boolean")
    name = friendly(F.col("entity_type"), F.lit(1))
    return table.select(
        "entity_type", F.concat(F.upper(F.left(name, F.lit(1))), F.substr(name, F.lit(2))).alias("meaning"),
        "weight", F.when(F.col("is_scored"), "Yes").otherwise("No (stored only)").alias("scored"),
    ).orderBy(F.desc("weight"), "entity_type")
