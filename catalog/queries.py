"""One query per operator, over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalog import texts as X
from veilscan.config import DEFAULT, Settings
from veilscan.functions import checks, masking, text as T
from veilscan.operators import chunks, detect as D, islands, score as SC, spans as SP
from veilscan.plans import compliance as CP, evaluate as EV, remediation as RM, reports as RP, scan as SN
from veilscan.session import shared_dir, spread_small
from veilscan.sources import files, store, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(*entities: str) -> Settings:
    return DEFAULT.with_(entities=entities)


def big(column: str) -> Column:
    return F.col(column).cast("bigint")


def dbl(column: str) -> Column:
    return F.col(column).cast("double")


# --- frames most queries start from ------------------------------------------------------
def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` with masked findings, all rules."""
    docs = spread_small(table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("lang").alias("file_type"), F.col("source").alias("sender")))
    return D.with_findings(docs)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.explode_findings(detected(spark, sf_dir))


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RP.type_rows(detected(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored documents with the report columns. Scoring shuffles nothing."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    risk = SC.score_documents(detected(spark, sf_dir).drop("text"))
    return risk.withColumns({
        "path": F.concat_ws("/", F.lit("corpus"), "sender", "file_type", name),
        "subject": F.concat(F.col("file_type"), F.lit(" document "), F.col("doc_id").cast("string")),
    })


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored documents with a date from `orders`: one join on unique keys, without text."""
    dates = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("timestamp").alias("date"))
    return scored(spark, sf_dir).drop("findings").join(dates, "doc_id", "left")


def tallied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that the summary reports are made of, in one pass over the documents."""
    docs = spread_small(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("file_type")))
    raw = D.with_raw_findings(docs)
    keyed = D.with_digests(SP.stage(raw, "findings", D.masked(F.col("found"))))
    return RP.tally(SC.score_documents(keyed.drop("text", "found")))


def spans_of(docs: DataFrame, *entities: str) -> DataFrame:
    """Resolved findings of some types, in the columns the checks compare."""
    raw = D.raw_findings(spread_small(docs), only(*entities))
    return raw.select("doc_id", "entity_type", big("start").alias("start_at"), big("end").alias("end_at"),
                      dbl("score").alias("confidence"), "value")


def projected(spark: SparkSession, sf_dir: str, name: str, key: str, text: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.expr(key).alias("doc_id"), F.expr(text).alias("text"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the one that all executors share."""
    return f"{shared_dir(spark)}/catalog/{name}-{uuid.uuid4().hex}"


# --- detection ---------------------------------------------------------------------------
@query
def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "EMAIL_ADDRESS")


@query
def ip_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "IP_ADDRESS")


@query
def us_phone_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "PHONE_NUMBER")


@query
def card_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "CREDIT_CARD")


@query
def ipv6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(projected(spark, sf_dir, "customer", "c_custkey", X.CUSTOMER_IPV6), "IP_ADDRESS")


@query
def intl_phone_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(projected(spark, sf_dir, "customer", "c_custkey", X.CUSTOMER_DIALS), "PHONE_NUMBER")


@query
def card_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(projected(spark, sf_dir, "customer", "c_custkey", X.CUSTOMER_CARDS), "CREDIT_CARD")


@query
def sure_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_small(table(spark, sf_dir, "documents").select("doc_id", "text"))
    raw = D.raw_findings(docs, DEFAULT.with_(min_score=0.6))
    return raw.select("doc_id", "entity_type", big("start").alias("start_at"), dbl("score").alias("confidence"), "value")


@query
def blank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    text = F.when(key % 3 == 0, F.lit(None)).when(key % 3 == 1, "").otherwise(" \n\t ")
    docs = table(spark, sf_dir, "customer").select(key.alias("doc_id"), text.alias("text"))
    return SC.score_documents(D.with_findings(docs)).select(
        "doc_id", "risk_level", dbl("risk_score").alias("risk_score"), big("finding_count").alias("finding_count"), "reason")


def _aadhaar_keys(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """The distinct keys, and the body that follows from them."""
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *more).distinct()
    return keys.withColumn("body", F.expr(X.aadhaar_body("l_orderkey * 10 + l_linenumber")))


@query
def aadhaar_verhoeff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _aadhaar_keys(spark, sf_dir, (F.col("l_partkey") % 10).alias("given"))
    given = F.concat("body", F.col("given").cast("string"))
    return rows.select("l_orderkey", "l_linenumber", "body", checks.verhoeff_check_digit(F.col("body")).alias("check_digit"),
                       checks.verhoeff_valid(given).alias("given_is_valid"), big("given").alias("given"))


@query
def aadhaar_label_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    spaced = F.concat_ws(" ", F.substring(n, 1, 4), F.substring(n, 5, 4), F.substring(n, 9, 4))
    kind = F.col("l_linenumber") % 5
    text = (F.when(kind == 0, F.concat(F.lit("Aadhaar: "), n)).when(kind == 1, F.concat(F.lit("Account No: "), n))
            .when(kind == 2, F.concat(F.lit("Account No: 77 | Aadhaar: "), n))
            .when(kind == 3, F.concat(F.lit("Aadhaar "), spaced))
            .otherwise(F.concat(F.lit("Parcel "), n, F.lit(" left"))))
    docs = (_aadhaar_keys(spark, sf_dir)
            .withColumn("check", checks.verhoeff_check_digit(F.col("body")).cast("int"))
            # every third number carries a wrong check digit
            .withColumn("n", F.concat("body", F.when(F.col("l_orderkey") % 3 == 0, (F.col("check") + 1) % 10)
                                      .otherwise(F.col("check")).cast("string")))
            .select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), text.alias("text")))
    return spans_of(docs, "IN_AADHAAR").drop("entity_type", "end_at")


@query
def pan_ifsc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = projected(spark, sf_dir, "customer", "c_custkey", X.CUSTOMER_CODES)
    return spans_of(docs, "IN_PAN", "IN_IFSC").drop("end_at")


@query
def upi_vs_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = projected(spark, sf_dir, "supplier", "s_suppkey", X.SUPPLIER_MAIL)
    return spans_of(docs, "IN_UPI", "EMAIL_ADDRESS").drop("end_at")


@query
def in_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = projected(spark, sf_dir, "customer", "c_custkey", X.CUSTOMER_PHONE)
    return spans_of(docs, "IN_PHONE").drop("entity_type", "end_at")


@query
def bank_account_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = projected(spark, sf_dir, "orders", "o_orderkey", X.ORDER_ACCOUNT)
    return spans_of(docs, "BANK_ACCOUNT").drop("entity_type", "end_at")


@query
def salary_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = projected(spark, sf_dir, "orders", "o_orderkey", X.ORDER_SALARY)
    return spans_of(docs, "SALARY").drop("entity_type", "end_at")


@query
def health_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = projected(spark, sf_dir, "conversations", "conv_id * 100000 + turn", X.TURN_HEALTH)
    return spans_of(docs, "HEALTH_INFO").drop("entity_type", "end_at")


@query
def name_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = projected(spark, sf_dir, "customer", "c_custkey", X.CUSTOMER_NAMES)
    return spans_of(docs, "PERSON").drop("entity_type", "end_at")


@query
def iban_ssn(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    bban = F.lpad((key * 104729).cast("string"), 18, "3")
    check = F.lpad((98 - F.concat(bban, F.lit("131400")).cast("decimal(38,0)") % 97).cast("int").cast("string"), 2, "0")
    wrong = F.lpad(((check.cast("int") + 1) % 97).cast("string"), 2, "0")
    ssn = F.concat(F.lpad((100 + key % 900).cast("string"), 3, "0"), F.lit("-12-"),
                   F.lpad((1 + key % 9000).cast("string"), 4, "0"))
    text = F.concat(F.lit("IBAN DE"), F.when(key % 3 == 0, wrong).otherwise(check), bban, F.lit(" SSN "), ssn)
    docs = table(spark, sf_dir, "supplier").select(key.alias("doc_id"), text.alias("text"))
    return spans_of(docs, "IBAN_CODE", "US_SSN").drop("end_at")


@query
def date_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    shown = (F.when(key % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 3 == 1, F.lit("some day"))
             .otherwise(F.date_format(day, "dd/MM/yyyy")))
    text = F.concat(F.lit("Order "), key.cast("string"), F.lit(" placed on "), shown, F.lit(" by clerk"))
    docs = table(spark, sf_dir, "orders").select(key.alias("doc_id"), text.alias("text"))
    return spans_of(docs, "DATE_TIME").drop("entity_type", "end_at")


@query
def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    body = F.expr(X.aadhaar_body("o_orderkey"))
    number = F.concat(body, checks.verhoeff_check_digit(body))
    text = (F.when(key % 5 == 0, F.concat(F.lit("Account No: "), number))
            .when(key % 5 == 1, F.lit("Bank account 4532017488265037"))
            .when(key % 5 == 2, F.lit("Card 4532017488265037 charged, bank account follows"))
            .when(key % 5 == 3, F.lit("Mobile: +91 81234 09876"))
            .otherwise(F.lit("Account 6543219870, salary is ₹91,250")))
    docs = table(spark, sf_dir, "orders").select(key.alias("doc_id"), text.alias("text"))
    return spans_of(docs, *DEFAULT.entities)


# --- masking -----------------------------------------------------------------------------
@query
def mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("doc_id", "entity_type", big("start").alias("start_at"), "masked_value",
                                       dbl("confidence").alias("confidence"))


@query
def masked_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = DEFAULT.snippet_chars
    return detected(spark, sf_dir).select("doc_id", masking.masked_snippet(
        F.left("text", F.lit(chars)), F.length("text"), F.col("findings"), chars).alias("masked_snippet"))


@query
def redact_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return RM.redact_top(scored(spark, sf_dir), texts)


@query
def unique_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_small(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return RP.unique_identifiers(D.with_digests(D.with_raw_findings(docs)))


# --- scoring -----------------------------------------------------------------------------
@query
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(
        "doc_id", dbl("risk_score").alias("risk_score"), "risk_level", "toxic",
        big("finding_count").alias("finding_count"), F.array_join("entity_types", ";").alias("entity_types"))


@query
def risk_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", "reason")


@query
def volume_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_doc = D.collect_findings(line_findings(spark, sf_dir))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    empty = F.array().cast(per_doc.schema["findings"].dataType)
    both = docs.join(per_doc, "doc_id", "left").withColumn("findings", F.coalesce("findings", empty))
    return SC.score_documents(both).select("doc_id", dbl("risk_score").alias("risk_score"), "risk_level", "toxic",
                                           F.array_join("entity_types", ";").alias("entity_types"))


def line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored findings made of `lineitem`, an order being a document."""
    line = F.col("l_linenumber")
    kind = (F.when(line == 1, "IN_AADHAAR").when(line == 2, "SALARY").when(line == 3, "PERSON")
            .when(line == 4, "HEALTH_INFO").when(line == 5, "DATE_TIME").when(line == 6, "CUSTOM_TYPE").otherwise("IN_PAN"))
    start = (F.col("l_partkey") * 1000 + F.col("l_suppkey")).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), kind.alias("entity_type"), start.alias("start"), (start + 1).alias("end"),
        F.lit("X").alias("masked_value"), ((500 + F.col("l_partkey") % 500) / 1000).cast("decimal(4,3)").alias("confidence"))


@query
def findings_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("path"), F.col("o_orderstatus").alias("risk_level"))
    return RP.findings_summary(docs, line_findings(spark, sf_dir), ordered=False).select(
        "doc_id", "path", "risk_level", "entity_type", "findings", dbl("max_confidence").alias("max_confidence"),
        dbl("avg_confidence").alias("avg_confidence"))


@query
def noisy_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = RP.type_rows_of(line_findings(spark, sf_dir))
    both = [RP.type_totals(RP.scored_only(types, include)).withColumn("noisy", F.lit(include)) for include in (False, True)]
    return both[0].unionByName(both[1])


# --- reports -----------------------------------------------------------------------------
@query
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RP.level_counts(scored(spark, sf_dir))


@query
def documents_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RP.documents_export(dated(spark, sf_dir), ordered=False).select(
        "doc_id", "path", "file_type", "sender", F.date_format("date", "yyyy-MM-dd").alias("date"),
        dbl("risk_score").alias("risk_score"), "risk_level", "reason", big("finding_count").alias("finding_count"),
        "toxic", F.array_join("entity_types", ";").alias("entity_types"))


@query
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RP.findings_summary(scored(spark, sf_dir), ordered=False).select(
        "doc_id", "path", "risk_level", "entity_type", big("findings").alias("findings"), dbl("max_confidence").alias("max_confidence"),
        dbl("avg_confidence").alias("avg_confidence"))


@query
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RP.entity_counts_of(tallied(spark, sf_dir)).withColumn(
        "avg_confidence", dbl("avg_confidence"))


@query
def type_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RP.type_totals(RP.scored_only(types(spark, sf_dir)))


@query
def widest_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RP.widest_types(types(spark, sf_dir))


@query
def filetype_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RP.filetype_levels(scored(spark, sf_dir))


@query
def dominant_filetype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RP.dominant_high_filetype(scored(spark, sf_dir))


@query
def top_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RP.top_senders(scored(spark, sf_dir))


@query
def explorer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = RP.explorer(dated(spark, sf_dir), levels=("High", "Medium", "Low"),
                       entities=("EMAIL_ADDRESS", "IP_ADDRESS"), file_types=("en", "fr"), query="ADDRESS", ordered=False)
    return view.select("doc_id", "risk_level", dbl("risk_score").alias("risk_score"), "file_name", "sender", "reason")


@query
def filter_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RP.filter_choices(scored(spark, sf_dir))


@query
def special_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RP.special_counts(scored(spark, sf_dir))


@query
def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RP.ranked_documents(scored(spark, sf_dir)).select(
        big("rank").alias("rank"), "doc_id", dbl("risk_score").alias("risk_score"), "risk_level")


@query
def timeline_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    level = F.when(kind == "error", "High").when(kind == "purchase", "Medium").when(kind == "signup", "Low").otherwise("Clean")
    docs = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("date"), level.alias("risk_level"))
    return RP.timeline(docs).withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query
def timeline_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    level = F.when(status == "F", "High").when(status == "O", "Low").otherwise("Clean")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("date"), level.alias("risk_level"))
    return RP.timeline(docs).withColumn("period", F.date_format("period", "yyyy-MM-dd"))


# --- compliance and remediation ----------------------------------------------------------
@query
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CP.kpi_of(tallied(spark, sf_dir)).select(
        "exposure_index", "exposure_band", "scale_component", "unique_individuals_estimate")


@query
def kpi_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CP.kpi_of(tallied(spark, sf_dir)).select(
        "docs_scanned", "docs_high", "docs_medium", "docs_low", "docs_clean", "docs_with_pii", "docs_toxic",
        "unique_identifiers_total", "pii_share", "high_share", "dpdp_ceiling", "dpdp_ceiling_eur", "gdpr_ceiling", "turnover")


@query
def compliance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CP.compliance_table(types(spark, sf_dir))


@query
def narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CP.narrative_of(tallied(spark, sf_dir))


@query
def ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", CP.gdpr_ceiling(F.col("c_custkey") * 1_000_000).alias("gdpr_ceiling_eur"),
        CP.dpdp_ceiling().alias("dpdp_ceiling_inr"))


@query
def remediation_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = F.lit("2001-06-30 00:00:00").cast("timestamp")
    return RM.remediation_actions(dated(spark, sf_dir), "corpus", reference).select("priority", "action", "documents")


@query
def retention_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = F.lit("2001-06-30 00:00:00").cast("timestamp")
    return RM.retention_candidates(dated(spark, sf_dir), reference).select(
        "doc_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "risk_level")


# --- evaluation --------------------------------------------------------------------------
def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = (F.when(F.col("toxic") == 1, F.array(F.lit("IP_ADDRESS"), F.lit("CREDIT_CARD")))
               .when(F.col("quality") == 0, F.array(F.lit("EMAIL_ADDRESS"))).otherwise(F.array().cast("array<string>")))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    truth = table(spark, sf_dir, "labels").select(
        name.alias("file"), planted.alias("planted"),
        F.when(F.col("toxic") == 1, "Low").otherwise("Clean").alias("expected_risk"))
    docs = scored(spark, sf_dir).withColumn("path", F.concat(F.lit("/flat/"), name))
    return EV.match_truth(docs.select("path", "entity_types", "risk_level"), truth, "/flat")


@query
def evaluate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.entity_accuracy(_matched(spark, sf_dir))


@query
def micro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.micro_average(EV.entity_accuracy(_matched(spark, sf_dir)))


@query
def tier_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.tier_confusion(_matched(spark, sf_dir))


@query
def tier_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.tier_agreement(_matched(spark, sf_dir))


# --- text functions and sources ----------------------------------------------------------
@query
def rows_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    line = tables.row_text({"Key ": F.col("c_custkey"), "Name": F.col("c_name"), "": segment,
                            "Balance": F.col("c_acctbal").cast("decimal(12,2)")})
    return table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))


@query
def table_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    line = tables.row_text({"Name": F.col("c_name"), "Segment": F.col("c_mktsegment")})
    return tables.table_documents(rows, F.floor(F.col("c_custkey") / 50), F.col("c_custkey"), line)


@query
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query
def truncate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = T.truncate(F.col("text"), 2000)
    return table(spark, sf_dir, "documents").select(
        "doc_id", cut["char_count"].cast("bigint").alias("char_count"), cut["truncated"].alias("truncated"),
        F.md5(cut["text"]).alias("digest"))


@query
def subject_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.when(F.col("event_type") == "view", F.lit(None)).when(F.col("event_type") == "error", " ").otherwise(
        F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")))
    return table(spark, sf_dir, "events").select("event_id", T.join_subject(subject, F.col("props")).alias("text"))


@query
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(".txt"))
    inside = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/data/corpus/"), name)).otherwise(
        F.concat_ws("/", F.lit("/data/corpus"), "source", "lang", name))
    outside = F.concat_ws("/", F.lit("data/corpus"), "source", name)
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.file_name(inside).alias("file_name"), T.safe_name(inside).alias("safe_name"),
        T.top_folder(inside, "/data/corpus").alias("under_root"), T.top_folder(outside, "/data/corpus").alias("elsewhere"))


@query
def money_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.floor("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.format_inr(base * (1 + F.col("o_orderkey") % 90)).alias("inr_text"),
        T.format_eur(base * (1 + F.col("o_orderkey") % 9000)).alias("eur_text"))


@query
def mail_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.expr(X.ORDER_MAIL_DATE)
    for part, form in (("w", "EEE"), ("d", "d"), ("m", "MMM"), ("y", "yyyy"), ("s", "yy")):
        written = F.replace(written, F.lit("{" + part + "}"), F.date_format("o_orderdate", form))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(T.mail_date(written), "yyyy-MM-dd HH:mm:ss").alias("date"))


@query
def mail_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"))
    message = F.concat(
        F.lit("From: Some One <"), F.col("role"), F.lit("@example.com>\nTo: A <a@example.com>\nCc: b@example.com\n"),
        F.lit("Date: Mon, 14 May 2001 16:39:00 -0700 (PDT)\nSubject: Turn "), F.col("turn").cast("string"),
        F.lit("\nContent-Type: text/plain; charset=utf-8\n\n"), F.col("text"))
    rows = spread_small(table(spark, sf_dir, "conversations").select(name.alias("file"), message.alias("message")))
    docs, _ = files.read_messages(rows)
    return docs.select("source_path", "sender", "recipients", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"),
                       "subject", "text")


@query
def far_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identifier behind the 200,000th character of a message."""
    key = F.col("s_suppkey").cast("string")
    message = F.concat(F.lit("Subject: Long\n\n"), F.expr(X.FAR), F.lit("PAN: ABCPK"), F.lpad(key, 4, "0"), F.lit("F"))
    # spread as short keys: the messages are 10,000 times their size
    rows = spread_small(table(spark, sf_dir, "supplier")).select(key.alias("file"), message.alias("message"))
    docs, _ = files.read_messages(rows)
    raw = D.with_raw_findings(docs.select("source_path", "text", "truncated"), only("IN_PAN"))
    return raw.select("source_path", "truncated", F.inline("found")).select(
        "source_path", "truncated", big("start").alias("start_at"), "value")


def as_files(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    """Rows as the file source gives them, spread before their content is made."""
    return spread_small(rows).select(path.alias("path"), content.cast("binary").alias("content"),
                                     F.lit("2024-03-01 10:00:00").cast("timestamp").alias("modificationTime"))


@query
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of 6,001 lines, all of which are read."""
    key = F.col("s_suppkey")
    line = lambda i: F.concat(F.lit("n"), i.cast("string"), F.lit(","), (key * 10000 + i).cast("string"))
    content = F.concat(F.lit("Name,Account No\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6000)), line), "\n"))
    rows = as_files(table(spark, sf_dir, "supplier"), F.concat(F.lit("/in/"), key.cast("string"), F.lit(".CSV")), content)
    docs, _ = files.split(files.parsed_files(rows))
    return docs.select("source_path", "file_type", big("char_count").alias("char_count"), "truncated", F.md5("text").alias("digest"))


@query
def mail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail of several parts: text beside HTML, HTML alone, an attachment; without a date the file's counts."""
    kind, turn = F.col("turn") % 3, F.col("turn").cast("string")
    plain = F.concat(F.lit("--B\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"),
                     F.base64(F.col("text").cast("binary")), F.lit("\n"))
    html = F.concat(F.lit("--B\nContent-Type: text/html; charset=utf-8\n\n<style>p {}</style><p>Turn "), turn, F.lit("</p>bye\n"))
    attached = F.lit("--B\nContent-Type: text/plain\nContent-Disposition: attachment; filename=a.txt\n\nsecret\n")
    parts = F.when(kind == 0, F.concat(plain, html)).when(kind == 1, html).otherwise(F.concat(attached, plain))
    date = F.when(kind == 1, "").otherwise("Date: Tue, 14 Mar 2023 10:30:00 +0530\n")
    message = F.concat(F.lit("From: "), F.col("role"), F.lit("@example.com\n"), date,
                       F.lit("Subject: =?utf-8?q?Hi?=\nContent-Type: multipart/mixed; boundary=B\n\n"), parts, F.lit("--B--\n"))
    name = F.concat(F.lit("/in/"), F.col("conv_id").cast("string"), F.lit("."), turn, F.lit(".eml"))
    docs, _ = files.split(files.parsed_files(as_files(table(spark, sf_dir, "conversations"), name, message)))
    return docs.select("source_path", "sender", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "text")


@query
def skipped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken files are skipped with an error, files of other kinds are not looked at, bad bytes are replaced."""
    key = F.col("c_custkey")
    kinds = F.array(*map(F.lit, ("xlsx", "docx", "txt", "jpg")))
    name = F.concat(F.lit("/in/"), key.cast("string"), F.lit("."), F.get(kinds, (key % 4).cast("int")))
    content = F.concat(F.col("c_name").cast("binary"), F.lit(b"\xff!"))
    docs, skipped = files.split(files.parsed_files(as_files(table(spark, sf_dir, "customer"), name, content)))
    return docs.select(F.col("source_path").alias("path"), "text", F.lit(False).alias("is_skipped")).unionByName(
        skipped.where(F.col("error") != "").select("path", F.lit(None).cast("string").alias("text"), F.lit(True).alias("is_skipped")))


@query
def mail_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with line ends, quotes and commas, written as CSV and read back in byte ranges."""
    path = new_folder(spark, "mail")
    message = F.concat(F.lit('From: "Desk, '), F.col("role"), F.lit('"\nSubject: ""\n\n'), F.col("text"), F.lit('\n"",\n"'))
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws(".", "conv_id", "turn").alias("file"), message.alias("message"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return files.raw_messages(spark, path)


@query
def long_text_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in documents, those of more than 4,096 characters chunk by chunk."""
    raw = chunks.raw_findings(table(spark, sf_dir, "documents").select("doc_id", "text"), only("EMAIL_ADDRESS", "IP_ADDRESS"), size=2048)
    return raw.select("doc_id", "entity_type", big("start").alias("start_at"), big("end").alias("end_at"), dbl("score").alias("confidence"), "value")


@query
def stored_span_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps among spans that are rows, of three texts with a third of all spans each."""
    n, start = F.col("n_chars"), (F.col("doc_id") * 16 + F.col("n_chars") % 31).cast("int")
    kinds = F.array(*map(F.lit, ("BANK_ACCOUNT", "EMAIL_ADDRESS", "IN_PAN", "IBAN_CODE")))
    spans = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 3).alias("text_no"), start.alias("start"), (start + 2 + n % 97).cast("int").alias("end"),
        F.get(kinds, (n % 4).cast("int")).alias("entity_type"), ((500 + n % 500) / 1000).cast(SP.SCORE).alias("score"),
        F.lit(False).alias("weak_card"), F.col("doc_id").cast("string").alias("value"))
    kept = islands.resolve_rows(spans, "text_no")
    return kept.select("text_no", big("start").alias("start_at"), big("end").alias("end_at"), "entity_type", dbl("score").alias("confidence"), "value")


# --- stored scans ------------------------------------------------------------------------
def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding for each document, in three scans."""
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("doc_id"), F.upper("lang").alias("entity_type"),
        ((500 + n % 500) / 1000).cast(SP.SCORE).alias("confidence"), F.concat(F.lit("XX"), (n % 100).cast("string")).alias("masked_value"),
        (n % 1000).cast("int").alias("start"), (n % 1000 + 5).cast("int").alias("end"), (1000 + F.col("doc_id") % 3).cast("bigint").alias("scan_id"))


def scan_rows(found: DataFrame, settings: Column | None = None) -> DataFrame:
    """Commit records for the scans of some findings."""
    at = F.lit("2024-03-01 10:00:00").cast("timestamp")
    return found.groupBy("scan_id").agg(F.count("*").alias("docs_scanned")).select(
        at.alias("started_at"), at.alias("finished_at"), F.concat(F.lit("scan "), F.col("scan_id").cast("string")).alias("source"), "docs_scanned",
        F.lit(0).cast("bigint").alias("docs_skipped"), (F.lit("{}") if settings is None else settings).alias("settings_json"),
        F.to_json(F.struct("docs_scanned", F.create_map(F.lit("High"), F.col("docs_scanned") % 7).alias("level_counts"))).alias("stats_json"), "scan_id")


def plain_findings(found: DataFrame) -> DataFrame:
    return found.select("scan_id", "doc_id", "entity_type", dbl("confidence").alias("confidence"), "masked_value", big("start").alias("start_at"))


@query
def stored_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scans are written, one is written again with other rows, two are loaded."""
    base, rows = new_folder(spark, "scans"), finding_rows(spark, sf_dir)
    store.write_scans(rows, base, "findings")
    store.write_scans(rows.where("scan_id = 1001 and start % 2 = 0").withColumn("masked_value", F.lit("again")), base, "findings")
    store.write_scans(scan_rows(rows), base, "scans")
    loaded = [store.load_scan(spark, base, i)["findings"] for i in (1000, 1001)]
    return plain_findings(loaded[0].unionByName(loaded[1]))


@query
def scan_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan without its commit record is not listed, its rows are not seen, and sweeping takes them away."""
    base, rows = new_folder(spark, "registry"), finding_rows(spark, sf_dir)
    store.write_scans(rows, base, "findings")
    store.write_scans(scan_rows(rows.where("scan_id <> 1001")), base, "scans")
    counted = lambda kind, df: df.groupBy("scan_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "scan_id", "n")
    listed = store.list_scans(spark, base).select(F.lit("listed").alias("kind"), "scan_id", F.col("docs_scanned").alias("n"))
    seen, left = counted("seen", store.read(spark, base, "findings")), counted("unfinished", store.unfinished(spark, base))
    before = listed.unionByName(seen).unionByName(left)
    rows_of = before.collect()  # six rows: the folder is swept below
    swept = store.sweep(spark, base, 0)
    after = counted("kept", store.read(spark, base, "findings", committed=False))
    return spark.createDataFrame(rows_of, before.schema).unionByName(after).unionByName(
        spark.createDataFrame([("swept", None, swept)], before.schema))


@query
def scan_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings and figures are written as JSON, read back as columns and filtered by a nested field."""
    base = new_folder(spark, "settings")
    rows = finding_rows(spark, sf_dir).withColumn("scan_id", (10 + F.col("start") % 40).cast("bigint"))
    score = (F.col("scan_id") % 4 / 10).cast("double")
    settings = F.to_json(F.struct(F.lit("folder").alias("source"), score.alias("min_score"), F.lit([1, 2]).alias("of_a_later_version")))
    store.write_scans(scan_rows(rows, settings), base, "scans")
    chosen = store.list_scans(spark, base).where("settings.min_score >= 0.2 and settings.limit is null")
    return chosen.select("scan_id", F.col("settings.source").alias("source"), F.col("settings.min_score").alias("min_score"),
                         F.col("stats.docs_scanned").alias("docs_scanned"), F.col("stats.level_counts")["High"].alias("high"))


@query
def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of single documents, from a table that is stored by range of their id."""
    base, rows = new_folder(spark, "lookup"), finding_rows(spark, sf_dir)
    store.write(rows, base, "findings", 7)
    store.write_scans(scan_rows(rows.withColumn("scan_id", F.lit(7).cast("bigint"))), base, "scans")
    frames = [plain_findings(store.find(spark, base, "findings", 7, f"DOC-{k}")) for k in (1, 55, 199, 123456789)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


@query
def unique_across_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct identifiers over three scans: exact, and whether merged sketches of the scans come within a twentieth of it."""
    identifier = F.struct(F.upper("lang").alias("id_group"), F.sha2((F.col("n_chars") * 7 + F.col("doc_id") % 5).cast("string"), 256).alias("digest"))
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("scan"), F.array(identifier).alias("digests"))
    sketches = [RP.unique_sketches(rows.where(F.col("scan") == k)) for k in range(3)]
    about = RP.unique_of_sketches(sketches[0].unionByName(sketches[1]).unionByName(sketches[2]))
    exact = RP.unique_identifiers(rows)
    close = F.abs(F.col("about") - F.col("unique_values")) * 20 <= F.col("unique_values")
    return exact.join(about.withColumnRenamed("unique_values", "about"), "id_group").select("id_group", "unique_values", close.alias("close"))


@query
def ordered_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with quotes and line ends, exported in order and read back with types."""
    text = F.concat(F.col("text"), F.lit(' said "'), F.col("role"), F.lit('",\nand more'))
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws(".", "conv_id", "turn").alias("path"), text.alias("reason"),
                                                        (F.col("conv_id") % 1000 / 10).cast("decimal(5,1)").alias("risk_score"), "turn")
    path = store.export_csv({"turns": rows.orderBy(F.desc("risk_score"), "path")}, new_folder(spark, "export"))["turns"]
    back = store.read_export(spark, path, "path string, reason string, risk_score decimal(5,1), turn bigint")
    return back.select("path", "reason", dbl("risk_score").alias("risk_score"), "turn")


@query
def nested_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of text files in folders of folders, beside files of other kinds; read back as documents."""
    folder = new_folder(spark, "nested")
    line = F.translate(F.concat_ws(": ", "role", "text"), "\r\n", "  ")
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 3).cast("int").alias("a"), (F.floor(F.col("conv_id") / 300)).cast("int").alias("b"), "conv_id", "turn", line.alias("line"))
    placed = rows.repartition("a", "b").sortWithinPartitions("a", "b", "conv_id", "turn").select("line", "a", "b")
    placed.write.partitionBy("a", "b").text(f"{folder}/in")
    placed.write.partitionBy("a", "b").json(f"{folder}/in/other")
    docs, skipped = files.read_folder(spark, folder)
    of = lambda name: F.regexp_extract("source_path", f"/{name}=([0-9]+)/", 1).cast("int").alias(name)
    return docs.select(of("a"), of("b"), "file_type", F.rtrim(F.col("text"), F.lit("\n")).alias("text")).join(skipped.select(F.lit(1).alias("x")), F.lit(True), "left_anti")


@query
def masked_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of which some are no part of their text, and some end inside an address."""
    address = F.concat(F.lit("t"), F.col("turn").cast("string"), F.lit(".x@mail.org"))
    kind = F.col("conv_id") % 3
    subject = F.when(kind == 0, F.concat(F.lit("Re "), address, F.lit(" and more"))).when(kind == 1, "Write to t").otherwise("Nothing")
    text = F.when(kind == 1, F.concat(F.lit("Write to "), address, F.lit(" today"))).otherwise(F.concat(F.lit("Body for "), address))
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws(".", "conv_id", "turn").alias("doc_id"), subject.alias("subject"), text.alias("text"))
    docs = spread_small(rows).select("*", F.col("doc_id").alias("source_path"), F.lit("eml").alias("file_type"), F.lit("").alias("sender"),
                                     F.lit(None).cast("timestamp").alias("date"), F.length("text").alias("char_count"), F.lit(False).alias("truncated"))
    done = SN.scan_documents(docs, only("EMAIL_ADDRESS"), b"k")
    return done.select("doc_id", "subject", "masked_snippet", big("finding_count").alias("finding_count"))
