"""Remediation: prioritised actions and redacted copies of the riskiest documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilscan import fixed_values as fv
from veilscan.config import DEFAULT, Settings
from veilscan.functions import masking, text as T
from veilscan.plans import reports as RP

# --- fixed values: priority, text before and after the count, reason; in emission order ---
RULE_TEXTS = (
    ("P1", "Restrict access to ", " spreadsheets holding bulk personal records",
     "Bulk exports (payroll, KYC) expose many people at once; limit to named owners and encrypt."),
    ("P1", "Review ", " 'toxic combination' files first",
     "Identity + health/salary/financial data together causes the most harm if breached."),
    ("P1", "Redact or mask Aadhaar numbers in ", " documents",
     "Keep only the last 4 digits; full Aadhaar numbers should not sit in email or shared files."),
    ("P1", "Move ", " documents with health information to a restricted HR-medical store",
     "Health data is special-category data under GDPR Art. 9 and high-risk under DPDP."),
    ("P2", "Vault or tokenise financial account details found in ", " documents",
     "Bank, card and UPI details enable fraud; card numbers must never travel by email (PCI DSS)."),
    ("P2", "Limit ", " documents with salary details to HR/Payroll",
     "Compensation data is confidential and should not live on shared drives or broad mailboxes."),
    ("P2", "Mask PAN numbers in ", " further documents",
     "PAN links a person to their tax records."),
    ("P2", "Apply a retention policy and DLP rule to the mailbox '", " high/medium-risk emails)",
     "The mailboxes that send the most sensitive data are the best place to start data-loss prevention."),
    ("P3", "Review ", " documents with personal data older than {years} years for deletion",
     "DPDP requires erasure once the purpose is served; a retention schedule shrinks exposure."),
    ("P3", "", " documents contain no detected PII: candidates for standard retention and AI/analytics use",
     "Classifying clean content is what makes it safe to feed into search or GenAI tools (after spot checks)."),
)
_WITH_FOLDER = (1, 3, 4, 5, 6, 7)
_MAILBOX = 8


def is_old(date: Column, level: Column, reference: Column, settings: Settings = DEFAULT) -> Column:
    """Older than the retention period and holding personal data; no date is never old."""
    edge = reference - F.make_ym_interval(F.lit(settings.retention_years), F.lit(0))
    return F.coalesce(date < edge, F.lit(False)) & (level != "Clean")


def retention_candidates(docs: DataFrame, reference: Column, settings: Settings = DEFAULT) -> DataFrame:
    return docs.where(is_old(F.col("date"), F.col("risk_level"), reference, settings))


def remediation_actions(docs: DataFrame, root: str = "", reference: Column | None = None,
                        settings: Settings = DEFAULT) -> DataFrame:
    """Prioritised actions, computed in one pass over the scored documents.

    Every document names the rules it meets; (rule, folder or sender) pairs are counted before
    the shuffle, so a folder or a sender with very many documents is one partial count per task.
    """
    reference = F.current_timestamp() if reference is None else reference

    def has(*kinds: str) -> Column:
        return F.arrays_overlap("entity_types", F.array(*[F.lit(k) for k in kinds]))

    risky_mail = F.col("risk_level").isin("High", "Medium") & (F.coalesce("sender", F.lit("")) != "")
    met = (
        F.col("file_type").isin("csv", "xlsx") & (F.col("risk_level") == "High"),
        F.col("toxic"),
        has("IN_AADHAAR"),
        has("HEALTH_INFO"),
        has(*fv.ACCOUNT_TYPES),
        has("SALARY"),
        has("IN_PAN") & ~has("IN_AADHAAR"),
        risky_mail,
        is_old(F.col("date"), F.col("risk_level"), reference, settings),
        F.col("risk_level") == "Clean",
    )
    rules = F.array_compact(F.array(*[F.when(m, F.lit(i)) for i, m in enumerate(met, 1)]))
    place = F.when(F.col("rule") == _MAILBOX, F.col("sender")).when(
        F.col("rule").isin(*_WITH_FOLDER), T.top_folder(F.col("path"), root)).otherwise(F.lit(""))
    per_place = (docs.select("path", "sender", F.explode(rules).alias("rule"))
                 .groupBy("rule", place.alias("place")).agg(F.count("*").alias("n")))
    per_rule = per_place.groupBy("rule").agg(
        F.sum("n").alias("total"),
        F.min(F.struct((-F.col("n")).alias("neg"), "place")).alias("best"))

    spark = docs.sparkSession
    texts = spark.createDataFrame(
        [(i, p, a, b.replace("{years}", str(settings.retention_years)), w)
         for i, (p, a, b, w) in enumerate(RULE_TEXTS, 1)],
        "rule int, priority string, lead string, tail string, why string")
    joined = per_rule.join(F.broadcast(texts), "rule")
    top = -F.col("best.neg")
    count = F.when(F.col("rule") == _MAILBOX, top).otherwise(F.col("total"))
    folder = F.when(F.col("rule").isin(*_WITH_FOLDER), F.concat(
        F.lit(" (mostly in '"), F.col("best.place"), F.lit("': "), top.cast("string"), F.lit(")"))).otherwise("")
    action = F.when(F.col("rule") == _MAILBOX, F.concat(
        "lead", F.col("best.place"), F.lit("' ("), top.cast("string"), "tail")).otherwise(
        F.concat("lead", F.col("total").cast("string"), "tail", folder))
    return (joined.select("priority", action.alias("action"), count.alias("documents"), "why", "rule")
            .orderBy("priority", F.desc("documents"), "rule").drop("rule"))


def redact_top(docs: DataFrame, texts: DataFrame, settings: Settings = DEFAULT,
               top_n: int | None = None) -> DataFrame:
    """Redacted copies of the riskiest documents: (rank, doc_id, source, redacted_name, content).

    ``docs`` holds ``findings``; ``texts`` is (doc_id, text). Only the ``top_n`` ranked rows are
    broadcast, and only their texts are touched.
    """
    n = settings.top_redacted if top_n is None else top_n
    ranked = RP.ranked_documents(docs.select("doc_id", "path", "risk_score", "risk_level", "reason", "findings"), n)
    body = masking.redact_text(F.col("text"), F.col("findings"))
    header = F.concat(
        F.lit("# REDACTED COPY\n# Source: "), T.file_name(F.col("path")), F.lit("\n# Risk: "), F.col("risk_level"),
        F.lit(" ("), F.col("risk_score").cast("string"), F.lit(") - "), F.col("reason"), F.lit("\n\n"))
    name = F.concat(F.lpad(F.col("rank").cast("string"), 2, "0"), F.lit("_"), T.safe_name(F.col("path")),
                    F.lit(".redacted.txt"))
    return (texts.select("doc_id", "text").join(F.broadcast(ranked), "doc_id")
            .select("rank", "doc_id", F.col("path").alias("source"), name.alias("redacted_name"),
                    F.concat(header, body).alias("content"))
            .orderBy("rank"))


