"""Scoring, reports, compliance, remediation and evaluation on small hand-made frames."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veilscan.config import DEFAULT
from veilscan.functions import masking, text as T
from veilscan.operators import score as SC
from veilscan.plans import compliance as CP, evaluate as EV, remediation as RM, reports as RP

FINDINGS = "array<struct<start:int,end:int,entity_type:string,masked_value:string,confidence:decimal(4,3)>>"


def findings(*kinds):
    out = []
    for i, k in enumerate(kinds):
        kind, sure = k if isinstance(k, tuple) else (k, 1.0)
        out.append((10 * i, 10 * i + 5, kind, "X", Decimal(str(sure))))
    return out


def scored(spark, cases, settings=DEFAULT):
    df = spark.createDataFrame(list(enumerate(cases)), f"doc_id int, findings {FINDINGS}")
    return {r.doc_id: r for r in SC.score_documents(df, settings).collect()}


def test_scores(spark):
    cases = [
        findings(), findings("DATE_TIME", "LOCATION"), findings(("IN_AADHAAR", 0.9), ("EMAIL_ADDRESS", 0.5)),
        findings("PERSON"), findings("IN_AADHAAR", "IN_PHONE", "PERSON"), findings(*["IN_AADHAAR"] * 4),
        findings("IN_AADHAAR", "IN_PHONE"), findings("PERSON", ("HEALTH_INFO", 0.55)), findings("IN_PAN", "BANK_ACCOUNT"),
        findings(("HEALTH_INFO", 0.55)), findings(*["IN_AADHAAR"] * 200),
        findings("IN_AADHAAR", "IN_AADHAAR", "IN_AADHAAR", "SALARY", "PERSON"),
        findings("NEW_TYPE"), findings("IN_IFSC", "EMAIL_ADDRESS", "IP_ADDRESS", "PERSON", "IN_PHONE", "DATE_TIME"),
        findings(*[("IN_PAN", 0.999)] * 5),
    ]
    got = scored(spark, cases)
    assert (got[0].risk_level, float(got[0].risk_score), got[0].reason) == ("Clean", 0.0, "No personal data detected")
    assert got[1].risk_level == "Clean" and got[1].finding_count == 2 and got[1].entity_types == ["DATE_TIME", "LOCATION"]
    assert float(got[2].risk_score) == 10.0
    assert [got[i].risk_level for i in (3, 4, 5, 6)] == ["Low", "Medium", "High", "Low"]
    assert got[7].toxic and got[7].risk_level == "High" and got[8].toxic
    assert not got[9].toxic and got[9].risk_level == "Low"
    assert float(got[10].risk_score) == 100 and "bulk file with 200 sensitive records (+30 volume bonus)" in got[10].reason
    assert got[11].reason.startswith("3 Aadhaar numbers") and "salary details linked to a named person" in got[11].reason
    assert float(got[12].risk_score) == 1.0 and got[12].reason == "1 NEW_TYPE" and got[12].sensitive_records == 0
    assert got[13].reason == "1 Indian mobile number + 1 IFSC code + 1 email address + 1 IP address + 1 other type(s)"
    # 39.96 is shown as 40.0 and stays Medium
    assert float(got[14].risk_score) == 40.0 and got[14].risk_level == "Medium"


def test_volume_bonus_tiers(spark):
    rows = spark.createDataFrame([(9,), (10,), (49,), (50,), (199,), (200,)], "n int")
    assert [r.b for r in rows.select(SC.volume_bonus(F.col("n")).alias("b")).collect()] == [0, 10, 10, 20, 20, 30]


@pytest.fixture(scope="module")
def docs(spark):
    day = dt.datetime
    rows = [
        (1, "/r/hr/pay.csv", "csv", "", day(2020, 1, 5), "Payroll", findings("IN_AADHAAR", "SALARY", "PERSON", "BANK_ACCOUNT", "IN_PAN")),
        (2, "/r/hr/leave.eml", "eml", "a@x.org", day(2024, 2, 5), "Leave", findings("PERSON", "HEALTH_INFO")),
        (3, "/r/hr/kyc.eml", "eml", "a@x.org", day(2024, 5, 1), "KYC", findings("IN_PAN", "IN_PHONE", "EMAIL_ADDRESS", "PERSON")),
        (4, "/r/top.txt", "txt", "", day(2019, 1, 1), "", findings("EMAIL_ADDRESS", "EMAIL_ADDRESS", "DATE_TIME")),
        (5, "/r/misc/none.txt", "txt", "b@x.org", None, "Lunch", findings()),
        (6, "/r/misc/mail.eml", "eml", "b@x.org", day(2024, 2, 29), "100% off_er", findings("IN_PAN", "IN_PAN")),
    ]
    schema = f"doc_id int, path string, file_type string, sender string, date timestamp, subject string, findings {FINDINGS}"
    return SC.score_documents(spark.createDataFrame(rows, schema)).cache()


def test_reports(docs):
    assert [tuple(r) for r in RP.level_counts(docs).collect()] == [("High", 2), ("Medium", 2), ("Low", 1), ("Clean", 1)]
    types = RP.type_rows(docs)
    counts = {r.entity_type: (r.findings, r.documents) for r in RP.entity_counts(types).collect()}
    assert counts["IN_PAN"] == (4, 3) and counts["EMAIL_ADDRESS"] == (3, 2) and counts["DATE_TIME"] == (1, 1)
    found = docs.select("doc_id", F.inline("findings"))
    assert RP.type_rows_of(found).count() == types.count()
    assert ([tuple(r) for r in RP.findings_summary(docs).collect()]
            == [tuple(r) for r in RP.findings_summary(docs, found).collect()])
    assert [r.entity_type for r in RP.widest_types(types).collect()] == ["IN_PAN", "PERSON", "EMAIL_ADDRESS"]
    assert "DATE_TIME" not in [r.entity_type for r in RP.scored_only(types).collect()]
    assert tuple(RP.dominant_high_filetype(docs).collect()[0]) == ("csv", 1, 2)
    assert [tuple(r) for r in RP.top_senders(docs).collect()] == [
        ("a@x.org", "High", 1), ("a@x.org", "Medium", 1), ("b@x.org", "Medium", 1)]
    special = RP.special_counts(docs).collect()[0]
    assert (special.health_documents, special.financial_documents, special.health_share) == (1, 1, "16.7%")
    assert [r.doc_id for r in RP.ranked_documents(docs, 3).collect()] == [1, 2, 6]
    choices = RP.filter_choices(docs).collect()
    assert [c.value for c in choices if c.field == "sender"] == ["a@x.org", "b@x.org"]
    assert [tuple(r)[:2] for r in RP.document_summary(found, 6).collect()] == [("IN_PAN", 2)]
    assert RP.document_findings(found, 6, 1).count() == 1
    assert "masked_snippet" not in RP.documents_export(docs).columns


def test_explorer(docs):
    def ids(**kw):
        return [r.doc_id for r in RP.explorer(docs, **kw).collect()]

    assert ids() == [1, 2, 6, 3, 4, 5]
    assert ids(levels=("High",)) == [1, 2]
    assert ids(entities=("IN_PAN",), file_types=("eml",)) == [6, 3]
    assert ids(sender="b@x.org") == [6, 5]
    assert ids(query="% OFF_") == [6] and ids(query="x%o") == []
    assert ids(query="pay.csv") == [1] and ids(query="aadhaar") == [1]


def test_timeline_is_dense(docs):
    quarters = RP.timeline(docs).collect()
    assert {r.grain for r in quarters} == {"quarter"}
    assert len(quarters) == 22 * 3 and sum(r.documents for r in quarters) == 5
    months = RP.timeline(docs.where("date > '2024-01-01'")).collect()
    assert {r.grain for r in months} == {"month"} and len({r.period for r in months}) == 4


def test_compliance(spark, docs):
    got = {r.entity_type: r for r in CP.compliance_table(RP.type_rows(docs)).collect()}
    assert got["HEALTH_INFO"].gdpr_special_category == "Yes" and got["IN_PAN"].financial == "Yes"
    unknown = RP.type_rows(docs).withColumn("entity_type", F.lit("NEW"))
    row = CP.compliance_table(unknown).collect()[0]
    assert (row.dpdp_category, row.dpdp_higher_risk, row.financial) == ("Personal data", "No", "No")
    caps = spark.createDataFrame([(100e6,), (1000e6,)], "t double").select(CP.gdpr_ceiling(F.col("t")).alias("c")).collect()
    assert [r.c for r in caps] == [20e6, 40e6]
    rows = spark.createDataFrame([(0, 0, 0, 0), (10_000_000, 100, 0, 100)], "p long, h long, m long, n long")
    out = rows.select(*[c.alias(k) for k, c in CP.exposure(F.col("p"), F.col("h"), F.col("m"), F.col("n")).items()]).collect()
    assert (out[0].exposure_index, out[0].exposure_band) == (0.0, "Low")
    assert (out[1].exposure_index, out[1].exposure_band) == (100.0, "Critical")
    assert CP.other_penalties(spark).count() == 4
    weights = RP.weights_listing(spark).collect()
    assert weights[0].weight == 10 and weights[-1].scored == "No (stored only)" and len(weights) == 17


def test_unique_counts_and_narrative(spark, docs):
    raw = spark.createDataFrame([("IN_PHONE", "+91 98765 43210"), ("PHONE_NUMBER", "9876543210"), ("EMAIL_ADDRESS", "A@b.org"),
                                 ("EMAIL_ADDRESS", "a@B.org "), ("EMAIL_ADDRESS", "c@b.org")], "e string, v string")
    ids = raw.select(F.array(F.struct(masking.identifier_group(F.col("e")).alias("id_group"),
                                      masking.normalise_identifier(F.col("v"), F.col("e")).alias("digest"))).alias("digests"))
    unique = RP.unique_identifiers(ids)
    assert {tuple(r) for r in unique.collect()} == {("PHONE", 1), ("EMAIL_ADDRESS", 2)}
    assert tuple(RP.unique_summary(unique).collect()[0]) == (3, 2)
    assert tuple(RP.unique_summary(unique.limit(0)).collect()[0]) == (0, 0)
    text = CP.narrative(docs, RP.type_rows(docs), unique).collect()[0].summary
    assert text.startswith("Of 6 documents scanned, 2 (33.3%) contain high-risk personal data")
    assert "PANs (3 files), person names (3 files) and email addresses (2 files)" in text
    assert "at least 2 distinct people" in text and "concentrated in CSV files (1 of 2)" in text


def test_remediation(spark, docs):
    ref = F.lit("2024-06-01 00:00:00").cast("timestamp")
    got = [tuple(r)[:3] for r in RM.remediation_actions(docs, "/r", ref).collect()]
    assert got == [
        ("P1", "Review 2 'toxic combination' files first", 2),
        ("P1", "Restrict access to 1 spreadsheets holding bulk personal records (mostly in 'hr': 1)", 1),
        ("P1", "Redact or mask Aadhaar numbers in 1 documents (mostly in 'hr': 1)", 1),
        ("P1", "Move 1 documents with health information to a restricted HR-medical store (mostly in 'hr': 1)", 1),
        ("P2", "Mask PAN numbers in 2 further documents (mostly in 'hr': 1)", 2),
        ("P2", "Apply a retention policy and DLP rule to the mailbox 'a@x.org' (2 high/medium-risk emails)", 2),
        ("P2", "Vault or tokenise financial account details found in 1 documents (mostly in 'hr': 1)", 1),
        ("P2", "Limit 1 documents with salary details to HR/Payroll (mostly in 'hr': 1)", 1),
        ("P3", "Review 2 documents with personal data older than 3 years for deletion", 2),
        ("P3", "1 documents contain no detected PII: candidates for standard retention and AI/analytics use", 1),
    ]
    assert RM.remediation_actions(docs.limit(0), "/r", ref).count() == 0


def test_redaction(spark, docs):
    texts = docs.select("doc_id", F.lit("0123456789abcdefghijABCDEFGHIJ" * 2).alias("text"))
    rows = RM.redact_top(docs, texts, top_n=2).collect()
    assert [r.redacted_name for r in rows] == ["01_pay.csv.redacted.txt", "02_leave.eml.redacted.txt"]
    assert rows[1].content.endswith("<PERSON>56789<HEALTH_INFO>fghijABCDEFGHIJ0123456789abcdefghijABCDEFGHIJ")
    one = docs.where("doc_id = 4").select(masking.redact_text(F.lit("0123456789abcdefghijABCDEFGHIJ"), F.col("findings")).alias("t"))
    assert one.collect()[0].t == "<EMAIL_ADDRESS>56789<EMAIL_ADDRESS>fghijABCDEFGHIJ"  # dates stay


def test_evaluation(spark):
    docs = spark.createDataFrame([("/r/a.txt", ["IN_PAN", "PERSON"], "Low"), ("/r/b.txt", ["PERSON"], "Clean"), ("/r/x.txt", [], "Low"),
                                  ("/q/a.txt", ["IN_PAN"], "High")], "path string, entity_types array<string>, risk_level string")
    truth = spark.createDataFrame([("a.txt", "Low", ["IN_PAN", "IN_UPI"]), ("b.txt", "Low", []), ("gone.txt", "High", ["IN_PAN"])],
                                  "file string, expected_risk string, planted array<string>")
    matched = EV.match_truth(docs, truth, "/r/")
    got = {r.entity_type: tuple(r)[1:] for r in EV.entity_accuracy(matched).collect()}
    assert got["IN_PAN"] == (1, 0, 0, 1.0, 1.0, 1.0)
    assert got["PERSON"] == (0, 2, 0, 0.0, None, None) and got["IN_UPI"] == (0, 0, 1, None, 0.0, None)
    assert got["SALARY"] == (0, 0, 0, None, None, None) and len(got) == 12
    assert tuple(EV.micro_average(EV.entity_accuracy(matched)).collect()[0]) == (0.333, 0.5)
    assert [tuple(r) for r in EV.tier_confusion(matched).collect()] == [("Low", "Clean", 1), ("Low", "Low", 1)]
    assert tuple(EV.tier_agreement(matched).collect()[0]) == (0.5, 2)


def test_text_functions(spark):
    df = spark.createDataFrame([(1,)], "x int")

    def one(column):
        return df.select(column.alias("v")).collect()[0].v

    assert one(T.strip_html(F.lit("<style>p</style>a<br/>b  <b>c</b><SCRIPT>x</SCRIPT></p>"))) == " a\nb c \n"
    assert one(T.join_subject(F.lit(" S "), F.lit("b"))) == "S\n\nb" and one(T.join_subject(F.lit(" "), F.lit("b"))) == "b"
    assert one(T.safe_name(F.lit("/a/b c(1)é.txt"))) == "b_c_1_.txt"
    folders = {"/r/hr/x/a.txt": "hr", "/r/a.txt": "(root folder)", "m/p/a.txt": "m/p", "m/a.txt": "m"}
    assert {k: one(T.top_folder(F.lit(k), "/r")) for k in folders} == folders
    assert [one(T.format_inr(F.lit(v))) for v in (2500000000, 450000, 950)] == ["INR 250 crore", "INR 4.5 lakh", "INR 950"]
    assert [one(T.format_eur(F.lit(v))) for v in (1134999600, 20000000, 950)] == ["EUR 1.13 bn", "EUR 20.0 m", "EUR 950"]
    assert one(T.percent(F.lit(1), F.lit(3))) == "33.3%" and one(T.percent(F.lit(0), F.lit(0))) == "0.0%"
    dates = {"Mon, 14 May 2001 16:39:00 -0700 (PDT)": "2001-05-14 23:39:00", "14 May 2001 16:39": "2001-05-14 16:39:00",
             "Tue, 14 Mar 2023 10:30:00 +0530": "2023-03-14 05:00:00", "1 Jan 2024 00:00:00 GMT": "2024-01-01 00:00:00", "soon": None}
    assert {k: one(F.date_format(T.mail_date(F.lit(k)), "yyyy-MM-dd HH:mm:ss")) for k in dates} == dates
    cut = T.truncate(F.lit("abc😀e"), 4)
    assert [one(cut[k]) for k in ("text", "char_count", "truncated")] == ["abc😀", 4, True]


def test_tally_gives_what_the_separate_reports_give(docs):
    ids = F.array(F.struct(F.lit("EMAIL_ADDRESS").alias("id_group"), F.concat(F.lit("d"), (F.col("doc_id") % 4).cast("string")).alias("digest")))
    both = docs.withColumn("digests", ids)
    counted, unique = RP.tally(both), RP.unique_identifiers(both)
    assert ({tuple(r) for r in RP.entity_counts_of(counted).collect()}
            == {tuple(r) for r in RP.entity_counts(RP.type_rows(both), unique).select("entity_type", "findings", "documents", "avg_confidence", "unique_values").collect()})
    want = CP.kpi_row(both, unique)
    assert CP.kpi_of(counted).select(want.columns).collect() == want.collect()
    assert CP.narrative_of(counted).collect() == CP.narrative(both, RP.type_rows(both), unique).collect()
    none = RP.tally(both.limit(0))
    assert RP.entity_counts_of(none).count() == 0 and CP.kpi_of(none).first().docs_scanned == 0
    assert CP.narrative_of(none).first().summary == "The selected scan contains no documents."


def test_unclosed_blocks_are_looked_through_once(spark):
    pages = ["a<script>x</script><SCRIPT>y</script>b<script>c", "<script " * 50_000, "<style>p{}</style>z<style>", "plain"]
    rows = spark.createDataFrame([(p,) for p in pages], "h string").select(T.strip_html(F.col("h")).alias("t")).collect()
    assert [r.t for r in rows] == ["a b c", "<script " * 50_000, " z ", "plain"]


def test_mail_dates_with_zones_and_short_years(spark):
    written = ["14 May 01 16:39 PDT", "Mon, 14 May 2001 16:39:00 EST", "14 May 99 16:39:00 +0530 (IST)", "14 May 2001 16:39:00", "14 May 2001 16:39:00 Zulu", "soon"]
    rows = spark.createDataFrame([(w,) for w in written], "w string").select(T.mail_date(F.col("w")).cast("string").alias("d")).collect()
    assert [r.d for r in rows] == ["2001-05-14 23:39:00", "2001-05-14 21:39:00", "1999-05-14 11:09:00", "2001-05-14 16:39:00", "2001-05-14 16:39:00", None]
