"""The same queries in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from catalog import texts as X
from veilscan import fixed_values as fv


def tokens(name: str, source: str, key: str, text: str, pattern: str) -> str:
    """CTEs giving every match of a pattern without look-around: (key, value, start)."""
    return f"""
{name}_g AS (
  SELECT {key}, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS g
  FROM {source} WHERE regexp_matches({text}, '{pattern}')),
{name} AS (
  SELECT {key}, m[i] AS value,
         coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
       + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start_at
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_g))"""


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_EMAIL = "[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+[.])+[A-Za-z]{2,24}"
_PHONE = "(?:[+][0-9]{1,3}[ .-]?)?(?:[(][0-9]{3}[)][ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
_CARD = "[3-6][0-9]{15}|[3-6][0-9]{18}|3[47][0-9]{13}|4[0-9]{12}|3(?:0[0-5]|[68][0-9])[0-9]{11}"
_D5 = "[" + ",".join(
    str(((a + b) if a < 5 else (a - b)) % 5 + (5 if (a >= 5) != (b >= 5) else 0)) for a in range(10) for b in range(10)
) + "]"


def _positions() -> str:
    base, rows = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [list(range(10))]
    while len(rows) < 8:
        rows.append([base[v] for v in rows[-1]])
    return "[" + ",".join(str(v) for r in rows for v in r) + "]"


_POS = _positions()
_INV = "[0,4,3,2,1,5,6,7,8,9]"


def verhoeff(number: str, shift: int) -> str:
    """Checksum of a digit string of at most 20 digits."""
    digits = f"list_transform(range(0, length({number})), lambda i: cast(substr({number}, cast(length({number}) - i as int), 1) as int) + 100 * cast(i as int))"
    return (f"list_reduce(list_concat([0], {digits}), "
            f"lambda c, d: {_D5}[c * 10 + {_POS}[((d // 100 + {shift}) % 8) * 10 + d % 100 + 1] + 1])")


def luhn(number: str) -> str:
    return (f"(list_sum(list_transform(range(0, length({number})), lambda i: "
            f"CASE WHEN i % 2 = 0 THEN cast(substr({number}, cast(length({number}) - i as int), 1) as int) "
            f"ELSE (CASE WHEN cast(substr({number}, cast(length({number}) - i as int), 1) as int) * 2 > 9 "
            f"THEN cast(substr({number}, cast(length({number}) - i as int), 1) as int) * 2 - 9 "
            f"ELSE cast(substr({number}, cast(length({number}) - i as int), 1) as int) * 2 END) END)) % 10 = 0)")


_MASK_ID = ("CASE WHEN length(regexp_replace(value, '[^0-9A-Za-z]', '', 'g')) > 4 THEN "
            "array_to_string(list_transform(range(1, length(value) + 1), lambda i: CASE WHEN regexp_matches(substr(value, cast(i as int), 1), '[0-9A-Za-z]') "
            "AND length(regexp_replace(substr(value, cast(i as int)), '[^0-9A-Za-z]', '', 'g')) > 4 THEN 'X' ELSE substr(value, cast(i as int), 1) END), '') "
            "ELSE regexp_replace(value, '[0-9A-Za-z]', 'X', 'g') END")
_MASK = (f"CASE WHEN entity_type = 'EMAIL_ADDRESS' THEN substr(value, 1, 1) || repeat('*', greatest(strpos(value, '@') - 2, 2)) "
         f"|| substr(value, strpos(value, '@')) ELSE {_MASK_ID} END")

# Findings of `documents`. The rules that need other words or other alphabets than these tables
# hold (see the per-rule queries) find nothing in them.
FINDINGS = "WITH " + ",".join([
    tokens("email", "documents", "doc_id", "text", _EMAIL),
    tokens("dots", "documents", "doc_id", "text", "[0-9.]*[0-9][.][0-9][0-9.]*"),
    tokens("word", "documents", "doc_id", "text", "[0-9A-Za-z_-]*[0-9]{13}[0-9A-Za-z_-]*"),
    tokens("run", "documents", "doc_id", "text", "[+]?[0-9]{10,}"),
    tokens("tel", "documents", "doc_id", "text", _PHONE),
]) + f""",
findings AS (
  SELECT *, {_MASK} AS masked_value FROM (
    SELECT doc_id, 'EMAIL_ADDRESS' AS entity_type, value, start_at, 1.0 AS confidence FROM email
    UNION ALL SELECT doc_id, 'IP_ADDRESS', rtrim(value, '.'), start_at, 0.6 FROM dots
      WHERE regexp_full_match(rtrim(value, '.'), '(?:{_OCTET}[.]){{3}}{_OCTET}')
    UNION ALL SELECT doc_id, 'CREDIT_CARD', value, start_at, 1.0 FROM word
      WHERE regexp_full_match(value, '{_CARD}') AND {luhn('value')}
    UNION ALL SELECT doc_id, 'PHONE_NUMBER', value, start_at, 0.55 FROM tel
    UNION ALL SELECT doc_id, 'IN_PHONE', value, start_at, 0.55 FROM run
      WHERE regexp_full_match(value, '(?:[+]91|0091|0)?[6-9][0-9]{{9}}')
    UNION ALL SELECT doc_id, 'IN_AADHAAR', value, start_at, 0.6 FROM run
      WHERE regexp_full_match(value, '[2-9][0-9]{{11}}') AND {verhoeff('value', 0)} = 0))"""

_WEIGHT = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fv.WEIGHTS.items()) + " ELSE 1 END"
_ONE = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in fv.FRIENDLY.items()) + " ELSE entity_type END"
_MANY = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in fv.FRIENDLY.items()) + " ELSE entity_type END"


def _in(kinds) -> str:
    return "(" + ", ".join(f"'{k}'" for k in kinds) + ")"


def scored(findings: str, docs: str) -> str:
    """CTEs `types`, `sums` and `scored` over the CTEs `findings` and a document source."""
    return f"""
types AS (
  SELECT doc_id, entity_type, count(*) AS n, sum(cast(confidence AS decimal(18,3))) AS sure, min(start_at) AS first_at,
         {_WEIGHT} AS weight FROM {findings} WHERE entity_type NOT IN {_in(fv.UNSCORED)} GROUP BY ALL),
sums AS (
  SELECT doc_id, sum(weight * sure) AS base, sum(CASE WHEN weight >= 6 THEN n ELSE 0 END) AS records,
         bool_or(entity_type IN {_in(fv.IDENTITY_TYPES)}) AND bool_or(entity_type IN {_in(fv.SENSITIVE_TYPES)}) AS toxic,
         bool_or(entity_type = 'HEALTH_INFO') AS health, bool_or(entity_type = 'SALARY') AS salary,
         bool_or(entity_type IN {_in(fv.ACCOUNT_TYPES)}) AS account, bool_or(entity_type = 'PERSON') AS person,
         list(cast(n AS varchar) || ' ' || (CASE WHEN n = 1 THEN {_ONE} ELSE {_MANY} END)
              ORDER BY weight DESC, n DESC, first_at) AS labels,
         list_sort(list(entity_type)) AS kinds, sum(n) AS finding_count
  FROM types GROUP BY doc_id),
bonused AS (
  SELECT *, CASE WHEN records >= 200 THEN 30 WHEN records >= 50 THEN 20 WHEN records >= 10 THEN 10 ELSE 0 END AS bonus
  FROM sums),
exact AS (
  SELECT *, CASE WHEN toxic THEN greatest(least(100, base + bonus), 40) ELSE least(100, base + bonus) END AS points
  FROM bonused),
scored AS (
  SELECT d.*, coalesce(cast(round(points, 1) AS double), 0) AS risk_score,
         CASE WHEN points IS NULL THEN 'Clean' WHEN points >= 40 THEN 'High' WHEN points >= 15 THEN 'Medium' ELSE 'Low' END AS risk_level,
         coalesce(toxic, false) AS toxic, coalesce(finding_count, 0) AS finding_count,
         coalesce(kinds, cast([] AS varchar[])) AS kinds,
         CASE WHEN points IS NULL THEN '{fv.CLEAN_REASON}' ELSE
           array_to_string(list_concat(labels[1:4], CASE WHEN len(labels) > 4 THEN [cast(len(labels) - 4 AS varchar) || ' other type(s)'] ELSE cast([] AS varchar[]) END), ' + ')
           || CASE WHEN toxic THEN '; ' || array_to_string(list_filter([CASE WHEN health THEN 'health data' END,
                CASE WHEN salary THEN 'salary details' END, CASE WHEN account THEN 'financial account data' END], lambda x: x IS NOT NULL), ' and ')
                || ' linked to ' || CASE WHEN person THEN 'a named person' ELSE 'a personal identifier' END || ' (toxic combination)' ELSE '' END
           || CASE WHEN bonus > 0 THEN '; bulk file with ' || cast(records AS varchar) || ' sensitive records (+' || cast(bonus AS varchar) || ' volume bonus)' ELSE '' END
         END AS reason
  FROM ({docs}) d LEFT JOIN exact USING (doc_id))"""


DOCS = """SELECT doc_id, 'corpus/' || source || '/' || lang || '/doc_' || cast(doc_id AS varchar) || '.txt' AS path,
  lang AS file_type, source AS sender, lang || ' document ' || cast(doc_id AS varchar) AS subject,
  o_orderdate AS date, text FROM documents LEFT JOIN orders ON doc_id = o_orderkey"""
SCORED = FINDINGS + "," + scored("findings", DOCS)
ROUND3 = "cast(round(avg(cast(confidence AS decimal(18,6))), 3) AS double)"


def _percent(part: str, whole: str) -> str:
    return (f"CASE WHEN {whole} = 0 THEN '0.0%' ELSE format('{{:.1f}}', "
            f"cast(round(cast({part} * 100 AS decimal(20,4)) / {whole}, 1) AS double)) || '%' END")


UNIQUE = """
unique_ids AS (
  SELECT CASE WHEN entity_type IN ('IN_PHONE', 'PHONE_NUMBER') THEN 'PHONE' ELSE entity_type END AS id_group,
         count(DISTINCT CASE WHEN entity_type = 'EMAIL_ADDRESS' THEN lower(trim(value))
               WHEN entity_type IN ('IN_PHONE', 'PHONE_NUMBER') THEN right(regexp_replace(value, '[^0-9]', '', 'g'), 10)
               ELSE regexp_replace(value, '[^0-9]', '', 'g') END) AS unique_values
  FROM findings WHERE entity_type IN """ + _in(fv.IDENTIFIER_TYPES) + " GROUP BY 1)"

_TOTALS = """
totals AS (
  SELECT count(*) AS docs_scanned, count(*) FILTER (risk_level = 'High') AS docs_high,
         count(*) FILTER (risk_level = 'Medium') AS docs_medium, count(*) FILTER (risk_level = 'Low') AS docs_low,
         count(*) FILTER (risk_level = 'Clean') AS docs_clean, count(*) FILTER (risk_level <> 'Clean') AS docs_with_pii,
         count(*) FILTER (toxic) AS docs_toxic FROM scored),
people AS (SELECT coalesce(sum(unique_values), 0) AS unique_identifiers_total,
                  coalesce(max(unique_values), 0) AS unique_individuals_estimate FROM unique_ids)"""

_BANK_RE = "(?i)(?:^|[^a-z])(?:" + "|".join(fv.BANK_WORDS) + ")(?:[^a-z]|$)"
_PREFIX40 = "substr(text, greatest(1, p - 40), p - greatest(1, p - 40))"




ORACLES: dict[str, str] = {}

for _name, _kind in (("email_spans", "EMAIL_ADDRESS"), ("ip_spans", "IP_ADDRESS"),
                     ("us_phone_spans", "PHONE_NUMBER"), ("card_luhn", "CREDIT_CARD")):
    ORACLES[_name] = FINDINGS + f"""
SELECT doc_id, entity_type, cast(start_at AS bigint) AS start_at, cast(start_at + length(value) AS bigint) AS end_at,
       cast(confidence AS double) AS confidence, value FROM findings WHERE entity_type = '{_kind}'"""

ORACLES["rows_to_text"] = """
SELECT c_custkey, 'Key: ' || cast(c_custkey AS varchar) || ' | Name: ' || c_name
  || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE ' | col3: ' || c_mktsegment END
  || ' | Balance: ' || cast(cast(c_acctbal AS decimal(12,2)) AS varchar) AS line FROM customer"""
ORACLES["table_documents"] = """
SELECT cast(floor(c_custkey / 50) AS bigint) AS doc_id,
  string_agg('Name: ' || c_name || ' | Segment: ' || c_mktsegment, chr(10) ORDER BY c_custkey) AS text
FROM customer GROUP BY 1"""

_KEY = "l_orderkey * 10 + l_linenumber"
_BODY = X.aadhaar_body(_KEY)
ORACLES["aadhaar_verhoeff"] = f"""
WITH b AS (SELECT DISTINCT l_orderkey, l_linenumber, {_BODY} AS body, l_partkey % 10 AS given FROM lineitem)
SELECT l_orderkey, l_linenumber, body, cast({_INV}[{verhoeff('body', 1)} + 1] AS varchar) AS check_digit,
       {verhoeff("(body || cast(given AS varchar))", 0)} = 0 AS given_is_valid, cast(given AS bigint) AS given FROM b"""

_AADHAAR_TEXT = """
CASE cast(l_linenumber % 5 AS int) WHEN 0 THEN 'Aadhaar: ' || n WHEN 1 THEN 'Account No: ' || n
  WHEN 2 THEN 'Account No: 77 | Aadhaar: ' || n WHEN 3 THEN 'Aadhaar ' || substr(n, 1, 4) || ' ' || substr(n, 5, 4) || ' ' || substr(n, 9, 4)
  ELSE 'Parcel ' || n || ' left' END"""


def label_at(words) -> str:
    return ("CASE WHEN regexp_matches(lower(w), '(?s)^(?:.*[^a-z])?(?:" + "|".join(words) + ")(?:[^a-z]|$)') "
            "THEN length(regexp_extract(lower(w), '(?s)^((?:.*[^a-z])?)(?:" + "|".join(words) + ")(?:[^a-z]|$)', 1)) ELSE -1 END")


ORACLES["aadhaar_label_score"] = f"""
WITH b AS (SELECT DISTINCT l_orderkey, l_linenumber, {_BODY} AS body FROM lineitem),
n AS (SELECT *, body || cast({_INV}[{verhoeff('body', 1)} + 1] AS varchar) AS n FROM b WHERE l_orderkey % 3 <> 0),
t AS (SELECT l_orderkey * 10 + l_linenumber AS doc_id, {_AADHAAR_TEXT} AS text FROM n),
m AS (SELECT doc_id, text, regexp_extract(text, '[0-9]{{12}}|[0-9]{{4}} [0-9]{{4}} [0-9]{{4}}') AS value FROM t),
p AS (SELECT doc_id, value, strpos(text, value) - 1 AS start_at,
             substr(text, 1, strpos(text, value) - 1) AS w FROM m),
l AS (SELECT *, {label_at(fv.AADHAAR_WORDS)} AS a, {label_at(fv.BANK_WORDS)} AS k FROM p)
SELECT doc_id, cast(start_at AS bigint) AS start_at, value,
       CASE WHEN contains(value, ' ') THEN 1.0 WHEN a < 0 OR k > a THEN 0.6 ELSE 1.0 END AS confidence
FROM l"""

_PAN = f"[A-Z]{{3}}[{fv.PAN_HOLDERS}][A-Z][0-9]{{4}}[A-Z]"
ORACLES["pan_ifsc"] = f"""WITH t AS (SELECT c_custkey AS doc_id, {X.CUSTOMER_CODES} AS text FROM customer),
{tokens("w", "t", "doc_id", "text", "[0-9A-Za-z_]+")}
SELECT doc_id, CASE WHEN regexp_full_match(value, '{_PAN}') THEN 'IN_PAN' ELSE 'IN_IFSC' END AS entity_type,
  cast(start_at AS bigint) AS start_at, value,
  CASE WHEN regexp_full_match(value, '{_PAN}') THEN 1.0 ELSE 0.6 END AS confidence
FROM w WHERE regexp_full_match(value, '{_PAN}|[A-Z]{{4}}0[A-Z0-9]{{6}}')"""

ORACLES["upi_vs_email"] = f"""WITH t AS (SELECT s_suppkey AS doc_id, {X.SUPPLIER_MAIL} AS text FROM supplier),
{tokens("w", "t", "doc_id", "text", "[0-9A-Za-z_.@-]+")}
SELECT doc_id, CASE WHEN regexp_full_match(value, '{_EMAIL}') THEN 'EMAIL_ADDRESS' ELSE 'IN_UPI' END AS entity_type,
  cast(start_at AS bigint) AS start_at, value,
  CASE WHEN regexp_full_match(value, '{_EMAIL}') THEN 1.0 ELSE 0.7 END AS confidence
FROM w WHERE regexp_full_match(value, '{_EMAIL}')
   OR regexp_full_match(lower(value), '[a-z0-9][a-z0-9._-]{{1,63}}@(?:{"|".join(fv.UPI_HANDLES)})')"""

ORACLES["in_phone"] = f"""WITH t AS (SELECT c_custkey AS doc_id, {X.CUSTOMER_PHONE} AS text FROM customer),
m AS (SELECT doc_id, text, regexp_extract(text, '(?:^|[^0-9+])((?:(?:[+]|00)91[ -]?|0)?[6-9][0-9]{{4}}[ -]?[0-9]{{5}})(?:[^0-9]|$)', 1) AS value FROM t)
SELECT doc_id, cast(strpos(text, value) - 1 AS bigint) AS start_at, value, cast(0.55 AS double) AS confidence
FROM m WHERE value <> ''"""

ORACLES["bank_account_context"] = f"""WITH t AS (SELECT o_orderkey AS doc_id, {X.ORDER_ACCOUNT} AS text FROM orders),
m AS (SELECT *, regexp_extract(text, '[0-9]{{12}}') AS value, strpos(text, regexp_extract(text, '[0-9]{{12}}')) AS p FROM t)
SELECT doc_id, cast(p - 1 AS bigint) AS start_at, value, cast(0.6 AS double) AS confidence
FROM m WHERE regexp_matches({_PREFIX40} || ' ', '{_BANK_RE}')"""

_MONEY = "(?i)(?:₹|rs[.]?|inr|usd|[$])[)]?\\s*[:=-]?\\s*[0-9]{1,3}(?:[,0-9]*[0-9])?(?:[.][0-9]{1,2})?|[0-9]+ LPA"
ORACLES["salary_context"] = f"""WITH t AS (SELECT o_orderkey AS doc_id, {X.ORDER_SALARY} AS text FROM orders),
m AS (SELECT *, regexp_extract(text, '{_MONEY}') AS value FROM t)
SELECT doc_id, cast(strpos(text, value) - 1 AS bigint) AS start_at, value, cast(0.55 AS double) AS confidence
FROM m WHERE value <> '' AND regexp_matches(text, '(?i)(?:^|[^a-z])(?:{"|".join(fv.SALARY_WORDS)})(?:[^a-z]|$)')"""

ORACLES["health_terms"] = f"""WITH t AS (SELECT conv_id * 100000 + turn AS doc_id, {X.TURN_HEALTH} AS text FROM conversations),
{tokens("w", "t", "doc_id", "text", "(?i)" + chr(92) + "b(?:" + "|".join(fv.HEALTH_TERMS) + ")" + chr(92) + "b")}
SELECT doc_id, cast(start_at AS bigint) AS start_at, value, cast(0.55 AS double) AS confidence FROM w"""

_NAME = "([A-Z][a-z]+(?: [A-Z][a-z]+){1,2})"
ORACLES["name_cues"] = f"""WITH t AS (SELECT c_custkey AS doc_id, {X.CUSTOMER_NAMES} AS text FROM customer),
m AS (SELECT *, regexp_extract(text, '(?:^|[^A-Za-z])(?i:{"|".join(fv.NAME_LABELS)})[ ]*:[ ]*{_NAME}', 1) AS a,
  regexp_extract(text, '(?:^|[^A-Za-z])(?i:dear|hi|hello|mr[.]?|mrs[.]?|ms[.]?|dr[.]?|shri|smt[.]?|customer|candidate|employee)[ ]+{_NAME}', 1) AS b FROM t),
v AS (SELECT doc_id, text, CASE WHEN a <> '' THEN a ELSE b END AS value, CASE WHEN a <> '' THEN 0.9 ELSE 0.6 END AS confidence FROM m)
SELECT doc_id, cast(strpos(text, value) - 1 AS bigint) AS start_at, value, cast(confidence AS double) AS confidence
FROM v WHERE value <> '' AND NOT list_has_any(string_split(lower(value), ' '), {list(fv.NAME_STOP_WORDS)})"""

ORACLES["resolve_overlaps"] = f"""
WITH b AS (SELECT o_orderkey AS doc_id, {X.aadhaar_body('o_orderkey')} AS body FROM orders),
n AS (SELECT doc_id, body || cast({_INV}[{verhoeff('body', 1)} + 1] AS varchar) AS n FROM b),
r AS (SELECT doc_id, CASE cast(doc_id % 5 AS int)
    WHEN 0 THEN [{{'k': 'BANK_ACCOUNT', 's': 12, 'v': n, 'c': 0.6}}]
    WHEN 1 THEN [{{'k': 'BANK_ACCOUNT', 's': 13, 'v': '4532017488265037', 'c': 0.6}}]
    WHEN 2 THEN [{{'k': 'CREDIT_CARD', 's': 5, 'v': '4532017488265037', 'c': 1.0}}]
    WHEN 3 THEN [{{'k': 'IN_PHONE', 's': 8, 'v': '+91 81234 09876', 'c': 0.55}}]
    ELSE [{{'k': 'BANK_ACCOUNT', 's': 8, 'v': '6543219870', 'c': 0.6}}, {{'k': 'SALARY', 's': 30, 'v': '₹91,250', 'c': 0.55}}] END AS f FROM n),
u AS (SELECT doc_id, unnest(f) AS x FROM r)
SELECT doc_id, x.k AS entity_type, cast(x.s AS bigint) AS start_at, cast(x.s + length(x.v) AS bigint) AS end_at,
       x.v AS value, cast(x.c AS double) AS confidence FROM u"""

ORACLES["mask_values"] = FINDINGS + """
SELECT doc_id, entity_type, cast(start_at AS bigint) AS start_at, masked_value, cast(confidence AS double) AS confidence FROM findings"""

ORACLES["masked_snippet"] = FINDINGS + """,
f AS (SELECT doc_id, list(struct_pack(s := start_at, e := start_at + length(value), t := '[[' || entity_type || '|' || masked_value || ']]')
             ORDER BY start_at) AS fs FROM findings WHERE start_at < 1500 GROUP BY doc_id)
SELECT doc_id, CASE WHEN fs IS NULL THEN substr(text, 1, 1500) ELSE
    array_to_string(list_transform(range(1, len(fs) + 1), lambda i:
      substr(text, cast(CASE WHEN i = 1 THEN 1 ELSE fs[i-1].e + 1 END AS bigint), cast(fs[i].s - CASE WHEN i = 1 THEN 0 ELSE fs[i-1].e END AS bigint)) || fs[i].t), '')
    || CASE WHEN fs[-1].e < 1500 THEN substr(text, cast(fs[-1].e + 1 AS bigint), cast(1500 - fs[-1].e AS bigint)) ELSE '' END END
  || CASE WHEN length(text) > 1500 THEN ' ...' ELSE '' END AS masked_snippet
FROM documents LEFT JOIN f USING (doc_id)"""

ORACLES["risk_scores"] = SCORED + """
SELECT doc_id, risk_score, risk_level, toxic, cast(finding_count AS bigint) AS finding_count,
       array_to_string(kinds, ';') AS entity_types FROM scored"""
ORACLES["risk_reasons"] = SCORED + " SELECT doc_id, reason FROM scored"
ORACLES["level_counts"] = SCORED + """
SELECT l.risk_level, count(s.doc_id) AS documents FROM (VALUES ('High'), ('Medium'), ('Low'), ('Clean')) l(risk_level)
LEFT JOIN scored s USING (risk_level) GROUP BY 1"""
ORACLES["documents_export"] = SCORED + """
SELECT doc_id, path, file_type, sender, strftime(date, '%Y-%m-%d') AS date, risk_score, risk_level, reason,
       cast(finding_count AS bigint) AS finding_count, toxic, array_to_string(kinds, ';') AS entity_types FROM scored"""
ORACLES["findings_summary"] = SCORED + f"""
SELECT f.doc_id, path, risk_level, entity_type, count(*) AS findings, cast(max(confidence) AS double) AS max_confidence,
       {ROUND3} AS avg_confidence FROM findings f JOIN scored USING (doc_id) GROUP BY ALL"""
ORACLES["entity_counts"] = FINDINGS + "," + UNIQUE + f"""
SELECT f.entity_type, count(*) AS findings, count(DISTINCT f.doc_id) AS documents, {ROUND3} AS avg_confidence,
       any_value(unique_values) AS unique_values
FROM findings f LEFT JOIN unique_ids u ON u.id_group = CASE WHEN f.entity_type IN ('IN_PHONE', 'PHONE_NUMBER') THEN 'PHONE' ELSE f.entity_type END
GROUP BY 1"""
ORACLES["unique_identifiers"] = FINDINGS + "," + UNIQUE + " SELECT id_group, unique_values FROM unique_ids"
_EXPOSURE = """round(60 * least(1, log10(1 + unique_individuals_estimate) / log10(100001))
  + CASE WHEN docs_with_pii = 0 THEN 0 ELSE 40 * (docs_high + 0.5 * docs_medium) / docs_with_pii END, 1)"""
ORACLES["exposure"] = SCORED + "," + UNIQUE + "," + _TOTALS + f"""
SELECT cast({_EXPOSURE} AS double) AS exposure_index,
  CASE WHEN {_EXPOSURE} >= 75 THEN 'Critical' WHEN {_EXPOSURE} >= 50 THEN 'High' WHEN {_EXPOSURE} >= 25 THEN 'Moderate' ELSE 'Low' END AS exposure_band,
  cast(round(60 * least(1, log10(1 + unique_individuals_estimate) / log10(100001)), 1) AS double) AS scale_component,
  cast(unique_individuals_estimate AS bigint) AS unique_individuals_estimate FROM totals, people"""
ORACLES["kpi_row"] = SCORED + "," + UNIQUE + "," + _TOTALS + f"""
SELECT docs_scanned, docs_high, docs_medium, docs_low, docs_clean, docs_with_pii, docs_toxic,
  cast(unique_identifiers_total AS bigint) AS unique_identifiers_total,
  {_percent('docs_with_pii', 'docs_scanned')} AS pii_share, {_percent('docs_high', 'docs_scanned')} AS high_share,
  'INR 250 crore' AS dpdp_ceiling, 'EUR 27.8 m' AS dpdp_ceiling_eur, 'EUR 20.0 m' AS gdpr_ceiling, 'EUR 500.0 m' AS turnover FROM totals, people"""
_REG = ", ".join(f"('{k}', '{a}', '{'Yes' if b else 'No'}', '{c}', '{'Yes' if c.startswith('Special') else 'No'}', '{'Yes' if d else 'No'}')"
                 for k, (a, b, c, d) in fv.REGULATION.items())
ORACLES["compliance_table"] = FINDINGS + f""",
reg AS (SELECT * FROM (VALUES {_REG}) r(entity_type, dpdp_category, dpdp_higher_risk, gdpr_category, gdpr_special_category, financial))
SELECT reg.*, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM findings JOIN reg USING (entity_type) GROUP BY ALL"""
ORACLES["type_totals"] = FINDINGS + f"""
SELECT entity_type, count(*) AS findings, count(DISTINCT doc_id) AS documents,
       upper(substr({_MANY}, 1, 1)) || substr({_MANY}, 2) AS label FROM findings GROUP BY entity_type"""
ORACLES["widest_types"] = FINDINGS + """
SELECT entity_type, count(DISTINCT doc_id) AS documents FROM findings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"""
ORACLES["filetype_level"] = SCORED + " SELECT file_type, risk_level, count(*) AS documents FROM scored GROUP BY ALL"
ORACLES["dominant_filetype"] = SCORED + """
SELECT file_type, count(*) AS documents, (SELECT count(*) FROM scored WHERE risk_level = 'High') AS docs_high
FROM scored WHERE risk_level = 'High' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"""
ORACLES["top_senders"] = SCORED + """,
best AS (SELECT sender FROM scored WHERE risk_level IN ('High', 'Medium') AND sender <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
SELECT sender, risk_level, count(*) AS documents FROM scored JOIN best USING (sender) WHERE risk_level IN ('High', 'Medium') GROUP BY ALL"""
ORACLES["explorer_filter"] = SCORED + """
SELECT doc_id, risk_level, risk_score, 'doc_' || cast(doc_id AS varchar) || '.txt' AS file_name, sender, reason
FROM scored WHERE risk_level IN ('High', 'Medium', 'Low') AND list_has_any(kinds, ['EMAIL_ADDRESS', 'IP_ADDRESS'])
  AND file_type IN ('en', 'fr') AND (contains(lower('doc_' || cast(doc_id AS varchar) || '.txt'), 'address') OR contains(lower(subject), 'address') OR contains(lower(reason), 'address'))"""
ORACLES["filter_choices"] = FINDINGS + """
SELECT DISTINCT 'entity_type' AS field, entity_type AS value FROM findings
UNION SELECT DISTINCT 'file_type', lang FROM documents UNION SELECT DISTINCT 'sender', source FROM documents WHERE source <> ''"""
ORACLES["special_counts"] = SCORED + f"""
SELECT count(*) AS documents, count(*) FILTER (list_contains(kinds, 'HEALTH_INFO')) AS health_documents,
  count(*) FILTER (list_has_any(kinds, {list(fv.ACCOUNT_TYPES) + ['SALARY']})) AS financial_documents,
  {_percent("count(*) FILTER (list_contains(kinds, 'HEALTH_INFO'))", "count(*)")} AS health_share,
  {_percent("count(*) FILTER (list_has_any(kinds, " + str(list(fv.ACCOUNT_TYPES) + ['SALARY']) + "))", "count(*)")} AS financial_share
FROM scored"""
_LEVEL = "CASE event_type WHEN 'error' THEN 'High' WHEN 'purchase' THEN 'Medium' WHEN 'signup' THEN 'Low' ELSE 'Clean' END"


def _timeline(source: str, grain: str, trunc: str, step: str) -> str:
    return f"""WITH d AS (SELECT * FROM ({source}) WHERE risk_level <> 'Clean' AND date IS NOT NULL),
p AS (SELECT unnest(generate_series(date_trunc('{trunc}', (SELECT min(date) FROM d)), date_trunc('{trunc}', (SELECT max(date) FROM d)), INTERVAL '{step}')) AS period),
g AS (SELECT period, risk_level FROM p, (SELECT DISTINCT risk_level FROM d)),
c AS (SELECT date_trunc('{trunc}', date) AS period, risk_level, count(*) AS n FROM d GROUP BY ALL)
SELECT '{grain}' AS grain, strftime(period, '%Y-%m-%d') AS period, risk_level, coalesce(n, 0) AS documents FROM g LEFT JOIN c USING (period, risk_level)"""


ORACLES["timeline_dense"] = _timeline(f"SELECT ts AS date, {_LEVEL} AS risk_level FROM events", "month", "month", "1 month")
ORACLES["timeline_quarters"] = _timeline(
    "SELECT o_orderdate AS date, CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'Low' ELSE 'Clean' END AS risk_level "
    "FROM orders", "quarter", "quarter", "3 months")

_TRUTH = """,
truth AS (SELECT doc_id, CASE WHEN toxic = 1 THEN ['IP_ADDRESS', 'CREDIT_CARD'] WHEN quality = 0 THEN ['EMAIL_ADDRESS'] ELSE cast([] AS varchar[]) END AS planted,
                 CASE WHEN toxic = 1 THEN 'Low' ELSE 'Clean' END AS expected_risk FROM labels),
matched AS (SELECT s.doc_id, s.kinds, s.risk_level, t.planted, t.expected_risk FROM scored s JOIN truth t USING (doc_id))"""
_ENTITY = ", ".join(f"('{t}')" for t in fv.EVALUATED)
_COUNTS = SCORED + _TRUTH + f""",
counts AS (SELECT entity_type,
    count(*) FILTER (list_contains(planted, entity_type) AND list_contains(kinds, entity_type)) AS tp,
    count(*) FILTER (NOT list_contains(planted, entity_type) AND list_contains(kinds, entity_type)) AS fp,
    count(*) FILTER (list_contains(planted, entity_type) AND NOT list_contains(kinds, entity_type)) AS fn
  FROM matched, (VALUES {_ENTITY}) e(entity_type) GROUP BY 1)"""
ORACLES["evaluate_labels"] = _COUNTS + """,
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r FROM counts)
SELECT entity_type, tp, fp, fn, cast(round(p, 3) AS double) AS precision, cast(round(r, 3) AS double) AS recall,
       cast(CASE WHEN p > 0 AND r > 0 THEN round(2 * p * r / (p + r), 3) END AS double) AS f1 FROM pr"""
ORACLES["micro_average"] = _COUNTS + """
SELECT coalesce(round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 3), 0.0) AS micro_precision,
       coalesce(round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 3), 0.0) AS micro_recall FROM counts"""
ORACLES["tier_confusion"] = SCORED + _TRUTH + " SELECT expected_risk AS expected, risk_level AS predicted, count(*) AS files FROM matched GROUP BY ALL"
ORACLES["tier_agreement"] = SCORED + _TRUTH + """
SELECT round(count(*) FILTER (expected_risk = risk_level) / count(*), 3) AS risk_tier_accuracy, count(*) AS files_evaluated FROM matched"""
ORACLES["retention_old"] = SCORED + """
SELECT doc_id, strftime(date, '%Y-%m-%d') AS date, risk_level FROM scored
WHERE date < TIMESTAMP '2001-06-30 00:00:00' - INTERVAL 3 YEAR AND risk_level <> 'Clean'"""
ORACLES["remediation_actions"] = SCORED + """,
r AS (
  SELECT 'P1' AS priority, 2 AS rule, doc_id, '' AS place FROM scored WHERE toxic
  UNION ALL SELECT 'P1', 3, doc_id, sender FROM scored WHERE list_contains(kinds, 'IN_AADHAAR')
  UNION ALL SELECT 'P2', 5, doc_id, sender FROM scored WHERE list_has_any(kinds, ['BANK_ACCOUNT', 'CREDIT_CARD', 'IN_UPI', 'IBAN_CODE'])
  UNION ALL SELECT 'P2', 8, doc_id, sender FROM scored WHERE risk_level IN ('High', 'Medium')
  UNION ALL SELECT 'P3', 9, doc_id, '' FROM scored WHERE date < TIMESTAMP '2001-06-30 00:00:00' - INTERVAL 3 YEAR AND risk_level <> 'Clean'
  UNION ALL SELECT 'P3', 10, doc_id, '' FROM scored WHERE risk_level = 'Clean'),
pl AS (SELECT priority, rule, place, count(*) AS n FROM r GROUP BY ALL),
pr AS (SELECT priority, rule, sum(n) AS total, arg_min(place, (-n, place)) AS place, max(n) AS top FROM pl GROUP BY ALL)
SELECT priority, CASE rule WHEN 2 THEN 'Review ' || total || ' ''toxic combination'' files first'
   WHEN 3 THEN 'Redact or mask Aadhaar numbers in ' || total || ' documents (mostly in ''' || place || ''': ' || top || ')'
   WHEN 5 THEN 'Vault or tokenise financial account details found in ' || total || ' documents (mostly in ''' || place || ''': ' || top || ')'
   WHEN 8 THEN 'Apply a retention policy and DLP rule to the mailbox ''' || place || ''' (' || top || ' high/medium-risk emails)'
   WHEN 9 THEN 'Review ' || total || ' documents with personal data older than 3 years for deletion'
   ELSE total || ' documents contain no detected PII: candidates for standard retention and AI/analytics use' END AS action,
   cast(CASE WHEN rule = 8 THEN top ELSE total END AS bigint) AS documents FROM pr"""

ORACLES["strip_html"] = r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?i)<br\s*/?>|</p>|</div>|</tr>', chr(10), 'g'),
  '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g') AS text FROM pages"""
ORACLES["truncate_flags"] = """
SELECT doc_id, length(substr(text, 1, 2000)) AS char_count, length(text) > 2000 AS truncated, md5(substr(text, 1, 2000)) AS digest FROM documents"""
ORACLES["subject_join"] = """
SELECT event_id, CASE WHEN event_type IN ('view', 'error') THEN props ELSE trim(event_type) || chr(10) || chr(10) || props END AS text FROM events"""
ORACLES["path_parts"] = """
SELECT doc_id, 'doc ' || cast(doc_id AS varchar) || '.txt' AS file_name,
  'doc_' || cast(doc_id AS varchar) || '.txt' AS safe_name,
  CASE WHEN doc_id % 3 = 0 THEN '(root folder)' ELSE source END AS under_root, 'data/' || 'corpus' AS elsewhere
FROM documents"""
ORACLES["money_formats"] = """
SELECT o_orderkey, CASE WHEN inr >= 10000000 THEN 'INR ' || format('{:,}', cast(round(cast(inr AS decimal(28,6)) / 10000000, 0) AS bigint)) || ' crore'
  WHEN inr >= 100000 THEN 'INR ' || format('{:,.1f}', cast(round(cast(inr AS decimal(28,6)) / 100000, 1) AS double)) || ' lakh'
  ELSE 'INR ' || format('{:,}', inr) END AS inr_text,
  CASE WHEN eur >= 1000000000 THEN 'EUR ' || format('{:,.2f}', cast(round(cast(eur AS decimal(28,6)) / 1000000000, 2) AS double)) || ' bn'
  WHEN eur >= 1000000 THEN 'EUR ' || format('{:,.1f}', cast(round(cast(eur AS decimal(28,6)) / 1000000, 1) AS double)) || ' m'
  ELSE 'EUR ' || format('{:,}', eur) END AS eur_text
FROM (SELECT o_orderkey, cast(floor(o_totalprice) AS bigint) * (1 + o_orderkey % 90) AS inr, cast(floor(o_totalprice) AS bigint) * (1 + o_orderkey % 9000) AS eur FROM orders)"""
ORACLES["ceilings"] = """
SELECT c_custkey, greatest(20000000.0, cast(c_custkey * 1000000 AS double) * 4 / 100) AS gdpr_ceiling_eur,
       2500000000.0 AS dpdp_ceiling_inr FROM customer"""
_SHIFT = "CASE cast(o_orderkey % 5 AS int) WHEN 0 THEN 7 WHEN 1 THEN 5 WHEN 2 THEN 7 ELSE 0 END"
ORACLES["mail_dates"] = f"""
SELECT o_orderkey, strftime(o_orderdate + INTERVAL 16 HOUR + INTERVAL 39 MINUTE + to_seconds(CASE WHEN o_orderkey % 5 = 2 THEN 0 ELSE 5 END)
  + to_hours({_SHIFT}), '%Y-%m-%d %H:%M:%S') AS date FROM orders"""
ORACLES["mail_messages"] = """
SELECT 'mail/' || cast(conv_id AS varchar) || '.' || cast(turn AS varchar) AS source_path, role || '@example.com' AS sender, 'a@example.com, b@example.com' AS recipients,
  '2001-05-14 23:39:00' AS date, 'Turn ' || cast(turn AS varchar) AS subject, 'Turn ' || cast(turn AS varchar) || chr(10) || chr(10) || text AS text FROM conversations"""
_LINES = """findings AS (
  SELECT l_orderkey AS doc_id, CASE cast(l_linenumber AS int) WHEN 1 THEN 'IN_AADHAAR' WHEN 2 THEN 'SALARY' WHEN 3 THEN 'PERSON'
    WHEN 4 THEN 'HEALTH_INFO' WHEN 5 THEN 'DATE_TIME' WHEN 6 THEN 'CUSTOM_TYPE' ELSE 'IN_PAN' END AS entity_type,
    (500 + l_partkey % 500) / 1000.0 AS confidence, l_partkey * 1000 + l_suppkey AS start_at, l_partkey FROM lineitem)"""
ORACLES["volume_scores"] = f"""WITH {_LINES},
{scored("findings", "SELECT o_orderkey AS doc_id FROM orders")}
SELECT doc_id, risk_score, risk_level, toxic, array_to_string(list_sort(list_concat(kinds, CASE WHEN doc_id IN (SELECT doc_id FROM findings WHERE entity_type = 'DATE_TIME') THEN ['DATE_TIME'] ELSE cast([] AS varchar[]) END)), ';') AS entity_types FROM scored"""
_IBAN_BBAN = "lpad(cast(s_suppkey * 104729 AS varchar), 18, '3')"
ORACLES["iban_ssn"] = f"""WITH t AS (SELECT s_suppkey AS doc_id, {_IBAN_BBAN} AS bban FROM supplier),
c AS (SELECT *, lpad(cast(98 - cast(bban || '131400' AS hugeint) % 97 AS varchar), 2, '0') AS chk FROM t)
SELECT doc_id, 'IBAN_CODE' AS entity_type, CAST(5 AS bigint) AS start_at, 'DE' || chk || bban AS value, cast(1.0 AS double) AS confidence FROM c WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 'US_SSN', CAST(32 AS bigint), lpad(cast(100 + doc_id % 900 AS varchar), 3, '0') || '-12-' || lpad(cast(1 + doc_id % 9000 AS varchar), 4, '0'), 0.5 FROM c
WHERE (100 + doc_id % 900) <> 666 AND (100 + doc_id % 900) < 900"""
ORACLES["date_spans"] = """
WITH t AS (SELECT o_orderkey AS doc_id, 'Order ' || cast(o_orderkey AS varchar) || ' placed on ' || CASE cast(o_orderkey % 3 AS int)
  WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'some day' ELSE strftime(o_orderdate, '%d/%m/%Y') END || ' by clerk' AS text FROM orders)
SELECT doc_id, regexp_extract(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}') AS value,
  cast(strpos(text, ' on ') + 3 AS bigint) AS start_at, cast(0.6 AS double) AS confidence FROM t WHERE doc_id % 3 <> 1"""
ORACLES["narrative"] = SCORED + "," + UNIQUE + "," + _TOTALS + f""",
w AS (SELECT entity_type, count(DISTINCT doc_id) AS n, {_MANY} AS label FROM findings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3),
wl AS (SELECT list(label || ' (' || n || ' files)' ORDER BY n DESC, entity_type) AS top FROM w),
hf AS (SELECT file_type, count(*) AS n FROM scored WHERE risk_level = 'High' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT 'Of ' || format('{{:,}}', docs_scanned) || ' documents scanned, ' || format('{{:,}}', docs_high) || ' (' || {_percent('docs_high', 'docs_scanned')}
 || ') contain high-risk personal data and a further ' || format('{{:,}}', docs_medium) || ' (' || {_percent('docs_medium', 'docs_scanned')}
 || ') are medium risk; ' || format('{{:,}}', docs_with_pii) || ' (' || {_percent('docs_with_pii', 'docs_scanned')} || ') contain some personal data.'
 || ' The most widespread types are ' || array_to_string(top[1:len(top)-1], ', ') || ' and ' || top[-1] || '.'
 || CASE WHEN docs_toxic > 0 THEN ' ' || format('{{:,}}', docs_toxic) || ' files link a person to health, salary or financial details - the combination that does the most harm if leaked - and together the scan found identifiers for at least '
    || format('{{:,}}', cast(unique_individuals_estimate AS bigint)) || ' distinct people.' ELSE '' END
 || CASE WHEN docs_high > 0 THEN ' High-risk data is concentrated in ' || upper((SELECT file_type FROM hf)) || ' files (' || (SELECT n FROM hf) || ' of ' || docs_high
    || '), so restricting access to those and masking identifiers is the fastest way to cut exposure.' ELSE '' END AS summary
FROM totals, people, wl"""
ORACLES["ranked_documents"] = SCORED + """
SELECT row_number() OVER (ORDER BY risk_score DESC, doc_id) AS rank, doc_id, risk_score, risk_level FROM scored WHERE risk_level <> 'Clean' ORDER BY 1 LIMIT 10"""
ORACLES["redact_top"] = SCORED + """,
top AS (SELECT row_number() OVER (ORDER BY risk_score DESC, doc_id) AS rank, * FROM scored WHERE risk_level <> 'Clean' ORDER BY 1 LIMIT 10),
f AS (SELECT doc_id, list(struct_pack(s := start_at, e := start_at + length(value), t := '<' || entity_type || '>') ORDER BY start_at) AS fs
      FROM findings WHERE doc_id IN (SELECT doc_id FROM top) GROUP BY doc_id)
SELECT rank, doc_id, path AS source, lpad(cast(rank AS varchar), 2, '0') || '_doc_' || cast(doc_id AS varchar) || '.txt.redacted.txt' AS redacted_name,
  '# REDACTED COPY' || chr(10) || '# Source: doc_' || cast(doc_id AS varchar) || '.txt' || chr(10) || '# Risk: ' || risk_level || ' ('
  || format('{:.1f}', risk_score) || ') - ' || reason || chr(10) || chr(10)
  || array_to_string(list_transform(range(1, len(fs) + 1), lambda i: substr(text, cast(CASE WHEN i = 1 THEN 1 ELSE fs[i-1].e + 1 END AS bigint),
       cast(fs[i].s - CASE WHEN i = 1 THEN 0 ELSE fs[i-1].e END AS bigint)) || fs[i].t), '')
  || substr(text, cast(fs[-1].e + 1 AS bigint)) AS content
FROM top JOIN f USING (doc_id)"""

_V6 = "[0-9A-Fa-f]{1,4}"
ORACLES["ipv6_spans"] = f"""WITH t AS (SELECT c_custkey AS doc_id, {X.CUSTOMER_IPV6} AS text FROM customer),
{tokens("w", "t", "doc_id", "text", "[0-9A-Za-z:.]*:[0-9A-Za-z:.]*")}
SELECT doc_id, 'IP_ADDRESS' AS entity_type, cast(start_at AS bigint) AS start_at, cast(start_at + length(value) AS bigint) AS end_at,
       cast(0.6 AS double) AS confidence, value FROM w
WHERE regexp_full_match(value, '(?:{_V6}:){{7}}{_V6}')
   OR (len(string_split(value, '::')) = 2 AND regexp_full_match(value, '(?:{_V6}(?::{_V6})*)?::(?:{_V6}(?::{_V6})*)?')
       AND value <> '::' AND len(list_filter(string_split(value, ':'), lambda g: g <> '')) <= 7)"""
ORACLES["intl_phone_spans"] = f"""WITH t AS (SELECT c_custkey AS doc_id, {X.CUSTOMER_DIALS} AS text FROM customer),
v AS (SELECT doc_id, text, string_split(text, ' now')[1][6:] AS value FROM t)
SELECT doc_id, 'PHONE_NUMBER' AS entity_type, cast(5 AS bigint) AS start_at, cast(5 + length(value) AS bigint) AS end_at,
       cast(0.5 AS double) AS confidence, value FROM v WHERE regexp_full_match(value, '[+][1-9][0-9]{{0,2}}(?:[ .-]?[0-9]{{2,5}}){{2,4}}')"""
ORACLES["card_lengths"] = f"""WITH t AS (SELECT c_custkey AS doc_id, {X.CUSTOMER_CARDS} AS text FROM customer),
v AS (SELECT doc_id, string_split(text, ' ')[2] AS value FROM t)
SELECT doc_id, 'CREDIT_CARD' AS entity_type, cast(4 AS bigint) AS start_at, cast(4 + length(value) AS bigint) AS end_at,
       cast(1.0 AS double) AS confidence, value FROM v WHERE regexp_full_match(value, '{_CARD}') AND {luhn('value')}"""
ORACLES["sure_spans"] = FINDINGS + """
SELECT doc_id, entity_type, cast(start_at AS bigint) AS start_at, cast(confidence AS double) AS confidence, value FROM findings WHERE confidence >= 0.6"""
ORACLES["blank_texts"] = f"""
SELECT c_custkey AS doc_id, 'Clean' AS risk_level, cast(0 AS double) AS risk_score, cast(0 AS bigint) AS finding_count, '{fv.CLEAN_REASON}' AS reason FROM customer"""
ORACLES["findings_joined"] = f"""WITH {_LINES}
SELECT f.doc_id, o_orderpriority AS path, o_orderstatus AS risk_level, entity_type, count(*) AS findings, cast(max(confidence) AS double) AS max_confidence,
       -- the exact mean rounded half up: an average of doubles falls on either side of a half
       (2 * sum(500 + l_partkey % 500) + count(*)) // (2 * count(*)) / 1000.0 AS avg_confidence FROM findings f JOIN orders ON f.doc_id = o_orderkey GROUP BY ALL"""
ORACLES["noisy_types"] = f"""WITH {_LINES},
n AS (SELECT entity_type, count(*) AS findings, count(DISTINCT doc_id) AS documents, upper(substr({_MANY}, 1, 1)) || substr({_MANY}, 2) AS label FROM findings GROUP BY entity_type)
SELECT *, true AS noisy FROM n UNION ALL SELECT *, false FROM n WHERE entity_type NOT IN {_in(fv.UNSCORED)}"""
ORACLES["far_findings"] = """
SELECT 'mail/' || cast(s_suppkey AS varchar) AS source_path, false AS truncated, cast(210011 AS bigint) AS start_at,
       'ABCPK' || lpad(cast(s_suppkey AS varchar), 4, '0') || 'F' AS value FROM supplier"""
ORACLES["csv_files"] = """
WITH t AS (SELECT s_suppkey, array_to_string(list_transform(range(1, 6001), lambda i: 'Name: n' || cast(i AS varchar) || ' | Account No: '
  || cast(s_suppkey * 10000 + i AS varchar)), chr(10)) AS text FROM supplier)
SELECT '/in/' || cast(s_suppkey AS varchar) || '.CSV' AS source_path, 'csv' AS file_type, cast(length(text) AS bigint) AS char_count,
       false AS truncated, md5(text) AS digest FROM t"""
ORACLES["mail_files"] = """
SELECT '/in/' || cast(conv_id AS varchar) || '.' || cast(turn AS varchar) || '.eml' AS source_path, role || '@example.com' AS sender,
  CASE WHEN turn % 3 = 1 THEN '2024-03-01 10:00:00' ELSE '2023-03-14 05:00:00' END AS date,
  '=?utf-8?q?Hi?=' || chr(10) || chr(10) || CASE WHEN turn % 3 = 1 THEN ' Turn ' || cast(turn AS varchar) || chr(10) || 'bye' ELSE text END AS text FROM conversations"""
ORACLES["skipped_files"] = """
SELECT '/in/' || cast(c_custkey AS varchar) || '.' || ['xlsx', 'docx', 'txt', 'jpg'][c_custkey % 4 + 1] AS path,
  CASE WHEN c_custkey % 4 = 2 THEN c_name || chr(65533) || '!' END AS text, c_custkey % 4 <> 2 AS is_skipped FROM customer WHERE c_custkey % 4 <> 3"""
ORACLES["mail_corpus"] = """
SELECT cast(conv_id AS varchar) || '.' || cast(turn AS varchar) AS file,
  'From: "Desk, ' || role || '"' || chr(10) || 'Subject: ""' || chr(10) || chr(10) || text || chr(10) || '"",' || chr(10) || '"' AS message FROM conversations"""
ORACLES["long_text_spans"] = f"""{FINDINGS}
SELECT doc_id, entity_type, start_at, start_at + length(value) AS end_at, cast(confidence AS double) AS confidence, value
FROM findings WHERE entity_type IN ('EMAIL_ADDRESS', 'IP_ADDRESS')"""
ORACLES["stored_span_resolution"] = """
WITH s AS (
  SELECT doc_id % 3 AS text_no, doc_id * 16 + n_chars % 31 AS start_at, doc_id * 16 + n_chars % 31 + 2 + n_chars % 97 AS end_at,
         ['BANK_ACCOUNT', 'EMAIL_ADDRESS', 'IN_PAN', 'IBAN_CODE'][n_chars % 4 + 1] AS entity_type, 500 + n_chars % 500 AS score,
         CASE WHEN n_chars % 4 IN (0, 2) THEN 0 ELSE 1 END AS own, cast(doc_id AS varchar) AS value FROM documents),
h AS (SELECT *, CASE WHEN start_at >= coalesce(max(end_at) OVER (PARTITION BY text_no ORDER BY start_at, end_at, value
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_at) THEN start_at END AS head FROM s),
i AS (SELECT *, max(head) OVER (PARTITION BY text_no ORDER BY start_at, end_at, value) AS island FROM h),
l AS (SELECT text_no, island, list({'k': -score, 'o': own, 'l': start_at - end_at, 's': start_at, 't': entity_type, 'e': end_at, 'v': value}
                                  ORDER BY -score, own, start_at - end_at, start_at, entity_type, end_at, value) AS ranked FROM i GROUP BY text_no, island),
g AS (SELECT text_no, unnest(list_reduce(list_transform(ranked, lambda x: [x]), lambda kept, x:
        CASE WHEN len(list_filter(kept, lambda k: k.s < x[1].e AND x[1].s < k.e)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS x FROM l)
SELECT text_no, x.s AS start_at, x.e AS end_at, x.t AS entity_type, cast(-x.k / 1000.0 AS double) AS confidence, x.v AS value FROM g"""
_STORED = """WITH f AS (SELECT 'DOC-' || cast(doc_id AS varchar) AS doc_id, upper(lang) AS entity_type, cast((500 + n_chars % 500) / 1000.0 AS double) AS confidence,
  'XX' || cast(n_chars % 100 AS varchar) AS masked_value, cast(n_chars % 1000 AS bigint) AS start_at, cast(1000 + doc_id % 3 AS bigint) AS scan_id FROM documents)"""
ORACLES["stored_scans"] = f"""{_STORED}
SELECT scan_id, doc_id, entity_type, confidence, CASE WHEN scan_id = 1001 THEN 'again' ELSE masked_value END AS masked_value, start_at
FROM f WHERE scan_id = 1000 OR scan_id = 1001 AND start_at % 2 = 0"""
ORACLES["scan_registry"] = f"""{_STORED}
SELECT kind, scan_id, count(*) AS n FROM f, (VALUES ('listed'), ('seen'), ('kept')) k(kind) WHERE scan_id <> 1001 GROUP BY kind, scan_id
UNION ALL SELECT 'unfinished', 1001, 1 UNION ALL SELECT 'swept', NULL, 1"""
ORACLES["scan_settings"] = f"""{_STORED}
SELECT 10 + start_at % 40 AS scan_id, 'folder' AS source, cast((10 + start_at % 40) % 4 / 10.0 AS double) AS min_score, count(*) AS docs_scanned, count(*) % 7 AS high
FROM f WHERE (10 + start_at % 40) % 4 >= 2 GROUP BY start_at % 40"""
ORACLES["document_lookup"] = f"""{_STORED}
SELECT cast(7 AS bigint) AS scan_id, doc_id, entity_type, confidence, masked_value, start_at FROM f WHERE doc_id IN ('DOC-1', 'DOC-55', 'DOC-199', 'DOC-123456789')"""
ORACLES["unique_across_scans"] = """
SELECT upper(lang) AS id_group, count(DISTINCT n_chars * 7 + doc_id % 5) AS unique_values, true AS close FROM documents GROUP BY upper(lang)"""
ORACLES["ordered_export"] = """
SELECT cast(conv_id AS varchar) || '.' || cast(turn AS varchar) AS path, text || ' said "' || role || '",' || chr(10) || 'and more' AS reason,
  cast(conv_id % 1000 / 10.0 AS double) AS risk_score, cast(turn AS bigint) AS turn FROM conversations"""
ORACLES["nested_folders"] = """
SELECT cast(conv_id % 3 AS int) AS a, cast(conv_id // 300 AS int) AS b, 'txt' AS file_type,
  string_agg(translate(role || ': ' || text, chr(13) || chr(10), '  '), chr(10) ORDER BY conv_id, turn) AS text FROM conversations GROUP BY conv_id % 3, conv_id // 300"""
ORACLES["masked_subjects"] = """
WITH c AS (SELECT conv_id % 3 AS kind, cast(conv_id AS varchar) || '.' || cast(turn AS varchar) AS doc_id, 't' || cast(turn AS varchar) || '.x@mail.org' AS mail,
  't' || repeat('*', length(cast(turn AS varchar)) + 2) || '@mail.org' AS hidden FROM conversations)
SELECT doc_id, CASE kind WHEN 0 THEN 'Re ' || hidden || ' and more' WHEN 1 THEN 'Write to ' || hidden ELSE 'Nothing' END AS subject,
  CASE kind WHEN 1 THEN 'Write to [[EMAIL_ADDRESS|' || hidden || ']] today' ELSE 'Body for [[EMAIL_ADDRESS|' || hidden || ']]' END AS masked_snippet,
  cast(1 AS bigint) AS finding_count FROM c"""
