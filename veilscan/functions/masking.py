"""Masking, redaction and identifier digests as column expressions."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_ALNUM = r"[\p{L}\p{N}]"


def _mask_address(value: Column) -> Column:
    at = F.instr(value, "@")
    local = F.left(value, at - 1)
    stars = F.repeat(F.lit("*"), F.greatest(F.length(local) - 1, F.lit(2)))
    return F.concat(F.left(local, F.lit(1)), stars, F.lit("@"), F.substr(value, at + 1))


def _mask_words(value: Column) -> Column:
    words = F.filter(F.split(value, r"[\s\x{00A0}]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(
        F.left(w, F.lit(1)), F.repeat(F.lit("*"), F.greatest(F.length(w) - 1, F.lit(1))))), " ")


def _mask_amount(value: Column) -> Column:
    tidy = F.regexp_replace(value, r"^[^\p{L}\p{N}_₹$]+", "")
    tidy = F.regexp_replace(tidy, r"\)?\s*[:=]\s*", " ")
    return F.trim(F.regexp_replace(tidy, "[0-9]", "X"))


def _mask_identifier(value: Column) -> Column:
    count = F.length(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))
    later = rf"{_ALNUM}(?=(?:[^\p{{L}}\p{{N}}]*{_ALNUM}){{4}})"
    return F.when(count > 4, F.regexp_replace(value, later, "X")).otherwise(
        F.regexp_replace(value, "[A-Za-z0-9]", "X"))


def mask_value(value: Column, entity: Column) -> Column:
    """Preview of a value that never shows all of it."""
    v = F.trim(value)
    return (
        F.when(entity.isin("EMAIL_ADDRESS", "IN_UPI") & F.contains(v, F.lit("@")), _mask_address(v))
        .when(entity.isin("PERSON", "HEALTH_INFO", "LOCATION"), _mask_words(v))
        .when(entity == "SALARY", _mask_amount(v))
        .otherwise(_mask_identifier(v))
    )


def identifier_group(entity: Column) -> Column:
    """Types that name the same identifier count as one group."""
    return F.when(entity.isin("IN_PHONE", "PHONE_NUMBER"), F.lit("PHONE")).otherwise(entity)


def normalise_identifier(value: Column, entity: Column) -> Column:
    """One spelling per identifier, so that the same value counts once."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(entity.isin("EMAIL_ADDRESS", "IN_UPI"), F.lower(F.trim(value)))
        .when(entity.isin("IN_PAN", "IBAN_CODE"), F.upper(F.regexp_replace(value, r"\s", "")))
        .when(entity.isin("IN_PHONE", "PHONE_NUMBER"), F.right(digits, F.lit(10)))
        .otherwise(digits)
    )


def key_table(spark: SparkSession, key: bytes | None = None) -> DataFrame:
    """HMAC pads of a key as one row of data; a fresh key unless one is given."""
    key = os.urandom(32) if key is None else key
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = key.ljust(64, b"\0")
    inner = bytearray(b ^ 0x36 for b in block)
    outer = bytearray(b ^ 0x5C for b in block)
    return spark.createDataFrame([(1, inner, outer)], "_one int, inner_pad binary, outer_pad binary")


def keyed_digest(group: Column, normal: Column, inner_pad: Column, outer_pad: Column) -> Column:
    """``GROUP:`` and the first 20 hex digits of HMAC-SHA256(key, ``GROUP:value``)."""
    message = F.concat(group, F.lit(":"), normal).cast("binary")
    inner = F.unhex(F.sha2(F.concat(inner_pad, message), 256))
    return F.concat(group, F.lit(":"), F.left(F.sha2(F.concat(outer_pad, inner), 256), F.lit(20)))


def _replaced(text: Column, findings: Column, tag, limit: Column) -> Column:
    """``text`` up to ``limit`` with every finding replaced; findings are in text order."""
    size = F.size(findings)

    def piece(f: Column, i: Column) -> Column:
        since = F.when(i == 0, 0).otherwise(F.get(findings, i - 1)["end"])
        return F.concat(F.substring(text, since + 1, f["start"] - since), tag(f))

    done = F.when(size > 0, F.get(findings, size - 1)["end"]).otherwise(0)
    tail = F.when(done < limit, F.substring(text, done + 1, limit - done)).otherwise("")
    return F.concat(F.array_join(F.transform(findings, piece), ""), tail)


def masked_snippet(head: Column, total_chars: Column, findings: Column, max_chars: int,
                   markers: bool = True) -> Column:
    """Preview of a text with every finding masked.

    ``head`` is at least the first ``max_chars`` characters, ``findings`` the array of
    (start, end, entity_type, masked_value) in text order.
    """
    shown = F.filter(findings, lambda f: f["start"] < max_chars)

    def tag(f: Column) -> Column:
        if markers:
            return F.concat(F.lit("[["), f["entity_type"], F.lit("|"), f["masked_value"], F.lit("]]"))
        return f["masked_value"]

    more = F.when(total_chars > max_chars, F.lit(" ...")).otherwise("")
    return F.concat(_replaced(head, shown, tag, F.lit(max_chars)), more)


def masked_text(text: Column, findings: Column) -> Column:
    """The whole text with every finding that begins in it masked, those that reach over its end too."""
    inside = F.filter(findings, lambda f: f["start"] < F.length(text))
    return _replaced(text, inside, lambda f: f["masked_value"], F.length(text))


def redact_text(text: Column, findings: Column, skip: tuple[str, ...] = ("DATE_TIME",)) -> Column:
    """Text with every finding replaced by ``<TYPE>``; skipped types stay readable."""
    shown = F.filter(findings, lambda f: ~f["entity_type"].isin(*skip))
    return _replaced(text, shown, lambda f: F.concat(F.lit("<"), f["entity_type"], F.lit(">")), F.length(text))
