"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: the zones that mail headers name
MAIL_ZONES = {"AST": "-0400", "ADT": "-0300", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
              "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def _bound(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _without_blocks(text: Column, name: str) -> Column:
    """Blocks of a tag become blanks. What stands behind the last closing tag holds none, so it is not looked through again and again."""
    def cut(head: Column) -> Column:
        return F.concat(F.regexp_replace(head, rf"(?is)<{name}.*?</{name}>", " "), F.substring(text, F.length(head) + 1, F.length(text)))

    return F.when(text.rlike(f"(?i)</{name}>"), _bound(F.regexp_extract(text, f"(?is)^.*</{name}>", 0), cut)).otherwise(text)


def _without_tags(text: Column) -> Column:
    """Tags become blanks; behind the last ``>`` there is none."""
    tail = F.substring_index(text, ">", -1)
    return _bound(tail, lambda t: F.concat(F.regexp_replace(F.left(text, F.length(text) - F.length(t)), r"<[^>]+>", " "), t))


def strip_html(html: Column) -> Column:
    """Readable text of a simple page: blocks and scripts out, breaks to newlines, tags to spaces.

    A block that is never closed stays, as does a tag; script blocks go before style blocks."""
    def tagged(text: Column) -> Column:
        # fixed values: the patterns here and above
        broken = F.regexp_replace(text, r"(?i)<br\s*/?>|</p>|</div>|</tr>", "\n")
        return _bound(broken, _without_tags)

    clean = _bound(html, lambda t: _bound(_without_blocks(t, "script"), lambda u: _bound(_without_blocks(u, "style"), tagged)))
    return F.regexp_replace(F.when(F.contains(html, F.lit("<")), clean).otherwise(html), r"[ \t]+", " ")


def join_subject(subject: Column, body: Column) -> Column:
    """Subject, blank line, body; the body alone when the subject is blank."""
    clean = F.btrim(F.coalesce(subject, F.lit("")), F.lit(" \t\r\n"))
    return F.when(clean != "", F.concat(clean, F.lit("\n\n"), body)).otherwise(body)


def truncate(text: Column, limit: int | None) -> dict[str, Column]:
    """Columns ``text`` (cut), ``char_count`` (after the cut) and ``truncated``; without a limit nothing is cut."""
    value = F.coalesce(text, F.lit(""))
    if limit is None:
        return {"text": value, "char_count": F.length(value), "truncated": F.lit(False)}
    cut = F.left(value, F.lit(limit))
    return {"text": cut, "char_count": F.length(cut), "truncated": F.length(value) > limit}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def safe_name(path: Column) -> Column:
    """File name usable anywhere: odd characters become one underscore, 80 characters at most."""
    return F.left(F.regexp_replace(file_name(path), "[^A-Za-z0-9._-]+", "_"), F.lit(80))


def top_folder(path: Column, root: str) -> Column:
    """First folder under ``root``; paths elsewhere give their first two parts."""
    base = root.rstrip("/")
    absolute = F.startswith(path, F.lit("/"))
    under = F.startswith(path, F.lit(base + "/")) if base not in ("", ".") else ~absolute
    inner = F.substring(path, F.lit(len(base) + 2), F.length(path)) if base not in ("", ".") else path
    parts = F.filter(F.split(inner, "/"), lambda p: (p != "") & (p != "."))
    inside = F.when(F.size(parts) > 1, F.get(parts, 0)).otherwise("(root folder)")
    all_parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    # an absolute path has the root itself as its first part
    named = F.when(absolute, F.concat(F.array(F.lit("/")), all_parts)).otherwise(all_parts)
    two = F.array_join(F.slice(named, 1, 2), "/")
    outside = F.when(F.size(named) > 2, two).otherwise(F.coalesce(F.get(named, 0), F.lit("")))
    return F.when(under, inside).otherwise(outside)


def percent(part: Column, whole: Column) -> Column:
    """Share with one decimal and a percent sign, ``0.0%`` of nothing."""
    share = F.coalesce(F.try_divide((part * 100).cast("decimal(20,1)"), whole), F.lit(0))
    return F.concat(F.round(share, 1).cast("decimal(20,1)").cast("string"), F.lit("%"))


def _grouped(amount: Column, decimals: int) -> Column:
    return F.format_number(F.round(amount.cast("double"), decimals), decimals)


def format_inr(amount: Column) -> Column:
    """Indian short form: crore, lakh or plain rupees."""
    return F.concat(F.lit("INR "), F.when(amount >= 10_000_000, F.concat(_grouped(amount / 10_000_000, 0), F.lit(" crore")))
                    .when(amount >= 100_000, F.concat(_grouped(amount / 100_000, 1), F.lit(" lakh")))
                    .otherwise(_grouped(amount, 0)))


def format_eur(amount: Column) -> Column:
    """Billions, millions or plain euros."""
    return F.concat(F.lit("EUR "), F.when(amount >= 1_000_000_000, F.concat(_grouped(amount / 1_000_000_000, 2), F.lit(" bn")))
                    .when(amount >= 1_000_000, F.concat(_grouped(amount / 1_000_000, 1), F.lit(" m")))
                    .otherwise(_grouped(amount, 0)))


def mail_date(value: Column) -> Column:
    """RFC 2822 date to a UTC timestamp; NULL when it cannot be read. No zone, or one nobody knows, means UTC.

    Years of two digits are 1969 to 2068."""
    bare = F.regexp_replace(F.trim(value), r"^[A-Za-z]{3,9},\s*", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s*\([^)]*\)\s*$", ""), r"\s+", " "))
    short = r"^(\d{1,2} [A-Za-z]{3}) (\d\d) "
    century = F.when(F.regexp_extract(bare, short, 2) > "68", "19").otherwise("20")
    bare = F.when(bare.rlike(short), F.concat(F.regexp_extract(bare, short, 1), F.lit(" "), century, F.regexp_replace(
        bare, short, "$2 "))).otherwise(bare)
    zone = F.upper(F.regexp_extract(bare, r"\s([A-Za-z]{1,5})$", 1))
    offset = F.coalesce(*[F.when(zone == name, offset) for name, offset in MAIL_ZONES.items()], F.lit("+0000"))
    bare = F.when(zone != "", F.concat(F.regexp_replace(bare, r"\s[A-Za-z]{1,5}$", " "), offset)).otherwise(bare)
    with_seconds = F.when(bare.rlike(r"\d:\d\d:\d\d"), bare).otherwise(
        F.regexp_replace(bare, r"(\d{1,2}:\d\d)", "$1:00"))
    zoned = F.when(with_seconds.rlike(r"[+-]\d{4}$"), with_seconds).otherwise(
        F.concat(with_seconds, F.lit(" +0000")))
    return F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z"))
