"""Folders of mixed files and mail corpora as document frames.

Parsing gives one frame, in which a file that cannot be read is a row with an ``error``; ``split`` makes
``(documents, skipped)`` of it, which is what the readers return. Whoever needs both from one pass, as a scan does, takes
the parsed frame.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilscan.config import DEFAULT, Settings
from veilscan.functions import text as T
from veilscan.session import spread_small
from veilscan.sources import csv_ranges, parsers as P
from veilscan.sources.tables import rows_to_text

DOCUMENT_COLUMNS = ("doc_id", "source_path", "file_type", "sender", "recipients", "date", "subject",
                    "text", "char_count", "truncated")
#: Bytes of files, or characters of messages, that a task holds in parsed form at a time; a larger one alone.
PARSED_AT_ONCE = 1 << 20


def _any_case(extension: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def _binary(spark: SparkSession, paths: str | list[str], extensions: tuple[str, ...]) -> DataFrame:
    """Files with one of the extensions; the name filter runs while listing, before any read."""
    reader = (spark.read.format("binaryFile")
              .option("pathGlobFilter", "*.{" + ",".join(_any_case(e) for e in extensions) + "}"))
    if isinstance(paths, str):
        reader = reader.option("recursiveFileLookup", "true")
    try:
        return reader.load(paths)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc.getCondition()):
            raise FileNotFoundError(f"Folder not found: {paths}") from exc
        raise


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:(?://)?", "")


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def _wanted(files: DataFrame, settings: Settings) -> DataFrame:
    name = T.file_name(F.col("path"))
    return files.where(~name.isin(*settings.excluded_names) & ~F.startswith(name, F.lit("~$")))


def _listed_path() -> Column:
    """The path of a file as a function of its listing alone, so that a filter on it is applied before any file is opened."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def last_path(spark: SparkSession, folder: str, limit: int, settings: Settings = DEFAULT) -> str | None:
    """The path of the ``limit``-th file, or of the last one if there are fewer: all that the driver gets of the listing."""
    listed = _wanted(_binary(spark, folder, settings.extensions).select("path"), settings)
    return listed.orderBy("path").limit(limit).agg(F.max("path")).first()[0]


def _literal_path(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def document_id(path: Column) -> Column:
    """Stable id of a document; a running number would need all files in one partition.

    128 bits, so that ids stay unique over tens of billions of documents.
    """
    return F.concat(F.lit("DOC-"), F.left(F.sha2(path, 256), F.lit(32)))


def _sheet_text(tables: Column, kind: Column) -> Column:
    """Tables as text: sheets carry their title, two-column document tables are label and value."""
    def one(t: Column) -> Column:
        header, rows = F.get(t["cells"], 0), F.slice(t["cells"], F.lit(2), F.greatest(F.size(t["cells"]), F.lit(1)))
        lines = rows_to_text(F.coalesce(header, F.array().cast("array<string>")), rows)
        pairs = F.array_join(F.transform(t["cells"], lambda r: F.concat(
            F.coalesce(F.get(r, 0), F.lit("")), F.lit(": "), F.coalesce(F.get(r, 1), F.lit("")))), "\n")
        paired = (kind == "docx") & F.forall(t["cells"], lambda r: F.size(r) == 2)
        titled = F.when(t["title"].isNotNull(), F.concat(F.lit("Sheet: "), t["title"], F.lit("\n"))).otherwise("")
        return F.when(paired, pairs).otherwise(F.concat(titled, lines))

    return F.transform(tables, one)


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents, and what was skipped: (path, error)."""
    return (parsed.where(F.col("error").isNull()).drop("error"),
            parsed.where(F.col("error").isNotNull()).select(F.col("source_path").alias("path"), "error"))


def _assemble(parsed: DataFrame, settings: Settings) -> DataFrame:
    """Parsed rows (path, file_type, mtime and the parser columns) to documents with ``error``."""
    pieces = F.transform(F.coalesce("parts", F.array().cast("array<struct<kind:string,text:string>>")), lambda p:
                         F.when(p["kind"] == "html", T.strip_html(p["text"])).otherwise(p["text"]))
    sheets = _sheet_text(F.coalesce("tables", F.array().cast(
        "array<struct<title:string,cells:array<array<string>>>>")), F.col("file_type"))
    sheet_gap = F.when(F.col("file_type") == "xlsx", F.array_join(sheets, "\n\n")).otherwise(
        F.array_join(sheets, "\n"))
    body = F.concat_ws("\n", F.when(F.size(pieces) > 0, F.array_join(pieces, "\n")),
                       F.when(F.size(sheets) > 0, sheet_gap))
    subject = F.btrim(F.coalesce("subject", F.lit("")), F.lit(" \t\r\n"))
    cut = T.truncate(F.col("_text"), settings.max_text_length)
    return (
        parsed.withColumn("_text", F.when(F.col("error").isNull(), T.join_subject(subject, body)))
        .select(
            document_id(F.col("path")).alias("doc_id"), F.col("path").alias("source_path"), "file_type",
            F.coalesce("sender", F.lit("")).alias("sender"),
            F.coalesce("recipients", F.lit("")).alias("recipients"),
            F.coalesce(F.try_to_timestamp("date"), "mtime").alias("date"),
            T.truncate(subject, settings.max_text_length)["text"].alias("subject"),
            cut["text"].alias("text"), cut["char_count"].alias("char_count"), cut["truncated"].alias("truncated"), "error")
    )


def in_pieces(batch: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    """The rows of a batch, PARSED_AT_ONCE of a column at a time: what is parsed takes many times the room of what was read."""
    low, held = 0, 0
    for k, value in enumerate(batch[column]):
        size = len(value) if value is not None else 0
        if k > low and held + size > PARSED_AT_ONCE:
            yield batch.iloc[low:k]
            low, held = k, 0
        held += size
    if low < len(batch):
        yield batch.iloc[low:]


def read_folder(spark: SparkSession, folder: str, limit: int | None = None,
                settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Every supported file below a folder, or the first ``limit`` of them by path."""
    return split(parsed_folder(spark, folder, limit, settings))


def parsed_folder(spark: SparkSession, folder: str, limit: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """The same as one frame, with ``error``."""
    return _read(spark, folder, settings, last_path(spark, folder, limit, settings) if limit else None)


def read_paths(spark: SparkSession, paths: list[str], settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The given files only."""
    return split(_read(spark, [_literal_path(p) for p in paths], settings))


def _read(spark: SparkSession, where: str | list[str], settings: Settings, last: str | None = None) -> DataFrame:
    # two listings by name, so that no file is read for a branch that does not parse it
    groups = [tuple(e for e in settings.extensions if (e == "txt") == plain) for plain in (False, True)]
    listed = [(_binary(spark, where, g), settings.with_(extensions=g)) for g in groups if g]
    frames = [parsed_files(f if last is None else f.where(_listed_path() <= last), own) for f, own in listed]
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def parsed_files(files: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Files in a frame (``path``, ``content``, ``modificationTime``) as documents with ``error``."""
    max_rows = settings.max_table_rows

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (piece for whole in batches for piece in in_pieces(whole, "content")):
            records = [P.attempt(P.PARSERS[kind], bytes(content), max_rows)
                       for kind, content in zip(batch["file_type"], batch["content"])]
            yield pd.concat([batch[["path", "file_type", "mtime"]],
                             pd.DataFrame(records, index=batch.index)], axis=1)

    files = _wanted(files, settings)
    named = (F.col("path"), _extension(F.col("path")).alias("file_type"), F.col("modificationTime").alias("mtime"))
    schema = "path string, file_type string, mtime timestamp, " + P.PARSED
    kinds = [e for e in settings.extensions if e != "txt"]
    frames = [files.select(*named, "content").where(F.col("file_type").isin(*kinds)).mapInPandas(parse, schema)] if kinds else []
    if "txt" in settings.extensions:
        # plain text needs no Python: bad bytes become U+FFFD
        body = F.make_valid_utf8(F.col("content").cast("string"))
        frames.append(files.where(_extension(F.col("path")) == "txt").select(
            *named, F.lit(None).cast("string").alias("sender"), F.lit(None).cast("string").alias("recipients"),
            F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("subject"),
            F.array(F.struct(F.lit("text").alias("kind"), body.alias("text"))).alias("parts"),
            F.lit(None).cast("array<struct<title:string,cells:array<array<string>>>>").alias("tables"),
            F.lit(None).cast("string").alias("error")))
    parsed = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    return _assemble(parsed.withColumn("path", _plain_path(F.col("path"))), settings)


def read_mail_corpus(spark: SparkSession, path: str, limit: int | None = None, settings: Settings = DEFAULT,
                     prefix: str = "enron") -> tuple[DataFrame, DataFrame]:
    """A CSV of raw messages (``file``, ``message``): all of them, or the first ``limit`` by file if a limit is given.

    There is no file date to fall back on.
    """
    return split(parsed_messages(raw_messages(spark, path, limit), settings, prefix))


def raw_messages(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The messages of a mail corpus, not parsed yet. Many tasks read one file."""
    try:
        raw = csv_ranges.read(spark, path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc.getCondition()):
            raise FileNotFoundError(f"Mail corpus not found: {path}") from exc
        raise
    if not {"file", "message"} <= set(raw.columns):
        raise ValueError(f"{path} needs the columns 'file' and 'message', it has {raw.columns}")
    rows = raw.select("file", "message")
    return spread_small(rows if limit is None else rows.orderBy("file", "message").limit(limit))


def read_messages(rows: DataFrame, settings: Settings = DEFAULT,
                  prefix: str = "mail") -> tuple[DataFrame, DataFrame]:
    """Raw RFC 822 messages in a frame (``file``, ``message``) as documents and skipped rows."""
    return split(parsed_messages(rows, settings, prefix))


def message_path(file: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix + "/"), F.coalesce(file, F.lit("?")))


def parsed_messages(rows: DataFrame, settings: Settings = DEFAULT, prefix: str = "mail") -> DataFrame:
    """The same as one frame, with ``error``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (piece for whole in batches for piece in in_pieces(whole, "message")):
            records = [P.attempt(P.parse_mail_text, m) for m in batch["message"]]
            yield pd.concat([batch[["file"]], pd.DataFrame(records, index=batch.index)], axis=1)

    parsed = rows.mapInPandas(parse, "file string, " + P.PARSED).select(
        message_path(F.col("file"), prefix).alias("path"),
        F.lit(prefix + "_email").alias("file_type"), F.lit(None).cast("timestamp").alias("mtime"),
        "sender", "recipients", "date", "subject", "parts", "tables", "error")
    return _assemble(parsed, settings)
