"""Detection in texts that are too long for one row of spans.

A long text is cut into chunks at places over which no match of a rule can reach (``rules.BARRIER``), so that every match lies in one
chunk, a search that begins at a border is in step with one from the start of the text, and spans that overlap share their chunk. Each chunk
becomes a row with some characters of its neighbours, in which rules see their borders and context windows; spans
that begin there belong to the neighbour and are left out. Overlaps are resolved within the chunk, offsets are moved to the text's, and
findings leave as rows: the spans of a whole text are never together.

A text without such places stays one chunk. Rules other than those of ``rules.RULES`` need the same property.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilscan.config import DEFAULT, Settings
from veilscan.operators import detect as D, rules as R, spans as SP

#: Characters after which a chunk ends at the next place; texts of more than twice as many are cut.
CHUNK = 1 << 16


def cut(text: Column, size: int) -> Column:
    """The text in pieces of ``size`` characters and more, cut where no match can be. Joined they are the text.

    No piece but the last is shorter than what a rule looks at in its neighbour."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{max(size, R.LOOK)}}}.*?{R.BARRIER}|.+"), F.lit(0))


def chunked(docs: DataFrame, text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """The documents with a row per chunk instead of the text: its number, where it begins and ends in the text, and ``slice`` from ``slice_start`` on."""
    others = [c for c in docs.columns if c != text_col]

    def rows(pieces: Column, starts: Column) -> Column:
        def row(piece: Column, k: Column) -> Column:
            before = F.right(F.coalesce(F.get(pieces, k - 1), F.lit("")), F.lit(R.LOOK))
            after = F.left(F.coalesce(F.get(pieces, k + 1), F.lit("")), F.lit(R.LOOK))
            start = F.element_at(starts, k + 1)
            return F.struct(k.alias("chunk"), start.alias("chunk_start"), (start + F.length(piece)).alias("chunk_end"),
                            (start - F.length(before)).alias("slice_start"), F.concat(before, piece, after).alias("slice"))

        return F.transform(pieces, row)

    cut_up = SP.stage(docs.select(*others, cut(F.col(text_col), size).alias("_pieces")), "_lengths", F.transform("_pieces", lambda p: F.length(p)))
    placed = SP.stage(cut_up, "_starts", SP.starts(F.col("_lengths")))
    return placed.select(*others, F.inline(rows(F.col("_pieces"), F.col("_starts"))))


def long_findings(docs: DataFrame, settings: Settings = DEFAULT, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """Unmasked findings of long texts as rows, chunk by chunk: (id, start, end, entity_type, score, value).

    Chunks are dealt to tasks anew, so that one long text is worked on by many; this is the one place where text is shuffled."""
    chunks = chunked(docs.select(id_col, text_col), text_col, size)
    dealt = chunks.repartition(F.col(id_col), F.col("chunk"))
    spotted = SP.with_spans(dealt, settings, "slice").drop("slice")
    own = F.filter("spans", lambda s: (s["start"] + F.col("slice_start") >= F.col("chunk_start")) & (s["start"] + F.col("slice_start") < F.col("chunk_end")))
    found = SP.stage(spotted.withColumn("spans", own), "found", D.resolved_spans("spans"))
    moved = found.select(id_col, "slice_start", F.inline("found"))
    place = lambda name: (F.col(name) + F.col("slice_start")).alias(name)
    return moved.select(id_col, place("start"), place("end"), "entity_type", "score", "value")


def raw_findings(docs: DataFrame, settings: Settings = DEFAULT, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """Unmasked findings as rows, of texts of any length: short ones in one row as they are, long ones by chunk. Do not write it."""
    is_long = F.coalesce(F.length(text_col) > 2 * size, F.lit(False))
    return D.raw_findings(docs.where(~is_long), settings, id_col, text_col).unionByName(long_findings(docs.where(is_long), settings, id_col, text_col, size))
