"""Tables as text: a row becomes ``Header: value | Header: value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def row_text(columns: dict[str, Column]) -> Column:
    """One table row as a line; null and empty cells are left out."""
    cells = []
    for i, (header, value) in enumerate(columns.items(), 1):
        label = header.strip() if header else f"col{i}"
        text = value.cast("string")
        cells.append(F.when(text != "", F.concat(F.lit(f"{label}: "), text)))
    return F.concat_ws(" | ", *cells)


def rows_to_text(header: Column, rows: Column) -> Column:
    """Lines of a table held as arrays of cells; a missing header cell becomes ``colN``."""
    def label(i: Column) -> Column:
        name = F.get(header, i)
        numbered = F.concat(F.lit("col"), (i + 1).cast("string"))
        return F.when(F.coalesce(name, F.lit("")) == "", numbered).otherwise(F.btrim(name, F.lit(" \t\r\n")))

    def line(row: Column) -> Column:
        cells = F.transform(row, lambda v, i: F.when(
            F.coalesce(v, F.lit("")) != "", F.concat(label(i), F.lit(": "), v)))
        return F.array_join(F.filter(cells, lambda c: c.isNotNull()), " | ")

    return F.array_join(F.filter(F.transform(rows, line), lambda s: s != ""), "\n")


def table_documents(df: DataFrame, doc_key: Column, order: Column, line: Column) -> DataFrame:
    """Documents (doc_id, text) from table rows, one line per row in ``order``.

    All lines of a key meet in one task, so choose a key that bounds its rows, such as a range
    of a unique number. Whole files keep the row cap of the file readers.
    """
    return (
        df.select(doc_key.alias("doc_id"), order.alias("_order"), line.alias("_line"))
        .where(F.col("_line") != "")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("_order", "_line"))).alias("_lines"))
        .select("doc_id", F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n").alias("text"))
    )
