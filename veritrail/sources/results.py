"""Result sinks: the spreadsheet of verdicts, JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions.patterns import safe_cell


def results_table(field_results: DataFrame, worklist: DataFrame, fields: list[str]) -> DataFrame:
    """One row per label in worklist order: rank, label, tier, headline and a verdict per field."""
    verdicts = field_results.groupBy("label_id").pivot("field", fields).agg(F.first("verdict"))
    return worklist.join(verdicts, "label_id", "left").select("rank", "label_id", "tier", "headline", *[F.col(f"`{f}`") for f in fields])


def write_csv(table: DataFrame, path: str, one_file: bool = True, spreadsheet: bool = False) -> None:
    """CSV with cells that no spreadsheet runs as formulas, in rank order.

    spreadsheet: lines end as spreadsheets want them, and a byte order mark before the header tells
    them the encoding. one_file gathers the sheet in one task; a large one is better off without.
    """
    cells = [safe_cell(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in table.dtypes]
    ordered = table.orderBy("rank")
    sheet = (ordered.coalesce(1) if one_file else ordered).select(*cells)
    if spreadsheet:
        sheet = sheet.withColumnRenamed(sheet.columns[0], f"\ufeff{sheet.columns[0]}")
    sheet.write.mode("overwrite").options(header=True, escape='"', lineSep="\r\n" if spreadsheet else "\n").csv(path)


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)
