"""Reads of cells as a stream: the row-wise header parser and a running count."""

from __future__ import annotations

from pyspark.sql import DataFrame

from readlake.operators import cells


def reads_per_cell(reads: DataFrame, header: str = "header") -> DataFrame:
    """Running counts by barcode of a streaming table of reads; for update or complete output."""
    return cells.reads_per_cell(cells.parse_headers(reads, header))
