"""Raw lines as entries: ``source, content, ts, id_log`` plus ``event_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE_SOURCE = "file-reader"  # fixed value: origin name of lines read from files


def log_entries(lines: DataFrame, source: Column, id_log: str, content: str = "content") -> DataFrame:
    """Attach the origin and the configured id to raw lines.

    ``lines`` keeps its other columns, among them ``ts`` and ``event_id``
    where the feed has them.
    """
    return lines.withColumnRenamed(content, "content").withColumns(
        {"source": source, "id_log": F.lit(id_log)}
    )


def file_entries(lines: DataFrame, id_log: str) -> DataFrame:
    return log_entries(lines, F.lit(FILE_SOURCE), id_log)
