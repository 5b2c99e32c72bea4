"""A5/A6 sinks: nested histories as JSON, history documents as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_history_json(history: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A5: one JSON object per patient and month with its nested
    ``atenciones`` list, as the API's response body."""
    history.write.mode(mode).option("ignoreNullFields", "false").json(path)


def history_as_json(history: DataFrame) -> DataFrame:
    """A5 as a column: (documento_id, mes, json)."""
    cols = [c for c in history.columns]
    return history.select("documento_id", "mes", F.to_json(F.struct(*cols)).alias("json"))


def write_documents(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The rendered documents, one parquet row per part, with
    the export file name kept as a column. Output files are sized by the
    job's partitioning; nothing is gathered on the driver."""
    documents.write.mode(mode).parquet(path)
