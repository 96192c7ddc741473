"""Grading outputs as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from promptmill.functions.grading import grade


def start_grading(outputs: DataFrame, path: str, checkpoint: str, grader: str = "strict",
                  **trigger) -> StreamingQuery:
    """Grade a stream of outputs into Parquet files. Grading looks at one row at a time, so there is no state."""
    graded = grade(outputs, grader)
    return (
        graded.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
