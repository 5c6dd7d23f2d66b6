"""Run analyses in order, each on its own, with a status table."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyloom.sources.tables import write_result


def run_suite(spark: SparkSession, analyses: dict[str, Callable[[], DataFrame]], path: str | None = None,
              fmt: str = "json") -> DataFrame:
    """(analysis, status, rows, seconds, error); one failure does not stop the rest."""
    report = []
    for name, run in analyses.items():
        start = time.time()
        try:
            out = run()
            if path:
                write_result(out, f"{path}/{name}", fmt, "overwrite")
            report.append((name, "ok", out.count(), time.time() - start, None))
        except Exception as exc:  # the table carries the reason
            report.append((name, "failed", None, time.time() - start, f"{type(exc).__name__}: {exc}"[:500]))
    return spark.createDataFrame(
        report, "analysis string, status string, n_rows long, seconds double, error string"
    )
