"""The scan over files that keep arriving.

The line rules keep no state: files of a stream go through the same plan as a table of files.
The function rule and everything that groups are left to the batch jobs over the written
findings.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.correlate import with_root_cause
from ..operators.rules import CustomRule
from ..options import ScanOptions
from ..plans.scan import local_findings


def stream_findings(files: DataFrame, options: ScanOptions = ScanOptions(),
                    custom_rules: Iterable[CustomRule] = ()) -> DataFrame:
    """Findings of a streaming DataFrame of source files."""
    return with_root_cause(local_findings(files, options, custom_rules, function_rules=False))


def write_findings(findings: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append findings as Parquet; restarts go on from the checkpoint."""
    writer = findings.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start()
