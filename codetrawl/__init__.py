"""Secure-code triage over very large collections of source files, on Spark.

Files come in as a DataFrame, findings, root causes, routes, inventories and
reports come out as DataFrames. See README.md for the layout.
"""

from .options import Kept, Quotes, ScanOptions, Sources
from .plans.scan import scan_files

__all__ = ["Kept", "Quotes", "ScanOptions", "Sources", "scan_files"]
