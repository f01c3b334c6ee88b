"""What a scan reads, what it quotes and what it keeps. Choices become literals and filters in the plan."""

from __future__ import annotations

from dataclasses import dataclass

from . import fixed_values as fv


@dataclass(frozen=True)
class Sources:
    """Which files are opened. Nothing is left out for its size unless `largest` says so, and then with a skip row."""

    languages: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    pruned: tuple[str, ...] = ()  # directory names that are not entered, besides the usual ones
    ignore_file: bool = False  # honour the ignore list at the root of a repository
    largest: int | None = None  # bytes
    surface_prefix: str = ""  # put before repository-relative paths when the code surface is derived


@dataclass(frozen=True)
class Quotes:
    """How much of a file goes into a finding: lines around a match (0 for none), secrets hidden or not."""

    lines: int = fv.SNIPPET_LINES
    hide_secrets: bool = True


#: What happens to findings in test code: all stay, only hard-coded secrets stay, or none.
TEST_CODE = ("all", "secrets", "none")


@dataclass(frozen=True)
class Kept:
    """Which findings stay in the table, and which of them a report shows. Empty choices do not restrict."""

    severities: tuple[str, ...] = ()
    verdicts: tuple[str, ...] = ()
    confidence: int = 0
    evidence: int = 0
    frameworks: tuple[str, ...] = ()
    test_code: str = "all"
    hidden: tuple[str, ...] = ("suppressed",)  # verdicts that reports leave out

    def __post_init__(self):
        if self.test_code not in TEST_CODE:
            raise ValueError(f"test_code is one of {TEST_CODE}")


@dataclass(frozen=True)
class ScanOptions:
    sources: Sources = Sources()
    quotes: Quotes = Quotes()
    kept: Kept = Kept()
