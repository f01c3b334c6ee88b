"""Column expressions over file paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_parts(path: Column) -> Column:
    """Directory names of a file path, outermost first."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def language_of(path: Column) -> Column:
    """Language by file extension, null when the extension is not a known one."""
    name = base_name(path)
    extension = F.lower(F.regexp_extract(name, r"^.+\.([^./]+)$", 1))
    cases = None
    for language in dict.fromkeys(fv.LANGUAGE_BY_EXTENSION.values()):
        names = [e for e, l in fv.LANGUAGE_BY_EXTENSION.items() if l == language]
        condition = extension.isin(*names)
        cases = F.when(condition, F.lit(language)) if cases is None else cases.when(condition, F.lit(language))
    return cases


def surface_of(path: Column) -> Column:
    """Code surface of a path; the first surface of the fixed list that applies."""
    text = F.lower(path)
    parts = F.split(text, "/")
    cases = None
    for surface, names, substring in fv.SURFACES:
        condition = F.lit(False)
        if names:
            condition = F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
        if substring:
            condition = condition | text.contains(substring)
        cases = F.when(condition, F.lit(surface)) if cases is None else cases.when(condition, F.lit(surface))
    return cases.otherwise(F.lit("unknown"))


def glob_regex(glob: str) -> str:
    """Regular expression for a path pattern that matches from the right."""
    absolute = glob.startswith("/")
    parts = [p for p in glob.split("/") if p and p != "."]
    translated = []
    for part in parts:
        out = ""
        i = 0
        while i < len(part):
            char = part[i]
            close = part.find("]", i + 2) if char == "[" else -1
            if char == "*":
                out += "[^/]*"
            elif char == "?":
                out += "[^/]"
            elif close > 0:
                body = part[i + 1 : close].replace("\\", "\\\\")
                out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
                i = close
            else:
                out += re.escape(char)
            i += 1
        translated.append(out)
    return ("^/?" if absolute else "(?:^|/)") + "/".join(translated) + r"\z"


def matches_any_glob(path: Column, globs) -> Column:
    condition = F.lit(False)
    for glob in globs:
        condition = condition | path.rlike(glob_regex(glob))
    return condition


def directory_prefixes(path: Column) -> Column:
    """All ancestor directories of a file path, outermost first."""
    parts = parent_parts(path)
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
                    lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    )
