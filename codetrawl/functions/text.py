"""Column expressions over source text: lines, masking, contexts, redaction.

Everything is built-in Spark SQL. A file is one row, so per-file work (splitting,
masking, contexts) needs no shuffle; the size of a row is bounded by the file size
limit of the source.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv

# one class, which the matcher finds faster than a choice
LINE_BREAK = r"[\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029](?:(?<=\r)\n)?"

# Tokens of a source text. Groups and inner runs are possessive: the JVM matcher then
# works in a loop instead of recursing, so very long literals cannot overflow its stack.
_SLASH_COMMENTS = r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?"
_DOUBLE = r'"(?:[^"\\]++|\\.)*+"?'
_SINGLE = r"'(?:[^'\\]++|\\.)*+'?"
_TEMPLATE = r"`(?:[^`\\]++|\\.)*+`?"
_RAW = r"`[^`]*+`?"
_PY_TRIPLE = r'"""(?:[^"\\]++|\\.|"(?!""))*+(?:""")?|\'\'\'(?:[^\'\\]++|\\.|\'(?!\'\'))*+(?:\'\'\')?'
_PY_QUOTED = r'"(?:[^"\\\n]++|\\.)*+"?|\'(?:[^\'\\\n]++|\\.)*+\'?'
TOKENS = {
    "java": rf"(?s){_SLASH_COMMENTS}|{_DOUBLE}|{_SINGLE}|[^/\"']++|.",
    "javascript": rf"(?s){_SLASH_COMMENTS}|{_DOUBLE}|{_SINGLE}|{_TEMPLATE}|[^/\"'`]++|.",
    "go": rf"(?s){_SLASH_COMMENTS}|{_DOUBLE}|{_SINGLE}|{_RAW}|[^/\"'`]++|.",
    "python": rf"(?s)#[^\n]*+|{_PY_TRIPLE}|{_PY_QUOTED}|[^#\"']++|.",
}
TOKENS["typescript"] = TOKENS["javascript"]
FETCHED_LINES = 32
# the first three letters of the names in KEY_VALUE_PARTS and what equals them without regard to case
_NAME_AHEAD = r"(?=[aAcCpPsStT\u017f][aAeEoOpPrRuU][cCiIkKoOsStT\u0130\u0131\u017f\u212a])"


def pattern(regex: str) -> str:
    """The regex with Unicode word and space classes, whatever the JVM version."""
    return "(?U)" + regex


def matches(column: Column, regex: str) -> Column:
    return column.rlike(pattern(regex))


def extract(column: Column, regex: str, group: int) -> Column:
    """Group of the first match; empty when there is none."""
    return F.regexp_extract(column, pattern(regex), group)


def normal_breaks(text: Column) -> Column:
    """Every kind of line break becomes a line feed."""
    return F.regexp_replace(text, LINE_BREAK, "\n")


def split_lines(text: Column, original: Column | None = None) -> Column:
    """Lines of a text with normal breaks; no trailing empty line, none for an empty text.

    ``original`` is a cheap column that is empty exactly when ``text`` is; give it when
    ``text`` is an expensive expression, which then appears (and runs) once only.
    """
    # a list of one, so that the lines are a name of their own and cut once
    whole = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.when(
        F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines))
    return F.when((text if original is None else original) == "", F.array().cast("array<string>")).otherwise(F.get(whole, F.lit(0)))


def tokens(text: Column, language: Column) -> Column:
    """Comment, literal and code tokens of a text; the whole text as one token otherwise."""
    cases = None
    for names in (("java",), ("javascript", "typescript"), ("go",), ("python",)):
        condition = language.isin(*names)
        value = F.regexp_extract_all(text, F.lit(TOKENS[names[0]]), F.lit(0))
        cases = F.when(condition, value) if cases is None else cases.when(condition, value)
    return cases.otherwise(F.array(text))


def _blank(token: Column) -> Column:
    return F.when(token.contains("\n"), F.regexp_replace(token, r"[^\n]", " ")).otherwise(
        F.repeat(F.lit(" "), F.length(token))
    )


def _is_comment(token: Column, language: Column) -> Column:
    slashes = token.startswith("//") | token.startswith("/*")
    return F.when(language == "python", token.startswith("#")).otherwise(slashes)


def _is_literal(token: Column, language: Column) -> Column:
    template = token.startswith("`") & (language != "java") & (language != "python")
    return token.startswith('"') | token.startswith("'") | template


def without_comments(token_array: Column, language: Column) -> Column:
    """Text with comments blanked; offsets, line numbers and literals stay."""
    return F.array_join(
        F.transform(token_array, lambda t: F.when(_is_comment(t, language), _blank(t)).otherwise(t)), ""
    )


def code_only(token_array: Column, language: Column) -> Column:
    """Text with comments and literals blanked; offsets and line numbers stay."""
    return F.array_join(
        F.transform(
            token_array,
            lambda t: F.when(_is_comment(t, language) | _is_literal(t, language), _blank(t)).otherwise(t),
        ),
        "",
    )


def window_text(lines: Column, line_no: Column, before: int, after: int) -> Column:
    """Lines ``line_no - before`` to ``line_no + after`` of a file, joined.

    Lines of a short window are fetched one by one: a slice copies the whole array, whose size is that of the file.
    """
    if before + after < FETCHED_LINES:
        fetched = [F.get(lines, line_no + (k - 1)) for k in range(-before, after + 1)]
        return F.when(lines.isNotNull() & line_no.isNotNull(), F.concat_ws("\n", *fetched))
    start = F.greatest(F.lit(1), line_no - before)
    return F.array_join(F.slice(lines, start, line_no + (after + 1) - start), "\n")


def context(lines: Column, line_no: Column) -> Column:
    """One line before to two lines after."""
    return window_text(lines, line_no, 1, 2)


def upload_context(lines: Column, line_no: Column) -> Column:
    """Nineteen lines before to three lines after."""
    return window_text(lines, line_no, 19, 3)


def redact(text: Column) -> Column:
    """Private keys, AWS keys and key=value secrets replaced by markers."""
    return _redact(text, fv.PEM_BLOCK)


def _replaced_if(condition: Column, text: Column, regex: str, marker: str) -> Column:
    # a list of one or no round of replacing; so the text, which may be a long expression, is written down once
    rounds = F.when(condition, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, text, lambda value, _: F.regexp_replace(value, pattern(regex), marker))


def _redact(text: Column, pem: str, signs: Column | None = None) -> Column:
    """``signs`` has a bit for each kind of secret, in the order of SECRET_SIGNS; kinds without theirs are not looked for."""
    kinds = (
        (pem, fv.PEM_MARKER),
        (fv.AWS_KEY_PARTS, f"$1{fv.STARS}$2"),
        (fv.AWS_CONSTRUCTOR_PARTS, f"$1{fv.AWS_ACCESS_MARKER}$2{fv.AWS_SECRET_MARKER}$3"),
        # a look at the first letters spares most places the try of every name
        (_NAME_AHEAD + fv.KEY_VALUE_PARTS, f"$1=$3{fv.STARS}$4"),
    )
    for bit, (regex, marker) in enumerate(kinds):
        if signs is None:
            text = F.regexp_replace(text, pattern(regex), marker)
        else:
            text = _replaced_if(signs.bitwiseAND(F.lit(1 << bit)) != 0, text, regex, marker)
    return text


def snippet(
    lines: Column, line_no: Column, maximum: int = fv.SNIPPET_LINES, enabled: bool = True, hide: bool = True
) -> Column:
    """Evidence lines of a finding, redacted. A private key that runs past the snippet is
    hidden to its end as well."""
    if not enabled:
        return F.lit("")
    value = window_text(lines, line_no, 0, max(1, maximum) - 1)
    return redacted_snippet(value) if hide else value


def redacted_snippet(value: Column, signs: Column | None = None) -> Column:
    """``signs``, if given, has the kinds of secrets that the lines have a sign of; others are not looked for."""
    return _redact(value, fv.PEM_BLOCK_OPEN, signs)


def trimmed_evidence(line: Column, characters: int | None = None) -> Column:
    """A line without surrounding white space, whole or up to a number of characters."""
    whole = F.regexp_replace(line, pattern(r"^\s+|\s+\z"), "")
    return whole if characters is None else F.substring(whole, 1, characters)


def contains_any(column: Column, words) -> Column:
    condition = F.lit(False)
    for word in words:
        condition = condition | column.contains(word)
    return condition


def present_names(column: Column, pairs) -> Column:
    """Names of the (name, marker) pairs whose marker is contained, in list order."""
    lowered = F.lower(column)
    found = F.array(*[F.when(lowered.contains(marker.lower()), F.lit(name)) for name, marker in pairs])
    return F.array_compact(found)


def computed(array: str) -> Column:
    """An array column as an expression, for use in a generator.

    For a generator over a plain column the optimizer adds a test that the array is not empty
    and pushes it down, where it computes the array a second time.
    """
    return F.slice(array, 1, 2**31 - 1)
