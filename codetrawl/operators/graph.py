"""Declarations, calls and routes.

A file is cut into segments at its declaration lines, inside its own row: one segment per
declaration plus one for the lines before the first. The declaration at or above a line is
then the one of the segment the line is in, so the as-of lookups need neither a shuffle nor
a nested loop, and each line is carried once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx

# What stands before a parenthesis, read backwards: blanks, then all characters a name may have.
_TAIL = r"\A\s*+([\w$]++)"
# The name that ``fv.CALL`` takes from those characters.
_CALLED = fv.CALL.replace("]*)", "]*+)").removesuffix(r"\s*\(") + r"\z"


# What the Java expression asks for before a parenthesis: a word, at most brackets and blanks, a blank and the name.
_JAVA_NAME = r"\w([\s<>\[\],?]*+)(?<=\s)([A-Za-z_]\w*+)\s*+\z"
_JAVA_BROKEN = r"[<>\[\],?] *+[^\S ]\s*+[<>\[\],?]"
_JAVA_BODY = r"\)\s*+\{"


def _java_name(line: Column) -> Column:
    """What the Java expression of ``fv.DECLARATIONS`` captures, in one walk over the line.

    That expression tries every word as a start and backtracks over all that follows. A match lies between
    parentheses, though: a name before one of them, and behind it a closing one with a brace before any semicolon. So
    the pieces between opening parentheses are read once, with the first name that still waits for its brace.
    """
    nothing = F.lit(None).cast("string")

    def step(state: Column, piece: Column) -> Column:
        body = tx.matches(F.substring_index(piece, ";", 1), _JAVA_BODY)
        name = F.nullif(tx.extract(piece, _JAVA_NAME, 2), F.lit(""))
        sound = ~tx.matches(tx.extract(piece, _JAVA_NAME, 1), _JAVA_BROKEN)
        return F.struct(
            F.coalesce(F.when(~piece.contains(";"), state["waiting"]), F.when(sound, name)).alias("waiting"),
            F.coalesce(state["name"], F.when(body, state["waiting"])).alias("name"))

    start = F.struct(nothing.alias("waiting"), nothing.alias("name"))
    return F.aggregate(F.split(line, r"\("), start, step, lambda state: state["name"])


def declared_name(line: Column, language: Column) -> Column:
    """Name declared on a line, null when there is none."""
    cases = None
    for name, (regex, _) in fv.DECLARATIONS.items():
        if name == "java":
            value = F.when(line.contains("(") & line.contains("{"), _java_name(line))
        else:
            value = tx.extract(line, regex, 1)
        cases = F.when(language == name, value) if cases is None else cases.when(language == name, value)
    return F.nullif(cases, F.lit(""))


def declaration_kind(language: Column) -> Column:
    return F.when(language == "java", F.lit("method")).otherwise(F.lit("function"))


def segments(files: DataFrame) -> DataFrame:
    """(repo, path, language, name, kind, start_line, lines): a file cut at its declarations.

    ``name`` is null for the lines before the first declaration. The cuts are made inside the row of the file, so that
    a declaration takes its own lines along and nothing else, however many there are.
    """
    language = F.col("language")
    lines = files.select(
        "repo", "path", "language", tx.split_lines(tx.normal_breaks(F.col("text"))).alias("all_lines")
    )
    named = lines.withColumn(
        "names", F.transform("all_lines", lambda line: declared_name(line, language))
    )
    starts = named.withColumn(
        "starts",
        F.filter(
            F.transform("names", lambda name, i: F.when((i == 0) | name.isNotNull(), i + 1)),
            lambda i: i.isNotNull(),
        ),
    )

    def segment(start: Column, place: Column) -> Column:
        end = F.coalesce(F.get("starts", place + 1), F.size("all_lines") + 1)
        return F.struct(F.get("names", start - 1).alias("name"), start.alias("start_line"),
                        F.slice("all_lines", start, end - start).alias("lines"))

    cut = starts.select("repo", "path", "language", F.transform("starts", segment).alias("segments"))
    rows = cut.select("repo", "path", "language", F.inline(tx.computed("segments")))
    return rows.select("repo", "path", "language", "name", declaration_kind(language).alias("kind"), "start_line", "lines")


def _calls(lines: Column, name: Column) -> Column:
    """Names called in the lines, each once, in the order first seen, without ``name``.

    A call ends at a parenthesis, so only what stands right before one is looked at, backwards from there. Lines are
    taken one by one, so that no call can reach over a line end.
    """
    pieces = F.flatten(F.transform(F.filter(lines, lambda line: line.contains("(")),
                                   lambda line: _before_parentheses(F.split(line, r"\("))))
    tails = F.transform(pieces, lambda piece: F.reverse(tx.extract(F.reverse(piece), _TAIL, 1)))
    called = F.transform(F.array_distinct(tails), lambda tail: tx.extract(tail, _CALLED, 1))
    return F.filter(F.array_distinct(called), lambda c: (c != "") & (name.isNull() | (c != name)))


def _before_parentheses(pieces: Column) -> Column:
    return F.slice(pieces, 1, F.size(pieces) - 1)


def code_graph(files: DataFrame) -> DataFrame:
    """One row for each segment: (repo, path, name, kind, start_line, calls, route_lines).

    ``calls`` are the names called in a declaration, none above the first one; ``route_lines`` holds (line_no, raw) of the
    lines with a route marker or a route call. All tables of this module are made of it: write it once and give it in
    place of the files, and their texts are read once, whatever is asked afterwards.
    """
    start, name = F.col("start_line"), F.col("name")
    placed = F.transform("lines", lambda raw, i: F.struct((start + i).alias("line_no"), raw.alias("raw")))
    return segments(files).select(
        "repo", "path", "name", "kind", "start_line",
        F.when(name.isNotNull(), _calls(F.col("lines"), name)).otherwise(F.array().cast("array<string>")).alias("calls"),
        F.filter(placed, lambda line: _has_marker(line["raw"]) | _is_route_call(line["raw"])).alias("route_lines"),
    )


def write_graph(files: DataFrame, path: str) -> DataFrame:
    """The code graph, written to a folder that all executors share and read from there."""
    code_graph(files).write.mode("errorifexists").parquet(path)
    return files.sparkSession.read.parquet(path)


def _graph(table: DataFrame) -> DataFrame:
    return table if "route_lines" in table.columns else code_graph(table)


def symbols(files: DataFrame) -> DataFrame:
    """(repo, path, name, line_no, kind, calls) of every declaration; ``files`` may be their code graph."""
    found = _graph(files).filter(F.col("name").isNotNull())
    return found.select("repo", "path", "name", F.col("start_line").alias("line_no"), "kind", "calls")


def call_edges(files: DataFrame) -> DataFrame:
    """(repo, path, caller, caller_line, callee, ord): one row per call edge."""
    return symbols(files).select(
        "repo", "path", F.col("name").alias("caller"), F.col("line_no").alias("caller_line"),
        F.posexplode(tx.computed("calls")).alias("ord", "callee"),
    ).select("repo", "path", "caller", "caller_line", "callee", "ord")


def callers(symbol_table: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(repo, name, caller): distinct callers of called names, in all files of the repository.

    ``names`` with (repo, name) restricts the lookup before anything is deduplicated.
    """
    edges = symbol_table.select("repo", F.explode(tx.computed("calls")).alias("name"), F.col("name").alias("caller"))
    if names is not None:
        edges = edges.join(names, ["repo", "name"], "left_semi")
    return edges.distinct()


def symbol_at(files: DataFrame) -> DataFrame:
    """Every line with the declaration at or above it: the as-of join of lines and symbols."""
    rows = segments(files).select(
        "repo", "path", "name", "start_line", F.posexplode(tx.computed("lines")).alias("_pos", "raw")
    )
    return rows.select("repo", "path", (F.col("start_line") + F.col("_pos")).alias("line_no"), "raw",
                       F.col("name").alias("symbol"), F.when(F.col("name").isNotNull(), F.col("start_line"))
                       .alias("symbol_line"))


def _route_lines(files: DataFrame, calls: bool = True) -> DataFrame:
    """Lines with a route marker or call, each with the symbol it is in and that symbol's calls."""
    carried = [F.sort_array("calls").alias("calls")] if calls else []
    marked = _graph(files).filter(F.size("route_lines") > 0)
    return marked.select("repo", "path", "name", *carried, F.inline(tx.computed("route_lines")))


def graph_routes(files: DataFrame) -> DataFrame:
    """(repo, path, line_no, method, route, handler): at most one route per line."""
    rows = _route_lines(files, calls=False).filter(_is_route_call(F.col("raw")))
    return rows.select(
        "repo", "path", "line_no",
        F.upper(tx.extract(F.col("raw"), fv.GRAPH_ROUTE, 1)).alias("method"),
        tx.extract(F.col("raw"), fv.GRAPH_ROUTE, 2).alias("route"),
        F.col("name").alias("handler"),
    )


def _route_part(group: int, mapping: Column) -> Column:
    raw = F.col("raw")
    return (
        F.when(tx.matches(raw, fv.ROUTE_DECORATOR), tx.extract(raw, fv.ROUTE_DECORATOR, group))
        .when(tx.matches(raw, fv.ROUTE_METHOD), tx.extract(raw, fv.ROUTE_METHOD, group))
        .when(tx.matches(raw, fv.ROUTE_JAVA), mapping)
    )


def _has_marker(raw: Column) -> Column:
    return tx.contains_any(raw, fv.ROUTE_MARKERS)


def _is_route_call(raw: Column) -> Column:
    """Does ``fv.GRAPH_ROUTE`` match; it needs a quote, and a comma or parenthesis before it."""
    return tx.contains_any(raw, "\"'") & tx.contains_any(raw, ",(") & tx.matches(raw, fv.GRAPH_ROUTE)


def _route_columns(keep: list[str]) -> list:
    raw = F.col("raw")
    return [
        *keep,
        F.upper(_route_part(1, F.lit(fv.ROUTE_JAVA_METHOD))).alias("method"),
        _route_part(2, tx.extract(raw, fv.ROUTE_JAVA, 1)).alias("route"),
        tx.trimmed_evidence(raw).alias("evidence"),
    ]


def route_inventory(files: DataFrame, frameworks: DataFrame | None = None) -> DataFrame:
    """Lines with route syntax: method and path where they can be read, evidence, notes.

    ``frameworks`` holds the (repo, framework) rows of the detector; a route gets the first
    of its repository's that its line names.
    """
    rows = _route_lines(files, calls=False).filter(_has_marker(F.col("raw")))
    routes = rows.select(*_route_columns(["repo", "path", "line_no"]), F.lower("raw").alias("_line"))
    return _with_route_framework(routes, frameworks).drop("_line").withColumns({
        "review_notes": F.lit(fv.ROUTE_NOTES),
        **{name: F.array().cast("array<string>") for name in fv.ROUTE_EMPTY_LISTS},
    })


def _with_route_framework(routes: DataFrame, frameworks: DataFrame | None) -> DataFrame:
    if frameworks is None:
        return routes.withColumn("framework", F.lit(None).cast("string"))
    # at most one name per known framework and repository, so the list is short
    names = frameworks.groupBy("repo").agg(F.sort_array(F.collect_set("framework")).alias("_names"))
    joined = routes.join(names, "repo", "left")
    named = F.filter("_names", lambda name: F.col("_line").contains(F.lower(name)))
    return joined.withColumn("framework", F.get(named, F.lit(0))).drop("_names")


def _handlers(routes: DataFrame) -> DataFrame:
    return routes.filter(F.col("name").isNotNull()).select("repo", "name").distinct()


def route_callers(files: DataFrame, symbol_table: DataFrame | None = None) -> DataFrame:
    """(repo, handler, caller): who calls the handlers of routes, one row each, however many there are.

    Give a written code graph for ``files`` to read it twice instead of the files.
    """
    graph = _graph(files)
    handlers = _handlers(_route_lines(graph, calls=False).filter(_has_marker(F.col("raw"))))
    edges = callers(symbols(graph) if symbol_table is None else symbol_table, handlers)
    return edges.select("repo", F.col("name").alias("handler"), "caller")


def enrich_routes(files: DataFrame, frameworks: DataFrame | None = None,
                  caller_table: DataFrame | None = None) -> DataFrame:
    """Route inventory with handler, sorted callees of the handler and the number of its callers.

    The callers themselves are rows of ``route_callers``; ``files`` may be a written code graph, which both read.
    """
    graph = _graph(files)
    rows = _route_lines(graph).filter(_has_marker(F.col("raw")))
    routes = rows.select(
        *_route_columns(["repo", "path", "line_no"]), F.col("name").alias("handler"),
        F.col("calls").alias("related_callees"), F.lower("raw").alias("_line"),
    )
    routes = _with_route_framework(routes, frameworks).drop("_line")
    edges = route_callers(graph) if caller_table is None else caller_table
    joined = routes.join(edges.groupBy("repo", "handler").agg(F.count("*").alias("caller_count")), ["repo", "handler"], "left")
    return joined.select(
        "repo", "path", "line_no", "method", "route", "framework", "handler", "evidence", "related_callees",
        F.coalesce("caller_count", F.lit(0)).alias("caller_count"),
        F.when(F.col("handler").isNotNull(), F.lit(fv.SCOPE_GRAPH)).otherwise(F.lit(fv.SCOPE_SYNTAX))
        .alias("graph_scope"),
        F.lit(fv.ROUTE_NOTES).alias("review_notes"),
        *[F.array().cast("array<string>").alias(name) for name in fv.ROUTE_EMPTY_LISTS],
    )
