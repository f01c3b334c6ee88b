"""DuckDB SQL for the checks: the operators once more, written independently of Spark."""

from __future__ import annotations

import re

from codetrawl import fixed_values as fv
from codetrawl.operators import rules

from . import corpus

_W = r"\p{L}\p{N}_"
_CLASS = re.compile(r"\[(?:\\.|[^\]\\])*\]")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(regex: str) -> str:
    """The regex for RE2: Unicode word characters, boundaries as consumed characters."""
    out, i = "", 0
    while i < len(regex):
        klass = _CLASS.match(regex, i)
        if klass:
            out += klass.group().replace(r"\w", _W)
            i = klass.end()
        elif regex.startswith(r"\w", i):
            out += f"[{_W}]"
            i += 2
        elif regex.startswith(r"\b", i):
            leading = out == "" or out.endswith(("(?i)", "|", "(?:", "("))
            if leading:
                out += rf"(?:^|[^{_W}])"
            elif not regex.startswith(r"\b\s*", i):
                out += rf"(?:[^{_W}]|$)"
            i += 2
        elif regex[i] == "\\":
            out += regex[i:i + 2]
            i += 2
        else:
            out += regex[i]
            i += 1
    return out


def m(column: str, regex: str) -> str:
    return f"regexp_matches({column}, {q(re2(regex))})"


def x(column: str, regex: str, group: int) -> str:
    return f"regexp_extract({column}, {q(re2(regex))}, {group})"


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def in_list(column: str, values) -> str:
    return f"{column} IN ({', '.join(q(v) for v in values)})"


# --- lines ---------------------------------------------------------------------------------

_SLASH = r"//[^\n]*|/\*.*?(?:\*/|\z)"
_DOUBLE, _SINGLE, _TICK = r'"(?:[^"\\]|\\.)*"?', r"'(?:[^'\\]|\\.)*'?", r"`(?:[^`\\]|\\.)*`?"
TOKENS = {
    "java": rf"(?s){_SLASH}|{_DOUBLE}|{_SINGLE}|[^/\"']+|.",
    "javascript": rf"(?s){_SLASH}|{_DOUBLE}|{_SINGLE}|{_TICK}|[^/\"'`]+|.",
    "go": rf"(?s){_SLASH}|{_DOUBLE}|{_SINGLE}|`[^`]*`?|[^/\"'`]+|.",
    "python": r"""(?s)#[^\n]*|\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\z)|'''(?:\\.|[^\\])*?(?:'''|\z)"""
              r"""|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|[^#"']+|.""",
}


def lines_of(text: str) -> str:
    """List of lines without a trailing empty one."""
    parts = f"string_split({text}, chr(10))"
    return (f"CASE WHEN {text} = '' THEN []::VARCHAR[] WHEN ends_with({text}, chr(10)) "
            f"THEN {parts}[:-2] ELSE {parts} END")


def lines_cte(snapshot: str | None = None, prefix: str = "") -> str:
    p = prefix
    tokens = " ".join(
        f"WHEN {in_list('language', names)} THEN regexp_extract_all(text, {q(TOKENS[names[0]])})"
        for names in (("java",), ("javascript", "typescript"), ("go",), ("python",)))
    comment = ("CASE WHEN language = 'python' THEN starts_with(t, '#') "
               "ELSE starts_with(t, '//') OR starts_with(t, '/*') END")
    literal = "(starts_with(t, '\"') OR starts_with(t, '''') OR (starts_with(t, '`') AND language IN " \
              "('javascript', 'typescript', 'go')))"
    blank = "regexp_replace(t, '[^\\n]', ' ', 'g')"
    unc = f"array_to_string(list_transform(toks, lambda t: CASE WHEN {comment} THEN {blank} ELSE t END), '')"
    code = (f"array_to_string(list_transform(toks, lambda t: CASE WHEN {comment} OR {literal} THEN {blank} "
            f"ELSE t END), '')")
    return f"""
    {p}files AS ({corpus.files_sql(snapshot)}),
    {p}toks AS (SELECT *, CASE {tokens} END AS toks FROM {p}files),
    {p}masked AS (SELECT repo, path, language, code_surface, text, {unc} AS unc, {code} AS code FROM {p}toks),
    {p}arrays AS (SELECT repo, path, language, code_surface, {lines_of('text')} AS raw,
                         {lines_of('unc')} AS unc, {lines_of('code')} AS code FROM {p}masked),
    {p}lines AS MATERIALIZED (SELECT repo, path, language, code_surface, unnest(range(1, len(raw) + 1)) AS n,
                        unnest(raw) AS raw, unnest(unc) AS unc, unnest(code) AS code FROM {p}arrays)"""


def _frame(column: str, before: int, after: int) -> str:
    parts = []
    for offset in range(-before, after + 1):
        if offset < 0:
            parts.append(f"lag({column}, {-offset}) OVER w")
        elif offset == 0:
            parts.append(column)
        else:
            parts.append(f"lead({column}, {offset}) OVER w")
    return f"concat_ws(chr(10), {', '.join(parts)})"


def contexts_cte(prefix: str = "") -> str:
    p = prefix
    return f"""
    {p}ctx AS MATERIALIZED (SELECT *, {_frame('code', 1, 2)} AS cctx, {_frame('raw', 1, 2)} AS rctx,
                      {_frame('unc', 19, 3)} AS uctx, {_frame('raw', 0, 2)} AS snip
               FROM {p}lines WINDOW w AS (PARTITION BY repo, path ORDER BY n))"""


_V = r"[^\s'\";,]"


def redact_sql(text: str, open_pem: bool = False) -> str:
    end = r"(?:-----END [^-]*PRIVATE KEY-----|\z)" if open_pem else "-----END [^-]*PRIVATE KEY-----"
    names = r"(api[_-]?key|secret|password|token|private[_-]?key|authorization|cookie)"
    value = f"({_V}{{3}}){_V}{{3,}}({_V}{{2}})"
    pair = rf"(?i){names}\s*[:=]\s*(?:'{value}'|\"{value}\"|{value})"
    out = f"regexp_replace({text}, {q('(?s)-----BEGIN [^-]*PRIVATE KEY-----.*?' + end)}, {q(fv.PEM_MARKER)}, 'g')"
    key_id = q(r"\b(AKIA|ASIA)[A-Z0-9]{14}([A-Z0-9]{2})\b")
    out = f"regexp_replace({out}, {key_id}, {q(chr(92) + '1********' + chr(92) + '2')}, 'g')"
    by = f"\\1{fv.AWS_ACCESS_MARKER}\\2{fv.AWS_SECRET_MARKER}\\3"
    out = f"regexp_replace({out}, {q(fv.AWS_CONSTRUCTOR_PARTS)}, {q(by)}, 'g')"
    joined = q(r"\1=\2\4\6********\3\5\7")
    return f"regexp_replace({out}, {q(pair)}, {joined}, 'g')"


# --- rules -------------------------------------------------------------------------------------
# (rule name, languages, [(condition, catalogue key)], api, source, controls)

RAW, UNC, CODE, CCTX, RCTX, UCTX = "raw", "unc", "code", "cctx", "rctx", "uctx"
_TEST = "code_surface = 'test'"


def _controls(column: str, pairs) -> str:
    names = ", ".join(f"CASE WHEN contains(lower({column}), {q(marker.lower())}) THEN {q(name)} END"
                      for name, marker in pairs)
    return f"list_filter([{names}], lambda c: c IS NOT NULL)"


def _call(column: str, regex: str) -> str:
    return f"trim({x(column, regex, 1)}, ' =(')"


def rule_table() -> list[tuple]:
    g = ("python", "go")
    table = []
    for key, _, regex, *_rest in fv.GENERIC_RULES:
        condition = m(RAW, regex)
        if key == "r_exec":
            condition += (f" AND (language <> 'go' OR {m(CODE, fv.GO_EXEC_CALL)}) AND NOT contains(raw, 'shell=False')"
                          f" AND NOT {m(RAW, fv.EXEC_SAFE_BUILDER)}")
        if key == "r_log":
            condition += f" AND {m(CODE, fv.LOG_CALL)} AND {m(CODE, fv.LOG_SENSITIVE)}"
        if key == "r_timeout":
            condition += f" AND NOT {m(RAW, fv.TIMEOUT_PRESENT)}"
        cases = [(condition, key)]
        if key == "r_random":
            cases = [(f"{condition} AND {m(RAW, fv.RANDOM_CONTEXT)}", key), (condition, "r_random_plain")]
        table.append((key, g, cases, None, None, None))

    j = ("java",)
    log = f"({m(CODE, fv.JAVA_LOG_CALL)} AND {m(CODE, fv.JAVA_LOG_SENSITIVE)})"
    open_line = f"NOT ({log} AND {m(RAW, fv.JAVA_LOG_MASKED)})"
    ctor = m(UNC, fv.JAVA_AWS_CONSTRUCTOR)
    known = f"({m(UNC, fv.JAVA_AWS_ENVIRONMENT)} OR {m(UNC, fv.AWS_KEY_ID)} OR {m(UNC, fv.JAVA_PEM_HEADER)})"
    # assignments outside literals: split the line into literal and code tokens, then look for a
    # code token that ends with name= and is followed by a long enough literal and a fitting token
    toks = r"""regexp_extract_all(unc, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|["''].*$|[^"'']+')"""
    name = q(re2(r"(?i)\b(?:api[_-]?key|secret|password|token|clientsecret)\b\s*=\s*") + "$")
    assigned = (f"len(list_filter(range(1, len({toks})), lambda i: regexp_matches({toks}[i], {name}) "
                f"AND regexp_matches({toks}[i + 1], '^\"(?s:.{{8,}})\"$') "
                f"AND (i + 2 > len({toks}) OR regexp_matches({toks}[i + 2], '^\\s*([;,)]|$)')))) > 0")
    table.append(("j_secret_assign", j, [(assigned, "j_secret_assign")], None, None, None))
    table.append(("j_secret_known", j, [
        (f"{ctor} AND {_TEST}", "j_secret_awsctor_test"), (ctor, "j_secret_awsctor"),
        (f"{known} AND {_TEST}", "j_secret_literal_test"), (known, "j_secret_literal")], None, None, None))
    table.append(("j_log", j, [(f"{log} AND {open_line}", "j_log")], None, None, None))
    controlled = m(RAW, fv.JAVA_EXEC_CONTROLLED)
    table.append(("j_exec", j, [
        (f"{open_line} AND {m(CODE, fv.JAVA_EXEC_RUNTIME)} AND {controlled}", "j_exec_runtime_controlled"),
        (f"{open_line} AND {m(CODE, fv.JAVA_EXEC_RUNTIME)}", "j_exec_runtime"),
        (f"{open_line} AND {m(CODE, fv.JAVA_EXEC_BUILDER)} AND {controlled}", "j_exec_builder_controlled"),
        (f"{open_line} AND {m(CODE, fv.JAVA_EXEC_BUILDER)}", "j_exec_builder"),
        (f"{open_line} AND {m(CODE, fv.JAVA_EXEC_ENGINE)}", "j_exec_engine")], None, None, None))
    sql = (f"{open_line} AND {m(CODE, fv.JAVA_SQL_CALL)} AND {m(RAW, fv.JAVA_SQL_VERB)} AND "
           f"{m(RAW, fv.JAVA_SQL_DYNAMIC)} AND NOT ({m(RAW, fv.JAVA_SQL_BIND)} AND {m(CODE, fv.JAVA_SQL_STATEMENT)})")
    table.append(("j_sql", j, [(sql, "j_sql")], x(CODE, fv.JAVA_SQL_API, 1),
                  f"CASE WHEN {m(RAW, fv.JAVA_SQL_CONTROLLED)} THEN 'request-controlled input' ELSE 'unknown' END",
                  None))
    uploaded = m(UCTX, fv.JAVA_UPLOAD_SOURCE)
    stored = f"{open_line} AND {uploaded} AND {m(CODE, fv.JAVA_UPLOAD_SINK)}"
    jc = _controls(CCTX, fv.JAVA_CONTROLS)
    table.append(("j_upload", j, [
        (f"{stored} AND code_surface = 'utility' AND NOT {m(RAW, fv.JAVA_ORIGINAL_NAME)}", "j_upload_utility"),
        (f"{stored} AND len({jc}) >= 2", "j_upload_validated"),
        (stored, "j_upload"),
        (f"{open_line} AND {uploaded} AND {m(RAW, fv.JAVA_ORIGINAL_NAME)} AND {m(CCTX, fv.JAVA_STORAGE)}",
         "j_upload_name")], _call(CODE, fv.JAVA_UPLOAD_SINK), None, jc))
    table.append(("j_path", j, [
        (f"{open_line} AND {m(CODE, fv.JAVA_PATH_SINK)} AND {m(RAW, fv.JAVA_PATH_SOURCE)}", "j_path")],
        _call(CODE, fv.JAVA_PATH_SINK), x(RAW, fv.JAVA_PATH_SOURCE, 1), jc))
    table.append(("j_deser", j, [
        (f"{open_line} AND {m(CODE, fv.JAVA_DESER)} AND {m(CCTX, fv.JAVA_DESER_CONTEXT)}", "j_deser")],
        None, None, None))
    table.append(("j_tls", j, [(f"{open_line} AND {m(CODE, fv.JAVA_TLS)} AND NOT {m(CODE, fv.JAVA_IMPORT)}", "j_tls")],
                  None, None, None))
    table.append(("j_random", j, [(f"{open_line} AND {m(CODE, fv.JAVA_RANDOM)}", "j_random")], None, None, None))

    s = ("javascript", "typescript")
    secret = (f"({m(RAW, fv.AWS_KEY_ID)} OR {m(RAW, fv.JS_SECRET_ASSIGN)} OR {m(RAW, fv.JS_SECRET_CONSTRUCTOR)}) "
              f"AND NOT {m(RAW, fv.JS_SECRET_ENVIRONMENT)}")
    table.append(("js_secret", s, [(f"{secret} AND {m(RAW, fv.JS_SECRET_ASSIGN)}", "js_secret_assign"),
                                   (secret, "js_secret")], None, None, None))
    log = f"{m(CODE, fv.JS_LOG_CALL)} AND {m(CODE, fv.JS_LOG_SENSITIVE)}"
    table.append(("js_log", s, [(f"{log} AND {m(RAW, fv.JS_LOG_PRESENCE)}", "js_log_presence"), (log, "js_log")],
                  None, None, None))
    evaluated = f"({m(CODE, fv.JS_EVAL)} OR {m(CODE, fv.JS_FUNCTION)})"
    other = f"({m(CODE, fv.JS_CHILD_PROCESS)} OR {m(CODE, fv.JS_VM)})"
    controlled = m(RAW, fv.JS_EXEC_CONTROLLED)
    api = (f"CASE WHEN {m(CODE, fv.JS_EVAL)} THEN 'eval' WHEN {m(CODE, fv.JS_FUNCTION)} THEN 'Function' "
           f"WHEN {m(CODE, fv.JS_CHILD_PROCESS)} THEN {x(CODE, fv.JS_CHILD_PROCESS, 1)} "
           f"ELSE {x(CODE, fv.JS_VM_API, 1)} END")
    table.append(("js_exec", s, [
        (f"{evaluated} AND {controlled}", "js_exec_eval_controlled"), (evaluated, "js_exec_eval"),
        (f"{other} AND {controlled}", "js_exec_controlled"), (other, "js_exec")], api, None, None))
    sink = m(CODE, fv.JS_UPLOAD_SINK)
    table.append(("js_formdata", s, [(f"{m(CODE, fv.JS_FORM_APPEND)} AND NOT {sink}", "js_formdata")],
                  None, None, None))
    upload = f"{sink} AND {m(CCTX, fv.JS_UPLOAD_SOURCE)}"
    sc = _controls(RCTX, fv.JS_CONTROLS)
    table.append(("js_upload", s, [(upload, "js_upload")], _call(CODE, fv.JS_UPLOAD_SINK),
                  x(CCTX, fv.JS_UPLOAD_SOURCE, 1), sc))
    table.append(("js_upload_name", s, [
        (f"{upload} AND {m(RCTX, fv.JS_ORIGINAL_NAME)} AND {m(RCTX, fv.JS_STORAGE)}", "js_upload_name")],
        None, None, sc))
    sql = (f"{m(CODE, fv.JS_SQL_CALL)} AND {m(RAW, fv.JS_SQL_VERB)} AND {m(RAW, fv.JS_SQL_DYNAMIC)} "
           f"AND NOT {m(RAW, fv.JS_SQL_BIND)}")
    table.append(("js_sql", s, [(sql, "js_sql")], _call(CODE, fv.JS_SQL_CALL),
                  f"CASE WHEN {m(RAW, fv.JS_SQL_CONTROLLED)} THEN 'request-controlled input' ELSE 'unknown' END",
                  None))
    table.append(("js_ssrf", s, [(f"{m(CODE, fv.JS_OUTBOUND)} AND {m(RAW, fv.JS_OUTBOUND_CONTROLLED)}", "js_ssrf")],
                  _call(CODE, fv.JS_OUTBOUND), None, None))
    table.append(("js_render", s, [(f"{m(CODE, fv.JS_RENDER)} AND NOT {m(CCTX, fv.JS_SANITIZED)}", "js_render")],
                  _call(CODE, fv.JS_RENDER), None, None))
    return table


def _value(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(q(v) for v in value) + "]::VARCHAR[]"
    return str(value) if isinstance(value, int) else q(value)


def catalogue_cte(prefix: str = "") -> str:
    names = rules.CATALOGUE.fieldNames()
    rows = ",\n".join("(" + ", ".join(_value(e[n]) for n in names) + ")" for e in rules.catalogue_entries())
    return f"{prefix}catalogue({', '.join(names)}) AS (VALUES {rows})"


def hits_cte(variants=None, prefix: str = "") -> str:
    """Raw matches of the wanted variants (all by default), with an emission ordinal."""
    p = prefix
    selects = []
    for ordinal, (_, languages, cases, api, source, controls) in enumerate(rule_table()):
        if variants is not None and not {k for _, k in cases} & set(variants):
            continue
        whens = " ".join(f"WHEN {c} THEN {q(k)}" for c, k in cases)
        selects.append(f"""
        SELECT repo, path, language, code_surface, n, snip, {ordinal} AS ord, CASE {whens} END AS key,
               {api or 'NULL::VARCHAR'} AS api, {source or 'NULL::VARCHAR'} AS src,
               {controls or '[]::VARCHAR[]'} AS controls
        FROM {p}ctx WHERE {in_list('language', languages)}""")
    wanted = "key IS NOT NULL" if variants is None else in_list("key", sorted(variants))
    return f"{p}hits AS (SELECT * FROM ({' UNION ALL '.join(selects)}) WHERE {wanted})"


def findings_ctes(variants=None, snapshot=None, prefix: str = "", authz: bool = True) -> str:
    """CTEs up to ``findings``: enriched, one per key (the last emitted)."""
    p = prefix
    evidence = redact_sql("snip", True)
    parts = [lines_cte(snapshot, p), contexts_cte(p), catalogue_cte(p)]
    line_rules = variants is None or any(v != "r_py_authz" for v in variants)
    unions = []
    if line_rules:
        parts.append(hits_cte(variants, p))
        unions.append(f"""
        SELECT repo, path, language, code_surface, n, {evidence} AS evidence, 0 AS phase, ord, family, rule_id, title,
               replace(reason, '{{api}}', coalesce(fixed_api, api, '')) AS description, category,
               severity, confidence, classification, verdict, cwes,
               coalesce(src, fixed_source) AS source,
               CASE WHEN fixed_sink = '{{api}}' THEN coalesce(fixed_api, api) ELSE fixed_sink END AS sink,
               syntax, CASE WHEN family <> 'generic' THEN coalesce(fixed_api, api) END AS api, controls,
               proof_gaps, counterevidence, false_positives,
               CASE WHEN contains(reason, '{{api}}') THEN [replace(reason, '{{api}}', api), verify[2]] ELSE verify END
               AS verify, fixed_flow, sensitive_value, logging_sink, NULL::VARCHAR AS function
        FROM {p}hits JOIN {p}catalogue USING (key)""")
    if authz and (variants is None or "r_py_authz" in variants):
        parts.append(authz_cte(p))
        key, rule_id, title, category, severity, confidence = fv.AUTHZ_RULE
        unions.append(f"""
        SELECT repo, path, 'python' AS language, code_surface, n, {evidence} AS evidence, 1 AS phase, 0 AS ord,
               'generic' AS family, {q(rule_id)} AS rule_id, {q(title)} AS title, {q(title)} AS description,
               {q(category)} AS category, {q(severity)} AS severity, {confidence} AS confidence,
               'review_lead' AS classification, 'secure_coding_concern' AS verdict, []::VARCHAR[] AS cwes,
               NULL::VARCHAR AS source, NULL::VARCHAR AS sink, NULL::VARCHAR AS syntax, NULL::VARCHAR AS api,
               []::VARCHAR[] AS controls, []::VARCHAR[] AS proof_gaps, []::VARCHAR[] AS counterevidence,
               []::VARCHAR[] AS false_positives, [{q(fv.AUTHZ_VERIFY)}] AS verify, []::VARCHAR[] AS fixed_flow,
               NULL::VARCHAR AS sensitive_value, NULL::VARCHAR AS logging_sink, function
        FROM {p}authz""")
    syntax = in_list("syntax", fv.INVOCATION_SYNTAX)
    parts.append(f"{p}raw_findings AS ({' UNION ALL '.join(unions)})")
    parts.append(f"""{p}flows AS (
        SELECT *, coalesce({syntax}, false) AS invoked, coalesce(source, '') <> '' AS has_source,
               coalesce(sink, '') <> '' AS has_sink FROM {p}raw_findings)""")
    parts.append(f"""{p}graded AS (
        SELECT *, CASE WHEN has_source AND has_sink AND invoked THEN 'partial'
                       WHEN has_sink OR invoked THEN 'sink_only' ELSE 'unresolved' END AS flow_status,
               CASE WHEN has_source AND has_sink AND invoked THEN 2 ELSE 0 END AS evidence_level FROM {p}flows)""")
    lower = "(flow_status = 'sink_only' AND classification = 'review_lead')"
    parts.append(f"""{p}final AS (
        SELECT repo, path AS file_path, n AS start_line, language, code_surface, evidence, phase, ord, family, rule_id,
               split_part(rule_id, '.', 2) AS rule_family, title, description, category,
               CASE WHEN {lower} THEN 'review_point' ELSE classification END AS classification,
               CASE WHEN {lower} THEN 'review_point' ELSE verdict END AS verdict_candidate,
               CASE WHEN {lower} THEN 'informational' ELSE severity END AS suggested_severity,
               confidence AS confidence_score, CASE WHEN {lower} THEN []::VARCHAR[] ELSE cwes END AS cwe_ids,
               source, sink, syntax, api AS exact_invoked_api, controls, proof_gaps, counterevidence,
               false_positives, verify, fixed_flow, sensitive_value, logging_sink, function,
               invoked, has_source, has_sink, flow_status, evidence_level, code_surface = 'test' AS test_only,
               substr(sha256(rule_id || ':' || path || ':' || n), 1, 16) AS id
        FROM {p}graded)""")
    root = "rule_id || '|' || coalesce(sink, '') || '|' || coalesce(source, '') || '|'"
    parts.append(f"""{p}findings AS (
        SELECT *, 'RC-' || upper(substr(sha256({root}), 1, 12)) AS root_cause_id,
               file_path || '|' || phase || '|' || lpad(start_line::VARCHAR, 9, '0') || '|' ||
               lpad(ord::VARCHAR, 4, '0') AS seq
        FROM {p}final
        QUALIFY row_number() OVER (PARTITION BY repo, rule_id, file_path, start_line ORDER BY phase DESC, ord DESC) = 1)""")
    return ",\n".join(parts)


def authz_cte(prefix: str = "") -> str:
    """Brute force: the end of every sensitive function by a self join, then its body as text."""
    p = prefix
    name = r"regexp_extract(raw, '^[ \t]*(?:async\s+)?def\s+([A-Za-z_][\p{L}\p{N}_]*)', 1)"
    indent = r"length(regexp_extract(raw, '^([ \t]*)', 1))"
    return f"""
    {p}defs AS (SELECT repo, path, code_surface, n, snip, {name} AS function, {indent} AS depth FROM {p}ctx
                WHERE language = 'python' AND {m(name, fv.AUTHZ_FUNCTION_NAME)}),
    {p}ends AS (SELECT d.repo, d.path, d.n, coalesce(min(l.n), 1000000000) AS stop
                FROM {p}defs d LEFT JOIN {p}lines l ON l.repo = d.repo AND l.path = d.path AND l.n > d.n
                     AND {indent.replace('raw', 'l.raw')} <= d.depth
                     AND NOT regexp_matches(l.raw, '^\\s*([)\\]}}]|$)')
                GROUP BY ALL),
    {p}bodies AS (SELECT e.repo, e.path, e.n, lower(string_agg(l.raw, chr(10))) AS body
                  FROM {p}ends e JOIN {p}lines l ON l.repo = e.repo AND l.path = e.path AND l.n >= e.n AND l.n < e.stop
                  GROUP BY ALL),
    {p}authz AS (SELECT d.* FROM {p}defs d JOIN {p}bodies b USING (repo, path, n)
                 WHERE NOT {any_of('body', fv.AUTHZ_MARKERS)})"""


VIEW = """repo, file_path, start_line::BIGINT AS start_line, id, rule_id, rule_family, title, category, classification,
    verdict_candidate, suggested_severity, confidence_score::BIGINT AS confidence_score,
    array_to_string(cwe_ids, ',') AS cwes, source, sink, exact_invoked_api, flow_status,
    evidence_level::BIGINT AS evidence_level, code_surface, test_only::INT::BIGINT AS test_only, evidence"""


def findings_sql(variants=None, where: str = "true", columns: str = VIEW, snapshot=None) -> str:
    return f"WITH {findings_ctes(variants, snapshot)} SELECT {columns} FROM findings WHERE {where}"
