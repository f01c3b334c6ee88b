"""Rules as data, compiled to literal predicates over lines.

A ``Rule`` says which languages it is for, which words a file and a line must hold for its
regular expressions to have a chance (``words``), which condition a line must meet before its
contexts are worth building (``gate``), and which catalogue entry (variant) it then matches.
Texts, grades and CWE ids of the variants are rows of a small catalogue. It is enriched and
filtered as if its rows were findings, and joined to the matches; its size is fixed by the
library and checked before it is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..functions.sqltext import Case, Sql, call, lit, present_names, when
from ..options import ScanOptions
from ..schema import FINDING_DEFAULTS, FINDINGS
from . import enrich

GENERIC = ("python", "go")
JAVA = ("java",)
SCRIPT = ("javascript", "typescript")
GROUPS = (GENERIC, JAVA, SCRIPT)
# rules of one group are bits of a BIGINT
GROUP_BITS = 60
BROADCAST_ROWS = 5_000


class Line:
    """SQL text of the fields a rule may look at. Contexts exist once a line passed its gate."""

    def __init__(self, prefix: str = "", suffix: str = ""):
        self._prefix, self._suffix = prefix, suffix
        self.language = Sql("language")

    def __getattr__(self, name: str) -> Sql:
        return Sql(self._prefix + name + self._suffix)

    def raw_has(self, regex: str) -> Sql:
        return self.raw.matches(regex)

    def code_has(self, regex: str) -> Sql:
        return self.code.matches(regex)

    def uncommented_has(self, regex: str) -> Sql:
        return self.uncommented.matches(regex)


Test = Callable[[Line], Sql]


@dataclass(frozen=True)
class Rule:
    name: str
    languages: tuple[str, ...]
    # one word of every group occurs, in lower case, in any line the gate accepts
    words: tuple[tuple[str, ...], ...]
    gate: Test
    # catalogue key of the match, null when the line does not match after all
    variant: Test
    variants: tuple[str, ...]
    api: Test | None = None
    source: Test | None = None
    controls: Test | None = None
    uses: frozenset[str] = field(default_factory=frozenset)


@dataclass(frozen=True)
class CustomRule:
    """A rule given by the caller: a pattern on the raw line, for Python and Go files."""

    rule_id: str
    pattern: str
    title: str
    category: str
    severity: str
    confidence: int
    cwes: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"custom:{self.rule_id}"


# --- words a match needs, in lower case ---------------------------------------------------

_SENSITIVE = ("token", "authorization", "bearer", "jwt", "key", "password", "secret", "cookie", "session")
_VERBS = ("select", "insert", "update", "delete")
_REQUEST = ("req.", "request.", "query", "body", "params", "user", "payload")
WORDS = {
    "r_secret": (("key", "secret", "password", "token"),),
    "r_tls": (("verif", "trustall"),),
    "r_weak": (("md5", "sha1", "des", "rc4", "ecb", "random", "math/rand"),),
    "r_exec": (("exec", "eval", "compile", "function", "vm.run", "processbuilder", "os.system", "subprocess",
                "child_process"),),
    "r_deser": (("yaml.load", "pickle.load", "marshal.load", "objectinputstream", "gob.newdecoder", "json.parse"),),
    "r_sql": (_VERBS, ("+", "%s", "f'", 'f"', "literal", "sprintf")),
    "r_ssrf": (("http.get", "requests.", "httpx.", "axios.", "fetch", "client.do", "http.newrequest"),),
    "r_render": (("innerhtml", "document.write", "mark_safe", "template.html", "text/template", "res.redirect",
                  "sendredirect"),),
    "r_path": (("open", "path.join", "send_file", "send_from_directory", "readfile", "writefile", "os.remove",
                "zip.extract", "tarfile"),),
    "r_authz": (("csrf_exempt", "permitall", "cors", "access-control-allow-origin", "trust proxy", "allowall"),),
    "r_upload": (("filename", "multer", "fileupload", "multipartfile", "uploadfile", "originalname"),),
    "r_log": (("log", "zap", "fmt"), _SENSITIVE),
    "r_debug": (("debug",),),
    "r_jwt": (("jwt.decode", "jsonwebtoken.decode"),),
    "r_random": (("random", "math/rand"),),
    "r_xml": (("documentbuilderfactory", "saxparser", "xml.etree", "xmldecoder"),),
    "r_timeout": (("requests.", "httpx.", "axios.", "http.get", "client.do"),),
    "j_secret_assign": (("key", "secret", "password", "token"), ('"',)),
    "j_secret_known": (("basicawscredentials", "aws_", "akia", "asia", "private key"),),
    "j_log": (("log", "system.", "printstacktrace"), (*_SENSITIVE, "passwd", "credential", "sid")),
    "j_exec": (("getruntime", "processbuilder", "eval"),),
    "j_sql": ((".execute", ".query", ".update", "createnativequery"), _VERBS, ("+", "string.format", "formatted")),
    "j_upload": (("transferto", "files.copy", "files.write", "fileoutputstream", "putobject", "upload", "store",
                  "getoriginalfilename"),),
    "j_path": (("file", "inputstream"), ("request", "pathvariable", "getoriginalfilename")),
    "j_deser": (("readobject",),),
    "j_tls": (("noophostnameverifier", "trustall", "insecuretrustmanagerfactory"),),
    "j_random": (("random",),),
    "js_secret": (("akia", "asia", "secret", "key", "password", "token", "credential", "auth"),),
    "js_log": (("console.", "logger.", "log."), _SENSITIVE),
    "js_exec": (("eval", "function", "child_process", "vm."),),
    "js_formdata": (("formdata",), ("append",)),
    "js_upload": (("writefile", "createwritestream", "stream.pipeline", "putobject", ".upload", ".put"),),
    "js_sql": ((".query", ".raw", ".execute"), _VERBS, ("+", "${", "string.raw")),
    "js_ssrf": (("fetch", "axios", "got", "request"), _REQUEST),
    "js_render": (("innerhtml", "outerhtml", "v-html", "document.write"),),
}

# --- generic rules -------------------------------------------------------------------


def _generic_gate(key: str, regex: str) -> Test:
    def gate(line: Line) -> Sql:
        hit = line.raw_has(regex)
        if key == "r_exec":
            call = ~line.language.equals("go") | line.code_has(fv.GO_EXEC_CALL)
            safe = line.raw.contains(fv.EXEC_SAFE_TEXT) | line.raw_has(fv.EXEC_SAFE_BUILDER)
            return hit & call & ~safe
        if key == "r_log":
            return hit & line.code_has(fv.LOG_CALL) & line.code_has(fv.LOG_SENSITIVE)
        if key == "r_timeout":
            return hit & ~line.raw_has(fv.TIMEOUT_PRESENT)
        return hit

    return gate


def _generic_rule(key: str, regex: str) -> Rule:
    gate = _generic_gate(key, regex)
    if key == "r_random":
        return Rule(
            key, GENERIC, WORDS[key], gate,
            lambda line: when(line.raw_has(fv.RANDOM_CONTEXT), lit("r_random"))
            .otherwise(lit("r_random_plain")),
            ("r_random", "r_random_plain"),
        )
    uses = frozenset({"code"}) if key in ("r_exec", "r_log") else frozenset()
    return Rule(key, GENERIC, WORDS[key], gate, lambda line: lit(key), (key,), uses=uses)


def _custom_rule(rule: CustomRule) -> Rule:
    return Rule(rule.rule_id, GENERIC, (), lambda line: line.raw_has(rule.pattern), lambda line: lit(rule.key),
                (rule.key,))


# --- Java rules ------------------------------------------------------------------------

# Literals become <open>body<close>; char literals and unterminated ones become empty, and
# escapes are neutralised at their length. A credential name directly before <open> is
# then certain to stand in code, and the whole test is one linear search.
_OPEN, _CLOSE = "\ue000", "\ue001"
_LITERALS = "'[^']*(?:'|$)|\"([^\"]*)\"|\"[^\"]*$"
_SECRET_ASSIGNED = fv.JAVA_SECRET_NAME + f"{_OPEN}[^{_OPEN}{_CLOSE}]{{8,}}{_CLOSE}\\s*(?:$|[;,)])"


def _java_secret_assigned(line: Line) -> Sql:
    neutral = line.uncommented.replaced(r"\\.", "xx")
    marked = neutral.replaced(_LITERALS, f"{_OPEN}$1{_CLOSE}")
    return line.uncommented_has(fv.JAVA_SECRET_NAME + '"') & marked.matches(_SECRET_ASSIGNED)


def _java_secret_literal(line: Line) -> Sql:
    return (line.uncommented_has(fv.JAVA_AWS_ENVIRONMENT) | line.uncommented_has(fv.AWS_KEY_ID)
            | line.uncommented_has(fv.JAVA_PEM_HEADER))


def _in_test_path(line: Line) -> Sql:
    return line.path_surface.equals("test")


def _java_log_line(line: Line) -> Sql:
    return line.code_has(fv.JAVA_LOG_CALL) & line.code_has(fv.JAVA_LOG_SENSITIVE)


def _java_log_masked(line: Line) -> Sql:
    return _java_log_line(line) & line.raw_has(fv.JAVA_LOG_MASKED)


def _graded(regex: str, column: Sql, key: str) -> Sql:
    return when(column.matches(regex), lit(f"{key}_controlled")).otherwise(lit(key))


def _java_exec(line: Line) -> Sql:
    raw = line.raw
    return (
        when(line.code_has(fv.JAVA_EXEC_RUNTIME), _graded(fv.JAVA_EXEC_CONTROLLED, raw, "j_exec_runtime"))
        .when(line.code_has(fv.JAVA_EXEC_BUILDER), _graded(fv.JAVA_EXEC_CONTROLLED, raw, "j_exec_builder"))
        .when(line.code_has(fv.JAVA_EXEC_ENGINE), lit("j_exec_engine"))
    )


def _java_sql(line: Line) -> Sql:
    bound = line.raw_has(fv.JAVA_SQL_BIND) & line.code_has(fv.JAVA_SQL_STATEMENT)
    return line.code_has(fv.JAVA_SQL_CALL) & line.raw_has(fv.JAVA_SQL_VERB) & line.raw_has(fv.JAVA_SQL_DYNAMIC) & ~bound


def _controlled(column: Sql, regex: str) -> Sql:
    return when(column.matches(regex), lit(fv.CONTROLLED_SOURCE)).otherwise(lit(fv.UNKNOWN_SOURCE))


def _call_name(column: Sql, regex: str, group: int = 1) -> Sql:
    """Matched call without surrounding blanks and the parenthesis or equals sign."""
    return column.extract(regex, group).replaced(r"^[ (=]+|[ (=]+$", "")


def _java_controls(line: Line) -> Sql:
    return present_names(line.code_context, fv.JAVA_CONTROLS)


def _java_upload(line: Line) -> Sql:
    uploaded = line.upload_context.matches(fv.JAVA_UPLOAD_SOURCE)
    utility = line.path_surface.equals("utility") & ~line.raw_has(fv.JAVA_ORIGINAL_NAME)
    stored = (
        when(utility, lit("j_upload_utility"))
        .when(Sql(f"size({_java_controls(line).text}) >= 2"), lit("j_upload_validated"))
        .otherwise(lit("j_upload"))
    )
    named = line.raw_has(fv.JAVA_ORIGINAL_NAME) & line.code_context.matches(fv.JAVA_STORAGE)
    return when(uploaded & line.code_has(fv.JAVA_UPLOAD_SINK), stored).when(uploaded & named, lit("j_upload_name"))


def _unmasked(condition: Test) -> Test:
    """A masked logging line silences every later Java rule on that line."""
    return lambda line: condition(line) & ~_java_log_masked(line)


_JAVA_USES = frozenset({"code", "uncommented", "contexts"})


def _java_rule(name, gate, variant, variants, **kw) -> Rule:
    return Rule(name, JAVA, WORDS[name], gate, variant, variants, uses=_JAVA_USES, **kw)


def _tested(line: Line, key: str) -> Sql:
    return when(_in_test_path(line), lit(f"{key}_test")).otherwise(lit(key))


def _java_rules(active: frozenset[str]) -> list[Rule]:
    def shadowed(line: Line) -> Sql:
        """The plain assignment gives way to a later secret on its line, if that one is kept."""
        constructor = line.uncommented_has(fv.JAVA_AWS_CONSTRUCTOR)
        test = _in_test_path(line)

        def kept(key: str) -> Sql:
            return when(test, lit(f"{key}_test" in active)).otherwise(lit(key in active))

        return when(constructor, kept("j_secret_awsctor")).otherwise(
            _java_secret_literal(line) & kept("j_secret_literal")
        )

    return [
        _java_rule("j_secret_assign", _java_secret_assigned,
                   lambda line: when(~shadowed(line), lit("j_secret_assign")), ("j_secret_assign",)),
        _java_rule("j_secret_known",
                   lambda line: line.uncommented_has(fv.JAVA_AWS_CONSTRUCTOR) | _java_secret_literal(line),
                   lambda line: when(line.uncommented_has(fv.JAVA_AWS_CONSTRUCTOR), _tested(line, "j_secret_awsctor"))
                   .otherwise(_tested(line, "j_secret_literal")),
                   ("j_secret_awsctor", "j_secret_awsctor_test", "j_secret_literal", "j_secret_literal_test")),
        _java_rule("j_log", _unmasked(_java_log_line), lambda line: lit("j_log"), ("j_log",)),
        _java_rule("j_exec",
                   _unmasked(lambda line: line.code_has(fv.JAVA_EXEC_RUNTIME) | line.code_has(fv.JAVA_EXEC_BUILDER)
                             | line.code_has(fv.JAVA_EXEC_ENGINE)),
                   _java_exec,
                   ("j_exec_runtime", "j_exec_runtime_controlled", "j_exec_builder",
                    "j_exec_builder_controlled", "j_exec_engine")),
        _java_rule("j_sql", _unmasked(_java_sql), lambda line: lit("j_sql"), ("j_sql",),
                   api=lambda line: call("coalesce", call("nullif", line.code.extract(fv.JAVA_SQL_API, 1), lit("")),
                                         lit(fv.SQL_API_FALLBACK)),
                   source=lambda line: _controlled(line.raw, fv.JAVA_SQL_CONTROLLED)),
        _java_rule("j_upload",
                   _unmasked(lambda line: line.code_has(fv.JAVA_UPLOAD_SINK) | line.raw_has(fv.JAVA_ORIGINAL_NAME)),
                   _java_upload, ("j_upload", "j_upload_utility", "j_upload_validated", "j_upload_name"),
                   api=lambda line: _call_name(line.code, fv.JAVA_UPLOAD_SINK), controls=_java_controls),
        _java_rule("j_path", _unmasked(lambda line: line.code_has(fv.JAVA_PATH_SINK) & line.raw_has(fv.JAVA_PATH_SOURCE)),
                   lambda line: lit("j_path"), ("j_path",),
                   api=lambda line: _call_name(line.code, fv.JAVA_PATH_SINK),
                   source=lambda line: line.raw.extract(fv.JAVA_PATH_SOURCE, 1), controls=_java_controls),
        _java_rule("j_deser", _unmasked(lambda line: line.code_has(fv.JAVA_DESER)),
                   lambda line: when(line.code_context.matches(fv.JAVA_DESER_CONTEXT), lit("j_deser")),
                   ("j_deser",)),
        _java_rule("j_tls", _unmasked(lambda line: line.code_has(fv.JAVA_TLS) & ~line.code_has(fv.JAVA_IMPORT)),
                   lambda line: lit("j_tls"), ("j_tls",)),
        _java_rule("j_random", _unmasked(lambda line: line.code_has(fv.JAVA_RANDOM)), lambda line: lit("j_random"), ("j_random",)),
    ]


# --- JavaScript / TypeScript rules ---------------------------------------------------------


def _js_secret(line: Line) -> Sql:
    known = line.raw_has(fv.AWS_KEY_ID) | line.raw_has(fv.JS_SECRET_ASSIGN) | line.raw_has(fv.JS_SECRET_CONSTRUCTOR)
    return known & ~line.raw_has(fv.JS_SECRET_ENVIRONMENT)


def _js_exec_gate(line: Line) -> Sql:
    return line.code_has(fv.JS_EVAL) | line.code_has(fv.JS_FUNCTION) | line.code_has(fv.JS_CHILD_PROCESS) | line.code_has(fv.JS_VM)


def _js_exec_api(line: Line) -> Sql:
    return (
        when(line.code_has(fv.JS_EVAL), lit("eval"))
        .when(line.code_has(fv.JS_FUNCTION), lit("Function"))
        .when(line.code_has(fv.JS_CHILD_PROCESS), line.code.extract(fv.JS_CHILD_PROCESS, 1))
        .otherwise(line.code.extract(fv.JS_VM_API, 1))
    )


def _js_exec(line: Line) -> Sql:
    raw = line.raw
    return when(
        line.code_has(fv.JS_EVAL) | line.code_has(fv.JS_FUNCTION), _graded(fv.JS_EXEC_CONTROLLED, raw, "js_exec_eval")
    ).otherwise(_graded(fv.JS_EXEC_CONTROLLED, raw, "js_exec"))


def _js_sql(line: Line) -> Sql:
    return (line.code_has(fv.JS_SQL_CALL) & line.raw_has(fv.JS_SQL_VERB) & line.raw_has(fv.JS_SQL_DYNAMIC) & ~line.raw_has(fv.JS_SQL_BIND))


def _js_controls(line: Line) -> Sql:
    return present_names(line.raw_context, fv.JS_CONTROLS)


def _js_uploaded(line: Line) -> Sql:
    return line.code_context.matches(fv.JS_UPLOAD_SOURCE)


def _js_upload_named(line: Line) -> Sql:
    return (_js_uploaded(line) & line.raw_context.matches(fv.JS_ORIGINAL_NAME)
            & line.raw_context.matches(fv.JS_STORAGE))


_SCRIPT_USES = frozenset({"code", "contexts"})


def _script_rule(name, gate, variant, variants, **kw) -> Rule:
    return Rule(name, SCRIPT, WORDS[name.removesuffix("_name")], gate, variant, variants, uses=_SCRIPT_USES, **kw)


def _script_rules() -> list[Rule]:
    return [
        _script_rule("js_secret", _js_secret,
                     lambda line: when(line.raw_has(fv.JS_SECRET_ASSIGN), lit("js_secret_assign"))
                     .otherwise(lit("js_secret")),
                     ("js_secret_assign", "js_secret")),
        _script_rule("js_log", lambda line: line.code_has(fv.JS_LOG_CALL) & line.code_has(fv.JS_LOG_SENSITIVE),
                     lambda line: when(line.raw_has(fv.JS_LOG_PRESENCE), lit("js_log_presence")).otherwise(lit("js_log")),
                     ("js_log_presence", "js_log")),
        _script_rule("js_exec", _js_exec_gate, _js_exec,
                     ("js_exec", "js_exec_controlled", "js_exec_eval", "js_exec_eval_controlled"),
                     api=_js_exec_api),
        _script_rule("js_formdata", lambda line: line.code_has(fv.JS_FORM_APPEND) & ~line.code_has(fv.JS_UPLOAD_SINK),
                     lambda line: lit("js_formdata"), ("js_formdata",)),
        _script_rule("js_upload", lambda line: line.code_has(fv.JS_UPLOAD_SINK),
                     lambda line: when(_js_uploaded(line), lit("js_upload")), ("js_upload",),
                     api=lambda line: _call_name(line.code, fv.JS_UPLOAD_SINK),
                     source=lambda line: line.code_context.extract(fv.JS_UPLOAD_SOURCE, 1),
                     controls=_js_controls),
        _script_rule("js_upload_name", lambda line: line.code_has(fv.JS_UPLOAD_SINK),
                     lambda line: when(_js_upload_named(line), lit("js_upload_name")), ("js_upload_name",),
                     controls=_js_controls),
        _script_rule("js_sql", _js_sql, lambda line: lit("js_sql"), ("js_sql",),
                     api=lambda line: _call_name(line.code, fv.JS_SQL_CALL),
                     source=lambda line: _controlled(line.raw, fv.JS_SQL_CONTROLLED)),
        _script_rule("js_ssrf", lambda line: line.code_has(fv.JS_OUTBOUND) & line.raw_has(fv.JS_OUTBOUND_CONTROLLED),
                     lambda line: lit("js_ssrf"), ("js_ssrf",),
                     api=lambda line: _call_name(line.code, fv.JS_OUTBOUND)),
        _script_rule("js_render", lambda line: line.code_has(fv.JS_RENDER),
                     lambda line: when(~line.code_context.matches(fv.JS_SANITIZED), lit("js_render")),
                     ("js_render",),
                     api=lambda line: _call_name(line.code, fv.JS_RENDER)),
    ]


# --- catalogue ---------------------------------------------------------------------------

CATALOGUE = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.IntegerType()),
    T.StructField("classification", T.StringType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("cwes", T.ArrayType(T.StringType())),
    T.StructField("fixed_source", T.StringType()),
    T.StructField("fixed_sink", T.StringType()),
    T.StructField("fixed_flow", T.ArrayType(T.StringType())),
    T.StructField("syntax", T.StringType()),
    T.StructField("fixed_api", T.StringType()),
    T.StructField("proof_gaps", T.ArrayType(T.StringType())),
    T.StructField("counterevidence", T.ArrayType(T.StringType())),
    T.StructField("false_positives", T.ArrayType(T.StringType())),
    T.StructField("verify", T.ArrayType(T.StringType())),
    T.StructField("sensitive_value", T.StringType()),
    T.StructField("logging_sink", T.StringType()),
])
_EMPTY = dict.fromkeys(CATALOGUE.fieldNames())


def _generic_entry(key, rule_id, title, category, severity, confidence, cwes) -> dict:
    high = confidence >= 75
    entry = dict(
        _EMPTY, key=key, family="generic", rule_id=rule_id, title=title, reason=title, category=category,
        severity=severity, confidence=confidence, cwes=list(cwes), fixed_flow=[], proof_gaps=[],
        counterevidence=[], false_positives=[], verify=[],
        classification="high_confidence_candidate" if high else "review_lead",
        verdict="high_confidence_candidate" if high else "secure_coding_concern",
    )
    if key in ("r_sql", "r_exec", "r_ssrf"):
        entry.update(fixed_source=fv.REQUEST_SOURCE, fixed_sink=category, fixed_flow=[fv.PARTIAL_FLOW])
    if key in ("r_authz", "r_path", "r_upload"):
        entry.update(classification="review_lead", verify=[fv.TRACE_HANDLER])
    if key == "r_weak":
        entry.update(classification="review_lead", false_positives=[fv.WEAK_FALSE_POSITIVE])
    if key == "r_log":
        entry.update(fixed_source=fv.LOG_SOURCE, fixed_sink=fv.LOG_SINK, fixed_flow=[fv.LOG_FLOW],
                     logging_sink=fv.LOG_SINK_NAMES, sensitive_value=fv.LOG_SENSITIVE_VALUE)
    return entry


def _structured_entry(rule: dict) -> dict:
    texts = fv.JAVA_TEXTS if rule["key"].startswith("j_") else fv.JS_TEXTS
    return dict(
        _EMPTY, key=rule["key"], family="java" if texts is fv.JAVA_TEXTS else "script",
        rule_id=rule["rule_id"], title=rule["title"], reason=rule["reason"], category=rule["category"],
        severity=rule["severity"], confidence=rule["confidence"],
        classification=rule.get("classification", "review_lead"),
        verdict=rule.get("verdict", "secure_coding_concern"), cwes=list(rule.get("cwes", ())),
        fixed_source=rule.get("source"), fixed_sink=rule["sink"] if "sink" in rule else None,
        fixed_flow=[], syntax=rule["syntax"], fixed_api=rule["api"],
        proof_gaps=list(rule.get("proof_gaps", ())), counterevidence=list(rule.get("counterevidence", ())),
        false_positives=[texts["false_positive"]], verify=[rule["reason"], texts["verify"]],
        sensitive_value=rule.get("sensitive_value"), logging_sink=rule.get("logging_sink"),
    )


def catalogue_entries(custom: Iterable[CustomRule] = ()) -> list[dict]:
    """All variants a line rule can yield, as plain rows."""
    entries = []
    for key, rule_id, _, title, category, severity, confidence, cwes in fv.GENERIC_RULES:
        entries.append(_generic_entry(key, rule_id, title, category, severity, confidence, cwes))
        if key == "r_random":
            plain = _generic_entry("r_random_plain", rule_id, title, category, "informational", 30, ())
            plain.update(classification="review_point", verdict="review_point",
                         false_positives=[fv.RANDOM_FALSE_POSITIVE])
            entries.append(plain)
    structured = {rule["key"]: _structured_entry(rule) for rule in fv.STRUCTURED_RULES}

    def derive(base: str, key: str, **changes) -> None:
        structured[key] = dict(structured[base], key=key, **changes)

    lead = dict(fixed_source=fv.CONTROLLED_SOURCE, classification="high_confidence_candidate")
    derive("j_secret_awsctor", "j_secret_awsctor_test", severity="low")
    derive("j_secret_literal", "j_secret_literal_test", severity="low")
    derive("j_exec_runtime", "j_exec_runtime_controlled", confidence=88, **lead)
    derive("j_exec_builder", "j_exec_builder_controlled", confidence=84, **lead)
    derive("js_secret", "js_secret_assign", syntax="literal_assignment")
    derive("js_exec", "js_exec_eval", cwes=["CWE-95"])
    for base in ("js_exec", "js_exec_eval"):
        derive(base, f"{base}_controlled", confidence=90, verdict="high_confidence_candidate", **lead)
    entries.extend(structured.values())
    for rule in custom:
        entries.append(_generic_entry(rule.key, rule.rule_id, rule.title, rule.category, rule.severity,
                                      rule.confidence, rule.cwes))
    return entries


def line_rules(active: frozenset[str], custom: Iterable[CustomRule] = ()) -> list[Rule]:
    """Rules in emission order, without those none of whose variants is active."""
    rules = [_generic_rule(entry[0], entry[2]) for entry in fv.GENERIC_RULES]
    rules += [_custom_rule(rule) for rule in custom]
    rules += _java_rules(active) + _script_rules()
    return [rule for rule in rules if active & set(rule.variants)]


# --- matching -------------------------------------------------------------------------------


def in_group(rules: list[Rule], languages: tuple[str, ...]) -> list[Rule]:
    return [rule for rule in rules if rule.languages == languages]


def batches(rules: list[Rule]) -> list[list[Rule]]:
    """The rules in as many lists as it takes for each group to fit the bits of a mask."""
    result: list[list[Rule]] = []
    for languages in GROUPS:
        group = in_group(rules, languages)
        for number, start in enumerate(range(0, len(group), GROUP_BITS)):
            if number == len(result):
                result.append([])
            result[number].extend(group[start:start + GROUP_BITS])
    return result


def _mask(conditions: list[Sql]) -> Sql:
    bits = [f"if({condition.text}, {1 << i}L, 0L)" for i, condition in enumerate(conditions)]
    return Sql("(" + " | ".join(bits) + ")")


def _has_bit(mask: str, position: int) -> Sql:
    return Sql(f"({mask} & {1 << position}L) <> 0")


def _per_group(rules: list[Rule], value: Callable[[list[Rule]], Sql], otherwise: str) -> Column:
    """A value chosen by language; the rules of other languages are not even looked at."""
    cases = []
    for languages in GROUPS:
        group = in_group(rules, languages)
        if group:
            names = ", ".join(lit(name).text for name in languages)
            cases.append((Sql(f"language in ({names})"), value(group)))
    return F.expr(Case(cases).otherwise(Sql(otherwise)).text if cases else otherwise)


def uses_code(rules: list[Rule], mask: str) -> Column:
    """Whether a file needs its masked lines: some rule it has words for reads them."""
    def needed(group: list[Rule]) -> Sql:
        bits = sum(1 << i for i, rule in enumerate(group) if "code" in rule.uses)
        return Sql(f"({mask} & {bits}L) <> 0")

    return _per_group(rules, needed, "false")


def reads(rules: list[Rule], mask: Column, context: str) -> Column:
    """Whether a rule of the mask looks at that context of its line once the line has passed its gate."""
    line = Line()
    bits = F.lit(0).cast("bigint")
    for languages in GROUPS:
        own = sum(1 << i for i, rule in enumerate(in_group(rules, languages))
                  if any(context in test(line).text for test in (rule.variant, rule.api, rule.source, rule.controls) if test))
        bits = F.when(F.col("language").isin(*languages), F.lit(own).cast("bigint")).otherwise(bits)
    return mask.bitwiseAND(bits) != 0


def line_masks(rules: list[Rule], lines: str, keep: tuple[str, ...]) -> Column:
    """For an array of lines, the fields `keep` and `mask`: the rules whose gate each line passes, as bits.

    `words` of a line has the bits of the rules whose words it holds; no other rule looks at it.
    """
    line = Line("x.", "_lines")
    kept = ", ".join(f"'{name}', x.{name}" for name in keep)

    def of_group(group: list[Rule]) -> Sql:
        tests = [_has_bit("x.words", i) & rule.gate(line) for i, rule in enumerate(group)]
        return Sql(f"transform({lines}, x -> named_struct({kept}, 'mask', {_mask(tests).text}))")

    return _per_group(rules, of_group, "null")


_NO_TEXT = Sql("cast(null as string)")
_NO_LIST = Sql("cast(array() as array<string>)")


def _match(rule: Rule, position: int, line: Line) -> Sql:
    fields = {
        "ord": lit(position),
        "key": rule.variant(line),
        "api": rule.api(line) if rule.api else _NO_TEXT,
        "source": rule.source(line) if rule.source else _NO_TEXT,
        "controls": rule.controls(line) if rule.controls else _NO_LIST,
    }
    parts = [part for name, value in fields.items() for part in (lit(name), value)]
    return when(_has_bit("mask", position), call("named_struct", *parts))


def line_matches(lines: DataFrame, rules: list[Rule], active: frozenset[str], keep: list[str]) -> DataFrame:
    """One row per (line, matching rule)."""
    line = Line()

    def found(group: list[Rule]) -> Sql:
        return call("array", *[_match(rule, position, line) for position, rule in enumerate(group)])

    nothing = "cast(array() as array<struct<ord:int,key:string,api:string,source:string,controls:array<string>>>)"
    # rules that a line does not match make no rows
    matches = F.array_compact(_per_group(rules, found, nothing))
    rows = lines.select(*keep, "line_no", "evidence", F.explode(matches).alias("match"))
    return rows.filter(F.col("match.key").isin(*sorted(active))).select(
        *keep, "line_no", "evidence", "match.ord", "match.key", "match.api", "match.source", "match.controls"
    )


# --- findings -------------------------------------------------------------------------------


def finding_columns(values: dict[str, str]) -> list[str]:
    """The columns of the findings table as SQL: given expressions, defaults for the rest."""
    columns = []
    for schema_field in FINDINGS:
        name, kind = schema_field.name, schema_field.dataType
        if name in values:
            expression = values[name]
        elif isinstance(kind, T.ArrayType):
            expression = "array()"
        elif isinstance(kind, T.MapType):
            expression = "map()"
        else:
            default = FINDING_DEFAULTS.get(name)
            expression = "null" if default is None else lit(default).text
        columns.append(f"cast({expression} as {kind.simpleString()}) as {name}")
    return columns


def _group_of(entry: dict) -> tuple[str, ...]:
    return {"java": JAVA, "script": SCRIPT}.get(entry["family"], GENERIC)


# Fields of a finding that the line decides; the rule variant, the language and whether the file
# is test code decide all others.
_VARIABLE = ("match_key", "match_language", "match_test", "family", "reason", "fixed_source", "fixed_sink", "fixed_api")


_TEMPLATE_FIELDS = (
    "rule_id", "title", "category", "subcategory", "language", "classification", "confidence_score",
    "suggested_severity", "cwe_ids", "missing_or_questionable_controls", "missing_controls",
    "false_positive_conditions", "recommended_remediation", "analyzer", "verdict_candidate", "reachability",
    "proof_gaps", "counterevidence", "parser_used", "syntax_node_type", "invocation_detected", "test_surface",
    "sensitive_value", "logging_sink", "rule_family", "test_only", "production_reachability", "source_detected",
    "sink_detected", "flow_status", "evidence_level", "evidence_score", "evidence_completeness",
)


def templates(spark: SparkSession, entries: list[dict], options: ScanOptions) -> DataFrame:
    """One finding per rule variant, language and kind of surface, enriched and filtered.

    Grades, texts, flow status and the filters depend on nothing else, so they are worked out
    here, on a few hundred rows, and the findings themselves only pick them up in a join.
    """
    names = CATALOGUE.fieldNames()
    rows = [
        (language, test, *(entry[name] for name in names))
        for entry in entries for language in _group_of(entry) for test in (False, True)
    ]
    schema = T.StructType([T.StructField("match_language", T.StringType()),
                           T.StructField("match_test", T.BooleanType()), *CATALOGUE.fields])
    table = spark.createDataFrame(rows, schema)
    java, script = fv.JAVA_TEXTS, fv.JS_TEXTS

    def by_family(generic: str, of_java: str, of_script: str) -> str:
        return f"case family when 'java' then {of_java} when 'script' then {of_script} else {generic} end"

    def texts(name: str, generic: str) -> str:
        return by_family(generic, lit(java[name]).text, lit(script[name]).text)

    missing = by_family("cast(array() as array<string>)", f"array({lit(java['missing']).text})",
                        f"array({lit(script['missing']).text})")
    syntax = ", ".join(lit(name).text for name in fv.INVOCATION_SYNTAX)
    dynamic = ", ".join(lit(key).text for key in ("j_sql", "j_path", "js_upload", "js_sql"))
    columns = finding_columns(dict(
        rule_id="rule_id", title="title", category="category", subcategory=texts("subcategory", "'secure-coding'"),
        language="match_language", classification="classification", confidence_score="confidence",
        suggested_severity="severity", cwe_ids="cwes",
        # a source or sink read from the line is never empty
        source=f"if(key in ({dynamic}), 'read from the line', fixed_source)", sink="fixed_sink",
        data_flow="fixed_flow", missing_or_questionable_controls=missing,
        missing_controls=f"if(family = 'java', {missing}, array())",
        false_positive_conditions="false_positives", recommended_verification_steps="verify",
        recommended_remediation=texts("remediation", lit(fv.DEFAULT_REMEDIATION).text),
        analyzer=texts("analyzer", "concat(match_language, '.lexical')"),
        verdict_candidate="verdict", code_surface="if(match_test, 'test', 'other')",
        reachability="if(family <> 'generic' and match_test, 'test_only', 'unknown')",
        proof_gaps="proof_gaps", counterevidence="counterevidence", parser_used=texts("parser", "'lexical'"),
        syntax_node_type="syntax", invocation_detected=f"coalesce(syntax in ({syntax}), false)",
        test_surface="match_test", sensitive_value="sensitive_value", logging_sink="logging_sink",
    ))
    plain = table.withColumnRenamed("key", "match_key").selectExpr(
        *_VARIABLE, *[column.replace("if(key in", "if(match_key in") for column in columns])
    return plain.transform(enrich.enrich).transform(enrich.apply_filters, options)


def broadcast_templates(table: DataFrame, rows: int) -> DataFrame:
    """The templates with a broadcast hint while their number is within the bound."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def to_findings(matches: DataFrame, table: DataFrame, framework: str | None = None) -> DataFrame:
    """Matches joined with the finding templates, in the shape of the findings table."""
    surfaced = matches.selectExpr("*", "if(code_surface <> 'unknown', code_surface, path_surface) as surface")
    template = table.select(*[F.col(name).alias(f"t_{name}") for name in table.columns])
    joined = surfaced.join(
        template,
        (F.col("key") == F.col("t_match_key")) & (F.col("language") == F.col("t_match_language"))
        & ((F.col("surface") == "test") == F.col("t_match_test")),
    )
    # the text of the catalogue wins: an upload by original filename names no call
    called = joined.selectExpr(
        "*", "t_family <> 'generic' as structured", "coalesce(t_fixed_api, api) as called",
        "coalesce(source, t_fixed_source) as origin")
    target = "if(t_fixed_sink = '{api}', called, t_fixed_sink)"
    reason = "replace(t_reason, '{api}', coalesce(called, ''))"
    # The lambda also keeps this wide projection out of whole-stage code: a projection of its own
    # is split into methods the JVM compiles, one fused method of this width would stay interpreted.
    controls = """concat('[', array_join(transform(controls, name -> concat("'", name, "'")), ', '), ']')"""
    notes = (f"concat('syntax=', t_syntax_node_type, '; invoked_api=', called, '; source=', "
             f"coalesce(origin, 'unknown'), '; sink=', coalesce({target}, 'unknown'), '; controls=', {controls}, "
             f"'; reason=', {reason})")
    given = dict(
        repo="repo", id="substring(sha2(concat_ws(':', t_rule_id, path, line_no), 256), 1, 16)",
        description=reason, file_path="path", start_line="line_no", end_line="line_no", source="origin", sink=target,
        data_flow="if(structured, array(concat('syntax=', t_syntax_node_type), concat('invoked_api=', called)), "
                  "t_data_flow)",
        observed_controls="controls", evidence="evidence", code_surface="surface",
        recommended_verification_steps="if(contains(t_reason, '{api}'), array(" + reason
        + ", get(t_recommended_verification_steps, 1)), t_recommended_verification_steps)",
        verification_notes=f"if(structured, {notes}, '')", exact_invoked_api="if(structured, called, null)",
        framework="null" if framework is None else f"if(structured, null, {lit(framework).text})",
        emit_seq="named_struct('origin', 0, 'file', path, 'phase', 0, 'pos', cast(line_no as bigint), 'ord', ord)",
    )
    picked = {name: f"t_{name}" for name in _TEMPLATE_FIELDS}
    return called.selectExpr(*finding_columns({**picked, **given}))
