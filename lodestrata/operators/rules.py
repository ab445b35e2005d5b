"""Lint rules: built-in ones over members and types, and user rules by regular expressions. All are previews."""

from __future__ import annotations

import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ci
from ..plans.shared import map_texts, numbered

#: Built-in rules with the words that call them, types passed by value, exempt names, suffixes of services.
INTENTS = {
    "add_xml_doc": ("xml doc", "doc comment", "document", "summary", "/// "),
    "add_null_checks": ("null check", "null guard", "argument null", "throwifnull", "null validation"),
    "extract_interfaces": ("extract interface", "generate interface", "create interface", "add interface"),
    "enforce_async_naming": ("async naming", "async suffix", "rename async", "async convention"),
    "add_sealed": ("sealed", "seal class", "add sealed", "no inheritance"),
}
VALUE_TYPES = (
    "int long short byte float double decimal bool char uint ulong ushort sbyte nint nuint int32 int64 int16 single boolean uint32 uint64 uint16 "
    "datetime datetimeoffset timespan guid dateonly timeonly cancellationtoken"
).split()
ASYNC_EXEMPT = "main oninitialized onafterrender dispose disposeasync onnavigatedto onnavigatedfrom onappearing ondisappearing".split()
#: Seconds that a match, and its exclusion, may take.
FIND_SECONDS, EXCLUDE_SECONDS = 5.0, 2.0
SERVICE_SUFFIXES = ("Service", "Handler", "Repository", "Manager", "Provider", "Factory")


def resolve_intent(text: str, custom: dict[str, tuple[str, ...]] | None = None) -> str | None:
    """The rule of that name, in any case, or the first of whose words the text holds one. Custom rules replace those of their name."""
    known = INTENTS | (custom or {})
    lower = text.lower()
    by_name = {k.lower(): k for k in known}
    return by_name.get(lower) or next((k for k, words in known.items() if any(w.lower() in lower for w in words)), None)


def in_scope(files: DataFrame, scope: str | None) -> DataFrame:
    """Files whose namespace begins with scope or whose path holds it, in any case; all for none or all."""
    if not scope or scope.lower() == "all":
        return files
    return files.filter(F.lower("namespace").startswith(scope.lower()) | contains_ci(F.col("relative_path"), scope))


def capped(found: DataFrame, max_targets: int = 50) -> DataFrame:
    """found of the first max_targets (1 to 200) files."""
    n = max(1, min(200, max_targets))
    kept = found.select("file_ord").distinct().orderBy("file_ord").limit(n)
    return found.join(F.broadcast(kept), "file_ord", "left_semi")  # n rows at most


def undocumented(members: DataFrame) -> DataFrame:
    return members.filter("access_modifier = 'public' and kind in ('Method', 'Property') and coalesce(xml_doc, '') = ''")


def unchecked_parameters(members: DataFrame) -> DataFrame:
    """member_ord, parameter: parameters of reference types of public methods and constructors whose body checks nothing of them."""
    rows = members.filter("access_modifier = 'public' and kind in ('Method', 'Constructor')").select("file_ord", "member_ord", "name", F.coalesce("body", F.lit("")).alias("body"), F.posexplode("parameters").alias("pos", "p"))
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.trim("p"), "^this ", ""), "^params ", ""), " "), lambda w: w != "")
    rows = rows.withColumn("words", words).filter(F.size("words") >= 2)
    kind = F.lower(F.regexp_replace(F.col("words")[0], r"\?$", ""))
    rows = rows.filter(~kind.isin(*VALUE_TYPES)).withColumn("parameter", F.regexp_replace(F.element_at("words", -1), ",+$", ""))
    b, p = F.col("body"), F.col("parameter")
    checked = F.contains(b, F.concat(F.lit("ThrowIfNull("), p)) | b.contains("ArgumentNullException") | F.contains(b, F.concat(p, F.lit(" == null"))) | F.contains(b, F.concat(p, F.lit(" is null")))
    return rows.filter(~checked).select("file_ord", "member_ord", "name", "pos", "parameter")


def missing_interfaces(types: DataFrame, members: DataFrame) -> DataFrame:
    """type_ord, name, n_members of service classes without an interface of their own and with public members."""
    rows = types.filter("kind = 'Class'").filter(F.rlike("name", F.lit(f"({'|'.join(SERVICE_SUFFIXES)})$")))
    rows = rows.filter(~F.exists("interfaces", lambda i: F.lower(i) == F.concat(F.lit("i"), F.col("name_lc"))))
    public = members.filter("access_modifier = 'public' and kind in ('Method', 'Property')").select("type_ord", F.col("name").alias("member"))
    return rows.join(public, "type_ord").filter("member <> name").groupBy("file_ord", "type_ord", "name").agg(F.count("*").alias("n_members"))


def async_without_suffix(members: DataFrame) -> DataFrame:
    ok = F.col("name").endswith("Async") | F.col("name_lc").isin(*ASYNC_EXEMPT) | (F.col("return_type") == "void")
    return members.filter((F.col("kind") == "Method") & F.col("is_async") & ~ok).withColumn("new_name", F.concat("name", F.lit("Async")))


def sealable(types: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Classes that are not abstract, that no type derives from, and whose line does not say sealed."""
    bases = types.filter("base_type <> ''").select(F.lower("base_type").alias("name_lc")).distinct()
    rows = types.filter("kind = 'Class' and not is_abstract").join(bases, "name_lc", "left_anti")
    if lines is not None:
        sealed = lines.filter(F.col("text").contains(" sealed ")).select("file_ord", F.col("line_no").alias("start_line"))
        rows = rows.join(sealed, ["file_ord", "start_line"], "left_anti")
    return rows


def load_rules(text: str) -> list[dict]:
    """Rules of a JSON document with comments and trailing commas; those without name or pattern are skipped, of equal names the last stays."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    rules = json.loads(re.sub(r",(\s*[}\]])", r"\1", text))
    rules = {k.lower(): v for k, v in rules.items()}.get("customintents") or []
    rules = [{k.lower(): v for k, v in r.items()} for r in rules]
    return list({r["name"].lower(): r for r in rules if r.get("name") and r.get("findpattern")}.values())


def translated(pattern: str) -> str:
    """A pattern of rules in the dialect of the matcher, which has other names for references to named groups."""
    return re.sub(r"\\k<(\w+)>", r"(?P=\1)", pattern)


def required_literal(pattern: str, least: int = 3) -> str | None:
    """The longest text that every match holds, as a parse tree of the pattern tells: characters that follow each other outside of choices, repetitions
    and groups with flags. None where there is none of that length, or the pattern is not of the parser's dialect."""
    try:
        tree = re._parser.parse(re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", pattern), re.M)
    except (re.error, OverflowError):
        return None
    if tree.state.flags & re.I:
        return None
    found, now = [], []
    for kind, value in [*tree, (None, None)]:
        if kind is re._constants.LITERAL:
            now.append(chr(value))
        else:
            found.append("".join(now))
            now = []
    best = max(found, key=len)
    return best if len(best) >= least else None


def _parts(replacement: str) -> list[str | tuple[str]]:
    """A replacement as texts and groups, (name or number,): $1, ${name}, $& and $$."""
    out: list[str | tuple[str]] = []
    for text, group in re.findall(r"([^$]+)|\$(\d+|\{\w+\}|&|\$|)", replacement):
        out.append(text or ("$" if group in ("$", "") else ("0" if group == "&" else group.strip("{}"),)))
    return out


def _replaced(m, parts: list[str | tuple[str]]) -> str:
    """The parts for a match; a group that the pattern does not have stands for itself."""
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(p)
            continue
        try:
            out.append(m[int(p[0]) if p[0].isdigit() else p[0]] or "")
        except IndexError:
            out.append(f"${p[0]}" if p[0].isdigit() else f"${{{p[0]}}}")
    return "".join(out)


def first_rules(texts: list[str | None]) -> list[dict]:
    """The rules of the first directory that has a document of them (None: it has none); those of later directories do not count."""
    return next((load_rules(t) for t in texts if t is not None), [])


def rule_matches(files: DataFrame, rule: dict, find_s: float = FIND_SECONDS, exclude_s: float = EXCLUDE_SECONDS) -> DataFrame:
    """file_ord, line, found, replacement (null for a rule that only reports), error of a rule over whole texts, line by its offset.

    files: file_ord, relative_path, extension, text. The matcher knows all of Unicode and can be stopped: a file with a match that takes longer than find_s seconds,
    or an exclusion than exclude_s, gives one row with an error and no others. A pattern that is none gives one row with an error alone. Only files that
    hold the text that every match holds, if the pattern has one, leave the JVM."""
    find, exclude, replace = (rule.get(k) for k in ("findpattern", "excludepattern", "replacepattern"))
    find, exclude, parts = translated(find), translated(exclude) if exclude else None, _parts(replace) if replace else None
    if wanted := rule.get("filefilter"):
        ext = F.lower("extension")
        files = files.filter(contains_ci(F.col("relative_path"), wanted) | (ext == wanted.lower()) | (ext == "." + wanted.lower().lstrip(".")))
    schema = f"file_ord {files.schema['file_ord'].dataType.simpleString()}, line int, found string, replacement string, error string"
    try:
        for p in (find, exclude or ""):
            regex.compile(p, regex.M)
    except regex.error as e:
        return files.sparkSession.createDataFrame([(None, None, None, None, f"Invalid regex in rule '{rule.get('name', '')}': {e}")], schema)

    def matches(text: str, pattern, skip) -> list[tuple]:
        out, line, counted, at = [], 1, 0, 0
        while at <= len(text) and (m := pattern.search(text, at, timeout=find_s)):
            at = m.end() + (m.end() == m.start())
            if skip and skip.search(m[0], timeout=exclude_s):
                continue
            line += text.count("\n", counted, m.start())
            counted = m.start()
            out.append((line, m[0], _replaced(m, parts) if parts is not None else None, None))
        return out

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        pattern, skip = regex.compile(find, regex.M), regex.compile(exclude, regex.M) if exclude else None  # compiled once: regex keeps them
        out = []
        for ord_, text in zip(b.column("file_ord").to_pylist(), b.column("text").to_pylist(), strict=True):
            try:
                out += [(ord_, *x) for x in matches(text or "", pattern, skip)]
            except TimeoutError:
                out.append((ord_, None, None, None, "The rule takes too long"))
        kinds = [b.schema.field("file_ord").type, pa.int32(), pa.string(), pa.string(), pa.string()]
        cols = zip(*out, strict=True) if out else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file_ord", "line", "found", "replacement", "error"])

    rows = files.select("file_ord", "text")
    if (held := required_literal(find)) is not None:
        rows = rows.filter(F.contains("text", F.lit(held)))
    return map_texts(rows, scan, schema)


def line_violations(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """rule, file_ord, line_no of the lines that match the pattern of a rule; the patterns are columns of one scan."""
    rules = F.array_compact(F.array(*[F.when(F.rlike("text", F.lit(p)), F.lit(name)) for name, p in patterns.items()]))
    return lines.select("file_ord", "line_no", F.explode(rules).alias("rule")).select("rule", "file_ord", "line_no")


def grep_replace(lines: DataFrame, pattern: str, replacement: str, case_sensitive: bool = False, exclude_pattern: str | None = None, exclude_matches: tuple[int, ...] = ()) -> DataFrame:
    """match_index, file_ord, line_no, old, new of the lines that match, by a running index over all of them from 1."""
    text = pattern if case_sensitive else f"(?i){pattern}"
    rows = lines.filter(F.rlike("text", F.lit(text)))
    if exclude_pattern:
        rows = rows.filter(~F.rlike("text", F.lit(exclude_pattern)))
    rows = numbered(rows.select("file_ord", "line_no", "text"), ["file_ord", "line_no"], "match_index")
    if exclude_matches:
        rows = rows.filter(~F.col("match_index").isin(*exclude_matches))
    return rows.select("match_index", "file_ord", "line_no", F.col("text").alias("old"), F.regexp_replace("text", text, replacement).alias("new"))
