"""Column functions for text, paths, labels and similarity. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by extension; others are text.
LANGUAGES = {
    ".cs": "csharp", ".xaml": "xml", ".xml": "xml", ".json": "json", ".js": "javascript", ".ts": "typescript", ".html": "html",
    ".css": "css", ".sql": "sql", ".py": "python", ".md": "markdown", ".yaml": "yaml", ".yml": "yaml", ".csproj": "xml",
}


def parse_list(text: Column) -> Column:
    """Items between commas and semicolons, trimmed, without empty ones. A space does not separate."""
    return F.filter(F.transform(F.split(text, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def parse_ignored(text: Column) -> Column:
    """parse_list in lower case, with .git, each once."""
    return F.array_distinct(F.concat(F.transform(parse_list(text), lambda x: F.lower(x)), F.array(F.lit(".git"))))


def language_of(extension: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(pairs[extension], F.lit("text"))


def estimated_tokens(size_bytes: Column) -> Column:
    """Bytes div 4."""
    return F.floor(size_bytes / 4).cast("int")


def visible_whitespace(line: Column) -> Column:
    """Tabs as arrows, spaces as dots, carriage returns dropped."""
    return F.translate(line, "\t \r", "→·")


def truncated(text: Column, limit: int, keep: int) -> Column:
    """Texts longer than limit: their first keep characters and an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def leading_width(line: Column) -> Column:
    """Width of the indentation: a space is 1, a tab 4."""
    lead = F.regexp_extract(line, "^([ \t]*)", 1)
    return F.length(lead) + 3 * (F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit(""))))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    """With the dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]?[^/\\]*$", "")


def normal_path(path: Column) -> Column:
    """Lower case, slashes forward, no leading slash."""
    return F.regexp_replace(F.lower(F.translate(path, "\\", "/")), "^/+", "")


def resolved_path(path: Column) -> Column:
    """Without . and name/.. segments."""
    step = lambda done, x: F.when(x.isin(".", ""), done).when((x == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(F.split(F.translate(path, "\\", "/"), "/"), F.array().cast("array<string>"), step), "/")


def namespace_of(path: Column) -> Column:
    """Directories joined by dots."""
    return F.regexp_replace(directory(F.translate(path, "\\", "/")), "/", ".")


def size_label(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / (1024 * 1024)), F.lit(" MB")))
    )


def duration_label(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("int")
    minutes, hours = (whole / 60).cast("int"), (whole / 3600).cast("int")
    return (
        F.when(whole >= 3600, F.format_string("%dh %dm", hours, minutes % 60)).when(whole >= 60, F.format_string("%dm %ds", minutes, whole % 60)).otherwise(F.format_string("%ds", whole))
    )


def contains_ci(text: Column, what: Column | str) -> Column:
    return F.contains(F.lower(text), F.lower(F.lit(what) if isinstance(what, str) else what))


def escaped(literal: str) -> str:
    """A literal as a pattern that Java and RE2 read alike."""
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in literal)


def normalised_code(text: Column) -> Column:
    """White space collapsed, lower case, trimmed."""
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def ngrams(text: Column, n: int = 5) -> Column:
    """The set of substrings of n characters; a shorter text is its own only one."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(grams)


def substrings(text: Column, lengths: list[int]) -> Column:
    """The different substrings of these lengths: what a text may hold can then be found by an equi-join."""
    none = F.array().cast("array<string>")

    def of_length(n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(none)

    pieces = [of_length(n) for n in lengths]
    return F.array_distinct(F.concat(*pieces)) if pieces else none


def similarity(a: Column, b: Column, long: int = 500) -> Column:
    """Percent, truncated: 100 if equal, 0 if one is shorter than half of the other; by 5-grams if one is longer than long
    characters, else by edit distance."""
    most, least = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    x, y = ngrams(a), ngrams(b)
    both = F.size(F.array_intersect(x, y))
    jaccard = both / (F.size(x) + F.size(y) - both) * 100
    edits = (F.lit(1.0) - F.levenshtein(a, b) / most) * 100
    return F.when(a == b, 100).when(least < most * 0.5, 0).when(most > long, jaccard.cast("int")).otherwise(edits.cast("int")).cast("int")
