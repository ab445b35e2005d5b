"""Classes of build errors: lookup by code, types by name, choice of what can be mended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Category, whether it can be mended, confidence, by error code.
CATEGORIES = {
    "CS0104": ("ambiguous_reference", True, 0.85),
    "CS1002": ("missing_semicolon", True, 0.95),
    "CS8600": ("null_warning", False, 0.3),
    "CS8602": ("null_warning", False, 0.3),
    "CS8603": ("null_warning", False, 0.3),
    "CS8604": ("null_warning", False, 0.3),
    "CS0534": ("abstract_not_implemented", False, 0.5),
    "CS0535": ("interface_not_implemented", False, 0.5),
    "CS0029": ("type_mismatch", False, 0.3),
    "CS0266": ("type_mismatch", False, 0.3),
    "CS0161": ("missing_return", False, 0.0),
}
MISSING = ("CS0246", "CS0103")
FIXED = ("missing_using", "ambiguous_reference", "missing_semicolon")
#: Namespaces of well-known types.
NAMESPACES = {
    "System.Collections.Generic": "List Dictionary HashSet Queue Stack LinkedList",
    "System.Collections.Concurrent": "ConcurrentDictionary ConcurrentBag ConcurrentQueue",
    "System.Text.RegularExpressions": "Regex Match",
    "System.Text": "StringBuilder Encoding",
    "System.Text.Json": "JsonSerializer JsonElement JsonSerializerOptions",
    "System.Text.Json.Serialization": "JsonProperty JsonConverter",
    "System.Threading.Tasks": "Task CancellationToken CancellationTokenSource",
    "System.Threading": "Thread Mutex Semaphore Timer",
    "System.IO": "File Directory Path Stream StreamReader StreamWriter FileInfo DirectoryInfo FileStream MemoryStream",
    "System.Diagnostics": "Process ProcessStartInfo Stopwatch Debug Trace",
    "System.Net.Http": "HttpClient HttpResponseMessage",
    "System.Net": "IPAddress IPEndPoint",
    "System.Xml.Linq": "XDocument XElement XAttribute",
    "System.Collections.ObjectModel": "ObservableCollection",
    "System.ComponentModel": "INotifyPropertyChanged",
    "System.Reflection": "Assembly",
    "Microsoft.CodeAnalysis.CSharp": "SyntaxTree SyntaxNode CSharpSyntaxTree CSharpCompilation",
    "Microsoft.CodeAnalysis": "SemanticModel ISymbol INamedTypeSymbol Diagnostic MetadataReference",
}


def well_known_namespace(name: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for ns, names in NAMESPACES.items() for n in names.split() for x in (n, ns)])
    return F.try_element_at(pairs, name)


def classified(errors: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """errors with category, is_auto_fixable, confidence and resolved_data (a namespace).

    known: (name, namespace) of the corpus's own types; a name found there is surer than a well-known one."""
    pairs = F.create_map(*[x for code, (c, fix, sure) in CATEGORIES.items() for x in (F.lit(code), F.struct(F.lit(c).alias("c"), F.lit(fix).alias("f"), F.lit(sure).alias("s")))])
    name = F.regexp_extract("message", r"['‘]([\w]+)", 1)
    rows = errors.withColumn("_name", name).withColumn("_own", F.lit(None).cast("string"))
    if known is not None:
        own = known.groupBy(F.col("name").alias("_name")).agg(F.min("namespace").alias("_found"))
        rows = rows.join(own, "_name", "left").withColumn("_own", F.col("_found")).drop("_found")
    missing, ns = F.col("error_code").isin(*MISSING), well_known_namespace(F.col("_name"))
    by = F.try_element_at(pairs, F.col("error_code"))
    pick = lambda own, well, none, no_name, field, default: F.when(missing & (F.col("_name") == ""), no_name).when(missing & F.col("_own").isNotNull(), own).when(missing & ns.isNotNull(), well).when(missing, none).otherwise(F.coalesce(by[field], F.lit(default)))
    return rows.withColumns({
        "category": pick(F.lit("missing_using"), F.lit("missing_using"), F.lit("missing_type_unresolved"), F.lit("unknown_missing_type"), "c", "unknown"),
        "is_auto_fixable": pick(F.lit(True), F.lit(True), F.lit(False), F.lit(False), "f", False),
        "confidence": pick(F.lit(0.9), F.lit(0.75), F.lit(0.0), F.lit(0.0), "s", 0.0),
        "resolved_data": F.when(missing, F.coalesce("_own", ns)),
    }).drop("_name", "_own")


def fixes(rows: DataFrame, least: float = 0.7) -> DataFrame:
    """Classified errors that can be mended, one for each file and description, the first."""
    text = F.concat_ws(" ", "category", F.coalesce("resolved_data", F.lit("")), F.when(F.col("category") != "missing_using", F.col("line").cast("string")))
    rows = rows.filter(F.col("is_auto_fixable") & (F.col("confidence") >= least) & F.col("category").isin(*FIXED)).withColumn("description", F.trim(text))
    k = F.row_number().over(W.partitionBy("file_path", "description").orderBy("line", "column", "message"))
    return rows.withColumn("_k", k).filter("_k = 1").drop("_k")


def best_candidate(text: Column, one: Column, two: Column) -> Column:
    """Of two full names, that of a namespace the text uses, else one of System, else the shorter."""
    used = lambda c: F.contains(text, F.concat(F.lit("using "), F.regexp_replace(c, r"\.[^.]*$", ""), F.lit(";")))
    return (
        F.when(used(one) & ~used(two), one).when(used(two) & ~used(one), two).when(one.startswith("System"), one).when(two.startswith("System"), two).when(F.length(one) <= F.length(two), one).otherwise(two)
    )


def capped_diagnostics(rows: DataFrame, per_file: int = 5, total: int = 30) -> DataFrame:
    """The first per_file diagnostics of each file, total in all."""
    k = F.row_number().over(W.partitionBy("file_path").orderBy("line", "column", "message"))
    return rows.withColumn("_k", k).filter(F.col("_k") <= per_file).drop("_k").orderBy("file_path", "line", "column", "message").limit(total)


def severity_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("severity").agg(F.count("*").alias("n"))
