"""Relevance of files to a task under a budget of tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contains_ci, substrings
from ..plans.shared import cut

#: Words of a task that say nothing about files.
STOP_WORDS = frozenset(
    """the and for that this with from have are was will can has but not you all any been each how its may new now old see way who did
    get got let say she too use her him his what when where which while about after before being below between both could does doing down
    during into just more most only other over same should some such than them then there these they those through under very were would
    also want need like make look find take give""".split()
)
MAX_FILES, MAX_TOKENS, FIRST_PASS = 10, 50_000, 0.7
#: Keywords that may be broadcast.
FEW_WORDS = 10_000


def task_words(task: str) -> tuple[list[str], list[str]]:
    """Words of three letters or more but stop words, and identifiers and quoted terms; each once."""
    words = list(dict.fromkeys(w.lower() for w in re.findall(r"\b[a-zA-Z]{3,}\b", task) if w.lower() not in STOP_WORDS))
    identifiers = [w for w in re.findall(r"\b(?:[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*)\b", task) if len(w) > 2]
    return words, list(dict.fromkeys([*identifiers, *re.findall(r"[\"']([^\"']+)[\"']", task)]))


def keywords(spark: SparkSession, task: str, type_names: DataFrame | None = None) -> DataFrame:
    """keyword: words of the task, names of types that hold one of four letters or more, identifiers and quoted terms; each once,
    where case counts. A table: as many types as there are may hold a word."""
    words, others = task_words(task)
    out = spark.createDataFrame([(w,) for w in [*words, *others]], "keyword string")
    long = [w for w in words if len(w) >= 4]
    if type_names is not None and long:
        out = out.unionByName(type_names.filter(F.rlike(F.lower("name"), F.lit("|".join(long)))).select(F.col("name").alias("keyword")))
    return out.distinct()


def held_keywords(rows: DataFrame, text: Column, words: DataFrame, keep: list[str], least: int = 1) -> DataFrame:
    """keep, k, n, whole: which of words(k, n), in lower case, the text of a row holds, by all substrings of the lengths that words have;
    whole: it is the text itself. An equi-join: neither side is compared with all of the other."""
    lengths = [r[0] for r in words.select(F.length("k")).distinct().collect()]  # of words; names are short
    lengths = sorted(x for x in lengths if x >= least)
    low = F.lower(text)
    held = substrings(low, lengths)
    return rows.select(*keep, low.alias("_text"), F.explode(held).alias("k")).join(words, "k").select(*keep, "k", "n", (F.col("k") == F.col("_text")).alias("whole"))


def scores(files: DataFrame, types: DataFrame, members: DataFrame, words: DataFrame | list[str], callers: DataFrame | None = None, depended: DataFrame | None = None) -> DataFrame:
    """file_ord, score, of words(keyword) or a list of them; two that differ by case count twice.

    10 for a file name, 4 for a path; of types 20 for the name, 10 for a part of it; 5 for a part of a member's name; half a
    point for each caller of a member, 5 at most (callers: type_name, name, n_callers); 2 for each type that another depends
    on (depended: name). Parts of names need four letters."""
    if isinstance(words, list):
        words = files.sparkSession.createDataFrame([(w,) for w in words], "keyword string")
    words = cut(words.groupBy(F.lower("keyword").alias("k")).agg(F.count("*").alias("n")), "words")
    if words.count() > FEW_WORDS:
        words = words.hint("merge")  # as many as there are types: never a table that the driver holds, however small its files are
    points = lambda rows, p: rows.select("file_ord", (F.col("n") * p).cast("double").alias("s"))
    rows = [files.select("file_ord", F.lit(0.0).alias("s"))]
    rows.append(points(held_keywords(files, F.col("file_name"), words, ["file_ord"]), F.lit(10)))
    rows.append(points(held_keywords(files, F.col("relative_path"), words, ["file_ord"]), F.lit(4)))
    named = held_keywords(types, F.col("name"), words, ["file_ord"])
    rows.append(points(named, F.when(F.col("whole"), 20).when(F.length("k") >= 4, 10).otherwise(0)))
    rows.append(points(held_keywords(members, F.col("name"), words, ["file_ord"], 4), F.lit(5)))
    if callers is not None:
        rows.append(members.join(callers, ["type_name", "name"]).select("file_ord", F.least(F.col("n_callers") * 0.5, F.lit(5.0)).alias("s")))
    if depended is not None:
        rows.append(types.join(depended.select("name").distinct(), "name", "left_semi").select("file_ord", F.lit(2.0).alias("s")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("file_ord").agg(F.sum("s").alias("score"))


def task_bonus(task: str, path: Column, classification: Column) -> Column:
    """15 for server files if the task is about tools, 10 for views if it is about the interface."""
    t = task.lower()
    server = F.when(contains_ci(path, "mcp") | contains_ci(path, "server"), 15.0).otherwise(0.0) if "tool" in t or "mcp" in t else F.lit(0.0)
    view = F.when(classification == "View", 10.0).otherwise(0.0) if any(w in t for w in ("ui", "view", "window", "xaml")) else F.lit(0.0)
    return server + view


def select_within(ranked: DataFrame, max_files: int, budget: int, first_always: bool = True) -> DataFrame:
    """Of ranked(file_ord, score, tokens), in order of score, files that still fit the budget; those that do not are skipped.

    The first is taken whatever its size. Ranked rows are few: the caller limits them before the fold. first_pass goes through all rows."""
    item = F.struct((-F.col("score")).alias("s"), "file_ord", F.col("tokens").cast("long").alias("tokens"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("held"), F.array().cast("array<boolean>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["n"] < max_files) & ((s["held"] + x["tokens"] <= budget) | (F.lit(first_always) & (s["n"] == 0)))
        return F.struct((s["n"] + fits.cast("int")).alias("n"), (s["held"] + F.when(fits, x["tokens"]).otherwise(0)).alias("held"), F.concat(s["out"], F.array(fits)).alias("out"))

    folded = ranked.agg(F.sort_array(F.collect_list(item)).alias("f"))
    rows = folded.select(F.explode(F.arrays_zip("f", F.aggregate("f", start, step, lambda s: s["out"]).alias("taken"))).alias("z")).filter("z.taken")
    return rows.select(F.col("z.f.file_ord").alias("file_ord"), (-F.col("z.f.s")).alias("score"), F.col("z.f.tokens").alias("tokens"))


def first_pass(scored: DataFrame, files: DataFrame, max_files: int = MAX_FILES, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The first files under 70 % of the budget, from all that score at all: in each round, of the files ranked after the last
    pick, the best that fits what is left. The first is taken whatever its size."""
    sized = files.select("file_ord", F.col("estimated_tokens").cast("long").alias("tokens")).hint("merge")  # a row for each file: as scored, nothing for the driver to hold
    ranked = scored.filter("score > 0").join(sized, "file_ord").select("file_ord", "score", "tokens")
    ranked, left = cut(ranked, "ranked"), int(max_tokens * FIRST_PASS)
    picked: list = []
    while len(picked) < max(3, max_files // 2):
        rest = ranked
        if picked:
            last = picked[-1]
            rest = ranked.filter((F.col("score") < last["score"]) | ((F.col("score") == last["score"]) & (F.col("file_ord") > last["file_ord"]))).filter(F.col("tokens") <= left)
        found = rest.orderBy(F.desc("score"), "file_ord").limit(1).collect()
        if not found:
            break
        picked += found
        left -= found[0]["tokens"]
    return scored.sparkSession.createDataFrame(picked, ranked.schema)


def expansion(selected: DataFrame, members: DataFrame, types: DataFrame, files: DataFrame, graph: DataFrame, slots: int, tokens: int) -> DataFrame:
    """Files of up to three callers (score x 0.6) and three callees (x 0.5) of each method of the selected files, the first
    slots by score, then those that fit the tokens."""
    methods = members.filter("kind = 'Method'").join(F.broadcast(selected.select("file_ord", "score")), "file_ord")  # few rows
    methods = methods.select(F.concat_ws(".", "type_name", "name").alias("method"), "score")
    home = types.groupBy("name").agg(F.max_by("file_ord", F.struct("file_ord", "type_ord")).alias("file_ord"))
    found = None
    for here, there, factor in (("callee", "caller", 0.6), ("caller", "callee", 0.5)):
        met = methods.join(graph, F.col("method") == F.col(here)).withColumn("k", F.row_number().over(W.partitionBy("method").orderBy(there))).filter("k <= 3")
        met = met.select(F.split(there, r"\.")[0].alias("name"), (F.col("score") * factor).alias("score"))
        found = met if found is None else found.unionByName(met)
    more = found.join(home, "name").groupBy("file_ord").agg(F.max("score").alias("score")).join(selected.select("file_ord"), "file_ord", "left_anti")
    more = more.join(files.select("file_ord", F.col("estimated_tokens").alias("tokens")), "file_ord").orderBy(F.desc("score"), "file_ord").limit(slots)
    return select_within(more, slots, tokens, first_always=False)


def match_reasons(types: DataFrame, words: list[str], limit: int = 5) -> DataFrame:
    """file_ord, reasons: which types match which keywords, the first five."""
    spark = types.sparkSession
    asked = spark.createDataFrame([(i, w, w.lower()) for i, w in enumerate(words)], "pos int, keyword string, k string")
    kept = asked.groupBy("k").agg(F.collect_list(F.struct("pos", "keyword")).alias("n"))
    rows = held_keywords(types, F.col("name"), kept, ["file_ord", "type_ord", "name"]).select("file_ord", "type_ord", "name", F.explode("n").alias("w"))
    reason = F.format_string("Type %s matches %s", "name", "w.keyword")
    rows = rows.select("file_ord", "type_ord", "w.pos", reason.alias("reason")).groupBy("file_ord", "reason").agg(F.min(F.struct("type_ord", "pos")).alias("o"))
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy("file_ord").orderBy("o"))).filter(F.col("_k") <= limit)
    return rows.groupBy("file_ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "reason"))), lambda x: x["reason"]).alias("reasons"))


def related_types(selected_types: DataFrame, all_types: DataFrame, dependency_map: DataFrame | None = None, limit: int | None = 10) -> DataFrame:
    """name of bases, interfaces and up to five dependencies of the types, those that the project has."""
    rows = selected_types.select(F.explode(F.concat(F.array("base_type"), "interfaces")).alias("name"))
    if dependency_map is not None:
        rows = rows.unionByName(selected_types.join(dependency_map, "name").select(F.explode(F.slice("deps", 1, 5)).alias("name")))
    out = rows.filter("name <> ''").distinct().join(all_types.select("name").distinct(), "name", "left_semi")
    return out if limit is None else out.orderBy("name").limit(limit)


def suggestions(task: str, n_files: int, tokens: int, model_path: str | None = None) -> list[str]:
    """Hints for a task, by its words and by what was selected."""
    t, out = task.lower(), []
    if "add" in t and "tool" in t:
        out += ["See how the existing tools are registered", "Register the new tool beside them", "Write its handler like theirs", "Dispatch it by name"]
    if "search" in t or "find" in t:
        out += ["Regular expressions make patterns flexible", "Return line numbers and context"]
    if ("model" in t or "class" in t) and model_path:
        out.append(f"Review the models in {model_path}")
    if not n_files:
        out += ["No file matches: the task may need new components", "Decide which class of file fits"]
    if tokens > 30_000:
        out.append("The context is large: name types or methods to narrow it")
    return out
