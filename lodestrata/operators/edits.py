"""Previews of edits: replacements, renames, moves, added parameters, generated text, differences. Nothing is written."""

from __future__ import annotations

import difflib
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import escaped, namespace_of, stem
from ..plans.shared import numbered


def replace_once(files: DataFrame, old: str, new: str) -> DataFrame:
    """file_ord, n_found, status, new_text: replaced where old is found exactly once; line ends count as line feeds."""
    text, old = F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), old.replace("\r\n", "\n")
    n = ((F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)).cast("int")
    done = F.replace(text, F.lit(old), F.lit(new.replace("\r\n", "\n")))
    return files.select("file_ord", n.alias("n_found"), F.when(n == 1, "replaced").when(n == 0, "not found").otherwise("ambiguous").alias("status"), F.when(n == 1, done).alias("new_text"))


def replace_lines(lines: DataFrame, file_ord: int, start: int, end: int, new: list[str]) -> DataFrame:
    """file_ord, line_no, text of the file with lines start to end replaced. start and end must be lines of it; else no row changes."""
    rows = lines.filter(F.col("file_ord") == file_ord)
    if not 1 <= start <= end or not rows.filter(F.col("line_no") == end).limit(1).count():
        return rows.select("file_ord", F.col("line_no").cast("int").alias("line_no"), "text")
    shift = len(new) - (end - start + 1)
    kept = rows.filter((F.col("line_no") < start) | (F.col("line_no") > end)).withColumn("line_no", F.when(F.col("line_no") > end, F.col("line_no") + shift).otherwise(F.col("line_no")))
    fresh = lines.sparkSession.createDataFrame([(file_ord, start + i, t) for i, t in enumerate(new)], "file_ord long, line_no int, text string")
    return kept.select("file_ord", F.col("line_no").cast("int").alias("line_no"), "text").unionByName(fresh)


def rename_preview(tokens: DataFrame, old: str) -> DataFrame:
    """file_ord, n_found of identifier tokens(file_ord, token) equal to old, case counts."""
    return tokens.filter(F.col("token") == old).groupBy("file_ord").agg(F.count("*").alias("n_found"))


def rename_ambiguity(symbols: DataFrame, name: str) -> DataFrame:
    """One row: kinds of definitions of that name, and whether there are several."""
    return symbols.filter(F.col("name") == name).agg(F.countDistinct("kind").alias("n_kinds")).withColumn("ambiguous", F.col("n_kinds") > 1)


def move_impact(tokens: DataFrame, types: DataFrame, file_ord: int, old_path: str, new_path: str) -> DataFrame:
    """file_ord, names, old_namespace, new_namespace: other files whose tokens name a type of the moved file. They are reported."""
    moved = types.filter(F.col("file_ord") == file_ord).select(F.col("name").alias("token")).distinct()
    hit = tokens.filter(F.col("file_ord") != file_ord).join(moved, "token", "left_semi").groupBy("file_ord").agg(F.sort_array(F.collect_set("token")).alias("names"))
    return hit.select("file_ord", "names", namespace_of(F.lit(old_path)).alias("old_namespace"), namespace_of(F.lit(new_path)).alias("new_namespace"))


def parameter_impact(call_sites: DataFrame, files: DataFrame, method: str) -> DataFrame:
    """file_path, n_sites, n_text: files with call sites of a method, and how often their text calls it."""
    sites = call_sites.filter(F.col("called_method") == method).groupBy("file_path").agg(F.count("*").alias("n_sites"))
    return sites.join(files.select("file_path", "text"), "file_path", "left").select("file_path", "n_sites", F.coalesce(F.regexp_count("text", F.lit(rf"\b{escaped(method)}\s*\(")), F.lit(0)).alias("n_text"))


def _listed(line: Column, by: str = "\n") -> Column:
    """In an aggregate: the lines of a type's members in their order, those that are null left out."""
    kept = F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct("member_ord", line.alias("l")))))
    return F.array_join(F.transform(kept, lambda x: x["l"]), by)


def interface_text(members: DataFrame, name: Column, namespace: Column | None = None) -> DataFrame:
    """type_ord, code of an interface with the public methods (constructors aside) and properties of each type, in its namespace if one
    is given. Types without a public member have none."""
    shown = members.filter((F.col("access_modifier") == "public") & ((F.col("kind") == "Property") | ((F.col("kind") == "Method") & (F.col("name") != F.col("type_name")))))
    line = F.when(F.col("kind") == "Method", F.format_string("        %s %s;", "return_type", "signature")).otherwise(F.format_string("        %s %s { get; set; }", "return_type", "name"))
    space = F.lit(None).cast("string") if namespace is None else namespace
    rows = shown.groupBy("type_ord", "type_name", name.alias("interface"), space.alias("space")).agg(_listed(line).alias("b"))
    code = F.format_string("    /// <summary>\n    /// Interface for %s\n    /// </summary>\n    public interface %s\n    {\n%s\n    }", "type_name", "interface", "b")
    wrapped = F.when(F.col("space").isNotNull(), F.format_string("namespace %s\n{\n%s\n}", "space", code)).otherwise(code)
    return rows.select("type_ord", wrapped.alias("code"))


def implementation_text(members: DataFrame) -> DataFrame:
    """type_ord, code of stubs for each method and property of each interface: members(type_ord, type_name, ...) are those of interfaces."""
    head = F.format_string("        public %s %s", F.coalesce("return_type", F.lit("void")), F.coalesce("signature", F.concat("name", F.lit("()"))))
    method = F.concat(head, F.lit("\n        {\n            throw new NotImplementedException();\n        }\n"))
    line = F.when(F.col("kind") == "Method", method).when(F.col("kind") == "Property", F.format_string("        public %s %s { get; set; }\n", "return_type", "name"))
    rows = members.groupBy("type_ord", "type_name").agg(_listed(line).alias("b"))
    return rows.select("type_ord", F.format_string("        #region %s Implementation\n\n%s\n        #endregion", "type_name", "b").alias("code"))


def constructor_text(members: DataFrame, only: list[str] | None = None) -> DataFrame:
    """type_ord, code of a constructor that sets each field and property that is not static, or those of only, in any case. Parameters
    have its name with the first letter small, then without one leading underscore."""
    kept = members.filter(F.col("kind").isin("Field", "Property") & ~F.coalesce("is_static", F.lit(False)))
    kept = kept.filter(F.lower("name").isin(*[x.lower() for x in only])) if only else kept
    arg = F.regexp_replace(F.concat(F.lower(F.substring("name", 1, 1)), F.expr("substring(name, 2)")), "^_", "")
    rows = kept.groupBy("type_ord", "type_name").agg(_listed(F.format_string("            %s %s", "return_type", arg), ",\n").alias("p"), _listed(F.format_string("            %s = %s;", "name", arg)).alias("s"))
    return rows.select("type_ord", F.format_string("        public %s(\n%s\n        )\n        {\n%s\n        }", "type_name", "p", "s").alias("code"))


def extract_method(lines: DataFrame, file_ord: int, start: int, end: int, name: str, parameters: list[tuple[str, str]] = (), returned: tuple[str, str] | None = None) -> DataFrame:
    """file_ord, line_no, text of the file with lines start to end as a method of their own, and a call in their place.

    parameters and returned: (type, name), as data_flow and a caller's table of types give them. The method stands before the last line
    that is a closing brace alone, or before the last line if there is none. Lines that are not there give the file as it is."""
    rows = lines.filter(F.col("file_ord") == file_ord).select("file_ord", "line_no", "text")
    inside = F.col("line_no").between(start, end)
    facts = rows.agg(
        F.max(F.when(~inside & (F.trim("text") == "}"), F.col("line_no"))).alias("brace"), F.max("line_no").alias("last"),
        F.first(F.when(F.col("line_no") == start, F.regexp_extract("text", r"^(\s*)", 1)), True).alias("pad"), F.count_if(inside).alias("n"),
    ).filter(F.col("n") == end - start + 1)
    kind, back = returned or ("void", None)
    call = (f"var {back} = " if back else "") + f"{name}({', '.join(x for _, x in parameters)});"
    head = f"private {kind} {name}({', '.join(f'{t} {x}' for t, x in parameters)})"
    place, pad = F.coalesce("brace", "last"), F.repeat(F.lit(" "), F.length("pad"))
    piece = lambda at, sub, *text: F.struct(at.cast("long").alias("at"), F.lit(sub).cast("long").alias("sub"), F.concat(*text).alias("text"))
    new = [piece(F.lit(start), 0, pad, F.lit(call)), piece(place, -6, F.lit("")), piece(place, -5, pad, F.lit(head)), piece(place, -4, pad, F.lit("{")), piece(place, -1, pad, F.lit("}")), piece(place, 0, F.lit(""))]
    if back:
        new += [piece(place, -3, F.lit("")), piece(place, -2, pad, F.lit(f"    return {back};"))]
    # Where the moved lines go: between the opening brace and what follows it, by their own numbers.
    made = facts.select(F.explode(F.array(*new)).alias("x")).select("x.at", "x.sub", F.lit(0).cast("long").alias("own"), "x.text")
    moved = rows.filter(inside).crossJoin(facts).select(place.cast("long").alias("at"), F.lit(-4).cast("long").alias("sub"), F.col("line_no").cast("long").alias("own"), "text")
    done = facts.select(F.lit(True).alias("done"))  # a row, or none
    stay = rows.join(F.broadcast(done), how="left").filter(~inside | F.col("done").isNull()).select(F.col("line_no").cast("long").alias("at"), F.lit(1).cast("long").alias("sub"), F.lit(0).cast("long").alias("own"), "text")
    out = numbered(made.unionByName(moved).unionByName(stay), ["at", "sub", "own"], "line_no")
    return out.select(F.lit(file_ord).cast("long").alias("file_ord"), F.col("line_no").cast("int").alias("line_no"), "text")


def data_flow(tokens: DataFrame, start: int, end: int) -> DataFrame:
    """One row for a range of lines of one method: parameters (used in it, declared before), returned (assigned in it and used after; null unless one).

    tokens: line_no, name, role (declare, assign, use)."""
    names = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("name"))))
    inside, role = F.col("line_no").between(start, end), F.col("role")
    s = tokens.agg(
        names(inside & (role != "declare")).alias("used"), names(inside & (role == "declare")).alias("declared"), names((F.col("line_no") < start) & (role == "declare")).alias("before"),
        names(inside & role.isin("assign", "declare")).alias("assigned"), names((F.col("line_no") > end) & (role != "declare")).alias("after"),
    )
    back = F.array_intersect("assigned", "after")
    return s.select(F.array_intersect(F.array_except("used", "declared"), "before").alias("parameters"), F.when(F.size(back) == 1, back[0]).alias("returned"))


def diffs(pairs: DataFrame, context: int = 3, limit: int = 100) -> DataFrame:
    """file_ord, diff, is_rewrite of pairs(file_ord, old, new): a unified difference of at most limit lines; a rewrite has less than a
    fifth of its lines equal in place. Hunks may be chosen otherwise than by other tools."""

    # By rows, not by Arrow: Spark gives such a function 100 rows at a time, an Arrow batch has up to 10,000 pairs of texts.
    @F.udf("diff string, is_rewrite boolean", useArrow=False)
    def difference(old: str, new: str) -> tuple[str, bool]:
        x, y = old.split("\n"), new.split("\n")
        found = "\n".join(islice(difflib.unified_diff(x, y, lineterm="", n=context), limit))
        return found, sum(p == q for p, q in zip(x, y, strict=False)) < 0.2 * max(len(x), len(y))

    return pairs.select(F.col("file_ord").cast("long").alias("file_ord"), difference("old", "new").alias("d")).select("file_ord", "d.diff", "d.is_rewrite")


def matches_of_lines(lines: DataFrame, old: str) -> DataFrame:
    """file_ord, at, score: for each line of files(lines: file_ord, line_no, text) where old could begin, 2 for each of its lines that is
    there as it is and 1 for each that is there but for white space around it; at counts lines from 1. Places that score nothing are left out."""
    wanted = old.replace("\r\n", "\n").split("\n")
    rows = lines.sparkSession.createDataFrame([(i, t, t.strip()) for i, t in enumerate(wanted)], "i int, want string, bare string").filter("bare <> ''")
    text = F.regexp_replace("text", "\r$", "")
    met = lines.select("file_ord", "line_no", text.alias("text"), F.trim(F.translate(text, "\t", " ")).alias("bare")).join(F.broadcast(rows), "bare")  # as many rows as old has lines
    met = met.select("file_ord", (F.col("line_no") - F.col("i")).alias("at"), F.when(F.col("text") == F.col("want"), 2).otherwise(1).alias("s"))
    return met.filter("at >= 1").groupBy("file_ord", "at").agg(F.sum("s").cast("int").alias("score"))


def replace_by_lines(lines: DataFrame, file_ord: int, old: str, new: str) -> DataFrame:
    """file_ord, line_no, text, status of the file with old replaced where its lines are found, whatever their indentation, exactly once
    (replaced); else as it is (not found, ambiguous). The new lines move by as much as the first line found is deeper than that of old."""
    wanted, fresh = old.replace("\r\n", "\n").split("\n"), new.replace("\r\n", "\n").split("\n")
    rows = lines.filter(F.col("file_ord") == file_ord)
    ahead = W.partitionBy("file_ord").orderBy("line_no")  # the lines of one file
    bare = lambda c: F.trim(F.translate(c, "\t\r", " "))
    hit = F.lit(True)
    for i, t in enumerate(wanted):
        hit = hit & F.coalesce(F.lead(bare(F.col("text")), i).over(ahead) == F.lit(t.replace("\t", " ").strip()), F.lit(False))
    places = [r for r in rows.withColumn("_hit", hit).filter("_hit").orderBy("line_no").limit(2).collect()]
    out = rows.select("file_ord", F.col("line_no").cast("int").alias("line_no"), "text")
    if len(places) != 1:
        return out.withColumn("status", F.lit("ambiguous" if places else "not found"))
    at, lead = places[0]["line_no"], len(places[0]["text"]) - len(places[0]["text"].lstrip())
    shift = lead - (len(wanted[0]) - len(wanted[0].lstrip()))
    moved = [(" " * shift + t if shift >= 0 else t[min(-shift, len(t) - len(t.lstrip())) :]) if t.strip() else t for t in fresh]
    return replace_lines(lines, file_ord, at, at + len(wanted) - 1, moved).withColumn("status", F.lit("replaced"))


def notes_without(lines: list[str], section: str | None = None, keep_head: bool = False) -> list[str]:
    """Lines of notes without a section, or with its heading alone (clear); without any line if none is given."""
    if section is None:
        return []
    head = f"## {section}"
    if head not in lines:
        return list(lines)
    at = lines.index(head)
    end = next((i for i in range(at + 1, len(lines)) if lines[i].startswith("## ")), len(lines))
    return [*lines[: at + keep_head], *lines[end:]]


def notes_replaced(lines: list[str], section: str, text: list[str], cap: int = 20_480) -> list[str] | None:
    """Lines of notes with the lines of a section replaced (added at the end if it is not there); None if they would pass the cap."""
    head = f"## {section}"
    if head not in lines:
        out = [*lines, "", head, *text]
    else:
        at = lines.index(head)
        end = next((i for i in range(at + 1, len(lines)) if lines[i].startswith("## ")), len(lines))
        out = [*lines[: at + 1], *text, *lines[end:]]
    return out if sum(len(x.encode()) + 1 for x in out) <= cap else None


def notes_edit(lines: list[str], note: str, section: str | None = None, cap: int = 20_480) -> list[str] | None:
    """Lines of notes with a note added at the end of a section (created if it is not there); None if they would pass the cap."""
    out = list(lines)
    if section is None:
        out.append(f"- {note}")
    else:
        head = f"## {section}"
        if head not in out:
            out += ["", head]
        at = out.index(head) + 1
        while at < len(out) and not out[at].startswith("## "):
            at += 1
        out.insert(at, f"- {note}")
    return out if sum(len(x.encode()) + 1 for x in out) <= cap else None


def symbol_file(path: Column) -> Column:
    return stem(path)
