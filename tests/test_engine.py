"""Operators on small tables with expected rows worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import buildlog, context, duplicates, edits, impact, lookup, rules, symbols, telemetry
from lodestrata.plans import index
from lodestrata.sources import code, csharp, files, logs, markup, python_code

TYPE = "type_ord long, file_ord long, name string, name_lc string, kind string, base_type string, interfaces array<string>, is_abstract boolean, start_line int"


def types_of(spark, rows):
    return spark.createDataFrame([(i, i, n, n.lower(), "Class", b, f, a, 1) for i, (n, b, f, a) in enumerate(rows)], TYPE)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("a, b, want", [("abcd", "abcx", 75), ("ab", "abcde", 0), ("abc", "abd", 66), ("x", "x", 100)])
def test_similarity(spark, a, b, want):
    assert value(spark, T.similarity(F.lit(a), F.lit(b))) == want == value(spark, T.similarity(F.lit(b), F.lit(a)))


def test_similarity_of_long_texts(spark):
    a, b = "ab cd ef " * 70, "ab cd ef " * 60 + "xyz"
    grams = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
    x, y = grams(a), grams(b)
    assert value(spark, T.similarity(F.lit(a), F.lit(b))) == int(100 * len(x & y) / len(x | y))


def test_text_functions(spark):
    assert value(spark, T.parse_list(F.lit(".cs, .py; .md .txt"))) == [".cs", ".py", ".md .txt"]
    assert value(spark, T.parse_ignored(F.lit("Bin, obj"))) == ["bin", "obj", ".git"]
    assert value(spark, T.normalised_code(F.lit("  A \n\t b  "))) == "a b"
    assert value(spark, T.estimated_tokens(F.lit(1003))) == 250
    assert value(spark, T.resolved_path(F.lit("a/b/../../c/./d"))) == "c/d"
    assert value(spark, T.visible_whitespace(F.lit("a\tb c\r"))) == "a→b·c"
    assert value(spark, T.leading_width(F.lit("\t  x"))) == 6
    assert value(spark, T.size_label(F.lit(1536))) == "1.5 KB" and value(spark, T.duration_label(F.lit(3700))) == "1h 1m"


@pytest.mark.parametrize("affected, tests, bindings, external, name, want, level", [(1, 0, 0, 0, "Foo", 2.2, "LOW"), (3, 0, 0, 0, "Foo", 2.8, "LOW"), (5, 0, 0, 0, "Foo", 3.2, "MEDIUM"), (20, 0, 5, 20, "ChargeCard", 10.0, "CRITICAL"), (0, 0, 0, 0, "Foo", 0.0, "LOW")])
def test_risk(spark, affected, tests, bindings, external, name, want, level):
    n = F.lit(affected)
    score = impact.risk_score(n, n, F.lit(tests), F.lit(bindings), F.lit(external), impact.is_critical(F.lit(name)))
    assert value(spark, score) == want and value(spark, impact.risk_level(score)) == level


def sites(spark, edges):
    return spark.createDataFrame([(i, a.split(".")[0], a.split(".")[1], "T", m, "f.cs", i, False) for i, (a, m) in enumerate(edges)], "site_ord long, caller_type string, caller_method string, called_type string, called_method string, file_path string, line int, is_property_access boolean")


def test_blast_radius(spark):
    members = spark.createDataFrame([(1, "B", "f", "f", True, 7, "g.cs")], "member_ord long, type_name string, name string, name_lc string, is_override boolean, start_line int, file_path string")
    known = spark.createDataFrame([("F.CS", "src/f.cs", True)], "file_path string, relative_path string, is_test boolean")
    got = lambda edges, s, ms: {(r.depth, r.name, r.kind) for r in impact.blast_radius(sites(spark, edges), ms, known, s, 3).collect()}
    none = members.filter("false")
    assert got([("A.f", "f")], "f", none) == {(1, "A.f", "caller")}
    assert got([("A.g", "f"), ("B.h", "g"), ("C.k", "g")], "f", none) == {(1, "A.g", "caller"), (2, "B.h", "caller"), (2, "C.k", "caller")}
    assert got([("A.g", "F")], "f", members) == {(1, "A.g", "caller"), (1, "B.f", "override")}
    row = impact.blast_radius(sites(spark, [("A.g", "f")]), none, known, "f").first()
    assert row.file == "src/f.cs" and row.is_test and not row.is_external
    s = impact.summary(impact.blast_radius(sites(spark, [("A.g", "f"), ("B.h", "g")]), none, known.filter("false"), "f"), "f").first()
    assert (s.affected, s.tests, s.external, s.levels, s.risk_score, s.risk_level) == (2, 0, 2, 2, 4.5, "MEDIUM")
    assert impact.blast_radius(sites(spark, [("A.g", "f")]), none, known, "nothing").count() == 0


def test_implementations(spark):
    t = types_of(spark, [("P", "", ["IFoo"], False), ("Q", "P", [], False), ("R", "Q", [], True), ("X", "Y", [], False), ("Y", "X", [], False)])
    assert {tuple(r) for r in symbols.implementations(t, "IFoo").collect()} == {("P", "direct"), ("Q", "Q → P → IFoo")}
    assert symbols.implementations(t, "IFoo", include_abstract=True).count() == 3
    assert symbols.implementations(t, "X").count() == 1
    chain = types_of(spark, [(f"T{i}", f"T{i - 1}" if i else "IRoot", [], False) for i in range(40)])
    assert {r.name for r in symbols.implementations(chain, "IRoot").collect()} == {f"T{i}" for i in range(40)}  # however long


def test_indexes(spark):
    t = types_of(spark, [("A", "B", ["IX"], False), ("A", "C", [], False)])
    assert index.type_hierarchy(t).first().bases == ["C"]
    for path, want in (("src/latest/Foo.cs", "Test"), ("Services/appsettings.json", "Config"), ("a/Views/Main.xaml", "View"), ("x/Plain.cs", "Unknown")):
        assert value(spark, index.classification(F.lit(path), T.file_name(F.lit(path)))) == want
    assert value(spark, index.python_classification(F.lit("a/test_x.py"), F.lit("test_x.py"))) == "Test"
    f = spark.createDataFrame([(i, f"p{i}", n, "Unknown") for i, n in enumerate([6, 3, 4, 12, 5])], "file_ord long, relative_path string, estimated_tokens int, classification string")
    assert [(r.chunk_number, r.file_ord) for r in index.chunk_files(f, 10).orderBy("chunk_number", "pos").collect()] == [(1, 0), (1, 1), (2, 2), (3, 3), (4, 4)]


def test_context_fold(spark):
    r = spark.createDataFrame([(1, 3.0, 60), (2, 2.0, 20), (3, 1.0, 10)], "file_ord long, score double, tokens long")
    assert [x.file_ord for x in context.select_within(r, 3, 70).collect()] == [1, 3]
    found = context.keywords(spark, "Fix the \"big list\" in MyParser for Parser", types_of(spark, [("XmlParser", "", [], False)]))
    assert sorted(r.keyword for r in found.collect()) == sorted(["XmlParser", "fix", "big", "list", "myparser", "parser", "Fix", "MyParser", "Parser", "big list"])


def test_scores(spark):
    files = spark.createDataFrame([(0, "src/ParserTools.cs", "ParserTools.cs"), (1, "parser/x.cs", "x.cs"), (2, "y.cs", "y.cs")], "file_ord long, relative_path string, file_name string")
    types = types_of(spark, [("ParserTools", "", [], False), ("Parser", "", [], False), ("Par", "", [], False)])
    members = spark.createDataFrame([(2, "Par", "ParseParser"), (2, "Par", "run")], "file_ord long, type_name string, name string")
    got = {r.file_ord: r.score for r in context.scores(files, types, members, ["Parser", "parser", "par"]).collect()}
    # Twice parser, and par, which is too short for parts of names: file name 10, path 4, type 20 or 10, member 5.
    assert got == {0: 2 * (10 + 4 + 10) + 10 + 4, 1: 2 * (4 + 20) + 4, 2: 2 * 5 + 20}


def test_chunks_against_the_fold(spark):
    import random

    rng = random.Random(9)
    for limit, most in ((50, 20), (50, 70), (10, 100)):
        sizes = [rng.choice([0, rng.randrange(1, most)]) for _ in range(120)]
        rows = [(i, f"p{(i * 7919) % 1000:04d}", n, rng.choice(["Config", "Model", "Unknown", "Test"])) for i, n in enumerate(sizes)]
        df = spark.createDataFrame(rows, "file_ord long, relative_path string, estimated_tokens int, classification string")
        want, chunk, held, closed, pos = {}, 0, 0, True, 0
        for i, _, n, _ in sorted(rows, key=lambda r: (index.PRIORITY[r[3]], r[1], r[0])):
            if closed or held + n > limit:
                chunk, held, pos = chunk + 1, 0, 0
            held, closed = held + n, not held and n > limit
            want[i] = (chunk, pos)
            pos += 1
        assert {r.file_ord: (r.chunk_number, r.pos) for r in index.chunk_files(df, limit).collect()} == want
    assert index.chunk_files(df.filter("false"), 10).count() == 0


def test_first_pass_looks_past_many_large_files(spark):
    files = spark.range(1500).select(F.col("id").alias("file_ord"), F.when(F.col("id") == 0, 30_000).when(F.col("id") < 1400, 6_000).otherwise(1_000 + F.col("id").cast("int")).alias("estimated_tokens"))
    scored = files.select("file_ord", F.when(F.col("file_ord") == 1499, 0.0).otherwise(2000.0 - F.floor(F.col("file_ord") / 2)).alias("score"))
    assert [tuple(r) for r in context.first_pass(scored, files).collect()] == [(0, 2000.0, 30_000), (1400, 1300.0, 2_400), (1401, 1300.0, 2_401)]
    some = [(i, float(i * 7 % 5), i * 13 % 11 * 1000) for i in range(40)]
    f, s = spark.createDataFrame([(i, t) for i, _, t in some], "file_ord long, estimated_tokens int"), spark.createDataFrame([(i, x) for i, x, _ in some], "file_ord long, score double")
    ranked = s.filter("score > 0").join(f.withColumnRenamed("estimated_tokens", "tokens"), "file_ord")
    assert [tuple(r) for r in context.first_pass(s, f).collect()] == [tuple(r) for r in context.select_within(ranked, 5, 35_000).collect()]
    assert context.first_pass(s.filter("false"), f).count() == 0


@pytest.mark.parametrize("order, pairs, want", [((1, 2, 3), [(1, 2), (2, 3)], {(1, 1), (1, 2)}), ((1, 2, 3), [(1, 2), (1, 3)], {(1, 1), (1, 2), (1, 3)})])
def test_clusters(spark, order, pairs, want):
    rows = spark.createDataFrame([(i,) for i in order], "ord long")
    p = spark.createDataFrame([(a, b, 90) for a, b in pairs], "a long, b long, similarity int")
    assert {(r.seed, r.ord) for r in duplicates.clusters(rows, p).collect()} == want


def test_similar_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "ord long, body string")
    got = {tuple(r) for r in duplicates.similar_pairs(rows, 60).collect()}
    a, b = rows.toDF("a", "x"), rows.toDF("b", "y")
    every = a.join(b, F.col("a") < F.col("b")).select("a", "b", T.similarity(F.col("x"), F.col("y")).alias("s")).filter("s >= 60")
    assert got == {tuple(r) for r in every.collect()} and got


def test_duplicates_of_all_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK_ROWS", 9)  # several blocks in a band
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 3000").limit(60).collect()]
    copies = [t for _, t in texts if t and 300 < len(t) < 2_000][:3]
    texts += [(10_000 + i, t) for i, t in enumerate(copies * 2)] + [(20_000 + i, "tiny text") for i in range(4)] + [(30_000, None), (30_001, " "), (30_002, copies[0] + " tail")]
    rows = duplicates.text_blocks(spark.createDataFrame(texts, "ord long, text string")).cache()
    texts_of = {r.ord: r.body for r in rows.collect()}
    a, b = rows.toDF("a", "x", "n"), rows.toDF("b", "y", "k")
    # The definition, which compares every row with every row.
    similar = F.when(F.col("x") == F.col("y"), 100).otherwise(T.similarity(F.col("x"), F.col("y")))
    near = F.least(F.length("x"), F.length("y")) * 2 >= F.greatest(F.length("x"), F.length("y"))
    want = {tuple(r) for r in a.join(b, F.col("a") < F.col("b")).filter(near).select("a", "b", similar.alias("s")).filter("s >= 50").collect()}
    of = {}
    for r in duplicates.row_classes(rows).collect():
        of.setdefault(r["class"], []).append(r.ord)
        assert r["class"] == min(x for x, t in texts_of.items() if t == texts_of[r.ord]) and r.n_rows == sum(t == texts_of[r.ord] for t in texts_of.values())
    pairs = duplicates.row_pairs(rows, 50).collect()
    assert all((r.a_rows, r.b_rows) == (len(of[r.a]), len(of[r.b])) for r in pairs) and len(pairs) < len(want)
    got = [(min(x, y), max(x, y), r.similarity) for r in pairs for x in of[r.a] for y in of[r.b]] + [(x, y, 100) for xs in of.values() for x in xs for y in xs if x < y]
    assert len(got) == len(set(got)) and set(got) == want and sum(s == 100 for *_, s in got) >= 15
    taken, clusters, like = set(), {}, {(x, y): s for x, y, s in want}
    for i in sorted(r.ord for r in rows.collect()):  # the loop of the reference
        if i not in taken and (mine := [j for x, j, in like if x == i and j not in taken]):
            clusters[i] = {i, *mine}
            taken |= clusters[i]
    found = {}
    for r in duplicates.row_clusters(rows, 50).collect():
        found.setdefault(r.seed, set()).add(r.ord)
        assert r.similarity == like.get((r.seed, r.ord), 100)
    assert found == clusters
    lines = {r.ord: r.n_lines for r in rows.collect()}
    report = duplicates.cluster_report(duplicates.row_clusters(rows, 50), rows).collect()
    assert all(r.n_members == len(clusters[r.seed]) and r.total_lines == sum(lines[i] for i in clusters[r.seed]) and r.similarity == max(like[r.seed, i] for i in clusters[r.seed] - {r.seed}) for r in report)
    assert report


def test_parities_lose_no_pair(spark):
    """Long texts changed more and more, in one space of sizes or in neighbouring ones, and some with more letters than digits hold."""
    import random

    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    texts = [base]
    for k in range(1, 40):
        t = list(base)
        for _ in range(4 * k):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t)[: 1500 - 7 * k])
    texts += ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(501, 2500))) for _ in range(40)] + ["ab" * 300, "ab" * 400, "ab" * 800]
    wide = "".join(chr(0x4E00 + i) for i in range(8000))
    texts += [wide, wide[:7500] + wide[:200], wide[4000:]]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    for least in (50, 80, 100):
        want = set()
        for i, x in enumerate(sets):
            for j in range(i + 1, len(sets)):
                n, k = len(texts[i]), len(texts[j])
                if max(n, k) > 500 and 2 * min(n, k) >= max(n, k) and texts[i] != texts[j] and (p := int(len(x & sets[j]) / len(x | sets[j]) * 100)) >= least:
                    want.add((i, j, p))
        rows = spark.createDataFrame(list(enumerate(texts)), "ord long, body string")
        assert {tuple(r) for r in duplicates.similar_pairs(rows, least).collect()} == want and want


def test_telemetry(spark):
    lines = spark.createDataFrame([(i, v) for i, v in enumerate(["W|COMPLETED|grep|12ms", "W|INDEXED|5 files", "W|ERROR|grep|x|y", "nobar", "W|STARTED"])], "ord long, value string")
    got = telemetry.parse_activity(lines).collect()
    assert [(r.type, r.tool_name, r.details) for r in got] == [("COMPLETED", "grep", "12ms"), ("ERROR", "grep", "x")]
    assert [r.duration_ms for r in telemetry.tool_calls(telemetry.parse_activity(lines)).collect()] == [12]
    t0 = dt.datetime(2024, 1, 1, 10, 0, 59, 900000)
    calls = spark.createDataFrame([(1, t0, "a", 1.0, False), (2, t0 + dt.timedelta(milliseconds=100), "a", 3.0, True), (3, t0 + dt.timedelta(seconds=130), "a", 2.0, True)], "ord long, ts timestamp_ntz, tool_name string, duration_ms double, is_error boolean")
    assert telemetry.activity_per_minute(calls).count() == 3
    assert [r.ord for r in telemetry.idle_gaps(calls).collect()] == [2]
    assert {(r.ord, r.n_errors) for r in telemetry.errors_before_each(calls).collect()} == {(2, 1), (3, 2)}
    assert telemetry.recent_errors(calls, t0 + dt.timedelta(seconds=300)).first()[0] == 2
    assert telemetry.session_summary(calls).first()[0] == "3 calls | avg 2ms | 2 errors"
    b = spark.createDataFrame([(f"p{i}", "o", t0 + dt.timedelta(hours=i)) for i in range(3)], "path string, original string, mtime timestamp_ntz")
    assert {r.path for r in telemetry.retention_excess(b, 1).collect()} == {"p0", "p1"}


def test_rules(spark):
    assert rules.resolve_intent("please add sealed to all") == "add_sealed" and rules.resolve_intent("ADD_XML_DOC") == "add_xml_doc" and rules.resolve_intent("x") is None
    loaded = rules.load_rules('{"customIntents": [{"name": "r", "findPattern": "old"}, {"name": "R", "findPattern": "fo(o)\\\\d", "replacePattern": "ba$1", "excludePattern": "9"}, {"name": "x"},] // end\n}')
    assert len(loaded) == 1
    f = spark.createDataFrame([(1, "a.cs", ".cs", "x\nfoo1 foo9\nfoo2"), (2, "b.py", ".py", "none")], "file_ord long, relative_path string, extension string, text string")
    assert [tuple(r)[:4] for r in rules.rule_matches(f, loaded[0]).orderBy("line").collect()] == [(1, 2, "foo1", "bao"), (1, 3, "foo2", "bao")]
    named = {"findpattern": r"(?<one>[a-z])-(?<two>\w)\k<one>", "replacepattern": r"${two}\$1"}
    f = spark.createDataFrame([(1, "a.cs", ".cs", "x-ya b-cb")], "file_ord long, relative_path string, extension string, text string")
    assert [(r.found, r.replacement) for r in rules.rule_matches(f, named).collect()] == [("b-cb", "c\\b")]
    m = spark.createDataFrame([(1, 1, "M", "public", "Method", ["string a", "int b", "this Foo c"], "if (a == null) return;")], "file_ord long, member_ord long, name string, access_modifier string, kind string, parameters array<string>, body string")
    assert [r.parameter for r in rules.unchecked_parameters(m).collect()] == ["c"]
    lines = spark.createDataFrame([(2, 1, "aa"), (1, 2, "ab"), (1, 1, "b")], "file_ord long, line_no int, text string")
    assert [tuple(r)[:3] + (r.new,) for r in rules.grep_replace(lines, "A", "x", exclude_matches=(1,)).collect()] == [(2, 2, 1, "xx")]


def test_error_classes(spark):
    rows = [("f", 1, 1, "CS1002", "; expected"), ("f", 2, 1, "CS8602", "null"), ("f", 3, 1, "CS9999", "?"), ("f", 4, 1, "CS0246", "The type 'Regex' is missing"), ("g", 5, 1, "CS0246", "The type 'Mine' is missing"), ("f", 9, 1, "CS0246", "The type 'Regex' is missing")]
    e = spark.createDataFrame(rows, "file_path string, line int, column int, error_code string, message string")
    got = {r.line: (r.category, r.is_auto_fixable, r.confidence, r.resolved_data) for r in buildlog.classified(e, spark.createDataFrame([("Mine", "Own.Space")], "name string, namespace string")).collect()}
    assert got[1] == ("missing_semicolon", True, 0.95, None) and got[2] == ("null_warning", False, 0.3, None) and got[3] == ("unknown", False, 0.0, None)
    assert got[4] == ("missing_using", True, 0.75, "System.Text.RegularExpressions") and got[5] == ("missing_using", True, 0.9, "Own.Space")
    assert buildlog.fixes(buildlog.classified(e)).count() == 2


def test_logs(spark):
    text = ["/src/A.cs(10,5): error CS0246: The type 'Foo' is missing", "error MSB1: The type 'Foo'", "error MSB2: other", "/src/A.cs(1,2): warning CS1: w", "plain"]
    lines = spark.createDataFrame(list(enumerate(text)), "ord long, value string")
    got = {(r.severity, r.file_path, r.line, r.error_code) for r in logs.build_messages(lines).collect()}
    assert got == {("error", "A.cs", 10, "CS0246"), ("warning", "A.cs", 1, "CS1"), ("error", "", 0, "MSB2")}
    lint = logs.lint_messages(spark.createDataFrame([(1, "a.R:3:1: style: Use <- for assignment")], "ord long, value string")).first()
    assert (lint.file, lint.line, lint.kind, lint.message) == ("a.R", 3, "style", "Use <- for assignment")
    check = logs.check_messages(spark.createDataFrame([(1, "* checking x ... NOTE"), (2, "b.R:1:2: bad")], "ord long, value string"))
    assert {(r.kind, r.message) for r in check.collect()} == {("note", "* checking x ... NOTE"), ("error", "bad")}
    assert logs.lessons(spark, "/nowhere/lessons.json").count() == 0


def test_notes_and_workspaces_of_whole_tables(spark, sf):
    from lodestrata import more_queries

    turns = sorted((r.conv_id * 1000 + r.turn, r.role) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect())
    got = more_queries.QUERIES["numbered_notes"](spark, sf).collect()
    assert len(got) == len(turns)
    users = [i for i, role in turns if role == "user"]
    assert {r.line_no: r.number for r in got} == {i: users.index(i) + 1 if role == "user" else None for i, role in turns}
    used = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_returnflag").collect():
        used.setdefault(r.l_suppkey, set()).add(r.l_returnflag)
    shared = {r.directory: r.workspaces for r in more_queries.QUERIES["shared_dirs"](spark, sf).collect()}
    assert shared == {str(k): ", ".join(sorted(v)) for k, v in used.items() if len(v) > 1}
    tags = {r.directory: r.tags for r in more_queries.QUERIES["merged_workspaces"](spark, sf).collect()}
    assert tags == {k: ", ".join(sorted(v, key=lambda x: (x != "R", x))) for k, v in used.items()}


def test_lookup(spark):
    f = spark.createDataFrame([(1, "src/A.cs", "A.cs", "/r/App"), (2, "lib/A.cs", "A.cs", "/r/App"), (3, "src/B.cs", "B.cs", "/r/App")], "file_ord long, relative_path string, file_name string, root_directory string")
    got = lambda p: {(r.file_ord, r.strategy, r.status) for r in lookup.find_file(f, p).collect()}
    assert got("SRC\\a.cs") == {(1, 1, "found")} and got("a.cs") == {(1, 2, "ambiguous"), (2, 2, "ambiguous")}
    assert got("app/src/b.cs") == {(3, 3, "found")} and got("x/../src/B.cs") == {(3, 4, "found")} and got("none.cs") == set()
    lines = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(["a", "b", "Hit x hit", "c", "d", "e"])], "file_ord long, line_no int, text string")
    r = lookup.grep(lines, "hit").first()
    assert (r.line_no, r["at"], r.found, r.before, r.after) == (3, 1, "Hit", ["a", "b"], ["c", "d"])
    assert lookup.grep(lines, "hit", case_sensitive=True).first()["at"] == 7 and lookup.grep(lines, "[", is_regex=False).count() == 0


def test_files(spark, tmp_path):
    for p in ("a/x.cs", "a/bin/y.cs", "a/z.py", "node_modules/q.cs", "k.log", "logs/a.log"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("text")
    got = {r.relative_path for r in files.scan(spark, str(tmp_path), [".cs"], ["bin"]).collect()}
    assert got == {"a/x.cs", "node_modules/q.cs"}
    every = files.scan_all(spark, [str(tmp_path), str(tmp_path / "a")])
    assert {r.relative_path for r in files.repository_files(every, patterns=["*.log"], exclude=["a/b"]).collect()} >= {"logs/a.log"}
    ok = lambda p, path: value(spark, files.ignored_by(F.lit(path), [p]))
    assert ok("*.log", "a.log") and not ok("*.log", "logs/a.log") and ok("**.log", "logs/a.log") and ok("bin/", "x/bin/y") and ok("/docs", "docs")


CS = '''using System;
using Foo.Bar;
namespace My.App
{
    /// <summary>Does it.</summary>
    public abstract class Runner : IDisposable, Base, IFoo
    {
        private readonly int _n = 3, _m;
        public event Action Gone;
        public string Name { get; set; } = "a{b";
        protected internal virtual async Task<int> RunAsync(string text, List<int> more)
        {
            // if (fake) Call();
            var s = "x.Fake()"; _list.Push(text); Helper();
            var t = new Thing(); return other.Size + s.Length;
        }
        public Runner(int n) { Init(n); }
        int Half(int n) => n / 2;
        enum Color { Red, Green = 2 }
    }
    interface IFoo { void Go(); }
    public delegate void Done(int code);
}
'''


def test_csharp():
    got = csharp.parse(CS)
    assert got["namespace"] == "My.App" and got["usings"] == ["System", "Foo.Bar"]
    t = {x["name"]: x for x in got["types"]}
    assert set(t) == {"Runner", "Color", "IFoo", "Done"}
    r = t["Runner"]
    assert (r["base_type"], r["interfaces"], r["is_abstract"], r["start_line"]) == ("Base", ["IDisposable", "IFoo"], True, 6) and "Does it" in r["xml_doc"]
    m = {x["name"]: x for x in r["members"]}
    assert {k: v["kind"] for k, v in m.items()} == {"_n": "Field", "Name": "Property", "RunAsync": "Method", "Runner": "Constructor", "Half": "Method"}
    assert m["RunAsync"]["access_modifier"] == "protected" and m["RunAsync"]["is_async"] and m["RunAsync"]["parameters"] == ["string text", "List<int> more"] and m["RunAsync"]["return_type"] == "Task<int>"
    assert m["Half"]["access_modifier"] == "private" and [x["name"] for x in t["Color"]["members"]] == ["Red", "Green"] and t["Done"]["kind"] == "Delegate"
    calls = {(c["caller_method"], c["called_type"], c["called_method"], c["is_property_access"]) for c in got["calls"]}
    assert calls == {("RunAsync", "_list", "Push", False), ("RunAsync", "Runner", "Helper", False), ("RunAsync", "other", "Size", True), (".ctor", "Runner", "Init", False)}
    assert csharp.split_bases(["Base1", "Base2"]) == ("Base1", ["Base2"])
    assert csharp.parse("class {{{")["types"] == []


PY = '''import os, sys as s
from a.b import c

class A(Base, Mixin):
    """Doc."""
    @staticmethod
    def run(cls, x: int) -> str:
        return self.help(os.path.join(x))

    async def _hide(self):
        pass

def top():
    run()
'''


def test_python():
    got = python_code.parse(PY, "mod")
    assert got["usings"] == ["os", "sys", "a.b"] and got["dependencies"] == ["os", "sys", "a"]
    mod, a = got["types"]
    assert (mod["name"], [m["name"] for m in mod["members"]]) == ("mod", ["top"])
    assert (a["base_type"], a["interfaces"], a["xml_doc"], a["start_line"], a["end_line"]) == ("Base", ["Mixin"], "Doc.", 4, 12)
    run, hide = a["members"]
    assert run["is_static"] and run["return_type"] == "str" and hide["access_modifier"] == "private" and hide["is_async"]
    calls = {(c["caller_type"], c["caller_method"], c["called_type"], c["called_method"]) for c in got["calls"]}
    assert ("A", "run", "A", "run") in calls and ("A", "run", "os.path", "join") in calls and ("module", "top", "module", "run") in calls


def test_corpus_of_files(spark, tmp_path):
    (tmp_path / "Services").mkdir()
    (tmp_path / "Services" / "Runner.cs").write_text(CS)
    (tmp_path / "mod.py").write_text(PY)
    c = code.corpus(files.scan_all(spark, [str(tmp_path)], [".cs", ".py"]))
    assert {(r.file_name, r.language, r.classification) for r in c.files.collect()} == {("Runner.cs", "csharp", "Service"), ("mod.py", "python", "Unknown")}
    assert c.types.count() == 6 and {r.symbol for r in symbols.usages(c, "helper").collect()} == {"Runner.RunAsync"}
    assert index.framework(c.files, c.types).first()[0] == ".NET Application"
    assert {tuple(r) for r in edits.rename_preview(code.tokens(c.files.filter("extension = '.cs'")), "Helper").select("n_found").collect()} == {(1,)}
    assert "int code" in str(c.members.filter("name = 'Done'").first().parameters)
    assert index.upserted(c.files.drop("usings"), c.files.drop("usings").limit(1)).count() == 2


def test_markup(spark):
    x = '<Window xmlns:x="u"><Grid x:Name="g"><Grid.Resources><A/><B/></Grid.Resources><Odd/><Style/><TextBox Text="{Binding Path=Name, Mode=TwoWay}" Style="{StaticResource Big}"/></Grid></Window>'
    f = spark.createDataFrame([(1, x), (2, "<broken")], "file_ord long, text string")
    rows = {(r.file_ord, r.node_id): r for r in markup.nodes(f).collect()}
    got = [(r.element, r.depth, r.parent_id) for (o, _), r in sorted(rows.items()) if o == 1]
    assert got == [("Window", 0, None), ("Grid", 1, 0), ("Grid.Resources", 2, 1), ("TextBox", 2, 1)]
    assert rows[1, 2].content == "2 items" and rows[1, 3].binding == "Text=Name" and rows[1, 3].style == "Big" and rows[2, 0].element.startswith("ERROR")
    assert impact.binding_files(f, "name").count() == 1


def test_edits(spark):
    f = spark.createDataFrame([(1, "a\r\nb\nb"), (2, "xx")], "file_ord long, text string")
    assert {(r.file_ord, r.status, r.new_text) for r in edits.replace_once(f, "a\nb", "c").collect()} == {(1, "replaced", "c\nb"), (2, "not found", None)}
    assert edits.replace_once(f, "b", "c").filter("file_ord = 1").first().status == "ambiguous"
    lines = spark.createDataFrame([(1, i, f"l{i}") for i in range(1, 5)], "file_ord long, line_no int, text string")
    assert [r.text for r in edits.replace_lines(lines, 1, 2, 3, ["n"]).orderBy("line_no").collect()] == ["l1", "n", "l4"]
    for start, end in ((90, 91), (3, 5), (0, 1), (3, 2)):  # no lines of the file: no row changes
        assert sorted(map(tuple, edits.replace_lines(lines, 1, start, end, ["n", "m"]).collect())) == [tuple(r) for r in lines.collect()]
    deep = spark.createDataFrame([(1, i, x) for i, x in enumerate(["if (a)", "    {", "\t\tx();", "    }", "y();"], 1)], "file_ord long, line_no int, text string")
    done = edits.replace_by_lines(deep, 1, "{\n  x();\n}", "{\n  z();\n}").orderBy("line_no").collect()
    assert [r.text for r in done] == ["if (a)", "    {", "      z();", "    }", "y();"] and done[0].status == "replaced"
    assert edits.replace_by_lines(deep, 1, "none", "x").first().status == "not found"
    assert {(r["at"], r.score) for r in edits.matches_of_lines(deep, "{\n    x();\n    }").collect()} == {(2, 4)}
    t = spark.createDataFrame([(1, "a", "declare"), (2, "b", "declare"), (3, "a", "use"), (3, "r", "declare"), (4, "r", "assign"), (5, "r", "use")], "line_no int, name string, role string")
    assert tuple(edits.data_flow(t, 3, 4).first()) == (["a"], "r")
    code = spark.createDataFrame([(1, i, x) for i, x in enumerate(["class C", "{", "  void M()", "  {", "    x();", "    y();", "  }", "}"], 1)], "file_ord long, line_no int, text string")
    got = [r.text for r in edits.extract_method(code, 1, 5, 6, "N", [("int", "a")], ("int", "r")).orderBy("line_no").collect()]
    assert got == ["class C", "{", "  void M()", "  {", "    var r = N(a);", "  }", "", "    private int N(int a)", "    {", "    x();", "    y();", "", "        return r;", "    }", "", "}"]
    assert [r.text for r in edits.extract_method(code, 1, 8, 9, "N").orderBy("line_no").collect()] == [r.text for r in code.collect()]
    own = spark.createDataFrame([(1, "C", 1, "_name", "Field", "string", "private", False), (1, "C", 2, "Size", "Property", "int", "public", False), (1, "C", 3, "All", "Field", "int", "private", True)], "type_ord long, type_name string, member_ord long, name string, kind string, return_type string, access_modifier string, is_static boolean")
    assert edits.constructor_text(own).first().code == "        public C(\n            string name,\n            int size\n        )\n        {\n            _name = name;\n            Size = size;\n        }"
    assert "_name" not in edits.constructor_text(own, ["SIZE"]).first().code
    whole = edits.interface_text(own.withColumn("signature", F.lit("")), F.lit("IC"), F.lit("A.B")).first().code
    assert whole.startswith("namespace A.B\n{\n    /// <summary>") and "        int Size { get; set; }" in whole and whole.endswith("    }\n}")
    d = edits.diffs(spark.createDataFrame([(1, "a\nb", "a\nc")], "file_ord long, old string, new string")).first()
    assert "-b" in d.diff and "+c" in d.diff and not d.is_rewrite
    assert edits.notes_edit(["## S", "- a", "## T"], "b", "S") == ["## S", "- a", "- b", "## T"] and edits.notes_edit([], "x" * 30_000) is None


def test_orders_do_not_matter(spark, sf):
    from lodestrata.plans import adapters as A

    lines = A.document_lines(spark, sf)
    first = [tuple(r)[:2] for r in lookup.grep(lines, "the", context=0).collect()]
    assert first == [tuple(r)[:2] for r in lookup.grep(lines.repartition(5), "the", context=0).collect()]
    f = A.document_files(spark, sf).withColumn("classification", F.lit("Unknown"))
    key = lambda df: sorted(map(tuple, index.chunk_files(df, 2000).collect()))
    assert key(f) == key(f.repartition(7))


def test_patterns_of_all_of_unicode_and_errors(spark):
    texts = [(1, "été froid"), (2, "ÉTÉ"), (3, "Ábc"), (4, "abc"), (5, "a" * 40 + "!"), (6, None), (7, "x\n\nkey=one key=two\nkey=three")]
    lines = spark.createDataFrame([(i, 1, t) for i, t in texts], "file_ord long, line_no int, text string")
    hits = lambda p, **how: [r.file_ord for r in lookup.grep(lines, p, context=0, **how).collect()]
    assert hits("été") == [1, 2] and hits("été", case_sensitive=True) == [1] and hits(r"^\w+ froid") == [1] and hits(r"\bbc") == [] and hits("É", is_regex=False) == [1, 2]
    for context in (0, 2):
        (bad,) = lookup.grep(lines, "(", context=context).collect()
        assert bad.error.startswith("Invalid regex pattern") and bad.file_ord is None and bad.text is None
    assert [(r.file_ord, r.n_hits, r.error is None) for r in lookup.grep_summary(lines, "[").collect()] == [(None, None, False)]
    assert [r.total for r in lookup.grep_total(lines, "(").collect()] == [0] and all(r.error is None for r in lookup.grep(lines, "a").collect())

    files = spark.createDataFrame([(i, "a.txt", ".txt", t) for i, t in texts], "file_ord long, relative_path string, extension string, text string")
    found = lambda p, **how: sorted(tuple(r) for r in rules.rule_matches(files, {"name": "r", "findpattern": p, **how}, find_s=0.5).collect())
    assert found(r"^\w+ froid") == [(1, 1, "été froid", None, None)] and found(r"\p{Lu}bc") == [(3, 1, "Ábc", None, None)] and found("(?i)été") == [(1, 1, "été", None, None), (2, 1, "ÉTÉ", None, None)]
    assert found(r"key=(?<v>\w+)", replacepattern="${v}$$ $1 $7 ${no} $&", excludepattern="^key=two$") == [(7, 3, "key=one", "one$ one $7 ${no} key=one", None), (7, 4, "key=three", "three$ three $7 ${no} key=three", None)]
    assert found(r"(?<q>.)\k<q>c") == [] and [x[:3] for x in found("^$")] == [(6, 1, ""), (7, 2, "")]
    ((i, *_, error),) = [x for x in found("(a|aa)+$") if x[4]]  # backtracks without an end
    assert i == 5 and "too long" in error
    ((i, line, text, new, error),) = found("(")
    assert (i, line, text, new) == (None, None, None, None) and error.startswith("Invalid regex in rule 'r'")


def test_required_literals():
    held = rules.required_literal
    assert held(r"foo\d+barbaz") == "barbaz" and held("ab|cde") is None and held("(?i)abcd") is None and held(r"(?<n>abcd)efg\k<n>") in (None, "efg")
    assert held("abc?de") is None and held(r"\p{Lu}bcd") in (None, "bcd") and held("(") is None


def test_keys_of_places_never_collide(spark, monkeypatch):
    rows = spark.createDataFrame([(899_999_999, 99_999)], "file_ord long, pos int")
    assert rows.select(code._key("file_ord", 100_000).alias("k")).first().k == 89_999_999_999_999
    with pytest.raises(Exception, match="more than 100000 rows within file_ord 7"):
        spark.createDataFrame([(7, 100_000)], "file_ord long, pos int").select(code._key("file_ord", 100_000).alias("k")).collect()
    monkeypatch.setattr(code.csharp, "parse", lambda _: [][1])
    assert code.parse("class A {}", "a.cs") == code._EMPTY | {"error": "IndexError: list index out of range"} and code.parse("x", "a.txt") == code._EMPTY
