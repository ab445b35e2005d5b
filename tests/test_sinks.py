"""Exports and reports on small tables."""

import datetime as dt


from lodestrata.operators import impact
from lodestrata.plans import index, shared
from lodestrata.sinks import export, reports

FILE = "file_ord long, relative_path string, file_name string, extension string, language string, classification string, dependencies array<string>, usings array<string>, estimated_tokens int, text string"
TYPE = "type_ord long, file_ord long, name string, kind string, base_type string, interfaces array<string>"
MEMBER = "member_ord long, type_ord long, file_ord long, name string, kind string, signature string, return_type string, access_modifier string"


def text(report):
    return [r.line for r in reports.ordered(report).collect()]


def tables(spark):
    files = spark.createDataFrame([(0, "a/A.cs", "A.cs", ".cs", "csharp", "Service", ["B"], [], 1500, "x\ny"), (1, "b/B.cs", "B.cs", ".cs", "csharp", "Unknown", [], [], 2, None)], FILE)
    types = spark.createDataFrame([(0, 0, "A", "Class", "B", ["IA"]), (1, 1, "B", "Class", "", [])], TYPE)
    members = spark.createDataFrame([(i, 0, 0, f"M{i}", "Method", f"M{i}()" if i else "", "int", "public") for i in range(12)] + [(20, 1, 1, "f", "Field", "", "", "private")], MEMBER)
    return files, types, members, index.chunk_files(files, 1000)


def test_numbered(spark):
    rows = spark.createDataFrame([(x * 7919 % 5003, None if x % 50 == 0 else x) for x in range(3000)], "a long, b long")
    got = shared.numbered(rows, ["b", "a"]).orderBy("number").collect()
    want = sorted(rows.collect(), key=lambda r: (r.b is not None, r.b or 0, r.a))
    assert [(r.a, r.b) for r in got] == [(r.a, r.b) for r in want] and [r.number for r in got] == list(range(1, 3001))
    assert shared.numbered(rows.filter("false"), ["a"]).count() == 0


def test_activity(spark, tmp_path):
    t = dt.datetime(2024, 1, 2, 3, 4, 5)
    log = spark.createDataFrame([(1, t, "COMPLETED", "grep", 12.0, 'say "hi", now'), (2, t, "ERROR", None, None, None)], "ord long, ts timestamp_ntz, type string, tool_name string, duration_ms double, message string")
    assert [r.line for r in export.activity_lines(log).orderBy("ord").collect()] == ['2024-01-02 03:04:05,COMPLETED,grep,12,"say ""hi"", now"', '2024-01-02 03:04:05,ERROR,,,""']
    export.write_activity(log, f"{tmp_path}/log")
    back = spark.read.csv(f"{tmp_path}/log", header=True, quote='"', escape='"').orderBy("DurationMs").collect()
    assert back[1].Message == 'say "hi", now' and back[1].asDict().keys() == {"Timestamp", "Type", "Tool", "DurationMs", "Message"}


def test_stores(spark, tmp_path):
    w = spark.createDataFrame([("one", ["a", "b"]), ("two", [])], "name string, directories array<string>")
    export.write_workspaces(w, f"{tmp_path}/w")
    assert {(r.name, r.workspace, tuple(r.directories)) for r in spark.read.json(f"{tmp_path}/w").collect()} == {("one", "one", ("a", "b")), ("two", "two", ())}
    export.write_lessons(w, f"{tmp_path}/l")
    assert spark.read.json(f"{tmp_path}/l").count() == 2


def test_master_index(spark):
    got = text(reports.master_index("W", "now", *tables(spark)))
    assert got == [
        "=== WORKSPACE: W ===", "Generated: now", "Total Files: 2", "Total Chunks: 2", "Total Tokens: 1,502", "Framework: .NET Class Library", "",
        "=== TYPE HIERARCHY ===", "A : B, IA", "B", "", "=== DEPENDENCY MAP ===", "A", "  → uses: B, IA", "", "=== FILE INDEX ===",
        "| File | Chunk | Type | Key Members |", "|------|-------|------|-------------|", "| a/A.cs | 1 | Service | , M1(), M2() |", "| b/B.cs | 2 | Unknown |  |", "",
        "=== CHUNK MANIFEST ===", "Chunk 1: Service (1,500 tokens)", "  References: Chunk 2: B", "Chunk 2: Unknown (2 tokens)",
    ]


def test_chunk_texts(spark, tmp_path):
    files, types, members, chunks = tables(spark)
    rows = reports.chunk_texts(chunks, files, types, members)
    want = [
        "=== CHUNK 1 of 2: Service ===", "Files in this chunk: A.cs", "See also: Chunk 2: B", "", "=== LOCAL INDEX ===", "a/A.cs", "  class A : B, IA", "    - M0 : int",
        *[f"    - M{i}() : int" for i in range(1, 10)], "    - ... (2 more members)", "", "=== FILES ===", "", "// --- a/A.cs ---", "```csharp", "x", "y", "```", "",
    ]
    assert text(rows.filter("at = 1")) == want
    assert text(rows.filter("at = 2"))[:7] == ["=== CHUNK 2 of 2: Unknown ===", "Files in this chunk: B.cs", "", "=== LOCAL INDEX ===", "b/B.cs", "  class B", "    - ... (1 more members)"]
    reports.write_chunks(rows, f"{tmp_path}/c")
    assert [r.value for r in spark.read.text(f"{tmp_path}/c/chunk=1").collect()] == want


def test_small_reports(spark, tmp_path):
    u = spark.createDataFrame([("Invocation", "b.cs", 9, "call"), ("Definition", "a.cs", 3, "class"), ("Invocation", "a.cs", 7, "call")], "usage_kind string, file_path string, line int, context string")
    want = ["# Usages of `X`", "", "**Total:** 3 usages — **Resolution:** heuristic", "", "## Definition", "- `a.cs:3` - class", "", "## Invocation", "- `a.cs:7` - call", "- `b.cs:9` - call", ""]
    assert text(reports.usages_report(u, "X")) == want
    reports.write(reports.usages_report(u, "X"), f"{tmp_path}/u")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/u").collect()) == sorted(want)
    c = spark.createDataFrame([("T", "m", 4, "f.cs", 1)], "type string, method string, site_ord long, file_path string, line int")
    hops = spark.createDataFrame([("T", "m", "S", "k")], "via_type string, via_method string, type string, method string")
    assert text(reports.call_graph_report(c, c.filter("false"), "A.b", hops)) == ["# Call Graph: `A.b`", "", "## Callers (who calls this)", "- `T.m` (f.cs:1)", "  ← S.k", "", "## Callees (what this calls)", "*No outgoing calls*"]
    counts = spark.createDataFrame([("b", 1), ("c", 5), ("a", 1)], "file_path string, n_hits long")
    assert text(reports.grep_summary_report(counts, "p", 9))[-3:] == ["| `c` | 5 |", "| `a` | 1 |", "| `b` | 1 |"]
    assert text(reports.grep_summary_report(counts.filter("false"), "p", 9))[-1] == "*No matches found.*"
    hits = spark.createDataFrame([(1, "f", 2, "a\tb", "b", ["x y"], [])], "file_ord long, file_path string, line_no int, text string, found string, before array<string>, after array<string>")
    assert text(reports.grep_report(hits, "b"))[2:] == ["**Found:** 1 matches in 1 files", "", "## `f`", "", "**Line 2:** matched `b`", "```", "x·y", "> a→b", "```", ""]


def test_impact_and_context_reports(spark):
    i = spark.createDataFrame([(1, "A.g", "f.cs", 4, "caller", False, True), (2, "B.h", "t.cs", 2, "override", True, False)], "depth int, name string, file string, line int, kind string, is_test boolean, is_external boolean")
    got = text(reports.impact_report(i, impact.summary(i, "X"), "X"))
    assert got[0] == "# Blast Radius: `X`" and got[2].startswith("## Risk: **") and "**Tests found:** 1" in got
    assert [x for x in got if x.startswith(("## Depth", "- `"))] == ["## Depth 1 — 1 symbols", "- `f.cs:4` — `A.g` [external]", "## Depth 2 — 1 symbols", "- `t.cs:2` — `B.h` (override) [test]"]
    assert "## Suggested Actions" in got and got.index("## Suggested Actions") > got.index("## Risk Factors")
    s = spark.createDataFrame([(1, "a", 2.0, 10, ["x", "y", "z"]), (2, "b", 3.0, 1200, [])], "file_ord long, relative_path string, score double, estimated_tokens int, reasons array<string>")
    got = text(reports.context_report(s, "do", ["k"], ["tip"]))
    assert got[-2:] == ["| 1 | `b` | 3.0 | 1,200 | - |", "| 2 | `a` | 2.0 | 10 | x; y |"] and "**Total Tokens:** 1,210" in got and "`k`" in got and "- tip" in got
