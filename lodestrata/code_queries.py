"""Source code, markup, projects and logs rendered from the driver's tables, read by the parsers, and compared with SQL over the
same tables: each row of a table is a declaration whose facts SQL can tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plans import adapters as A
from .plans import index
from .queries import query
from .sources import code, files as scans, logs, markup

_N = "\n"


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _cat(*parts: str | Column) -> Column:
    """Text with columns in it: strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _joined(order: str, text: Column) -> Column:
    """In an aggregate: texts in order, one after the other."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text.alias("t")))), lambda x: x["t"]), "")


def _as_files(rows: DataFrame, extension: str) -> DataFrame:
    """rows(file_ord, path, text) as scanned files."""
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(
        "file_ord", F.col("path").alias("file_path"), F.col("path").alias("relative_path"), name.alias("file_name"), F.lit(extension).alias("extension"),
        F.octet_length("text").cast("long").alias("size_bytes"), F.encode("text", "UTF-8").alias("content"),
    )


# C#: a partial class for each brand and 500 parts; a part is a method, property, field or constructor by its size.
PARTS = """(SELECT p_partkey AS k, CAST(substr(p_brand, 7) AS BIGINT) AS b, 'Brand' || substr(p_brand, 7) AS owner, p_partkey // 500 AS block, p_size % 4 AS kind, p_size % 3 AS access, p_name AS name,
  CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS doc, CASE p_size % 4 WHEN 0 THEN 6 WHEN 3 THEN 4 ELSE 1 END AS height FROM part)"""
PLACED = f"(SELECT *, b * 1000000 + block AS file_ord, 8 + sum(doc + height) OVER (PARTITION BY b, block ORDER BY k) - height + 1 AS line FROM {PARTS})"
ACCESS = "CASE access WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'protected' END"


def csharp_files(spark, d) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    b = F.regexp_extract("p_brand", r"(\d+)$", 1)
    word = lambda c, w: F.when(c, F.lit(w + " ")).otherwise("")
    access = F.element_at(F.array(*map(F.lit, ("public ", "private ", "protected "))), size % 3 + 1)
    mods = F.concat(access, word(k % 5 == 0, "static"), word(k % 7 == 0, "override"), word(k % 4 == 0, "async"))
    doc = F.when(k % 3 == 0, _cat("    /// ", F.col("p_name"), _N)).otherwise("")
    kind = F.when(k % 4 == 0, F.lit("Task<int>")).otherwise("int")
    method = _cat("    ", mods, kind, " M", _s(k), "(string name, int depth = 1)\n    {\n        Store.Load(name.Length); // Ghost.Call(\n        var t = order.Total + \"Not.A(\".Length;\n        Helper();\n    }\n")
    property_ = _cat("    ", access, "string P", _s(k), " { get; set; }\n")
    field = _cat("    ", access, "int f", _s(k), " = 3;\n")
    constructor = _cat("    ", access, "Brand", b, "(int a", _s(k), ")\n    {\n        Init(a", _s(k), ");\n    }\n")
    body = F.concat(doc, F.when(size % 4 == 0, method).when(size % 4 == 1, property_).when(size % 4 == 2, field).otherwise(constructor))
    rows = A.read(spark, d, "part").select(k.alias("k"), b.cast("long").alias("b"), F.floor(k / 500).alias("block"), body.alias("text"))
    rows = rows.groupBy("b", "block").agg(_joined("k", F.col("text")).alias("text"))
    bases = F.element_at(F.array(*map(F.lit, ("Catalog, IBrand", "IBrand, Catalog", "IBrand, IPriced"))), (F.col("b") % 3 + 1).cast("int"))
    head = _cat("using System;\nusing Shop.Block", _s("block"), ";\n\nnamespace Shop.Area", _s("b"), "\n{\n/// Parts of brand ", _s("b"), "\npublic ", F.when(F.col("b") % 2 == 0, F.lit("abstract ")).otherwise(""), "partial class Brand", _s("b"), " : ", bases, "\n{\n")
    path = _cat("shop/", F.when(F.col("b") % 4 == 0, F.lit("models/")).when(F.col("b") % 4 == 1, F.lit("services/")).otherwise("src/"), "Brand", _s("b"), ".", _s("block"), ".cs")
    rows = rows.select((F.col("b") * 1_000_000 + F.col("block")).alias("file_ord"), path.alias("path"), _cat(head, F.col("text"), "}\n}\n").alias("text"))
    return _as_files(rows, ".cs")


@query(
    f"""SELECT file_ord, owner AS name, 'Shop.Area' || b || '.' || owner AS full_name, 'Class' AS kind, CASE b % 3 WHEN 2 THEN '' ELSE 'Catalog' END AS base_type, CASE b % 3 WHEN 2 THEN 'IBrand,IPriced' ELSE 'IBrand' END AS faces,
  b % 2 = 0 AS is_abstract, 7 AS start_line, CAST(9 + sum(doc + height) AS INTEGER) AS end_line, 'Parts of brand ' || b AS xml_doc FROM {PLACED} GROUP BY file_ord, owner, b"""
)
def csharp_types(spark, d):
    types = code.corpus(csharp_files(spark, d)).types
    return types.select("file_ord", "name", "full_name", "kind", "base_type", F.array_join("interfaces", ",").alias("faces"), "is_abstract", "start_line", "end_line", "xml_doc")


@query(
    f"""SELECT file_ord, 'Shop.Area' || b AS namespace, 'System,Shop.Block' || block AS usings, CASE b % 3 WHEN 0 THEN 'Catalog,IBrand' WHEN 1 THEN 'Catalog,IBrand' ELSE 'IBrand,IPriced' END AS dependencies,
  CASE b % 4 WHEN 0 THEN 'Model' WHEN 1 THEN 'Service' ELSE 'Unknown' END AS classification, 'csharp' AS language FROM {PLACED} GROUP BY file_ord, b, block"""
)
def csharp_file_facts(spark, d):
    files = code.corpus(csharp_files(spark, d)).files
    return files.select("file_ord", "namespace", F.array_join("usings", ",").alias("usings"), F.array_join("dependencies", ",").alias("dependencies"), "classification", "language")


@query(
    f"""SELECT file_ord, owner AS type_name, CASE kind WHEN 0 THEN 'M' || k WHEN 1 THEN 'P' || k WHEN 2 THEN 'f' || k ELSE owner END AS name, CASE kind WHEN 0 THEN 'Method' WHEN 1 THEN 'Property' WHEN 2 THEN 'Field' ELSE 'Constructor' END AS kind,
  CASE kind WHEN 0 THEN CASE WHEN k % 4 = 0 THEN 'Task<int>' ELSE 'int' END WHEN 1 THEN 'string' WHEN 2 THEN 'int' ELSE '' END AS return_type, {ACCESS} AS access_modifier,
  CASE kind WHEN 0 THEN 'string name|int depth = 1' WHEN 3 THEN 'int a' || k ELSE '' END AS parameters, kind = 0 AND k % 5 = 0 AS is_static, kind = 0 AND k % 7 = 0 AS is_override, kind = 0 AND k % 4 = 0 AS is_async,
  CAST(line AS INTEGER) AS start_line, CAST(line + height - 1 AS INTEGER) AS end_line, CASE WHEN doc = 1 THEN name ELSE '' END AS xml_doc FROM {PLACED}"""
)
def csharp_members(spark, d):
    members = code.corpus(csharp_files(spark, d)).members
    return members.select("file_ord", "type_name", "name", "kind", "return_type", "access_modifier", F.array_join("parameters", "|").alias("parameters"), "is_static", "is_override", "is_async", "start_line", "end_line", "xml_doc")


@query(
    f"""SELECT owner AS caller_type, 'M' || k AS caller_method, u.t AS called_type, u.m AS called_method, CAST(line + u.off AS INTEGER) AS line, u.p AS is_property_access
FROM {PLACED}, (VALUES ('Store', 'Load', 2, FALSE), ('order', 'Total', 3, TRUE), ('', 'Helper', 4, FALSE)) u(t, m, off, p) WHERE kind = 0 AND u.t <> ''
UNION ALL SELECT owner, 'M' || k, owner, 'Helper', CAST(line + 4 AS INTEGER), FALSE FROM {PLACED} WHERE kind = 0
UNION ALL SELECT owner, '.ctor', owner, 'Init', CAST(line + 2 AS INTEGER), FALSE FROM {PLACED} WHERE kind = 3"""
)
def csharp_calls(spark, d):
    return code.corpus(csharp_files(spark, d)).call_sites.select("caller_type", "caller_method", "called_type", "called_method", "line", "is_property_access")


@query(f"SELECT file_ord, CASE b % 3 WHEN 0 THEN 'Catalog,IBrand' WHEN 1 THEN 'Catalog,IBrand' ELSE 'IBrand,IPriced' END AS dependencies FROM {PLACED} GROUP BY file_ord, b")
def file_dependencies(spark, d):
    return index.file_dependencies(code.corpus(csharp_files(spark, d)).types).select("file_ord", F.array_join("dependencies", ",").alias("dependencies"))


@query("SELECT '.NET Class Library' AS framework")
def framework(spark, d):
    corpus = code.corpus(csharp_files(spark, d))
    return index.framework(corpus.files, corpus.types)


@query(f"SELECT file_ord, token, count(*) AS n FROM (SELECT file_ord, unnest(['Store', 'Load', 'name', 'order', 'Total', 'Helper']) AS token FROM {PLACED} WHERE kind = 0 UNION ALL SELECT file_ord, 'name' FROM {PLACED} WHERE kind = 0) GROUP BY 1, 2")
def csharp_tokens(spark, d):
    text = csharp_files(spark, d).select("file_ord", F.decode("content", "UTF-8").alias("text"))
    kept = code.tokens(text).filter(F.col("token").isin("Store", "Load", "name", "order", "Total", "Helper", "Ghost", "Not"))
    return kept.groupBy("file_ord", "token").agg(F.count("*").alias("n"))


# Python: a module for each nation and 100 customers, a class for each customer.
PEOPLE = """(SELECT c_custkey AS k, c_nationkey AS n, c_custkey // 100 AS block, c_nationkey * 1000000 + c_custkey // 100 AS file_ord, c_name AS name, c_mktsegment AS segment,
  CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS doc FROM customer)"""
CLASSES = f"(SELECT *, CAST(3 + sum(7 + doc) OVER (PARTITION BY file_ord ORDER BY k) - 6 - doc AS INTEGER) AS line FROM {PEOPLE})"


def python_files(spark, d) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    head = F.when(k % 2 == 0, _cat("class C", _s(k), "(Nation", _s(n), ", ", F.initcap("c_mktsegment"), "Mixin):\n")).otherwise(_cat("class C", _s(k), ":\n"))
    doc = F.when(k % 3 == 0, _cat('    """', F.col("c_name"), '"""\n')).otherwise("")
    body = "    def total(self, x: int) -> int:\n        return helper(x) + self.tax.rate(x)\n    async def _load(cls, path):\n        '''Loads.'''\n        os.path.join(path)\n\n"
    rows = A.read(spark, d, "customer").select(k.alias("k"), n.cast("long").alias("n"), F.floor(k / 100).alias("block"), _cat(head, doc, body).alias("text"))
    rows = rows.groupBy("n", "block").agg(_joined("k", F.col("text")).alias("text"))
    text = _cat("import os, sys as s\nfrom shop.nation", _s("n"), " import Base\n\n", F.col("text"), "def entry(a, b=2) -> None:\n    # Runs.\n    start(a)")
    folder = F.when(F.col("n") % 3 == 0, F.lit("app/tests/")).when(F.col("n") % 3 == 1, F.lit("app/models/")).otherwise("app/")
    path = _cat(folder, "n", _s("n"), "_", _s("block"), ".py")
    return _as_files(rows.select((F.col("n") * 1_000_000 + F.col("block")).alias("file_ord"), path.alias("path"), text.alias("text")), ".py")


SEGMENT = "upper(substr(segment, 1, 1)) || lower(substr(segment, 2))"


@query(
    f"""SELECT file_ord, 'C' || k AS name, CASE WHEN k % 2 = 0 THEN 'Nation' || n ELSE '' END AS base_type, CASE WHEN k % 2 = 0 THEN {SEGMENT} || 'Mixin' ELSE '' END AS faces, line AS start_line, CAST(line + 6 + doc AS INTEGER) AS end_line,
  CASE WHEN doc = 1 THEN name ELSE '' END AS doc FROM {CLASSES}
UNION ALL SELECT file_ord, 'n' || n || '_' || block, '', '', 1, CAST(6 + sum(7 + doc) AS INTEGER), '' FROM {CLASSES} GROUP BY file_ord, n, block"""
)
def python_types(spark, d):
    types = code.corpus(python_files(spark, d)).types
    return types.select("file_ord", "name", "base_type", F.array_join("interfaces", ",").alias("faces"), "start_line", "end_line", F.col("xml_doc").alias("doc"))


@query(
    f"""SELECT file_ord, 'C' || k AS type_name, 'total' AS name, 'int' AS return_type, 'self|x: int' AS parameters, 'public' AS access_modifier, FALSE AS is_static, FALSE AS is_async, CAST(line + 1 + doc AS INTEGER) AS start_line, CAST(line + 2 + doc AS INTEGER) AS end_line, '' AS doc FROM {CLASSES}
UNION ALL SELECT file_ord, 'C' || k, '_load', 'None', 'cls|path', 'private', TRUE, TRUE, CAST(line + 3 + doc AS INTEGER), CAST(line + 6 + doc AS INTEGER), 'Loads.' FROM {CLASSES}
UNION ALL SELECT file_ord, 'n' || n || '_' || block, 'entry', 'None', 'a|b=2', 'public', FALSE, FALSE, CAST(4 + sum(7 + doc) AS INTEGER), CAST(6 + sum(7 + doc) AS INTEGER), '' FROM {CLASSES} GROUP BY file_ord, n, block"""
)
def python_members(spark, d):
    members = code.corpus(python_files(spark, d)).members
    return members.select("file_ord", "type_name", "name", "return_type", F.array_join("parameters", "|").alias("parameters"), "access_modifier", "is_static", "is_async", "start_line", "end_line", F.col("xml_doc").alias("doc"))


@query(
    f"""SELECT 'C' || k AS caller_type, u.c AS caller_method, CASE u.t WHEN '' THEN 'C' || k ELSE u.t END AS called_type, u.m AS called_method
FROM {PEOPLE}, (VALUES ('total', '', 'total'), ('total', '', 'helper'), ('total', 'self.tax', 'rate'), ('_load', '', '_load'), ('_load', 'os.path', 'join')) u(c, t, m)
UNION ALL SELECT 'module', 'entry', 'module', u.m FROM (SELECT DISTINCT file_ord FROM {PEOPLE}), (VALUES ('entry'), ('start')) u(m)"""
)
def python_calls(spark, d):
    return code.corpus(python_files(spark, d)).call_sites.select("caller_type", "caller_method", "called_type", "called_method")


@query(
    f"""SELECT file_ord, 'os,sys,shop.nation' || n AS usings, 'os,sys,shop' AS dependencies, CASE n % 3 WHEN 0 THEN 'Test' WHEN 1 THEN 'Model' ELSE 'Unknown' END AS classification, 'python' AS language FROM {PEOPLE} GROUP BY file_ord, n"""
)
def python_file_facts(spark, d):
    files = code.corpus(python_files(spark, d)).files
    return files.select("file_ord", F.array_join("usings", ",").alias("usings"), F.array_join("dependencies", ",").alias("dependencies"), "classification", "language")


@query(
    """SELECT n_nationkey AS k, CASE n_nationkey % 8 WHEN 0 THEN 'Test' WHEN 1 THEN 'View' WHEN 2 THEN 'Model' WHEN 3 THEN 'Controller' WHEN 4 THEN 'Service' WHEN 5 THEN 'Repository' WHEN 6 THEN 'Config'
  ELSE CASE n_regionkey WHEN 0 THEN 'View' WHEN 1 THEN 'Model' WHEN 2 THEN 'Test' ELSE 'Unknown' END END AS classification FROM nation"""
)
def python_classification(spark, d):
    k = F.col("n_nationkey")
    names = ["test_x.py", "views.py", "forms.py", "routes.py", "x_service.py", "x_repository.py", "conftest.py", "x.py"]
    name = F.element_at(F.array(*map(F.lit, names)), (k % 8 + 1).cast("int"))
    base = F.element_at(F.array(*map(F.lit, ("ListView", "BaseModel", "MyTestCase", "Thing", "Other"))), (F.col("n_regionkey") + 1).cast("int"))
    rows = A.read(spark, d, "nation").select(k.alias("k"), name.alias("name"), F.array(F.lit("object"), base).alias("bases"))
    return rows.select("k", index.python_classification(_cat("app/", F.col("name")), F.col("name"), F.col("bases")).alias("classification"))


# Markup: a window for each nation and 100 customers; a customer is a line with one element, or two.
CONTROLS = f"(SELECT k, n, file_ord, name, k % 4 AS kind, CAST(9 + row_number() OVER (PARTITION BY file_ord ORDER BY k) - 1 AS INTEGER) AS line, CAST(3 + sum(CASE k % 4 WHEN 1 THEN 0 WHEN 3 THEN 2 ELSE 1 END) OVER (PARTITION BY file_ord ORDER BY k) - CASE k % 4 WHEN 3 THEN 1 ELSE 0 END AS INTEGER) AS node FROM {PEOPLE})"


def markup_files(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, _cat('<TextBlock x:Name="c', _s(k), '" Text="{Binding Path=Total', _s(k), ', Mode=OneWay}"/>'))
    text = text.when(k % 4 == 1, "<Rectangle/>").when(k % 4 == 2, _cat('<Button Content="{Binding B', _s(k), '}" Command="{Binding Go}" Style="{StaticResource Big}"/>'))
    text = text.otherwise(_cat('<Shape><Style.Triggers><Trigger/></Style.Triggers><TextBox Header="h', _s(k), '" Text="{Binding A}"/></Shape>'))
    rows = A.read(spark, d, "customer").select(k.alias("k"), F.col("c_nationkey").cast("long").alias("n"), F.floor(k / 100).alias("block"), _cat(text, _N).alias("text"))
    rows = rows.groupBy("n", "block").agg(_joined("k", F.col("text")).alias("text"))
    head = _cat('<Window x:Class="Shop.N', _s("n"), '" xmlns:x="x">\n<Window.Resources>\n<Style/>\n<Style/>\n</Window.Resources>\n<Grid>\n<Grid.RowDefinitions/>\n<StackPanel x:Name="list">\n')
    return rows.select((F.col("n") * 1_000_000 + F.col("block")).alias("file_ord"), _cat(head, F.col("text"), "</StackPanel>\n</Grid>\n</Window>\n").alias("text"))


@query(
    f"""SELECT file_ord, node AS node_id, 3 AS parent_id, 3 AS depth, CASE kind WHEN 0 THEN 'TextBlock' WHEN 2 THEN 'Button' ELSE 'Shape' END AS element, CASE kind WHEN 0 THEN 'c' || k END AS x_name, NULL AS header,
  CASE kind WHEN 0 THEN 'Text=Total' || k WHEN 2 THEN 'Command=Go' END AS binding, CASE kind WHEN 2 THEN 'Big' END AS style, line AS start_line FROM {CONTROLS} WHERE kind <> 1
UNION ALL SELECT file_ord, node + 1, node, 4, 'TextBox', NULL, 'h' || k, 'Text=A', NULL, line FROM {CONTROLS} WHERE kind = 3
UNION ALL SELECT file_ord, u.i, u.p, u.d, u.e, u.x, NULL, NULL, NULL, u.l FROM (SELECT DISTINCT file_ord FROM {CONTROLS}), (VALUES (0, NULL, 0, 'Window', NULL, 1), (1, 0, 1, 'Window.Resources', NULL, 2), (2, 0, 1, 'Grid', NULL, 6), (3, 2, 2, 'StackPanel', 'list', 8)) u(i, p, d, e, x, l)"""
)
def markup_nodes(spark, d):
    return markup.nodes(markup_files(spark, d)).select("file_ord", "node_id", "parent_id", "depth", "element", "x_name", "header", "binding", "style", "start_line")


@query(f"SELECT DISTINCT file_ord FROM {PEOPLE} WHERE k % 4 = 2")
def binding_probe(spark, d):
    from .operators import impact

    return impact.binding_files(markup_files(spark, d), "GO").select("file_ord")


# Projects: one for each supplier, with references to the project of its nation.
def project_files(spark, d) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    root = F.when(k % 2 == 0, _cat("<RootNamespace>Shop.S", _s(k), "</RootNamespace>")).when(k % 3 == 0, _cat("<AssemblyName>Asm", _s(k), "</AssemblyName>")).otherwise("")
    refs = _cat('<ProjectReference Include="..\\N', _s(n), "\\N", _s(n), '.csproj"/>', F.when(k % 5 == 0, F.lit('<ProjectReference Include="..\\..\\lib\\Core.csproj"/>')).otherwise(""))
    packages = F.when(k % 4 == 0, _cat('<PackageReference Include="Pack', _s(k % 7), '"/>')).otherwise("")
    text = _cat("<Project><PropertyGroup><TargetFramework>net", _s(k % 3 + 6), ".0</TargetFramework>", F.when(k % 2 == 1, F.lit("<OutputType>Exe</OutputType>")).otherwise(""), root, "</PropertyGroup><ItemGroup>", refs, packages, "</ItemGroup></Project>")
    name = _cat("S", _s(k), ".csproj")
    return A.read(spark, d, "supplier").select(k.alias("file_ord"), name.alias("file_name"), _cat("src/S", _s(k), "/", name).alias("relative_path"), text.alias("text"))


@query(
    r"""SELECT s_suppkey AS file_ord, '..\N' || s_nationkey || '\N' || s_nationkey || '.csproj' || CASE WHEN s_suppkey % 5 = 0 THEN ',..\..\lib\Core.csproj' ELSE '' END AS refs, CASE WHEN s_suppkey % 4 = 0 THEN 'Pack' || (s_suppkey % 7) ELSE '' END AS packages,
  'net' || (s_suppkey % 3 + 6) || '.0' AS framework, CASE WHEN s_suppkey % 2 = 1 THEN 'Exe' END AS output, CASE WHEN s_suppkey % 2 = 0 THEN 'Shop.S' || s_suppkey WHEN s_suppkey % 3 = 0 THEN 'Asm' || s_suppkey ELSE 'S' || s_suppkey END AS namespace FROM supplier"""
)
def project_facts(spark, d):
    facts = scans.project_facts(project_files(spark, d))
    return facts.select("file_ord", F.array_join("project_refs", ",").alias("refs"), F.array_join("packages", ",").alias("packages"), "framework", "output", "namespace")


@query(
    r"""SELECT 'S' || s_suppkey AS source_project, '..\N' || s_nationkey || '\N' || s_nationkey || '.csproj' AS relative_path, 'src/N' || s_nationkey || '/N' || s_nationkey || '.csproj' AS resolved_path, 'N' || s_nationkey AS name FROM supplier
UNION ALL SELECT 'S' || s_suppkey, '..\..\lib\Core.csproj', 'lib/Core.csproj', 'Core' FROM supplier WHERE s_suppkey % 5 = 0"""
)
def project_references_resolved(spark, d):
    files = project_files(spark, d)
    return scans.project_references(scans.project_facts(files), files)


# Scans and lists.
@query("SELECT p_partkey, p_name || '|' || p_type AS items, lower(p_name) || '|' || lower(p_type) || '|.git' AS ignored FROM part")
def parsed_lists(spark, d):
    from .functions import text as T

    line = _cat(" ", F.col("p_name"), " ,, ; ", F.col("p_type"), ";")
    return A.read(spark, d, "part").select("p_partkey", F.array_join(T.parse_list(line), "|").alias("items"), F.array_join(T.parse_ignored(line), "|").alias("ignored"))


TREE = """(SELECT file_ord, CASE file_ord % 9 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/Build/' WHEN 2 THEN 'docs/' WHEN 3 THEN 'src/gen/' ELSE 'src/' END || CAST(file_ord AS VARCHAR) || CASE file_ord % 4 WHEN 0 THEN '.cs' WHEN 1 THEN '.PY' WHEN 2 THEN '.tmp' ELSE '.md' END AS relative_path FROM (SELECT doc_id AS file_ord FROM documents))"""


def _tree(spark, d) -> DataFrame:
    i = F.col("doc_id")
    top = F.when(i % 9 == 0, "node_modules/").when(i % 9 == 1, "src/Build/").when(i % 9 == 2, "docs/").when(i % 9 == 3, "src/gen/").otherwise("src/")
    end = F.when(i % 4 == 0, ".cs").when(i % 4 == 1, ".PY").when(i % 4 == 2, ".tmp").otherwise(".md")
    return A.read(spark, d, "documents").select(i.alias("file_ord"), F.concat(top, _s(i), end).alias("relative_path"))


@query(f"SELECT file_ord, relative_path FROM {TREE} WHERE file_ord % 9 NOT IN (0, 1, 2, 3) AND file_ord % 4 <> 2")
def repository_scan(spark, d):
    """Fixed directories, an ignore pattern, a prefix to include and one to exclude, extensions."""
    return scans.repository_files(_tree(spark, d), [".cs", ".py", ".md", ".tmp"], ["bin"], ["*/*.tmp"], ["SRC/"], ["src/GEN"])


@query(f"SELECT file_ord FROM {TREE} WHERE file_ord % 4 IN (0, 1)")
def preset_scan(spark, d):
    wanted = scans.with_preset([".py"], "csharp")
    return _tree(spark, d).filter(scans.accepted(F.col("relative_path"), wanted, [])).select("file_ord")


@query("SELECT n_name AS directory FROM nation WHERE n_regionkey <> 2")
def active_directories(spark, d):
    rows = A.read(spark, d, "nation").select(F.col("n_name").alias("directory"), "n_regionkey")
    return scans.active_directories(rows.select("directory"), rows.filter("n_regionkey = 2").select("directory"))


@query("SELECT CAST(number AS INTEGER) AS number, pattern FROM (SELECT row_number() OVER (ORDER BY lower(n_name)) AS number, lower(n_name) || '/' AS pattern FROM nation)")
def ignore_file(spark, d):
    """An ignore file with blank lines and comments, read back in its order."""
    from .plans.shared import fresh_path

    name = F.lower("n_name")
    line = F.array(_cat("# ", name), F.lit(""), _cat("  ", name, "/ "))
    path = fresh_path(spark, "ignore")
    A.read(spark, d, "nation").orderBy(name).coalesce(1).select(F.explode(line).alias("value")).write.text(path)
    found = scans.ignore_patterns(spark, path)
    return spark.createDataFrame([(i, p) for i, p in enumerate(found, 1)], "number int, pattern string")


# Logs.
@query(
    """SELECT o_orderkey AS ord, 'f' || o_custkey || '.R' AS file, CAST(o_orderkey % 1000 AS INTEGER) AS line, CASE o_orderkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'style' END AS kind, o_orderpriority AS message FROM orders WHERE o_orderkey % 4 <> 3"""
)
def lint_log(spark, d):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "Error").when(k % 4 == 1, "WARNING").when(k % 4 == 2, "style").otherwise("info")
    line = _cat("pkg/R/f", _s("o_custkey"), ".R:", _s(k % 1000), ":7: ", kind, ": ", F.col("o_orderpriority"), "  ")
    return logs.lint_messages(A.read(spark, d, "orders").select(k.alias("ord"), line.alias("value")))


@query(
    """SELECT o_orderkey AS ord, CASE o_orderkey % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'note' ELSE 'error' END AS kind,
  CASE o_orderkey % 6 WHEN 0 THEN '* checking ' || o_custkey || ' ... ERROR' WHEN 1 THEN '* checking ' || o_custkey || ' ... WARNING' WHEN 2 THEN '* checking ' || o_custkey || ' ... NOTE' WHEN 3 THEN 'Error in f(' || o_custkey || ')' ELSE 'bad ' || o_custkey END AS message
FROM orders WHERE o_orderkey % 6 <> 5"""
)
def check_log(spark, d):
    k, c = F.col("o_orderkey"), _s("o_custkey")
    value = F.when(k % 6 == 0, _cat("* checking ", c, " ... ERROR")).when(k % 6 == 1, _cat("  * checking ", c, " ... WARNING")).when(k % 6 == 2, _cat("* checking ", c, " ... NOTE "))
    value = value.when(k % 6 == 3, _cat("Error in f(", c, ")")).when(k % 6 == 4, _cat("tests/a.R:3:4: bad ", c)).otherwise(_cat("* checking ", c, " ... OK"))
    return logs.check_messages(A.read(spark, d, "orders").select(k.alias("ord"), value.alias("value")))


@query("SELECT o_orderkey AS ord, o_orderpriority AS value FROM orders ORDER BY o_orderkey DESC LIMIT 500")
def log_tail(spark, d):
    return logs.tail(A.read(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("value")), 500)


@query("SELECT CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size_bytes, CAST(floor(sum(octet_length(encode(text)) + 1) / 4) AS BIGINT) AS tokens, CAST(floor(sum(octet_length(encode(text)) + 1) * 100 / 20480) AS BIGINT) AS percent FROM (SELECT text FROM benchmark)")
def notes_size(spark, d):
    return logs.notes_size(A.read(spark, d, "benchmark").select("text"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS number, n_name AS component, CAST(r_name AS VARCHAR) AS observation FROM nation JOIN region ON n_regionkey = r_regionkey")
def lessons_read(spark, d):
    """A lessons file of a JSON array, as another tool writes it; a file that is not there, and one that is no JSON, add nothing."""
    from .plans.shared import fresh_path

    rows = A.read(spark, d, "nation").join(A.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lesson = F.struct(F.col("n_nationkey").cast("int").alias("number"), F.col("n_name").alias("component"), F.col("r_name").alias("observation"))
    path, broken = fresh_path(spark, "lessons"), fresh_path(spark, "lessons")
    rows.agg(F.to_json(F.collect_list(lesson)).alias("value")).coalesce(1).write.text(path)
    spark.createDataFrame([("no json at all",)], "value string").coalesce(1).write.text(broken)
    found = logs.lessons(spark, path)
    for p in (fresh_path(spark, "missing"), broken):
        found = found.unionByName(logs.lessons(spark, p).filter("number is not null"))
    return found.select("number", "component", "observation")
