"""Markup trees: elements of XAML as a flat table, and their bindings."""

from __future__ import annotations

import re
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.shared import map_texts

#: Elements that are left out, those that always show, property elements that count, attributes that bind.
SKIPPED = frozenset(
    """setter setter.value trigger datatrigger multitrigger eventtrigger style.triggers controltemplate.triggers gradientstop lineargradientbrush
    radialgradientbrush solidcolorbrush rotatetransform scaletransform translatetransform storyboard doubleanimation coloranimation
    datagridtextcolumn datagridtemplatecolumn datagridcheckboxcolumn columndefinition rowdefinition grid.columndefinitions grid.rowdefinitions
    booleantovisibilityconverter style controltemplate""".split()
)
SHOWN = frozenset(
    """window usercontrol page grid stackpanel dockpanel wrappanel canvas border scrollviewer tabcontrol tabitem groupbox expander menu menuitem
    toolbar statusbar datagrid listview listbox treeview combobox button togglebutton radiobutton checkbox textbox textblock label passwordbox
    richtextbox image mediaelement slider progressbar contentcontrol itemscontrol frame datepicker calendar""".split()
)
PROPERTIES = (".Resources", ".Content", ".Items", ".ContextMenu", ".ToolTip")
BOUND = ("ItemsSource", "SelectedItem", "SelectedValue", "Text", "Content", "IsChecked", "Value", "Visibility", "IsEnabled", "Command", "CommandParameter")

NODES = "file_ord long, node_id int, parent_id int, depth int, element string, x_name string, header string, content string, text string, binding string, style string, start_line int, end_line int"


def _read(text: str) -> dict | None:
    parser, stack, root = expat.ParserCreate(), [], []

    def start(name: str, attributes: dict) -> None:
        node = {"name": name.split(":")[-1], "at": attributes, "line": parser.CurrentLineNumber, "children": [], "last": parser.CurrentLineNumber}
        (stack[-1]["children"] if stack else root).append(node)
        stack.append(node)

    def end(_: str) -> None:
        node = stack.pop()
        node["last"] = max([node["line"], *(c["last"] for c in node["children"])])

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.Parse(text, True)
    return root[0] if root else None


def binding_of(attributes: dict) -> str | None:
    out = None
    for name in BOUND:
        if (m := re.search(r"\{Binding\s+([^}]+)\}", attributes.get(name, ""))) is not None:
            out = f"{name}={m[1].split(',')[0].strip().removeprefix('Path=')}"
    return out


def tree(text: str) -> list[dict]:
    """Nodes in document order; a text that is not well formed is one node that says so."""
    try:
        root = _read(text)
    except expat.ExpatError as e:
        return [{"node_id": 0, "parent_id": None, "depth": 0, "element": f"ERROR: {e}", "start_line": 0, "end_line": 0}]

    def build(node: dict) -> dict:
        a = node["at"]
        style = a.get("Style")
        made = {
            "element": node["name"], "x_name": a.get("x:Name") or a.get("Name"), "header": a.get("Header"), "content": a.get("Content"), "text": a.get("Text"), "binding": binding_of(a),
            "style": (re.search(r"\{(?:Static|Dynamic)Resource\s+(\w+)\}", style) or [None, style])[1] if style else None, "start_line": node["line"], "end_line": node["last"], "children": [],
        }
        for child in node["children"]:
            name = child["name"]
            if name.lower() in SKIPPED or "." in name and not name.endswith(PROPERTIES):
                continue
            if name.endswith(".Resources"):
                made["children"].append({"element": name, "content": f"{len(child['children'])} items", "start_line": child["line"], "end_line": child["last"], "children": []})
                continue
            below = build(child)
            if name.lower() in SHOWN or below["x_name"] or below["binding"] or below["header"] or below["children"]:
                made["children"].append(below)
        return made

    out: list[dict] = []

    def flatten(node: dict, parent: int | None, depth: int) -> None:
        me = len(out)
        out.append({k: v for k, v in node.items() if k != "children"} | {"node_id": me, "parent_id": parent, "depth": depth})
        for c in node["children"]:
            flatten(c, me, depth + 1)

    if root:
        flatten(build(root), None, 0)
    return out


def nodes(files: DataFrame) -> DataFrame:
    """The nodes of files(file_ord, text)."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in NODES.split(", ")])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [{"file_ord": o, **n} for o, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for n in tree(t or "")]
        return pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in rows], schema)

    return map_texts(files.select("file_ord", "text"), run, NODES)
