"""Python source by its lines: classes, functions, imports and calls."""

from __future__ import annotations

import re

#: The forms of declarations, imports and calls that are recognised.
_CLASS = re.compile(r"^class\s+(\w+)\s*(?:\((.*?)\))?\s*:")
_DEF = re.compile(r"^(\s*)(async\s+)?def\s+(\w+)\s*\((.*?)\)\s*(?:->\s*(\S+))?\s*:")
_IMPORT = re.compile(r"^(?:from\s+(\S+)\s+)?import\s+(.+)$")
_CALL = re.compile(r"(\w+(?:\.\w+)*)\s*\(")


def _indent(line: str) -> int:
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return len(lead) + 3 * lead.count("\t")


def _end(lines: list[str], at: int, indent: int) -> int:
    """Index of the first line after at that is not blank and not deeper than indent."""
    return next((i for i in range(at + 1, len(lines)) if lines[i].strip() and _indent(lines[i]) <= indent), len(lines))


def _doc(lines: list[str], at: int) -> str:
    first = lines[at].strip() if at < len(lines) else ""
    if (quote := first[:3]) not in ('"""', "'''"):
        return ""
    if len(first) > 6 and first.endswith(quote):
        return first[3:-3].strip()
    out = [first[3:]]
    for line in lines[at + 1 :]:
        if quote in line:
            out.append(line[: line.index(quote)])
            break
        out.append(line.strip())
    return " ".join(out).strip()


def imports(lines: list[str]) -> list[str]:
    out = []
    for line in lines:
        if m := _IMPORT.match(line):
            out += [m[1]] if m[1] else [p.strip().split(" ")[0] for p in m[2].split(",")]
    return [x for x in dict.fromkeys(out) if x]


def parse(text: str, stem: str) -> dict:
    """usings, dependencies, types (with members) and calls. Functions outside classes belong to a type named after the file; their
    callers' type is module. Decorators have no effect; a first parameter cls makes a method static; _names are private."""
    lines = text.split("\n")
    calls: list[dict] = []

    def member(i: int, m: re.Match, owner: str) -> dict:
        end = _end(lines, i, _indent(lines[i]))
        params = [p.strip() for p in m[4].split(",") if p.strip()]
        body = "\n".join(lines[i:end])
        for c in _CALL.findall(body):
            *receiver, name = c.split(".")
            calls.append({"caller_type": owner, "caller_method": m[3], "called_type": ".".join(receiver) or owner, "called_method": name, "line": 0, "is_property_access": False})
        return {
            "name": m[3], "kind": "Method", "return_type": m[5] or "None", "signature": f"{m[3]}({m[4]})", "access_modifier": "private" if m[3].startswith("_") else "public",
            "parameters": params, "body": body, "is_static": bool(params) and params[0].split(":")[0].strip() == "cls", "is_async": bool(m[2]), "is_virtual": False, "is_override": False,
            "is_abstract": False, "start_line": i + 1, "end_line": end, "xml_doc": _doc(lines, i + 1),
        }

    types = []
    for i, line in enumerate(lines):
        if c := _CLASS.match(line):
            end = _end(lines, i, 0)
            bases = [b.strip() for b in c[2].split(",")] if c[2] else [""]
            own = [member(k, m, c[1]) for k in range(i, end) if (m := _DEF.match(lines[k])) and m[1]]
            types.append({"name": c[1], "full_name": c[1], "kind": "Class", "base_type": bases[0], "interfaces": bases[1:], "is_abstract": False, "start_line": i + 1, "end_line": end, "xml_doc": _doc(lines, i + 1), "members": own})
    functions = [member(i, m, "module") for i, line in enumerate(lines) if (m := _DEF.match(line)) and not m[1]]
    if functions:
        types.insert(0, {"name": stem, "full_name": stem, "kind": "Class", "base_type": "", "interfaces": [], "is_abstract": False, "start_line": 1, "end_line": len(lines), "xml_doc": "", "members": functions})
    used = imports(lines)
    return {"namespace": "", "usings": used, "dependencies": list(dict.fromkeys(u.split(".")[0] for u in used)), "types": types, "calls": calls}
