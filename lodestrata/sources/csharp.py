"""C# source by a small lexer: namespace, usings, types, members, call sites.

Comments and literals are blanked first, so braces and words in them do not count; places keep their lines."""

from __future__ import annotations

import re

#: Members of the framework that are no sign of a use.
NOISE = frozenset(
    """Length Count ToString Equals GetHashCode GetType Where Select Any All First FirstOrDefault Last LastOrDefault OrderBy
    OrderByDescending ThenBy ThenByDescending ToList ToArray ToDictionary ToHashSet Sum Min Max Average Aggregate Contains Except
    Intersect Union Distinct Concat Skip Take SkipWhile TakeWhile GroupBy SelectMany Zip OfType Cast Add Remove RemoveAll Insert Clear
    AddRange RemoveAt ConfigureAwait GetAwaiter GetResult WaitAsync Abs Round Floor Ceiling Sqrt Pow HasValue Value TryParse Parse""".split()
)
_BLANK = re.compile(r'//[^\n]*|/\*.*?\*/|@"(?:[^"]|"")*"|\$?"""[\s\S]*?"""|\$?@?"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', re.S)
_MODS = r"(?:(?:public|internal|private|protected|abstract|sealed|static|partial|readonly|ref|file|new|unsafe)\s+)*"
_TYPE = re.compile(rf"({_MODS})\b(class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+(\w+)\s*(?:<[^>{{;]*>)?\s*(?:\([^)]*\))?\s*(?::\s*([^{{;]+?))?(?:\s*\bwhere\b[^{{;]*)?\s*([{{;])")
_DELEGATE = re.compile(rf"({_MODS})\bdelegate\s+([\w<>\[\],.? ]+?)\s+(\w+)\s*\(([^)]*)\)\s*;")
_CALL = re.compile(r"(?<![\w.?])((?:[A-Za-z_]\w*(?:\([^()]*\))?\s*\.\s*)*)([A-Za-z_]\w*)\s*\(")
_ACCESS = re.compile(r"(?<![\w.?])((?:[A-Za-z_]\w*\s*\.\s*)+)([A-Za-z_]\w*)(?!\s*[\w(.<])")
_KEYWORDS = frozenset("if for foreach while switch using lock return catch when nameof typeof sizeof default checked unchecked fixed await throw new base this in is as and or not out ref var get set init add remove".split())
_METHOD = re.compile(r"^(.*?)(?:([\w<>\[\],.?()]+(?:\s*<.*>)?)\s+)?([\w.]+)\s*(?:<[^>]*>)?\s*\((.*)\)\s*(?::.*|where.*)?$", re.S)


def blanked(code: str) -> str:
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def _close(text: str, at: int) -> int:
    """Index of the brace that closes the one at at; the end if there is none."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if not depth:
                return i
    return len(text) - 1


def _split(text: str, by: str = ",") -> list[str]:
    """Pieces of text between separators that are in no brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<([{") - (c in ">)]}")
        if c == by and depth == 0:
            out.append(text[last:i])
            last = i + 1
    return [x.strip() for x in [*out, text[last:]] if x.strip()]


def _top(text: str) -> re.Match | None:
    """The first arrow or sign of assignment that is in no brackets."""
    depth, after = 0, 0
    for m in re.finditer(r"[(\[{]|[)\]}]|=>|[=!<>]=|=", text):
        depth += (m[0] in "([{") - (m[0] in ")]}")
        if depth == 0 and m[0] in ("=>", "=") and m.start() >= after:
            return m
        after = m.end()
    return None


def split_bases(bases: list[str]) -> tuple[str, list[str]]:
    """The first that does not look like an interface (I and a capital), and the others."""
    base = next((b for b in bases if not re.match(r"I[A-Z]", b)), "")
    rest = list(bases)
    if base:
        rest.remove(base)
    return base, rest


def _access(words: list[str]) -> str:
    return next((a for a in ("public", "protected", "internal") if a in words), "private")


def _doc(lines: list[str], at: int) -> str:
    out = []
    while at > 0 and (lines[at - 1].strip().startswith("///") or (out == [] and lines[at - 1].strip().startswith("["))):
        if lines[at - 1].strip().startswith("///"):
            out.insert(0, lines[at - 1].strip()[3:].strip())
        at -= 1
    return " ".join(out).strip()


def _statements(text: str, begin: int, end: int):
    """header, place, body range (or None) of each member in a type's body."""
    i = last = begin
    depth = 0
    while i < end:
        c = text[i]
        depth += (c == "(") - (c == ")")
        if depth == 0 and c == "{":
            close = _close(text, i)
            yield text[last:i], last, (i, close)
            i = close
            after = i + 1
            if (m := re.match(r"\s*=[^;]*;", text[after:end])) is not None:  # a property with a first value
                i = after + m.end() - 1
            last = i + 1
        elif depth == 0 and c == ";":
            yield text[last:i], last, None
            last = i + 1
        i += 1


def _sites(code: str, text: str, begin: int, end: int, owner: str, method: str, line_of) -> list[dict]:
    out, body = [], text[begin:end]
    row = lambda m, t, n, p: {"caller_type": owner, "caller_method": method, "called_type": t, "called_method": n, "line": line_of(begin + m.start()), "is_property_access": p}
    for m in _CALL.finditer(body):
        if m[2] in _KEYWORDS or re.search(r"\bnew\s+$", body[: m.start()]):
            continue
        receiver = re.sub(r"\s*\.\s*$", "", code[begin + m.start(1) : begin + m.end(1)]).strip()
        out.append(row(m, receiver or owner, m[2], False))
    for m in _ACCESS.finditer(body):
        if m[2] not in NOISE and m[2] not in _KEYWORDS and m[1].split(".")[0].strip() not in ("new", "using", "namespace"):
            out.append(row(m, re.sub(r"\s*\.\s*$", "", m[1]).strip(), m[2], True))
    return out


def parse(code: str) -> dict:
    """namespace, usings, dependencies, types (with members) and calls. A source that cannot be read has no types."""
    text, lines = blanked(code), code.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)

    def line_of(at: int) -> int:
        import bisect

        return bisect.bisect_right(starts, at)

    ns = re.search(r"\bnamespace\s+([\w.]+)", text)
    usings = re.findall(r"^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;", text, re.M)
    namespace = ns[1] if ns else ""
    types, calls = [], []
    found = list(_TYPE.finditer(text))
    bodies = [(m.end() - 1, _close(text, m.end() - 1)) if m[5] == "{" else None for m in found]
    for m, body in zip(found, bodies, strict=True):
        kind = m[2].split()[0].capitalize()
        name, mods = m[3], m[1].split()
        base, faces = split_bases(_split(m[4])) if m[4] and kind != "Enum" else ("", [])
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        members = []
        if body:
            # nested types are types of their own
            inner = list(text[body[0] + 1 : body[1]])
            for m2, b2 in zip(found, bodies, strict=True):
                if body[0] < m2.start() < body[1] and b2:
                    for i in range(m2.start() - body[0] - 1, min(b2[1] + 1, body[1]) - body[0] - 1):
                        if inner[i] != "\n":
                            inner[i] = " "
            view = text[: body[0] + 1] + "".join(inner) + text[body[1] :]
            if kind == "Enum":
                for part in _split("".join(inner)):
                    members.append(_member(re.match(r"\w*", part)[0], "Field", name, part, "public", [], "", [], 0, 0, ""))
            else:
                for head, place, block in _statements(view, body[0] + 1, body[1]):
                    if made := _declared(code, text, head, place, block, name, lines, line_of):
                        member, sites = made
                        members.append(member)
                        calls += sites
        types.append({"name": name, "full_name": f"{namespace}.{name}".lstrip("."), "kind": kind, "base_type": base, "interfaces": faces, "is_abstract": "abstract" in mods, "start_line": line_of(at), "end_line": line_of(body[1] if body else m.end()), "xml_doc": _doc(lines, line_of(at) - 1), "members": members})
    for m in _DELEGATE.finditer(text):
        at = line_of(m.start() + len(m[0]) - len(m[0].lstrip()))
        invoke = _member(m[3], "Method", m[2].strip(), f"{m[3]}({m[4]})", _access(m[1].split()), _split(m[4]), "", m[1].split(), at, at, "")
        types.append({"name": m[3], "full_name": f"{namespace}.{m[3]}".lstrip("."), "kind": "Delegate", "base_type": "", "interfaces": [], "is_abstract": False, "start_line": at, "end_line": at, "xml_doc": "", "members": [invoke]})
    deps = list(dict.fromkeys(b for t in types for b in [t["base_type"], *t["interfaces"]] if b))
    return {"namespace": namespace, "usings": usings, "dependencies": deps, "types": types, "calls": calls}


def _member(name, kind, returns, signature, access, params, body, mods, start, end, doc) -> dict:
    flag = {f"is_{w}": w in mods for w in ("static", "async", "virtual", "override", "abstract")}
    return {"name": name, "kind": kind, "return_type": returns, "signature": signature, "access_modifier": access, "parameters": params, "body": body, **flag, "start_line": start, "end_line": end, "xml_doc": doc}


_WORDS = r"(?:(?:public|private|protected|internal|static|async|virtual|override|abstract|sealed|readonly|extern|unsafe|partial|new|required|const|volatile|event)\s+)*"


def _declared(code, text, head, place, block, owner, lines, line_of):
    """The member that a statement of a type's body declares, and its call sites."""
    lead = len(head) - len(head.lstrip())
    h = re.sub(r"^(?:\s*\[[^\]]*\])+", "", head).strip()
    if not h:
        return None
    top = _top(h)  # values of parameters are in brackets
    arrow, value = bool(top and top[0] == "=>"), bool(top and top[0] == "=")
    sig = h[: top.start()].strip() if top and not h.startswith("operator") else h
    words = re.match(_WORDS, sig + " ")[0].split()
    rest = sig[len(re.match(_WORDS, sig + " ")[0].rstrip()) :].strip() if words else sig
    start, end = line_of(place + lead), line_of(block[1] if block else place + len(head))
    doc = _doc(lines, start - 1)
    body_range = block or ((place + head.index("=>") + 2, place + len(head)) if arrow else None)
    body = code[body_range[0] : body_range[1] + 1] if body_range else ""
    name_args = re.match(r"^(?:(.+?)\s+)?([\w.~]+)\s*(?:<[^>]*>)?\s*\((.*)\)\s*(?::.*|where.*)?$", rest, re.S)
    if "event" in words:
        if not block:
            return None  # field-like events are not members
        *kind, name = rest.split()
        return _member(name, "Event", " ".join(kind), rest, _access(words), [], body, words, start, end, doc), []
    if name_args and (block or arrow or "abstract" in words or not value):
        name, params = name_args[2], _split(name_args[3])
        ctor = name == owner and not name_args[1]
        sites = _sites(code, text, body_range[0], body_range[1] + 1, owner, ".ctor" if ctor else name, line_of) if body_range else []
        return _member(name, "Constructor" if ctor else "Method", name_args[1] or "", f"{name}({', '.join(params)})", _access(words), params, body, words, start, end, doc), sites
    parts = rest.split()
    if len(parts) < 2:
        return None
    if block or arrow:
        sites = _sites(code, text, body_range[0], body_range[1] + 1, owner, parts[-1], line_of) if body_range else []
        return _member(parts[-1], "Property", " ".join(parts[:-1]), rest, _access(words), [], body, words, start, end, doc), sites
    first = _split(rest)[0].split()
    return _member(first[-1], "Field", " ".join(first[:-1]), rest, _access(words), [], "", words, start, end, doc), []
