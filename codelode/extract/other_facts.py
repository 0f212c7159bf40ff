"""Facts of Python, Go and SQL files."""

from __future__ import annotations

import ast
import re
import warnings

from codelode.extract.ecma_facts import balanced, split_top
from codelode.syntax.golang import HARD, RUNE, STRING
from codelode.syntax.groups import Bad

EMPTY = {"functions": [], "classes": [], "imports": [], "exports": [], "findings": [], "unused_imports": [], "unused_variables": []}
PY_SHAPES = {ast.If: "IF", ast.For: "FOROF", ast.AsyncFor: "FOROF", ast.While: "WHILE", ast.Match: "SWITCH", ast.Try: "TRY", ast.Return: "RET", ast.Raise: "THROW", ast.Await: "AWAIT"}
PY_DECISIONS = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.match_case)


def function_row(**more) -> dict:
    row = {"name": None, "owner": None, "line": 0, "n_lines": 0, "params": [], "is_async": False, "exported": False, "returns": None, "calls": [], "complexity": 1, "structure": "", "has_doc": False, "doc_params": [], "doc_returns": False, "has_return": False, "accessor": None, "sql": []}
    return row | more


def python_facts(text: str) -> dict:
    """From the interpreter's own syntax tree; top-level classes and functions, and methods without __init__ among the names of methods."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text.removeprefix(chr(0xFEFF)))
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            raise Bad(str(e)) from None
    out = {k: [] for k in EMPTY}
    named = [ast.literal_eval(n.value) for n in tree.body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)) and all(isinstance(e, ast.Constant) for e in n.value.elts)]
    listed = set(named[0]) if named else None
    is_open = lambda name: name in listed if listed is not None else not name.startswith("_")

    def calls(node):
        found = {}
        for c in ast.walk(node):
            if isinstance(c, ast.Call):
                f = c.func
                if isinstance(f, ast.Name):
                    name = f.id
                elif isinstance(f, ast.Attribute):
                    owner = f.value.id if isinstance(f.value, ast.Name) else f.value.attr if isinstance(f.value, ast.Attribute) else ""
                    name = f"{owner}.{f.attr}" if owner and owner not in ("self", "cls") else f.attr
                else:
                    continue
                if name != "print":
                    found.setdefault(name)
        return list(found)

    def add(f, owner):
        a = f.args
        args = [x.arg for x in [*a.posonlyargs, *a.args]]
        plain = len(args) - len(a.defaults)
        params = [n + ("=" if k >= plain else "") for k, n in enumerate(args)]
        if owner and params and params[0] in ("self", "cls"):
            params = params[1:]
        params += ["..." + x.arg for x in [a.vararg] if x] + [x.arg + ("=" if d else "") for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)] + ["..." + x.arg for x in [a.kwarg] if x]
        inside = [n for s in f.body for n in ast.walk(s)]
        doc = ast.get_docstring(f)
        out["functions"].append(function_row(
            name=f.name, owner=owner, line=f.lineno, n_lines=(f.end_lineno or f.lineno) - f.lineno + 1, params=params, is_async=isinstance(f, ast.AsyncFunctionDef), exported=owner is None and is_open(f.name),
            returns=ast.unparse(f.returns) if f.returns else None, calls=calls(ast.Module(f.body, [])),
            complexity=1 + sum(isinstance(n, PY_DECISIONS) for n in inside) + sum(len(n.values) - 1 for n in inside if isinstance(n, ast.BoolOp)),
            structure="|".join(PY_SHAPES[type(n)] for n in inside if type(n) in PY_SHAPES), has_doc=bool(doc), doc_params=re.findall(r":param\s+(?:[\w.\[\]]+\s+)?(\w+)", doc or ""), doc_returns=bool(re.search(r":returns?:", doc or "")),
            has_return=any(isinstance(n, ast.Return) and n.value is not None for n in inside), accessor="method" if owner else None,
        ))

    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            add(n, None)
        elif isinstance(n, ast.ClassDef):
            methods = [m for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            fields = [t.id for m in n.body if isinstance(m, (ast.Assign, ast.AnnAssign)) for t in (m.targets if isinstance(m, ast.Assign) else [m.target]) if isinstance(t, ast.Name)]
            out["classes"].append({"name": n.name, "extends": ast.unparse(n.bases[0]) if n.bases else None, "line": n.lineno, "methods": [m.name for m in methods if m.name != "__init__"], "properties": fields, "calls": calls(n), "exported": is_open(n.name), "has_doc": bool(ast.get_docstring(n))})
            for m in methods:
                add(m, n.name)
        elif isinstance(n, ast.Import):
            for x in n.names:
                out["imports"].append({"source": x.name, "names": [x.asname or x.name.split(".")[0]], "line": n.lineno})
        elif isinstance(n, ast.ImportFrom):
            out["imports"].append({"source": "." * n.level + (n.module or ""), "names": [x.asname or x.name for x in n.names], "line": n.lineno})
    out["exports"] = sorted(listed) if listed is not None else sorted(x["name"] for x in [*out["classes"], *(f for f in out["functions"] if not f["owner"])] if is_open(x["name"]))
    count: dict[str, int] = {}
    for w in re.findall(r"[A-Za-z_]\w*", text):
        count[w] = count.get(w, 0) + 1
    out["unused_imports"] = [n for i in out["imports"] for n in i["names"] if count.get(n, 0) <= 1]
    return out


def go_mask(s: str) -> str:
    out, i = [], 0
    while True:
        m = HARD.search(s, i)
        if m is None:
            out.append(s[i:])
            return "".join(out)
        out.append(s[i : m.start()])
        c = m.group()
        if c == "//":
            end = s.find("\n", m.start())
            end = len(s) if end < 0 else end
        elif c == "/*":
            end = s.find("*/", m.end()) + 2
            if end < 2:
                raise Bad("comment")
        elif c == "`":
            end = s.find("`", m.end()) + 1
            if not end:
                raise Bad("string")
        else:
            e = (STRING if c == '"' else RUNE).match(s, m.start())
            if e is None:
                raise Bad("string")
            end = e.end()
        out.append(re.sub(r"[^\n]", " ", s[m.start() : end]))
        i = end


GO_FUNC = re.compile(r"^func\b[ \t]*(?:\(([^()\n]*)\)[ \t]*)?([^\W\d]\w*)\s*(?:\[[^\]]*\])?\s*\(", re.M)
GO_TYPE = re.compile(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\s*\{", re.M)
GO_CALL = re.compile(r"(?<![\w.])((?:\w+\.)*)(\w+)\(")
GO_NO_CALL = set("if for switch select func return go defer range append len cap make new panic recover copy delete close print println complex real imag string int byte rune float64".split())
GO_DECISION = re.compile(r"\b(?:if|for|case)\b|&&|\|\|")
GO_SHAPES = {"if": "IF", "for": "FOR", "switch": "SWITCH", "select": "SWITCH", "return": "RET", "panic": "THROW"}


def go_facts(text: str) -> dict:
    """Structs and interfaces as classes, receivers' functions as methods; capital letters export."""
    s = text.replace("\r\n", "\n")
    masked = go_mask(s)
    line_of = lambda at: masked.count("\n", 0, at) + 1
    out = {k: [] for k in EMPTY}
    by_name = {}
    for m in GO_TYPE.finditer(masked):
        body = masked[m.end() : balanced(masked, m.end() - 1) - 1]
        lines = [x.strip() for x in re.split(r"[\n;]", body) if x.strip()]
        embedded = [x.lstrip("*").split(".")[-1] for x in lines if re.fullmatch(r"\*?[\w.]+", x)]
        fields = [n for x in lines for n in re.findall(r"\w+", x.split(" ")[0])] if m.group(2) == "struct" else []
        methods = re.findall(r"^\s*(\w+)\s*\(", body, re.M) if m.group(2) == "interface" else []
        by_name[m.group(1)] = row = {"name": m.group(1), "extends": embedded[0] if embedded else None, "line": line_of(m.start(1)), "methods": methods, "properties": [f for f in fields if f not in embedded], "calls": [], "exported": m.group(1)[:1].isupper(), "has_doc": False}
        out["classes"].append(row)
    for m in GO_FUNC.finditer(masked):
        end = balanced(masked, m.end() - 1)
        params = [re.match(r"\w*", p).group() if not re.search(r"\.\.\.", p) else "..." + re.match(r"\w*", p).group() for p in split_top(masked[m.end() : end - 1])]
        brace = masked.find("{", end)
        stop = balanced(masked, brace) if brace >= 0 else end
        body = masked[brace:stop] if brace >= 0 else ""
        owner = re.findall(r"(\w+)\s*(?:\[[^\]]*\])?\s*$", m.group(1))[0] if m.group(1) and m.group(1).strip() else None
        calls = {}
        for c in GO_CALL.finditer(body):
            if c.group(1) or c.group(2) not in GO_NO_CALL:
                first = [x for x in c.group(1).split(".") if x]
                calls.setdefault(f"{first[-1]}.{c.group(2)}" if first else c.group(2))
        line = line_of(m.start(2))
        before = s[: m.start()].rstrip(" \t")
        out["functions"].append(function_row(
            name=m.group(2), owner=owner, line=line, n_lines=line_of(stop - 1) - line + 1, params=params, exported=m.group(2)[:1].isupper(), returns=" ".join(masked[end:brace].split()) or None if brace >= 0 else None, calls=list(calls),
            complexity=1 + len(GO_DECISION.findall(body)), structure="|".join(GO_SHAPES[w] for w in re.findall(r"\b(if|for|switch|select|return|panic)\b", body)),
            has_doc=bool(re.search(r"//[^\n]*\n$", before)), has_return=bool(re.search(r"\breturn\s+[^\s;}]", body)), accessor="method" if owner else None,
        ))
        if owner in by_name:
            by_name[owner]["methods"].append(m.group(2))
            by_name[owner]["calls"] = list(dict.fromkeys([*by_name[owner]["calls"], *calls]))
    for m in re.finditer(r"^import\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?\"[^\"]*\")", s, re.M):
        for x in re.finditer(r"([\w.]+\s+)?\"([^\"]*)\"", m.group()):
            alias = (x.group(1) or "").replace("import", "").strip()
            out["imports"].append({"source": x.group(2), "names": [alias or x.group(2).split("/")[-1]], "line": line_of(m.start() + x.start())})
    out["exports"] = sorted({x["name"] for x in [*out["classes"], *(f for f in out["functions"] if not f["owner"])] if x["exported"]})
    return out


DDL = re.compile(r"\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"`\[\]]+)\s*\(", re.I)
CONSTRAINT = {"primary", "foreign", "unique", "check", "constraint", "key", "index", "exclude", "like"}


def sql_tables(text: str) -> list[dict]:
    """Tables and columns of CREATE TABLE statements; constraints are no columns."""
    s = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)
    s = re.sub(r"--[^\n]*", lambda m: " " * len(m.group()), s)
    out = []
    for m in DDL.finditer(s):
        end = balanced(s, m.end() - 1)
        if s[end - 1 : end] != ")":
            continue
        columns = []
        for part in split_top(s[m.end() : end - 1]):
            w = re.match(r"([\w\"`\[\]]+)\s+(\w+(?:\s*\([^)]*\))?)", part)
            if w and w.group(1).strip('"`[]').lower() not in CONSTRAINT:
                columns.append({"name": w.group(1).strip('"`[]'), "type": re.sub(r"\s+", "", w.group(2))})
        out.append({"name": m.group(1).split(".")[-1].strip('"`[]'), "line": s.count("\n", 0, m.start()) + 1, "columns": columns})
    return out
