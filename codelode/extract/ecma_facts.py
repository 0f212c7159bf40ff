"""Classes, functions, imports, exports, calls and findings of JavaScript and TypeScript files, from the masked text."""

from __future__ import annotations

import bisect
import re

from codelode.syntax import ecma
from codelode.syntax.groups import Bad

NAME = r"[A-Za-z_$][\w$]*"
BRACKET = re.compile(r"[()\[\]{}]")
FUNCTION = re.compile(rf"(?<![\w$.])((?:export\s+)?(?:default\s+)?)((?:async\s+)?)function\b\s*\*?\s*({NAME})\s*(?:<[^>(]*>)?\s*\(")
CLASS = re.compile(rf"(?<![\w$.])((?:export\s+)?(?:default\s+)?)(?:abstract\s+)?class\s+({NAME})\s*(?:<[^{{]*?>)?\s*(?:extends\s+([\w$.]+)[^{{]*?)?(?:implements\s+[^{{]*?)?\{{")
METHOD = re.compile(rf"((?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*)\*?\s*(#?{NAME})\s*(?:<[^>(]*>)?\s*\(")
PROPERTY = re.compile(rf"(?:(?:static|public|private|protected|readonly|declare|override)\s+)*(#?{NAME})\s*[?!]?\s*(?::[^=;\n]*)?(?:=(?!=|>)|;|\n)")
CALL = re.compile(rf"(?<![\w$#])((?:new\s+)?)((?:{NAME}\s*\??\.\s*)*)(#?{NAME})\s*(?:\?\.\s*)?\(")
IMPORT = re.compile(rf"(?<![\w$.])import\s*(?:type\s+)?((?:{NAME}\s*,?\s*)?(?:\*\s*as\s+{NAME}|\{{[^}}]*\}})?)\s*(?:from)?\s*(?={ecma.STR})")
EXPORT_NAMES = re.compile(r"(?<![\w$.])export\s*\{([^}]*)\}")
EXPORT_DECL = re.compile(rf"(?<![\w$.])export\s+(?:default\s+)?(?:(?:async\s+)?function\s*\*?|(?:abstract\s+)?class|const|let|var|interface|type|enum)\s+({NAME})")
NAMED_EXPORT = re.compile(rf"(?<![\w$.])export\s+((?:async\s+)?function\s*\*?|(?:abstract\s+)?class|const\s+enum|const|let|var|interface|type|enum)\s+({NAME})")
BARE_NEW = re.compile(rf"(?<![\w$.])new\s+({NAME})(?!\s*[\w$.])")
NO_CALL = {"if", "for", "while", "switch", "catch", "with", "function", "return", "typeof", "await", "super", "import", "void", "delete", "throw", "new", "do", "else", "in", "of", "instanceof", "case", "yield", "constructor"}
DECISION = re.compile(r"(?<![\w$.])(?:if|for|while|case|catch)(?![\w$])|&&(?!=)|\|\|(?!=)|\?(?![.?:)\],=])(?<!\?\?)")
SHAPE = re.compile(r"(?<![\w$.])(if|for|while|switch|try|return|throw|await)(?![\w$])")
SHAPES = {"if": "IF", "while": "WHILE", "switch": "SWITCH", "try": "TRY", "return": "RET", "throw": "THROW", "await": "AWAIT"}
IS_SQL = re.compile(r"^\s*(SELECT|INSERT|UPDATE|DELETE|WITH|CREATE\s+TABLE)\b", re.I)
SQL_TAG = re.compile(r"[\w$]*sql[\w$]*\s*$", re.I)
ESCAPED = re.compile(r"\\(?:\r?\n|(.))", re.S)
LETTER = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
# ---- fixed values: names of rules; the patterns are those of this library ----
#: outdated patterns: (id, severity, pattern on the masked text)
OUTDATED = [
    ("var-usage", "warning", re.compile(r"(?<![\w$.])var\s")), ("require-usage", "info", re.compile(r"(?<![\w$.])require\s*\(")), ("module-exports", "info", re.compile(r"(?<![\w$.])module\s*\.\s*exports\s*=(?!=)")),
    ("buffer-constructor", "error", re.compile(r"(?<![\w$.])new\s+Buffer\s*\(")), ("arguments-usage", "warning", re.compile(r"(?<![\w$.])arguments(?![\w$:])")),
    ("promisify-usage", "info", re.compile(r"(?<![\w$.])util\s*\.\s*promisify\s*\(")), ("sync-in-async", "warning", re.compile(r"\.\s*[\w$]*Sync\s*\(")),
]


def balanced(s: str, at: int) -> int:
    depth = 0
    for m in BRACKET.finditer(s, at):
        depth += 1 if m.group() in "([{" else -1
        if not depth:
            return m.end()
    return len(s)


def split_top(s: str, sep: str = ",") -> list[str]:
    """Parts at separators outside of brackets."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(s):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and s[k - 1 : k] != "=":
            depth -= 1
        elif c == sep and depth <= 0:
            out.append(s[at:k])
            at = k + 1
    out.append(s[at:])
    return [x.strip() for x in out if x.strip()]


def parameter(p: str) -> str:
    """The short form of a parameter: name, name=, ...name, options for a pattern; a type goes behind a colon."""
    p = re.sub(r"^(?:(?:public|private|protected|readonly|override)\s+)+", "", p.strip())
    rest = p.startswith("...")
    p = p[3:].strip() if rest else p
    default = bool(re.search(r"=(?!>)", re.sub(r"\([^()]*\)\s*=>", "", p)))
    name = "options" if p[:1] in "{[" else (re.match(NAME, p) or re.match(r"", p)).group()
    kind = ""
    m = re.match(rf"{NAME}\??\s*:\s*([^=]+)", p)
    if m and p[:1] not in "{[":
        kind = ":" + m.group(1).strip()
    return ("..." if rest else "") + name + kind + ("=" if default else "")


def calls_in(body: str, most: int | None = None) -> list[str]:
    """Names called, in order: a.b() is a.b, x.y.b() is y.b, this.b() is b; constructors are not calls."""
    out = {}
    for m in CALL.finditer(body):
        if m.group(1) or m.group(3) in NO_CALL and not m.group(2):
            continue
        owner = [x for x in re.split(r"\s*\??\.\s*", m.group(2)) if x]
        out.setdefault(f"{owner[-1]}.{m.group(3)}" if owner and owner[-1] not in ("this", "super") else m.group(3))
    return list(out)


def uses_in(s: str, defined: set[int]) -> list[str]:
    """Names that a text calls, makes with new, whose members it calls, or that it gives as arguments. ``defined``: places of the names of declared functions."""
    out = {}
    for m in CALL.finditer(s):
        if m.start(3) in defined or m.group(3) in NO_CALL and not m.group(2):
            continue
        end = balanced(s, m.end() - 1)
        if not m.group(2) and not m.group(1) and s[end : end + 40].lstrip()[:1] == "{":
            continue  # a method
        owner = [x for x in re.split(r"\s*\??\.\s*", m.group(2)) if x]
        if len(owner) < 2 and not (owner and m.group(1)):
            out.setdefault(owner[0] if owner else m.group(3))
        if not m.group(1):
            out.update(dict.fromkeys(x for x in split_top(s[m.end() : end - 1]) if re.fullmatch(NAME, x)))
    out.update(dict.fromkeys(BARE_NEW.findall(s)))
    return list(out)


def named_exports(s: str) -> list[str]:
    """Names under which a file exports, default ones left out."""
    out = {m.group(2) for m in NAMED_EXPORT.finditer(s)}
    for m in EXPORT_NAMES.finditer(s):
        out.update(re.sub(r"^type\s+", "", x).split(" as ")[-1].strip() for x in split_top(m.group(1)))
    return sorted(x for x in out if x and x != "default")


def imported_names(clause: str) -> list[str]:
    """What an import clause asks the other file for: exported names, and default. A namespace asks for no name."""
    named = re.search(r"\{([^}]*)\}", clause)
    out = [re.sub(r"^type\s+", "", x).split(" as ")[0].strip() for x in split_top(named.group(1))] if named else []
    return out + (["default"] if re.match(NAME, clause.strip()) else [])


def shape_of(body: str) -> str:
    out = []
    for m in SHAPE.finditer(body):
        w = m.group(1)
        if w == "for":
            head = body[m.end() : balanced(body, body.find("(", m.end()))] if "(" in body[m.end() :] else ""
            out.append("FOROF" if re.search(r"\sof\s", head) and ";" not in head else "FORIN" if re.search(r"\sin\s", head) and ";" not in head else "FOR")
        else:
            out.append(SHAPES[w])
    return "|".join(out)


def template_text(source: str, at: int) -> str:
    """The text of the template literal that begins at a backtick; holes become $1, $2 and so on."""
    out, i, holes, n = [], at + 1, 0, len(source)
    while i < n and source[i] != "`":
        if source[i] == "\\":
            out.append(source[i : i + 2])
            i += 2
        elif source.startswith("${", i):
            holes, depth, i = holes + 1, 1, i + 2
            while i < n and depth:
                depth += {"{": 1, "}": -1}.get(source[i], 0)
                i += 1
            out.append(f"${holes}")
        else:
            out.append(source[i])
            i += 1
    return unescape("".join(out))


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: LETTER.get(m.group(1), m.group(1)) if m.group(1) else "", text)


def sql_texts(source: str, begin: int, end: int, masked: str) -> list[str]:
    """Texts that go to a database, of a part of the source: string and template literals that look like SQL, and templates with a tag whose name has sql in it."""
    out = {}
    for m in LITERAL_MARK.finditer(masked, begin, end):
        at = m.start()
        q = source[at]
        if q == "`":
            text, tagged = template_text(source, at), SQL_TAG.search(masked, max(begin, at - 80), at)
        elif q in "'\"":
            found = ecma.STRINGS[q].match(source, at)
            text, tagged = unescape(found.group()[1:-1]) if found else "", None
        else:
            continue
        if text and (tagged or IS_SQL.match(text)):
            out.setdefault(text)
    return list(out)


LITERAL_MARK = re.compile(f"[{ecma.STR}{ecma.TPL}]")


class Doc:
    """Documentation blocks by the line they end on."""

    def __init__(self, text: str, comments: list[tuple[int, int]], line_of):
        self.blocks = [(line_of(b - 1), text[a:b]) for a, b in comments if text.startswith("/**", a)]
        self.ends = [end for end, _ in self.blocks]

    def before(self, line: int, most: int = 2) -> str | None:
        """The block that ends at most so many lines before a line (or on it); the first such."""
        k = bisect.bisect_left(self.ends, line - most)
        return self.blocks[k][1] if k < len(self.blocks) and self.ends[k] <= line else None


def doc_params(block: str) -> list[str]:
    """Names of @param lines: [x] and [x=1] are x, a.b is left out."""
    out = []
    for m in re.finditer(r"@param\s+(?:\{(?:[^{}]|\{[^{}]*\})*\}\s*)?(\[?)([\w$.]+)", block):
        if "." not in m.group(2):
            out.append(m.group(2))
    return out


def facts(text: str, typescript: bool, jsx: bool) -> dict:
    """All facts of a file. Raises Bad if strings, comments or templates are not closed."""
    lexer = ecma.Lexer(text, jsx)
    s = lexer.run()
    source = lexer.s
    starts = [0] + [m.end() for m in re.finditer("\n", source)]
    line_of = lambda at: bisect.bisect_right(starts, at)
    docs = Doc(source, lexer.comments, line_of)
    exports = {m.group(1) for m in EXPORT_DECL.finditer(s)}
    for m in EXPORT_NAMES.finditer(s):
        exports.update(re.sub(r"^type\s+", "", x).split(" as ")[0].strip() for x in split_top(m.group(1)))
    imports = []
    for m in IMPORT.finditer(s):
        at = s.find(ecma.STR, m.end())
        end = re.compile(rf"{ecma.STR} *").match(s, at).end()
        source_name = source[at:end].strip()[1:-1]
        names = [re.sub(r"^type\s+", "", x).split(" as ")[-1].strip() for x in split_top(m.group(1).replace("{", ",").replace("}", "").replace("*", "")) if x.strip()]
        imports.append({"source": source_name, "asked": imported_names(m.group(1)), "names": [n.replace("as ", "").strip() for n in names], "line": line_of(m.start())})

    def function(name, at, paren, is_async, owner, exported):
        end = balanced(s, paren)
        params = [parameter(p) for p in split_top(s[paren + 1 : end - 1])]
        brace = s.find("{", end)
        semi = s.find(";", end)
        if brace < 0 or 0 <= semi < brace and typescript and "{" not in s[end:semi]:
            return None
        returns = None
        if typescript and s[end:brace].strip().startswith(":"):
            returns = " ".join(s[end:brace].strip()[1:].split())
            if not returns:
                brace = s.find("{", balanced(s, brace))
        stop = balanced(s, brace)
        body = s[brace:stop]
        line = line_of(at)
        doc = docs.before(line)
        return {
            "name": name, "owner": owner, "line": line, "n_lines": line_of(stop - 1) - line + 1, "params": params, "is_async": is_async, "exported": exported, "returns": returns, "calls": calls_in(body),
            "complexity": 1 + len(DECISION.findall(body)), "structure": shape_of(body), "has_doc": doc is not None, "doc_params": doc_params(doc) if doc else [],
            "sql": sql_texts(source, brace, stop, s), "doc_returns": bool(doc and re.search(r"@returns?\s", doc)), "has_return": bool(re.search(r"(?<![\w$.])return\s+[^;\s}]", body)), "start": brace, "stop": stop,
        }

    functions, defined = [], set()
    for m in FUNCTION.finditer(s):
        defined.add(m.start(3))
        f = function(m.group(3), m.start(3), m.end() - 1, bool(m.group(2)), None, bool(m.group(1).strip()) or m.group(3) in exports)
        if f:
            functions.append(f)
    classes = []
    for m in CLASS.finditer(s):
        a, b = m.end() - 1, balanced(s, m.end() - 1)
        i, methods, properties, own = a + 1, [], [], []
        while i < b - 1:
            i = re.compile(r"[\s;]*").match(s, i).end()
            if s.startswith("@", i):
                i = re.compile(rf"@\s*[\w$.]+\s*").match(s, i).end()
                if s.startswith("(", i):
                    i = balanced(s, i)
                continue
            k = METHOD.match(s, i)
            if k and k.group(2) not in NO_CALL | {"if"} or k and k.group(2) == "constructor":
                f = function(k.group(2), k.start(2), k.end() - 1, "async" in k.group(1), m.group(2), False)
                if f:
                    accessor = "get" if re.search(r"\bget\b", k.group(1)) else "set" if re.search(r"\bset\b", k.group(1)) else "method"
                    f["accessor"] = "constructor" if k.group(2) == "constructor" else accessor
                    own.append(f)
                    if k.group(2) != "constructor":
                        methods.append(k.group(2))
                    i = f["stop"]
                    continue
                i = balanced(s, k.end() - 1)
                continue
            p = PROPERTY.match(s, i)
            if p:
                properties.append(p.group(1))
            e = i
            while e < b - 1 and s[e] != ";" and not (s[e] == "\n" and e > i and s[i:e].strip()):
                e = balanced(s, e) if s[e] in "([{" else e + 1
            i = max(e, i + 1)
        classes.append({"name": m.group(2), "extends": m.group(3), "line": line_of(m.start(2)), "methods": methods, "properties": properties, "calls": calls_in(s[a:b]), "exported": bool(m.group(1).strip()) or m.group(2) in exports,
                        "has_doc": docs.before(line_of(m.start(2))) is not None})
        functions.extend(own)
    findings = []
    for rule, severity, p in OUTDATED:
        for m in p.finditer(s):
            if rule == "sync-in-async" and not any(f["is_async"] and f["start"] <= m.start() < f["stop"] for f in functions):
                continue
            findings.append({"rule": rule, "severity": severity, "line": line_of(m.start())})
    words = re.findall(NAME, source)
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    unused = [n for i in imports for n in i["names"] if count.get(n, 0) <= 1]
    variables = [m.group(1) for m in re.finditer(rf"^(?:const|let|var)\s+({NAME})", s, re.M)]
    unused_variables = [v for v in variables if count.get(v, 0) <= 1 and not v.startswith("_") and v not in exports]
    for f in functions:
        f.pop("start")
        f.pop("stop")
        f.setdefault("accessor", None)
    return {"functions": functions, "classes": classes, "imports": imports, "exports": sorted(e for e in exports if e), "findings": findings, "unused_imports": unused, "unused_variables": unused_variables, "uses": uses_in(s, defined), "named_exports": named_exports(s)}


__all__ = ["Bad", "balanced", "calls_in", "facts", "parameter", "shape_of", "split_top"]
