"""Rewriting source texts: smaller, laid out again, edited, with and without documentation. Pure functions of a text; see operators.docs for frames."""

from __future__ import annotations

import re

from codelode.extract.ecma_facts import balanced, facts, split_top
from codelode.syntax import ecma
from codelode.syntax.groups import Bad

WORD = re.compile(r"[\w$]")
KEEP_LINE = re.compile(r"(?:[;{(\[,]|[^+\-]\+|[^+\-]-|[*%&|^<>=?:!~])$")


def _mask(text: str, jsx: bool = False) -> tuple[str, str, list[tuple[int, int]]]:
    lexer = ecma.Lexer(text.replace("\r\n", "\n"), jsx)
    masked = lexer.run()
    return lexer.s, masked, lexer.comments


def _pieces(source: str, masked: str, comments: list[tuple[int, int]]) -> list[tuple[str, str]]:
    """(kind, text): code, literal or comment, in order. Literals are what the lexer has masked."""
    out, i, n = [], 0, len(source)
    starts = dict(comments)
    marks = (ecma.STR, ecma.TPL, ecma.REGEX, ecma.JSX)
    while i < n:
        if i in starts:
            out.append(("comment", source[i : starts[i]]))
            i = starts[i]
        elif masked[i] in marks:
            j = i + 1
            depth = 0
            while j < n and (depth or masked[j] in " " + ecma.OPEN_X + ecma.CLOSE_X and not (masked[j] == " " and source[j] == " " and not _inside(source, masked, i, j))):
                depth += {ecma.OPEN_X: 1, ecma.CLOSE_X: -1}.get(masked[j], 0)
                j += 1
            out.append(("literal", source[i:j]))
            i = j
        else:
            j = i + 1
            while j < n and j not in starts and masked[j] not in marks:
                j += 1
            out.append(("code", source[i:j]))
            i = j
    return out


def _inside(source: str, masked: str, start: int, at: int) -> bool:
    """Whether a blank at ``at`` still belongs to the literal begun at ``start``."""
    mark, first = masked[start], source[start]
    if mark == ecma.STR:
        m = ecma.STRINGS[first].match(source, start)
        return m is not None and at < m.end()
    if mark == ecma.REGEX:
        m = ecma.REGEXP.match(source, start)
        return m is not None and at < m.end()
    out: list[str] = []
    lexer = ecma.Lexer(source, True)
    lexer.s = source
    try:
        end = lexer.template(start + 1, out) if mark == ecma.TPL else lexer.element(start, out)
    except Bad:
        return False
    return at < end


def minify(text: str, jsx: bool = False) -> str:
    """Without comments and needless white space. Names stay; line ends stay where an automatic semicolon may stand."""
    source, masked, comments = _mask(text, jsx)
    out: list[str] = []

    def add(x: str) -> None:
        if not x:
            return
        last = out[-1][-1] if out else ""
        if last and (WORD.match(last) and WORD.match(x[0]) or last in "+-" and x[0] == last):
            out.append(" ")
        out.append(x)

    gap = ""
    for kind, piece in _pieces(source, masked, comments):
        if kind == "comment":
            gap += "\n" if "\n" in piece else " "
            continue
        for part in [piece] if kind == "literal" else re.split(r"(\s+)", piece):
            if not part:
                continue
            if kind == "code" and part.isspace():
                gap += part
                continue
            if "\n" in gap and out and not (out[-1][-1] in ";{([,:?=&|<>*%^!~.") and part[0] not in ")].,;:?=&|<>*%^}":
                out.append("\n")
                out.append(part)
            else:
                before = len(out)
                add(part)
                if gap and before and len(out) == before + 1 and WORD.match(out[before - 1][-1]) and WORD.match(part[0]):
                    out.insert(before, " ")
            gap = ""
    return "".join(out).strip()


def beautify(text: str, jsx: bool = False, indent: str = "  ") -> str:
    """One statement a line, indented by braces. Literals and comments stay as they are."""
    source, masked, comments = _mask(text, jsx)
    out, line, depth, parens = [], "", 0, 0

    def flush() -> None:
        nonlocal line
        if line.strip():
            close = len(re.match(r"[})\]]*", line.strip()).group())
            out.append(indent * max(0, depth - (1 if close and line.strip()[0] == "}" else 0)) + line.strip())
        line = ""

    for kind, piece in _pieces(source, masked, comments):
        if kind != "code":
            if kind == "comment":
                if piece.startswith("//"):
                    line += (" " if line.strip() else "") + piece
                    flush()
                elif "\n" in piece:
                    flush()
                    out.extend(indent * depth + (" " if k else "") + x.strip() for k, x in enumerate(piece.split("\n")))
                else:
                    line += piece + " "
                continue
            line += piece
            continue
        for c in piece:
            if c == "\n":
                if not parens and line.strip() and not KEEP_LINE.search(line.strip()):
                    flush()
                elif line and not line.endswith(" "):
                    line += " "
            elif c in "([":
                parens += 1
                line += c
            elif c in ")]":
                parens -= 1
                line += c
            elif c == "{" and not parens:
                line += c
                flush()
                depth += 1
            elif c == "}" and not parens:
                flush()
                depth -= 1
                line = "}"
            elif c == ";" and not parens:
                line += c
                flush()
            elif c in " \t":
                if line and not line.endswith(" "):
                    line += " "
            else:
                if line == "}" and c not in ",;.)":
                    rest = c
                    if not rest.isalpha():
                        flush()
                        line = ""
                    else:
                        line += " "
                line += c
    flush()
    return "\n".join(out) + ("\n" if out else "")


def top_level(text: str, jsx: bool = False) -> list[str]:
    """The declarations and statements of a text at its top level."""
    source, masked, _ = _mask(text, jsx)
    out, at, i, n = [], 0, 0, len(masked)
    while i < n:
        c = masked[i]
        if c in "([{":
            i = balanced(masked, i)
            after = masked[i:].lstrip()
            if c == "{" and not re.match(r"[,;.)=\[(]|from\b|else\b|catch\b|finally\b|while\b", after) and not re.search(r"=\s*$|=>\s*$", masked[at : i].split("{")[0]) or c == "{" and "\n" in masked[i : i + 1]:
                out.append(source[at:i])
                at = i
            continue
        if c == ";" or c == "\n" and masked[at:i].strip() and not KEEP_LINE.search(masked[at:i].rstrip()) and not re.match(r"\s*(?:[.?:*/&|)\]}=]|[+\-](?![+\-]))", masked[i:]):
            out.append(source[at : i + 1])
            at = i + 1
        i += 1
    out.append(source[at:])
    return [x.strip() for x in out if x.strip().strip(";")]


def is_single_line(text: str) -> bool:
    """Whether several declarations stand on one line."""
    try:
        return len([x for x in text.split("\n") if x.strip()]) == 1 and len(top_level(text)) > 1
    except Bad:
        return False


def edit(text: str, symbol: str, replacement: str, grammar: str = "js") -> tuple[str, str | None]:
    """(new text, error): the declaration of a top-level function, class or constant replaced. The text stays as it is if the result does not parse."""
    try:
        parts = top_level(text, grammar == "tsx")
    except Bad:
        return text, "the text does not parse"
    name = re.escape(symbol)
    own = re.compile(rf"^(?:/\*.*?\*/\s*|//[^\n]*\n\s*)*(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function\s*\*?|(?:abstract\s+)?class|const|let|var)\s+{name}(?![\w$])", re.S)
    hits = [p for p in parts if own.match(p)]
    if not hits:
        return text, f"no symbol {symbol}"
    changed = text.replace("\r\n", "\n").replace(hits[0], replacement, 1)
    return (changed, None) if ecma.Grammar(grammar).check(changed) else (text, "the replacement does not parse")


def strip_docs(text: str, jsx: bool = False) -> tuple[str, int]:
    """(text without documentation blocks, how many there were). What looks like one in a string stays."""
    source, _, comments = _mask(text, jsx)
    docs = [(a, b) for a, b in comments if source.startswith("/**", a)]
    out, at = [], 0
    for a, b in docs:
        line = source.rfind("\n", 0, a) + 1
        start = line if not source[line:a].strip() else a
        end = b + 1 if source[b : b + 1] == "\n" and start == line else b
        out.append(source[at:start])
        at = end
    return "".join(out) + source[at:], len(docs)


def doc_template(function: dict) -> str:
    """A documentation block to fill in for a function's facts."""
    lines = [f" * {function['name']}"]
    for p in function["params"]:
        name = re.match(r"(?:\.\.\.)?([\w$]+)", p).group(1)
        kind = p.split(":", 1)[1].rstrip("=") if ":" in p else "*"
        default = p.endswith("=")
        lines.append(f" * @param {{{('...' if p.startswith('...') else '') + kind}}} {'[' + name + ']' if default else name}")
    if function["has_return"]:
        lines.append(f" * @returns {{{'Promise<*>' if function['is_async'] else '*'}}}")
    return "\n".join(["/**", *lines, " */"])


def inject_docs(text: str, docs: dict[str, str], typescript: bool = False, jsx: bool = False) -> tuple[str, int]:
    """(text with documentation blocks, how many were put in) above functions named in ``docs`` that have none."""
    own = [f for f in facts(text, typescript, jsx)["functions"] if f["name"] in docs and not f["has_doc"]]
    lines = text.replace("\r\n", "\n").split("\n")
    for f in sorted(own, key=lambda f: -f["line"]):
        pad = re.match(r"\s*", lines[f["line"] - 1]).group()
        block = docs[f["name"]] if docs[f["name"]].startswith("/**") else "/** " + docs[f["name"]] + " */"
        lines[f["line"] - 1 : f["line"] - 1] = [pad + x for x in block.split("\n")]
    return "\n".join(lines), len(own)


def legend(text: str, typescript: bool = False, jsx: bool = False) -> str:
    """Exported signatures with the first sentence of their documentation, at most 80 characters of it."""
    x = facts(text, typescript, jsx)
    source, _, comments = _mask(text, jsx)
    first = {}
    for a, b in comments:
        if source.startswith("/**", a):
            words = " ".join(re.sub(r"^\s*\*+ ?", "", line) for line in source[a + 3 : b - 2].split("\n")).split("@")[0]
            first[source.count("\n", 0, b) + 1] = re.split(r"(?<=[.!?])\s", " ".join(words.split()))[0][:80]
    out = []
    for f in x["functions"]:
        if f["exported"]:
            doc = next((d for end, d in sorted(first.items()) if 0 <= f["line"] - end <= 2), "")
            out.append(f"{f['name']}({','.join(f['params'])})" + (f" - {doc}" if doc else ""))
    return "\n".join(out)


def ctx_params(params: str) -> list[tuple[str, str | None]]:
    """(name, type) of the parameters of a context line; commas in brackets do not part."""
    return [(m.group(1), m.group(2)) for m in (re.match(r"(?:\.\.\.)?([\w$]+)=?\??(?::\s*(.+?)=?)?$", p) for p in split_top(params)) if m]
