"""Functions paired with their documentation, by island grammars.

Of each file only the islands are parsed: documentation, decorators, signatures and balanced bodies. All else is water: strings,
comments and texts are masked first, so that nothing in them is taken for code.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.parsing import GRAMMAR_OF, _made
from codelode.syntax import ecma

PAIRS = "file_id long, func_name string, line_no int, signature string, body string, doc string, useful boolean, version timestamp"
NAME = r"[A-Za-z_$][\w$]*"
WORD = re.compile(r"[^\W_]+")
NAME_RUN = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z0-9]+|[^\W_]+")
#: documentation that only says that documentation is still to come
TO_COME = re.compile(
    r"""^\W*(?:(?:todo|fixme|tbd|tba|xxx|wip)\b\W*(?:$|(?:please\s+|must\s+|should\s+|needs?\s+to\s+)?(?:add|write|document|describe|explain|fill|complete|doc|docs|documentation|description|comment|comments)\b)
    |(?:description|documentation|docs?|docstring|comment|text|details|explanation|summary)\s+(?:(?:is|are|will|still|not|yet|be|for|this|function|method)\s+)*
      (?:pending\b|tbd\b|todo\b|to\s+come\b|to\s+follow\b|follows?\s+(?:later|soon)\b|to\s+be\s+(?:added|written|done|provided|completed|filled|supplied|documented|described)\b|coming\s+(?:soon|later)\b|written\s+(?:yet|later)\b)
    |(?:description|documentation|docs?|docstring)\s+(?:(?:is|are|still|goes|needed|wanted)\s+)*(?:missing|here|needed|wanted|later|soon)\b
    |(?:to\s+be\s+(?:documented|written|described|done|added|completed|explained)|not\s+(?:yet\s+)?documented|undocumented|no\s+(?:documentation|description|docs)\b|(?:needs|add|write|missing|insert|put|your)\s+(?:a\s+|some\s+|the\s+|more\s+|proper\s+|your\s+)?(?:documentation|description|docs?|docstring|comment)|placeholder|coming\s+soon|document\s+(?:me|this)|describe\s+(?:me|this)|write\s+(?:me|something)|lorem\s+ipsum))""",
    re.I | re.X,
)


def name_words(name: str) -> set[str]:
    """The words of a name, split at case and underscore."""
    return {w.lower() for part in name.split("_") for w in NAME_RUN.findall(part)}


def useful(doc: str, name: str) -> bool:
    """Whether documentation is more than trivial."""
    lines = [x for x in (line.strip() for line in doc.split("\n")) if not x.startswith(("@", ":"))]
    own = name_words(name)
    if sum(w.lower() not in own for x in lines for w in WORD.findall(x)) < 4:
        return False
    return not to_come("\n".join(lines))


def to_come(text: str) -> bool:
    return bool(TO_COME.match(text))


class Lines:
    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer(r"\r\n|\r|\n", text)]

    def of(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)


BRACKET = re.compile(r"[()\[\]{}]")
ENDS = re.compile(r"[()\[\]{};\n]")
GOES_ON = re.compile(r"\s*[.?:+\-*/&|]")
BLANKS = re.compile(r"[ \t\\]*")
LINE_BEGIN = re.compile(r"^([ \t]*)\S", re.M)


def balanced(s: str, at: int) -> int:
    """Just behind the bracket that closes the one at ``at``; the length of s if none does."""
    depth = 0
    for m in BRACKET.finditer(s, at):
        depth += 1 if m.group() in "([{" else -1
        if not depth:
            return m.end()
    return len(s)


# ---- JavaScript and TypeScript ----
SPACE = re.compile(r"\s*")
DECORATOR = re.compile(rf"@\s*{NAME}(?:\s*\.\s*{NAME})*")
FUNCTION = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\b\s*\*?\s*({NAME})")
CONSTANT = re.compile(rf"(?:export\s+)?const\s+({NAME})\s*(?=[=:])")
METHOD = re.compile(rf"(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract|accessor)\s+(?=[\w$#*\[]))*\*?\s*#?({NAME})\s*[?!]?\s*(?=[(<])")
NO_METHOD = {"if", "for", "while", "switch", "catch", "with", "function", "return", "new", "typeof", "await", "super", "import", "throw", "delete", "void", "yield"}


def block_text(comment: str) -> str:
    """The text of a /** */ block."""
    lines = comment[3:-2].split("\n")
    return "\n".join(re.sub(r"^\s*\**\s?", "", x).rstrip() for x in lines).strip()


def skip_type(s: str, at: int, ends: str) -> int:
    """From a type annotation's colon to the first of the ends outside of brackets; => belongs to the type unless it is an end."""
    i, angle = at, 0
    while i < len(s):
        c = s[i]
        if c in "([{":
            if c == "{" and "{" in ends and not angle and s[at:i].strip(": \n\t") and s[:i].rstrip()[-1] not in "|&:,<=?" and not s[:i].rstrip().endswith("=>"):
                return i
            i = balanced(s, i)
            continue
        if s.startswith("=>", i):
            if "=>" == ends:
                return i
            i += 2
            continue
        if c == "<":
            angle += 1
        elif c == ">":
            angle = max(0, angle - 1)
        elif not angle and c in ends and ends != "=>":
            return i
        elif c == ";" or c == "}":
            return i
        i += 1
    return i


def type_params(s: str, i: int) -> int:
    if s.startswith("<", i):
        depth = 0
        while i < len(s):
            if s.startswith("=>", i):
                i += 2
                continue
            depth += {"<": 1, ">": -1}.get(s[i], 0)
            i += 1
            if not depth:
                break
        i = SPACE.match(s, i).end()
    return i


def ecma_declaration(s: str, i: int, ts: bool) -> tuple[str, int, int, int] | None:
    """(name, where the name is, end of the signature, end of the body) of the function declared at i of the masked text."""
    space = lambda k: SPACE.match(s, k).end()
    m = FUNCTION.match(s, i)
    if m:
        k = type_params(s, space(m.end()))
        if not s.startswith("(", k):
            return None
        k = space(balanced(s, k))
        if s.startswith(":", k) and ts:
            k = skip_type(s, k + 1, "{;")
        return (m.group(1), m.start(1), k, balanced(s, k)) if s.startswith("{", k) else None
    m = CONSTANT.match(s, i)
    if m:
        k = m.end()
        if s[k] == ":":
            k = skip_type(s, k + 1, "=")
        if not s.startswith("=", k):
            return None
        k = space(k + 1)
        a = re.compile(r"async\b(?!\s*=>)\s*").match(s, k)
        k = a.end() if a else k
        f = re.compile(rf"function\b\s*\*?\s*(?:{NAME})?\s*").match(s, k)
        if f:
            k = type_params(s, f.end())
            k = space(balanced(s, k))
            if s.startswith(":", k) and ts:
                k = skip_type(s, k + 1, "{;")
            return m.group(1), m.start(1), k, balanced(s, k)
        k = type_params(s, k)
        n = re.compile(NAME).match(s, k)
        if n:
            k = space(n.end())
        elif s.startswith("(", k):
            k = space(balanced(s, k))
            if s.startswith(":", k) and ts:
                k = skip_type(s, k + 1, "=>")
        else:
            return None
        if not s.startswith("=>", k):
            return None
        k = space(k + 2)
        if s.startswith("{", k):
            return m.group(1), m.start(1), k, balanced(s, k)
        e = k
        for b in ENDS.finditer(s, k):
            c = b.start()
            if c < e:
                continue
            if s[c] in "([{":
                e = balanced(s, c)
            elif s[c] in ";)]}" or s[c] == "\n" and not GOES_ON.match(s, c):
                e = c
                break
            else:
                e = c + 1
        return m.group(1), m.start(1), k, max(e, k)
    m = METHOD.match(s, i)
    if m and m.group(1) not in NO_METHOD:
        k = type_params(s, m.end())
        if not s.startswith("(", k):
            return None
        k = space(balanced(s, k))
        if s.startswith(":", k) and ts:
            k = skip_type(s, k + 1, "{;")
        if s.startswith("{", k):
            return m.group(1), m.start(1), k, balanced(s, k)
    return None


def ecma_pairs(text: str, masked: str, comments: list[tuple[int, int]], ts: bool) -> Iterator[tuple[str, int, int, int, int, str]]:
    """(name, its place, signature's begin and end, body's end, documentation)."""
    for n, (a, b) in enumerate(comments):
        if not text.startswith("/**", a) or text.startswith("/**/", a):
            continue
        stop = comments[n + 1][0] if n + 1 < len(comments) else len(text)
        i = SPACE.match(masked, b).end()
        while masked.startswith("@", i):
            m = DECORATOR.match(masked, i)
            if not m:
                break
            i = SPACE.match(masked, m.end()).end()
            if masked.startswith("(", i):
                i = SPACE.match(masked, balanced(masked, i)).end()
        if i > stop and any(a2 < i for a2, _ in comments[n + 1 : n + 2]):
            continue  # another comment stands between
        d = ecma_declaration(masked, i, ts)
        if d:
            name, at, sig, end = d
            yield name, at, i, sig, end, block_text(text[a:b])


# ---- Python ----
PY_HARD = re.compile(r"""(?P<p>\b[rRuUbBfF]{1,2})?(?P<q>\"\"\"|'''|"|')|\#[^\n]*""")
PY_END = {q: re.compile(rf"(?:[^\\{q[0]}]|\\.|{q[0]}(?!{q[0]}{q[0]}))*{q}" if len(q) == 3 else rf"(?:[^\\{q}\n]|\\.)*{q}", re.S) for q in ('"""', "'''", '"', "'")}
PY_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+([^\W\d]\w*)[ \t]*(?=[(\[])", re.M)
PY_BEFORE_DOC = re.compile(r"(?:[ \t\f]*\n)*[ \t\f]*")


def py_mask(text: str) -> tuple[str, dict[int, int]]:
    """The text with blanks for comments and strings, and where each string begins and ends."""
    out, strings, i = [], {}, 0
    while True:
        m = PY_HARD.search(text, i)
        if m is None:
            out.append(text[i:])
            return "".join(out), strings
        out.append(text[i : m.start()])
        if m.group("q"):
            e = PY_END[m.group("q")].match(text, m.end())
            end = e.end() if e else len(text)
            strings[m.start()] = end
            out.append('"' + " " * (end - m.start() - 1))
        else:
            end = m.end()
            out.append(" " * (end - m.start()))
        i = end


def py_pairs(text: str) -> Iterator[tuple[str, int, int, int, int, str]]:
    masked, strings = py_mask(text)
    for m in PY_DEF.finditer(masked):
        k = m.end()
        if masked[k] == "[":
            k = SPACE.match(masked, balanced(masked, k)).end()
        k = balanced(masked, k)
        while k < len(masked) and masked[k] != ":":
            k = balanced(masked, k) if masked[k] in "([{" else k + 1
        i = PY_BEFORE_DOC.match(masked, k + 1).end()
        doc, first = "", i
        while i in strings:
            literal = text[i : strings[i]]
            if re.match(r"[rRuU]*['\"]", literal) is None:
                doc = ""
                break
            doc += literal_text(literal)
            i = strings[i]
            i = BLANKS.match(masked, i).end()
        if i == first or i < len(masked) and masked[i] not in "\n;" or not doc:
            continue
        lines = doc.split("\n")
        margin = min((len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()), default=0)
        doc = "\n".join([lines[0].strip()] + [x[margin:].rstrip() for x in lines[1:]]).strip()
        indent = len(m.group(1).expandtabs())
        end = len(text)
        for line in LINE_BEGIN.finditer(masked, masked.find("\n", k) + 1 or len(masked)):
            if len(line.group(1).expandtabs()) <= indent:
                end = line.start()
                break
        yield m.group(2), m.start(2), m.start(), k + 1, end, doc


def literal_text(literal: str) -> str:
    try:
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.literal_eval(literal)
    except (SyntaxError, ValueError):
        return literal.strip("rRuU").strip("'\"")


# ---- Go ----
GO_HARD = re.compile(r"""["'`]|//[^\n]*|/\*""")
GO_STRING = {'"': re.compile(r'"(?:[^"\\\n]|\\.)*"'), "'": re.compile(r"'(?:[^'\\\n]|\\.)+'"), "`": re.compile(r"`[^`]*`")}
GO_FUNC = re.compile(r"^func\b[ \t]*(\([^()\n]*\)[ \t]*)?([^\W\d]\w*)\s*(?=[(\[])", re.M)


def go_pairs(text: str) -> Iterator[tuple[str, int, int, int, int, str]]:
    out, line_comments, i = [], {}, 0
    while True:
        m = GO_HARD.search(text, i)
        if m is None:
            out.append(text[i:])
            break
        out.append(text[i : m.start()])
        c = m.group()
        if c.startswith("//"):
            end = m.end()
            line_comments[m.start()] = end
        elif c == "/*":
            end = text.find("*/", m.end()) + 2 or len(text)
        else:
            e = GO_STRING[c].match(text, m.start())
            end = e.end() if e else m.end()
        out.append(re.sub(r"[^\n]", " ", text[m.start() : end]))
        i = end
    masked = "".join(out)
    for m in GO_FUNC.finditer(masked):
        doc, at = [], m.start()
        while at:
            begin = text.rfind("\n", 0, at - 1) + 1
            first = begin + len(text[begin:at]) - len(text[begin:at].lstrip(" \t"))
            if first not in line_comments:
                break
            doc.append(text[first + 2 : at].strip("\r\n").strip())
            at = begin
        if not doc:
            continue
        k = m.end()
        if masked[k] == "[":
            k = SPACE.match(masked, balanced(masked, k)).end()
        k = balanced(masked, k)
        brace = re.compile(r"[^\n{]*(?:(?:interface|struct)\s*\{[^{}]*\}[^\n{]*)*").match(masked, k).end()
        end = balanced(masked, brace) if masked.startswith("{", brace) else brace
        yield m.group(2), m.start(2), m.start(), brace, end, "\n".join(reversed(doc))


def pairs_of(grammar: str, text: str, parser) -> Iterator[tuple[str, int, int, int, int, str]]:
    if grammar in ("js", "ts", "tsx"):
        yield from ecma_pairs(parser.lexer.s, parser.masked, parser.lexer.comments, grammar != "js")
    elif grammar in ("py", "go"):
        yield from (py_pairs if grammar == "py" else go_pairs)(text)


def normal(text: str) -> str:
    """Line ends as \\n; a byte order mark counts for nothing."""
    return text.removeprefix(ecma.BOM).replace("\r\n", "\n").replace("\r", "\n")


def documented_functions(files: DataFrame, keep_trivial: bool = False) -> DataFrame:
    """A row for each function with documentation in the files that parse: PAIRS; ``useful`` says whether it is not trivial.

    files(file_id, repo, ext, raw, version), as for parse_files, with the same rules for nulls and repeated rows.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammars = _made
        for pdf in batches:
            out = []
            for f, ext, raw, v in pdf.itertuples(index=False, name=None):
                own = GRAMMAR_OF[ext]
                text = normal(raw)
                if not text.strip() or grammars[own].check(text) is False:
                    continue
                lines = None
                for name, at, a, sig, end, doc in pairs_of(own, text, grammars[own]):
                    good = useful(doc, name)
                    if good or keep_trivial:
                        lines = lines or Lines(text)
                        out.append((f, name, lines.of(at), text[a:sig].strip(), text[sig:end].strip(), doc, good, v))
            yield pd.DataFrame(out, columns=["file_id", "func_name", "line_no", "signature", "body", "doc", "useful", "version"])

    rows = files.select("file_id", F.lower("ext").alias("ext"), "raw", "version")
    ext = [e for e, g in GRAMMAR_OF.items() if g != "sql"]
    return rows.where(F.col("file_id").isNotNull() & F.col("raw").isNotNull() & F.col("ext").isin(*ext)).mapInPandas(extract, PAIRS)
