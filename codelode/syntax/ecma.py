"""ECMAScript modules and TypeScript, with JSX where asked for."""

from __future__ import annotations

import re

from codelode.syntax.groups import FIRST, Bad, Groups

# ---- tokens: fixed values ----
WORDS = """break case catch class const continue debugger default delete do else enum export extends false finally for function if
import in instanceof new null return super switch this throw true try typeof var void while with yield await async of get set
static let as from type interface namespace module declare abstract public private protected readonly override implements
keyof infer is asserts satisfies unique accessor target meta global require out""".split()
K = {w: chr(0xE100 + i) for i, w in enumerate(WORDS)}
#: words that may also be names
SOFT = set("""async of get set static let as from type interface namespace module declare abstract public private protected readonly
override implements keyof infer is asserts satisfies unique accessor target meta global require out await yield""".split())
OPS = ["...", "=>", "===", "!==", "**=", "&&=", "||=", "??=", "<<=", "==", "!=", "<=", "&&", "||", "??", "?.", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**", "<<"]
O = {o: chr(0xE200 + i) for i, o in enumerate(OPS)}
NAME, NUM, STR, TPL, REGEX, PRIV, JSX, WRONG = "a", "0", *(chr(0xE300 + i) for i in range(6))
OPEN_X, CLOSE_X = chr(0xE310), chr(0xE311)
END = "\x00"
FIRST_MARK = chr(0xE000)
OP_MARKS = sorted(O.items(), key=lambda x: -len(x[0]))

BOM, LS, PS, NBSP = chr(0xFEFF), chr(0x2028), chr(0x2029), chr(0xA0)
IDENT = rf"[A-Za-z_${chr(0xAA)}-{chr(0x1FFF)}{chr(0x3040)}-{chr(0xD7FF)}{chr(0xF900)}-{chr(0xFDFF)}][\w$]*"
HARD = re.compile(r"""['"`/<]""")
STRINGS = {q: re.compile(rf"{q}(?:[^{q}\\\n]|\\(?:.|\n))*{q}") for q in "'\""}
TEMPLATE_PART = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
REGEXP = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
JSX_NAME = re.compile(rf"\s*{IDENT}(?:-[\w$-]*)*(?:[.:]{IDENT}(?:-[\w$-]*)*)*")
JSX_START = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?!\s*(?:,|extends\b))[\s/>])")
JSX_SPACE = re.compile(r"\s*")
JSX_TEXT = re.compile(r"[^<>{}]*")
WORD_BEFORE = re.compile(r"([\w$]+)\s*$")
#: words after which a slash starts a regular expression
BEFORE_REGEX = set("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
MEMBER = re.compile(rf"\.(?<![.\d]\.)\s*#?{IDENT}")
WORDLIKE = re.compile(r"[\w$](?:(?<=[0-9])(?:[\w$]|\.(?!\.)|(?<=[eE])[+-])*|(?<![0-9])[\w$]*)")
NUMBER = re.compile(
    r"(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:0|[1-9](?:_?\d)*)n|(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d+)?)(?![\w$])"
)
PRIVATE = re.compile(rf"#[{NAME}{K[WORDS[0]]}-{K[WORDS[-1]]}]")
LINES = re.compile(r"\n{2,}")


class Tokens(dict):
    """What each word becomes; the table is emptied when it holds many."""

    def __missing__(self, w: str) -> str:
        if len(self) > 200_000:
            self.clear()
        c = self[w] = _token(w)
        return c


def _token(w: str) -> str:
    c = K.get(w)
    if c is not None:
        return c
    c = w[0]
    if c < "0" or c > "9":
        return w if c >= FIRST_MARK else NAME
    n = NUMBER.match(w)
    if n is None:
        return WRONG
    rest = w[n.end() :]
    return NUM + finish(rest) if rest else NUM


class Lexer:
    """Masks strings, comments, templates, regular expressions and JSX text: each becomes a mark and blanks of the same length.

    Newlines in comments stay, for automatic semicolons. ``comments`` has where the comments are, ``s`` the text they are in.
    """

    def __init__(self, text: str, jsx: bool):
        self.s, self.jsx, self.comments = text, jsx, []

    def run(self) -> str:
        s = self.s
        if s.startswith(BOM):
            s = " " + s[1:]
        s = s.replace("\r\n", "\n").replace("\r", "\n").replace(LS, "\n").replace(PS, "\n")
        if s.startswith("#!"):
            s = "//" + s[2:]
        self.s = s
        out: list[str] = []
        end = self.code(0, out, None)
        if end != len(s):
            raise Bad("end")
        return "".join(out)

    def code(self, i: int, out: list[str], close: str | None) -> int:
        """Copies code from i on; with close, up to the brace that closes the part begun before i."""
        s, n, depth = self.s, len(self.s), 0
        hard = HARD if close is None else re.compile(r"""['"`/<{}]""")
        while True:
            m = hard.search(s, i)
            if m is None:
                if close is not None:
                    raise Bad("open part")
                out.append(s[i:])
                return n
            j = m.start()
            c = s[j]
            if j > i:
                out.append(s[i:j])
            if c in "'\"":
                m = STRINGS[c].match(s, j)
                if m is None:
                    raise Bad("string")
                i = m.end()
                out.append(STR + " " * (i - j - 1))
            elif c == "`":
                i = self.template(j + 1, out)
            elif c == "/":
                two = s[j : j + 2]
                if two == "//":
                    i = s.find("\n", j)
                    if i < 0:
                        i = n
                    self.comments.append((j, i))
                    out.append(" " * (i - j))
                elif two == "/*":
                    k = s.find("*/", j + 2)
                    if k < 0:
                        raise Bad("comment")
                    i = k + 2
                    self.comments.append((j, i))
                    out.append("\n".join(" " * len(x) for x in s[j:i].split("\n")))
                elif self.operand_next(out):
                    m = REGEXP.match(s, j)
                    if m is None:
                        raise Bad("regex")
                    i = m.end()
                    out.append(REGEX + " " * (i - j - 1))
                else:
                    out.append("/")
                    i = j + 1
            elif c == "<":
                if self.jsx and self.operand_next(out) and JSX_START.match(s, j):
                    out.append(JSX)
                    i = self.element(j, out)
                else:
                    out.append("<")
                    i = j + 1
            elif c == "{":
                depth += 1
                out.append(c)
                i = j + 1
            else:
                if not depth:
                    return j
                depth -= 1
                out.append(c)
                i = j + 1

    def operand_next(self, out: list[str]) -> bool:
        """Whether an operand, not an operator, comes next."""
        for part in reversed(out):
            t = part.rstrip()
            if not t:
                continue
            c = t[-1]
            if c in ")]}" or c in (STR, TPL, REGEX, JSX, CLOSE_X):
                return c == "}" or c == ")" and self.after_condition(out)
            if c.isalnum() or c in "_$" or ord(c) > 0xE000:
                w = WORD_BEFORE.search(t)
                if w is None:
                    return False
                before = t[: w.start()].rstrip()
                return w.group(1) in BEFORE_REGEX and not before.endswith(".")
            if t.endswith("++") or t.endswith("--"):
                return False
            return True
        return True

    def after_condition(self, out: list[str]) -> bool:
        """Whether the closing parenthesis at the end belongs to an if, while, for or with."""
        depth = 0
        for n, part in enumerate(reversed(out)):
            for k in range(len(part) - 1, -1, -1):
                if part[k] in "()":
                    depth += 1 if part[k] == ")" else -1
                    if not depth:
                        before = part[:k].rstrip() if part[:k].strip() else "".join(out[: len(out) - n - 1][-8:]).rstrip()
                        w = WORD_BEFORE.search(before[-40:])
                        return w is not None and w.group(1) in ("if", "while", "for", "with") and not before[: -len(w.group(1))].rstrip().endswith(".")
        return False

    def template(self, i: int, out: list[str]) -> int:
        out.append(TPL)
        s = self.s
        while True:
            j = i
            i = TEMPLATE_PART.match(s, i).end()
            out.append(" " * (i - j))
            if s.startswith("`", i):
                out.append(" ")
                return i + 1
            if not s.startswith("${", i):
                raise Bad("template")
            out.append(" " + OPEN_X)
            i = self.code(i + 2, out, "}") + 1
            out.append(CLOSE_X)

    def element(self, i: int, out: list[str]) -> int:
        """A JSX element from its < on; expressions go out as groups."""
        inner = JsxOut(out, i + 1)
        end = self.element_parts(i, inner)
        inner.upto(end)
        return end

    def element_parts(self, i: int, out: "JsxOut") -> int:
        s = self.s
        space = lambda k: JSX_SPACE.match(s, k).end()
        i = space(i + 1)
        name = ""
        if not s.startswith(">", i):
            m = JSX_NAME.match(s, i)
            if m is None:
                raise Bad("element")
            name, i = m.group().strip(), space(m.end())
            while True:
                if s.startswith("/>", i):
                    return i + 2
                if s.startswith(">", i):
                    break
                if s.startswith("{", i):
                    i = self.inner(i, out)
                else:
                    m = JSX_NAME.match(s, i)
                    if m is None:
                        raise Bad("attribute")
                    i = space(m.end())
                    if s.startswith("=", i):
                        i = space(i + 1)
                        c = s[i : i + 1]
                        if c in ("'", '"'):
                            i = s.find(c, i + 1) + 1
                            if not i:
                                raise Bad("attribute")
                        elif c == "{":
                            i = self.inner(i, out)
                        elif c == "<":
                            i = self.element_parts(i, out)
                        else:
                            raise Bad("attribute")
                i = space(i)
        i += 1
        while True:
            i = JSX_TEXT.match(s, i).end()
            c = s[i : i + 1]
            if c == "{":
                i = self.inner(i, out)
            elif c == "<":
                k = space(i + 1)
                if s.startswith("/", k):
                    k = space(k + 1)
                    m = JSX_NAME.match(s, k)
                    end = m.group().strip() if m else ""
                    k = space(m.end() if m else k)
                    if end != name or not s.startswith(">", k):
                        raise Bad("closing element")
                    return k + 1
                i = self.element_parts(i, out)
            else:
                raise Bad("element text")

    def inner(self, i: int, out: "JsxOut") -> int:
        out.upto(i)
        out.out.append(OPEN_X)
        i = self.code(i + 1, out.out, "}") + 1
        out.out.append(CLOSE_X)
        out.at = i
        return i


class JsxOut:
    """Output of an element: blanks for all but the expressions."""

    def __init__(self, out: list[str], at: int):
        self.out, self.at = out, at

    def upto(self, i: int) -> None:
        self.out.append(" " * (i - self.at))
        self.at = i


TOKENS = Tokens()
WORDS_APART = re.compile(f"({WORDLIKE.pattern})")


def finish(t: str) -> str:
    parts = WORDS_APART.split(MEMBER.sub("." + NAME, t))
    parts[1::2] = [TOKENS[w] for w in parts[1::2]]
    t = "".join(parts)
    if WRONG in t or chr(92) in t:
        raise Bad("token")
    if "." + NUM in t:
        t = t.replace("." + NUM, NUM)
    for o, c in OP_MARKS:
        if o in t:
            t = t.replace(o, c)
    for c in (" ", "\t", "\f", "\v", NBSP, BOM):
        if c in t:
            t = t.replace(c, "")
    if "#" in t:
        t = PRIVATE.sub(PRIV, t)
    return LINES.sub("\n", t)


# ---- what a token can be ----
NAMES = {NAME, *(K[w] for w in SOFT)}
ALL_WORDS = {NAME, *K.values()}
KEYS = ALL_WORDS | {STR, NUM, PRIV}
ASSIGN = {"=", *(O[o] for o in ("**=", "&&=", "||=", "??=", "<<=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="))}
BINARY = {
    **{O[o]: p for o, p in (("??", 1), ("||", 1), ("&&", 2), ("==", 6), ("!=", 6), ("===", 6), ("!==", 6), ("<=", 7), ("<<", 8), ("**", 11))},
    "|": 3, "^": 4, "&": 5, "<": 7, ">": 7, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, K["instanceof"]: 7, K["in"]: 7,
}
UNARY = {"+", "-", "!", "~", K["typeof"], K["void"], K["delete"]}
# what a group can be
EXPR, ARGS, PARAMS, FORHEAD, TYPE, BLOCK, OBJECT, CLASSBODY, MEMBERS, ENUM, NAMELIST, SWITCH, INDEX, MODULE, SPREAD_X, CATCH, FORIN, INDEXSIG, ASSIGNPAT, EMPTY, PAREN, SQUARE, CURLY, PART = (1 << i for i in range(24))
# what it holds outside functions of its own
RETURN, AWAIT, YIELD, BREAK, CONTINUE = (1 << i for i in range(5))


SHAPE = {"(": PAREN, "[": SQUARE, "{": CURLY, OPEN_X: PART}


class Grammar:
    """One of: js, ts, tsx."""

    def __init__(self, name: str):
        self.ts, self.jsx = name != "js", name == "tsx"
        self.groups = Groups(self.classify)
        self.statements: dict[str, int | None] = {}

    def check(self, text: str) -> bool | None:
        """Whether the text is valid; None if it is nested too deep for the parser to tell."""
        try:
            if not text.strip(BOM + " \t\r\n"):
                return True
            self.lexer = Lexer(text, self.jsx)
            self.masked = self.lexer.run()
            return self.check_tokens(finish(self.masked))
        except Bad:
            return False
        except RecursionError:
            return None

    def check_tokens(self, tokens: str) -> bool | None:
        """``check`` on what the lexer and ``finish`` make of a text."""
        try:
            t = self.groups.fold(tokens)
            if len(self.statements) > 100_000:
                self.statements.clear()
            return not self.block(t, True) & ~AWAIT
        except Bad:
            return False
        except RecursionError:
            return None

    # a group: (roles, flags)
    def classify(self, g: str):
        inside, b = g[1:-1], g[0]
        roles = flags = 0

        def attempt(role, f, *args):
            nonlocal roles, flags
            p = Parser(self, inside)
            try:
                f(p, *args)
                p.at_end()
            except Bad:
                return
            roles |= role
            flags |= p.flags

        if b == "(":
            semicolon = ";" in inside
            if semicolon:
                attempt(FORHEAD, Parser.for_head)
            else:
                attempt(ARGS, Parser.arguments)
                if roles:
                    attempt(EXPR, Parser.expression)
                attempt(PARAMS, Parser.parameters)
                if K["of"] in inside or K["in"] in inside:
                    attempt(FORIN, Parser.for_in)
                attempt(CATCH, Parser.catch_parameter)
                if self.ts:
                    attempt(TYPE, Parser.type)
        elif b == "[":
            attempt(OBJECT, Parser.array)
            if roles:
                attempt(EXPR, Parser.expression)
            attempt(PARAMS, Parser.array_pattern)
            attempt(ASSIGNPAT, Parser.array_pattern, True)
            if self.ts:
                attempt(TYPE, Parser.tuple_type)
                attempt(INDEXSIG, Parser.index_signature)
        elif b == "{":
            bare = inside.strip("\n")
            if not bare:
                return (BLOCK | OBJECT | PARAMS | ASSIGNPAT | CLASSBODY | MEMBERS | ENUM | NAMELIST | SWITCH | MODULE | CURLY, 0)
            first = bare[0]
            if first in (K["case"], K["default"]):
                attempt(SWITCH, Parser.switch_body)
            try:
                f = self.block(inside, False)
                roles |= BLOCK
                flags |= f
            except Bad:
                pass
            if ";" not in inside or self.ts:
                attempt(OBJECT, Parser.object)
                attempt(PARAMS, Parser.object_pattern)
                attempt(ASSIGNPAT, Parser.object_pattern, True)
                attempt(NAMELIST, Parser.name_list)
                if self.ts:
                    attempt(ENUM, Parser.enum_body)
            attempt(CLASSBODY, Parser.class_body)
            if self.ts:
                attempt(MEMBERS, Parser.type_members)
                if K["export"] in inside or roles & BLOCK:
                    attempt(MODULE, Parser.module_body)
        else:
            if not inside.strip("\n"):
                return (SPREAD_X | EMPTY | PART, 0)
            attempt(EXPR, Parser.expression)
            if not roles:
                attempt(SPREAD_X, Parser.spread)
        return (roles | SHAPE[b], flags) if roles else None

    def block(self, t: str, top: bool) -> int:
        """The flags of a list of statements. Lines that are whole statements by themselves are looked up."""
        flags, known = 0, self.statements
        for line in t.split("\n"):
            if not line:
                continue
            key = line + "!" if top else line
            f = known.get(key, -1)
            if f == -1:
                p = Parser(self, line)
                try:
                    p.whole_line(top)
                    f = p.flags
                except Bad:
                    f = None
                if len(line) < 400:
                    known[key] = f
            if f is None:
                break
            flags |= f
        else:
            return flags
        p = Parser(self, t)
        p.statement_list(top)
        p.at_end()
        return p.flags


class Parser:
    def __init__(self, g: Grammar, text: str):
        self.g, self.ts, self.kind = g, g.ts, g.groups.kind
        if "\n" in text:
            parts = text.split("\n")
            self.t = "".join(parts) + END * 4
            self.nl, n = set(), 0
            for p in parts[:-1]:
                n += len(p)
                self.nl.add(n)
        else:
            self.t, self.nl = text + END * 4, ()
        self.i, self.flags, self.expr, self.no_in = 0, 0, "", False

    # -- helpers
    def at_end(self):
        if self.i != len(self.t) - 4:
            raise Bad

    def eat(self, c: str) -> bool:
        if self.t[self.i] == c:
            self.i += 1
            return True
        return False

    def need(self, c: str):
        if self.t[self.i] != c:
            raise Bad
        self.i += 1

    def name(self):
        if self.t[self.i] not in NAMES:
            raise Bad
        self.i += 1

    def group(self, roles: int, at: int | None = None) -> bool:
        """Whether a group of one of the roles is here."""
        k = self.kind.get(self.t[self.i if at is None else at])
        return k is not None and bool(k[0] & roles)

    def take(self, roles: int, mask: int = 0):
        k = self.kind.get(self.t[self.i])
        if k is None or not k[0] & roles:
            raise Bad
        self.i += 1
        self.flags |= k[1] & ~mask

    def parens(self, roles: int, mask: int = 0):
        if not self.group(PAREN):
            raise Bad
        self.take(roles, mask)

    def body(self, is_async: bool, generator: bool):
        """A function's block."""
        k = self.kind.get(self.t[self.i])
        if k is None or not k[0] & BLOCK:
            raise Bad
        f = k[1]
        if f & (BREAK | CONTINUE) or f & AWAIT and not is_async or f & YIELD and not generator:
            raise Bad
        self.i += 1

    def semicolon(self):
        c = self.t[self.i]
        if c == ";":
            self.i += 1
        elif c != END and self.i not in self.nl:
            raise Bad

    def maybe(self, f, *args) -> bool:
        """Tries f; nothing is read if it fails."""
        i, flags, no_in = self.i, self.flags, self.no_in
        try:
            f(*args)
            return True
        except Bad:
            self.i, self.flags, self.no_in = i, flags, no_in
            return False

    # -- statements
    def whole_line(self, top: bool):
        """One line of complete statements: nothing of it depends on the next line."""
        while self.t[self.i] != END:
            self.statement(True, top)
        # an automatic semicolon at the end of the line would look at what follows
        if self.t[self.i - 1] != ";" and not self.closed:
            raise Bad

    closed = False

    def statement_list(self, top: bool, stop: tuple = ()):
        t = self.t
        while t[self.i] != END and t[self.i] not in stop:
            self.statement(True, top)

    def statement(self, declarations: bool = True, top: bool = False):
        t, c = self.t, self.t[self.i]
        self.closed = False
        f = STATEMENTS.get(c)
        if f is not None and f(self, declarations, top):
            return
        k = self.kind.get(c)
        if k is not None and k[0] & CURLY:
            self.take(BLOCK)
            self.closed = True
            return
        if c in NAMES and t[self.i + 1] == ":":
            self.i += 2
            self.statement(False)
            return
        self.expression()
        self.semicolon()

    def empty_(self, d, top):
        self.i += 1
        return True

    def if_(self, d, top):
        self.i += 1
        self.parens(EXPR)
        self.statement(False)
        if self.eat(K["else"]):
            self.statement(False)
        return True

    def loop_body(self):
        old = self.flags
        self.flags = 0
        self.statement(False)
        self.flags = old | self.flags & ~(BREAK | CONTINUE)

    def while_(self, d, top):
        self.i += 1
        self.parens(EXPR)
        self.loop_body()
        return True

    def do_(self, d, top):
        self.i += 1
        self.loop_body()
        self.need(K["while"])
        self.parens(EXPR)
        self.eat(";")
        self.closed = self.t[self.i - 1] == ";"
        return True

    def for_(self, d, top):
        self.i += 1
        if self.eat(K["await"]):
            self.flags |= AWAIT
            self.take(FORIN)
        else:
            self.take(FORHEAD | FORIN)
        self.loop_body()
        return True

    def jump_(self, d, top):
        c = self.t[self.i]
        self.i += 1
        if self.t[self.i] in NAMES and self.i not in self.nl:
            self.i += 1
        else:
            self.flags |= BREAK if c == K["break"] else CONTINUE
        self.semicolon()
        return True

    def return_(self, d, top):
        self.i += 1
        self.flags |= RETURN
        if self.t[self.i] not in (";", END) and self.i not in self.nl:
            self.expression()
        self.semicolon()
        return True

    def throw_(self, d, top):
        self.i += 1
        if self.i in self.nl:
            raise Bad
        self.expression()
        self.semicolon()
        return True

    def try_(self, d, top):
        self.i += 1
        self.take(BLOCK)
        done = False
        if self.eat(K["catch"]):
            done = True
            if self.group(CATCH):
                self.take(CATCH)
            self.take(BLOCK)
        if self.eat(K["finally"]):
            done = True
            self.take(BLOCK)
        if not done:
            raise Bad
        self.closed = True
        return True

    def switch_(self, d, top):
        self.i += 1
        self.parens(EXPR)
        self.take(SWITCH, BREAK)
        self.closed = True
        return True

    def debugger_(self, d, top):
        self.i += 1
        self.semicolon()
        return True

    def var_(self, d, top):
        c = self.t[self.i]
        n = self.t[self.i + 1]
        if c == K["let"]:
            if not (n in NAMES or self.group(PARAMS, self.i + 1)):
                return False
        if c == K["const"] and n == K["enum"] and self.ts:
            self.i += 1
            return self.enum_(d, top)
        if c != K["var"] and not d:
            raise Bad
        self.i += 1
        self.declarators(c == K["const"])
        self.semicolon()
        return True

    ambient = False

    def declarators(self, const: bool = False):
        while True:
            pattern = self.kind.get(self.t[self.i]) is not None
            self.binding()
            if self.ts:
                if self.eat("!"):
                    pass
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.assign()
            elif (pattern or const) and not self.ambient:
                raise Bad
            if not self.eat(","):
                return

    def function_(self, d, top):
        if not d:
            raise Bad
        self.i += 1
        self.function_rest(False, True)
        self.closed = self.t[self.i - 1] != END
        return True

    def function_rest(self, is_async: bool, named: bool, statement: bool = True):
        generator = self.eat("*")
        if named or self.t[self.i] in NAMES:
            self.name()
        self.type_parameters()
        self.parens(PARAMS, 255)
        self.return_type()
        if self.ts and statement and not self.group(BLOCK):
            self.semicolon()  # an overload or a declaration
            return
        self.body(is_async, generator)

    def async_(self, d, top):
        if self.t[self.i + 1] == K["function"] and self.i + 1 not in self.nl:
            if not d:
                raise Bad
            self.i += 2
            self.function_rest(True, True)
            self.closed = True
            return True
        return False

    def class_(self, d, top):
        if not d:
            raise Bad
        self.i += 1
        self.class_rest(True)
        self.closed = True
        return True

    def class_rest(self, named: bool):
        t = self.t
        if named or t[self.i] in NAMES and not (t[self.i] == K["implements"] and self.ts):
            self.name()
        self.type_parameters()
        if self.eat(K["extends"]):
            self.postfix(True)
            self.type_arguments()
        if self.ts and self.eat(K["implements"]):
            self.type()
            while self.eat(","):
                self.type()
        self.take(CLASSBODY, 255)

    def decorator_(self, d, top):
        while self.t[self.i] == "@":
            self.decorator()
        if self.eat(K["export"]):
            self.eat(K["default"])
        if self.ts:
            self.eat(K["abstract"])
        if self.t[self.i] != K["class"]:
            raise Bad
        return self.class_(d, top)

    def decorator(self):
        if not self.ts:
            raise Bad
        self.need("@")
        if self.group(EXPR):
            self.take(EXPR)
            return
        self.name()
        while self.t[self.i] == ".":
            self.i += 2
        if self.group(ARGS):
            self.take(ARGS)

    def import_(self, d, top):
        n = self.t[self.i + 1]
        if n == "." or self.group(PAREN, self.i + 1):
            return False
        if not top:
            raise Bad
        self.i += 1
        if self.ts and self.t[self.i] == K["type"] and self.t[self.i + 1] != K["from"] and self.t[self.i + 1] not in (",", "="):
            self.i += 1
        if self.eat(STR):
            self.attributes()
            self.semicolon()
            return True
        if self.t[self.i] in NAMES:
            self.i += 1
            if self.ts and self.eat("="):
                self.expression()
                self.semicolon()
                return True
            if not self.eat(","):
                self.from_()
                return True
        if self.eat("*"):
            self.need(K["as"])
            self.name()
        else:
            self.take(NAMELIST)
        self.from_()
        return True

    def from_(self):
        self.need(K["from"])
        self.need(STR)
        self.attributes()
        self.semicolon()

    def attributes(self):
        if self.t[self.i] == K["with"]:
            self.i += 1
            self.take(OBJECT)

    def export_(self, d, top):
        if not top:
            raise Bad
        self.i += 1
        c = self.t[self.i]
        if c == K["default"]:
            self.i += 1
            c = self.t[self.i]
            if c == K["function"] or c == K["async"] and self.t[self.i + 1] == K["function"]:
                a = self.eat(K["async"])
                self.i += 1
                self.function_rest(a, False)
                self.closed = True
            elif c == K["class"] or self.ts and c == K["abstract"] and self.t[self.i + 1] == K["class"]:
                self.eat(K["abstract"])
                self.i += 1
                self.class_rest(False)
                self.closed = True
            elif c == "@":
                self.decorator_(True, True)
            elif self.ts and c == K["interface"] and self.t[self.i + 1] in NAMES:
                self.interface_(True, True)
            else:
                self.assign()
                self.semicolon()
            return True
        if self.ts and c == K["type"] and (self.group(NAMELIST, self.i + 1) or self.t[self.i + 1] == "*"):
            self.i += 1
            c = self.t[self.i]
        if c == "*":
            self.i += 1
            if self.eat(K["as"]):
                if not self.eat(STR):
                    self.word()
            self.from_()
            return True
        if self.group(NAMELIST):
            self.i += 1
            if self.t[self.i] == K["from"]:
                self.from_()
            else:
                self.semicolon()
            return True
        if self.ts and c == "=":
            self.i += 1
            self.expression()
            self.semicolon()
            return True
        if self.ts and c == K["as"]:
            self.i += 1
            self.need(K["namespace"])
            self.name()
            self.semicolon()
            return True
        f = STATEMENTS.get(c)
        if f not in EXPORTED and not (self.ts and c in TS_EXPORTED):
            raise Bad
        if not f(self, True, True):
            raise Bad
        return True

    def word(self):
        if self.t[self.i] not in ALL_WORDS:
            raise Bad
        self.i += 1

    # TypeScript statements
    def type_(self, d, top):
        if not self.ts or self.t[self.i + 1] not in NAMES or self.i + 1 in self.nl:
            return False
        self.i += 1
        self.name()
        self.type_parameters()
        self.need("=")
        self.type()
        self.semicolon()
        return True

    def interface_(self, d, top):
        if not self.ts or self.t[self.i + 1] not in NAMES:
            return False
        self.i += 1
        self.name()
        self.type_parameters()
        if self.eat(K["extends"]):
            self.type()
            while self.eat(","):
                self.type()
        self.take(MEMBERS)
        self.closed = True
        return True

    def enum_(self, d, top):
        if not self.ts:
            raise Bad
        self.i += 1
        self.name()
        self.take(ENUM)
        self.closed = True
        return True

    def namespace_(self, d, top):
        n = self.t[self.i + 1]
        if not self.ts or not (n in NAMES or n == STR):
            return False
        self.i += 2
        while self.eat("."):
            self.name()
        if self.group(MODULE | BLOCK):
            self.take(MODULE | BLOCK)
        else:
            self.semicolon()
        self.closed = True
        return True

    def declare_(self, d, top):
        n = self.t[self.i + 1]
        if not self.ts or n not in DECLARABLE:
            return False
        self.i += 1
        if self.t[self.i] == K["global"]:
            self.i += 1
            self.take(MODULE | BLOCK)
            self.closed = True
            return True
        self.ambient = True
        self.statement(True, top)
        self.ambient = False
        return True

    def abstract_(self, d, top):
        if not self.ts or self.t[self.i + 1] != K["class"]:
            return False
        self.i += 1
        return self.class_(d, top)

    # -- bindings
    def binding(self):
        c = self.t[self.i]
        if c in NAMES:
            self.i += 1
        elif self.group(PAREN):
            raise Bad
        else:
            self.take(PARAMS)

    def parameters(self):
        t = self.t
        while t[self.i] != END:
            while t[self.i] == "@":
                self.decorator()
            if self.ts:
                while t[self.i] in MODIFIERS and (t[self.i + 1] in NAMES or self.group(PARAMS, self.i + 1)):
                    self.i += 1
            rest = self.eat(O["..."])
            if self.ts and t[self.i] == K["this"]:
                self.i += 1
            else:
                self.binding()
            if self.ts:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                if rest:
                    raise Bad
                self.assign()
            if t[self.i] == END:
                return
            self.need(",")
            if rest:
                raise Bad

    def catch_parameter(self):
        self.binding()
        if self.ts and self.eat(":"):
            self.type()

    def target(self, assign: bool):
        """An element of a pattern."""
        if assign:
            if self.group(ASSIGNPAT) and self.t[self.i + 1] in (",", "=", END):
                self.take(ASSIGNPAT)
            else:
                self.postfix()
                if self.expr not in ("name", "member"):
                    raise Bad
        else:
            self.binding()

    def array_pattern(self, assign: bool = False):
        while self.t[self.i] != END:
            if self.eat(","):
                continue
            rest = self.eat(O["..."])
            self.target(assign)
            if not rest and self.eat("="):
                self.assign()
            if self.t[self.i] == END:
                return
            if rest:
                raise Bad
            self.need(",")

    def object_pattern(self, assign: bool = False):
        t = self.t
        while t[self.i] != END:
            if self.eat(O["..."]):
                self.target(assign)
                if t[self.i] != END:
                    raise Bad
                return
            c = t[self.i]
            if c in NAMES and t[self.i + 1] != ":":
                self.i += 1
            else:
                self.key()
                self.need(":")
                self.target(assign)
            if self.eat("="):
                self.assign()
            if t[self.i] == END:
                return
            self.need(",")

    def key(self):
        c = self.t[self.i]
        if c in KEYS:
            self.i += 1
        else:
            if not self.group(SQUARE):
                raise Bad
            self.take(EXPR)

    def name_list(self):
        t = self.t
        while t[self.i] != END:
            if self.ts and t[self.i] == K["type"] and t[self.i + 1] in ALL_WORDS:
                self.i += 1
            if t[self.i] not in ALL_WORDS and t[self.i] != STR:
                raise Bad
            self.i += 1
            if self.eat(K["as"]):
                if t[self.i] not in ALL_WORDS and t[self.i] != STR:
                    raise Bad
                self.i += 1
            if t[self.i] == END:
                return
            self.need(",")

    def for_head(self):
        self.no_in = True
        c = self.t[self.i]
        if c != ";":
            n = self.t[self.i + 1]
            if c in (K["var"], K["const"]) or c == K["let"] and (n in NAMES or self.group(PARAMS, self.i + 1)):
                self.i += 1
                self.declarators(c == K["const"])
            else:
                self.expression()
        self.no_in = False
        self.need(";")
        if self.t[self.i] != ";":
            self.expression()
        self.need(";")
        if self.t[self.i] != END:
            self.expression()

    def for_in(self):
        c = self.t[self.i]
        n = self.t[self.i + 1]
        if c in (K["var"], K["const"]) or c == K["let"] and (n in NAMES or self.group(PARAMS, self.i + 1)):
            self.i += 1
            self.binding()
            if self.ts and self.eat(":"):
                self.type()
        elif self.group(ASSIGNPAT) and self.t[self.i + 1] in (K["of"], K["in"]):
            self.take(ASSIGNPAT)
        else:
            self.postfix()
            if self.expr not in ("name", "member"):
                raise Bad
        if self.eat(K["of"]):
            self.assign()
        else:
            self.need(K["in"])
            self.expression()

    def switch_body(self):
        seen = False
        while self.t[self.i] != END:
            if self.eat(K["default"]):
                if seen:
                    raise Bad
                seen = True
            else:
                self.need(K["case"])
                self.expression()
            self.need(":")
            self.statement_list(False, (K["case"], K["default"]))

    def module_body(self):
        self.ambient = True  # of a declared module; of another one constants without a value are taken, too
        self.statement_list(True)

    # -- expressions
    def expression(self):
        self.assign()
        while self.eat(","):
            self.assign()
            self.expr = ""

    def spread(self):
        self.need(O["..."])
        self.assign()

    def arguments(self):
        while self.t[self.i] != END:
            self.eat(O["..."])
            self.assign()
            if self.t[self.i] == END:
                return
            self.need(",")

    def array(self):
        while self.t[self.i] != END:
            if self.eat(","):
                continue
            self.eat(O["..."])
            self.assign()
            if self.t[self.i] == END:
                return
            self.need(",")

    def arrow_body(self, is_async: bool):
        if self.group(CURLY):
            self.body(is_async, False)
        else:
            old, self.flags = self.flags, 0
            self.assign()
            if self.flags & AWAIT and not is_async:
                raise Bad
            self.flags = old
        self.expr = "arrow"

    def arrow_tail(self, is_async: bool):
        """Parameters in parentheses, a type, the arrow and the body."""
        self.parens(PARAMS, 255)
        if self.ts:
            self.return_type()
        if self.i in self.nl:
            raise Bad
        self.need(O["=>"])
        self.arrow_body(is_async)

    def generic_arrow(self, is_async: bool):
        self.need("<")
        self.i -= 1
        self.type_parameters()
        self.arrow_tail(is_async)

    def assign(self):
        t, c = self.t, self.t[self.i]
        n = t[self.i + 1]
        if c in NAMES:
            if n == O["=>"]:
                self.i += 2
                self.arrow_body(False)
                return
            if c == K["async"] and self.i + 1 not in self.nl:
                if n in NAMES and t[self.i + 2] == O["=>"]:
                    self.i += 3
                    self.arrow_body(True)
                    return
                if self.group(PAREN, self.i + 1) and t[self.i + 2] in (O["=>"], ":"):
                    self.i += 1
                    if self.maybe(self.arrow_tail, True):
                        return
                    self.i -= 1
                if n == "<" and self.ts:
                    self.i += 1
                    if self.maybe(self.generic_arrow, True):
                        return
                    self.i -= 1
            if c == K["yield"]:
                self.i += 1
                self.flags |= YIELD
                if self.i not in self.nl:
                    if self.eat("*") or t[self.i] not in (END, ";", ",", ":", K["in"], K["of"]):
                        self.assign()
                self.expr = ""
                return
        elif self.kind.get(c) is not None:
            k = self.kind[c][0]
            if k & PAREN and k & PARAMS:
                if n == O["=>"]:
                    self.arrow_tail(False)
                    return
                if n == ":" and self.ts and self.maybe(self.arrow_tail, False):
                    return
            if k & ASSIGNPAT and n == "=":
                self.i += 2
                self.flags |= self.kind[c][1]
                self.assign()
                self.expr = ""
                return
        elif c == "<" and self.ts:
            if self.maybe(self.generic_arrow, False):
                return
        self.conditional()
        shift = t[self.i] == ">" and t[self.i + 1] == ">"
        if shift or t[self.i] in ASSIGN:
            if shift:  # >>= and >>>=
                self.i += 3 if t[self.i + 2] == ">" else 2
                self.need("=")
            else:
                self.i += 1
            if self.expr not in ("name", "member"):
                raise Bad
            self.assign()
            self.expr = ""

    def conditional(self):
        self.binary(0)
        if self.t[self.i] == "?":
            self.i += 1
            no_in, self.no_in = self.no_in, False
            start, flags = self.i, self.flags
            try:
                self.assign()
                self.need(":")
            except Bad:
                # in "a ? (b) : c => d" the parentheses were taken for parameters
                self.i, self.flags = start, flags
                self.conditional()
                self.need(":")
            self.no_in = no_in
            self.assign()
            self.expr = ""

    def binary(self, least: int):
        t = self.t
        if t[self.i] == PRIV:
            self.i += 1
            if t[self.i] != K["in"]:
                raise Bad
            self.expr = ""
        else:
            self.unary()
        while True:
            c = t[self.i]
            p = BINARY.get(c)
            if p is None:
                if self.ts and c in (K["as"], K["satisfies"]) and self.i not in self.nl and least < 7:
                    self.i += 1
                    if not self.eat(K["const"]):
                        self.type()
                    if self.expr not in ("name", "member"):
                        self.expr = ""
                    continue
                return
            if p <= least and not (c == O["**"] and p == least):
                return
            if c == K["in"] and self.no_in:
                return
            if c == ">" and t[self.i + 1] in (">", "="):  # >=, >> and >>>; a type may end in each of their signs, so they are kept apart
                j = self.i + 1
                while t[j] == ">" and j < self.i + 3:
                    j += 1
                if t[j] == "=":
                    if j > self.i + 1:
                        return
                    j += 1
                else:
                    p = 8
                    if p <= least:
                        return
                self.i = j
            else:
                if c == O["**"] and self.expr == "unary":
                    raise Bad
                self.i += 1
            self.binary(p)
            self.expr = ""

    def unary(self):
        t, c = self.t, self.t[self.i]
        if c in UNARY:
            self.i += 1
            self.unary()
            self.expr = "unary"
            return
        if c in (O["++"], O["--"]):
            self.i += 1
            self.unary()
            if self.expr not in ("name", "member"):
                raise Bad
            self.expr = ""
            return
        if c == K["await"] and t[self.i + 1] not in (O["=>"],):
            self.i += 1
            self.flags |= AWAIT
            self.unary()
            self.expr = ""
            return
        if c == "<" and self.ts and not self.g.jsx:
            self.i += 1
            self.type()
            self.need(">")
            self.unary()
            self.expr = ""
            return
        self.postfix()
        if t[self.i] in (O["++"], O["--"]) and self.i not in self.nl:
            if self.expr not in ("name", "member"):
                raise Bad
            self.i += 1
            self.expr = ""

    def postfix(self, heritage: bool = False):
        """A primary expression with members, calls and templates."""
        t = self.t
        self.primary()
        optional = False
        while True:
            c = t[self.i]
            if c == ".":
                if t[self.i + 1] != NAME:
                    raise Bad
                self.i += 2
                self.expr = "member"
            elif c == O["?."]:
                self.i += 1
                optional = True
                if t[self.i] == NAME:
                    self.i += 1
                elif self.bracket(SQUARE):
                    self.take(EXPR)
                else:
                    if self.ts:
                        self.type_arguments()
                    self.take(ARGS)
                self.expr = "member"
            elif c == TPL:
                self.template()
                self.expr = "call"
            elif c == "!" and self.ts and self.i not in self.nl and t[self.i + 1] != "=":
                self.i += 1
            elif c == "<" and self.ts and not heritage:
                if not self.maybe(self.call_types):
                    break
                self.expr = "call"
            else:
                k = self.kind.get(c)
                if k is None:
                    break
                if k[0] & ARGS:
                    self.take(ARGS)
                    self.expr = "call"
                elif k[0] & EXPR and self.is_index(k[0]):
                    self.take(EXPR)
                    self.expr = "member"
                else:
                    break
        if optional and self.expr == "member":
            self.expr = "chain"

    # groups of square brackets have no role that only parentheses or braces have
    def is_index(self, roles: int) -> bool:
        return bool(roles & SQUARE)

    def bracket(self, *roles) -> bool:
        k = self.kind.get(self.t[self.i])
        return k is not None and all(k[0] & r for r in roles)

    def call_types(self):
        self.need("<")
        self.i -= 1
        self.type_arguments()
        c = self.t[self.i]
        k = self.kind.get(c)
        if k is not None and k[0] & ARGS:
            self.take(ARGS)
        elif c == TPL:
            self.template()
        elif c in (")", ",", ";", ":", END, "."):
            pass
        else:
            raise Bad

    def template(self):
        self.i += 1
        while self.is_part():
            self.take(EXPR)

    def is_part(self) -> bool:
        """A substitution: the only groups that are an expression and neither arguments nor an array."""
        k = self.kind.get(self.t[self.i])
        return k is not None and bool(k[0] & PART)

    def primary(self):
        t, c = self.t, self.t[self.i]
        if c in NAMES:
            if c == K["async"] and t[self.i + 1] == K["function"] and self.i + 1 not in self.nl:
                self.i += 2
                self.function_rest(True, False, False)
                self.expr = ""
                return
            self.i += 1
            self.expr = "name"
            return
        if c in LITERALS:
            self.i += 1
            self.expr = "this" if c == K["this"] else ""
            return
        if c == TPL:
            self.template()
            self.expr = ""
            return
        if c == JSX:
            self.i += 1
            while self.kind.get(t[self.i]) is not None and self.is_part():
                self.take(EXPR | SPREAD_X)
            self.expr = ""
            return
        k = self.kind.get(c)
        if k is not None:
            r = k[0]
            if r & PAREN:
                self.take(EXPR)
                # (a) = 1 and (a.b) = 1 are targets, as is any name in parentheses
                self.expr = "name"
                return
            self.take(OBJECT)
            self.expr = ""
            return
        if c == K["function"]:
            self.i += 1
            self.function_rest(False, False, False)
            self.expr = ""
            return
        if c == K["class"]:
            self.i += 1
            self.class_rest(False)
            self.expr = ""
            return
        if c == K["new"]:
            self.i += 1
            if t[self.i] == "." and t[self.i + 1] == NAME:
                self.i += 2
                self.expr = ""
                return
            self.new_target()
            return
        if c == K["import"]:
            self.i += 1
            if t[self.i] == ".":
                self.i += 2
            elif self.group(ARGS):
                self.take(ARGS)
            else:
                raise Bad
            self.expr = ""
            return
        if c == K["super"]:
            self.i += 1
            if t[self.i] != "." and not self.group(ARGS | EXPR):
                raise Bad
            self.expr = ""
            return
        if c == "@":
            while t[self.i] == "@":
                self.decorator()
            self.need(K["class"])
            self.class_rest(False)
            self.expr = ""
            return
        raise Bad

    def new_target(self):
        t = self.t
        if t[self.i] == K["import"]:
            raise Bad
        self.primary()
        while True:
            c = t[self.i]
            if c == ".":
                if t[self.i + 1] != NAME:
                    raise Bad
                self.i += 2
            elif c == TPL:
                self.template()
            elif c == "<" and self.ts:
                if not self.maybe(self.type_arguments):
                    break
            elif self.kind.get(c) is not None and self.is_index(self.kind[c][0]) and self.kind[c][0] & EXPR:
                self.take(EXPR)
            else:
                break
        if self.group(ARGS):
            self.take(ARGS)
        self.expr = ""

    def object(self):
        t = self.t
        while t[self.i] != END:
            if self.eat(O["..."]):
                self.assign()
            else:
                self.property()
            if t[self.i] == END:
                return
            self.need(",")

    def property(self):
        t, c = self.t, self.t[self.i]
        n = t[self.i + 1]
        if c in NAMES and n in (",", END):
            self.i += 1
            return
        is_async = generator = False
        ends = (",", ":", END, "=", "<", "?")
        if c == K["async"] and n not in ends and not self.group(PAREN, self.i + 1):
            self.i += 1
            is_async = True
        elif c in (K["get"], K["set"]) and n not in ends and not self.group(PAREN, self.i + 1):
            self.i += 1
        if self.eat("*"):
            generator = True
        if t[self.i] == PRIV:
            raise Bad
        self.key()
        if self.eat(":"):
            if is_async or generator:
                raise Bad
            self.assign()
            return
        self.type_parameters()
        self.parens(PARAMS, 255)
        self.return_type()
        self.body(is_async, generator)

    def class_body(self):
        t = self.t
        while t[self.i] != END:
            if self.eat(";"):
                continue
            self.member()

    def member(self):
        t = self.t
        while t[self.i] == "@":
            self.decorator()
        is_async = generator = abstract = False
        while True:
            c, n = t[self.i], t[self.i + 1]
            plain = n in ("=", ";", END, ":", "?", "!", "<") or self.group(PAREN, self.i + 1)
            if c == K["static"]:
                if self.group(CURLY, self.i + 1):
                    self.i += 1
                    self.body(False, False)
                    return
                if plain:
                    break
                self.i += 1
            elif c in (K["async"], K["get"], K["set"], K["accessor"]) and not plain and not (self.i + 1 in self.nl):
                is_async |= c == K["async"]
                self.i += 1
            elif self.ts and c in MODIFIERS and not plain:
                abstract |= c in (K["abstract"], K["declare"])
                self.i += 1
            else:
                break
        if self.eat("*"):
            generator = True
        if self.ts and self.group(INDEXSIG) and t[self.i + 1] == ":":
            self.i += 2
            self.type()
            self.semicolon()
            return
        self.key()
        if self.ts:
            if not self.eat("?"):
                self.eat("!")
        if self.group(PARAMS) and self.is_parens() or t[self.i] == "<" and self.ts:
            self.type_parameters()
            self.parens(PARAMS, 255)
            self.return_type()
            if self.ts and not self.group(BLOCK):
                self.semicolon()
                return
            self.body(is_async, generator)
            return
        if is_async or generator:
            raise Bad
        if self.ts and self.eat(":"):
            self.type()
        if self.eat("="):
            old, self.flags = self.flags, 0
            self.assign()
            if self.flags & (AWAIT | YIELD):
                raise Bad
            self.flags = old
        self.semicolon()

    def is_parens(self) -> bool:
        k = self.kind.get(self.t[self.i])
        return k is not None and bool(k[0] & PARAMS) and bool(k[0] & PAREN)

    # -- types
    def return_type(self):
        if self.ts and self.eat(":"):
            if self.t[self.i] == K["asserts"] and self.t[self.i + 1] in NAMES | {K["this"]} and self.i + 1 not in self.nl:
                self.i += 2
                if self.eat(K["is"]):
                    self.type()
                return
            self.type()

    def type_parameters(self):
        if not self.ts or self.t[self.i] != "<":
            return
        self.i += 1
        while True:
            while self.t[self.i] in (K["const"], K["in"], K["out"]) and self.t[self.i + 1] in NAMES:
                self.i += 1
            self.name()
            if self.eat(K["extends"]):
                self.type()
            if self.eat("="):
                self.type()
            if self.eat(","):
                if self.t[self.i] == ">":
                    break
                continue
            break
        self.need(">")

    def type_arguments(self):
        if not self.ts or self.t[self.i] != "<":
            return
        self.i += 1
        self.type()
        while self.eat(","):
            self.type()
        self.need(">")

    def type(self):
        self.union()
        t = self.t
        if t[self.i] == K["is"] and self.i not in self.nl:
            self.i += 1
            self.type()
        elif t[self.i] == K["extends"] and self.i not in self.nl:
            start, flags = self.i, self.flags
            self.i += 1
            try:
                self.union()
                self.need("?")
                self.type()
                self.need(":")
                self.type()
            except Bad:
                self.i, self.flags = start, flags

    def union(self):
        if self.t[self.i] in ("|", "&"):
            self.i += 1
        self.type_operand()
        while self.t[self.i] in ("|", "&"):
            self.i += 1
            self.type_operand()

    def type_operand(self):
        t, c = self.t, self.t[self.i]
        n = t[self.i + 1]
        starts = n in ALL_WORDS or n in (STR, NUM, TPL) or self.kind.get(n) is not None
        if c in (K["keyof"], K["readonly"], K["unique"], K["infer"]) and starts and self.i + 1 not in self.nl:
            self.i += 1
            self.type_operand()
            if c == K["infer"] and t[self.i] == K["extends"]:
                i = self.i
                self.i += 1
                self.type_operand()
                if t[self.i] == "?":
                    self.i = i
            return
        if c == K["abstract"] and n == K["new"]:
            self.i += 1
            c = K["new"]
        if c == K["new"]:
            self.i += 1
            self.type_parameters()
            self.parens(PARAMS, 255)
            self.need(O["=>"])
            self.type()
            return
        if c == "<":
            self.type_parameters()
            self.parens(PARAMS, 255)
            self.need(O["=>"])
            self.type()
            return
        k = self.kind.get(c)
        if k is not None:
            if k[0] & PARAMS and n == O["=>"] and self.is_parens():
                self.i += 2
                if t[self.i] == K["asserts"] and t[self.i + 1] in NAMES:
                    self.i += 1
                self.type()
                return
            if k[0] & (MEMBERS | TYPE):
                self.i += 1
            else:
                raise Bad
        elif c == K["typeof"]:
            self.i += 1
            if self.eat(K["import"]):
                self.take(ARGS)
            else:
                self.word()
            self.names()
            self.type_arguments_here()
        elif c == K["import"]:
            self.i += 1
            self.take(ARGS)
            self.names()
            self.type_arguments_here()
        elif c == "-" and n == NUM:
            self.i += 2
        elif c in (STR, NUM, K["true"], K["false"], K["null"], K["void"], K["this"]):
            self.i += 1
        elif c == TPL:
            self.i += 1
            while self.kind.get(t[self.i]) is not None and self.is_part():
                self.i += 1
        elif c in NAMES:
            self.i += 1
            self.names()
            self.type_arguments_here()
        else:
            raise Bad
        while self.i not in self.nl:
            k = self.kind.get(t[self.i])
            if k is not None and k[0] & TYPE and k[0] & SQUARE:
                self.i += 1
            else:
                return

    def names(self):
        while self.t[self.i] == ".":
            self.i += 2

    def type_arguments_here(self):
        if self.t[self.i] == "<" and self.i not in self.nl:
            self.type_arguments()

    def tuple_type(self):
        t = self.t
        while t[self.i] != END:
            self.eat(O["..."])
            if t[self.i] in ALL_WORDS and (t[self.i + 1] == ":" or t[self.i + 1] == "?" and t[self.i + 2] == ":"):
                self.i += 1
                self.eat("?")
                self.need(":")
            self.type()
            self.eat("?")
            if t[self.i] == END:
                return
            self.need(",")

    def index_signature(self):
        """[key: type] or [K in T as U]."""
        self.name()
        if self.eat(":"):
            self.type()
        else:
            self.need(K["in"])
            self.type()
            if self.eat(K["as"]):
                self.type()

    def enum_body(self):
        t = self.t
        while t[self.i] != END:
            self.key()
            if self.eat("="):
                self.assign()
            if t[self.i] == END:
                return
            self.need(",")

    def type_members(self):
        t = self.t
        while t[self.i] != END:
            if t[self.i] in ("+", "-") and t[self.i + 1] == K["readonly"]:
                self.i += 1
            n = t[self.i + 1]
            if t[self.i] in (K["readonly"], K["get"], K["set"]) and (n in KEYS or self.group(SQUARE, self.i + 1)):
                self.i += 1
            if t[self.i] == K["new"] and (self.group(PAREN, self.i + 1) or n == "<"):
                self.i += 1
            if self.is_parens() or t[self.i] == "<":
                self.type_parameters()
                self.parens(PARAMS, 255)
                self.return_type()
            else:
                if self.group(INDEXSIG):
                    self.i += 1
                else:
                    self.key()
                if t[self.i] in ("+", "-"):
                    self.i += 1
                    if t[self.i] != "?":
                        raise Bad
                self.eat("?")
                if self.is_parens() or t[self.i] == "<":
                    self.type_parameters()
                    self.parens(PARAMS, 255)
                self.return_type()
            if t[self.i] in (",", ";"):
                self.i += 1
            elif t[self.i] != END and self.i not in self.nl:
                raise Bad


LITERALS = {NUM, STR, REGEX, K["this"], K["null"], K["true"], K["false"]}
MODIFIERS = {K[w] for w in ("public", "private", "protected", "readonly", "override", "abstract", "declare", "accessor")}
P = Parser
STATEMENTS = {
    ";": P.empty_, K["if"]: P.if_, K["while"]: P.while_, K["do"]: P.do_, K["for"]: P.for_, K["break"]: P.jump_, K["continue"]: P.jump_, K["return"]: P.return_,
    K["throw"]: P.throw_, K["try"]: P.try_, K["switch"]: P.switch_, K["debugger"]: P.debugger_, K["var"]: P.var_, K["let"]: P.var_, K["const"]: P.var_,
    K["function"]: P.function_, K["async"]: P.async_, K["class"]: P.class_, "@": P.decorator_, K["import"]: P.import_, K["export"]: P.export_, K["type"]: P.type_,
    K["interface"]: P.interface_, K["enum"]: P.enum_, K["namespace"]: P.namespace_, K["module"]: P.namespace_, K["declare"]: P.declare_, K["abstract"]: P.abstract_,
}
EXPORTED = {P.var_, P.function_, P.async_, P.class_, P.decorator_}
TS_EXPORTED = {K[w] for w in ("type", "interface", "enum", "namespace", "module", "declare", "abstract", "import")}
DECLARABLE = {K[w] for w in ("var", "let", "const", "function", "async", "class", "enum", "type", "interface", "namespace", "module", "abstract", "global")}


def tokens_of(text: str, jsx: bool) -> str | None:
    """What ``check_tokens`` wants; None if the lexer does not take the text."""
    try:
        return finish(Lexer(text, jsx).run())
    except Bad:
        return None
