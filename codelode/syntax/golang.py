"""Go source files."""

from __future__ import annotations

import re

from codelode.syntax.groups import Bad, Groups

# ---- tokens: fixed values ----
WORDS = """break case chan const continue default defer else fallthrough for func go goto if import interface map package range return
select struct switch type var""".split()
K = {w: chr(0xE100 + i) for i, w in enumerate(WORDS)}
OPS = ["<<=", ">>=", "&^=", "...", "&&", "||", "<-", "++", "--", "==", "!=", "<=", ">=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", ">>", "&^"]
O = {o: chr(0xE200 + i) for i, o in enumerate(OPS)}
NAME, NUM, STR, END = "a", "0", chr(0xE300), "\x00"
BOM = chr(0xFEFF)
HARD = re.compile(r"""["'`]|//|/\*""")
STRING = re.compile(r'"(?:[^"\\\n]|\\[^\n])*"')
RUNE = re.compile(r"'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))'")
WORDLIKE = re.compile(r"\w(?:(?<=[0-9])(?:\w|\.|(?<=[eEpP])[+-])*|(?<![0-9])\w*)")
NUMBER = re.compile(r"(?:0[xX](?:_?[\da-fA-F])*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO]?(?:_?[0-7])+|\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d+)?)i?$")
MARKS = sorted(O.items(), key=lambda x: -len(x[0]))
ENDS = "".join([NAME, NUM, STR, ")", r"\]", "}", O["++"], O["--"], K["break"], K["continue"], K["fallthrough"], K["return"]])
SEMI = re.compile(rf"(?<=[{ENDS}])\n+")

EXPR, ARGS, PARAMS, TYPE, IMPORTS, CONSTS, VARS, TYPES, TYPESWITCH, INDEX, TYPEPARAMS, BLOCK, LITERAL, FIELDS, IFACE, SWITCH, SELECT, PAREN, SQUARE, CURLY, EMPTY, DOTS = (1 << i for i in range(22))
BINARY = {O["||"]: 1, O["&&"]: 2, **{o: 3 for o in (O["=="], O["!="], "<", O["<="], ">", O[">="])}, **{o: 4 for o in "+-|^"}, **{o: 5 for o in ("*", "/", "%", O["<<"], O[">>"], "&", O["&^"])}}
UNARY = set("+-!^*&") | {O["<-"], "~"}
ASSIGN = {"=", O[":="], *(O[o] for o in ("<<=", ">>=", "&^=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="))}


def _token(m):
    w = m.group()
    c = K.get(w)
    if c is not None:
        return c
    if "0" <= w[0] <= "9":
        if NUMBER.match(w):
            return NUM
        raise Bad("number")
    return NAME


def lex(s: str) -> str:
    s = s.removeprefix(BOM).replace("\r\n", "\n")
    out, i, n = [], 0, len(s)
    while True:
        m = HARD.search(s, i)
        if m is None:
            out.append(s[i:])
            break
        j, c = m.start(), m.group()
        out.append(s[i:j])
        if c == "//":
            i = s.find("\n", j)
            i = n if i < 0 else i
        elif c == "/*":
            k = s.find("*/", j + 2)
            if k < 0:
                raise Bad("comment")
            out.append("\n" if "\n" in s[j:k] else " ")
            i = k + 2
        elif c == "`":
            k = s.find("`", j + 1)
            if k < 0:
                raise Bad("string")
            out.append(STR)
            i = k + 1
        else:
            m = (STRING if c == '"' else RUNE).match(s, j)
            if m is None:
                raise Bad("string")
            out.append(STR)
            i = m.end()
    t = WORDLIKE.sub(_token, "".join(out))
    t = re.sub(r"\.0", "0", t) if ".0" in t else t
    for o, c in MARKS:
        if o in t:
            t = t.replace(o, c)
    t = t.replace(" ", "").replace("\t", "").replace("\r", "").replace("\f", "")
    t = SEMI.sub(";", t + "\n").replace("\n", "")
    if re.search(r"[@#$?\\'\"`]", t):
        raise Bad("token")
    return t


#: every file begins with its package; comments and white space may stand before it
PACKAGE = re.compile(rf"{BOM}?(?:\s|//[^\n]*(?:\n|$)|/\*(?:[^*]|\*(?!/))*\*/)*package(?![^\W])")


class Grammar:
    def __init__(self, name: str = "go"):
        self.groups = Groups(self.classify)
        self.statements: dict[str, bool] = {}

    def check(self, text: str) -> bool:
        try:
            if not text.strip(BOM + " \t\r\n"):
                return True
            if not PACKAGE.match(text):
                return False
            t = self.groups.fold(lex(text))
            p = Parser(self, t)
            p.file()
            return True
        except (Bad, RecursionError):
            return False

    def classify(self, g: str):
        inside, b = g[1:-1], g[0]
        roles = 0

        def attempt(role, f, *args):
            nonlocal roles
            p = Parser(self, inside)
            try:
                f(p, *args)
                p.at_end()
            except (Bad, RecursionError):
                return
            roles |= role

        if b == "(":
            shape = PAREN
            if not inside:
                roles = ARGS | PARAMS | IMPORTS | CONSTS | VARS | TYPES
            elif inside == K["type"]:
                roles = TYPESWITCH
            else:
                attempt(ARGS, Parser.arguments)
                attempt(EXPR, Parser.expression)
                attempt(TYPE, Parser.type)
                attempt(PARAMS, Parser.parameters)
                attempt(IMPORTS, Parser.specs, Parser.import_spec)
                attempt(CONSTS, Parser.specs, Parser.const_spec)
                attempt(VARS, Parser.specs, Parser.var_spec)
                attempt(TYPES, Parser.specs, Parser.type_spec)
        elif b == "[":
            shape = SQUARE
            if not inside:
                roles = EMPTY
            elif inside == O["..."]:
                roles = DOTS
            else:
                attempt(INDEX, Parser.index)
                attempt(TYPEPARAMS, Parser.type_parameters)
        else:
            shape = CURLY
            if not inside:
                roles = BLOCK | LITERAL | FIELDS | IFACE | SWITCH | SELECT
            elif inside[0] in (K["case"], K["default"]):
                attempt(SWITCH, Parser.clauses, False)
                attempt(SELECT, Parser.clauses, True)
            else:
                attempt(BLOCK, Parser.statement_list)
                attempt(LITERAL, Parser.literal)
                attempt(FIELDS, Parser.fields)
                attempt(IFACE, Parser.interface)
        return roles | shape if roles else None


class Parser:
    def __init__(self, g: Grammar, text: str):
        self.g, self.kind, self.t, self.i = g, g.groups.kind, text + END * 4, 0
        self.header = False

    def at_end(self):
        if self.i != len(self.t) - 4:
            raise Bad

    def eat(self, c):
        if self.t[self.i] == c:
            self.i += 1
            return True
        return False

    def need(self, c):
        if self.t[self.i] != c:
            raise Bad
        self.i += 1

    def is_(self, roles, at=0):
        k = self.kind.get(self.t[self.i + at])
        return k is not None and bool(k & roles)

    def take(self, roles):
        if not self.is_(roles):
            raise Bad
        self.i += 1

    def maybe(self, f, *args):
        i = self.i
        try:
            f(*args)
            return True
        except Bad:
            self.i = i
            return False

    # declarations
    def file(self):
        self.need(K["package"])
        self.need(NAME)
        self.end_of_statement()
        while self.t[self.i] == K["import"]:
            self.i += 1
            if self.is_(PAREN):
                self.take(IMPORTS)
            else:
                self.import_spec()
            self.end_of_statement()
        while self.t[self.i] != END:
            if self.eat(K["func"]):
                if self.is_(PAREN):
                    self.take(PARAMS)
                self.need(NAME)
                if self.is_(TYPEPARAMS):
                    self.i += 1
                self.signature()
                if self.is_(CURLY):
                    self.take(BLOCK)
            elif not self.declaration():
                raise Bad
            self.end_of_statement()
        self.at_end()

    def end_of_statement(self):
        if self.t[self.i] != END:
            self.need(";")

    def declaration(self):
        c = self.t[self.i]
        for word, role, spec in ((K["const"], CONSTS, self.const_spec), (K["var"], VARS, self.var_spec), (K["type"], TYPES, self.type_spec)):
            if c == word:
                self.i += 1
                if self.is_(PAREN):
                    self.take(role)
                else:
                    spec()
                return True
        return False

    def specs(self, spec):
        while self.t[self.i] != END:
            spec(self)
            self.end_of_statement()

    def import_spec(self):
        if self.t[self.i] in (NAME, "."):
            self.i += 1
        self.need(STR)

    def names(self):
        self.need(NAME)
        while self.eat(","):
            self.need(NAME)

    def const_spec(self):
        self.names()
        if self.t[self.i] not in (";", END):
            if self.t[self.i] != "=":
                self.type()
            self.need("=")
            self.expressions()

    def var_spec(self):
        self.names()
        if self.t[self.i] != "=":
            self.type()
            if self.t[self.i] != "=":
                return
        self.need("=")
        self.expressions()

    def type_spec(self):
        self.need(NAME)
        if self.is_(TYPEPARAMS) and self.maybe(self.generic_spec):
            return
        self.eat("=")
        self.type()

    def generic_spec(self):
        self.i += 1
        self.type()

    # types
    def type(self):
        t, c = self.t, self.t[self.i]
        if c == NAME:
            self.i += 1
            if self.eat("."):
                self.need(NAME)
            if self.is_(SQUARE) and self.is_(INDEX) and not self.header:
                self.i += 1
        elif c == "*":
            self.i += 1
            self.type()
        elif c == K["map"]:
            self.i += 1
            if not self.is_(SQUARE):
                raise Bad
            self.take(INDEX)
            self.type()
        elif c == K["chan"]:
            self.i += 1
            self.eat(O["<-"])
            self.type()
        elif c == O["<-"] and t[self.i + 1] == K["chan"]:
            self.i += 2
            self.type()
        elif c == K["func"]:
            self.i += 1
            self.signature()
        elif c == K["struct"]:
            self.i += 1
            self.take(FIELDS)
        elif c == K["interface"]:
            self.i += 1
            self.take(IFACE)
        elif self.is_(SQUARE):
            self.take(EMPTY | DOTS | INDEX)
            self.type()
        elif self.is_(PAREN):
            self.take(TYPE)
        else:
            raise Bad

    def type_starts(self):
        c = self.t[self.i]
        return c in (NAME, "*", K["map"], K["chan"], O["<-"], K["func"], K["struct"], K["interface"]) or self.is_(SQUARE) or self.is_(PAREN)

    def signature(self):
        if not self.is_(PAREN):
            raise Bad
        self.take(PARAMS)
        if self.is_(PAREN):
            self.take(PARAMS)
        elif self.type_starts():
            self.type()

    def parameters(self):
        while self.t[self.i] != END:
            if self.eat(O["..."]):
                self.type()
            elif self.t[self.i] == NAME and self.t[self.i + 1] == O["..."]:
                self.i += 2
                self.type()
            else:
                i = self.i
                try:
                    self.need(NAME)
                    self.type()
                    if self.t[self.i] not in (",", END):
                        raise Bad
                except Bad:
                    self.i = i
                    self.type()
            if self.t[self.i] == END:
                return
            self.need(",")

    def type_parameters(self):
        while self.t[self.i] != END:
            self.names()
            self.constraint()
            if self.t[self.i] == END:
                return
            self.need(",")

    def constraint(self):
        self.eat("~")
        self.type()
        while self.eat("|"):
            self.eat("~")
            self.type()

    def fields(self):
        while self.t[self.i] != END:
            i = self.i
            try:
                self.names()
                self.type()
            except Bad:
                self.i = i
                self.type()
            self.eat(STR)
            self.end_of_statement()

    def interface(self):
        while self.t[self.i] != END:
            if self.t[self.i] == NAME and self.is_(PAREN, 1):
                self.i += 1
                self.signature()
            else:
                self.constraint()
            self.end_of_statement()

    # expressions
    def expressions(self):
        self.expression()
        while self.eat(","):
            self.expression()

    def expression(self, least=0):
        self.unary()
        while True:
            p = BINARY.get(self.t[self.i])
            if p is None or p <= least:
                return
            self.i += 1
            self.expression(p)

    def unary(self):
        c = self.t[self.i]
        if c == O["<-"] and self.t[self.i + 1] == K["chan"]:
            pass
        elif c in UNARY:
            self.i += 1
            self.unary()
            return
        self.primary()

    def primary(self):
        t, c = self.t, self.t[self.i]
        composite = False
        if c == NAME:
            self.i += 1
            composite = not self.header
        elif c in (NUM, STR):
            self.i += 1
        elif c == K["func"]:
            self.i += 1
            self.signature()
            if self.is_(CURLY):
                self.take(BLOCK)
        elif self.is_(PAREN):
            self.take(EXPR | TYPE)
        elif self.is_(SQUARE) or c in (K["map"], K["chan"], K["struct"], K["interface"], O["<-"]):
            header, self.header = self.header, False
            self.type()
            self.header = header
            composite = True
            if not (self.is_(LITERAL) or self.is_(ARGS)):
                raise Bad
        else:
            raise Bad
        while True:
            c = t[self.i]
            if c == ".":
                self.i += 1
                if self.is_(PAREN):
                    self.take(TYPE | TYPESWITCH)
                else:
                    self.need(NAME)
            elif self.is_(SQUARE):
                self.take(INDEX)
            elif self.is_(PAREN):
                self.take(ARGS)
                composite = False
            elif composite and self.is_(CURLY):
                self.take(LITERAL)
                composite = False
            else:
                return

    def arguments(self):
        while self.t[self.i] != END:
            if not (self.maybe(self.argument)):
                self.type()
            if self.eat(O["..."]):
                self.eat(",")
                return
            if self.t[self.i] == END:
                return
            self.need(",")

    def argument(self):
        self.expression()
        if self.t[self.i] not in (",", END, O["..."]):
            raise Bad

    def index(self):
        t = self.t
        if ":" in t:
            if t[self.i] != ":":
                self.expression()
            self.need(":")
            if t[self.i] not in (":", END):
                self.expression()
                if self.eat(":"):
                    self.expression()
            return
        while t[self.i] != END:
            if not self.maybe(self.argument):
                self.type()
            if t[self.i] == END:
                return
            self.need(",")

    def literal(self):
        while self.t[self.i] != END:
            self.element()
            if self.eat(":"):
                self.element()
            if self.t[self.i] == END:
                return
            self.need(",")

    def element(self):
        if self.is_(CURLY):
            self.take(LITERAL)
        else:
            self.expression()

    # statements
    def statement_list(self):
        known, t = self.g.statements, self.t[self.i : -4]
        if not self.i:
            for part in t.split(";"):
                ok = known.get(part)
                if ok is None:
                    p = Parser(self.g, part)
                    try:
                        p.statement()
                        p.at_end()
                        ok = True
                    except (Bad, RecursionError):
                        ok = False
                    if len(part) < 400:
                        if len(known) > 100_000:
                            known.clear()
                        known[part] = ok
                if not ok:
                    break
            else:
                self.i = len(self.t) - 4
                return
        self.statements()

    def statements(self, stop=()):
        while self.t[self.i] != END and self.t[self.i] not in stop:
            self.statement()
            if self.t[self.i] in stop:
                return
            self.end_of_statement()

    def statement(self):
        t, c = self.t, self.t[self.i]
        if c in (";", END):
            return
        if self.declaration():
            return
        if c == K["return"]:
            self.i += 1
            if t[self.i] not in (";", END, K["case"], K["default"]):
                self.expressions()
        elif c == K["if"]:
            self.if_()
        elif c == K["for"]:
            self.for_()
        elif c == K["switch"]:
            self.i += 1
            self.headers(SWITCH)
            self.take(SWITCH)
        elif c == K["select"]:
            self.i += 1
            self.take(SELECT)
        elif c in (K["go"], K["defer"]):
            self.i += 1
            self.expression()
        elif c in (K["break"], K["continue"], K["goto"]):
            self.i += 1
            if not self.eat(NAME) and c == K["goto"]:
                raise Bad
        elif c == K["fallthrough"]:
            self.i += 1
        elif self.is_(CURLY):
            self.take(BLOCK)
        elif c == NAME and t[self.i + 1] == ":":
            self.i += 2
            if t[self.i] not in (END,):
                self.statement()
        else:
            self.simple()

    def simple(self, ranged=False):
        t = self.t
        if ranged and self.eat(K["range"]):
            self.expression()
            return
        self.expressions()
        c = t[self.i]
        if c in ASSIGN:
            self.i += 1
            if ranged and self.eat(K["range"]):
                self.expression()
            else:
                self.expressions()
        elif c in (O["++"], O["--"]):
            self.i += 1
        elif c == O["<-"]:
            self.i += 1
            self.expression()

    def headers(self, role):
        """[simple;] [simple] before the braces."""
        self.header = True
        if not self.is_(CURLY):
            if self.t[self.i] != ";":
                self.simple()
            if self.eat(";") and not self.is_(CURLY):
                self.simple()
        self.header = False

    def if_(self):
        self.i += 1
        self.header = True
        if self.t[self.i] != ";":
            self.simple()
        if self.eat(";"):
            self.expression()
        self.header = False
        self.take(BLOCK)
        if self.eat(K["else"]):
            if self.t[self.i] == K["if"]:
                self.if_()
            else:
                self.take(BLOCK)

    def for_(self):
        self.i += 1
        self.header = True
        if not self.is_(CURLY):
            if self.t[self.i] != ";":
                self.simple(True)
            if self.eat(";"):
                if self.t[self.i] != ";":
                    self.expression()
                self.need(";")
                if not self.is_(CURLY):
                    self.simple()
        self.header = False
        self.take(BLOCK)

    def clauses(self, select):
        while self.t[self.i] != END:
            if not self.eat(K["default"]):
                self.need(K["case"])
                if select:
                    self.simple()
                else:
                    self.case_item()
                    while self.eat(","):
                        self.case_item()
            self.need(":")
            self.statements((K["case"], K["default"]))

    def case_item(self):
        i = self.i
        try:
            self.expression()
            if self.t[self.i] not in (",", ":"):
                raise Bad
        except Bad:
            self.i = i
            self.type()
