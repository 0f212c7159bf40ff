"""SQL scripts: data definition, data manipulation and queries of the usual dialects."""

from __future__ import annotations

import re

from codelode.syntax.groups import Bad

BOM = chr(0xFEFF)
TOKEN = re.compile(
    r"""\s+|--[^\n]*|/\*.*?\*/|(?P<s>[eEnNbBxX]?'(?:[^']|'')*'|\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)|(?P<q>"(?:[^"]|"")+"|`[^`]+`|\[[A-Za-z_][\w ]*\])|(?P<n>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?(?!\w))|(?P<w>[^\W\d][\w$]*)|(?P<p>[:@?$]\w*)(?=[\s,;)=]|$)|(?P<o>::|<=>|<>|!=|<=|>=|\|\||->>|->|:=|[-+*/%<>=(),.;\[\]~&|^#])""",
    re.S,
)
# fixed values: words that are no plain names
RESERVED = set("""select from where group having order limit union intersect except insert update delete create drop alter table values into set
join on using and or not in is null as case when then else end between exists all any some distinct primary foreign references check unique
constraint default with by cross inner natural full left right""".split())
BINARY = {"or": 1, "and": 2, "=": 4, "<>": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "<=>": 4, "|": 5, "&": 5, "#": 5, "^": 5, "||": 6, "->": 6, "->>": 6, "~": 4, "+": 7, "-": 7, "*": 8, "/": 8, "%": 8, ":=": 1}
#: statements with an inner language or forms of one dialect each: any tokens with closed parentheses are taken
LOOSE = set("copy pragma attach detach optimize load unload cluster go do declare prepare".split())
LOOSE_CREATE = set("""function procedure trigger database schema role user extension sequence type domain policy aggregate operator collation publication
subscription server language rule event cast""".split())


def tokens(text: str) -> list[str]:
    out, i, n = [], 0, len(text)
    while i < n:
        m = TOKEN.match(text, i)
        if m is None:
            raise Bad("token")
        i = m.end()
        k = m.lastgroup
        if k is None:
            continue
        if k == "w":
            w = m.group().lower()
            out.append(w)
        elif k in ("s", "tag"):
            out.append("'")
        elif k == "q":
            out.append('"')
        elif k == "n":
            out.append("0")
        elif k == "p":
            out.append("?")
        else:
            out.append(m.group())
    return out


#: what stands before the first word, and it; no word where a script begins with something else
BEGIN = re.compile(r"(?:\s|--[^\n]*(?:\n|$)|/\*(?:[^*]|\*(?!/))*\*/|;)*([^\W\d][\w$]*)?")


class Grammar:
    def __init__(self, name: str = "sql"):
        pass

    def check(self, text: str) -> bool:
        try:
            text = text.removeprefix(BOM)
            first = BEGIN.match(text)
            word = first.group(1).lower() if first and first.group(1) else None
            if word is not None and word not in STATEMENTS:
                return False  # the rest need not be looked at
            t = tokens(text)
            start = 0
            while start < len(t):
                try:
                    end = t.index(";", start)
                except ValueError:
                    end = len(t)
                if end > start:
                    Parser(t[start:end]).statement()
                start = end + 1
            return True
        except (Bad, RecursionError):
            return False


class Parser:
    def __init__(self, t: list[str]):
        self.t, self.i = t + [""] * 4, 0

    def done(self):
        if self.i != len(self.t) - 4:
            raise Bad

    def eat(self, *words):
        if self.t[self.i : self.i + len(words)] == list(words):
            self.i += len(words)
            return True
        return False

    def need(self, *words):
        if not self.eat(*words):
            raise Bad

    def is_name(self, at=0):
        w = self.t[self.i + at]
        return w == '"' or (w[:1].isalpha() or w[:1] == "_") and w not in RESERVED

    def name(self):
        """A name, perhaps with prefixes."""
        if not self.is_name():
            raise Bad
        self.i += 1
        while self.t[self.i] == "." and self.t[self.i + 1] != "*":
            self.i += 1
            if not (self.is_name() or self.t[self.i][:1].isalpha()):
                raise Bad
            self.i += 1

    def list(self, f):
        f()
        while self.eat(","):
            f()

    def in_parens(self, f):
        self.need("(")
        self.list(f)
        self.need(")")

    def balanced(self):
        """The rest, with closed parentheses."""
        depth = 0
        while self.i < len(self.t) - 4:
            depth += {"(": 1, ")": -1}.get(self.t[self.i], 0)
            if depth < 0:
                raise Bad
            self.i += 1
        if depth:
            raise Bad

    def statement(self):
        w = self.t[self.i]
        if w in ("select", "with", "values", "("):
            self.query()
        elif w == "create":
            self.create()
        elif w == "insert":
            self.insert()
        elif w == "update":
            self.with_where(self.update)
        elif w == "delete":
            self.with_where(self.delete)
        elif w == "drop":
            self.i += 1
            if not self.t[self.i].isalpha():
                raise Bad
            self.i += 1
            self.eat("concurrently")
            self.eat("if", "exists")
            self.list(self.name)
            while self.eat("on"):
                self.name()
            while self.eat("cascade") or self.eat("restrict") or self.eat("purge"):
                pass
            if w == "drop" and self.t[self.i] == "(":
                self.in_parens(self.type)  # of a function
        elif w == "alter":
            self.i += 1
            if not self.t[self.i].isalpha():
                raise Bad
            self.i += 1
            self.eat("if", "exists")
            self.eat("only")
            self.name()
            if self.i == len(self.t) - 4:
                raise Bad
            if self.eat("add"):
                self.eat("column")
                self.eat("if", "not", "exists")
                self.table_item()
                while self.eat(","):
                    self.need("add")
                    self.eat("column")
                    self.table_item()
            else:
                self.balanced()
        elif w in OTHER:
            self.i += 1
            OTHER[w](self)
        elif w in LOOSE:
            self.i += 1
            self.balanced()
        else:
            raise Bad
        self.done()

    def with_where(self, f):
        f()

    def create(self):
        self.i += 1
        self.eat("or", "replace")
        while self.t[self.i] in ("temp", "temporary", "unlogged", "global", "local", "unique", "materialized", "external", "recursive", "clustered"):
            self.i += 1
        w = self.t[self.i]
        self.i += 1
        if w == "table":
            self.eat("if", "not", "exists")
            self.name()
            if self.eat("as"):
                self.query()
                return
            self.in_parens(self.table_item)
            if not self.eat("as"):
                self.table_options()
                if not self.eat("as"):
                    return
            self.query()
        elif w == "view":
            self.eat("if", "not", "exists")
            self.name()
            if self.t[self.i] == "(":
                self.in_parens(self.name)
            if self.eat("with"):
                self.in_parens(self.option)
            self.need("as")
            self.query()
            if self.eat("with"):
                while self.t[self.i].isalpha():
                    self.i += 1
        elif w == "index":
            self.eat("concurrently")
            self.eat("if", "not", "exists")
            if self.t[self.i] != "on":
                self.name()
            self.need("on")
            self.name()
            if self.eat("using"):
                self.name()
            self.in_parens(self.ordered)
            if self.eat("include"):
                self.in_parens(self.name)
            if self.eat("with"):
                self.in_parens(self.option)
            if self.eat("tablespace"):
                self.name()
            if self.eat("where"):
                self.expression()
        elif w in LOOSE_CREATE:
            if self.i == len(self.t) - 4:
                raise Bad
            self.balanced()
        else:
            raise Bad

    def at_end(self):
        return self.i >= len(self.t) - 4

    def plain(self):
        """One value of an option: a name, word, number or string."""
        if self.t[self.i] in ("-", "+"):
            self.i += 1
        if not (self.t[self.i] in ("'", "0", '"', "?") or self.t[self.i][:1].isalpha()):
            raise Bad
        self.i += 1

    def option(self):
        self.name() if self.t[self.i] != "'" else self.plain()
        if self.eat("="):
            self.plain()

    def words(self, allowed: str):
        """Words of the list, at least one."""
        known, at = allowed.split(), self.i
        while self.t[self.i] in known:
            self.i += 1
        if self.i == at:
            raise Bad

    def table_options(self):
        """What may stand behind the columns of a table."""
        while not self.at_end() and self.t[self.i] != "as":
            w = self.t[self.i]
            self.i += 1
            if w == "with":
                self.in_parens(self.option)
            elif w == "without":
                self.words("oids rowid")
            elif w in ("partition", "partitioned", "cluster", "clustered", "distributed", "sorted", "order", "subpartition"):
                self.need("by")
                while self.t[self.i] in ("range", "list", "hash", "key", "linear", "columns"):
                    self.i += 1
                if self.t[self.i] == "(":
                    self.in_parens(self.partition_key)
                elif not self.eat("random"):
                    self.name()
                if self.eat("into"):
                    self.need("0", "buckets")
            elif w == "inherits":
                self.in_parens(self.name)
            elif w == "on":
                self.need("commit")
                self.words("preserve delete rows drop")
            elif w == "stored":
                self.need("as")
                self.name()
            elif w in ("tblproperties", "options"):
                self.in_parens(self.option)
            elif w == "strict":
                pass
            elif w == "default" or w == "character":
                if w == "default" and not (self.eat("charset") or self.eat("collate")):
                    self.need("character")
                    self.need("set")
                elif w == "character":
                    self.need("set")
                self.eat("=")
                self.plain()
            elif w in ("tablespace", "using", "comment", "location", "engine", "charset", "collate") or self.t[self.i] == "=" and w[:1].isalpha():
                self.eat("=")
                self.plain()
            else:
                raise Bad
            if self.eat(",") and self.at_end():
                raise Bad

    def partition_key(self):
        self.expression()
        if not self.t[self.i] in (",", ")"):
            self.type()

    # statements of other kinds, behind their first word
    def grant(self):
        if self.eat("grant", "option") or self.eat("admin", "option"):
            self.need("for")
        self.list(self.privilege)
        if self.eat("on"):
            if self.t[self.i] in ("table", "schema", "database", "function", "procedure", "sequence", "type", "language", "domain", "tablespace", "all"):
                self.i += 1
                if self.t[self.i - 1] == "all":
                    self.words("tables sequences functions procedures routines in schema")
            self.list(self.granted)
        if not self.eat("to"):
            self.need("from")
        self.list(self.role)
        if self.eat("with"):
            self.words("grant admin option")
        if self.eat("cascade") or self.eat("restrict"):
            pass

    def privilege(self):
        at = self.i
        while self.t[self.i][:1].isalpha() and self.t[self.i] not in ("on", "to", "from"):
            self.i += 1
        if not 0 < self.i - at <= 3:
            raise Bad
        if self.t[self.i] == "(":
            self.in_parens(self.name)

    def granted(self):
        if self.eat("*"):
            if self.eat("."):
                self.need("*")
            return
        self.name()
        if self.eat("."):
            self.need("*")
        if self.t[self.i] == "(":
            self.i += 1
            if not self.eat(")"):
                self.list(self.type)
                self.need(")")

    def role(self):
        self.eat("group") or self.eat("role")
        self.eat("'") or self.name()
        if self.eat("@"):
            self.eat("'") or self.name()

    def comment(self):
        self.need("on")
        self.words("table column view index schema database function procedure sequence type domain constraint trigger role extension materialized foreign policy rule")
        self.name()
        if self.t[self.i] == "(":
            self.granted_arguments()
        if self.eat("on"):
            self.name()
        self.need("is")
        if not self.eat("null"):
            self.need("'")

    def granted_arguments(self):
        self.need("(")
        if not self.eat(")"):
            self.list(self.type)
            self.need(")")

    def merge(self):
        self.eat("into")
        self.source()
        self.need("using")
        self.source()
        self.need("on")
        self.expression()
        while True:
            self.need("when")
            self.eat("not")
            self.need("matched")
            if self.eat("by"):
                self.words("source target")
            if self.eat("and"):
                self.expression()
            self.need("then")
            if self.eat("update"):
                self.need("set")
                self.eat("*") or self.list(self.assignment)
            elif self.eat("insert"):
                if not self.eat("*"):
                    if self.t[self.i] == "(":
                        self.in_parens(self.name)
                    self.need("values")
                    self.row()
            elif not self.eat("delete"):
                self.need("do", "nothing")
            if self.at_end():
                return

    def transaction(self):
        if self.eat("to"):
            self.eat("savepoint")
            self.name()
        elif not self.at_end():
            self.words("transaction work tran isolation level serializable repeatable read committed uncommitted write only immediate deferred exclusive and no chain prepared")
            if self.eat("to"):
                self.eat("savepoint")
                self.name()

    def one_name(self):
        self.eat("savepoint")
        self.name()

    def names(self):
        while self.t[self.i] in ("table", "full", "freeze", "verbose", "analyze", "only", "index", "schema", "database", "system", "concurrently", "materialized", "view", "extended", "formatted"):
            self.i += 1
        if not self.at_end():
            self.list(self.granted)
        while not self.at_end():
            self.words("restart continue identity cascade restrict in access share exclusive mode row update nowait with no data")

    def some_names(self):
        if self.at_end():
            raise Bad
        self.names()

    def explain(self):
        while self.t[self.i] in ("analyze", "verbose", "query", "plan", "for", "extended", "formatted"):
            self.i += 1
        if self.t[self.i] == "(" and self.t[self.i + 1] not in ("select", "with", "("):
            self.in_parens(self.plain_words)
        self.statement()

    def plain_words(self):
        self.plain()
        if self.t[self.i] not in (",", ")"):
            self.plain()

    def set_value(self):
        while self.t[self.i] in ("session", "local", "global"):
            self.i += 1
        if self.eat("time", "zone"):
            return self.plain()
        if self.eat("transaction") or self.eat("characteristics"):
            return self.words("transaction isolation level serializable repeatable read committed uncommitted write only as deferrable not")
        self.eat("@")
        self.name()
        if not (self.eat("=") or self.eat("to") or self.eat(":=")):
            return self.eat("'") or self.words("on off zone authorization default none utc")
        self.list(self.setting)

    def setting(self):
        if not self.eat("on") and not self.eat("default"):
            self.expression()

    def call_statement(self):
        self.name()
        if self.t[self.i] == "(":
            self.call()
        elif not self.at_end():
            self.list(self.value)

    def all_or_names(self):
        self.eat("all") or self.names()
        if self.eat(","):
            self.need("'")

    def show(self):
        while self.t[self.i] in ("create", "table", "from", "in", "like", "all", "tables", "columns", "databases", "schemas", "index", "status", "variables", "full") and not self.at_end():
            self.i += 1
        if not self.at_end():
            self.eat("'") or self.name()
        if not self.at_end():
            self.words("from in like")
            self.eat("'") or self.name()

    def replace(self):
        self.i -= 1
        self.insert()

    def table_item(self):
        w = self.t[self.i]
        if w == "constraint":
            self.i += 1
            self.name()
            w = self.t[self.i]
        if w in ("primary", "foreign", "unique", "check", "exclude") or w in ("key", "index", "fulltext") and self.t[self.i + 1] not in ("int",) and (self.is_name(1) or self.t[self.i + 1] == "(") and self.t[self.i + 2] == "(":
            self.i += 1
            self.attribute_rest(w)
            self.attributes()
            return
        if not (self.is_name() or self.t[self.i][:1].isalpha() and self.t[self.i] not in ("select", "from", "create", "insert", "table")):
            raise Bad
        self.i += 1
        self.type()
        self.attributes()

    def type(self):
        self.name()
        while self.t[self.i] in ("varying", "precision", "unsigned", "zerofill", "large", "object") or self.t[self.i] in ("with", "without") and self.t[self.i + 2] == "zone":
            self.i += 3 if self.t[self.i] in ("with", "without") else 1
        if self.eat("("):
            self.list(self.type_argument)
            self.need(")")
            while self.t[self.i] in ("varying", "unsigned") or self.t[self.i] in ("with", "without") and self.t[self.i + 2] == "zone":
                self.i += 3 if self.t[self.i] in ("with", "without") else 1
        while self.eat("[", "]") or self.eat("array"):
            pass

    def type_argument(self):
        if self.t[self.i] in ("0", "'", "max"):
            self.i += 1
            if self.t[self.i] in ("char", "byte"):
                self.i += 1
        else:
            self.type()

    def attribute_rest(self, w):
        if w == "primary":
            self.need("key")
            if self.t[self.i] == "(":
                self.in_parens(self.ordered)
        elif w == "foreign":
            self.need("key")
            self.in_parens(self.name)
        elif w in ("unique", "key", "index", "fulltext"):
            self.eat("key")
            if self.is_name() and self.t[self.i + 1] == "(":
                self.name()
            if self.t[self.i] == "(":
                self.in_parens(self.ordered)
        elif w == "check":
            self.in_parens(self.expression)
        else:
            depth = 0
            while self.i < len(self.t) - 4 and not (depth == 0 and self.t[self.i] in (",", ")")):
                depth += {"(": 1, ")": -1}.get(self.t[self.i], 0)
                self.i += 1

    def attributes(self):
        while self.t[self.i] not in (",", ")", ""):
            w = self.t[self.i]
            self.i += 1
            if w == "not":
                self.need("null")
            elif w in ("null", "autoincrement", "auto_increment", "asc", "desc", "stored", "virtual", "deferrable", "enforced", "invisible"):
                pass
            elif w == "initially":
                self.i += 1
            elif w in ("primary", "unique", "check"):
                self.attribute_rest(w)
            elif w == "default":
                self.expression(3)
            elif w == "references":
                self.name()
                if self.t[self.i] == "(":
                    self.in_parens(self.name)
            elif w == "on":
                if not (self.eat("delete") or self.eat("update") or self.eat("conflict")):
                    raise Bad
                if self.eat("set"):
                    if not (self.eat("null") or self.eat("default")):
                        raise Bad
                elif self.eat("no"):
                    self.need("action")
                elif self.t[self.i] in ("cascade", "restrict", "rollback", "abort", "fail", "ignore", "replace"):
                    self.i += 1
                else:
                    self.expression()
            elif w in ("collate", "constraint", "comment", "match", "charset", "compression", "encode"):
                if not self.eat("'"):
                    self.name()
            elif w == "character":
                self.need("set")
                self.name()
            elif w in ("generated", "as", "identity", "by", "always"):
                if w == "generated":
                    if not self.eat("always"):
                        self.need("by", "default")
                    self.need("as")
                    self.eat("identity")
                if self.t[self.i] == "(":
                    depth = 0
                    while True:
                        depth += {"(": 1, ")": -1, "": -99}.get(self.t[self.i], 0)
                        if depth < 0:
                            raise Bad
                        self.i += 1
                        if not depth:
                            break
            else:
                raise Bad

    def insert(self):
        self.i += 1
        if self.eat("or"):
            self.i += 1
        self.eat("ignore")
        if not self.eat("into"):
            self.need("overwrite")
        self.eat("table")
        self.name()
        if self.eat("as"):
            self.name()
        if self.t[self.i] == "(" and self.t[self.i + 1] not in ("select", "with"):
            self.in_parens(self.name)
        if self.eat("default", "values"):
            pass
        else:
            self.query()
        if self.eat("on"):
            self.upsert()
        self.returning()

    def upsert(self):
        if self.eat("duplicate"):
            self.need("key", "update")
            self.list(self.assignment)
            return
        self.need("conflict")
        if self.t[self.i] == "(":
            self.in_parens(self.ordered)
            if self.eat("where"):
                self.expression()
        elif self.eat("on"):
            self.need("constraint")
            self.name()
        self.need("do")
        if not self.eat("nothing"):
            self.need("update")
            self.need("set")
            self.list(self.assignment)
            if self.eat("where"):
                self.expression()

    def returning(self):
        if self.eat("returning"):
            self.list(self.result)

    def update(self):
        self.i += 1
        self.eat("only")
        self.source()
        self.need("set")
        self.list(self.assignment)
        if self.eat("from"):
            self.list(self.joined)
        if self.eat("where"):
            self.expression()
        self.returning()

    def assignment(self):
        if self.t[self.i] == "(":
            self.in_parens(self.name)
        else:
            self.name()
        self.need("=")
        self.value()

    def delete(self):
        self.i += 1
        self.need("from")
        self.eat("only")
        self.source()
        if self.eat("using"):
            self.list(self.joined)
        if self.eat("where"):
            self.expression()
        self.returning()

    # queries
    def query(self):
        if self.eat("with"):
            self.eat("recursive")
            self.list(self.cte)
            w = self.t[self.i]
            if w in ("insert", "update", "delete"):
                {"insert": self.insert, "update": self.update, "delete": self.delete}[w]()
                return
        self.core()
        while self.t[self.i] in ("union", "intersect", "except", "minus"):
            self.i += 1
            if not self.eat("all"):
                self.eat("distinct")
            self.core()
        if self.eat("order", "by"):
            self.list(self.ordered)
        while True:
            if self.eat("limit"):
                if not self.eat("all"):
                    self.expression()
                if self.eat(","):
                    self.expression()
            elif self.eat("offset"):
                self.expression()
                self.eat("rows") or self.eat("row")
            elif self.eat("fetch"):
                self.i += 1
                self.eat("0")
                self.i += 1
                self.need("only")
            elif self.eat("for"):
                self.i += 1
            else:
                return

    def cte(self):
        self.name()
        if self.t[self.i] == "(":
            self.in_parens(self.name)
        self.need("as")
        self.eat("not")
        self.eat("materialized")
        self.need("(")
        w = self.t[self.i]
        if w in ("insert", "update", "delete"):
            {"insert": self.insert, "update": self.update, "delete": self.delete}[w]()
        else:
            self.query()
        self.need(")")

    def core(self):
        if self.eat("("):
            self.query()
            self.need(")")
            return
        if self.eat("values"):
            self.list(self.row)
            return
        self.need("select")
        if not self.eat("all") and self.eat("distinct") and self.eat("on"):
            self.in_parens(self.expression)
        self.list(self.result)
        if self.eat("into"):
            self.name()
        if self.eat("from"):
            self.list(self.joined)
        if self.eat("where"):
            self.expression()
        if self.eat("group", "by"):
            self.list(self.value)
        if self.eat("having"):
            self.expression()
        if self.eat("qualify"):
            self.expression()

    def row(self):
        self.need("(")
        self.list(self.value)
        self.need(")")

    def value(self):
        if not self.eat("default"):
            self.expression()

    def result(self):
        if self.eat("*"):
            return
        if self.is_name() and self.t[self.i + 1] == "." and self.t[self.i + 2] == "*":
            self.i += 3
            return
        self.expression()
        self.alias()

    def alias(self):
        if self.eat("as"):
            if not (self.is_name() or self.t[self.i] == "'" or self.t[self.i].isalpha()):
                raise Bad
            self.i += 1
        elif self.is_name() and self.t[self.i] not in ("offset", "fetch", "returning", "qualify", "window", "for", "minus"):
            self.i += 1

    def joined(self):
        self.source()
        while True:
            start = self.i
            natural = self.eat("natural")
            for w in ("inner", "left", "right", "full", "cross"):
                if self.eat(w):
                    natural = natural or w == "cross"
                    break
            self.eat("outer")
            self.eat("lateral")
            if not self.eat("join"):
                if self.i != start:
                    raise Bad
                return
            self.source()
            if self.eat("on"):
                self.expression()
            elif self.eat("using"):
                self.in_parens(self.name)
            elif not natural:
                raise Bad

    def source(self):
        self.eat("lateral")
        if self.t[self.i] == "(":
            self.i += 1
            if self.t[self.i] in ("select", "with", "values", "("):
                self.query()
            else:
                self.joined()
            self.need(")")
        else:
            self.name()
            if self.t[self.i] == "(":
                self.call()
        if self.t[self.i] != "set":
            self.alias()
        if self.t[self.i] == "(":
            self.in_parens(self.name)

    def ordered(self):
        self.expression()
        if not self.eat("asc"):
            self.eat("desc")
        if self.eat("nulls"):
            self.i += 1

    # expressions
    def expression(self, least=0):
        if self.eat("not"):
            self.expression(2)
        else:
            self.operand()
        while True:
            w = self.t[self.i]
            negated = w == "not" and self.t[self.i + 1] in ("in", "like", "ilike", "between", "similar", "rlike", "regexp", "glob")
            k = self.t[self.i + 1] if negated else w
            if k in ("in", "like", "ilike", "between", "is", "isnull", "notnull", "similar", "rlike", "regexp", "glob"):
                if least >= 4:
                    return
                self.i += 2 if negated else 1
                if k == "in":
                    self.need("(")
                    if self.t[self.i] in ("select", "with", "values"):
                        self.query()
                    else:
                        self.list(self.expression)
                    self.need(")")
                elif k == "between":
                    self.eat("symmetric")
                    self.expression(4)
                    self.need("and")
                    self.expression(4)
                elif k == "is":
                    self.eat("not")
                    if self.eat("distinct", "from"):
                        self.expression(4)
                    elif self.t[self.i] in ("null", "true", "false", "unknown"):
                        self.i += 1
                    else:
                        raise Bad
                elif k not in ("isnull", "notnull"):
                    self.eat("to")
                    self.expression(4)
                    if self.eat("escape"):
                        self.operand()
                continue
            p = BINARY.get(w)
            if p is None or p <= least:
                return
            self.i += 1
            if self.t[self.i] in ("any", "all", "some") and self.t[self.i + 1] == "(":
                self.i += 1
            self.expression(p)

    def operand(self):
        w = self.t[self.i]
        if w in ("+", "-", "~", "prior", "binary"):
            self.i += 1
            self.operand()
            return
        if w in ("0", "'", "?", "null", "true", "false"):
            self.i += 1
            while w == "'" and self.eat("'"):
                pass
        elif w == "(":
            self.i += 1
            if self.t[self.i] in ("select", "with", "values"):
                self.query()
            else:
                self.list(self.expression)
            self.need(")")
        elif w == "case":
            self.i += 1
            if self.t[self.i] != "when":
                self.expression()
            self.need("when")
            while True:
                self.expression()
                self.need("then")
                self.expression()
                if not self.eat("when"):
                    break
            if self.eat("else"):
                self.expression()
            self.need("end")
        elif w in ("exists", "any", "all", "some"):
            self.i += 1
            self.need("(")
            self.query()
            self.need(")")
        elif w in ("date", "time", "timestamp", "interval") and self.t[self.i + 1] == "'":
            self.i += 2
            if w == "interval" and self.t[self.i] in ("year", "month", "day", "hour", "minute", "second"):
                self.i += 1
        elif w in ("left", "right", "replace", "values", "set", "default") and self.t[self.i + 1] == "(":
            self.i += 1
            self.call()
        else:
            self.name()
            if self.t[self.i] == "(":
                self.call()
            elif self.t[self.i] == "." and self.t[self.i + 1] == "*":
                self.i += 2
        while True:
            if self.eat("::"):
                self.type()
            elif self.eat("["):
                self.expression()
                self.need("]")
            elif self.eat("at", "time", "zone"):
                self.operand()
            elif self.eat("collate"):
                self.name()
            else:
                return

    def call(self):
        self.need("(")
        if not self.eat("*") and self.t[self.i] != ")":
            self.eat("distinct") or self.eat("all")
            self.list(self.call_argument)
        self.need(")")
        if self.eat("filter"):
            self.need("(", "where")
            self.expression()
            self.need(")")
        if self.eat("over"):
            if self.t[self.i] != "(":
                self.name()
                return
            depth = 0
            while True:
                depth += {"(": 1, ")": -1, "": -99}.get(self.t[self.i], 0)
                if depth < 0:
                    raise Bad
                self.i += 1
                if not depth:
                    return

    def call_argument(self):
        if self.t[self.i] in ("select", "with"):
            self.query()
            return
        self.expression()
        while self.t[self.i] in ("as", "from", "for", "using", "separator", "order"):
            w = self.t[self.i]
            self.i += 1
            if w == "as":
                self.type()
            elif w == "order":
                self.need("by")
                self.list(self.ordered)
            else:
                self.expression()


OTHER = {
    **dict.fromkeys(("grant", "revoke"), Parser.grant), "comment": Parser.comment, "merge": Parser.merge, **dict.fromkeys(("begin", "start", "commit", "rollback", "end", "abort"), Parser.transaction),
    **dict.fromkeys(("savepoint", "release", "use"), Parser.one_name), **dict.fromkeys(("analyze", "vacuum"), Parser.names), **dict.fromkeys(("truncate", "lock", "reindex", "refresh", "describe", "desc"), Parser.some_names), "explain": Parser.explain,
    "set": Parser.set_value, **dict.fromkeys(("call", "execute"), Parser.call_statement), **dict.fromkeys(("reset", "discard", "listen", "notify", "deallocate"), Parser.all_or_names), "show": Parser.show, "replace": Parser.replace,
}
STATEMENTS = {"select", "with", "values", "create", "insert", "update", "delete", "drop", "alter", *OTHER, *LOOSE}
