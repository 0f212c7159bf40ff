"""Column functions on names, paths and texts. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: words that are never table names, as the dialects' keywords, types, functions and catalogues come ----
SQL_STOPLIST = """select from where and or not in on as join left right inner outer cross full group order by having limit offset union all distinct case when then else end
null true false is between like ilike exists any some set values into table create alter drop index primary key foreign references constraint default check unique
if begin commit rollback transaction returning conflict nothing do update cascade restrict lateral each row with recursive only
integer int bigint smallint serial bigserial text varchar char character boolean bool timestamp timestamptz date time timetz interval numeric decimal real float double
json jsonb uuid bytea inet cidr macaddr array point line box circle polygon path
count sum avg min max coalesce cast extract now current_timestamp current_date generate_series unnest string_agg array_agg row_number rank dense_rank over partition
asc desc nulls first last filter columns rows tables schema schemas information_schema pg_catalog pg_tables pg_class""".split()
# ---- fixed values: methods of object-relational mappers, and classes of the language that are no models ----
CLIENT_READS = "findMany findFirst findUnique findRaw count aggregate groupBy".split()
CLIENT_WRITES = "create createMany update updateMany upsert delete deleteMany".split()
MODEL_READS = "findAll findOne findByPk findAndCountAll count".split()
MODEL_WRITES = "create bulkCreate update destroy".split()
NO_MODELS = "Promise Object Array Map Set Date Error JSON Math Buffer RegExp Symbol String Number Boolean Request Response Console".split()
#: how far behind knex('t') a method that changes the table makes it a write, the call included
KNEX_REACH = 200
# ---- fixed values: what a scan leaves out ----
EXCLUDED_DIRS = ["node_modules", "dist", "build", "coverage", ".next", ".nuxt", ".output", "__pycache__", ".cache", ".turbo", "out"]
EXCLUDED_GLOBS = ["*.test.js", "*.spec.js", "*.min.js", "*.bundle.js", "*.d.ts"]
EMPTY = "cast(array() as array<string>)"


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up; null for null."""
    return F.ceil(F.length(text) / 4).cast("long")


def content_hash(text: Column) -> Column:
    """The first 8 hex digits of the MD5."""
    return F.substring(F.md5(text), 1, 8)


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: * is any text, ? one character, all else itself."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def excluded(path: Column, dirs: list[str] = EXCLUDED_DIRS, globs: list[str] = EXCLUDED_GLOBS, ignore: list[str] = (), hidden: bool = False) -> Column:
    """Whether a scan leaves the path out: a directory of the list, a hidden one unless asked for, a name that fits a glob, or an ignore pattern."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    out = F.arrays_overlap(folders, F.array(*map(F.lit, dirs))) if dirs else F.lit(False)
    if not hidden:
        out = out | F.exists(folders, lambda p: p.startswith(".") & (F.length(p) > 1))
    for g in globs:
        out = out | base_name(path).rlike(glob_regex(g))
    for p in ignore:
        out = out | ignored(path, p)
    return F.coalesce(out, F.lit(False))


def ignored(path: Column, pattern: str) -> Column:
    """An ignore pattern fits an exact name, as a glob the base name, and else any part of the path. Blank lines and comments fit nothing."""
    p = pattern.strip()
    if not p or p.startswith("#"):
        return F.lit(False)
    p = p.rstrip("/")
    if "*" in p:
        return base_name(path).rlike(glob_regex(p))
    return path.contains(p)


# ---- fixed values: folders that the plain walk over JavaScript files does not enter ----
WALK_SKIPS = "node_modules .git vendor .context dev-docs .agent .agents .expanded web".split()


def walked(path: Column, extensions: tuple[str, ...] = (".js", ".mjs")) -> Column:
    """Whether the plain walk takes a path: its extension, no folder of the fixed list or with a dot in front on the way, no dot before its name."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    out = F.lower(base_name(path)).rlike("(?:" + "|".join(re.escape(e) for e in extensions) + ")$") & ~base_name(path).startswith(".")
    return F.coalesce(out & ~F.arrays_overlap(folders, F.array(*map(F.lit, WALK_SKIPS))) & ~F.exists(folders, lambda p: p.startswith(".")), F.lit(False))


def graph_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a list for the graph leaves a path out: name* fits what begins with it, *name what ends with it (path or base name), else what holds it."""
    out = F.lit(False)
    for p in (p.strip() for p in patterns):
        if not p or p.startswith("#"):
            continue
        if p.endswith("*"):
            out = out | path.startswith(p[:-1]) | base_name(path).startswith(p[:-1])
        elif p.startswith("*"):
            out = out | path.endswith(p[1:]) | base_name(path).endswith(p[1:])
        else:
            out = out | path.contains(p)
    return F.coalesce(out, F.lit(False))


# ---- fixed values: what a context of a whole project leaves out unless it says otherwise ----
CONTEXT_IGNORE = "vendor/ *.min.js *.bundle.js chart.js d3.js three.js lodash.js jquery*.js dist/ build/ coverage/ *.d.ts *.test.js *.spec.js".split()


def context_ignored(path: Column, patterns: list[str] = CONTEXT_IGNORE) -> Column:
    """Whether a path is left out of a context: a pattern that ends with a slash fits a path that begins with it or has it behind a slash (its slash
    dropped), any other fits the base name or the whole path as a glob. Blank patterns and comments fit nothing."""
    out = F.lit(False)
    for p in (p.strip() for p in patterns):
        if not p or p.startswith("#"):
            continue
        if p.endswith("/"):
            out = out | path.startswith(p[:-1]) | path.contains("/" + p[:-1])
        else:
            out = out | base_name(path).rlike(glob_regex(p)) | path.rlike(glob_regex(p))
    return F.coalesce(out, F.lit(False))


def alias_base(name: Column) -> Column:
    """The short form of a name before collisions are told apart: of two or more signs that are no small letters the first three; else the first letter, small,
    and the capital; without a capital the first two signs."""
    rest = F.regexp_replace(name, "[a-z]", "")
    capital = F.regexp_extract(name, "[A-Z]", 0)
    return F.when(F.length(rest) >= 2, F.substring(rest, 1, 3)).when(capital != "", F.concat(F.lower(F.substring(name, 1, 1)), capital)).otherwise(F.substring(name, 1, 2))


def strip_sql(text: Column) -> Column:
    """Without comments, white space as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"--[^\n]*", ""), r"/\*[\s\S]*?\*/", ""), r"\s+", " "))


def is_sql(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*(SELECT|INSERT|UPDATE|DELETE|WITH|CREATE\s+TABLE)\b")


def is_table_name(n: Column) -> Column:
    """Identifiers of two or more signs that are neither stop words nor all capitals nor capitalised nor of the catalogue's function families."""
    return (F.length(n) >= 2) & n.rlike("^[a-zA-Z_][A-Za-z0-9_]*$") & ~F.lower(n).isin(SQL_STOPLIST) & ~n.rlike("^[A-Z][A-Z_]*$") & ~n.rlike("^[A-Z][a-z]") & ~n.rlike("^(pg_|jsonb_|array_|string_|regexp_)")


def table_names(names: Column) -> Column:
    """Those of an array, without their schema, that can be table names: distinct and sorted."""
    bare = F.transform(names, lambda n: F.substring_index(n, ".", -1))
    return F.array_sort(F.array_distinct(F.filter(bare, is_table_name)))


_SQL_NAME = r"([a-zA-Z_]\w*+(?:\.[a-zA-Z_]\w*+)?+)"


def sql_reads(text: Column) -> Column:
    """Tables after FROM and JOIN; names followed by a parenthesis are functions. The target of the first DELETE is not read if it stands without a schema."""
    s = strip_sql(text)
    found = table_names(F.regexp_extract_all(s, F.lit(rf"(?i)\b(?:FROM|JOIN)\s+{_SQL_NAME}(?!\s*\()"), F.lit(1)))
    deleted = F.regexp_extract(s, r"(?i)\bDELETE\s+FROM\s+([a-zA-Z_]\w*)", 1)
    return F.filter(found, lambda n: (n != deleted) | ~F.array_contains(sql_writes(text), n))


def sql_writes(text: Column) -> Column:
    """Tables after INSERT INTO, UPDATE and DELETE FROM."""
    return table_names(F.regexp_extract_all(strip_sql(text), F.lit(rf"(?i)\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+{_SQL_NAME}"), F.lit(1)))


def mapper_tables(code: Column, write: bool) -> Column:
    """Tables that code reads or writes through object-relational mappers and query builders: distinct and sorted.

    prisma.order.findMany() names its table as it is spelt, Order.findAll() in small letters (classes of the language are no models); knex('t') reads,
    or writes where a method that changes it follows soon; .from('t') and .table('t') read, .into('t') writes.
    """
    verbs = lambda words: "|".join(sorted(words, key=len, reverse=True))
    client = F.regexp_extract_all(code, F.lit(rf"\bprisma\.(\w+)\.(?:{verbs(CLIENT_WRITES if write else CLIENT_READS)})\s*\("), F.lit(1))
    model = F.regexp_extract_all(code, F.lit(rf"\b([A-Z][a-zA-Z]+)\.(?:{verbs(MODEL_WRITES if write else MODEL_READS)})\s*\("), F.lit(1))
    model = F.transform(F.filter(model, lambda n: ~n.isin(NO_MODELS)), lambda n: F.lower(n))
    knex = rf"\b(?=knex)(?=([\s\S]{{0,{KNEX_REACH}}}))knex\s*\(\s*['\"](\w+)['\"]\s*\)"
    calls = F.arrays_zip(F.regexp_extract_all(code, F.lit(knex), F.lit(1)).alias("reach"), F.regexp_extract_all(code, F.lit(knex), F.lit(2)).alias("name"))
    changes = lambda c: c["reach"].rlike(r"(?i)\.(?:insert|update|del|delete|truncate)\s*\(")
    built = F.transform(F.filter(calls, lambda c: changes(c) if write else ~changes(c)), lambda c: c["name"])
    named = F.regexp_extract_all(code, F.lit(rf"\.(?:{'into' if write else 'from|table'})\s*\(\s*['\"](\w+)['\"]\s*\)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(client, model, F.filter(F.concat(built, named), is_table_name))))


#: strings of the languages: three quotes of either kind, backticks; and quotes of one line or more, in a text without escaped quotes
QUOTED = [r'"""([\s\S]*?)"""', r"'''([\s\S]*?)'''", r"`([\s\S]*?)`"]
QUOTED_BARE = [r'"([^"]*)"', r"'([^']*)'"]


def code_tables(code: Column, write: bool) -> Column:
    """Tables that code reads or writes: of all strings of five quote styles that are SQL, and through mappers. Distinct and sorted."""
    # an escaped quote or backslash becomes signs that are no part of a name either, so that a string ends at the next quote
    bare = F.regexp_replace(code, r"\\[\\'\"`]", "\ue000\ue000")
    strings = F.filter(F.concat(*[F.regexp_extract_all(code, F.lit(q), F.lit(1)) for q in QUOTED], *[F.regexp_extract_all(bare, F.lit(q), F.lit(1)) for q in QUOTED_BARE]), is_sql)
    found = F.flatten(F.transform(strings, lambda t: sql_writes(t) if write else sql_reads(t)))
    return F.array_sort(F.array_distinct(F.concat(found, mapper_tables(code, write))))


def template_tags(html: Column) -> Column:
    """Custom elements of a template: names with a hyphen, distinct, in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(r"<([a-z][a-z0-9]*-[a-z0-9-]*)"), F.lit(1))))


def css_tokens(css: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(css, F.lit(r"(--[A-Za-z][\w-]*)\s*:"), F.lit(1))))


def bindings(html: Column) -> Column:
    """Keys of ${{key: 'value'}} bindings."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(r"\$\{\{\s*(\w+)\s*:"), F.lit(1))))


def strip_markup_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"<!--[\s\S]*?-->", "")


def strip_code_comments(code: Column) -> Column:
    """The plain way to make code smaller: block comments, comment lines, blank ends and blank lines go. Not aware of strings."""
    s = F.regexp_replace(code, r"/\*[\s\S]*?\*/", "")
    s = F.regexp_replace(s, r"(?m)^[ \t]*//[^\n]*$", "")
    s = F.regexp_replace(s, r"(?m)[ \t]+$", "")
    return F.trim(F.regexp_replace(s, r"\n{2,}", "\n"))


def signature_hash(parts: Column) -> Column:
    """The hash of an interface: its sorted signatures."""
    return content_hash(F.array_join(F.array_sort(parts), "|"))
