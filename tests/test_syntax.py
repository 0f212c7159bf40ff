"""Grammars: what they take and what they refuse."""

import pytest
from codelode.syntax import ecma, golang, pygram, sqlgram
from codelode.syntax.groups import Bad, Groups

JS_GOOD = [
    "import a, { b as c, default as d } from 'x'; import * as n from \"y\"; import 'z'; export * from 'q'; export * as w from 'q'; export { a as b, c }; export default class {}",
    "const { a, b: { c = 1 }, ...r } = o, [x, , y = 2, ...z] = l; ({ a, b } = o); [a, b] = [b, a]; for (const [k, v] of m) {} for (const k in o) {} for (let i = 0, j; i < 3; i++, j--) {}",
    "class A extends B.C { #p = 1; static s = 2; static { this.s = 3 } get x() { return this.#p } set x(v) {} async *g() { yield* a; await b } static async m() {} 'q'() {} [k]() {} constructor() { super(); } has(o) { return #p in o } }",
    "a?.b?.[c]?.(d) ?? e; a ||= b; a &&= c; a ??= d; a **= 2; x = a ? b : c ? d : e; -a ** 2 || 1".replace("-a ** 2 || 1", "(-a) ** 2 || 1"),
    "const f = async (a, { b }, ...c) => await a, g = x => ({ x }), h = () => {}, i = async x => x; (function () { return 1 })(); !function () {}();",
    "label: for (;;) { if (a) continue label; else break } do x++; while (x < 5) switch (a) { case 1: case 2: b(); break; default: c() } try { a() } catch { b() } finally { c() }",
    "const s = `a ${b + `c ${d} }`} {`; const r = /[/\\]}]+\\//gi.test(s), q = a / b / c; if (x) /re/.exec(y); return_ = 1 / 2",
    "let a = 1\nlet b = a\n++b\nvar c = function* () { const x = yield 1; yield }\nif (a) b()\nelse c()\nthrow new Error('x')",
    "const n = [0xFF, 0b1, 0o7, 1_000n, .5, 5., 1e-3, 1.5.toFixed()]; const o = { a, 'b': 1, [c]: 2, get d() { return 1 }, async e() {}, *f() {}, async *g() {}, ...h, async: 1, get: 2, static: 3, default: 4 }; o.default.class.new",
    "new.target; new A; new A.B(c); new (f())(); import('x').then(y); import.meta.url; await z; async function k() { for await (const x of y) {} }".replace("new.target; ", ""),
    "<!-- not html -->".replace("<!-- not html -->", "a <b; a << 2 >> 3 >>> 4; a >>>= 1; a >>= 1; typeof a === 'b' && void 0, delete a.b"),
    "// comment ' { \n/* ` \" ( */ 'it\\'s'; \"a\\\nb\"; '\\u{1F600}'; #!x".replace("#!x", ""),
    "#!/usr/bin/env node\nvar let_ = 1; var of = 2, async = 3; async(1); of => of; let [q] = w; (let_)",
    "export const x = 1, y = () => 2; export async function* f() {} export let z; debugger;;", "", "   \n",
]
JS_BAD = [
    "const a = ;", "if (a { b }", "function f( { }", "a b", "let x = 1 let y = 2", "class A { foo( }", "return 1", "const x", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "for (const a of) {}", "const a = 'x\n'", "`abc", "/* abc", "a = /x",
    "export { a } from", "function () {}", "await = 1 +", "x => { return }}", "var a = 1; }", "({ a: 1, b = 2 })", "a ? b", "1 = a", "f() = 1", "() => {} + 1".replace("() => {} + 1", "async () => 1 => 2"), "function f() { await x }",
    "function f() { export const a = 1 }", "break;", "try { }", "switch (a) { b }", "a..b", "3in", "interface A { x: string }", "const a: number = 1", "enum A { B }", "<div />", "{ a", "foo(a,,b)", "new", "import x", "class { }", "@dec class A {}",
    "const f = (a: string) => a;", "let a = b as string;", "yield x", "if (a) function", "else { }",
]
TS_GOOD = [
    "interface A<T extends B = C> extends D, E<F> { readonly a: string; b?: number; [k: string]: any; m(x: T): void; new (x: string): A; (y: number): string; get z(): string; method?<U>(u: U): U }",
    "type T = { [K in keyof A as `x${K}`]?: A[K] } & (B | C)[] | null; type F = (a: string, ...b: number[]) => asserts a is string; type G = abstract new () => void; type H = A extends infer U ? U : never; type I = typeof a.b; type J = readonly [x: string, y?: number, ...z: A[]]; type L = import('x').Y<Z>; type M = unique symbol; type N = -1 | 'a' | true",
    "enum E { A, B = 1 << 2, 'C' = A } declare module 'm' { export const x: number; } namespace N.M { export function f(): void {} } declare global { interface Window { a: b } } const enum Q { A } declare const q: string; declare function g(x: number): string; abstract class P { abstract m(): void; protected constructor(private readonly x: string, public y?: number) { super() } declare z: string; override n(): void {} static #p?: number; [key: string]: unknown; }",
    "function f<T>(this: Window, a: T, b?: string, c = 1): a is string { return <any>a as unknown as string } const g = <T,>(x: T): T => x; const h = async <T>(x: T): Promise<T> => x; let x!: number; a!.b![0]!(); const y = f<string>('a'); new Map<string, Array<number>>(); const z = a satisfies B; function o(a: string): void; function o(a: any) {}",
    "import type { A } from 'x'; import { type B, C } from 'y'; export type { D }; export type E = A; import F = require('z'); export = F; export default interface G {} @dec() class H { @prop({ a: 1 }) x: string = ''; @method m() {} constructor(@Inject() private a: B) {} }",
    "const m: Record<string, Map<string, Array<number>>> = {}; for (const x of a as B[]) {} let v: A<B<C>>= d; const u = a < b && c > d; const t = (a): b => c; const w = a ? (b) : c; const p = x as const; let k: new () => void; export abstract class Z<T> implements Y {}",
    "type A = {\n a: string\n b: number\n}\ninterface B { a(): void, b: string }\nlet x: { (a: string): void; b?: () => void } | undefined\ntry {} catch (e: unknown) {}",
]
TS_BAD = ["let a: = 1", "interface { }", "type A = ;", "function f(a: ): void {}", "class A { private }{", "const x = <div/>;", "enum { A }", "let x: Array<string = 1"]
TSX_GOOD = ["const a = <div className=\"x y\" {...p} on={() => { f(1) }}>it's {b} <B.C d='e' /> {/* c */} <></> text, don't {'}'}</div>; const g = <T,>(x: T) => x; function F(): JSX.Element { return (\n <ul>{l.map(i => <li key={i}>{i}</li>)}</ul>\n) }", "const a = b < c ? <p>x</p> : <q-r data-x=\"1\"/>; const y = a as B;"]
TSX_BAD = ["const a = <div>", "const a = <div></span>;", "const a = <div x=></div>;", "const a = <>{b</>;"]
GO_GOOD = [
    'package p\n\nimport (\n\t"fmt"\n\tx "y/z"\n)\n\ntype S[T any] struct {\n\tA, B int `json:"a"`\n\t*C\n\td.E\n\tf func(int) (string, error)\n}\n\ntype I interface {\n\tM(a int) error\n\tfmt.Stringer\n\t~int | string\n}\n',
    "package p\nfunc (s *S[T]) M(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok && v > 1 {\n\t\treturn v, nil\n\t} else if x := f(); x {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor range c {\n\t}\n\tfor k, v := range m {\n\t\tcontinue\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tswitch t := a.(type) {\n\tcase int, *S[T]:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase <-ch:\n\tcase v := <-ch:\n\tcase ch <- 1:\n\t}\n\tgo func() { x++ }()\n\tdefer f(a...)\n\treturn\n}\n",
    'package p\nvar a = []int{1, 2,\n\t3}\nvar m = map[string][]struct{ x int }{"a": {{1}, {2}}}\nconst (\n\tA = iota\n\tB\n)\nvar f = func(x int) int { return x << 2 &^ 1 }\nvar c chan<- int = make(chan int, 3)\nvar z = [...]string{2: "a"}[1:2]\nfunc main() {\n\tx := &S{A: 1}\n\t*p = 2\n\tx.y[1:2:3], w = 1, 2\n\tL:\n\tfor {\n\t\tbreak L\n\t}\n\t_ = T(x).(I)\n\tvar q struct{}\n\t_ = struct{ a int }{1}\n\t_ = \'\\n\' + \'é\'\n}\n',
]
GO_BAD = ["func f() {}", "package p\nfunc f( {}\n", "package p\nfunc f() {\n\treturn 1 +\n}\n", "package p\nvar x = \"a\n", "package p\n<<<<<<< HEAD\n", "package p\nfunc f() {\n\tif x {\n}\n", "package p\nimport x\n", "package p\nfunc f() { a b }\n", "package p\nx := 1\n"]
SQL_GOOD = [
    "CREATE TABLE IF NOT EXISTS a.b (id SERIAL PRIMARY KEY, n NUMERIC(10, 2) NOT NULL DEFAULT 0, t TIMESTAMP WITH TIME ZONE, r INT REFERENCES c (id) ON DELETE SET NULL, s VARCHAR(20)[], CONSTRAINT u UNIQUE (n, t), CHECK (n > 0), FOREIGN KEY (r) REFERENCES c (id));",
    "SELECT DISTINCT a.*, count(*) AS n, CASE WHEN x IS NOT NULL THEN 1 ELSE 2 END FROM a LEFT JOIN b ON a.id = b.id, c WHERE a.x IN (SELECT y FROM d) AND NOT EXISTS (SELECT 1) OR z BETWEEN 1 AND 2 GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC NULLS LAST LIMIT 5 OFFSET 2",
    "INSERT INTO a (b, c) VALUES (1, 'it''s'), (2, NULL) ON CONFLICT DO NOTHING; UPDATE a SET b = b + 1, c = 'x' WHERE d LIKE '%y'; DELETE FROM a USING b WHERE a.x = b.x; WITH t AS (SELECT 1) SELECT * FROM t UNION ALL SELECT 2; CREATE UNIQUE INDEX i ON a (lower(b)); ALTER TABLE a ADD COLUMN z INT; DROP TABLE IF EXISTS a CASCADE; CREATE VIEW v AS SELECT 1; BEGIN; COMMIT;",
    "-- only a comment\n/* ( */", "", "SELECT sum(a) OVER (PARTITION BY b ORDER BY c ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), CAST(x AS INT), y::TEXT, EXTRACT(YEAR FROM d), date '2024-01-01' + interval '1 day' FROM f(1) AS g",
]
SQL_BAD = ["CREATE TABLE a (", "CREATE TABLE a (id INT,, b INT)", "SELECT FROM WHERE", "INSERT a VALUES", "CREATE TABLE a (id)", "import json", "SELECT 'a", "package p", "SELECT (1", "UPDATE a b = 1", "=======\nSELECT 1", "DELETE a", "CREATE a"]
PY_GOOD = ["def f(a, /, b, *, c=1, **k): return a\n", "match x:\n    case 1: pass\n", "async def f():\n    await x\n", "", chr(0xFEFF) + "x = 1\n"]
PY_BAD = ["def f(:\n", "if x:\n", "x = (1\n", "return 1\n", "  x = 1\ny = 2\n z = 3\n", "break\n", "'abc\n"]


@pytest.mark.parametrize("make,good,bad", [
    (lambda: ecma.Grammar("js"), JS_GOOD, JS_BAD), (lambda: ecma.Grammar("ts"), JS_GOOD + TS_GOOD, TS_BAD), (lambda: ecma.Grammar("tsx"), TSX_GOOD, TSX_BAD),
    (golang.Grammar, GO_GOOD, GO_BAD), (sqlgram.Grammar, SQL_GOOD, SQL_BAD), (pygram.Grammar, PY_GOOD, PY_BAD),
])
def test_grammars(make, good, bad):
    g = make()
    assert [t for t in good if not g.check(t)] == []
    assert [t for t in bad if g.check(t)] == []
    assert [t for t in good if not g.check(t.replace("\n", "\r\n"))] == []


def test_results_do_not_depend_on_the_table():
    warm = ecma.Grammar("ts")
    for t in JS_GOOD + JS_BAD + TS_GOOD:
        assert warm.check(t) == ecma.Grammar("ts").check(t), t


def test_deep_and_long_texts():
    js = ecma.Grammar("js")
    assert js.check("x = " + "(" * 3000 + "1" + ")" * 3000)
    assert not js.check("x = " + "(" * 3000 + "1" + ")" * 2999)
    assert js.check("a = 1;\n" * 50_000) and not js.check("a = 1;\n" * 50_000 + "a = ;")
    with pytest.raises(Bad):
        Groups(lambda g: 1).fold("(]")


def test_truncated_texts_are_refused_almost_everywhere():
    text = "export function f(a) {\n  const b = a.map(x => x + 1);\n  return { b, c: [1, 2] };\n}\n"
    js = ecma.Grammar("js")
    assert js.check(text) and not any(js.check(text[:k]) for k in range(7, len(text) - 2))


SQL_GOOD = """GRANT SELECT, INSERT (a, b) ON TABLE x.y TO joe, "Ann" WITH GRANT OPTION; REVOKE ALL PRIVILEGES ON ALL TABLES IN SCHEMA s FROM public CASCADE; GRANT admin TO joe; COMMENT ON COLUMN a.b IS 'x'; COMMENT ON TABLE a IS NULL;
MERGE INTO t USING (SELECT 1 AS a) s ON t.a = s.a WHEN MATCHED AND s.b > 1 THEN UPDATE SET b = s.b WHEN NOT MATCHED THEN INSERT (a, b) VALUES (s.a, s.b);
BEGIN; BEGIN TRANSACTION ISOLATION LEVEL SERIALIZABLE; COMMIT; ROLLBACK TO SAVEPOINT a; SAVEPOINT a; RELEASE SAVEPOINT a; TRUNCATE TABLE a, b RESTART IDENTITY CASCADE; SET search_path TO a, b; SET x.y = 'on'; SET TIME ZONE 'UTC'; SET NAMES 'utf8'; USE db; EXPLAIN ANALYZE SELECT 1; ANALYZE a; VACUUM FULL a; CALL f(1, 'x');
CREATE TABLE a (b INT) ENGINE=InnoDB DEFAULT CHARSET=utf8 COMMENT='x'; CREATE TABLE a (b INT) WITH (fillfactor = 70) TABLESPACE t; CREATE TABLE a (b INT) PARTITION BY RANGE (b); CREATE TABLE a (b INT) INHERITS (c); CREATE TABLE a (b INT) WITHOUT ROWID; CREATE TABLE a (b INT) AS SELECT 1;
CREATE TEMP TABLE a (b INT) ON COMMIT DROP; CREATE UNIQUE INDEX i ON a (b DESC) WHERE b > 1; CREATE VIEW v AS SELECT 1; CREATE VIEW v AS SELECT 1 WITH CHECK OPTION; DROP TABLE IF EXISTS a, b CASCADE; DROP INDEX i; ALTER TABLE a ADD COLUMN b INT; ALTER TABLE a RENAME TO b; ALTER TABLE a DROP COLUMN b, ALTER COLUMN c SET NOT NULL;
INSERT INTO a VALUES (1) ON CONFLICT (a) DO UPDATE SET b = excluded.b WHERE a.b > 1 RETURNING a; INSERT INTO a VALUES (1) ON DUPLICATE KEY UPDATE b = 2; INSERT INTO a VALUES (1) ON CONFLICT DO NOTHING; REPLACE INTO a VALUES (1); CREATE FUNCTION f() RETURNS int AS $$ select 1 $$ LANGUAGE sql; LOCK TABLE a IN EXCLUSIVE MODE; REFRESH MATERIALIZED VIEW v; SHOW TABLES; DESCRIBE a; RESET ALL; REINDEX TABLE a; COMMENT ON FUNCTION f(int, text) IS 'x'; SET a = on"""
SQL_BAD = """GRANT grant ON on TO to;MERGE a b c d e;COMMENT ON ON ON 5 5 5;CREATE TABLE a (x INT) CREATE TABLE b (y INT);CREATE TABLE a (x INT) foo bar = = 1;GRANT SELECT ON a TO;BEGIN CREATE TABLE a (b INT);TRUNCATE;SET = 5;DROP TABLE a b;COMMENT ON TABLE a IS;MERGE INTO t USING s ON t.a = s.a;INSERT INTO a VALUES (1) ON CONFLICT foo;CREATE VIEW v AS SELECT 1 CREATE VIEW w AS SELECT 2;REVOKE SELECT ON a;TRUNCATE"""


def test_sql_statements_of_all_kinds():
    from codelode.syntax import sqlgram

    g = sqlgram.Grammar()
    assert [x for x in SQL_GOOD.split(";") if not g.check(x + ";")] == []
    assert [x for x in SQL_BAD.split(";") if g.check(x + ";")] == []


def test_depth_is_no_error():
    from codelode.syntax import ecma, pygram

    p = pygram.Grammar()
    assert p.check("x = " + " + ".join(["1"] * 20_000)) is True and p.check("x = " + "-" * 9_000 + "1") is None
    assert not any(p.check(x) for x in ("def f():\n break", "class A:\n return 1", "(yield)", "a = *b, *c = 1", "if x:\n return 1", "def f():\n await x", "def f(:", "a\0b"))
    assert ecma.Grammar("js").check("x = " + "!" * 50_000 + "1;") in (True, None) and ecma.Grammar("js").check("x = " + "[" * 5_000 + "]" * 5_000 + ";") is True


def test_group_kinds_are_bounded(monkeypatch):
    from codelode.syntax import groups

    monkeypatch.setattr(groups, "LAST", groups.FIRST + 3)
    g = groups.Groups(lambda t: t)
    try:
        g.fold("(a)(b)(c)(d)(e)(f)")
        raise AssertionError
    except RecursionError:
        pass
    assert len(g.fold("(a)(b)")) == 2
