"""Classes and exports that nothing uses."""

from codelode.extract import facts as X
from codelode.plans.code_facts_queries import dead_code

FILES = {
    "src/a.js": "import { used as u } from './lib/b.js';\nimport Def from './lib/c';\nclass Gone {}\nclass Made {}\nclass Given {}\nclass Stat {}\nconst x = new Made();\ncustomElements.define('a-b', Given);\nStat.run();\nu(x, Def);\n",
    "src/lib/b.js": "export function used() {}\nexport function lost(a) { return a; }\nexport const own = () => 1, k = own();\nfunction inner() {}\nexport { inner as outer };\nexport class Shown {}\n",
    "src/lib/c.js": "export default class C {}\nclass Shown {}\n",
    "src/lib/index.ts": "export const top = 1;\nexport type T = string;\n",
    "src/d.ts": "import { top } from './lib';\nexport const z = top;\n",
    "src/a.test.js": "export const t = 1;\nclass InTest {}\n",
}


def test_classes_and_exports(spark):
    files = spark.createDataFrame([(i, "r", p, p[p.rindex(".") :], t) for i, (p, t) in enumerate(FILES.items())], "file_id long, repo string, path_rel string, ext string, raw string")
    got = {(r["type"], r["path_rel"], r["name"]) for r in dead_code(X.extract(files)).collect() if r["type"] in ("class", "export")}
    assert got == {
        ("class", "src/a.js", "Gone"), ("export", "src/lib/b.js", "lost"), ("export", "src/lib/b.js", "outer"), ("export", "src/lib/b.js", "Shown"), ("export", "src/lib/index.ts", "T"), ("export", "src/d.ts", "z"),
    }
