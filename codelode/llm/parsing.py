"""Source files that do not parse.

Each file is ranked by its tokens against the languages and then parsed with all grammars, the likeliest first. One that its own grammar takes
is ``valid``; else a foreign grammar that takes it tells what the file really is (``foreign``: a wrong extension); one that none takes is
``corrupt`` (truncated, merge conflict and the like). A file nested deeper than its parser can go is ``too deep``: nothing is known of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.syntax import ecma, golang, pygram, sqlgram

#: the grammar of each extension
GRAMMAR_OF = {".js": "js", ".mjs": "js", ".ts": "ts", ".tsx": "tsx", ".py": "py", ".go": "go", ".sql": "sql"}
LANGUAGE_OF = {"js": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "go": "go", "sql": "sql"}
MAKE: dict[str, Callable] = {"js": ecma.Grammar, "ts": ecma.Grammar, "tsx": ecma.Grammar, "py": pygram.Grammar, "go": golang.Grammar, "sql": sqlgram.Grammar}
TOKEN = re.compile(r"[^\W\d]\w*|===|=>|:=|</|/>|[;:]$", re.M)
#: tokens that speak for a language
SIGNS = {
    "js": "const let function export import new await async === => ;",
    "ts": "const let interface type export import readonly enum => string number boolean unknown any void ;",
    "tsx": "const let export import return </ /> className ;",
    "py": "def class from import elif except with self None True False :",
    "go": "package func chan defer range struct nil :=",
    "sql": "CREATE TABLE INSERT INTO SELECT FROM WHERE VARCHAR NUMERIC TIMESTAMP VALUES create table insert select where varchar numeric timestamp values",
}
SPEAKS: dict[str, list[str]] = {}
for _g, _signs in SIGNS.items():
    for _t in _signs.split():
        SPEAKS.setdefault(_t, []).append(_g)
CONFLICT = re.compile(r"^(?:<{7}|>{7}|={7}|\|{7})(?: |$)", re.M)
VERDICTS = "file_id long, repo string, ext string, verdict string, parsed_as string, taken_by array<string>, ranked array<string>, has_marker boolean, version timestamp"


class Grammars:
    """One parser for each grammar, made when first needed."""

    def __init__(self):
        self.made: dict[str, object] = {}

    def __getitem__(self, name: str):
        if name not in self.made:
            self.made[name] = MAKE[name](name)
        return self.made[name]


_made = Grammars()  # the parsers of this worker process: what they remember of earlier files saves time and changes no result


def rank(text: str) -> list[str]:
    """The grammars, the likeliest first, by how many of the text's tokens speak for each."""
    score = dict.fromkeys(SIGNS, 0)
    for token, n in Counter(TOKEN.findall(text)).items():
        for g in SPEAKS.get(token, ()):
            score[g] += n
    return sorted(SIGNS, key=lambda g: (-score[g], g))


def takes(grammars: Grammars, text: str) -> dict[str, bool | None]:
    """Whether each grammar takes the text; None where it is too deep to tell.

    The three of the ECMAScript family share what is the same: js and ts the tokens, tsx, too, where nothing can begin an element, and ts and tsx
    the result if there is no < in the text.
    """
    out = {g: grammars[g].check(text) for g in ("py", "go", "sql")}
    plain = _tokens(text, False)
    for g in ("js", "ts"):
        out[g] = grammars[g].check_tokens(plain) if isinstance(plain, str) else plain
    if "<" in text:
        marked = _tokens(text, True) if ecma.JSX_START.search(text) else plain
        out["tsx"] = grammars["tsx"].check_tokens(marked) if isinstance(marked, str) else marked
    else:
        out["tsx"] = out["ts"]
    return out


def _tokens(text: str, jsx: bool) -> str | bool | None:
    try:
        t = ecma.tokens_of(text, jsx)
    except RecursionError:
        return None
    return False if t is None else t


def judge(grammars: Grammars, ext: str, text: str) -> tuple[str, str | None, list[str], list[str]]:
    """(verdict, grammar that says so, all that take the text, ranking); the grammars in the order of the ranking. Blank texts are valid."""
    own, ranked = GRAMMAR_OF[ext], rank(text)
    if not text.strip(ecma.BOM + " \t\r\n\f\v"):
        return "valid", own, [own], ranked
    known = takes(grammars, text)
    takers = [g for g in ranked if known[g]]
    if known[own]:
        return "valid", own, takers, ranked
    if known[own] is None:
        return "too deep", None, takers, ranked
    return ("foreign", takers[0], takers, ranked) if takers else ("corrupt", None, takers, ranked)


def parse_files(files: DataFrame) -> DataFrame:
    """A row with the verdict for each row of files(file_id, repo, ext, raw, version).

    Rows with a null id, a null text or an extension without a grammar get none. Further columns are ignored, whatever their names;
    repeated rows give repeated verdicts; an empty table gives none. Texts of any length are parsed whole.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for f, repo, ext, raw, v in pdf.itertuples(index=False, name=None):
                verdict, as_, takers, ranked = judge(_made, ext, raw)
                out.append((f, repo, ext, verdict, as_, takers, ranked, verdict != "valid" and bool(CONFLICT.search(raw)), v))
            yield pd.DataFrame(out, columns=["file_id", "repo", "ext", "verdict", "parsed_as", "taken_by", "ranked", "has_marker", "version"])

    rows = files.select("file_id", "repo", F.lower("ext").alias("ext"), "raw", "version")
    return rows.where(F.col("file_id").isNotNull() & F.col("raw").isNotNull() & F.col("ext").isin(*GRAMMAR_OF)).mapInPandas(parse, VERDICTS)


def rates(verdicts: DataFrame) -> DataFrame:
    """Files that do not parse, per repo and language, and why."""
    language = F.create_map(*[F.lit(x) for e, g in GRAMMAR_OF.items() for x in (e, LANGUAGE_OF[g])])[F.col("ext")]
    return (
        verdicts.groupBy("repo", language.alias("lang"))
        .agg(F.count("*").alias("n_files"), F.count_if(F.col("verdict").isin("foreign", "corrupt")).alias("n_bad"),
             F.count_if(F.col("verdict") == "foreign").alias("n_foreign"), F.count_if(F.col("has_marker")).alias("n_conflict"))
        .withColumn("bad_rate", F.round(F.col("n_bad") / F.col("n_files"), 4))
    )
