"""Web components: registrations, events and templates joined to their classes. Native plans over texts and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import bindings, css_tokens, template_tags

MOST = 16  # entries of a list that are kept, after they are trimmed and made distinct


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return compact_list(found)


def compact_list(entries: Column) -> Column:
    """Entries as found, trimmed, empty and repeated ones left out, the first ``MOST`` of them."""
    return F.slice(F.array_distinct(F.filter(F.transform(entries, F.trim), lambda x: x != "")), 1, MOST)


def registrations(files: DataFrame) -> DataFrame:
    """(file_id, class_name, tag): X.reg('tag') and customElements.define('tag', X)."""
    a = F.regexp_extract_all("raw", F.lit(r"\b([A-Z]\w*)\.reg\(\s*['\"`]([a-z][\w-]*)['\"`]"), F.lit(1))
    at = F.regexp_extract_all("raw", F.lit(r"\b([A-Z]\w*)\.reg\(\s*['\"`]([a-z][\w-]*)['\"`]"), F.lit(2))
    b = F.regexp_extract_all("raw", F.lit(r"customElements\.define\(\s*['\"`]([a-z][\w-]*)['\"`]\s*,\s*([A-Z]\w*)"), F.lit(2))
    bt = F.regexp_extract_all("raw", F.lit(r"customElements\.define\(\s*['\"`]([a-z][\w-]*)['\"`]\s*,\s*([A-Z]\w*)"), F.lit(1))
    pairs = F.explode(F.arrays_zip(F.concat(a, b).alias("class_name"), F.concat(at, bt).alias("tag")))
    return files.where("raw is not null").select("file_id", pairs.alias("z")).select("file_id", "z.class_name", "z.tag").distinct()


def web_calls(files: DataFrame) -> DataFrame:
    """(file_id, listeners, dispatches, subscriptions) of each file."""
    return files.where("raw is not null").select(
        "file_id", _all(F.col("raw"), r"\.addEventListener\(\s*['\"`]([\w:.-]+)['\"`]").alias("listeners"),
        _all(F.col("raw"), r"\bnew\s+(?:CustomEvent|Event)\(\s*['\"`]([\w:.-]+)['\"`]").alias("dispatches"),
        _all(F.col("raw"), r"\.(?:sub|pub|multiPub)\(\s*['\"`]([\w:./-]+)['\"`]").alias("subscriptions"),
    )


def components(files: DataFrame, classes: DataFrame, imports: DataFrame) -> DataFrame:
    """One row for each class that is a component: it has a tag, a template or a style.

    files(file_id, repo, path_rel, raw), classes(file_id, repo, path_rel, name, extends), imports(file_id, source, names). Template and style are the imported modules
    that end on .tpl.js and .css.js, found by their path. Children are custom elements of the template other than the component itself.
    """
    tags = registrations(files)
    module = lambda end: imports.where(F.col("source").endswith(end)).groupBy("file_id").agg(F.min("source").alias("source"))
    folder = F.regexp_replace("path_rel", r"[^/]*$", "")
    place = files.select("file_id", "repo", folder.alias("folder"))
    path = F.concat("folder", F.regexp_replace("source", r"^\./", ""))
    t = F.coalesce("raw", F.lit(""))
    # what is asked of a template or style is made where its text is read; texts are not moved
    asked = {
        "template": {"tags": template_tags(t), "refs": _all(t, r"\bref=['\"]([\w-]+)"), "bindings": bindings(t), "template_events": F.transform(_all(t, r"\bon([A-Za-z]+)\s*[=:]"), lambda e: F.lower(e)), "item_tags": _all(t, r"item-tag=['\"]([\w-]+)")},
        "style": {"css_tokens": css_tokens(t)},
    }
    made = lambda name: files.select("repo", F.col("path_rel").alias("path"), *[c.alias(k) for k, c in asked[name].items()])
    found = lambda end, name: module(end).join(place, "file_id").select("file_id", "repo", path.alias("path")).join(made(name), ["repo", "path"], "left").select("file_id", F.col("path").alias(name), *asked[name])
    rows = (
        classes.select("file_id", "repo", "path_rel", "name", "extends").join(tags.withColumnRenamed("class_name", "name"), ["file_id", "name"], "left")
        .join(found(".tpl.js", "template"), "file_id", "left").join(found(".css.js", "style"), "file_id", "left").join(web_calls(files), "file_id", "left")
    )
    own = F.coalesce("tag", F.lit(""))
    none = F.array().cast("array<string>")
    lists = [F.coalesce(c, none).alias(c) for c in ("refs", "bindings", "template_events", "item_tags", "css_tokens")]
    return rows.where("tag is not null or template is not null or style is not null").select(
        "file_id", "repo", "path_rel", "name", "tag", "template", "style", F.filter(F.coalesce("tags", none), lambda x: x != own).alias("children"), *lists, "listeners", "dispatches", "subscriptions",
    )


def element_edges(rows: DataFrame) -> DataFrame:
    """(repo, src, dst): components whose template uses another component's tag."""
    uses = rows.select("repo", F.col("name").alias("src"), F.explode("children").alias("tag"))
    return uses.join(rows.where("tag is not null").select("repo", "tag", F.col("name").alias("dst")), ["repo", "tag"]).where("src <> dst").select("repo", "src", "dst").distinct()
