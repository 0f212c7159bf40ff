"""Checks a graph-metadata document. One table says what each place must be; a walker visits the places."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

#: what a place must be, by the words of the message (fixed values)
KINDS: dict[str, Callable[[Any], bool]] = {
    "an array": lambda v: isinstance(v, list),
    "an object": lambda v: isinstance(v, dict),
    "a string": lambda v: isinstance(v, str),
    "a non-empty string": lambda v: isinstance(v, str) and v.strip() != "",
    "a non-empty array": lambda v: isinstance(v, list) and len(v) > 0,
    "an array of non-empty strings": lambda v: isinstance(v, list) and all(isinstance(x, str) and x.strip() for x in v),
    "a positive number": lambda v: _number(v) is not None and _number(v) >= 1,
    "a hex color": lambda v: re.fullmatch(r"#?(?:[0-9a-f]{3}|[0-9a-f]{6})", str(v).strip(), re.I) is not None,
}
MATCH_KEYS = ("paths", "patterns", "nodes", "path", "pattern", "node", "match")
#: (field, kind, whether it must be there, table of the elements)
BEAT = [("id", "a non-empty string", False, None), ("label", "a non-empty string", False, None), ("narrative", "a string", False, None), ("nodes", "an array of non-empty strings", False, None),
        ("edges", "an array of non-empty strings", False, None), ("clusterId", "a string", False, None), ("focusPath", "a string", False, None)]
STORY = [("id", "a non-empty string", False, None), ("label", "a non-empty string", False, None), ("description", "a string", False, None), ("beats", "a non-empty array", True, BEAT)]
CLUSTER = [("*match", "", False, None), ("color", "a hex color", False, None)]
DOCUMENT = [("version", "a positive number", False, None), ("clusters", "an array", False, CLUSTER), ("stories", "an array", False, STORY), ("hiddenNodes", "an array", False, None),
            ("focusPresets", "an array", False, None), ("nodeDescriptions", "an object", False, None), ("layoutPins", "an object", False, None)]


def _number(v: Any) -> float | None:
    try:
        return float(v) if not isinstance(v, (list, dict)) and v is not None and str(v).strip() else None
    except ValueError:
        return None


def _names_something(cluster: dict) -> bool:
    values = [cluster.get(k) for k in MATCH_KEYS]
    flat = [x for v in values for x in (v if isinstance(v, list) else [v] if isinstance(v, str) else [])]
    return any(x is not None and str(x).strip() for x in flat)


def _walk(value: dict, table: list, at: str) -> Iterator[str]:
    for field, kind, needed, inner in table:
        if field == "*match":
            if not _names_something(value):
                yield f"{at[:-1]} must define at least one path, pattern, node, or match"
            continue
        if field not in value and not needed:
            continue
        v = value.get(field)
        if not KINDS[kind](v):
            yield f"{at}{field} must be {kind}"
        elif inner is not None:
            for k, x in enumerate(v):
                if isinstance(x, dict):
                    yield from _walk(x, inner, f"{at}{field}[{k}].")
                else:
                    yield f"{at}{field}[{k}] must be an object"


def validate(document: Any) -> list[str]:
    """All errors of a parsed document."""
    return list(_walk(document, DOCUMENT, "")) if isinstance(document, dict) else ["metadata must be an object"]


def validate_text(text: str | None) -> list[str]:
    """All errors of a JSON text; a text that is no JSON has one."""
    try:
        return validate(json.loads(text or ""))
    except ValueError as e:
        return [f"metadata is not JSON: {e}"]
