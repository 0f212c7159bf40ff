"""Settings of a run: immutable, passed explicitly; nothing is kept between runs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column

from codelode.functions.text import EXCLUDED_DIRS, EXCLUDED_GLOBS, excluded


@dataclass(frozen=True)
class Filters:
    """What a scan leaves out."""

    dirs: tuple[str, ...] = tuple(EXCLUDED_DIRS)
    globs: tuple[str, ...] = tuple(EXCLUDED_GLOBS)
    ignore: tuple[str, ...] = ()
    hidden: bool = False

    def add(self, dirs: list[str] = (), globs: list[str] = ()) -> "Filters":
        return replace(self, dirs=(*self.dirs, *(d for d in dirs if d not in self.dirs)), globs=(*self.globs, *(g for g in globs if g not in self.globs)))

    def remove(self, dirs: list[str] = (), globs: list[str] = ()) -> "Filters":
        return replace(self, dirs=tuple(d for d in self.dirs if d not in dirs), globs=tuple(g for g in self.globs if g not in globs))

    def with_ignore_file(self, text: str) -> "Filters":
        lines = [x.strip() for x in text.splitlines()]
        return replace(self, ignore=tuple(x for x in lines if x and not x.startswith("#")))

    def excluded(self, path: Column) -> Column:
        return excluded(path, list(self.dirs), list(self.globs), list(self.ignore), self.hidden)


MODES = {1: "Compact: sources are kept small, documentation beside them", 2: "Full: sources are kept as written"}


@dataclass(frozen=True)
class Mode:
    """How sources are kept. Only the modes listed are valid; an unreadable file gives the defaults."""

    mode: int = 2
    beautify: bool = True
    auto_validate: bool = False
    strip_docs: bool = False

    @staticmethod
    def load(path: str) -> "Mode":
        try:
            values = json.loads(Path(path).read_text())
            known = {k: values[k] for k in ("mode", "beautify", "auto_validate", "strip_docs") if k in values}
            return Mode(**known).checked()
        except (OSError, ValueError, TypeError):
            return Mode()

    def checked(self) -> "Mode":
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode}; valid are {sorted(MODES)}")
        return self

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.checked().__dict__, indent=2))

    def describe(self) -> str:
        return MODES[self.checked().mode]


@dataclass(frozen=True)
class Workspace:
    """Paths are resolved below a root and must stay there."""

    root: Path = field(default_factory=Path.cwd)

    def resolve(self, path: str) -> Path:
        full = (self.root / path).resolve()
        if not full.is_relative_to(self.root.resolve()):
            raise ValueError(f"{path} is outside of {self.root}")
        return full
