"""Parsing by bracket groups.

A lexer turns a file into a string with one character for each token. The innermost bracket groups are then replaced,
again and again, by one character that stands for what the group can be (a block, arguments, a pattern ...). Groups with the
same tokens are parsed once: a table keyed by the token string remembers the result, and since names, numbers and strings are
single classes most groups of a corpus have been seen before. What a file is parsed into does not depend on the table.
"""

from __future__ import annotations

import re

#: characters that stand for groups; the table is emptied when they are used up. The two parts enclose an expression inside a template
FIRST, LAST = 0xF0000, 0x10FFFD
PART_OPEN, PART_CLOSE = chr(0xE310), chr(0xE311)
_NONE = rf"[^()\[\]{{}}{PART_OPEN}{PART_CLOSE}]*"
INNERMOST = re.compile(rf"\({_NONE}\)|\[{_NONE}\]|\{{{_NONE}\}}|{PART_OPEN}{_NONE}{PART_CLOSE}")
GROUPS_APART = re.compile(f"({INNERMOST.pattern})")
ANY_BRACKET = re.compile(rf"[()\[\]{{}}{PART_OPEN}{PART_CLOSE}]")


OPENING = {"(": ")", "[": "]", "{": "}", PART_OPEN: PART_CLOSE}


class Bad(Exception):
    """The tokens are not of the grammar."""


class Learned(dict):
    """The characters of groups by their text; a group that is not known is learnt."""

    def __init__(self, groups: "Groups"):
        self.groups = groups

    def __missing__(self, g: str) -> str:
        return self.groups.learn(g)


class Groups:
    """The table of groups of one grammar: ``classify`` gives a hashable description of a group's text, or None if it can be nothing."""

    def __init__(self, classify, limit: int = 100_000):
        self.classify, self.limit = classify, limit
        self.clear()

    def clear(self) -> None:
        self.by_text: dict[str, str] = Learned(self)
        self.by_kind: dict[object, str] = {}
        self.kind: dict[str, object] = {}

    def fold(self, text: str) -> str:
        """The text with every bracket group replaced; raises Bad if a bracket is left or a group can be nothing."""
        if len(self.by_text) > self.limit or len(self.by_kind) > (LAST - FIRST) // 2:
            self.clear()
        by_text = self.by_text
        for _ in range(40):
            parts = GROUPS_APART.split(text)
            if len(parts) == 1:
                if ANY_BRACKET.search(text):
                    raise Bad("bracket")
                return text
            parts[1::2] = [by_text[g] for g in parts[1::2]]
            text = "".join(parts)
        return self.fold_deep(text)

    def fold_deep(self, text: str) -> str:
        """In one pass with a stack, for texts nested so deep that a pass for each level would take too long."""
        stack, at = [[]], 0
        for m in ANY_BRACKET.finditer(text):
            stack[-1].append(text[at : m.start()])
            at, c = m.end(), m.group()
            if c in OPENING:
                stack.append([c])
            else:
                if len(stack) < 2 or OPENING[stack[-1][0]] != c:
                    raise Bad("bracket")
                g = "".join(stack.pop()) + c
                stack[-1].append(self.by_text.get(g) or self.learn(g))
        if len(stack) > 1:
            raise Bad("bracket")
        return "".join(stack[0]) + text[at:]

    def learn(self, g: str) -> str:
        kind = self.classify(g)
        if kind is None:
            raise Bad("group")
        c = self.by_kind.get(kind)
        if c is None:
            if FIRST + len(self.by_kind) > LAST:
                raise RecursionError("more kinds of groups in one file than there are characters for them")
            c = chr(FIRST + len(self.by_kind))
            self.by_kind[kind] = c
            self.kind[c] = kind
        if len(g) < 2000:
            self.by_text[g] = c
        return c
