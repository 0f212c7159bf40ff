"""Python source files: the interpreter's own parser, symbol table and compiler; no code is run."""

from __future__ import annotations

import warnings

BOM = chr(0xFEFF)


class Grammar:
    def __init__(self, name: str = "py"):
        pass

    def check(self, text: str) -> bool | None:
        """Whether the text is valid; None if it is nested too deep for the parser to tell.

        The stages behind the parser may give up on a deep tree, too, but only after the parser has taken the text: that is valid.
        """
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                compile(text.removeprefix(BOM), "file", "exec", dont_inherit=True)
                return True
            except RecursionError:
                return True
            except (MemoryError, OverflowError):
                return None
            except (SyntaxError, ValueError) as e:
                return None if "too many nested" in str(e) or "too complex" in str(e) else False
