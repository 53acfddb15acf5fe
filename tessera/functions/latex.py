"""A small reader of LaTeX source: groups, commands, and the text that is left without them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Commands that stand for letters.
LETTERS = {"i": "i", "j": "j", "o": "o", "O": "O", "l": "l", "L": "L", "ss": "ss", "ae": "ae", "AE": "AE", "oe": "oe", "OE": "OE", "aa": "a", "AA": "A"}


def group(s: str, at: int, opening: str = "{", closing: str = "}") -> tuple[str | None, int]:
    """Content of the balanced group that opens at ``at``, behind white space, and the index behind it."""
    start = at
    while start < len(s) and s[start].isspace():
        start += 1
    if s[start : start + 1] != opening:
        return None, at
    depth, i = 0, start
    while i < len(s):
        c = s[i]
        if c == "\\":
            i += 2
            continue
        if c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if depth == 0:
                return s[start + 1 : i], i + 1
        elif c == "{" and opening == "[":  # a bracket within braces is text
            inner, behind = group(s, i)
            i = i if inner is None else behind - 1
        i += 1
    return None, at


def name_at(s: str, at: int) -> int:
    """Index behind the letters of a command name that begins at ``at``."""
    while at < len(s) and s[at].isascii() and s[at].isalpha():
        at += 1
    return at


def commands(s: str) -> Iterator[tuple[str, int, int]]:
    """Name, index of the backslash and index behind name and star of each command."""
    i = s.find("\\")
    while i >= 0:
        j = name_at(s, i + 1)
        if j > i + 1:
            yield s[i + 1 : j], i, j + (s[j : j + 1] == "*")
        i = s.find("\\", max(j, i + 2))


def plain(s: str) -> str:
    """The text of LaTeX source: arguments stay, commands, accents' marks and braces go."""
    out, i = [], 0
    while i < len(s):
        c = s[i]
        i += 1
        if c == "\\":
            j = name_at(s, i)
            if j > i:
                name, i = s[i:j], j + (s[j : j + 1] == "*")
                if name in LETTERS:
                    out.append(LETTERS[name])
                    i += s[i : i + 1] == " "
                    continue
                _, i = group(s, i, "[", "]")
                if group(s, i)[0] is None:
                    out.append(" ")
            elif s[i : i + 1] in tuple("&%$#_{}"):
                out.append(s[i])
                i += 1
            else:  # an accent's mark stands before its letter; a space or line break separates
                out.append(" " if s[i : i + 1] in ("", " ", "\\", "\n", ",", ";") else "")
                i += 1
        elif c not in "{}":
            out.append(" " if c == "~" else c)
    return " ".join("".join(out).split())


@F.pandas_udf(StringType())
def flatten_latex(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else plain(x))
