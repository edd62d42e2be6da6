"""Tokens of SQL text, and what lies outside its literals."""

from __future__ import annotations

import re
from collections.abc import Callable

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|\$?[A-Za-z_][\w$#]*|\d+(?:\.\d+)?|\|\||==|\*=|=\*|<>|!=|<=|>=|&&|\s+|.", re.S)


def tokens(text: str) -> list[str]:
    """Literals, quoted names, comments, words, numbers, signs and blanks; joined they are the text."""
    return _TOKEN.findall(text)


def split_arguments(parts: list[str]) -> list[str]:
    out, depth = [""], 0
    for t in parts:
        depth += (t == "(") - (t == ")")
        if t == "," and not depth:
            out.append("")
        else:
            out[-1] += t
    return [x.strip() for x in out] if "".join(out).strip() else []


def outside(text: str, change: Callable[[str], str]) -> str:
    """``change`` applied to what isn't a literal, a quoted name or a comment."""
    out, run = "", ""
    for t in tokens(text):
        if t.startswith(("'", '"', "--", "/*")):
            out, run = out + change(run) + t, ""
        else:
            run += t
    return out + change(run)


def is_word(t: str) -> bool:
    return bool(re.match(r'[A-Za-z_"`]', t))


def closing(parts: list[str], i: int) -> int:
    """The place of the parenthesis that closes the one at ``i``."""
    depth = 0
    for k in range(i, len(parts)):
        depth += (parts[k] == "(") - (parts[k] == ")")
        if not depth:
            return k
    raise ValueError(f"a parenthesis isn't closed in {''.join(parts)!r}")
