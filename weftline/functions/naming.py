"""Names: snake and Pascal case, sanitising, variables and placeholders."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import tokens


def pascal(name: str) -> str:
    return "".join(p[:1].upper() + p[1:].lower() for p in re.split(r"[_\W]+", name) if p)


def snake(name: str) -> str:
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"_+", "_", re.sub(r"\W+", "_", name)).strip("_").lower()


def identifier(name: str) -> str:
    """A plain identifier: letters, digits and underscores, not beginning with a digit."""
    out = re.sub(r"\W+", "_", name.strip()).strip("_") or "col"
    return f"_{out}" if out[0].isdigit() else out


def without_number(name: str) -> str:
    return re.sub(r"^\d+_", "", name).lower()


def is_placeholder(text: str) -> bool:
    return bool(re.fullmatch(r"\s*(?:\?|:\w+|\$\$?\{?\w+\}?|@\w+|<\w+>|TODO|TBD|N/?A)?\s*", text, re.I))


_VARIABLE = re.compile(r"\$\$(\w+)|\$\{(\w+)\}")
#: Words before which, or a dot beside which, a variable is a name and no value.
_NAMES = re.compile(r"(?i)(?:\b(?:FROM|JOIN|INTO|UPDATE|TABLE|USING)\s+|\.)$")


def filled(text: str, variables: Mapping[str, object], put: Callable[[str, object], str] = lambda _, v: literal(v)) -> str:
    """``$$name`` and ``${name}`` replaced by what ``put`` makes of the name and its value; unknown ones are an error.

    A quoted literal that is a variable alone becomes a text value, one that
    holds variables among other text a concat. Without quotes a variable is a
    value, a number if it looks like one, but where a table or schema stands: a
    name there must be a plain one.
    """

    def value(m: re.Match):
        key = m[1] or m[2]
        if key not in variables:
            raise KeyError(f"no value for variable {key!r}")
        return key, variables[key]

    def quoted_text(t: str) -> str:
        out, at, inside = [], 0, t[1:-1]
        for m in _VARIABLE.finditer(inside):
            if m.start() > at:
                out.append(f"'{inside[at : m.start()]}'")
            key, v = value(m)
            out.append(put(f"{key}_text", str(v)))
            at = m.end()
        if at < len(inside):
            out.append(f"'{inside[at:]}'")
        return out[0] if len(out) == 1 else f"concat({', '.join(out)})"

    def bare(part: str) -> str:
        def one(m: re.Match) -> str:
            key, v = value(m)
            if _NAMES.search(part[: m.start()]) or part[m.end() :].startswith("."):
                if not re.fullmatch(r"\w+(\.\w+)*", str(v)):
                    raise ValueError(f"variable {key!r} isn't a plain name")
                return str(v)
            if isinstance(v, str) and re.fullmatch(r"-?\d+(\.\d+)?", v):
                v = Decimal(v) if "." in v else int(v)
            return put(key, v)

        return _VARIABLE.sub(one, part)

    out, run = "", ""
    for t in tokens(text):
        if t.startswith("'") and _VARIABLE.search(t):
            out, run = out + bare(run) + quoted_text(t), ""
        elif t.startswith(("'", "--", "/*")):
            out, run = out + bare(run) + t, ""
        else:
            run += t
    return out + bare(run)


def bound(text: str, variables: Mapping[str, object]) -> tuple[str, dict[str, object]]:
    """A statement with named markers for its variables, and the markers' typed values, as ``spark.sql`` takes them."""
    args: dict[str, object] = {}

    def put(key: str, v: object) -> str:
        args[f"v_{key}"] = v
        return f":v_{key}"

    return filled(text, variables, put), args


def inlined(text: str, variables: Mapping[str, object]) -> str:
    """An expression with its variables as literals."""
    return filled(text, variables, lambda _, v: literal(v))


def literal(v: object) -> str:
    """A value as a literal of Spark's SQL."""
    if v is None:
        return "NULL"
    if isinstance(v, bool | int | Decimal):
        return str(v).upper() if isinstance(v, bool) else str(v)
    if isinstance(v, float):
        return f"double('{v!r}')"
    kind = "TIMESTAMP_NTZ" if isinstance(v, datetime.datetime) else "DATE" if isinstance(v, datetime.date) else ""
    return kind + "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def pascal_column(name: Column) -> Column:
    return F.regexp_replace(F.initcap(F.regexp_replace(name, "[^A-Za-z0-9]+", " ")), " ", "")
