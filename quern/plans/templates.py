"""SQL templates: ``{x}`` quoted, ``{x_raw}`` verbatim, ``{{`` a brace, and computed values.

``{@now}`` and ``{@last_run}`` are quoted times (the last successful run's start; the epoch before the first), ``{@prev}`` and
``{@input}`` the name of the previous step's view, ``{@step:id:column}`` a list of literals for ``IN (..)`` (NULL without rows).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

_TOKEN = re.compile(r"\{\{|\}\}|\{(@?[\w:.]+)\}")


def quote(value: object) -> str:
    """A literal: null, a bare number or boolean, or text with its quotes and backslashes escaped."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def render(sql: str, values: Mapping[str, object], special: Mapping[str, object] | None = None, step: Callable[[str, str], Sequence[object]] | None = None) -> str:
    """Fills a template; unknown names are errors.  Raw values may not hold ``;``, comment marks or ``..``."""

    def fill(m: re.Match) -> str:
        if m[0] in ("{{", "}}"):
            return m[0][0]
        name = m[1]
        if name.startswith("@step:"):
            _, ident, column = name.split(":")
            return ", ".join(quote(v) for v in step(ident, column)) or "NULL"
        if name in ("@prev", "@input"):
            if not (special or {}).get("prev"):
                raise KeyError(f"{name}: no step before this one")
            return special["prev"]
        if name.startswith("@"):
            return quote((special or {})[name[1:]])
        if name in values:
            return quote(values[name])
        if name.endswith("_raw") and name[:-4] in values:
            raw = str(values[name[:-4]])
            if re.search(r";|--|/\*|\.\.", raw):
                raise ValueError(f"unsafe raw value for {name[:-4]}")
            return raw
        raise KeyError(name)

    return _TOKEN.sub(fill, sql)


def fill_vars(text: str, values: Mapping[str, object]) -> str:
    """``{{ name }}`` in YAML text; unknown names stay as they are."""
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: str(values[m[1]]) if m[1] in values else m[0], text)
