"""Which columns of a layer hold its codes and names."""

from __future__ import annotations

import re

# Patterns in order of preference, matched without regard to case.
CODE_PATTERNS = (
    r"^(gid|fid)$",
    r"^(geoid|pcode|adm[0-9]?_?pcode|p_code|iso3?|iso_a[23])$",
    r"^(fips|hasc|adm_code)$",
    r"^(code|id)$",
    r"code$",
)
NAME_PATTERNS = (
    r"^name$",
    r"^(.*_name|name_.*)$",
    r"^(label|title|display.*|short.*name|long.*name)$",
    r"^adm[0-9]?_?(en|name)$",
)


def detect_columns(columns: list[str]) -> tuple[str | None, str | None]:
    """The likely (code, name) columns; an earlier pattern outranks an earlier column, and ``fid`` is never meant."""
    own = [c for c in columns if c != "fid"]

    def first(patterns: tuple[str, ...]) -> str | None:
        return next((c for p in patterns for c in own if re.search(p, c, re.IGNORECASE)), None)

    return first(CODE_PATTERNS), first(NAME_PATTERNS)
