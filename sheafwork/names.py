"""Canonical field names: camelCase, so that my_name and myName are one field."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W_A-Z]+|[A-Z]")
#: Names that were made canonical before.
KNOWN: dict[str, str] = {}


def canonical(name: str) -> str:
    found = KNOWN.get(name)
    if found is None:
        parts = [p.lower() for p in PARTS.findall(name)]
        found = (parts[0] + "".join(p[:1].upper() + p[1:] for p in parts[1:])) if parts else name
        if len(KNOWN) < 1000:
            KNOWN[name] = found
    return found


def with_canonical_names(df: DataFrame) -> DataFrame:
    return df.select(*[df[f"`{c}`"].alias(canonical(c)) for c in df.columns])
