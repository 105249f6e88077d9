"""Bringing tables to a declared schema, and columns to canonical names."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.functions.scalars import truth


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order: missing ones null, values that don't fit null, NaN null, truth values in any spelling."""
    made = []
    for f in schema.fields:
        if f.name not in df.columns:
            value = F.lit(None).cast(f.dataType)
        elif isinstance(f.dataType, T.BooleanType) and dict(df.dtypes)[f.name] != "boolean":
            value = truth(F.col(f.name))
        elif isinstance(f.dataType, T.TimestampType) and dict(df.dtypes)[f.name] == "string":
            value = F.try_to_timestamp(f.name)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            number = F.col(f.name).try_cast(f.dataType)
            value = F.when(~F.isnan(number), number)
        else:
            value = F.col(f.name).try_cast(f.dataType)
        made.append(value.alias(f.name))
    return df.select(*made)


def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def resolve_columns(columns: Sequence[str], aliases: Mapping[str, Sequence[str]], required: Sequence[str], explicit: Mapping[str, str] | None = None) -> dict[str, str]:
    """Which column each canonical name is read from.

    A choice made by hand stands before the name itself and its aliases, which are tried in turn and compared without case
    and punctuation. All that is wrong is told at once: choices for names that are none, choices of columns that aren't
    there, and required names without a column.
    """
    chosen = dict(explicit or {})
    wrong = [f"{name} is no canonical name" for name in chosen if name not in aliases]
    wrong += [f"no column {column} for {name}" for name, column in chosen.items() if name in aliases and column not in columns]
    ranks = {column: rank for rank, column in reversed(list(enumerate(map(plain_name, columns))))}
    found = {}
    for name, others in aliases.items():
        tried = [] if name in chosen else [ranks[p] for p in map(plain_name, (name, *others)) if p in ranks]
        if name in chosen:
            found[name] = chosen[name]
        elif tried:
            found[name] = columns[tried[0]]
        elif name in required:
            wrong.append(f"no column for {name}; tried {', '.join((name, *others))}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return found


def two_row_header(first: Sequence[str], second: Sequence[str]) -> list[str]:
    """Names of a table with two header rows: the upper entry runs on over blank ones; equal or blank parts are left out."""
    names, above = [], ""
    for a, b in zip(first, second):
        above = a.strip() or above
        parts = [x for x in dict.fromkeys((above, b.strip())) if x and not x.startswith("Unnamed")]
        names.append("_".join(parts) or f"column_{len(names)}")
    return names


def rest_as_json(df: DataFrame, taken: Sequence[str], into: str) -> DataFrame:
    """All other columns as one JSON object with sorted keys, nulls kept."""
    rest = sorted(c for c in df.columns if c not in taken)
    value = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
    return df.select(*taken, value.alias(into))
