"""Checks of tables: value quality, contents, and whether what was written is what was meant."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions.scalars import truth

DAY_MS = 86_400_000


def history_quality(df: DataFrame, artist: str, time: str, ms: str, flags: Sequence[str], most: float = 0.5, longest_ms: int = DAY_MS) -> DataFrame:
    """(check, bad, share, passed): blank artists, missing times, durations out of range, flags that are no truth value; one pass."""
    bad = {artist: F.trim(F.coalesce(F.col(artist), F.lit(""))) == "", time: F.col(time).isNull(), ms: F.col(ms).isNull() | (F.col(ms) < 0) | (F.col(ms) > longest_ms)}
    bad |= {f: F.col(f).isNotNull() & truth(F.col(f)).isNull() for f in flags}
    one = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(c).alias(f"_{k}") for k, c in bad.items()))
    share = lambda k: F.when(F.col("_n") > 0, F.col(f"_{k}") / F.col("_n")).otherwise(0.0)
    row = lambda name, n, s, ok: F.struct(F.lit(name).alias("check"), n.cast("long").alias("bad"), F.round(s, 9).alias("share"), ok.alias("passed"))
    rows = [row("rows", F.col("_n"), F.lit(0.0), F.col("_n") > 0), *(row(k, F.col(f"_{k}"), share(k), share(k) <= most) for k in bad)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def violations(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """(constraint, violations): rows for which each SQL condition isn't true."""
    one = df.agg(*(F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in checks.items()))
    return one.unpivot([], list(checks), "constraint", "violations")


def blocked_content(df: DataFrame, names: str, values: str) -> DataFrame:
    """(column, rows): columns whose name matches, and how many values of text columns match, the patterns (regular expressions)."""
    import re

    text = [c for c, t in df.dtypes if t == "string"]
    counted = df.agg(*(F.count_if(F.col(c).rlike(values)).alias(c) for c in text)).unpivot([], text, "column", "rows") if text else None
    named = df.sparkSession.createDataFrame([(c, -1) for c in df.columns if re.search(names, c)], "column string, rows long")
    return named if counted is None else counted.where("rows > 0").unionByName(named)


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, xor, sum): the same for the same rows in any order; the sum catches pairs that cancel in the xor."""
    h = F.xxhash64(*(F.to_json(F.struct(c)) if t.startswith("map") else F.col(c) for c, t in sorted(df.dtypes)))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"))


def row_count_findings(now: dict[str, int], before: dict[str, int], upstream: dict[str, Sequence[str]]) -> list[tuple[str, str]]:
    """(table, finding): dropped to zero, recovered from zero, or empty though a table it comes from is not."""
    found = []
    for name, n in sorted(now.items()):
        if n == 0 and before.get(name, 0) > 0:
            found.append((name, "dropped to zero"))
        elif n > 0 and before.get(name) == 0:
            found.append((name, "recovered"))
        elif n == 0 and any(now.get(u, 0) > 0 for u in upstream.get(name, ())):
            found.append((name, "empty below data"))
    return found


LOGICAL = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "float", "double": "float", "boolean": "boolean", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "timestamp"}


def logical_type(kind: str) -> str:
    return "float" if kind.startswith("decimal") else LOGICAL.get(kind, "string")


def same_table(wanted: DataFrame, found: DataFrame) -> list[str]:
    """Differences in columns, logical types and row count."""
    a, b = ({c: logical_type(t) for c, t in d.dtypes} for d in (wanted, found))
    out = [f"missing column {c}" for c in a if c not in b] + [f"extra column {c}" for c in b if c not in a] + [f"{c} is {b[c]}, not {a[c]}" for c in a if c in b and a[c] != b[c]]
    n, m = wanted.count(), found.count()
    return out + ([f"{m} rows, not {n}"] if n != m else [])


def any_match(columns: Sequence[str], pattern: str):
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in columns))
