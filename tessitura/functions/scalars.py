"""Expressions that bring raw values to one type and spelling. All run inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def text_or_null(c: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


@cache
def key_letters() -> tuple[dict[str, str], dict[str, str]]:
    """What is left for a name key of characters beyond ASCII, by Unicode's compatible decompositions: of those that leave one sign, and of those that leave several."""
    one, more = {}, {}
    for code in range(0x80, 0x20000):
        if 0xD800 <= code < 0xE000:
            continue
        left = re.sub(r"[^a-z0-9]", "", unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode().lower())
        if left:
            (one if len(left) == 1 else more)[chr(code)] = left
    return one, more


def name_key(c: Column) -> Column:
    """Compatible decomposition, accents and other signs beyond ASCII dropped, lower case, only a-z and 0-9 kept. In the JVM:
    by translation; names with a character that stands for several (ligatures, numerals) are spelt out before."""
    one, more = key_letters()
    spelt = F.create_map(*(F.lit(x) for pair in more.items() for x in pair))
    long = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(spelt, x), x)), "")
    text = F.when(c.rlike("[^\\x00-\\x7f]") & c.rlike("[" + "".join(more) + "]"), long).otherwise(c)
    return F.regexp_replace(F.lower(F.translate(text, "".join(one), "".join(one.values()))), "[^a-z0-9]", "")


def name_key_sql(c: str) -> str:
    """The same in SQL."""
    one, more = key_letters()
    spelt = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in more.items()) + "}"
    long = f"array_to_string(list_transform(string_split({c}, ''), lambda x: coalesce({spelt}[x], x)), '')"
    text = f"CASE WHEN regexp_matches({c}, '[{''.join(more)}]') THEN {long} ELSE {c} END"
    return f"regexp_replace(lower(translate({text}, '{''.join(one)}', '{''.join(one.values())}')), '[^a-z0-9]', '', 'g')"


def genre_label(c: Column) -> Column:
    """A genre's label: lower case, words of letters and digits joined by one blank; blank is null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(""))


def number(c: Column) -> Column:
    """As double; what is no number, and NaN, is null."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def truth(c: Column, more_true: Sequence[str] = (), more_false: Sequence[str] = ()) -> Column:
    """Boolean of many spellings; others are null."""
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS, *more_true), True).when(word.isin(*FALSE_WORDS, *more_false), False)


def tri_state(c: Column) -> Column:
    """As truth(), with t and f."""
    return truth(c, ("t",), ("f",))


def epoch_ms(c: Column) -> Column:
    """Whole milliseconds: values under 1e10 are seconds."""
    value = number(c).cast("long")
    return F.when(F.abs(value) < 10_000_000_000, value * 1000).otherwise(value)


def device_family(c: Column) -> Column:
    word = F.lower(F.coalesce(c, F.lit("")))
    return F.when(word.rlike("ios|iphone|ipad|android|mobile|phone|tablet"), "mobile").when(word.rlike("windows|mac|osx|linux|desktop|web"), "desktop").otherwise("other")


def content_type(**uris: Column) -> Column:
    """Name of the first of the given URIs that is not blank, else unknown."""
    found = F.lit("unknown")
    for name, uri in reversed(uris.items()):
        found = F.when(text_or_null(uri).isNotNull(), name).otherwise(found)
    return found


def release_date(raw: Column, precision: Column) -> Column:
    """Date of a release known to the year, month or day."""
    width = {"year": 4, "month": 7, "day": 10}
    found = F.lit(None).cast("timestamp")
    for name, n in width.items():
        padded = F.concat(F.substring(raw, 1, n), F.lit("-01-01"[: 10 - n] if n == 4 else "-01" if n == 7 else ""))
        found = F.when(precision == name, F.try_to_timestamp(padded, F.lit("yyyy-MM-dd"))).otherwise(found)
    return found.cast("date")


def listed(c: Column) -> Column:
    """A list from JSON, else from text joined by pipes; blank entries are left out."""
    parsed = F.from_json(c, "array<string>")
    parts = F.when(F.trim(c).startswith("["), parsed).otherwise(F.split(c, "\\|"))
    return F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


#: The same in SQL, of the column put in.
LISTED_SQL = "list_filter(list_transform(CASE WHEN trim({0}) LIKE '[%' THEN coalesce(TRY_CAST(TRY_CAST({0} AS JSON) AS VARCHAR[]), []) WHEN {0} IS NULL THEN [] ELSE string_split({0}, '|') END, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '')"


def label_by(value: Column, steps: Sequence[tuple[float, str]], rest: str) -> Column:
    """The label of the first threshold that the value reaches."""
    found = F.lit(rest)
    for least, label in reversed(steps):
        found = F.when(value >= least, label).otherwise(found)
    return found


def similarity_label(value: Column) -> Column:
    return label_by(value, [(0.5, "strong"), (0.25, "moderate"), (0.1, "light")], "distinct")


def leading(names: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Name of the largest of the columns (times its weight); of equals the first; null if all are null."""
    parts = [F.struct((F.coalesce(F.nanvl(F.col(n), F.lit(None)), F.lit(float("-inf"))) * w).alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, w) in enumerate(zip(names, weights or [1.0] * len(names)))]
    return F.when(F.coalesce(*(F.col(n) for n in names)).isNotNull(), F.array_max(F.array(*parts))["n"])
