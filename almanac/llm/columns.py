"""Column helpers of the operators that stay in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# White space of the word rules: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Matches handled by one inner loop of ``match_spans``: the cost of growing an array stays linear.
_STEP = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also inside lambda functions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all other characters as they are."""
    return F.translate(text, _UPPER, _LOWER)


def n_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def beside(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with more columns; an input column of the same name gives way, in whatever case it is written."""
    taken = {name.lower() for name in columns}
    kept = ["`" + c.replace("`", "``") + "`" for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[col.alias(name) for name, col in columns.items()])


def match_spans(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """All matches, left to right without overlap: structs ``start``, ``end`` (code points, end exclusive), ``got``.

    ``got`` is the text of ``group``. The pattern must not match the empty string or look beyond
    its own match to the left. Matches are gathered in steps, so that a text with very many costs
    no quadratic copying.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    if group:
        found = F.arrays_zip(
            F.transform(whole, lambda m: F.length(m)).alias("n"),
            F.regexp_extract_all(text, pattern, F.lit(group)).alias("got"),
        )
    else:
        found = F.transform(whole, lambda m: F.struct(F.length(m).alias("n"), m.alias("got")))
    return let(
        F.struct(between.alias("between"), found.alias("found")),
        lambda x: _placed(x["between"], x["found"]),
    )


def _placed(between: Column, found: Column) -> Column:
    span = "struct<start:int,end:int,got:string>"

    def step(done: Column, at: Column) -> Column:
        part = F.slice(found, at * _STEP + 1, F.lit(_STEP))
        inner = F.aggregate(
            F.sequence(F.lit(1), F.size(part)),
            F.struct(done["at"].alias("at"), F.array().cast(f"array<{span}>").alias("spans")),
            lambda acc, i: let(
                acc["at"] + F.get(between, at * _STEP + i - 1),
                lambda start: F.struct(
                    (start + F.get(part, i - 1)["n"]).alias("at"),
                    F.concat(acc["spans"], F.array(F.struct(
                        start.alias("start"), (start + F.get(part, i - 1)["n"]).alias("end"),
                        F.get(part, i - 1)["got"].alias("got"),
                    ))).alias("spans"),
                ),
            ),
        )
        return let(inner, lambda x: F.struct(
            x["at"].alias("at"), F.concat(done["steps"], F.array(x["spans"])).alias("steps")
        ))

    steps = F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / F.lit(_STEP)).cast("int")),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{span}>>").alias("steps")),
        step,
        lambda acc: F.flatten(acc["steps"]),
    )
    return F.when(F.size(found) > 0, steps).otherwise(F.array().cast(f"array<{span}>"))
