"""Label lines, polygons and class-only lines as column expressions, by the rules of a lenient reader.

Tokens are split at white space of any script. Numbers follow Python's text forms: nan and inf are numbers, 1d and hexadecimal
forms aren't; digits with underscores or of other scripts are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOAT = r"(?i)^[+-]?(inf(inity)?|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"
_INT = "^[+-]?[0-9]+$"


def tokens(line: Column) -> Column:
    """Array of tokens; empty for a blank line, null for a null one."""
    t = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"(?U)\s+"))


def as_float(token: Column) -> Column:
    return F.when(token.rlike(_FLOAT), token.try_cast("double"))


def as_int(token: Column) -> Column:
    return F.when(token.rlike(_INT), token.try_cast("bigint"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def box_line(tok: Column) -> Column:
    """struct(class_id, xc, yc, w, h, extras) of a token array; null unless there are five tokens, an integer and four numbers."""
    names = ("class_id", "xc", "yc", "w", "h")

    def values(t: Column) -> Column:
        at = lambda i: F.get(t, F.lit(i))
        return F.when(F.size(t) >= 5, F.struct(as_int(at(0)).alias("class_id"), *(let(at(i), as_float).alias(n) for i, n in enumerate(names[1:], 1)), F.slice(t, F.lit(6), F.size(t)).alias("extras")))

    def whole(v: Column) -> Column:
        ok = v.isNotNull()
        for n in names:
            ok &= v[n].isNotNull()
        return F.when(ok, v)

    return let(let(tok, values), whole)


def score(tok: Column, index: int = 5) -> Column:
    """The score of a box line; null if absent or no number."""
    return as_float(F.get(tok, F.lit(index)))


def class_line(tok: Column) -> Column:
    """struct(class_id, rest) where only the class counts; null without an integer first token."""
    return F.when(as_int(F.get(tok, F.lit(0))).isNotNull(), F.struct(as_int(F.get(tok, F.lit(0))).alias("class_id"), F.slice(tok, F.lit(2), F.size(tok)).alias("rest")))


def polygon_box(coords: Column) -> Column:
    """struct(xc, yc, w, h): four values are a box already, an even number above is a polygon's bounds, an odd one of 4 + 3k key points led by a box; else null."""
    n = F.size(coords)
    box = lambda a, b, c, d: F.struct(a.alias("xc"), b.alias("yc"), c.alias("w"), d.alias("h"))
    first = box(*(F.get(coords, F.lit(i)) for i in range(4)))
    xs, ys = F.filter(coords, lambda _, i: i % 2 == 0), F.filter(coords, lambda _, i: i % 2 == 1)
    x1, x2, y1, y2 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.when(n == 4, first).when((n > 4) & (n % 2 == 0), box((x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1)).when((n > 4) & ((n - 4) % 3 == 0), first)


def polygon_line(tok: Column) -> Column:
    """struct(class_id, coords) of a polygon or key point line; null unless there are five tokens, an integer and numbers."""

    def read(t: Column) -> Column:
        coords = F.transform(F.slice(t, F.lit(2), F.size(t)), as_float)
        return F.when(F.size(t) >= 5, F.struct(as_int(F.get(t, F.lit(0))).alias("class_id"), coords.alias("coords")))

    return let(let(tok, read), lambda v: F.when(v["class_id"].isNotNull() & F.forall(v["coords"], lambda x: x.isNotNull()), v))
