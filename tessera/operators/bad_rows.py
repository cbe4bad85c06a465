"""Rows that fail to parse: generated row patterns, and the first broken field of what doesn't match.

A `RowSchema` yields one anchored pattern for whole valid rows. Lines that it accepts load; the others run
through patterns of growing field prefixes, the first that fails names the broken field.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.util import join_small

INTEGER = "[0-9]++"
DECIMAL = r"[+-]?+(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][+-]?+[0-9]++)?+"
#: Ends of a line that don't count, and what separates fields.
ENDS, GAP = r"[ \t\r]", r"[ \t]++"
BARE, QUOTED = r'[^ \t"]++', r'"(?:[^"]|"")*+"'


@dataclass(frozen=True)
class Field:
    name: str
    pattern: str = DECIMAL
    above: float | None = None  # exclusive
    most: float | None = None  # inclusive


@dataclass(frozen=True)
class RowSchema:
    """Leading typed fields that are never quoted, then up to `extras` free ones that may be."""

    fields: tuple[Field, ...]
    extras: int

    def row(self) -> str:
        """Whole valid rows, ends trimmed."""
        return "^" + GAP.join(f.pattern for f in self.fields) + f"(?:{GAP}(?:{QUOTED}|{BARE})(?![^ \\t])){{0,{self.extras}}}+$"

    def quoting(self) -> str:
        """Rows whose double quotes, if any, enclose whole fields after the typed ones."""
        n = len(self.fields)
        return f"^(?:{BARE}(?:{GAP}|$)){{0,{n - 1}}}+(?:$|{BARE}(?:{GAP}(?:{QUOTED}|{BARE})(?![^ \\t]))*+$)"

    def columns(self) -> str:
        """Well-quoted rows with an admissible number of fields."""
        n = len(self.fields)
        return f"^{BARE}(?:{GAP}{BARE}){{{n - 1}}}+(?:{GAP}(?:{QUOTED}|{BARE})(?![^ \\t])){{0,{self.extras}}}+$"

    def prefix(self, k: int) -> str:
        """Rows whose first k fields are well-formed."""
        return "^" + GAP.join(f.pattern for f in self.fields[:k]) + r"(?![^ \t])"


BOX_ROW = RowSchema((Field("class_id", INTEGER), Field("xc"), Field("yc"), Field("w", above=0.0, most=1.0), Field("h", above=0.0, most=1.0)), extras=2)


def trimmed(raw: Column) -> Column:
    return F.regexp_replace(raw, f"^{ENDS}+|{ENDS}+$", "")


def _in_range(f: Field, value: Column) -> Column:
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    if f.above is not None:
        ok &= value > f.above
    if f.most is not None:
        ok &= value <= f.most
    return ok


def parse_rows(lines: DataFrame, classes: DataFrame, schema: RowSchema = BOX_ROW, raw: str = "raw") -> DataFrame:
    """lines with, added, a struct `row`: status (`blank`, `ok`, `bad`), reason, field (the first broken one) and the typed fields.

    The first field is the key into classes.class_id. Reasons, the first that applies: `quoting`, `columns`, `value`.
    A null line counts as blank. Only the struct is added, so other columns of lines may have any names.
    An empty classes table makes every non-blank line bad.
    """
    first, *rest = schema.fields
    known = classes.select(F.col("class_id").cast("bigint").alias("__id"), F.lit(True).alias("__known")).where("__id is not null").distinct()
    d = lines.withColumn("__t", trimmed(F.col(raw)))
    text = F.col("__t")
    d = d.withColumn("__row", F.coalesce(text.rlike(schema.row()), F.lit(False))).withColumn("__k", F.split(text, "[ \\t]+", len(schema.fields) + 1))
    d = join_small(d.withColumn("__id", F.expr("try_cast(get(__k, 0) as bigint)")), known, ["__id"], "left")
    num = {f.name: F.expr(f"try_cast(get(__k, {i}) as double)") for i, f in enumerate(rest, 1)}
    good = F.col("__row") & F.col("__known").isNotNull()
    for f in rest:
        good &= F.coalesce(_in_range(f, num[f.name]), F.lit(False))
    # patterns of growing prefixes: the first that fails, or the first value out of range, is the broken field
    broken = F.when(~text.rlike(schema.prefix(1)) | F.col("__known").isNull(), first.name)
    for k, f in enumerate(rest, 2):
        broken = broken.when(~text.rlike(schema.prefix(k)) | ~F.coalesce(_in_range(f, num[f.name]), F.lit(False)), f.name)
    broken = broken.otherwise("extras")
    reason = F.when(F.col("__row"), "value").when(~text.rlike(schema.quoting()), "quoting").when(~text.rlike(schema.columns()), "columns").otherwise("value")
    d = d.withColumn("__s", F.when(F.coalesce(text, F.lit("")) == "", "blank").when(good, "ok").otherwise("bad"))
    bad, ok = F.col("__s") == "bad", F.col("__s") == "ok"
    row = F.struct(F.col("__s").alias("status"), F.when(bad, reason).alias("reason"), F.when(bad, broken).alias("field"), F.when(ok, F.col("__id")).cast("int").alias(first.name), *(F.when(ok, num[f.name]).alias(f.name) for f in rest))
    return d.withColumn("row", row).drop("__t", "__row", "__k", "__id", "__known", "__s")


def loaded(parsed: DataFrame, keep: list[str], schema: RowSchema = BOX_ROW) -> DataFrame:
    """The rows that load: kept columns and the typed fields."""
    return parsed.where("row.status = 'ok'").select(*keep, *(F.col(f"row.{f.name}").alias(f.name) for f in schema.fields))


def rejected(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """The rows that don't: kept columns, reason and first broken field."""
    return parsed.where("row.status = 'bad'").select(*keep, F.col("row.reason").alias("reason"), F.col("row.field").alias("field"))
