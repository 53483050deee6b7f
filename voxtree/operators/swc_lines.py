"""Raw SWC lines as typed nodes, with the lines that fail and the reason for it.

Structure (quoting, number of fields) is judged line by line with possessive patterns, which neither
backtrack nor recurse, so that a line of any length is safe. Values are judged once each: the distinct
texts of every kind of column are cast, those that fail form a dictionary of invalid values with
reasons, and the dictionary is joined back to the lines' fields. Fields and dictionary are written to the
shared folder first; the true size of the dictionary then decides between a broadcast and a shuffled join.

Defined results: a null line is blank; a line of an unknown neuron, or one without ``n_cols``, must
have seven fields; repeated rows give one rejected line; columns that other tables add are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtree.session import materialize

_S = r"[ \t\r\n]"
_FIELD = r'(?:"[^"]*+"|[^ \t\r\n"#]++)'
#: Fields apart from each other, no stray quote, then perhaps a comment.
SOUND = rf"(?s)\A(?:{_S}*+{_FIELD}(?={_S}|#|\z))*+{_S}*+(?:#.*)?\z"
_BODY = r'(?s)\A((?:"[^"]*+"|[^"#]++)*+)'
_NOT_A_ROW = rf"(?s)\A{_S}*+(?:\z|#|id)"
#: The spellings of length units.
LENGTH_UNIT = r"(?:[uµμ]m|microns?|micromet(?:er|re)s?|nm|nanomet(?:er|re)s?|mm|millimet(?:er|re)s?)"
_WHOLE = r"\A[+-]?[0-9]+\z"
_REAL = rf"(?i)\A[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?{_S}*+{LENGTH_UNIT}?\z"
_NUMBER = r"\A([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
#: Name and kind of the seven standard columns, in file order.
COLUMNS = (("node_id", "id"), ("node_type", "type"), ("x", "real"), ("y", "real"), ("z", "real"), ("radius", "size"), ("parent_id", "parent"))


def whole(text: Column) -> Column:
    """The text as a 32-bit number, else null."""
    n = F.when(text.rlike(_WHOLE), text).try_cast("decimal(38,0)")
    return F.when(n.between(-(2**31), 2**31 - 1), n.cast("int"))


def real(text: Column) -> Column:
    """The text's finite number without its unit, else null."""
    v = F.when(text.rlike(_REAL), F.regexp_extract(text, _NUMBER, 1)).try_cast("double")
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def _sound_value(kind: Column, text: Column) -> Column:
    n, v = whole(text), real(text)
    return (
        F.when(kind == "id", n >= 1)
        .when(kind == "type", n >= 0)
        .when(kind == "parent", (n >= 1) | (n == -1))
        .when(kind == "size", v > 0)
        .otherwise(v.isNotNull())
    )


@dataclass(frozen=True)
class ParsedLines:
    """``structure``: the row lines with their fields, a hash of the line (mark), and the reason of those of bad
    structure; ``invalid``: the dictionary of invalid values (kind, value)."""

    structure: DataFrame
    invalid: DataFrame

    def _bad_values(self) -> DataFrame:
        return _fields(self.structure).join(self.invalid, ["kind", "value"])

    def rejected(self) -> DataFrame:
        """neuron_id, line_no, reason, and the raw_line (the smallest of repeated ones that differ)."""
        structural = self.structure.where("reason is not null").select("neuron_id", "line_no", "reason", "raw_line")
        values = self._bad_values().select("neuron_id", "line_no", F.lit("value").alias("reason"), "raw_line")
        return structural.unionByName(values).groupBy("neuron_id", "line_no", "reason").agg(F.min("raw_line").alias("raw_line"))

    def valid(self) -> DataFrame:
        """neuron_id, line_no and the seven typed columns; further columns stay as text in ``extra``."""
        bad = self._bad_values().select(F.col("neuron_id").alias("_n"), F.col("line_no").alias("_l"), F.col("mark").alias("_m")).distinct()
        same = F.col("neuron_id").eqNullSafe(F.col("_n")) & F.col("line_no").eqNullSafe(F.col("_l")) & (F.col("mark") == F.col("_m"))
        good = self.structure.where("reason is null").join(bad, same, "left_anti")
        typed = [(real(f) if kind in ("real", "size") else whole(f)).alias(name) for i, (name, kind) in enumerate(COLUMNS) for f in [F.col("fields")[i]]]
        return good.select("neuron_id", "line_no", *typed, F.slice("fields", 8, F.greatest(F.size("fields") - 7, F.lit(0))).alias("extra"))


def _fields(structure: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col("fields")[i].alias("value")) for i, (_, kind) in enumerate(COLUMNS)])
    return structure.where("reason is null").select("neuron_id", "line_no", "mark", "raw_line", F.inline(pairs))


def parse_swc_lines(lines: DataFrame, neurons: DataFrame, default_cols: int = 7) -> ParsedLines:
    """Judge every row line of ``lines`` (neuron_id, line_no, raw_line); ``neurons`` has neuron_id, n_cols."""
    widths = neurons.where("neuron_id is not null").groupBy("neuron_id").agg(F.max("n_cols").alias("_cols"))
    raw = F.col("raw_line")
    rows = lines.select("neuron_id", "line_no", "raw_line").where(raw.isNotNull() & ~raw.rlike(_NOT_A_ROW))
    fields = F.transform(
        F.regexp_extract_all(F.regexp_extract(raw, _BODY, 1), F.lit(r'("[^"]*+"|[^ \t\r\n"]++)'), 1),
        lambda f: F.when(f.startswith('"'), F.substring(f, F.lit(2), F.length(f) - 2)).otherwise(f),
    )
    # without quotes and comments, as most lines are, a split will do
    simple = F.split(F.trim(F.translate(raw, "\t\r\n", "   ")), " +")
    special = raw.contains('"') | raw.contains("#")
    structure = (
        rows.join(widths, "neuron_id", "left")
        .withColumn("fields", F.when(~special, simple).when(raw.rlike(SOUND), fields))
        .withColumn("reason", F.when(F.col("fields").isNull(), "quoting").when(F.size("fields") != F.coalesce("_cols", F.lit(default_cols)), "columns"))
        .select("neuron_id", "line_no", F.xxhash64("raw_line").alias("mark"), "fields", "reason", "raw_line")
    )
    # lines are taken apart once: the dictionary and what is joined with it read the fields
    structure = materialize(structure)
    values = _fields(structure).select("kind", "value").distinct()
    invalid = values.where(~F.coalesce(_sound_value(F.col("kind"), F.col("value")), F.lit(False)))
    return ParsedLines(structure, materialize(invalid))
