"""Typing rules: cells of delimited files, and dynamically typed JSON values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .times import flexible_ms, iso_date, iso_to_ms


def blank_to_null(cell: Column) -> Column:
    return F.when(F.trim(cell) != "", cell)


def cell_int(cell: Column) -> Column:
    """A whole number in a cell; '12.5' is none."""
    return F.when(F.trim(cell).rlike(r"^[+-]?\d+$"), F.trim(cell).try_cast("int"))


def cell_double(cell: Column) -> Column:
    return F.trim(cell).try_cast("double")


def cell_error(name: str, kind: str, required: bool) -> Column:
    """Why a cell breaks its rule, or null. Kinds: string, int, double, timestamp, date."""
    cell = F.col(name)
    missing = blank_to_null(cell).isNull()
    typed = {"string": F.lit(True), "int": cell_int(cell).isNotNull(), "double": cell_double(cell).isNotNull(), "timestamp": iso_to_ms(cell).isNotNull(), "date": iso_date(cell).isNotNull()}[kind]
    bad = F.concat(F.lit(f"unparseable {kind} for '{name}': '"), cell, F.lit("'"))
    absent = F.lit(f"missing required field: '{name}'") if required else F.lit(None).cast("string")
    return F.when(missing, absent).when(~typed, bad)


def cell_value(name: str, kind: str) -> Column:
    cell = blank_to_null(F.col(name))
    return {"int": cell_int, "double": cell_double}.get(kind, lambda c: c)(cell)


class Json:
    """Values of a JSON text by path, dynamically typed: each asked for is read and typed once."""

    def __init__(self):
        self.paths: dict[str, str] = {}
        self.objects: set[str] = set()
        self.typed: dict[str, Column] = {}

    def _name(self, path: str) -> str:
        return self.paths.setdefault(path, path.replace(".", "__"))

    def read(self, rows: DataFrame, value: str) -> DataFrame:
        """`rows` with the values asked for so far and `is_object`.

        An object's fields are taken in one pass, as a struct of variants; a nested object's
        from its own variant. A value's JSON text tells its kind by its first sign, at a
        fraction of what its schema costs.
        """
        tops = {path.split(".")[0] for path in self.paths}
        inner = {top: [path.split(".")[1] for path in self.paths if path.startswith(f"{top}.")] for top in sorted(tops)}
        fields = lambda of, names: F.expr(f"try_variant_get({of}, '$', 'struct<{', '.join(f'`{n}`: variant' for n in names)}>')")
        parsed = rows.withColumn("__v", F.try_parse_json(F.col(value)))
        taken = parsed.select(*rows.columns, fields("__v", sorted(tops) or ["__none"]).alias("__0"))
        nested = taken.select(*rows.columns, "__0", *[fields(f"__0.`{top}`", names).alias(f"__1_{top}") for top, names in inner.items() if names])

        def leaf(path: str) -> str:
            top, _, name = path.partition(".")
            return f"__1_{top}.`{name}`" if name else f"__0.`{top}`"

        out = [F.col("__0").isNotNull().alias("is_object")]
        for path, name in self.paths.items():
            at = leaf(path)
            if path in self.objects and inner.get(path):
                null = F.col(at).isNull() | F.expr(f"is_variant_null({at})")
                out.append(F.when(F.col(f"__1_{path}").isNotNull(), "{").when(null, "n").otherwise("?").alias(f"__k_{name}"))
            else:
                out += [F.substring(F.to_json(F.col(at)), 1, 1).alias(f"__k_{name}"), F.expr(f"try_variant_get({at}, '$', 'string')").alias(f"__t_{name}")]
        return nested.select(*rows.columns, *out).select("*", *[value.alias(name) for name, value in self.typed.items()])

    def _first(self, path: str) -> Column:
        """The first sign of the value as JSON; null where absent."""
        return F.col(f"__k_{self._name(path)}")

    def text(self, path: str) -> Column:
        """The value as text: texts as they are, anything else as JSON."""
        return F.col(f"__t_{self._name(path)}")

    def absent(self, path: str) -> Column:
        """Not there, or null."""
        return F.coalesce(self._first(path), F.lit("n")) == "n"

    def is_object(self, path: str) -> Column:
        self.objects.add(path)
        return F.coalesce(self._first(path) == "{", F.lit(False))

    def is_text(self, path: str) -> Column:
        return F.coalesce(self._first(path) == '"', F.lit(False))

    def is_truth(self, path: str) -> Column:
        return F.coalesce(self._first(path).isin("t", "f"), F.lit(False))

    def _typed(self, kind: str, path: str, make) -> Column:
        name = f"__{kind}_{self._name(path)}"
        if name not in self.typed:
            self.typed[name] = make()
        return F.col(name)

    def int(self, path: str) -> Column:
        """A whole number, also 3.0 or the text '3'; null for fractions, truth values and the rest."""

        def make() -> Column:
            text = F.trim(self.text(path))
            number = text.try_cast("double")
            from_number = F.when(number == F.floor(number), number.try_cast("int"))
            from_text = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
            return F.when(~self.is_truth(path), F.when(self.is_text(path), from_text).otherwise(from_number))

        return self._typed("i", path, make)

    def double(self, path: str) -> Column:
        """A number or its text; null for truth values and the rest."""
        return self._typed("d", path, lambda: F.when(~self.is_truth(path), F.trim(self.text(path)).try_cast("double")))

    def millis(self, path: str) -> Column:
        """Epoch milliseconds, as a whole number or an ISO text."""
        return self._typed("m", path, lambda: F.when(~self.is_truth(path), flexible_ms(self.text(path))))
