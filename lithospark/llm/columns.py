"""Columns that pass through an operator, whatever their names.

Inside an operator they are called c0, c1, ..., so nothing that it adds or
needs for itself can clash with them. Columns that are named like an added one,
ignoring case, are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Passing:
    def __init__(self, df: DataFrame, added: list[str], consumed: str | None = None):
        """consumed: a column that the operator takes and does not pass on."""
        self.names = df.columns
        self.df = df.toDF(*(f"c{k}" for k in range(len(self.names))))
        self.added = added
        taken = {a.lower() for a in added}
        gone = self[consumed] if consumed is not None else None
        self.kept = [k for k, name in enumerate(self.names) if name.lower() not in taken and f"c{k}" != gone]

    def __getitem__(self, name: str) -> str:
        """The inner name of a column: by its exact name, else ignoring case."""
        if name in self.names:
            return f"c{self.names.index(name)}"
        found = [k for k, n in enumerate(self.names) if n.lower() == name.lower()]
        if not found:
            raise ValueError(f"there is no column {name}; there are {', '.join(self.names)}")
        return f"c{found[0]}"

    @property
    def inner(self) -> list[str]:
        return [f"c{k}" for k in self.kept]

    def schema(self, *more: str) -> str:
        """The schema of the kept columns, with a comma after each, for a function that adds others."""
        fields = self.df.schema.fields
        return "".join(f"`{c}` {fields[int(c[1:])].dataType.simpleString()}, " for c in [*self.inner, *more])

    def restored(self, out: DataFrame) -> DataFrame:
        """out with the kept columns under their own names, and the added ones."""
        return out.select(*(F.col(f"c{k}").alias(self.names[k]) for k in self.kept), *(F.col(f"`{a}`") for a in self.added))
