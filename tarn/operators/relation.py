"""A DataFrame whose physical columns have unique generated names, and the visible names they stand for.

Visible names may repeat (the first match wins), hold dots, and are told apart by case; none of
this reaches Spark's name resolution. Self-joins need no aliases.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_IDS = count()


class PlanError(ValueError):
    """The plan cannot be run: an unknown column, or a comparison that its types do not allow."""


@dataclass(frozen=True)
class Field:
    name: str
    id: str
    type: T.DataType


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    fields: tuple[Field, ...]

    @classmethod
    def of(cls, df: DataFrame) -> Relation:
        fields = tuple(Field(f.name, f"c{next(_IDS)}", f.dataType) for f in df.schema)
        return cls(df.toDF(*(f.id for f in fields)), fields)

    def resolve(self, name: str) -> Field:
        for field in self.fields:
            if field.name == name:
                return field
        raise PlanError(f"no column {name!r} among {[f.name for f in self.fields]}")

    def to_df(self) -> DataFrame:
        return self.df.select(*(F.col(f.id).alias(f.name) for f in self.fields))
