"""Functions by name: builders of expressions, and aggregates written in Python."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from weftline.errors import AlreadyExists, NoSuchObject

Builder = Callable[..., Column]

#: Rows of a task that are grouped at once by an aggregate written in Python.
GROUP_ROWS = 1 << 20


class FunctionRegistry:
    """Named builders of column expressions; names don't depend on case.

    Built in: ``average``, ``div0`` (division with NULL for a zero divisor), ``greatest``, ``least``, ``coalesce``, ``if``.
    """

    def __init__(self) -> None:
        self._builders: dict[str, Builder] = {}
        self.restore()

    def restore(self) -> None:
        """Only the built-in functions."""
        from weftline.functions import scalar

        self._builders = {
            "average": scalar.average,
            "div0": scalar.divide,
            "greatest": F.greatest,
            "least": F.least,
            "coalesce": F.coalesce,
            "if": scalar.choose,
        }

    def register(self, name: str, builder: Builder, replace: bool = True) -> None:
        if not replace and self.exists(name):
            raise AlreadyExists("function", name)
        self._builders[name.lower()] = builder

    def exists(self, name: str) -> bool:
        return name.lower() in self._builders

    def lookup(self, name: str) -> Builder:
        try:
            return self._builders[name.lower()]
        except KeyError:
            raise NoSuchObject("function", name) from None

    def call(self, name: str, *arguments: Column | str) -> Column:
        return self.lookup(name)(*[F.col(a) if isinstance(a, str) else a for a in arguments])

    def names(self) -> list[str]:
        return sorted(self._builders)

    def drop(self, name: str) -> bool:
        """Whether there was such a function."""
        return self._builders.pop(name.lower(), None) is not None

    def clear(self) -> None:
        self._builders.clear()

    def rename(self, old: str, new: str) -> None:
        builder = self.lookup(old)
        if self.exists(new):
            raise AlreadyExists("function", new)
        self.drop(old)
        self._builders[new.lower()] = builder

    def register_sql(self, spark: SparkSession, name: str, function: Callable, returns: DataType | str) -> None:
        """A Python function for SQL text too; pandas functions run on batches of rows."""
        spark.udf.register(name, function, returns) if not hasattr(function, "evalType") else spark.udf.register(name, function)
        self.register(name, lambda *a: F.call_function(name, *a))


class UserDefinedAggregate(ABC):
    """An aggregate in four steps over a buffer, partial buffers being merged.

    Buffers are kept for stretches of rows first, so that what is shuffled is one buffer for each key and
    stretch, however many rows a key has.
    """

    #: type of the buffer, which must be a struct or a primitive type that Spark can carry
    buffer_type: str
    result_type: str

    @abstractmethod
    def initialize(self) -> object: ...

    @abstractmethod
    def update(self, buffer: object, values: pd.Series) -> object:
        """The buffer after a batch of values; they come without order."""

    @abstractmethod
    def merge(self, buffer: object, other: object) -> object: ...

    @abstractmethod
    def evaluate(self, buffer: object) -> object: ...

    def update_groups(self, values: pd.Series, starts: np.ndarray) -> list:
        """A new buffer for each stretch of ``values``; stretch ``i`` begins at ``starts[i]`` and ends where the next one does.

        Overwrite it where one operation does for all stretches; by default each is an ``update``.
        """
        ends = [*starts[1:], len(values)]
        return [self.update(self.initialize(), values.iloc[a:b]) for a, b in zip(starts, ends, strict=True)]

    def aggregate(self, df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
        """``keys`` and the aggregate of ``value`` as ``name``.

        A task groups stretches of ``GROUP_ROWS`` rows; buffers of equal keys come together sorted and are merged as a stream, so
        neither step holds more than a stretch, a batch and one buffer.
        """
        schema = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        by = ", ".join(f"`{k}` {schema[k]}" for k in keys)

        def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
            if not keys:
                return pd.DataFrame({"_buffer": self.update_groups(pdf[value], np.array([0]))})
            codes = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            out = pdf[keys].iloc[order[starts]].reset_index(drop=True)
            out["_buffer"] = self.update_groups(pdf[value].iloc[order], starts)
            return out

        def partial(batches):
            held, n = [], 0
            for pdf in batches:
                held.append(pdf)
                n += len(pdf)
                if n >= GROUP_ROWS:
                    yield grouped(pd.concat(held, ignore_index=True))
                    held, n = [], 0
            if n:
                yield grouped(pd.concat(held, ignore_index=True))

        def final(batches):
            buffer, last = None, None
            for pdf in batches:
                rows = []
                for *key, other in zip(*[_plain(pdf[k]) for k in keys], pdf["_buffer"], strict=True):
                    if last is not None and key == last:
                        buffer = self.merge(buffer, other)
                        continue
                    if last is not None:
                        rows.append((*last, self.evaluate(buffer)))
                    buffer, last = self.merge(self.initialize(), other), key
                yield pd.DataFrame(rows, columns=[*keys, name], dtype=object)
            if last is not None:
                yield pd.DataFrame([(*last, self.evaluate(buffer))], columns=[*keys, name], dtype=object)

        parts = df.select(*keys, value).mapInPandas(partial, f"{by + ', ' if by else ''}_buffer {self.buffer_type}")
        together = parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.repartition(1)
        return together.mapInPandas(final, f"{by + ', ' if by else ''}`{name}` {self.result_type}")


def _plain(keys: pd.Series) -> list:
    """Keys that can be compared: None for NULL."""
    return keys.astype(object).where(keys.notna(), None).tolist()
