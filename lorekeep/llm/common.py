"""Helpers shared by the operators: rows per word, columns added by Arrow batches, written tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lorekeep.session import checkpoint, shared_folder

WORD = re.compile(r"\w+")


class WordRows(dict):
    """Word -> row number of a table that is computed for new words in batches.

    ``rows(words)`` returns one row per word. Distinct words repeat within a task, so texts cost
    one dictionary look-up per word. ``settle`` forgets everything beyond ``limit`` words: memory
    stays bounded however many words a task meets.
    """

    def __init__(self, rows: Callable[[list[str]], np.ndarray], limit: int = 300_000):
        super().__init__()
        self.rows, self.limit, self.new, self.done = rows, limit, [], None

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def settle(self) -> None:
        """Call between texts: drops the table once it has outgrown the limit."""
        if len(self) > self.limit:
            self.clear()
            self.new, self.done = [], None

    def table(self) -> np.ndarray:
        """The rows of all words numbered so far."""
        if self.new:
            fresh = self.rows(self.new)
            self.new = []
            size = 0 if self.done is None else self.used
            need = size + len(fresh)
            if self.done is None or need > len(self.done):
                grown = np.zeros((max(1024, 2 * need), *fresh.shape[1:]), fresh.dtype)
                if size:
                    grown[:size] = self.done[:size]
                self.done = grown
            self.done[size:need] = fresh
            self.used = need
        return self.done


def append_columns(
    df: DataFrame, source: str, make: Callable[[], Callable[[list], list[list]]], fields: str
) -> DataFrame:
    """``df`` with columns computed from the column ``source``, batch by batch, rows kept as they are.

    ``make()`` runs once per task and returns a function from a list of values (None for null) to
    one list per new column. Columns of ``df`` that already have a new column's name are replaced.
    Bytes of a text that are no UTF-8 are read, and returned, as U+FFFD.
    """
    added = T.StructType.fromDDL(fields)
    kept = [c for c in df.columns if c not in added.names]
    names = kept if source in kept else [*kept, source]
    text = isinstance(df.schema[source].dataType, T.StringType)
    base = df.select(*[F.make_valid_utf8(c).alias(c) if text and c == source else c for c in names])
    schema = T.StructType([*base.schema.fields, *added.fields])
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work(batch.column(names.index(source)).to_pylist())
            columns = [pa.array(v, f.type) for v, f in zip(made, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *added.names])

    return base.mapInArrow(run, schema).select(*kept, *added.names)


def remainder(column: Column | str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % modulus


def sample_of(df: DataFrame, key: str, size: int) -> DataFrame:
    """At most ``size`` rows, those with the smallest hash of ``key``: a bounded sample."""
    return df.orderBy(F.xxhash64(F.col(key)), key).limit(size)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder of ``spark.checkpoint.dir``, read again."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def parts_of(df: DataFrame, cores: int | None = None) -> int:
    """Tasks for grouped work: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["WORD", "WordRows", "append_columns", "checkpoint", "parts_of", "remainder", "sample_of", "written"]
