"""Python beside columns that stay as they are: Arrow batches whose ids and other columns never become Python numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def beside(df: DataFrame, keep: Sequence[str], read: Sequence[str], made: T.StructType | str, columns: Callable[[], Callable[..., Sequence]]) -> DataFrame:
    """The columns ``keep`` of ``df``, untouched, and the columns ``made`` (fields or DDL).

    ``columns()`` is called once in a task and gives a function from the lists of the columns ``read`` to the
    columns made, each as long as these. Columns go by their place, so a null beside a 64-bit id changes nothing.
    """
    kind = made if isinstance(made, T.StructType) else T.StructType.fromDDL(made)
    fields, names = list(to_arrow_schema(kind)), list(dict.fromkeys([*keep, *read]))
    at = [df.columns.index(c) for c in names]
    rows = df.toDF(*(f"c{k}" for k in range(len(df.columns)))).select([f"c{k}" for k in at])
    kept, args = [names.index(c) for c in keep], [names.index(c) for c in read]
    out = T.StructType([*(df.schema.fields[at[k]] for k in kept), *kind.fields])
    labels = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = columns()
        for b in batches:
            new = make(*(b.column(k).to_pylist() for k in args))
            arrays = [b.column(k) for k in kept] + [pa.array(x, f.type) for x, f in zip(new, fields, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, labels)

    return rows.mapInArrow(run, out)


def transposed(rows: list[tuple], width: int) -> list[Sequence]:
    """Columns of rows; ``width`` of them even if there are no rows."""
    return list(zip(*rows, strict=True)) if rows else [[]] * width
