"""Prefix sums over a global order, from the totals of sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from graphloom.llm.common import cut, in_arrow, parallelism


def prefix_sums(df: DataFrame, order: list[str], values: list[str], group: str | None = None) -> DataFrame:
    """``df`` with ``before_<v>`` for each long column ``v``: the sum over all rows ahead of the row.

    Rows are ahead by ``order``, within the integer column ``group`` if given. The rows are sorted by
    range over partitions, each partition sums its own rows in a stream, and the totals of the
    partitions (one row for each partition and group that meet) give what lies ahead of each. A group
    of any size is spread over as many partitions as its rows ask for.
    """
    keys = [group, *order] if group else order

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carry = None, dict.fromkeys(values, 0)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            own = batch.column(group).to_numpy() if group else np.zeros(m, np.int32)
            starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
            lengths = np.diff(np.concatenate([starts, [m]]))
            columns = []
            for v in values:
                x = batch.column(v).to_numpy()
                ahead = np.cumsum(x) - x
                ahead = ahead - np.repeat(ahead[starts], lengths)
                if own[0] == last:
                    ahead[: lengths[0]] += carry[v]
                carry[v] = int(ahead[-1] + x[-1])
                columns.append(pa.array(ahead))
            last = own[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(m, part, np.int32)), *columns], names=[*batch.schema.names, "_part", *(f"_local_{v}" for v in values)])

    schema = StructType([*df.schema.fields, StructField("_part", IntegerType()), *(StructField(f"_local_{v}", LongType()) for v in values)])
    placed = cut(in_arrow(df.repartitionByRange(parallelism(df.sparkSession), *keys).sortWithinPartitions(*keys), local, schema))
    by = [group, "_part"] if group else ["_part"]
    ahead = Window.partitionBy(group) if group else Window.partitionBy()
    ahead = ahead.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by).agg(*(F.sum(v).alias(f"_sum_{v}") for v in values))
    totals = totals.select(*by, *(F.coalesce(F.sum(f"_sum_{v}").over(ahead), F.lit(0)).alias(f"_ahead_{v}") for v in values))
    out = placed.join(totals, by)
    return out.select(*df.columns, *((F.col(f"_local_{v}") + F.col(f"_ahead_{v}")).alias(f"before_{v}") for v in values))
