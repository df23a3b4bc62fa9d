"""One pass over each document's rows in an order, where Spark has no expression for what it keeps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string


def folded(df: DataFrame, order: list, fold, added: list[tuple[str, str]]) -> DataFrame:
    """df with the columns `added` (name, kind), worked out by one pass over each document's rows in `order`.

    fold is a function of Python lists of the columns it names in `fold.reads`; it is called anew for each partition, with
    an iterator over the lists of all batches (documents whole or not), and yields the added columns of each batch.
    """
    df = df.drop(*[name for name, _ in added])
    own, schema = df.columns, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{n} {k}" for n, k in added])
    names, reads, kinds = [n for n, _ in added], fold.reads, [to_arrow_type(_parse_datatype_string(k)) for _, k in added]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def lists():
            for batch in batches:
                for low in range(0, batch.num_rows, 4096):
                    part = batch.slice(low, 4096)
                    held.append(part)
                    yield [part.column(c).to_pylist() for c in reads]

        for columns in fold(lists()):
            part = held.pop(0)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *(pa.array(x, k) for x, k in zip(columns, kinds))], names=[*own, *names])

    return df.repartition("doc_id").sortWithinPartitions("doc_id", *order).mapInArrow(run, schema)
