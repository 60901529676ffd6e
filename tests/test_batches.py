"""What a Python worker holds at once is bounded, whatever the session's batches are."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from topicflow.batches import pieces
from topicflow.scratch import Scratch


def test_pieces_are_bounded_and_whole():
    lengths = [3, 0, 5, 9, 0, 1, 1]
    at = np.r_[0, np.cumsum(lengths)]
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.arange(at[-1])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), lists], names=["id", "x"])
    out = list(pieces(iter([batch, batch.slice(2, 3), batch.slice(0, 0)]), "x", 6))
    assert [b.column("id").to_pylist() for b in out] == [[0, 1], [2], [3], [4, 5, 6], [2], [3], [4]]
    assert all(len(b.column("x").flatten()) <= 6 or b.num_rows == 1 for b in out)
    assert pa.Table.from_batches(out[:4]).equals(pa.Table.from_batches([batch]).combine_chunks())


def test_saved_tables_are_written_in_small_batches(spark):
    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = Scratch(spark, "batches").save(spark.range(5000, numPartitions=1).mapInArrow(size, "n long"), "sizes")
    assert sizes.agg(F.max("n"), F.sum("n")).first() == (1000, 5000)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
