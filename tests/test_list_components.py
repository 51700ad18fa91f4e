"""What components of a similarity join read and keep."""

from __future__ import annotations

from bidlake.operators.components import list_components


def test_ranked_postings_are_worked_out_once(spark):
    """Lists and their members are made of the same postings; worked out twice, they would lie on disk twice at once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(key, key + i, 0, 1) for key in range(0, 100, 10) for i in range(3)]
    postings = spark.createDataFrame(rows, "key long, id long, rank int, size int").mapInArrow(counted, "key long, id long, rank int, size int")
    found = list_components(postings, lambda pairs: pairs, rounds=0)
    assert found.count() == 30
    assert seen.value == 30
