import pyarrow as pa

from fundstelle.functions.arrow import slices


def test_slices_keep_rows_and_order():
    batch = pa.RecordBatch.from_pydict({"k": list(range(6)), "t": ["a" * 5, None, "", "b" * 30, "c", "d" * 9]})
    parts = list(slices(batch, "t", 10))
    assert [k for p in parts for k in p["k"].to_pylist()] == list(range(6)) and len(parts) > 2
    assert list(slices(batch.slice(0, 0), "t", 10)) == []
