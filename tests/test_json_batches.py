from stopwise.sources import json_ranges


def test_small_objects_are_handed_over_in_batches():
    values = [f'{{"R{i}":{{"a":"}}"}}}}' for i in range(10_000)]
    batches = list(json_ranges.in_batches(values))
    assert [v for b in batches for v in b.column(0).to_pylist()] == values
    assert len(batches) == 3


def test_a_batch_is_bounded_by_its_text():
    values = ["x" * json_ranges.BATCH_CHARS, "y", "z" * json_ranges.BATCH_CHARS, "w"]
    assert [b.num_rows for b in json_ranges.in_batches(values)] == [1, 2, 1]
    assert list(json_ranges.in_batches([])) == []
