"""The stored event table: appends, repeats, failures, compaction, streams."""

import pytest

from tidemark.sources.event_store import EventStore
from tidemark.sources.shared import shared_folder

SCHEMA = "d string, n long, t long, i string"


@pytest.fixture
def store(spark):
    return EventStore(spark, shared_folder(spark, "store"), spark.createDataFrame([], SCHEMA).schema, most_deltas=3)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(store):
    return sorted(map(tuple, store.read().collect()), key=str)


def test_appends_repeats_and_a_failure(spark, store, monkeypatch):
    assert held(store) == []
    first = rows(spark, ("a", 1, 10, "x"), ("a", 2, 11, "x"), ("a", 2, 12, "y"), (None, 3, 1, "z"))
    assert store.append(first, "w", 0)
    assert held(store) == [("a", 1, 10, "x"), ("a", 2, 12, "y"), (None, 3, 1, "z")]
    second = rows(spark, ("a", 2, 5, "later wins"), ("b", 1, 7, "q"))
    with monkeypatch.context() as m:
        m.setattr(EventStore, "_publish", lambda *_: (_ for _ in ()).throw(OSError("the driver is lost")))
        with pytest.raises(OSError, match="lost"):
            store.append(second, "w", 1)
    assert held(store) == [("a", 1, 10, "x"), ("a", 2, 12, "y"), (None, 3, 1, "z")]
    assert store.append(second, "w", 1)
    want = [("a", 1, 10, "x"), ("a", 2, 5, "later wins"), ("b", 1, 7, "q"), (None, 3, 1, "z")]
    assert held(store) == want
    assert not store.append(first, "w", 0) and not store.append(second, "w", 1) and held(store) == want
    before = store.read()
    assert store.append(rows(spark, (None, 3, 2, "new")), "v", 0)  # the third delta: compacted
    assert store.state()["deltas"] == [] and store.state()["base"]
    assert sorted(map(tuple, before.collect()), key=str) == want
    want[3] = (None, 3, 2, "new")
    assert held(store) == want and store.vacuum() > 0 and held(store) == want and store.vacuum() == 0
    assert not store.append(second, "w", 1)


def test_two_appends_at_once(spark, store):
    """The slower one finds its version taken and fails; tried again, it goes in."""
    other = EventStore(spark, store.path, store.schema)
    publish = store._publish

    def late(state):
        other.append(rows(spark, ("b", 1, 1, "theirs")), "theirs", 0)
        publish(state)

    store._publish = late
    with pytest.raises(Exception, match="(?i)exist"):
        store.append(rows(spark, ("a", 1, 1, "mine")), "mine", 0)
    store._publish = publish
    assert held(store) == [("b", 1, 1, "theirs")]
    assert store.append(rows(spark, ("a", 1, 1, "mine")), "mine", 0)
    assert held(store) == [("a", 1, 1, "mine"), ("b", 1, 1, "theirs")]


def test_a_stream_run_twice(spark, store, tmp_path):
    rows(spark, ("a", 1, 1, "x"), ("b", 2, 2, "y")).write.parquet(str(tmp_path / "in"))
    for state in ("one", "one", "two"):  # "two": the stream's own state is lost, so it sends its first batch again
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        store.sink(stream, "stream").option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination()
        assert held(store) == [("a", 1, 1, "x"), ("b", 2, 2, "y")] and len(store.state()["deltas"]) == 1
