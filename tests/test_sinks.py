"""The publisher and the registry store: batches once, whole, or not at all."""

import json
import os

import pytest

from ampgraph.errors import PublishError
from ampgraph.operators import registry
from ampgraph.sources import topics
from ampgraph.sources.registry_store import RegistryStore

READINGS = "id long, device_id string, device_type string, zone string, node string, arrival_us long"


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.startswith(".") and not f.endswith(".crc"))


def test_a_stream_publishes_each_batch_once(spark, tmp_path):
    topics.register(spark)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def run():
        stream = spark.readStream.schema("topic string, value string").json(str(source))
        query = stream.writeStream.format(topics.FORMAT).option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None

    for n, zones in enumerate(("ab", "c")):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"topic": f"net/ventana/{z}", "value": f"é{n}"}) for z in zones))
        run()
    got = sorted((r.batch, r.topic, r.value) for r in topics.published(spark, out).collect())
    assert got == [(0, "net/ventana/a", "é0"), (0, "net/ventana/b", "é0"), (1, "net/ventana/c", "é1")]
    before = files(out)
    writer = topics.TopicWriter(out)
    writer.commit([writer.write(iter([{"topic": "t", "value": "again"}]))], 1)  # a batch that was committed
    assert files(out) == before and not [f for f in before if "_staging" in f]


def test_failures_leave_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    writer = topics.TopicWriter(out)
    with pytest.raises(PublishError):
        writer.write(iter([{"topic": "t", "value": "x"}, {"topic": None, "value": "y"}]))
    assert files(out) == []
    writer.abort([writer.write(iter([{"topic": "t", "value": "x"}])), None], 3)
    assert files(out) == []
    os.makedirs(f"{out}/data/batch=4")
    with open(f"{out}/data/batch=4/part-00000.json", "w") as f:
        f.write('{"topic": "t", "value": "half"}\n')  # a commit broke off before its manifest
    writer.commit([writer.write(iter([])), writer.write(iter([{"topic": "t", "value": "whole"}]))], 4)
    assert [(r.batch, r.value) for r in topics.published(spark, out).collect()] == [(4, "whole")]
    for options, columns in (({}, ["topic", "value"]), ({"path": out}, ["value"])):
        with pytest.raises(PublishError):
            topics.Topics(options).streamWriter(spark.createDataFrame([], ", ".join(f"{c} string" for c in columns)).schema, False)


def rows(df):
    return sorted((r.device_id, r.device_type, r.zone, r.node, r.last_seen_us) for r in df.collect())


def test_the_registry_store_rewrites_touched_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    store, every = RegistryStore(spark, path, buckets=16), []
    for n in range(5):
        data = [(n * 100 + i, f"d{i}", None if (n + i) % 3 else "mono", f"z{n}" if i % 2 else None, "n" if n == 2 else None, n * 100 + i) for i in (range(40) if n == 0 else range(n, n + 2))]
        every += data
        store.write(spark.createDataFrame(data, READINGS), n)
        assert rows(store.registry()) == rows(registry.upsert(spark.createDataFrame(every, READINGS)))
        assert store.readings(READINGS).count() == len(every)
    touched = {n: {f.split("/")[2] for f in files(path) if f.startswith(f"registry/version={n}/bucket")} for n in range(5)}
    assert all(len(touched[n]) <= 2 for n in range(1, 5)) and len(touched[0]) < 16  # what newer commits replaced is gone
    before = files(path)
    store.write(spark.createDataFrame([(1, "d1", "tri", "other", "n9", 10**9)], READINGS), 3)  # committed: nothing changes
    assert files(path) == before


def test_a_crash_between_the_sinks_is_invisible(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store = RegistryStore(spark, path, buckets=4)
    first = spark.createDataFrame([(1, "a", "mono", "z", None, 5), (2, "b", None, "z", None, 6)], READINGS)
    second = spark.createDataFrame([(3, "a", None, "y", "n1", 9)], READINGS)
    store.write(first, 0)
    want = rows(store.registry())
    with monkeypatch.context() as m:
        m.setattr(RegistryStore, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.write(second, 1)
    assert rows(store.registry()) == want and store.readings(READINGS).count() == 2
    RegistryStore(spark, path, buckets=4).write(second, 1)  # the batch comes again
    assert rows(store.registry()) == [("a", "mono", "y", "n1", 9), ("b", None, "z", None, 6)] and store.readings(READINGS).count() == 3


def test_an_empty_store(spark, tmp_path):
    store = RegistryStore(spark, str(tmp_path / "none"))
    assert store.registry().collect() == [] and store.readings(READINGS).collect() == [] and store.commits() == []
