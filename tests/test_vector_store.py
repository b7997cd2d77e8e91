"""The vector store: what is written is read back, by range, and neither half-written nor altered stores are."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import vector_store as V


@pytest.fixture(scope="module")
def store(spark):
    V.register(spark)
    return spark


def _rows(n, width=6, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, width)).astype(np.float32)
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def test_round_trip_by_range(store, tmp_path, monkeypatch):
    rows, path = _rows(900), str(tmp_path / "v")
    store.createDataFrame(rows, V.SCHEMA).repartitionByRange(5, "id").write.format("vectors").mode("append").save(path)
    got = {r["id"]: r["vector"] for r in store.read.format("vectors").load(path).collect()}
    assert got == {i: [float(np.float16(v)) for v in x] for i, x in rows}
    manifest = json.load(open(f"{path}/manifest.json"))
    assert (manifest["rows"], manifest["width"], len(manifest["shards"])) == (900, 6, 5)
    # A filter by id leaves other shards alone: they may even be gone.
    some = store.read.format("vectors").load(path).where("id >= 100 and id < 120")
    for s in manifest["shards"]:
        if s["least"] >= 120 or s["most"] < 100:
            os.remove(f"{path}/{s['file']}")
    assert sorted(r["id"] for r in some.collect()) == list(range(100, 120))


def test_a_failed_write_leaves_no_manifest(store, tmp_path):
    path = str(tmp_path / "v")
    bad = store.createDataFrame([*_rows(50), (99, [1e9] * 6)], V.SCHEMA).repartitionByRange(3, "id")
    with pytest.raises(Exception, match="beyond the range"):
        bad.write.format("vectors").mode("append").save(path)
    assert not os.path.exists(f"{path}/manifest.json") and glob.glob(f"{path}/shard-*") == []
    for rows, why in (([(1, [1.0]), (2, [1.0, 2.0])], "one width"), ([(None, [1.0])], "null"), ([(1, [1.0, None])], "null")):
        with pytest.raises(Exception, match=why):
            store.createDataFrame(rows, V.SCHEMA).write.format("vectors").mode("append").save(path)
    assert not os.path.exists(f"{path}/manifest.json")


def test_altered_shards_and_second_writes(store, tmp_path):
    path = str(tmp_path / "v")
    df = store.createDataFrame(_rows(40), V.SCHEMA).coalesce(1)
    df.write.format("vectors").mode("append").save(path)
    with pytest.raises(Exception, match="holds vectors already"):
        df.write.format("vectors").mode("append").save(path)
    df.limit(7).write.format("vectors").mode("overwrite").save(path)
    assert store.read.format("vectors").load(path).count() == 7 and len(glob.glob(f"{path}/shard-*")) == 1
    shard = glob.glob(f"{path}/shard-*")[0]
    data = bytearray(open(shard, "rb").read())
    data[-1] ^= 1
    open(shard, "wb").write(data)
    with pytest.raises(Exception, match="not what was written"):
        store.read.format("vectors").load(path).select(F.sum("id")).collect()


def test_an_empty_store(store, tmp_path):
    path = str(tmp_path / "v")
    store.createDataFrame([], V.SCHEMA).write.format("vectors").mode("append").save(path)
    assert store.read.format("vectors").load(path).collect() == []
