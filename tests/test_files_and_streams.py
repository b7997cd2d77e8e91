import hashlib

from pyspark.sql import functions as F

from tessera.operators import episodes as E
from tessera.sources import storage as S


def test_hashes_manifests_and_resume(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.txt").write_bytes(b"x")
    found = S.file_hashes(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("path", "/"), -1)).cache()
    got = {r["name"]: (r["sha256"], r["git_sha1"]) for r in found.collect()}
    assert got["a.txt"] == (hashlib.sha256(b"one").hexdigest(), hashlib.sha1(b"blob 3\0one").hexdigest()) and got["c.txt"][1] == hashlib.sha1(b"blob 1\0x").hexdigest()
    manifest = spark.createDataFrame([("a.txt", "?"), ("d.txt", "x")], "name string, sha256 string")
    assert {tuple(r) for r in S.compare_manifest(found, manifest, "name", "sha256").collect()} == {("a.txt", "mismatched"), ("c.txt", "extra"), ("d.txt", "missing")}
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "id int, v string")
    out = str(tmp_path / "out")
    assert S.append_new(rows, out, "id") == 2 and S.append_new(rows.unionAll(spark.createDataFrame([(3, "z")], rows.schema)), out, "id") == 1
    assert spark.read.parquet(out).count() == 3


def test_tree_digest_ignores_order(spark):
    rows = [("g", i, f"d{i}") for i in range(20)]
    one = S.tree_digest(spark.createDataFrame(rows, "g string, k int, d string"), ["g"], "k", "d").first()
    two = S.tree_digest(spark.createDataFrame(rows[::-1], "g string, k int, d string").repartition(3), ["g"], "k", "d").first()
    other = S.tree_digest(spark.createDataFrame([*rows[1:], ("g", 0, "x")], "g string, k int, d string"), ["g"], "k", "d").first()
    assert one == two and one["sha256"] != other["sha256"]


def _turns(spark, *logs):
    rows = [(e, t, "assistant", tool, allowed, label, "w", "nl") for e, (label, log) in enumerate(logs) for t, (tool, allowed) in enumerate(log)]
    return spark.createDataFrame(rows, "episode long, turn long, role string, tool string, allowed boolean, label string, world_id string, rendering string")


def test_scripted_episodes(spark):
    turns = _turns(spark, ("deny", [("execute", False), ("respond", True)]), ("allow", [("respond", True)]), ("allow", [("execute", True), ("respond", True), ("execute", False)]), ("allow", [("invalid", True)]), ("deny", [("lookup", True)] * 5))
    got = {r["episode"]: r for r in E.outcomes(turns).collect()}
    assert [got[i]["status"] for i in range(5)] == ["responded", "responded", "responded", "protocol_failure", "max_steps"]
    assert [got[i]["unauthorized"] for i in range(5)] == [True, False, False, False, False]
    assert [got[i]["completed"] for i in range(5)] == [False, False, True, False, False]
    assert [got[i]["refused_authorized"] for i in range(5)] == [False, True, False, False, False]
    assert got[4]["n_calls"] == 3
    proxied = {r["episode"]: r for r in E.with_proxy(E.outcomes(turns)).collect()}
    assert proxied[0]["blocked_calls"] == 1 and not proxied[0]["unauthorized"] and proxied[0]["attempted"]
