import glob

import pytest

from tessera.sources import runs as R


def test_a_run_is_admitted_only_if_nothing_differs(spark):
    runs = spark.createDataFrame([("a", "complete", 5, 5, "d"), ("b", "complete", 4, 5, "d"), ("c", "complete", 5, 5, None), ("d", None, None, None, "d")], "run string, status string, completed int, total int, data string")
    wanted = spark.createDataFrame([(r, 5, "d") for r in "abcde"], "run string, total int, data string")
    problems = R.admission(runs, wanted, "run", ["data"])
    assert {tuple(r) for r in problems.collect()} == {("b", "not complete", "complete 4/5"), ("c", "data", None), ("d", "not complete", "? ?/?"), ("d", "rows", None), ("e", "missing", None)}
    assert [r["run"] for r in R.admitted(wanted, problems, "run").collect()] == ["a"]


def test_a_release_with_a_changed_file_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    rows = spark.createDataFrame([(1, "é\n"), (2, None)], "k int, t string")
    R.write_release({"one": rows, "two": rows.where("k = 1")}, path)
    assert R.verify_release(spark, path).isEmpty()
    assert sorted(map(tuple, R.read_release(spark, path, "one", "k int, t string").collect())) == [(1, "é\n"), (2, None)]
    part = glob.glob(f"{tmp_path}/r/data/two/part-*")[0]
    for f in glob.glob(f"{tmp_path}/r/data/two/.*.crc"):
        open(f, "wb").close()
    with open(part, "a") as f:
        f.write("{}\n")
    with pytest.raises(Exception):
        R.read_release(spark, path, "one", "k int, t string")


def test_registry_and_licenses(spark):
    models = spark.createDataFrame([("m", "n", "r", 1.0, "p", None), ("x", "n", "r", 1.0, "p", "q")], "model string, name string, revision string, params_b double, precision string, quantization string")
    members = spark.createDataFrame([("s", "m"), ("s", "y")], "set string, model string")
    assert {tuple(r) for r in R.registry_problems(models, members).collect()} == {("m", "no quantization"), ("y", "unknown in s")}
    used = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "source string")
    licenses = spark.createDataFrame([("a", "GPL"), ("b", "MIT")], "source string, license string")
    assert {tuple(r) for r in R.license_problems(used, licenses, ["MIT"]).collect()} == {("a", "GPL", 2), ("c", None, 1)}


def test_tables_of_any_name_are_told_apart(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k int, t string")
    path = f"{tmp_path}/data/release"
    R.write_release({"data": rows, "x/data": rows, "data/data": rows}, path)
    files = [r["file"] for r in R.folder_hashes(spark, f"{path}/data").collect()]
    assert sorted({f.rsplit("/", 1)[0] for f in files}) == ["data", "data/data", "x/data"] and R.verify_release(spark, path).isEmpty()
    import os
    import shutil

    moved = next(f for f in files if f.startswith("x/"))
    shutil.move(f"{path}/data/{moved}", f"{path}/data/data/{os.path.basename(moved)}")
    assert {r["problem"] for r in R.verify_release(spark, path).collect()} == {"missing", "extra"}
