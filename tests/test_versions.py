"""Versioned datasets: published whole or not at all."""

import json

import pytest
from pyspark.sql import functions as F

from keyloom.sources import versions as V

ROWS = [("a", "a__x", 0, 1.0), ("a", "a__x", 1, 2.0), ("b c/d", "b__y", 0, 3.0), ("", "__z", 0, 4.0), (None, "none", 0, 5.0)]


def points(spark, rows=ROWS):
    return spark.createDataFrame(rows, "shot string, element_id string, frame int, value double")


def seen(df):
    return sorted(map(str, df.collect()))


def test_round_trip_and_manifest(spark, tmp_path):
    root = str(tmp_path)
    meta = spark.createDataFrame([("k", 1)], "name string, n int")
    got = V.write_version({"points": points(spark), "meta": meta}, root, "v1", facts={"qc_version": 3})
    assert got["facts"] == {"qc_version": 3} and got["tables"]["points"]["rows"] == 5 and got["tables"]["meta"]["rows"] == 1
    assert V.load_manifest(spark, root, "v1") == got
    back = V.read_version(spark, root, "v1", "points")
    assert back.schema == points(spark).schema and seen(back) == seen(points(spark))
    assert seen(V.read_version(spark, root, "v1", "meta")) == seen(meta)
    assert V.read_version(spark, root, "v1", "splits") is None and V.read_version(spark, root, "v9", "points") is None


@pytest.mark.parametrize("shots", [["a"], ["b c/d", ""], [None], ["", None], ["zz"]])
def test_shots_are_pruned(spark, tmp_path, shots):
    root = str(tmp_path)
    V.write_version({"points": points(spark)}, root, "v1")
    df = V.read_version(spark, root, "v1", "points", shots)
    assert seen(df) == seen(points(spark, [r for r in ROWS if r[0] in shots] or ROWS[:0]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_half_written_versions_are_invisible_and_block_nothing(spark, tmp_path):
    root = str(tmp_path)
    V.write_tables({"points": points(spark)}, f"{root}/datasets/v1/data/lost")
    assert V.prefix_exists(spark, f"{root}/datasets/v1") and not V.version_exists(spark, root, "v1")
    assert V.read_version(spark, root, "v1", "points") is None
    V.write_version({"points": points(spark)}, root, "v1")
    assert V.read_version(spark, root, "v1", "points").count() == 5


def test_refusal_overwrite_and_old_readers(spark, tmp_path):
    root = str(tmp_path)
    V.write_version({"points": points(spark)}, root, "v1")
    old = V.read_version(spark, root, "v1", "points")
    with pytest.raises(FileExistsError):
        V.write_version({"points": points(spark)}, root, "v1")
    V.write_version({"points": points(spark).where("frame = 1")}, root, "v1", overwrite=True)
    assert V.read_version(spark, root, "v1", "points").count() == 1 and old.count() == 5


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    V.write_version({"points": points(spark)}, root, "v1")
    # The other writer looked before the first had published.
    monkeypatch.setattr(V, "_published", lambda *a: [])
    with pytest.raises(FileExistsError, match="meanwhile"):
        V.write_version({"points": points(spark).limit(1)}, root, "v1")
    monkeypatch.undo()
    assert V.read_version(spark, root, "v1", "points").count() == 5
    names = [p.name for p in (tmp_path / "datasets" / "v1" / "manifests").iterdir() if not p.name.endswith(".crc")]
    assert names == ["000000.json"]


def test_absent_is_not_unavailable(spark, tmp_path):
    assert not V.prefix_exists(spark, str(tmp_path / "nothing"))
    (tmp_path / "empty" / "inner").mkdir(parents=True)
    assert not V.prefix_exists(spark, str(tmp_path / "empty"))
    (tmp_path / "empty" / "inner" / "f").write_text(json.dumps(1))
    assert V.prefix_exists(spark, str(tmp_path / "empty"))
    for ask in (lambda: V.prefix_exists(spark, "nosuchfs://bucket/x"), lambda: V.version_exists(spark, "nosuchfs://bucket", "v1"),
                lambda: V.read_version(spark, "nosuchfs://bucket", "v1", "points")):
        with pytest.raises(V.StorageUnavailable):
            ask()


def test_heavy_shot_is_many_files(spark, tmp_path):
    root = str(tmp_path)
    heavy = spark.range(4000).select(F.lit("s").alias("shot"), F.lit("e").alias("element_id"), F.col("id").alias("frame"))
    V.write_version({"points": heavy.repartition(8)}, root, "v1")
    files = list((tmp_path / "datasets" / "v1").glob("data/*/points/by_shot=s_s/*.parquet"))
    assert len(files) > 1 and V.read_version(spark, root, "v1", "points").count() == 4000
