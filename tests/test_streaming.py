"""The streamed state equals the batch state, whatever order the events arrive in."""

from keyloom.operators.quality import latest_state
from keyloom.streaming.run_events import keep_latest_state

DDL = "run_id int, event_id int, ts timestamp_ntz, stage string, kind string"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, i, f"2026-01-01 00:00:{i:02d}", f"s{i % 4}", "failed" if i == 7 else "started") for i in range(20)]
    df = spark.createDataFrame(rows, DDL.replace("timestamp_ntz", "string")).selectExpr(
        "run_id", "event_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "stage", "kind")
    for part in (df.where("event_id >= 10"), df.where("event_id < 10")):          # later half first
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}

    def write(batch, _):
        seen.update({r["run_id"]: tuple(r) for r in batch.collect()})
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = keep_latest_state(stream, str(tmp_path / "cp"), write)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == {r["run_id"]: tuple(r) for r in latest_state(df).collect()}
