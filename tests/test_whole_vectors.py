"""Project ingest over files that hold whole vectors."""

import check
from __spark_entry__ import queries
from keyloom.plans.sources import project_files

SF = "/root/testdata/sf0.001"


def test_every_component_reaches_the_keys(spark):
    ok, note = check.compare(spark, check.duck(SF), SF, "project_ingest_all")
    assert ok, note
    rows = queries()["project_ingest_all"](spark, SF).where("track = 'path'").groupBy("path").agg({"n_points": "sum"}).collect()
    assert rows and {r[1] for r in rows} == {32}


def test_the_short_outline_is_still_refused(spark):
    from keyloom.sources import projects
    bad = projects.ingest_projects(projects.parse_projects(project_files(spark, SF, 16)))["quarantine"]
    ids = {str(r.vec_id) for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 10 = 7").collect()}
    assert {r.path for r in bad.collect()} == ids
