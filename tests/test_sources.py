from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from scorewright.plans.inputs import CsvTables
from scorewright.plans.registry import jobs_on_inputs
from scorewright.sources import schemas, storage, tables
from scorewright.sources.csv_files import export_csv, load_csv, load_csv_lines
from scorewright.sources.storage import materialize, shared_dir

USERS = """id,attribute1,attribute2
u1,1,A
u2,0,B
u3,0,C
u4,1,C
"""
FACTS = """who,when,at,score
"u1 ",1/2/19,16,"""+ '"""732"""' + """
u1,1/3/19,16,-700
u2,1/2/2019,17,2006??
u2,2/2/2019,18,-3000
u3,19/24/2019,18,5
u3,12/30/19,18,5
u3,12/31/19,19,-5
g9,3/22/99,18,7
g9,6/1/19,18,7
"""


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    (folder / "users.csv").write_text(USERS)
    (folder / "facts.csv").write_text(FACTS)
    return CsvTables(
        spark,
        str(folder / "users.csv"),
        str(folder / "facts.csv"),
        "category",
        schemas.CATEGORY_LEVELS,
    )


def test_loading_by_position(loaded):
    raw = {tuple(r) for r in loaded.staging_facts.collect()}
    assert ("u1 ", "1/2/19", "16", '"732"') in raw and len(raw) == 9
    assert loaded.malformed_facts.count() == loaded.malformed_users.count() == 0


def test_lines_that_do_not_fit_are_kept_apart_or_fail(spark, tmp_path):
    (tmp_path / "ragged.csv").write_text("a,b,c,d\nu1,x,1,2\nu2,x,1\nu3,x,1,2,3\n")
    rows, bad = load_csv_lines(spark, str(tmp_path / "ragged.csv"), schemas.staging_facts())
    assert [tuple(r) for r in rows.collect()] == [("u1", "x", "1", "2")]
    assert sorted(r[0] for r in bad.collect()) == ["u2,x,1", "u3,x,1,2,3"]
    for line in ("u1,bad,1,2", "u1,2019-01-02,x,2", "u1,2019-01-02,99999999999,2", "u1,2019-01-02,1"):
        (tmp_path / "typed.csv").write_text(f"a,b,c,d\n{line}\n")
        with pytest.raises(Exception, match="(?i)malformed|failfast|cast|parse"):
            load_csv(spark, str(tmp_path / "typed.csv"), schemas.clean_facts()).collect()


def test_rejected_rows_of_loaded_files(loaded):
    assert {r["userid"] for r in loaded.rejected_facts.collect()} == {"u3", "g9"}
    assert loaded.rejected_users.count() == 0
    assert loaded.staging_users.columns == ["userid", "subscriber", "category"]


def test_cleaned_tables(loaded):
    facts = sorted(tuple(r) for r in loaded.facts.collect())
    assert facts[0] == ("g9", date(2019, 6, 1), 18, 7)
    assert ("u1", date(2019, 1, 2), 16, 732) in facts and len(facts) == 7
    assert loaded.users.count() == 4


def test_jobs_take_the_attribute_as_a_parameter(loaded):
    job = jobs_on_inputs()
    assert {tuple(r) for r in job["q32_attribute_proportions"](loaded).collect()} == {
        ("A", 0.25), ("B", 0.25), ("C", 0.5)
    }
    assert {tuple(r) for r in job["q42_sign_class_frequencies"](loaded).collect()} == {
        ("total_points_positive", 2, 0.5),
        ("total_points_negative", 1, 0.25),
        ("total_points_zero", 1, 0.25),
    }
    assert {tuple(r) for r in job["q53_rows_per_level"](loaded).collect()} == {
        ("A", 2), ("B", 2), ("C", 2)
    }
    assert [tuple(r) for r in job["q25_ghost_ids"](loaded).collect()] == [("g9",)]
    assert job["q37_participants_by_status"](loaded).collect() == [
        ("non_subscribers", 2, 50.0), ("subscribers", 1, 25.0)
    ]
    totals = {r["userid"]: r["total_points"] for r in job["q56_user_totals"](loaded).collect()}
    assert totals == {"u1": 32, "u2": -994, "u3": 0, "u4": 0}


def test_only_the_needed_columns_and_days_are_read(loaded):
    days = loaded.facts.where(F.col("event_date") >= F.lit(date(2019, 6, 1))).select("points")
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_date,2019-06-01)" in plan
    assert "ReadSchema: struct<event_date:date,points:int>" in plan


def test_csv_export_keeps_blanks_and_quotes(spark, tmp_path):
    frame = spark.createDataFrame([("a ", 'x"y', None), (" b", "p,q", "1")], "a string, b string, c string")
    path = str(tmp_path / "out")
    export_csv(frame, path)
    assert sorted(tuple(r) for r in load_csv(spark, path, frame.schema).collect()) == [
        (" b", "p,q", "1"), ("a ", 'x"y', None)
    ]


def test_tables_and_views(spark, loaded):
    empty = spark.createDataFrame([], schemas.clean_facts())
    tables.replace_table(empty, "facts_test")
    tables.insert_select(
        loaded.facts, "facts_test", ["hour", "userid", "points", "event_date"], F.col("points") > 0
    )
    assert spark.table("facts_test").count() == 4
    stored = tables.run_step(lambda f: f.where("points < 0"), loaded.facts, table="facts_test")
    assert stored.count() == 3
    tables.create_views(loaded.facts, loaded.users, "category")
    result = tables.run_query(
        spark,
        "SELECT hour, '2019-01-02' AS day, COUNT(*) AS n FROM subscribers GROUP BY hour",
        index_columns=["day"],
        date_columns=["day"],
    )
    assert [tuple(r) for r in result.collect()] == [(date(2019, 1, 2), 16, 2)]
    assert spark.table("non_subscribers").count() == 4
    assert spark.table("event_performance_joined").where("subscriber is null").count() == 1


def test_preview_is_repeatable(loaded):
    order = ["event_date", "hour", "userid", "points"]
    first = tables.preview(loaded.facts, order, 3).collect()
    assert first == tables.preview(loaded.facts.repartition(5), order, 3).collect()


def test_intermediates_can_be_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "app_dir", lambda _: f"file://{tmp_path}/own")
    assert storage.materialize(spark.range(3).toDF("x"), "gone").count() == 3
    assert (tmp_path / "own").exists()
    storage.remove_intermediates(spark)
    assert not (tmp_path / "own").exists()


def test_materialized_rows_live_in_the_shared_folder(spark):
    frame = materialize(spark.range(10).toDF("x"), "test")
    assert frame.count() == 10
    location = frame.inputFiles()[0]
    assert shared_dir(spark).removeprefix("file:") in location
