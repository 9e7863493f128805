"""CSV records with line breaks, stored tables by user and month, counted writes, scopes."""

from __future__ import annotations

import csv
import io
import random
from datetime import date

import pytest
from pyspark.sql import functions as F, types as T

from scorewright.functions.dates import parse_month_day_year
from scorewright.operators import boxplot, distinct, joins, quality, ranking, series
from scorewright.sources import csv_records, layout, schemas, storage, tables
from scorewright.sources.csv_files import export_csv, load_csv, load_csv_lines

TEXT = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_line_breaks_in_quotes_over_many_splits(spark, tmp_path, small_splits):
    draw = random.Random(4)
    parts = ["x", "é", ",", "\n", '"', "\n\n", " ", "long " * 20]
    rows = [
        (str(i), "".join(draw.choices(parts, k=draw.randint(1, 6))), f"end{i}") for i in range(300)
    ]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows([("a", "b", "c"), *rows])
    (tmp_path / "breaks.csv").write_text(text.getvalue(), newline="")
    path = str(tmp_path / "breaks.csv")
    assert csv_records.numbered_lines(spark, path).select("block").distinct().count() > 20
    good, bad = load_csv_lines(spark, path, TEXT)
    assert sorted(map(tuple, good.collect())) == sorted(rows) and bad.count() == 0
    assert sorted(map(tuple, load_csv(spark, path, TEXT).collect())) == sorted(rows)


def test_line_numbers_and_malformed_records(spark, tmp_path, small_splits):
    lines = ["a,b,c", '1,"x', 'y",2', "3,4,5", "", '6,"p', 'q"', "7,8,9", '10,"never', "closed,1,2"]
    (tmp_path / "odd.csv").write_text("\r\n".join(lines) + "\r\n", newline="")
    good, bad = load_csv_lines(spark, str(tmp_path / "odd.csv"), TEXT, positions=True)
    found = sorted((r.line, r.a, r.b, r.c) for r in good.collect())
    assert found == [(2, "1", "x\r\ny", "2"), (4, "3", "4", "5"), (8, "7", "8", "9")]
    assert sorted((r.line, r.malformed_line) for r in bad.collect()) == [
        (6, '6,"p\r\nq"'),
        (9, '10,"never\r\nclosed,1,2'),
    ]
    with pytest.raises(Exception, match="malformed record at line [69]"):
        load_csv(spark, str(tmp_path / "odd.csv"), TEXT).collect()


def test_an_unclosed_quote_gives_its_lines_back(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b,c\n1,2,3\n4,"5,6\n' + "7,8,9\n" * 50)
    found = csv_records.records(spark, str(tmp_path / "open.csv"), most_lines=20).collect()
    assert sorted(r.line for r in found if r.whole) == [1, 2]
    assert sorted(r.line for r in found if not r.whole) == list(range(3, 54))


def test_export_can_be_read_back(spark, tmp_path):
    rows = [("a\nb", 'x"y', None), (" b\r\nc,", "p,q", "1"), ('"\n', "\n\n", "2"), ("é", " ", "3")]
    frame = spark.createDataFrame(rows, TEXT)
    export_csv(frame, str(tmp_path / "out"))
    good, bad = load_csv_lines(spark, str(tmp_path / "out"), TEXT)
    assert sorted(map(str, map(tuple, good.collect()))) == sorted(map(str, rows)) and bad.count() == 0
    typed = spark.createDataFrame([("u\n1", date(2020, 1, 2), 3, -4)], schemas.clean_facts())
    export_csv(typed, str(tmp_path / "typed"))
    assert load_csv(spark, str(tmp_path / "typed"), schemas.clean_facts()).collect() == typed.collect()
    (tmp_path / "bad.csv").write_text('a,b,c,d\n"u\n1",2020-01-02,x,4\n')
    with pytest.raises(Exception, match="malformed record at line 2"):
        load_csv(spark, str(tmp_path / "bad.csv"), schemas.clean_facts()).collect()


def test_the_first_bad_value_has_its_file_and_line(spark, tmp_path, small_splits):
    lines = ["who,when,at,score"] + [f'"u\n{i}",1/{1 + i % 28}/19,16,{i}' for i in range(80)]
    lines[41] = '"u\nx",19/24/2019,16,1??'
    lines[60] = "u,20/1/19,16,2??"
    (tmp_path / "facts.csv").write_text("\n".join(lines) + "\n")
    facts, _ = load_csv_lines(spark, str(tmp_path / "facts.csv"), schemas.staging_facts(), positions=True)
    (day,) = quality.first_failed_cast(facts, "event_date", parse_month_day_year("event_date")).collect()
    assert (day.line, day.event_date) == (82, "19/24/2019") and day.file.endswith("facts.csv")
    (points,) = quality.first_failed_cast(facts, "points", F.col("points").try_cast("int")).collect()
    assert (points.line, points.points) == (82, "1??")


def test_empty_and_blank_files(spark, tmp_path):
    for name, text in (("none.csv", ""), ("head.csv", "a,b,c\n"), ("blank.csv", '\n\n"\n"\n')):
        (tmp_path / name).write_text(text)
        good, bad = load_csv_lines(spark, str(tmp_path / name), TEXT, positions=True)
        assert good.count() == 0 and bad.count() == (name == "blank.csv")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    facts = spark.range(0, 6000, 1, 5).selectExpr(
        "case when id % 3 = 0 then 'hot' when id % 50 = 1 then 'guest' else concat('u', id % 700) end as userid",
        "date_add(date'2019-01-15', cast(id % 200 as int)) as event_date",
        "cast(id % 24 as int) as hour",
        "cast(id % 1000 - 400 as int) as points",
    )
    users = spark.range(900).selectExpr(
        "case when id = 0 then 'hot' else concat('u', id) end as userid",
        "cast(id % 2 as int) as subscriber",
        "array('CA', 'MX', 'US')[id % 3] as country",
    )
    yield layout.store_by_user(facts, users, 6), facts, users
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_jobs_by_user_shuffle_nothing(spark, stored):
    by_user, facts, users = stored
    assert [r.userid for r in by_user.heavy_users.collect()] == ["hot"]
    assert by_user.heavy_facts.count() == 2000
    joined = joins.enrich_facts(by_user.facts, by_user.users)
    totals = joins.users_with_totals(by_user.users, by_user.facts)
    for df, n in ((joined, 1), (totals, 1)):
        assert "Exchange" not in plan_of(df) and plan_of(df).count("SortMergeJoin") == n
    assert "Exchange" in plan_of(joins.enrich_facts(facts, users))
    for job, same in (
        (joins.enrich_facts, lambda: joins.enrich_facts(facts, users)),
        (lambda f, u: joins.users_with_totals(u, f), lambda: joins.users_with_totals(users, facts)),
    ):
        assert sorted(map(str, by_user.each_part(job).collect())) == sorted(map(str, same().collect()))


def test_a_period_lists_its_months_only(spark, stored):
    by_user, facts, _ = stored
    first, last = date(2019, 3, 20), date(2019, 4, 2)
    rows = by_user.period(first, last)
    plan = plan_of(rows)
    assert plan.count("event_month") >= 2 and "PartitionFilters: [isnotnull(event_month" in plan
    assert {f.split("event_month=")[1][:10] for f in rows.inputFiles()} > {"2019-03-01"}
    read = rows.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("event_month=")[1][:10] for r in read} == {"2019-03-01", "2019-04-01"}
    expected = facts.where(F.col("event_date").between(F.lit(first), F.lit(last)))
    got = sorted(map(str, rows.drop("event_month").collect()))
    assert got == sorted(map(str, expected.collect()))
    listed = rows._jdf.queryExecution().executedPlan().toString().count("DataFilters")
    assert listed == 2
    monthly = series.monthly_activity(by_user.all_facts())
    assert sorted(monthly.collect()) == sorted(series.monthly_activity(facts).collect())


def test_empty_tables_are_stored(spark):
    facts = spark.createDataFrame([], schemas.clean_facts())
    users = spark.createDataFrame([], schemas.clean_users())
    by_user = layout.store_by_user(facts, users, 3)
    assert by_user.each_part(joins.enrich_facts).count() == 0


def test_counts_are_taken_by_the_write(spark):
    rows = spark.range(1000).selectExpr("id", "cast(id % 10 as int) as v", "if(id % 7 = 0, null, 1) as w")
    rules = [*quality.not_null("w"), quality.in_range("v", 0, 7)]
    written = quality.write_split(quality.flag(rows, rules), "counted", [r.name for r in rules])
    assert written.valid.count() == written.counts["valid"]
    assert written.rejected.count() == written.counts["rejected"]
    counted = {r.rule: r.num_rows for r in written.rejection_counts(spark).collect()}
    assert counted == {r.rule: r.num_rows for r in quality.rejection_counts(written.rejected).collect()}
    assert {r.outcome: r.num_rows for r in written.row_account(spark).collect()}["unaccounted"] == 0


def test_a_scope_removes_its_tables(spark):
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    with pytest.raises(ZeroDivisionError), storage.scope(spark):
        kept = layout.write_table(spark.range(5).withColumnRenamed("id", "userid"), "scoped", 2)
        name, place = next(reversed(storage._tables.items()))
        assert kept.count() == 5 and spark.catalog.tableExists(name)
        1 / 0
    assert not spark.catalog.tableExists(name)
    path = fs.Path(place)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    outside = storage.materialize(spark.range(3).toDF("x"), "outside")
    with storage.scope(spark):
        storage.materialize(spark.range(3).toDF("x"), "inside")
    assert outside.count() == 3


def test_months_without_events_are_marked(spark):
    rows = [(date(2019, m, 1), v, 1) for m, v in ((1, 10), (2, 30), (5, 7), (6, 8))]
    frame = spark.createDataFrame(rows, "month date, total_points long, total_users long")
    found = series.on_calendar(frame, ["total_points"]).orderBy("month").collect()
    assert [(r.month.month, r.has_events, r.total_points_change, r.after_gap) for r in found] == [
        (1, True, None, False), (2, True, 20, False), (3, False, None, False),
        (4, False, None, True), (5, True, None, True), (6, True, 1, False),
    ]
    assert series.on_calendar(frame.limit(0), ["total_points"]).count() == 0


def test_query_parameters_are_bound(spark):
    spark.createDataFrame([("O'Hara", "2020-01-02"), ("x", "2020-01-03")], "name string, day string").createOrReplaceTempView("people")
    found = tables.run_query(
        spark, "SELECT day, name FROM people WHERE name = :who", ["name"], ["day"], args={"who": "O'Hara"}
    )
    assert found.columns == ["name", "day"] and [tuple(r) for r in found.collect()] == [("O'Hara", date(2020, 1, 2))]
    none = tables.run_query(spark, "SELECT name FROM people WHERE name = ?", args=["' OR '1'='1"])
    assert none.count() == 0
    with pytest.raises(ValueError, match="missing"):
        tables.run_query(spark, "SELECT name FROM people", index_columns=["missing"])


def test_bitmaps_of_new_months_merge(spark):
    rows = spark.range(5000).selectExpr(
        "concat('u', pmod(xxhash64(id), 70000 div (1 + id % 3))) as userid",
        "date_add(date'2019-01-01', cast(id % 300 as int)) as event_date",
    )
    old, new = rows.where("event_date < '2019-07-01'"), rows.where("event_date >= '2019-07-01'")
    known = storage.materialize(distinct.dense_numbers(old), "known")
    numbers = storage.materialize(distinct.dense_numbers(new, known=known), "numbers")
    assert numbers.agg(F.max("number")).first()[0] == numbers.count() == rows.select("userid").distinct().count()
    assert known.join(numbers, ["userid", "number"]).count() == known.count()
    month = F.trunc("event_date", "month")
    maps = distinct.bitmaps(old, known, month).unionByName(distinct.bitmaps(new, numbers, month))
    found = distinct.distinct_counts(distinct.merged(maps, F.trunc("period", "year")), "n").collect()
    assert [r.n for r in found] == [rows.select("userid").distinct().count()]
    empty = distinct.counts_by_month_quarter_year(rows.limit(0), "event_date", "userid", "n")
    assert empty.count() == 0


def test_quantiles_by_narrowing_like_sorting(spark):
    draw = random.Random(6)
    values = [("a", draw.randrange(-(10**12), 10**12)) for _ in range(500)]
    values += [("b", 7)] * 40 + [("c", v) for v in (3, -1, 10)] + [("d", draw.randrange(3)) for _ in range(200)]
    values += [("e", None), ("a", None)]
    frame = spark.createDataFrame(values, "g string, v long")
    wanted = {"q1": 0.25, "median": 0.5, "q9": 0.9}
    found = ranking.quantiles_by_narrowing(frame, "v", ["g"], wanted, bins=16).collect()
    assert {r.g for r in found} == set("abcd")
    for row in found:
        ordered = sorted(v for g, v in values if g == row.g and v is not None)
        assert row.n == len(ordered)
        for name, p in wanted.items():
            at = (len(ordered) - 1) * p
            low, high = ordered[int(at)], ordered[min(int(at) + (at > int(at)), len(ordered) - 1)]
            assert row[name] == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12)


def test_box_totals_are_written_once(spark, monkeypatch):
    written = []
    original = storage.materialize

    def noted(df, label):
        found = original(df, label)
        written.append((label, found.count()))
        return found

    for module in (boxplot, ranking):
        monkeypatch.setattr(module, "materialize", noted)
    totals = spark.range(3000).selectExpr("id as userid", "id * 37 % 1009 as total_points", "id % 2 as a", "id % 3 as b")
    boxplot.box_stats(totals, ["a", "b"]).collect()
    assert [n for label, n in written if n >= 3000] == [3000]
    assert sum(n for label, n in written) < 3200
