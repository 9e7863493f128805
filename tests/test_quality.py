from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from scorewright.operators import cleaning, quality


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [
            ("a", 1, "CA"),
            ("b", 0, "MX"),
            ("b", 0, "MX"),
            (None, 1, "US"),
            (None, 0, "US"),
            ("c", None, "US"),
            ("d", 2, "US"),
            ("e", 1, "USA"),
            ("f" * 37, 1, "US"),
        ],
        "userid string, subscriber int, country string",
    )


def _rules():
    return cleaning.user_rules(("CA", "MX", "US"))


def test_rows_with_nulls(people):
    assert quality.rows_with_nulls(people).count() == 3
    assert quality.rows_with_nulls(people, ["subscriber"]).count() == 1


def test_duplicates(people):
    assert [tuple(r) for r in quality.duplicate_keys(people, "userid").collect()] == [("b", 2)]
    whole = quality.duplicates(people, people.columns).collect()
    assert [tuple(r) for r in whole] == [("b", 0, "MX", 2)]


def test_validate_reports_every_broken_rule_and_loses_no_row(people):
    valid, rejected = quality.validate(people, _rules(), unique="userid")
    assert [tuple(r) for r in valid.collect()] == [("a", 1, "CA")]
    reasons = sorted((str(r["userid"])[:1], r["failed_rules"]) for r in rejected.collect())
    assert reasons == [
        ("N", ["userid_not_null"]),
        ("N", ["userid_not_null"]),
        ("b", ["userid_unique"]),
        ("b", ["userid_unique"]),
        ("c", ["subscriber_not_null"]),
        ("d", ["valid_subscriber"]),
        ("e", ["valid_country"]),
        ("f", ["userid_max_length"]),
    ]
    counts = {r["rule"]: r["num_rows"] for r in quality.rejection_counts(rejected).collect()}
    assert counts["userid_unique"] == 2 and sum(counts.values()) == 8


def test_require_fails_fast(spark, people):
    good = people.where("userid = 'a'")
    assert quality.require(good, _rules(), unique="userid").count() == 1
    with pytest.raises(Exception, match="valid_subscriber"):
        quality.require(people.where("userid = 'd'"), _rules()).collect()


def test_longest_values_and_lengths(people):
    longest = quality.longest_values(people, "userid").collect()
    assert [tuple(r) for r in longest] == [("f" * 37, 37)]
    lengths = {tuple(r) for r in quality.length_histogram(people, "userid").collect()}
    assert lengths == {(1, 6), (None, 2), (37, 1)}


def test_failed_casts(spark):
    frame = spark.createDataFrame([('"732"',), ("2006??",), ("-12",), (None,)], "points string")
    bad = quality.failed_casts(frame, "points", F.col("points").try_cast("int"))
    assert {r[0] for r in bad.collect()} == {'"732"', "2006??"}


def test_cleaning_of_every_kind_of_dirt(spark):
    rows = [
        ("u1 ", "1/2/19", "16", "5"),
        ('u2"', "01/02/2019", "17", '"732"'),
        ("u3", "12/31/19", "20", "2006??"),
        ("u4", "19/24/2019", "18", "1"),
        ("u5", "3/22/99", "18", "1"),
        ("u6", "8/2/39", "18", "1"),
        ("u7", "1/2/19", "27", "1"),
        ("u8", "1/2/19", "18", "n/a"),
        (None, "1/2/19", "18", "1"),
        ("u9", None, "18", "1"),
    ]
    staging = spark.createDataFrame(rows, "userid string, event_date string, hour string, points string")
    valid, rejected = cleaning.clean_facts(staging)
    assert sorted(tuple(r) for r in valid.collect()) == [
        ("u1", date(2019, 1, 2), 16, 5),
        ("u2", date(2019, 1, 2), 17, 732),
        ("u3", date(2019, 12, 31), 20, 2006),
    ]
    assert sorted((str(r["userid"]), *r["failed_rules"]) for r in rejected.collect()) == [
        ("None", "userid_not_null"),
        ("u4", "parseable_event_date"),
        ("u5", "valid_event_date"),
        ("u6", "valid_event_date"),
        ("u7", "valid_hour"),
        ("u8", "points_not_null"),
        ("u9", "event_date_not_null"),
    ]
    account = cleaning.row_account(staging, cleaning.flagged_facts(staging)).collect()
    assert {tuple(r) for r in account} == {("valid", 3), ("rejected", 7), ("unaccounted", 0)}
    kept, dropped = cleaning.split_invalid_dates(staging)
    assert [r["userid"] for r in dropped.collect()] == ["u4"]
    assert kept.count() == 9 and cleaning.normalise_dates(staging).count() == 9
    later, _ = cleaning.clean_facts(staging, as_of=date(2040, 1, 1))
    assert later.where("userid = 'u6'").count() == 1


def test_compute_once_keeps_rows(people):
    fixed = quality.compute_once(people)
    assert fixed.columns == people.columns
    assert fixed.exceptAll(people).count() == 0 and people.exceptAll(fixed).count() == 0
