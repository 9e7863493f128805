from __future__ import annotations

import math
import random
from statistics import NormalDist

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from scorewright.functions.distributions import t_two_sided
from scorewright.operators import boxplot, encoding, hypothesis, ranking, regression, segments, series
from scorewright.plans.inputs import OrderTables
from tests.conftest import SMALL


def _brute_ranks(rows, order, within):
    ranks = {}
    groups = {}
    for row in sorted(rows, key=lambda r: tuple(r[k] for k in order)):
        group = tuple(row[k] for k in within)
        groups[group] = groups.get(group, 0) + 1
        ranks[row["id"]] = groups[group]
    return {r["id"]: (ranks[r["id"]], groups[tuple(r[k] for k in within)]) for r in rows}


def test_global_rank_with_ties_and_a_hot_group(spark):
    rng = random.Random(5)
    rows = [
        {
            "id": i,
            "g": rng.choice(["hot", "hot", "b", "c", None]),
            "v": 0 if rng.random() < 0.4 else rng.randint(-50, 50),
        }
        for i in range(2000)
    ]
    frame = spark.createDataFrame([(r["id"], r["g"], r["v"]) for r in rows], "id int, g string, v int")
    frame = frame.repartition(7)
    ranked = ranking.global_rank(frame, ("v", "id"), ("g",))
    assert {r["id"]: (r["rank"], r["n"]) for r in ranked.collect()} == _brute_ranks(rows, ("v", "id"), ("g",))
    overall = ranking.global_rank(frame, ("v", "id"))
    assert {r["id"]: (r["rank"], r["n"]) for r in overall.collect()} == _brute_ranks(rows, ("v", "id"), ())


def test_interpolated_quartiles(spark):
    frame = spark.createDataFrame(
        [("a", k, float(v)) for k, v in enumerate((1, 2, 3, 10))] + [("b", 9, 4.0)],
        "g string, k int, v double",
    )
    placed = ranking.place_by_range(frame, ("v", "k"), ("g",))
    found = ranking.group_quantiles(placed, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    assert {tuple(r) for r in found.collect()} == {("a", 4, 1.75, 2.5, 4.75), ("b", 1, 4.0, 4.0, 4.0)}


def test_quantiles_over_many_ranges(spark):
    rng = random.Random(11)
    rows = [(rng.choice("aab"), k, rng.choice((0, 0, rng.randint(-999, 999)))) for k in range(5000)]
    frame = spark.createDataFrame(rows, "g string, k int, v bigint")
    wide = ranking.place_by_range(frame.repartition(9), ("v", "k"), ("g",))
    probabilities = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99}
    found = ranking.group_quantiles(wide, "v", probabilities)
    exact = frame.groupBy("g").agg(
        F.count("*").alias("n"),
        *[F.percentile("v", p).alias(name) for name, p in probabilities.items()],
    )
    for ours, built_in in zip(found.orderBy("g").collect(), exact.orderBy("g").collect(), strict=True):
        assert tuple(ours)[:2] == tuple(built_in)[:2]
        assert tuple(ours)[2:] == pytest.approx(tuple(built_in)[2:])


def test_box_stats_and_outliers(spark):
    values = [1, 2, 3, 4, 5, 6, 7, 8, 9, 100, 200, -90]
    totals = spark.createDataFrame(
        [(f"u{i}", 1, "A", v) for i, v in enumerate(values)],
        "userid string, subscriber int, category string, total_points bigint",
    )
    stats = boxplot.box_stats(totals, ["category"]).first()
    assert (stats["n"], stats["q1"], stats["median"], stats["q3"]) == (12, 2.75, 5.5, 8.25)
    assert (stats["whisker_low"], stats["whisker_high"], stats["num_outliers"]) == (1, 9, 3)
    top = boxplot.top_outliers(totals, "category", "A", 2).collect()
    assert [(r["total_points"], r["threshold"]) for r in top] == [(200, 100), (100, 100)]


def test_leaderboard_keeps_ties(spark):
    facts = spark.sql(
        "select * from values ('a', date'2019-01-05', 16, 10), ('b', date'2020-01-06', 16, 10),"
        " ('c', date'2019-01-07', 16, 4), ('c', date'2019-01-08', 17, 2), ('d', date'2019-01-09', 16, 5),"
        " ('a', date'2019-02-01', 16, -1) as t(userid, event_date, hour, points)"
    )
    rows = [tuple(r) for r in ranking.top_players_per_month(facts, 2).collect()]
    assert rows == [("a", 1, 10, 1), ("b", 1, 10, 1), ("c", 1, 6, 2), ("a", 2, -1, 1)]


def test_leaderboard_prunes_before_the_shuffle(spark):
    result = ranking.top_players_per_month(OrderTables(spark, SMALL).facts, 2)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_zero_total_is_a_class_of_its_own(spark):
    facts = spark.sql(
        "select * from values ('z', date'2019-01-05', 16, 5), ('z', date'2019-02-05', 16, -5),"
        " ('p', date'2019-01-05', 16, 3) as t(userid, event_date, hour, points)"
    )
    classes = {r["userid"]: r["user_type"] for r in segments.classified_totals(facts).collect()}
    assert classes == {"z": segments.ZERO, "p": segments.POSITIVE}
    assert segments.classified_facts(facts).count() == 1
    assert segments.facts_of_class(facts, segments.ZERO).count() == 2


def test_simple_regression(spark):
    frame = spark.createDataFrame([(0, 1), (0, 2), (1, 5), (1, 9)], "x int, y bigint")
    fit = regression.fit_linear(frame, "y", ["x"])
    assert fit.coefficients == pytest.approx([1.5, 5.5])
    assert fit.std_errors == pytest.approx([math.sqrt(4.25 / 2), math.sqrt(4.25)])
    assert regression.correlation(frame, "x", "y", 10).first()[0] == round(0.8835412617927487, 10)
    rows = fit.predict(frame, "y").collect()
    assert [r["predicted"] for r in rows] == pytest.approx([1.5, 1.5, 7.0, 7.0])
    assert [r["residual"] for r in rows] == pytest.approx([-0.5, 0.5, -2.0, 2.0])
    with pytest.raises(ValueError, match="too few"):
        regression.fit_linear(frame.limit(2), "y", ["x"])


def test_multiple_regression_matches_the_built_in_solver(spark):
    frame = OrderTables(spark, SMALL).dummy_totals
    xs = ["subscriber", "country_MX", "country_US"]
    fit = regression.fit_linear(frame, "total_points", xs)
    vectors = VectorAssembler(inputCols=xs, outputCol="features").transform(frame)
    model = LinearRegression(labelCol="total_points", solver="normal").fit(vectors)
    assert fit.coefficients == pytest.approx([model.intercept, *model.coefficients])
    *errors, constant_error = model.summary.coefficientStandardErrors
    assert fit.std_errors == pytest.approx([constant_error, *errors])
    *p_values, constant_p = model.summary.pValues
    assert fit.p_values == pytest.approx([constant_p, *p_values], abs=1e-9)


def test_anova_textbook(spark):
    groups = {"a": (6, 8, 4, 5, 3, 4), "b": (8, 12, 9, 11, 6, 8), "c": (13, 9, 11, 8, 7, 12)}
    frame = spark.createDataFrame(
        [(g, v) for g, values in groups.items() for v in values], "g string, v int"
    )
    row = hypothesis.one_way_anova(frame, "v", "g").first()
    assert (round(row["f_statistic"], 4), row["df_between"], row["df_within"]) == (9.2647, 2, 15)
    assert row["p_value"] == pytest.approx(0.0023988, abs=1e-6)


def test_chi_square_with_and_without_yates(spark):
    names = "level string, positive_users bigint, negative_users bigint"
    wide = spark.createDataFrame([("a", 10, 20), ("b", 20, 20), ("c", 30, 40)], names)
    row = hypothesis.chi_square(spark, wide).first()
    expected = sum(
        (o - r * c / 140) ** 2 / (r * c / 140)
        for o, r, c in [(10, 30, 60), (20, 30, 80), (20, 40, 60), (20, 40, 80), (30, 70, 60), (40, 70, 80)]
    )
    assert row["chi2"] == pytest.approx(expected) and row["dof"] == 2
    assert row["p_value"] == pytest.approx(math.exp(-expected / 2))
    square = spark.createDataFrame([("a", 12, 5), ("b", 7, 7)], names)
    row = hypothesis.chi_square(spark, square).first()
    # Yates: n (|ad - bc| - n/2)^2 over the product of the margins.
    assert row["chi2"] == pytest.approx(31 * (abs(12 * 7 - 5 * 7) - 15.5) ** 2 / (17 * 14 * 19 * 12))


def test_tests_refuse_empty_cells(spark):
    names = "level string, positive_users bigint, negative_users bigint"
    with pytest.raises(ValueError, match="at least one count"):
        hypothesis.chi_square(spark, spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], names))
    with pytest.raises(ValueError, match="two groups"):
        hypothesis.one_way_anova(spark.createDataFrame([("a", 1), ("a", 2)], "g string, v int"), "v", "g")


def test_contingency_grains(spark):
    users = spark.sql("select * from values ('p', 0, 'A'), ('n', 0, 'A'), ('z', 1, 'B') as t(userid, subscriber, category)")
    facts = spark.sql(
        "select * from values ('p', date'2019-01-01', 16, 1), ('p', date'2019-01-02', 16, 1),"
        " ('n', date'2019-01-01', 16, -1), ('g', date'2019-01-01', 16, 9) as t(userid, event_date, hour, points)"
    )
    by_row = {tuple(r) for r in hypothesis.contingency_table(users, facts, "category").collect()}
    assert by_row == {("A", 3, 2), ("B", 1, 1)}
    by_user = {tuple(r) for r in hypothesis.contingency_table(users, facts, "category", "user").collect()}
    assert by_user == {("A", 1, 1), ("B", 0, 0)}


def test_probability_plot(spark):
    frame = spark.createDataFrame([(f"u{i}", float(v)) for i, v in enumerate((3, 1, 2, 2, 9))], "k string, v double")
    rows = regression.probability_plot(frame, "v", "k").orderBy("rank").collect()
    assert [r["ordered"] for r in rows] == [1, 2, 2, 3, 9]
    medians = [1 - 0.5 ** 0.2, *[(i - 0.3175) / 5.365 for i in (2, 3, 4)], 0.5 ** 0.2]
    assert [r["theoretical"] for r in rows] == pytest.approx([NormalDist().inv_cdf(m) for m in medians])


def test_one_hot_keeps_null_and_refuses_other_levels(spark):
    frame = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    coded = encoding.one_hot(frame, "c", ["a", "b"])
    assert [tuple(r) for r in coded.collect()] == [(0.0, 1.0), (1.0, 0.0), (None, None)]
    with pytest.raises(Exception, match="c has no level b"):
        encoding.one_hot(frame, "c", ["a"]).collect()


def test_expected_counts_beyond_whole_numbers(spark):
    n = 4_000_000_000
    table = spark.createDataFrame([("a", n, n), ("b", n, 3 * n)], "level string, positive_users long, negative_users long")
    rows = {r["level"]: r for r in hypothesis.expected_counts(table).collect()}
    assert rows["a"]["expected_positive"] == pytest.approx(2 * n / 3)
    assert hypothesis.chi_square(spark, table).first()["p_value"] == 0.0


def test_exact_fit_and_columns_of_very_different_size(spark):
    flat = spark.range(10).selectExpr("cast(id as double) as x", "0D as y", "2D * id + 1 as z")
    fit = regression.fit_linear(flat, "y", ["x"])
    assert fit.coefficients == [0.0, 0.0] and all(map(math.isnan, fit.t_values))
    line = regression.fit_linear(flat, "z", ["x"])
    assert line.coefficients == pytest.approx([1, 2]) and line.t_values[1] == math.inf
    assert line.p_values == [0.0, 0.0] and line.table(spark).count() == 2
    mixed = spark.range(200).selectExpr(
        "id % 2 as flag", "(id * 7919 % 200) * 1e12 as huge", "id % 2 * 3 + (id * 7919 % 200) * 5 + id % 3 as y"
    )
    fit = regression.fit_linear(mixed, "y", ["flag", "huge"])
    assert fit.coefficients[1] == pytest.approx(3, abs=0.1)
    assert fit.coefficients[2] == pytest.approx(5e-12, rel=1e-2)
    with pytest.raises(ValueError, match="depend on each other"):
        regression.fit_linear(mixed.withColumn("twice", F.col("huge") * 2), "y", ["huge", "twice"])


def test_tails_at_very_many_degrees_of_freedom():
    for df in (1e6, 1e9, 1e11):
        assert t_two_sided(1.959963984540054, df) == pytest.approx(0.05, abs=1e-6 if df < 1e9 else 1e-9)
        assert t_two_sided(1e-3, df) == pytest.approx(2 * (1 - NormalDist().cdf(1e-3)), abs=1e-9)


def test_totals_agree_between_views_of_the_facts(spark):
    t = OrderTables(spark, SMALL)
    total = t.facts.agg(F.sum("points")).first()[0]
    sums = [
        series.monthly_activity(t.facts).agg(F.sum("total_points")),
        series.daily_totals(t.facts).agg(F.sum("total_points")),
        series.season_hour_totals(t.facts).agg(F.sum("tot_points")),
        segments.monthly_points_by_class(t.facts).agg(F.sum("points")),
    ]
    assert [s.first()[0] for s in sums] == [total] * 4
