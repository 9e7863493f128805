"""User totals and the statistics on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scorewright.operators import boxplot, hypothesis, regression, segments
from scorewright.plans.inputs import Inputs
from scorewright.sources.storage import materialize

_TOTAL = "total_points"


def _rounded(df: DataFrame, places: int = 4) -> DataFrame:
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: F.round(name, places) for name in doubles})


def q56_user_totals(t: Inputs) -> DataFrame:
    return t.totals


def q57_box_stats(t: Inputs) -> DataFrame:
    return boxplot.box_stats(t.totals, ["subscriber", t.attribute])


def q58_top_outliers(t: Inputs) -> DataFrame:
    return boxplot.top_outliers(t.totals, t.attribute, t.levels[-1], 9)


def q59_subscriber_correlation(t: Inputs) -> DataFrame:
    return regression.correlation(t.totals, _TOTAL, "subscriber")


def q60_subscriber_regression(t: Inputs) -> DataFrame:
    fit = regression.fit_linear(t.totals, _TOTAL, ["subscriber"])
    return _rounded(fit.table(t.spark))


def _residuals(t: Inputs) -> DataFrame:
    totals = materialize(t.totals, "user-totals")
    fit = regression.fit_linear(totals, _TOTAL, ["subscriber"])
    return fit.predict(totals, _TOTAL)


def q61_residuals(t: Inputs) -> DataFrame:
    return _rounded(
        _residuals(t).select("userid", "subscriber", _TOTAL, "predicted", "residual")
    )


def q62_probability_plot(t: Inputs) -> DataFrame:
    return _rounded(regression.probability_plot(_residuals(t), "residual", "userid"))


def q62_probability_plot_line(t: Inputs) -> DataFrame:
    plot = regression.probability_plot(_residuals(t), "residual", "userid")
    return regression.probability_plot_line(plot)


def q63_anova(t: Inputs) -> DataFrame:
    return _rounded(hypothesis.one_way_anova(t.totals, _TOTAL, t.attribute))


def q64_dummy_frame(t: Inputs) -> DataFrame:
    return t.dummy_totals


def q65_correlations(t: Inputs) -> DataFrame:
    return regression.correlations_with(t.dummy_totals, ["subscriber", *t.dummies], _TOTAL)


def q65_correlation_matrix(t: Inputs) -> DataFrame:
    return regression.correlation_matrix(t.dummy_totals, ["subscriber", *t.dummies, _TOTAL])


def q66_multiple_regression(t: Inputs) -> DataFrame:
    fit = regression.fit_linear(t.dummy_totals, _TOTAL, ["subscriber", *t.dummies[1:]])
    return _rounded(fit.table(t.spark))


def q67_classified_totals(t: Inputs) -> DataFrame:
    return segments.classified_totals(t.facts)


def q67_classified_facts(t: Inputs) -> DataFrame:
    return segments.classified_facts(t.facts)


def q67_positive_facts(t: Inputs) -> DataFrame:
    return segments.facts_of_class(t.facts, segments.POSITIVE)


def q68_users_with_negative_facts(t: Inputs) -> DataFrame:
    return segments.users_with_facts_of_class(t.users, t.facts, segments.NEGATIVE)


def q68_users_with_positive_facts(t: Inputs) -> DataFrame:
    return segments.users_with_facts_of_class(t.users, t.facts, segments.POSITIVE)


def q68_class_row_shares(t: Inputs) -> DataFrame:
    return hypothesis.class_row_shares(t.users, t.facts, ["subscriber", t.attribute])


def q69_contingency_table(t: Inputs) -> DataFrame:
    return hypothesis.expected_counts(
        hypothesis.contingency_table(t.users, t.facts, t.attribute, "row")
    )


def q69_contingency_table_by_user(t: Inputs) -> DataFrame:
    return hypothesis.expected_counts(
        hypothesis.contingency_table(t.users, t.facts, t.attribute, "user")
    )


def q69_chi_square(t: Inputs) -> DataFrame:
    table = hypothesis.contingency_table(t.users, t.facts, t.attribute, "row")
    return _rounded(hypothesis.chi_square(t.spark, table))


def q69_chi_square_by_user(t: Inputs) -> DataFrame:
    table = hypothesis.contingency_table(t.users, t.facts, t.attribute, "user")
    return _rounded(hypothesis.chi_square(t.spark, table))
