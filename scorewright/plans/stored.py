"""Jobs on stored clean tables, and figures that are taken while tables are written."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from scorewright.operators import distinct, joins, moments, series
from scorewright.plans.inputs import Inputs

#: The period of the job that reads a part of the months.
PERIOD = (date(2012, 1, 1), date(2012, 12, 31))


def q22_row_account_while_writing(t: Inputs) -> DataFrame:
    """Where the staging facts go, as counted by the write that splits them."""
    return t.written_facts().row_account(t.spark)


def q22_rejection_counts_while_writing(t: Inputs) -> DataFrame:
    return t.written_facts().rejection_counts(t.spark)


def q36_enriched_facts_by_user(t: Inputs) -> DataFrame:
    return t.stored.each_part(lambda facts, users: joins.enrich_facts(facts, users, t.attribute))


def q43_monthly_activity_of_a_year(t: Inputs) -> DataFrame:
    return series.monthly_activity(t.stored.period(*PERIOD)).orderBy("month")


def q43_players_by_month_quarter_year(t: Inputs) -> DataFrame:
    return distinct.counts_by_month_quarter_year(t.facts, "event_date", "userid", "num_players")


def q56_user_totals_by_user(t: Inputs) -> DataFrame:
    return t.stored.each_part(lambda facts, users: joins.users_with_totals(users, facts, t.attribute))


def q59_subscriber_correlation_from_moments(t: Inputs) -> DataFrame:
    return moments.correlation(t.moments, "subscriber")


def q59_subscriber_correlation_by_month(t: Inputs) -> DataFrame:
    return moments.correlation_by_month(t.moments, "subscriber")


def q63_anova_from_moments(t: Inputs) -> DataFrame:
    found = moments.one_way_anova(t.moments, t.attribute)
    return found.withColumns({c: F.round(c, 4) for c in ("f_statistic", "p_value")})


def q66_multiple_regression_from_moments(t: Inputs) -> DataFrame:
    table = moments.fit_linear(t.moments, t.attribute, t.levels).table(t.spark)
    return table.withColumns({c: F.round(c, 4) for c, kind in table.dtypes if kind == "double"})
