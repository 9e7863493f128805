"""Participation, user profiles and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scorewright.operators import joins, segments, shares, summary
from scorewright.plans.inputs import Inputs
from scorewright.sources import tables

_FACT_ORDER = ("event_date", "hour", "userid", "points")


def q01_registered_players(t: Inputs) -> DataFrame:
    return summary.count_distinct(t.users, "userid", "num_players")


def q02_participating_players(t: Inputs) -> DataFrame:
    return summary.count_distinct(t.facts, "userid", "num_participating_players")


def q03_events(t: Inputs) -> DataFrame:
    return summary.count_distinct(t.facts, "event_date", "num_gaming_events")


def q24_matched_ids(t: Inputs) -> DataFrame:
    return joins.matched_id_counts(t.facts, t.users)


def q25_ghost_ids(t: Inputs) -> DataFrame:
    return joins.ghost_ids(t.facts, t.users).withColumnRenamed("userid", "ghost_userids")


def q26_ghost_rows(t: Inputs) -> DataFrame:
    return joins.ghost_row_count(t.facts, t.users)


def q27_fact_rows(t: Inputs) -> DataFrame:
    return summary.count_rows(t.facts, "num_rows")


def q28_event_stats(t: Inputs) -> DataFrame:
    return summary.event_stats(t.facts)


def q29_participation_stats(t: Inputs) -> DataFrame:
    return summary.participation_stats(t.facts, t.users)


def q30_points_summary(t: Inputs) -> DataFrame:
    return summary.points_summary(t.facts, t.users)


def q31_subscriber_proportions(t: Inputs) -> DataFrame:
    return shares.proportions(t.users, ["subscriber"]).orderBy("subscriber")


def q32_attribute_proportions(t: Inputs) -> DataFrame:
    return shares.proportions(t.users, [t.attribute]).orderBy(t.attribute)


def q33_stacked_frequencies(t: Inputs) -> DataFrame:
    return shares.stacked_frequencies(t.users, t.profile).orderBy("attribute")


def q34_profile_frequencies(t: Inputs) -> DataFrame:
    counted = shares.frequencies(t.users, t.profile)
    return shares.with_share(counted, "num_users", "rel_freq").orderBy(*t.profile)


def q34_profile_proportions(t: Inputs) -> DataFrame:
    return shares.proportions(t.users, t.profile).orderBy(*t.profile)


def q35_proportions_within_subscriber(t: Inputs) -> DataFrame:
    return shares.proportions(t.users, t.profile, within=["subscriber"]).orderBy(*t.profile)


def q36_enriched_facts(t: Inputs) -> DataFrame:
    return tables.create_views(t.facts, t.users, t.attribute)


def q36_subscriber_facts(t: Inputs) -> DataFrame:
    tables.create_views(t.facts, t.users, t.attribute)
    return tables.run_query(t.spark, "SELECT * FROM subscribers")


def q36_non_subscriber_facts(t: Inputs) -> DataFrame:
    tables.create_views(t.facts, t.users, t.attribute)
    return tables.run_query(t.spark, "SELECT * FROM non_subscribers")


def q37_participants_by_status(t: Inputs) -> DataFrame:
    return shares.participants_by_status(t.facts, t.users)


def q38_subscription_rate(t: Inputs) -> DataFrame:
    return shares.subscription_rate(t.users)


def q39_points_share_by_attribute(t: Inputs) -> DataFrame:
    return shares.points_share(t.facts, t.users, t.attribute)


def q40_points_share_by_subscriber(t: Inputs) -> DataFrame:
    return shares.points_share(t.facts, t.users, "subscriber")


def q41_fact_preview(t: Inputs) -> DataFrame:
    return tables.preview(t.facts, _FACT_ORDER, 5)


def q42_sign_class_frequencies(t: Inputs) -> DataFrame:
    return segments.sign_class_frequencies(t.facts)


def q53_rows_per_level(t: Inputs) -> DataFrame:
    return shares.rows_per_level(t.facts, t.users, t.attribute)


def q54_profile_percentages(t: Inputs) -> DataFrame:
    keys = [t.attribute, "subscriber"]
    return shares.percentages(t.users, keys).orderBy(*keys)


def q55_percentages_within_attribute(t: Inputs) -> DataFrame:
    keys = [t.attribute, "subscriber"]
    return shares.percentages(t.users, keys, within=[t.attribute]).orderBy(*keys)
