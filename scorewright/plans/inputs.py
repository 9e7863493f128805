"""The tables the named jobs run on."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from scorewright.operators import encoding, moments
from scorewright.operators.cleaning import (
    fact_rules,
    flagged_facts,
    flagged_users,
    normalise_dates,
    user_rules,
)
from scorewright.operators.joins import users_with_totals
from scorewright.operators.quality import Written, write_split
from scorewright.sources import derived, schemas
from scorewright.sources.csv_files import load_csv_lines
from scorewright.sources.layout import ByUser, store_by_user

#: First day of the batch that is added to the moments of the earlier days.
SECOND_BATCH = date(2015, 1, 1)


class Inputs:
    """Raw and clean users and facts, and the user attribute under study with its levels."""

    staging_users: DataFrame
    staging_facts: DataFrame
    users: DataFrame
    facts: DataFrame

    def __init__(
        self,
        spark: SparkSession,
        attribute: str,
        levels: Sequence[str],
        as_of: date = schemas.ANALYSIS_DATE,
    ):
        self.spark = spark
        self.as_of = as_of
        self.attribute = attribute
        self.levels = tuple(levels)

    @property
    def profile(self) -> list[str]:
        return ["subscriber", self.attribute]

    @property
    def dummies(self) -> list[str]:
        return encoding.dummy_columns(self.attribute, self.levels)

    def flagged_users(self) -> DataFrame:
        """Every staging user with the rules it breaks."""
        return flagged_users(self.staging_users, self.levels, self.attribute)

    def flagged_facts(self) -> DataFrame:
        """Every staging fact, repaired, with the rules it breaks."""
        return flagged_facts(self.staging_facts, self.as_of)

    def written_facts(self) -> Written:
        """The staging facts, checked, written as valid and rejected ones, and counted."""
        rules = [rule.name for rule in fact_rules(self.as_of)]
        return write_split(self.flagged_facts(), "event-performance", rules)

    def written_users(self) -> Written:
        rules = [rule.name for rule in user_rules(self.levels, self.attribute)]
        return write_split(self.flagged_users(), "users", [*rules, "userid_unique"])

    @cached_property
    def stored(self) -> ByUser:
        """Facts and users in buckets by user and folders by month."""
        return store_by_user(self.facts, self.users)

    @cached_property
    def moments(self) -> moments.UserMoments:
        """Moments of the user totals, from two batches of facts: before a day and from it on."""
        later = F.col("event_date") >= F.lit(SECOND_BATCH)
        earlier = self.facts.where(~F.coalesce(later, F.lit(False)))
        first = moments.start(self.users, earlier, self.profile)
        return first.add(self.facts.where(later))

    @cached_property
    def dated_facts(self) -> DataFrame:
        """Staging facts after the date repair."""
        return normalise_dates(self.staging_facts)

    @cached_property
    def event_dates(self) -> DataFrame:
        """The repaired dates alone."""
        return normalise_dates(self.staging_facts.select("event_date"))

    @cached_property
    def totals(self) -> DataFrame:
        """Registered users with their total points."""
        return users_with_totals(self.users, self.facts, self.attribute)

    @cached_property
    def dummy_totals(self) -> DataFrame:
        """User totals with one 0/1 column per attribute level."""
        return encoding.one_hot(self.totals, self.attribute, self.levels)


class OrderTables(Inputs):
    """Tables derived from the orders, customers and suppliers in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, "country", schemas.COUNTRY_LEVELS)
        self.folder = folder

    @cached_property
    def staging_users(self) -> DataFrame:
        return derived.staging_users(self.spark, self.folder)

    @cached_property
    def staging_facts(self) -> DataFrame:
        return derived.staging_facts(self.spark, self.folder)

    @cached_property
    def users(self) -> DataFrame:
        return derived.users(self.spark, self.folder)

    @cached_property
    def facts(self) -> DataFrame:
        return derived.facts(self.spark, self.folder)


class Cleaned(Inputs):
    """Inputs whose users and facts are the valid staging rows.

    The flagged rows are written once to the shared folder, valid and rejected rows apart.
    """

    @cached_property
    def _checked_users(self) -> Written:
        return self.written_users()

    @cached_property
    def _checked_facts(self) -> Written:
        return self.written_facts()

    @cached_property
    def users(self) -> DataFrame:
        return self._checked_users.valid

    @cached_property
    def facts(self) -> DataFrame:
        return self._checked_facts.valid

    @property
    def rejected_users(self) -> DataFrame:
        return self._checked_users.rejected

    @property
    def rejected_facts(self) -> DataFrame:
        return self._checked_facts.rejected


class CleanedOrderTables(Cleaned, OrderTables):
    """The raw form of the derived tables, cleaned."""


class CsvTables(Cleaned):
    """Raw CSV files, cleaned; lines that do not fit the columns are kept apart."""

    def __init__(
        self,
        spark: SparkSession,
        users_path: str,
        facts_path: str,
        attribute: str = "country",
        levels: Sequence[str] = schemas.COUNTRY_LEVELS,
        as_of: date = schemas.ANALYSIS_DATE,
    ):
        super().__init__(spark, attribute, levels, as_of)
        self.staging_users, self.malformed_users = load_csv_lines(
            spark, users_path, schemas.staging_users(attribute)
        )
        self.staging_facts, self.malformed_facts = load_csv_lines(
            spark, facts_path, schemas.staging_facts()
        )
