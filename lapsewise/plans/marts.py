"""The tables between ingestion and the models, written once and read by all of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

from lapsewise.config import Params
from lapsewise.operators import ingest, revenue, spells
from lapsewise.session import materialise
from lapsewise.sources import warehouse
from lapsewise.sources.figures import table_state


@dataclass(frozen=True)
class Marts:
    """staged and subjects are tables; the rest are narrow projections of subjects."""

    # The deliverables, each with its own schema.
    TABLES: ClassVar = ("spells", "excluded", "quarantine", "revenue", "reactivation")

    staged: DataFrame
    members: DataFrame
    users: DataFrame
    subjects: DataFrame
    params: Params

    @cached_property
    def numbered(self) -> DataFrame:
        return spells.number_spells(self.staged, self.params)

    @cached_property
    def spells(self) -> DataFrame:
        return spells.spells(self.subjects)

    @cached_property
    def quarantine(self) -> DataFrame:
        return spells.spells_quarantine(self.subjects)

    @cached_property
    def excluded(self) -> DataFrame:
        return spells.spells_excluded(self.subjects)

    @cached_property
    def revenue(self) -> DataFrame:
        return revenue.spell_revenue(self.subjects)

    @cached_property
    def reactivation(self) -> DataFrame:
        return revenue.reactivation(self.subjects, self.params)


class MartsOnDemand(Marts):
    """Marts whose tables are written when first read: what reads subjects alone does not
    pay for staged, nor the reverse."""

    def __init__(
        self, clean: Callable[[DataFrame], DataFrame], raw: DataFrame, members: DataFrame,
        params: Params, write: Callable[[str, DataFrame], DataFrame],
        deal: Callable[[DataFrame], DataFrame],
    ):
        for name, value in (("_clean", clean), ("_raw", raw), ("members", members),
                            ("params", params), ("_write", write), ("_deal", deal)):
            object.__setattr__(self, name, value)

    @cached_property
    def staged(self) -> DataFrame:
        return self._write("staged", self._clean(self._raw))

    @property
    def by_user(self) -> DataFrame:
        """The rows of staged dealt by user. Copies share a user, so that raw rows are dealt
        once and then cleaned, unless staged is there already."""
        if "staged" in vars(self):
            return self._deal(self.staged)
        return self._clean(self._deal(self._raw))

    @cached_property
    def users(self) -> DataFrame:
        return self._write("users", spells.user_rows(self.staged))

    @cached_property
    def subjects(self) -> DataFrame:
        return self._write("subjects", spells.build_subjects(self.by_user, self.members, self.params))


def build_marts(
    staged: DataFrame,
    members: DataFrame,
    params: Params,
    write: Callable[[str, DataFrame], DataFrame],
) -> Marts:
    """Segment once, write the subject table, and project everything from it.

    staged should be a written table: it is read twice. write keeps a table under a name
    and reads it back.
    """
    users = write("users", spells.user_rows(staged))
    subjects = write("subjects", spells.build_subjects(staged, members, params))
    return Marts(staged, members, users, subjects, params)


_built: dict[tuple[str, str, str, Params], Marts] = {}


def warehouse_state(spark: SparkSession, sf_dir: str) -> str:
    """Changes whenever a file of the tables behind the subscription view does."""
    return table_state(spark, *[f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "customer")])


def warehouse_marts(spark: SparkSession, sf_dir: str, params: Params) -> Marts:
    """Marts over the warehouse tables of sf_dir: the first query to read a table writes
    it, and later ones read what it wrote, until a file of the tables changes."""
    key = (spark.sparkContext.applicationId, sf_dir, warehouse_state(spark, sf_dir), params)
    if key not in _built:
        _built[key] = MartsOnDemand(
            lambda raw: ingest.stage_transactions(raw, params)[0],
            warehouse.raw_transactions(spark, sf_dir, params),
            ingest.stage_members(warehouse.raw_members(spark, sf_dir, params)),
            params,
            lambda name, df: materialise(df, f"marts-{name}"),
            lambda rows: warehouse.by_user(spark, sf_dir, rows),
        )
    return _built[key]
