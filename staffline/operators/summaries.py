"""Monthly series from stored summaries (A3, A8): month events kept per data set.

A data set is saved together with its cells (``cube.event_cells``: month events by dimension). Cells add up, so the series
of all data sets, or of any of them, come from the cells of the versions that are live: a new version's cells replace the
former ones, a deleted data set's are no longer read. Staff rows are read once, when they are saved.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.dates import DEFAULT_AS_OF
from ..sources import store
from . import attrition, cube, headcount

CELLS = "month_cells"
DIMENSIONS = ("department", "gender")


def save_with_summary(spark: SparkSession, root: str, owner: str, dataset_id: str, tables: Mapping[str, DataFrame], name: str,
                      file_name: str, created_at: str, dims: Sequence[str] = DIMENSIONS, mode: str = "compat") -> str:
    """``store.save_dataset`` of prepared staff (and other tables) with the staff's cells beside them."""
    cells = cube.event_cells(tables["staff"], dims, mode=mode)
    return store.save_dataset(spark, root, owner, dataset_id, {**tables, CELLS: cells}, name, file_name, created_at)


def live_cells(spark: SparkSession, root: str, owner: str, dataset_ids: Sequence[str] | None = None) -> DataFrame | None:
    """The cells of an owner's live data sets (all, or the given ones); None if there are none."""
    return store.read_all(spark, root, owner, CELLS, dataset_ids)


def history(spark: SparkSession, root: str, owner: str, by: Sequence[str] = (), as_of: str = DEFAULT_AS_OF,
            dataset_ids: Sequence[str] | None = None) -> DataFrame | None:
    """A3 over the live data sets."""
    cells = live_cells(spark, root, owner, dataset_ids)
    return None if cells is None else attrition.labelled(attrition.history_of(cube.month_events(cells, by), by, as_of), by)


def headcount_monthly(spark: SparkSession, root: str, owner: str, group: str = "department", as_of: str = DEFAULT_AS_OF,
                      dataset_ids: Sequence[str] | None = None) -> DataFrame | None:
    """A8 over the live data sets."""
    cells = live_cells(spark, root, owner, dataset_ids)
    return None if cells is None else headcount.monthly_of(headcount.series_of(cube.month_events(cells, [group], ids=True), group, as_of), group)
