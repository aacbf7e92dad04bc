"""The best rows of a query: within a task, and over all tasks."""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Best:
    """The ``k`` highest scores seen, ties to the smaller id, a null id last.

    ``floor`` is the score that a row needs to get in (equal scores may): it begins at what is
    known to be reached and rises to the last of ``k`` rows.
    """

    def __init__(self, k: int, floor: int | None = None):
        self.k, self.floor, self._rows = k, floor, []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``ids``: objects, None for null."""
        if self.floor is not None:
            fit = scores >= self.floor
            scores, ids = scores[fit], ids[fit]
        if len(scores) > self.k:
            fit = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[fit], ids[fit]
        if len(scores):
            new = [(-int(s), x is None, x or 0, x) for s, x in zip(scores.tolist(), ids.tolist())]
            self._rows = sorted(self._rows + new, key=lambda r: r[:3])[: self.k]
            if len(self._rows) == self.k:
                last = -self._rows[-1][0]
                self.floor = last if self.floor is None else max(self.floor, last)

    def rows(self) -> list[tuple[int | None, int]]:
        return [(x, -score) for score, _, _, x in self._rows]


def best_of_all(rows: DataFrame, by: str, id_column: str, k: int) -> DataFrame:
    """The ``k`` best of each ``by`` with their ``rank``.

    Rows that cannot be among them are left out before the shuffle, so that a task passes on
    ``k`` rows of each query at most.
    """
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col(id_column).asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def floors(rows: DataFrame, by: str, id_column: str, k: int) -> dict[int, int]:
    """The score of the last of ``k`` rows, for each query that has as many."""
    best = best_of_all(rows, by, id_column, k)
    last = best.groupBy(by).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    return {r[by]: r["floor"] for r in last.filter(F.col("n") == k).collect()}
