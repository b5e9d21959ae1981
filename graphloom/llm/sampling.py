"""Bounded samples of labelled rows, for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, label: str, key: str, most: int) -> tuple[DataFrame, dict]:
    """About `most` rows at most for all labels together, as many of each label as there are if few; {label: its rows in all}.

    A row is chosen by a hash of its key, so reruns agree; the expected number is the bound, and chance may add a few
    rows to it. Every row counts in the totals. Rows without label or key are left out.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    totals = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row for each label
    if not totals:
        return rows.limit(0), totals
    each, room = {}, most
    for i, (value, n) in enumerate(sorted(totals.items(), key=lambda x: x[1])):  # what small labels leave goes to the larger
        each[value] = min(n, room // (len(totals) - i))
        room -= each[value]
    chosen = F.lit(False)
    hashed = F.xxhash64(F.col(key), F.lit("sample"))
    for value, n in totals.items():
        last = (each[value] << 64) // n - (1 << 63) - 1  # the greatest hash of the share, to within 2 ** -64
        chosen = chosen | ((F.col(label) == F.lit(value)) & (hashed <= F.lit(last).cast("long")) if each[value] else F.lit(False))
    return rows.where(chosen), totals
