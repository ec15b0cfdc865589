"""Look words up where their documents are.

A corpus has many times more tokens than words, so a join of tokens on a word
should move words, not tokens.  Documents are dealt to *seats*, one a
partition; each seat asks for its distinct words, the answers are dealt to
the seats that asked, and the join on ``(seat, word)`` finds both sides in
place: no token is shuffled, and a hot word is no hot task.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEAT = "_seat"


@lru_cache(maxsize=8)
def _seat_ids(n: int) -> tuple[int, ...]:
    """For each of ``n`` partitions an integer that ``repartition(n, column)`` deals to it."""
    k = F.col("id").cast("int")
    rows = SparkSession.getActiveSession().range(0, 40 * n + 200, 1, 1).select(k.alias("k"), F.pmod(F.hash(k), F.lit(n)).alias("p")).collect()
    first: dict[int, int] = {}
    for r in rows:
        first.setdefault(r["p"], r["k"])
    # any integer is right, one that shares a partition only makes that one larger
    return tuple(first.get(p, p) for p in range(n))


def join_in_place(spark: SparkSession) -> None:
    """Let joins use partitions by some of their keys: both sides dealt alike by a document's id need no exchange of words.

    The planner's option for that is set on the session, as plans are made when they run.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def seated(rows: DataFrame, by: Column, n: int | None = None) -> DataFrame:
    """Rows dealt to ``n`` partitions by a hash; column ``_seat`` says to which.

    Joins on the seat and a word use the partitions of the seat alone.
    """
    join_in_place(rows.sparkSession)
    n = n or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = F.array(*[F.lit(i) for i in _seat_ids(n)])
    return rows.withColumn(SEAT, F.get(ids, F.pmod(by, F.lit(n)).cast("int"))).repartition(n, SEAT)


def has_seats(rows: DataFrame) -> bool:
    return SEAT in rows.columns


def answers(asks: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """``(seat, *on)`` questions joined with ``table``, each answer dealt to the seat that asked.

    ``asks`` come from seated rows: their distinct values are taken inside each partition.
    """
    n = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return asks.select(SEAT, *on).distinct().join(table, on, "inner").repartition(n, SEAT)
