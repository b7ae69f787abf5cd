"""Packages that arrive in parts: state by package, a new finding at each arrival, and an end by timer.

The state of a package is what its audit adds up (whole numbers, so any order of arrival gives the same), never its
rows, and so has one size however many rows there are. Packages are kept in BUCKETS states, by a hash of their key. Each batch in which rows of a package arrive gives its finding
anew; ``current`` takes the last one. A package without arrivals for ``within`` of event time gives its last finding
once more, closed, and its state goes; rows that come later than the watermark are dropped, rows after that begin anew.
Restarted from its checkpoint a stream goes on with the same state.

Nulls: rows without a package are left out, rows without a price count as arrivals only. Repeated rows count as often
as they come.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.findings import verdict
from ..operators.prices import VARIATION_LIMIT

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: States of all packages; a batch reads and writes those whose packages it has. A stream keeps the number it began with.
BUCKETS = 1024
_OUT = "pk string, at timestamp, arrival int, n_prices long, cv double, closed boolean"


class PriceSums(StatefulProcessor):
    """Sums of the packages of a bucket: number, sum and sum of squares of prices; squares are text, as they may pass 64 bits.

    A call to the state store takes milliseconds, so packages share one state by a hash of their key, and a batch reads and
    writes the state of a bucket once. The bucket's timer is that of its package whose time is up first.
    """

    def __init__(self, within_ms: int):
        self.within_ms = within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "pk array<string>, n array<long>, total array<string>, squares array<string>, arrival array<int>, last array<long>")

    def _known(self) -> dict[str, list[int]]:
        """pk to n, total, squares, arrival, last."""
        if not self.sums.exists():
            return {}
        pk, n, total, squares, arrival, last = self.sums.get()
        return {p: [a, int(t), int(q), r, at] for p, a, t, q, r, at in zip(pk, n, total, squares, arrival, last, strict=True)}

    def _keep(self, known: dict[str, list[int]]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not known:
            self.sums.clear()
            return
        n, total, squares, arrival, last = zip(*known.values(), strict=True)
        self.sums.update((list(known), list(n), list(map(str, total)), list(map(str, squares)), list(arrival), list(last)))
        self.handle.registerTimer(min(last) + self.within_ms)

    def _findings(self, sums: dict[str, list[int]], closed: bool) -> pd.DataFrame:
        cvs = []
        for n, total, squares, _, _ in sums.values():
            # n (sum of squares) - (sum)**2 is a whole number, so only the root and the quotients round
            cvs.append(math.sqrt((n * squares - total * total) / (n * (n - 1))) / (total / n) * 100 if n >= 2 and total else math.nan)
        n, _, _, arrival, last = zip(*sums.values(), strict=True)
        return pd.DataFrame({"pk": list(sums), "at": pd.to_datetime(list(last), unit="ms"), "arrival": arrival, "n_prices": n, "cv": cvs, "closed": closed})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, met = self._known(), {}
        for part in rows:
            for pk, at, price in zip(part["pk"], part["at_ms"], part["price"].astype(object), strict=True):
                if pk not in met:
                    met[pk] = known.setdefault(pk, [0, 0, 0, 0, 0])
                    met[pk][3] += 1
                sums = met[pk]
                if not pd.isna(price):
                    price = int(price)
                    sums[0], sums[1], sums[2] = sums[0] + 1, sums[1] + price, sums[2] + price * price
                sums[4] = max(sums[4], int(at))
        self._keep(known)
        yield self._findings(met, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        now = max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs())
        quiet = {pk: sums for pk, sums in known.items() if sums[4] + self.within_ms <= now}
        if quiet:
            self._keep({pk: sums for pk, sums in known.items() if pk not in quiet})
            yield self._findings(quiet, True)

    def close(self) -> None:
        pass


def audit_arrivals(stream: DataFrame, within: str = "7 days", late: str = "1 day") -> DataFrame:
    """pk, at, arrival, n_prices, cv, closed: the findings of each arrival. ``stream``: pk, at (event time), price (whole numbers)."""
    spark = stream.sparkSession
    # timers and several states of a key need this store; it is asked for where the query starts
    spark.conf.set(_PROVIDER, _ROCKS)
    within_ms = int(spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {within}) AS ms").first().ms)
    rows = stream.where("pk is not null").withWatermark("at", late).select(F.col("pk").cast("string").alias("pk"), "at", F.unix_millis("at").alias("at_ms"), F.col("price").cast("long").alias("price"))
    bucket = F.pmod(F.xxhash64("pk"), F.lit(BUCKETS)).alias("bucket")
    return rows.select("*", bucket).groupBy("bucket").transformWithStateInPandas(PriceSums(within_ms), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")


def current(findings: DataFrame, limit: float = VARIATION_LIMIT) -> DataFrame:
    """pk, n_prices, cv, closed, status: the last finding of each package."""
    last = findings.groupBy("pk").agg(F.max_by(F.struct("n_prices", "cv", "closed"), F.struct("at", "arrival", "closed")).alias("f")).select("pk", "f.*")
    cv = F.round(F.nanvl("cv", F.lit(None).cast("double")), 4)
    return last.select("pk", "n_prices", cv.alias("cv"), "closed", verdict(cv.isNotNull(), cv < limit).alias("status"))
