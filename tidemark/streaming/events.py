"""Streaming forms: the same bins, de-duplication and forward monitoring over unbounded events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str, files: int | None = 1) -> DataFrame:
    """A stream of event files; event times become timestamps, as watermarks want.

    A batch has that many files, so their order in time decides what is late. With None it has all that are there: no file of a
    table is late to another.
    """
    schema = spark.read.parquet(folder).schema
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str = "1 day", late: str = "1 day", start: str | None = None) -> DataFrame:
    """begin, event_type, n, total of closed windows."""
    w = F.window("ts", width, startTime=start) if start else F.window("ts", width)
    g = stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("begin"), "event_type", "n", "total")


def weeks_to_sunday(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Weeks that begin on Monday: the epoch was a Thursday, so windows start four days later."""
    return tumbling(stream, "7 days", late, "4 days")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("until"), "n")


def first_by_minute(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """One event of each user, type and minute, within the watermark."""
    return stream.withColumn("minute", F.date_trunc("minute", "ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type", "minute"])


def forward_monitor(stream: DataFrame, floor: float = 0.0, late: str = "1 day", idle_days: int = 730) -> DataFrame:
    """unit, n, total, peak, below: a running account of each user, kept in state across batches.

    An account without events for idle_days of event time is given up, so that state is as large as the users who are active.
    """
    import pandas as pd

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        n, total, peak, seen = state.get if state.exists else (0, 0.0, float("-inf"), 0)
        for b in batches:
            n, total, peak = n + len(b), total + float(b["value"].sum()), max(peak, float(b["value"].max()))
            seen = max(seen, int(b["ts"].max().timestamp() * 1000))
        state.update((n, total, peak, seen))
        state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + idle_days * 86_400_000)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "peak": [peak], "below": [total / n < floor]})

    return stream.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double, peak double, below boolean", "n long, total double, peak double, seen long", "update", "EventTimeTimeout")


def run_once(stream: DataFrame, at: str, mode: str = "append") -> DataFrame:
    """What the stream gives for all files that are there now: Parquet files below the folder `at`, beside the stream's checkpoint."""
    w = stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").start(f"{at}/rows")
    else:  # what changes is written anew by each batch
        q = w.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{at}/rows/batch={i}")).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


REVERSAL = "user_id long, period long, e double, peak double, peak_period long, recent double, detected boolean, reversal_period long"


def reversals(stream: DataFrame, width_ms: int, floor: float, share: float = 0.45, late: str = "1 day", idle_periods: int = 400, groups: int = 1024) -> DataFrame:
    """A row (REVERSAL) whenever a period of a user closes: its mean, the peak so far, and whether the last two periods have fallen from it.

    A period closes by an event-time timer at its end, once the watermark has passed it: rows that come late but before that
    count, later ones don't. A user of whom no period has closed for idle_periods, and none is open, is forgotten, by a timer
    too. Empty periods are none. Rows without time, user or value don't count. Means are taken to 10 digits after the point,
    so that the order in which values are added decides no tie.

    State is held by group of users, hashed from them: each call to the store goes through a socket, and with calls by user
    and period these took nearly all of the time. A group makes a few calls for each period, however many users it has. Open
    periods are a map in state, by period, so that a batch rewrites only those that it has rows of; of closed ones state
    keeps, in one value, what the rule needs of each user, so that it doesn't grow with time. A stream keeps its number of
    groups for good, as its checkpoint is by group.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    names = [x.split()[0] for x in REVERSAL.split(", ")]

    class Reversals(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.open = handle.getMapState("open", "period long", "user array<long>, total array<double>, n array<long>")
            self.past = handle.getValueState("past", "user array<long>, peak array<double>, peak_period array<long>, below array<long>, closed array<long>, last array<double>")
            self.until = handle.getValueState("until", "ms long")  # periods that end by then are closed

        def wake(self, at: int, now: int | None = None) -> None:
            """A timer at that time, unless one before it (and after now) will look after it."""
            if at < min((t for t in self.handle.listTimers() if now is None or t > now), default=at + 1):
                self.handle.registerTimer(at)

        def handleInputRows(self, key, rows, timerValues):
            until = self.until.get() or (None,)
            new = {}
            for pdf in rows:
                g = pdf.assign(period=pdf["ms"] // width_ms).groupby(["period", "user_id"], as_index=False)["value"].agg(["sum", "count"])
                for period, part in g.groupby("period"):
                    if until[0] is None or (period + 1) * width_ms > until[0]:
                        add(new.setdefault(int(period), {}), part["user_id"].tolist(), part["sum"].tolist(), part["count"].tolist())
                if sum(map(len, new.values())) >= 100_000:  # a batch may have any number of periods
                    self.keep(new)
                    new = {}
            self.keep(new)
            return iter(())

        def keep(self, new: dict) -> None:
            for period, sums in new.items():
                old = self.open.getValue((period,))
                if old is not None:
                    add(sums, *old)
                self.open.updateValue((period,), (list(sums), [x for x, _ in sums.values()], [n for _, n in sums.values()]))
            if new:
                self.wake((min(new) + 1) * width_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now, out = timerValues.getCurrentWatermarkInMs(), []
            periods = sorted(p for (p,) in self.open.keys())
            kept = self.past.get()
            past = {u: x for u, *x in zip(*kept, strict=True)} if kept else {}
            done, ahead = [p for p in periods if (p + 1) * width_ms <= now], [p for p in periods if (p + 1) * width_ms > now]
            for period in done:
                for user, total, n in zip(*self.open.getValue((period,)), strict=True):
                    e = round(total / n, 10)
                    peak, at, below, _, last = past.get(user, (None,) * 5)
                    if peak is None or e > peak:
                        peak, at, below = e, period, None
                    elif below is None and e < floor:
                        below = period
                    past[user] = (peak, at, below, period, e)
                    recent = e if last is None else (last + e) / 2
                    hit = peak >= floor and recent < floor and recent < share * peak
                    out.append((user, period, e, peak, at, recent, hit, (period if below is None else below) if hit else None))
                self.open.removeKey((period,))
                if len(out) >= 10_000:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)
            idle = {u for u, x in past.items() if (x[3] + idle_periods) * width_ms <= now}
            for period in ahead if idle else []:
                idle.difference_update(self.open.getValue((period,))[0])
            past = {u: x for u, x in past.items() if u not in idle}
            if past:
                self.past.update((list(past), *map(list, zip(*past.values(), strict=True))))
            else:
                self.past.clear()
            self.until.update((now,))
            due = [(p + 1) * width_ms for p in ahead] + [(x[3] + idle_periods) * width_ms for x in past.values()]
            due = [t for t in due if t > now]
            if due:
                self.wake(min(due), now)

        def close(self) -> None:
            """Nothing is held outside state."""

    def add(sums: dict, users: list, totals: list, counts: list) -> None:
        for user, total, n in zip(users, totals, counts, strict=True):
            old = sums.get(user, (0.0, 0))
            sums[user] = (old[0] + total, old[1] + n)

    def frame(out: list):
        return pd.DataFrame(out, columns=names).astype({"reversal_period": "Int64"})

    rows = stream.where("user_id is not null and ts is not null and value is not null").withWatermark("ts", late)
    rows = rows.select(F.pmod(F.hash("user_id"), F.lit(groups)).alias("part"), "user_id", "ts", F.col("value").cast("double").alias("value"), F.unix_millis("ts").alias("ms"))
    return rows.groupBy("part").transformWithStateInPandas(Reversals(), REVERSAL, "Append", "EventTime")


def with_rocksdb(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store, which also keeps state out of the executors' heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
