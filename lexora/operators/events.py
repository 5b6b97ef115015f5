"""Event logs folded in batch: throttling, changes, tap suppression, gestures, navigation.

All operators take keys and an order (ts, event_id).  Sequential folds run over
stretches that a reset separates, so that an array holds a stretch of a key's
events and not its whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ORDER = ("us", "event_id")


def timed(events: DataFrame) -> DataFrame:
    """events with us, the event time in microseconds."""
    return events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def throttled(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """The events kept by a leading-edge throttle: the first, then each more than `seconds` after the last kept one.

    An event that far from the one before it is always kept, whatever was kept
    before; so the fold starts anew there.
    """
    gap = round(seconds * 1e6)
    w = W.partitionBy(key).orderBy(*ORDER)
    free = F.coalesce(F.col("us") - F.lag("us").over(w) > gap, F.lit(True))
    cut = events.withColumn("_free", free.cast("int")).withColumn("_stretch", F.sum("_free").over(w.rowsBetween(W.unboundedPreceding, 0)))
    grouped = cut.groupBy(key, "_stretch").agg(F.array_sort(F.collect_list(F.struct(*ORDER))).alias("e"))
    kept_type = "array<struct<us:bigint,event_id:bigint>>"

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)["us"]
        return F.when((F.size(a) == 0) | (x["us"] - last > gap), F.array_append(a, x)).otherwise(a)

    nothing = F.array().cast(kept_type)
    # an empty list has no last element; the first event is put in before the fold
    first = F.aggregate(F.slice("e", 2, F.size("e")), F.concat(nothing, F.slice("e", 1, 1)), step)
    return grouped.select(key, F.inline(first))


def changed(events: DataFrame, key: str, value: str) -> DataFrame:
    """Events whose value differs from the one before (null equals null); a key's first always."""
    w = W.partitionBy(key).orderBy(*ORDER)
    x = events.withColumn("_before", F.lag(F.struct(value)).over(w))
    return x.where(F.col("_before").isNull() | ~F.col(f"_before.{value}").eqNullSafe(F.col(value))).drop("_before")


def hits(events: DataFrame, key: str, hit: Column, clear: Column) -> DataFrame:
    """Events whose hit differs from the one in force; an empty hit (null or "") and a clear leave none in force and aren't given."""
    w = W.partitionBy(key).orderBy(*ORDER)
    value = F.when(~F.coalesce(clear, F.lit(False)) & (hit != ""), hit)
    x = events.withColumn("hit", value).withColumn("_is", F.col("hit").isNotNull() | clear | hit.isNull() | (hit == ""))
    x = x.where("_is").withColumn("_before", F.lag("hit").over(w))
    return x.where(F.col("hit").isNotNull() & ~F.col("hit").eqNullSafe(F.col("_before"))).drop("_is", "_before")


def last_runs(events: DataFrame, key: str, run: Column) -> DataFrame:
    """The run that each key last touched; touches without one leave it as it was."""
    return latest(events.withColumn("run", run).where("run IS NOT NULL"), key, "run")


def taps(events: DataFrame, key: str, press: Column, tap: Column, seconds: float) -> DataFrame:
    """Taps with suppressed: whether one follows the end of the last press by less than `seconds`, and no tap came between."""
    w = W.partitionBy(key).orderBy(*ORDER)
    x = events.withColumns({"_press": press, "_tap": tap}).where("_press OR _tap")
    x = x.withColumn("press_us", F.last(F.when(F.col("_press"), F.col("us")), True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    nth = F.row_number().over(W.partitionBy(key, "press_us").orderBy(*ORDER))
    x = x.where("_tap").withColumn("_nth", nth)
    near = (F.col("us") - F.col("press_us") < round(seconds * 1e6)) & (F.col("_nth") == 1)
    return x.withColumn("suppressed", F.coalesce(near, F.lit(False))).drop("_press", "_tap", "_nth")


def gestures(events: DataFrame, key: str, state: Column, hit: Column) -> DataFrame:
    """Of each gesture event (state began, changed or ended): frozen after it, the current hit, whether it emits an empty hit, and the last end's time."""
    w = W.partitionBy(key).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    x = events.withColumn("state", state).where("state IS NOT NULL").withColumn("_hit", hit)
    moves = F.col("state") != "ended"
    current = F.last(F.when(moves, F.struct("_hit")), True).over(w)
    x = x.withColumn("_current", current).withColumn("current", F.col("_current._hit"))
    ended_us = F.last(F.when(~moves, F.col("us")), True).over(w)
    return x.withColumns({"frozen": moves, "emits_empty": ~moves & F.col("current").isNull(), "ended_us": ended_us}).drop("_hit", "_current")


def single_flight(events: DataFrame, key: str, opens: Column, done: Column) -> DataFrame:
    """The open requests with accepted: the first after the start or a completion; others come while one is under way."""
    w = W.partitionBy(key).orderBy(*ORDER)
    x = events.withColumns({"_open": opens, "_done": done}).where("_open OR _done")
    x = x.withColumn("_round", F.sum(F.col("_done").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    x = x.where("_open").withColumn("accepted", F.row_number().over(W.partitionBy(key, "_round").orderBy(*ORDER)) == 1)
    return x.drop("_open", "_done", "_round")


def navigation(events: DataFrame, key: str, kind: Column, word: Column, found: Column) -> DataFrame:
    """Of each event the dictionary stack after it: depth, top and whether back is possible.

    kind: open (a found word replaces the stack, a missing one changes nothing),
    push (a found word is put on top), pop, close (empties it); others change
    nothing.  A close or a found open settles the stack whatever it was, so a
    fold reaches from one of them to the next.
    """
    w = W.partitionBy(key).orderBy(*ORDER)
    x = events.withColumns({"kind": kind, "_word": word, "_found": F.coalesce(found, F.lit(False))})
    settles = (F.col("kind") == "close") | ((F.col("kind") == "open") & F.col("_found"))
    x = x.withColumn("_part", F.sum(F.coalesce(settles, F.lit(False)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    e = F.struct("us", "event_id", "kind", F.col("_word").alias("word"), F.col("_found").alias("found"))
    grouped = x.groupBy(key, "_part").agg(F.array_sort(F.collect_list(e)).alias("e"))
    empty = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<event_id:bigint,depth:int,top:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["stack"]
        now = (
            F.when(x["kind"] == "close", F.array().cast("array<string>"))
            .when((x["kind"] == "open") & x["found"], F.array(x["word"]))
            .when((x["kind"] == "push") & x["found"], F.array_append(s, x["word"]))
            .when((x["kind"] == "pop") & (F.size(s) > 0), F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))))
            .otherwise(s)
        )
        seen = F.struct(x["event_id"].alias("event_id"), F.size(now).alias("depth"), F.get(now, F.size(now) - 1).alias("top"))
        return F.struct(now.alias("stack"), F.array_append(a["out"], seen).alias("out"))

    out = grouped.select(key, F.inline(F.aggregate("e", empty, step, lambda a: a["out"])))
    return out.withColumn("can_go_back", F.col("depth") > 1)


def reader(events: DataFrame, key: str, kind: Column, word: Column, found: Column) -> DataFrame:
    """navigation() where a tap closes an open dictionary and a move to another place clears it; chrome: whether a tap on nothing has last shown it.

    A tap while no dictionary is open toggles the chrome, which is hidden at first.
    """
    folded = F.when(kind.isin("tap", "move"), "close").otherwise(kind)
    n = navigation(events, key, folded, word, found).withColumnRenamed("event_id", "_event").withColumnRenamed(key, "_key")
    w = W.partitionBy(key).orderBy(*ORDER)
    x = events.withColumn("kind", kind).join(n, (F.col(key) == F.col("_key")) & (F.col("event_id") == F.col("_event")))
    toggles = (F.col("kind") == "tap") & (F.coalesce(F.lag("depth").over(w), F.lit(0)) == 0)
    x = x.withColumn("_toggle", F.coalesce(toggles, F.lit(False)).cast("int"))
    return x.withColumn("chrome", F.sum("_toggle").over(w.rowsBetween(W.unboundedPreceding, 0)) % 2 == 1).drop("_toggle", "_event", "_key")


def latest(events: DataFrame, key: str, value: str) -> DataFrame:
    """The last value of each key, by partial aggregation."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*ORDER)).alias(value))


def gated(events: DataFrame, key: str, mode: Column, custom: str) -> DataFrame:
    """Events other than mode changes, where the last mode before them (custom at first) is `custom`."""
    w = W.partitionBy(key).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    x = events.withColumn("_mode", mode).withColumn("_at", F.coalesce(F.last("_mode", True).over(w), F.lit(custom)))
    return x.where(F.col("_mode").isNull() & (F.col("_at") == custom)).drop("_mode", "_at")
