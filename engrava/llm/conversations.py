"""Conversations from message rows: sorted by range, summarised in segments, joined at the seams."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from engrava.functions.instants import blank
from engrava.storage import materialize

SPEAKERS = ("user", "assistant", "system")
_NO_TIME = -(2**63)


def speaker_of(role: Column, kind: Column) -> Column:
    """The role, or the row's type where that is blank; trimmed and lower-cased."""
    return F.lower(F.regexp_replace(F.when(~blank(role), role).otherwise(F.coalesce(kind, F.lit(""))), r"^\s+|\s+$", ""))


def _numbered(batches, partition_of):
    """Sorted rows with their place in the run of their session inside this partition, the time since the row before, and
    who spoke last before (of the run: 1 the user, 2 the assistant, 0 nobody yet)."""
    me, session, n, before, said = partition_of(), None, 0, _NO_TIME, 0
    for b in batches:
        m = b.num_rows
        if not m:
            continue
        s, ts, who = b.column(0), pc.fill_null(b.column(1), _NO_TIME).to_numpy(), b.column(4).to_numpy().astype(np.int64)
        at, new = np.arange(m), np.ones(m, bool)
        new[1:] = pc.not_equal(s.slice(1), s.slice(0, m - 1)).to_numpy(zero_copy_only=False)
        new[0] = session is None or s[0].as_py() != session
        start = np.maximum.accumulate(np.where(new, at, -1))  # -1 in a run that goes on from the batch before
        place = np.where(start >= 0, at - start + 1, at + 1 + n)
        last_ts = np.concatenate([[before], ts[:-1]])
        known = ~new & (ts != _NO_TIME) & (last_ts != _NO_TIME)
        spoke = np.maximum.accumulate(np.where(who > 0, at, -1))
        of = np.concatenate([[-1], spoke[:-1]])
        after = np.where((of >= 0) & (of >= start), who[of], np.where(start < 0, said, 0))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(m, me, np.int32)), pa.array(place), pa.array(np.where(known, ts - np.where(known, last_ts, 0), 0), mask=~known), pa.array(after.astype(np.int8))], names=[*b.schema.names, "segment", "place", "gap", "after"])
        said = int(who[spoke[-1]]) if spoke[-1] >= 0 and spoke[-1] >= start[-1] else said if start[-1] < 0 else 0
        session, n, before = s[-1].as_py(), int(place[-1]), ts[-1]


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


class Conversations:
    """Message rows of sessions as ordered conversations.

    rows has session, row (BIGINT, order of arrival, unique), ts (TIMESTAMP or null where unusable), speaker, spoken
    (BOOLEAN: has a text that isn't blank), uses and answers (ARRAY<STRING>: ids of tool calls made and answered). Rows
    with a blank session belong to no conversation. Equal times keep the order of arrival; rows without a usable time
    come first. Repeated rows are turns of their own: remove deliveries before.

    A session may be a third of all rows: rows are sorted by ranges of (session, time, row), and sessionized there: a
    session is split into parts where it rests longer than is usual here - longer than three standard deviations above
    the mean of log(gap), over all gaps of all sessions. Each part is summed up (who spoke first and last, whether a
    user spoke twice running), parts to one summary per session and range, and these - at most one per session and
    range - are folded in order.
    """

    def __init__(self, rows: DataFrame):
        self.rows = materialize(rows.where(~blank(F.col("session"))).select("session", "row", F.unix_micros("ts").alias("ts"), "speaker", "spoken", "uses", "answers"), "turns")

    @functools.cached_property
    def placed(self) -> DataFrame:
        """(session, ts, row, speaker, who, segment, place, gap, after): sorted rows, numbered within each range."""
        who = F.when(~F.coalesce("spoken", F.lit(False)), 0).when(F.col("speaker") == "user", 1).when(F.col("speaker") == "assistant", 2).otherwise(0).cast("byte").alias("who")
        rows = self.rows.select("session", "ts", "row", "speaker", who).repartitionByRange("session", "ts", "row").sortWithinPartitions("session", "ts", "row")
        return materialize(rows.mapInArrow(lambda it: _numbered(it, _partition), "session string, ts long, row long, speaker string, who byte, segment int, place long, gap long, after byte"), "placed")

    @functools.cached_property
    def rest(self) -> float:
        """The gap, in microseconds, beyond which a session rests."""
        ends = self.placed.groupBy("session", "segment").agg(F.min("ts").alias("from"), F.max("ts").alias("to"))
        over = ends.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("segment", "from", "to"))).alias("s")).where(F.size("s") > 1)  # a struct a range
        seams = over.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.get("s", i)["from"] - F.get("s", i - 1)["to"])).alias("gap"))
        gaps = self.placed.select("gap").union(seams).where("gap > 0")
        return gaps.agg(F.exp(F.avg(F.log("gap")) + 3 * F.coalesce(F.stddev_pop(F.log("gap")), F.lit(0.0)))).first()[0] or float("inf")

    def _rested(self) -> DataFrame:
        """placed with ``rests``: the number of rests so far in the session and range."""
        w = W.partitionBy("session", "segment").orderBy("place")
        return self.placed.withColumn("rests", F.sum(F.when(F.col("gap") > self.rest, 1).otherwise(0)).over(w))

    def parts(self) -> DataFrame:
        """(session, segment, rests, n, from, to, first, last, twice, users, assistants): each part of each session, as far
        as it lies in one range: who spoke first and last, and whether the user spoke twice running up to here."""
        spoken = F.when(F.col("who") > 0, F.col("place"))
        return self._rested().groupBy("session", "segment", "rests").agg(
            F.count("*").alias("n"), F.min("ts").alias("from"), F.max("ts").alias("to"), F.min_by("who", spoken).alias("first"), F.max_by("who", spoken).alias("last"),
            F.bool_or((F.col("who") == 1) & (F.col("after") == 1)).alias("twice"), F.count_if(F.col("who") == 1).alias("users"), F.count_if(F.col("who") == 2).alias("assistants"),
        )

    def _seams(self) -> DataFrame:
        """(session, s): a summary for each range that a session lies in, in order."""
        seen = lambda c: F.when(F.col(c).isNotNull(), F.col("rests"))
        each = self.parts().groupBy("session", "segment").agg(
            F.sum("n").alias("n"), F.min("from").alias("from"), F.max("to").alias("to"), F.max("rests").alias("rests"), F.min_by("first", seen("first")).alias("first"),
            F.max_by("last", seen("last")).alias("last"), F.bool_or("twice").alias("twice"), F.sum("users").alias("users"), F.sum("assistants").alias("assistants"),
        )
        return each.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("segment", "n", "from", "to", "rests", "first", "last", "twice", "users", "assistants"))).alias("s"))

    def faults(self) -> DataFrame:
        """(session, fault): why sessions are dropped, one row per session and fault.

        unusable - a row has no usable time, or a speaker that is not user, assistant or system;
        one-sided - no spoken turn of the user, or none of the assistant;
        unanswered - a spoken user turn is not followed by a spoken assistant turn before the next, or the end;
        tools - a tool call is not answered by a later row, or an answer has no earlier call (nor an id).
        """
        unusable = self.rows.groupBy("session").agg(F.bool_or(F.col("ts").isNull() | ~F.coalesce(F.col("speaker"), F.lit("")).isin(*SPEAKERS)).alias("bad")).where("bad").select("session", F.lit("unusable").alias("fault"))
        fold = F.aggregate(
            "s",
            F.struct(F.lit(None).cast("byte").alias("last"), F.lit(False).alias("twice"), F.lit(0).cast("long").alias("users"), F.lit(0).cast("long").alias("assistants")),
            lambda acc, x: F.struct(
                F.coalesce(x["last"], acc["last"]).alias("last"),
                (acc["twice"] | x["twice"] | F.coalesce((acc["last"] == 1) & (x["first"] == 1), F.lit(False))).alias("twice"),
                (acc["users"] + x["users"]).alias("users"),
                (acc["assistants"] + x["assistants"]).alias("assistants"),
            ),
        )
        folded = self._seams().select("session", fold.alias("f"))
        unanswered = folded.where("f.twice OR coalesce(f.last = 1, FALSE)").select("session", F.lit("unanswered"))
        one_sided = folded.where("f.users = 0 OR f.assistants = 0").select("session", F.lit("one-sided"))
        at = F.struct(F.col("ts").alias("t"), F.col("row").alias("r")).alias("at")
        calls = self.rows.select("session", F.explode("uses").alias("tool"), at, F.lit(True).alias("call")).where("tool is not null")
        replies = self.rows.select("session", F.explode("answers").alias("tool"), at, F.lit(False).alias("call"))
        when = lambda f, c: f(F.when(F.col("call") == c, F.col("at")))
        t = calls.union(replies).groupBy("session", "tool").agg(when(F.max, True).alias("last_call"), when(F.min, True).alias("first_call"), when(F.max, False).alias("last_reply"), when(F.min, False).alias("first_reply"))
        fine = F.col("tool").isNotNull() & F.coalesce((F.col("last_reply") > F.col("last_call")) & (F.col("first_call") < F.col("first_reply")), F.lit(False))
        tools = t.where(~fine).select("session", F.lit("tools").alias("fault")).distinct()
        return unusable.union(one_sided).union(unanswered).union(tools)

    def inferred(self) -> DataFrame:
        """(session, row, speaker): who it must be that speaks in a row whose speaker is unknown but which has a text,
        where the spoken turns before and after it are of one speaker: the other one. Other rows have no row here."""
        odd = self.rows.where(F.coalesce("spoken", F.lit(False)) & ~F.coalesce("speaker", F.lit("")).isin(*SPEAKERS)).select("session", "row")
        mine = self.placed.join(odd.select("session").distinct(), "session", "left_semi")
        back = W.partitionBy("session", "segment").orderBy(F.desc("place")).rowsBetween(W.unboundedPreceding, -1)
        rows = mine.withColumn("next", F.last(F.when(F.col("who") > 0, F.col("who")), ignorenulls=True).over(back)).join(odd, ["session", "row"], "left_semi")
        # beyond the range: the last who spoke in the ranges before it, the first in those after it
        ends = self._seams().join(odd.select("session").distinct(), "session", "left_semi").select("session", "s", F.explode(F.transform("s", lambda x: x["segment"])).alias("segment"))
        said = lambda side, keep: F.transform(F.filter("s", lambda x: keep(x["segment"]) & x[side].isNotNull()), lambda x: x[side])
        ends = ends.select("session", "segment", F.try_element_at(said("last", lambda x: x < F.col("segment")), F.lit(-1)).alias("far_before"), F.try_element_at(said("first", lambda x: x > F.col("segment")), F.lit(1)).alias("far_after"))
        x, y = F.coalesce(F.when(F.col("after") > 0, F.col("after")), F.col("far_before")), F.coalesce("next", "far_after")
        return rows.join(ends, ["session", "segment"]).where(x == y).select("session", "row", F.when(x == 1, "assistant").otherwise("user").alias("speaker"))

    def turns(self) -> DataFrame:
        """(session, turn, part, row, speaker): the turns of the sessions that are kept, numbered from 1 in order, and the
        part of the session that each is in."""
        limit = self.rest
        bad = self.faults().select("session").distinct()
        over = self._seams().where(F.size("s") > 1)  # sessions that go over a range's edge: no more than there are ranges
        each = over.select("session", F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.struct(F.slice(F.array_sort("s"), 1, i).alias("upto")))).alias("x")).select("session", "x.upto")
        total = lambda a, f: F.aggregate(a, F.lit(0).cast("long"), lambda acc, y: acc + y[f])
        before = F.slice("upto", 1, F.size("upto") - 1)
        last = F.element_at("upto", -1)
        breaks = F.size(F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("upto"))), lambda i: (i <= F.size("upto")) & (F.element_at("upto", i)["from"] - F.element_at("upto", i - 1)["to"] > limit)))
        offsets = each.select("session", last["segment"].alias("segment"), total(before, "n").alias("plus"), (total(before, "rests") + breaks).alias("plus_parts"))
        numbered = self._rested().join(bad, "session", "left_anti").join(F.broadcast(offsets), ["session", "segment"], "left")
        return numbered.select("session", (F.col("place") + F.coalesce("plus", F.lit(0))).alias("turn"), (F.col("rests") + F.coalesce("plus_parts", F.lit(0)) + 1).cast("int").alias("part"), "row", "speaker")
