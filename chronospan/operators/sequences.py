"""Operators whose next step depends on the last one: greedy merging, change episodes, box tracks, slowdowns, in-order packing.

The first four stream the rows of a recording in order through a small state; packing is solved by pointer doubling.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import stored
from . import search
from .matching import greedy, overlap  # noqa: F401

Rows = Iterator[tuple]


def streamed(rows: DataFrame, order: list[str], step: Callable[[Rows], Iterable[tuple]], schema: str, most: int = 4096) -> DataFrame:
    """step over each recording's rows (without rec) in order, as they arrive; what it yields comes back behind rec."""
    wanted = StructType.fromDDL(f"rec {rows.schema['rec'].dataType.simpleString()}, {schema}")
    arrow = to_arrow_schema(wanted)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (r for batch in it for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held: list[tuple] = []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
        ahead = next(flat, None)
        while ahead is not None:
            rec = ahead[0]

            def own() -> Rows:
                nonlocal ahead
                while ahead is not None and ahead[0] == rec:  # noqa: B023
                    yield ahead[1:]
                    ahead = next(flat, None)

            source = own()
            for out in step(source):
                held.append((rec, *out))
                if len(held) >= most:
                    yield batch_of()
                    held = []
            deque(source, maxlen=0)
        if held:
            yield batch_of()

    columns = ["rec", *(c for c in rows.columns if c != "rec")]
    ordered = rows.filter("rec is not null").select(*columns).repartition("rec").sortWithinPartitions("rec", *order)
    return ordered.mapInArrow(run, wanted)


class Groups:
    """Result groups of one recording, in the order of their best member, found by the time cells that their spans touch."""

    def __init__(self, gap: int, most: int, grow: int):
        self.gap, self.most, self.grow, self.cell = gap, most, grow, max(most + gap, 1)
        self.spans: list[list[int]] = []
        self.cells: dict[int, list[int]] = {}

    def put(self, group: int, start: int, end: int) -> None:
        for c in range(start // self.cell, end // self.cell + 1):
            near = self.cells.setdefault(c, [])
            if group not in near[-1:]:
                near.append(group)

    def join(self, rank: int, start: int, end: int) -> int:
        """The first group that takes the result, else a new one."""
        near = {g for c in range((start - self.gap) // self.cell, (end + self.gap) // self.cell + 1) for g in self.cells.get(c, ())}
        for g in sorted(near):
            a, b = self.spans[g]
            if start > b + self.gap or end < a - self.gap:
                continue
            if rank >= self.grow:  # a weak result never widens what is shown
                if start < b and end > a:
                    return g
            elif max(b, end) - min(a, start) <= self.most:
                self.spans[g] = [min(a, start), max(b, end)]
                self.put(g, *self.spans[g])
                return g
        self.spans.append([start, end])
        self.put(len(self.spans) - 1, start, end)
        return len(self.spans) - 1


def merged_results(ranked: DataFrame, gap: int, most: int, grow: int) -> DataFrame:
    """ranked (rec, id, start, end, rank from 1) folded in rank order: rec, id, leader, start, end, n, merged_id, group_rank.

    A result joins the best-ranked group of its recording whose span lies within `gap`, if the span stays within `most`; from rank
    `grow` + 1 on only if it overlaps, and without widening. Every result comes back, with its group's final span; merged_id covers the
    sorted member ids, null for a group of one.
    """

    def fold(rows: Rows) -> Iterator[tuple]:
        groups, leaders = Groups(gap, most, grow), []
        for rank, i, start, end in rows:
            g = groups.join(rank - 1, start, end)
            if g == len(leaders):
                leaders.append((i, rank))
            yield i, *leaders[g], None, None
        for (i, rank), (start, end) in zip(leaders, groups.spans, strict=True):
            yield None, i, rank, start, end

    id_type = ranked.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, leader {id_type}, leader_rank bigint, start bigint, end bigint"
    both = stored(streamed(ranked.select("rec", "rank", "id", "start", "end"), ["rank"], fold, schema))
    members = both.filter("id is not null")
    digest = F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(F.col("id").cast("string"))), "|"), 256), 1, 16)
    per = members.groupBy("rec", "leader").agg(F.count("*").alias("n"), digest.alias("merged_id"))
    spans = both.filter("id is null").select("rec", "leader", F.col("leader_rank").alias("lr"), "start", "end").join(per, ["rec", "leader"])
    spans = search.numbered(spans, [F.col("lr")]).withColumnRenamed("rank", "group_rank").withColumn("merged_id", F.when(F.col("n") > 1, F.col("merged_id")))
    return members.select("rec", "id", "leader").join(spans.drop("lr"), ["rec", "leader"]).select("rec", "id", "leader", "start", "end", "n", "merged_id", "group_rank")


def _ahead(rows: Rows, within: int) -> Iterator[tuple]:
    """(place, t, y, low, high) of each sample; low and high: (y, t, place) of the first least and first greatest later sample within reach."""
    low: deque[tuple] = deque()  # later samples, each smaller than all behind it
    high: deque[tuple] = deque()
    waiting: deque[tuple] = deque()

    def close() -> tuple:
        n, t, y = waiting.popleft()
        for queue in (low, high):
            while queue and queue[0][2] <= n:
                queue.popleft()
        return n, t, y, low[0] if low else None, high[0] if high else None

    for n, (t, _, y) in enumerate(rows):
        while waiting and waiting[0][1] + within < t:
            yield close()
        if y is not None:
            while low and low[-1][0] > y:
                low.pop()
            low.append((y, t, n))
            while high and high[-1][0] < y:
                high.pop()
            high.append((y, t, n))
        waiting.append((n, t, y))
    while waiting:
        yield close()


def change_episodes(series: DataFrame, amount: float, within: int, direction: str | None = None, relative: bool = False, floor: float = 0.25) -> DataFrame:
    """(rec, start, end, value): episodes in which y falls or rises by `amount` within a time, grouped greedily.

    A sample qualifies if its largest fall (DOWN), rise (UP) or the larger of both (falls first) to a later sample within reach is at least
    `amount`, relative to |y| where asked, which then must reach `floor` times the recording's largest |y|. A group goes on over
    qualifying neighbours up to the latest extreme met so far. It starts at its highest sample (UP: lowest; no direction: largest change),
    ends at that one's extreme, and the search goes on behind both. NaN counts as null; ties: the first sample.
    """

    def episodes(rows: Rows) -> Iterator[tuple]:
        own, least = _ahead(((t, s, y) for t, s, y, top in keep(rows)), within), 0.0
        resume = reach = -1
        best: tuple | None = None  # of the open group: (key, t, change, extreme's t, extreme's place)
        last = -1
        for n, t, y, low, high in own:
            least = floor * tops[0] if relative else 0.0
            change = None
            if y is not None and low is not None and high is not None and not (relative and (abs(y) < least or y == 0)):
                down, up = y - low[0], high[0] - y
                found = (down, low) if direction == "DOWN" or (direction is None and down >= up) else (up, high)
                size = found[0] / abs(y) if relative else found[0]
                if size >= amount:
                    change = (size, found[1])
            if best is not None:
                if change is not None and n <= reach:
                    reach = max(reach, change[1][2])
                    last = n
                    key = {"DOWN": y, "UP": -y}.get(direction or "", change[0])
                    if key > best[0]:
                        best = (key, t, change[0], change[1][1], change[1][2])
                    continue
                yield best[1], best[3], best[2]
                resume, best = max(last + 1, best[4]), None
            if change is not None and n >= resume:
                key = {"DOWN": y, "UP": -y}.get(direction or "", change[0])
                best, reach, last = (key, t, change[0], change[1][1], change[1][2]), change[1][2], n
        if best is not None:
            yield best[1], best[3], best[2]

    tops: list[float] = [0.0]

    def keep(rows: Rows) -> Rows:
        for t, s, y, top in rows:
            tops[0] = top or 0.0
            yield t, s, y, top

    if relative:
        top = series.groupBy("rec").agg(F.max(F.abs("y")).alias("top"))
        rows = series.select("rec", "t", "seq", "y").join(top, "rec")
    else:
        rows = series.select("rec", "t", "seq", "y", F.lit(0.0).alias("top"))
    return streamed(rows.select("rec", "t", "seq", "y", "top"), ["t", "seq"], episodes, "start bigint, end bigint, value double")


def box_tracks(boxes: DataFrame, most_miss: int = 3, least: float = 0.3, confirm: int = 3) -> DataFrame:
    """(rec, track, first, last, n, confirmed) of boxes (rec, t, nr, x0, y0, x1, y1), nr ordering the boxes of a frame.

    Frame by frame the pair of open track and box with the best overlap is taken, until none reaches `least`; other boxes open tracks,
    numbered in order. A track that misses more than most_miss frames in a row is closed. confirmed: when it had `confirm` boxes. A row
    with a null corner is no box, but its frame counts. Only the open tracks, one frame and a bounded number of their pairs are held.
    """

    def frames(rows: Rows) -> Iterator[tuple[int, np.ndarray]]:
        now, held = None, []
        for t, _, *box in rows:
            if t != now and now is not None:
                yield now, np.array(held, float).reshape(-1, 4)
                held = []
            now = t
            if None not in box:
                held.append(box)
        if now is not None:
            yield now, np.array(held, float).reshape(-1, 4)

    def follow(rows: Rows) -> Iterator[tuple]:
        box, live = np.empty((0, 4)), np.empty((0, 6), np.int64)  # of open tracks: track, first, last, n, frames missed, when confirmed
        sure = np.zeros(0, bool)
        n_tracks = 0

        def closed(lines: np.ndarray, confirmed: np.ndarray) -> Iterator[tuple]:
            for (track, first, last, n, _, at), known in zip(lines.tolist(), confirmed.tolist(), strict=True):
                yield track, first, last, n, at if known else None

        for t, found in frames(rows):
            pairs = np.array(greedy(box, found, least), np.int64).reshape(-1, 2)
            i, b = pairs[:, 0], pairs[:, 1]
            live[:, 4] += 1
            box[i], live[i, 2], live[i, 4] = found[b], t, 0
            live[i, 3] += 1
            now = i[live[i, 3] == confirm]
            live[now, 5], sure[now] = t, True
            gone = live[:, 4] > most_miss
            yield from closed(live[gone], sure[gone])
            new = np.ones(len(found), bool)
            new[b] = False
            n = int(new.sum())
            fresh = np.tile(np.array([0, t, t, 1, 0, t], np.int64), (n, 1))
            fresh[:, 0] = n_tracks + np.arange(n)
            n_tracks += n
            box, live, sure = np.r_[box[~gone], found[new]], np.r_[live[~gone], fresh], np.r_[sure[~gone], np.full(n, confirm == 1)]
        yield from closed(live, sure)

    rows = boxes.select("rec", "t", "nr", "x0", "y0", "x1", "y1")
    return streamed(rows, ["t", "nr"], follow, "track bigint, first bigint, last bigint, n bigint, confirmed bigint")


def slowdowns(grid: DataFrame, onset: int, span: int, loss: float, least_base: float, recover: float | None, horizon: int, lead: int, tail: int, nearest: int, pad: int) -> DataFrame:
    """(rec, onset, low, recovery, base, loss, start, end): distinct slowdowns of grid (rec, t, y, base) by their lowest point.

    From each onset (a multiple of `onset`, lead after the first and tail before the last sample) whose base is at least least_base y must
    lose `loss` of it within `span`; with `recover` it must reach that share of the base within `horizon` of the lowest point. Slowdowns
    whose lowest points round to one multiple of `nearest` are one, with the earliest onset.
    """

    def events(rows: Rows) -> Iterator[tuple]:
        held: deque[tuple] = deque()
        first = last = None
        asked: deque[tuple] = deque()

        def settle(t: int, base: float) -> tuple | None:
            while held and held[0][0] < t:
                held.popleft()
            if last <= t + tail or t < first + lead:
                return None
            inside = [(y, u) for u, y in held if u <= t + span]
            if len(inside) < 2:
                return None
            low, at = min(inside)
            if 1 - low / base < loss:
                return None
            back = None
            if recover is not None:
                back = next((u for u, y in held if at <= u <= at + horizon and y >= recover * base), None)
                if back is None:
                    return None
            return t, at, back, base, 1 - low / base, t - pad, (back or at) + pad

        for t, y, base in rows:
            first = t if first is None else first
            last = t
            held.append((t, y))
            if t % onset == 0 and base is not None and base >= least_base:
                asked.append((t, base))
            while asked and asked[0][0] + max(span + horizon, tail) < t:
                if (out := settle(*asked.popleft())) is not None:
                    yield out
            while held[0][0] < (asked[0][0] if asked else t):
                held.popleft()
        while asked:
            if (out := settle(*asked.popleft())) is not None:
                yield out

    schema = "onset bigint, low bigint, recovery bigint, base double, loss double, start bigint, end bigint"
    found = streamed(grid.select("rec", "t", "y", "base"), ["t"], events, schema)
    key = F.floor((F.col("low") + nearest // 2) / F.lit(nearest))
    one = found.groupBy("rec", key.alias("key")).agg(F.min(F.struct(*(c for c in found.columns if c != "rec"))).alias("m"))
    return one.select("rec", "m.*")


def maneuvers(
    grid: DataFrame, onset: int, lengths: list[int], lead: int, tail: int, least_base: float,
    loss: tuple[float | None, float | None] = (None, None), excursion: tuple[float | None, float | None] = (None, None), net: float | None = None,
) -> DataFrame:
    """(rec, start, end, base, loss, excursion, net) of grid (rec, t, y, base, h): windows of each length from each onset, as of slowdowns, whose
    loss of y against the base and swing of h lie in [from, to) and whose h ends at least `net` from where it began.

    Windows end within the recording and hold two samples at least. The longest window is held.
    """

    def inside(x: float, bounds: tuple[float | None, float | None]) -> bool:
        return (bounds[0] is None or x >= bounds[0]) and (bounds[1] is None or x < bounds[1])

    def windows(rows: Rows) -> Iterator[tuple]:
        held: deque[tuple] = deque()
        asked: deque[tuple] = deque()
        first = last = 0

        def measure(t: int, base: float) -> Iterator[tuple]:
            while held and held[0][0] < t:
                held.popleft()
            if last <= t + tail or t < first + lead:
                return
            for n in lengths:
                if t + n > last:
                    return
                own = [(y, h) for u, y, h in held if u <= t + n]
                if len(own) < 2:
                    continue
                lost, turns = 1 - min(y for y, _ in own) / base, [h for _, h in own]
                swing, turned = max(turns) - min(turns), turns[-1] - turns[0]
                if inside(lost, loss) and inside(swing, excursion) and (net is None or abs(turned) >= net):
                    yield t, t + n, base, lost, swing, turned

        started = False
        for t, y, base, h in rows:
            first, started, last = (first, True, t) if started else (t, True, t)
            held.append((t, y, h))
            if t % onset == 0 and base is not None and base >= least_base:
                asked.append((t, base))
            while asked and asked[0][0] + max(*lengths, tail) < t:
                yield from measure(*asked.popleft())
            while held[0][0] < (asked[0][0] if asked else t):
                held.popleft()
        while asked:
            yield from measure(*asked.popleft())

    schema = "start bigint, end bigint, base double, loss double, excursion double, net double"
    return streamed(grid.select("rec", "t", "y", "base", "h"), ["t"], windows, schema)


def chunks(intervals: DataFrame, size: int, overlap_by: int) -> DataFrame:
    """Intervals (rec, start, end) in the fewest equal parts of at most `size`; each but the first begins overlap_by earlier: (rec, start, end, nr)."""
    n = F.greatest(F.ceil((F.col("end") - F.col("start")) / F.lit(size)), F.lit(1))
    cut = intervals.withColumn("n", n).withColumn("nr", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    part = (F.col("end") - F.col("start")) / F.col("n")
    begin = F.greatest(F.lit(0), F.floor(F.col("start") + F.col("nr") * part + F.lit(0.5)) - F.when(F.col("nr") > 0, overlap_by).otherwise(0))
    return cut.select("rec", begin.cast("long").alias("start"), F.floor(F.col("start") + (F.col("nr") + 1) * part + F.lit(0.5)).cast("long").alias("end"), "nr")


def running(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """rows with `rank` from 1 and `upto`, the sum of `value` (a long) up to the row, both in the given order: sums of ranges first."""
    columns = [F.col(c) for c in order]
    spread = stored(rows.repartitionByRange(*columns).withColumn("run_part", F.spark_partition_id()))
    before = Window.orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1)
    per = spread.groupBy("run_part").agg(F.count("*").alias("c"), F.sum(value).alias("s"))  # a row per range
    per = per.select("run_part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"))
    own = Window.partitionBy("run_part").orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0)
    out = spread.withColumn("rank", F.count("*").over(own)).withColumn("upto", F.sum(value).over(own)).join(F.broadcast(per), "run_part")
    return out.withColumn("rank", F.col("rank") + F.col("c0")).withColumn("upto", F.col("upto") + F.col("s0")).drop("run_part", "c0", "s0")


def packed_in_order(items: DataFrame, order: list[str], size: str, most: int) -> DataFrame:
    """items with `job` from 1: jobs take items in order until the next one would exceed `most`; an item over `most` has a job alone.
    Sizes are positive, and the order has no ties.

    An item's successor is the first one that a job beginning at it leaves over. Successors are found by sorting job limits and item ends
    within cells of width `most`; doubling them marks every job's first item in as many rounds as the number of jobs has bits.
    """
    # An item over `most` counts as most + 1: alone in its job either way, and every successor lies in the limit's cell or the one after.
    width = F.least(F.col(size).cast("long"), F.lit(most + 1))
    lines = stored(running(items.withColumn("pack_width", width), order, "pack_width"))
    limit = F.greatest(F.col("upto") - F.col("pack_width") + most, F.col("upto"))
    limits = lines.select(limit.alias("x"), F.lit(0).alias("kind"), F.col("rank").alias("i"), F.lit(None).cast("long").alias("found"))
    ends = lines.select(F.col("upto").alias("x"), F.lit(-1).alias("kind"), F.lit(None).cast("long").alias("i"), F.col("rank").alias("found"))
    cell = F.floor(F.col("x") / F.lit(most))
    behind = Window.partitionBy("cell").orderBy("x", "kind", "found").rowsBetween(0, Window.unboundedFollowing)
    both = limits.union(ends).withColumn("cell", cell).withColumn("next", F.first("found", ignorenulls=True).over(behind)).filter("kind = 0").select("i", "cell", "next")
    firsts = ends.groupBy(cell.alias("cell")).agg(F.min("found").alias("next_first"))
    after = both.join(firsts.withColumn("cell", F.col("cell") - 1), "cell", "left").join(firsts.select((F.col("cell") - 2).alias("cell"), F.col("next_first").alias("second")), "cell", "left")
    jump = stored(after.select("i", F.coalesce("next", "next_first", "second").alias("to")).filter("to is not null"))
    one_step = jump
    reached = stored(lines.filter("rank = 1").select(F.col("rank").alias("i"), F.lit(1).cast("long").alias("job")))
    step, n = 1, 0
    while (now := reached.count()) > n:
        n = now
        ahead = reached.join(jump, "i").select(F.col("to").alias("i"), (F.col("job") + step).alias("job"))
        reached = stored(reached.union(ahead))
        jump = stored(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.i")).select(F.col("a.i").alias("i"), F.col("b.to").alias("to")))
        step *= 2
    total = lines.agg(F.max("rank").alias("total"))  # one row
    spans = reached.join(one_step, "i", "left").join(F.broadcast(total)).select("job", F.explode(F.sequence("i", F.coalesce(F.col("to") - 1, "total"))).alias("rank"))
    return lines.join(spans, "rank").drop("rank", "upto", "pack_width")
