"""Forests of records of any depth: paths to a leaf, nested order and subtrees, and contexts along a branch.

Records have file, id and parent; an id is unique in its file (distinct_records makes it so). A
parent that is no id of the file makes a root. Jumps over ancestors double in length with every round,
so a forest of depth d takes log2 d rounds of joins, each written down once; nothing holds a path.
Nested order takes the same rounds inside a task for files of few records, many of which a task holds
at once, and by joins for files of any more.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators.scans import running_sums
from logloom.sources.shared import settle

_KEY = ["file", "id"]


def distinct_records(records: DataFrame, at: str = "at") -> DataFrame:
    """Of the records of one id the last; records without file or id are left out."""
    known = records.where(F.col("file").isNotNull() & F.col("id").isNotNull())
    rest = [c for c in records.columns if c not in _KEY]
    return known.groupBy(*_KEY).agg(F.max_by(F.struct(*rest), F.col(at)).alias("r")).select(*_KEY, *[f"r.`{c}`" for c in rest])


def _linked(records: DataFrame) -> DataFrame:
    """Columns file, id, up: the parent where it is another id of the file, else null."""
    ids = records.select("file", F.col("id").alias("up"))
    asked = records.select(*_KEY, F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("up"))
    return asked.join(ids.withColumn("is_there", F.lit(True)), ["file", "up"], "left").select(*_KEY, F.when(F.col("is_there"), F.col("up")).alias("up"))


def _above(state: DataFrame, *columns: str) -> DataFrame:
    """State of the record that each one's jump ends at, as columns above_*."""
    far = state.select("file", F.col("id").alias("up"), *[F.col(c).alias(f"above_{c}") for c in ("up", *columns) if c != "up"], F.col("up").alias("above_up"))
    return state.join(far, ["file", "up"], "left")


def paths_to(records: DataFrame, leaves: DataFrame) -> DataFrame:
    """Columns file, id, steps: the records on the way from each leaf (file, id) to its root; the leaf has steps 0.

    A file may have one leaf; one that is no record has no path. On a cycle the way ends before the
    first record that it would meet again.
    """
    jump = settle(_linked(records))
    on = settle(leaves.join(records.select(*_KEY), _KEY, "left_semi").select(*_KEY, F.lit(0).cast("bigint").alias("steps")))
    count, length = on.count(), 1
    while True:
        further = on.join(jump, _KEY).where(F.col("up").isNotNull()).select("file", F.col("up").alias("id"), (F.col("steps") + length).alias("steps"))
        on = settle(on.unionByName(further).groupBy(*_KEY).agg(F.min("steps").alias("steps")))
        now = on.count()
        if now == count:
            return on
        count, length = now, 2 * length
        jump = settle(_above(jump).select(*_KEY, F.col("above_up").alias("up")))


def last_records(records: DataFrame, at: str = "at") -> DataFrame:
    """The leaf of each file that is current: its record of the greatest `at`."""
    return records.groupBy("file").agg(F.max_by("id", at).alias("id"))


def context_entries(records: DataFrame, leaves: DataFrame) -> DataFrame:
    """Columns file, id, place: what a model sees at each leaf; `place` orders it, with gaps.

    records has, besides, compaction (boolean), first_kept (id that a compaction keeps from) and
    system (boolean). The last compaction on the path stands first; before it on the path what lies
    from its first_kept on stays, but for system records, and nothing if that is not before it on
    the path; all that follows it stays.
    """
    path = settle(paths_to(records, leaves).join(records.select(*_KEY, "compaction", "first_kept", "system"), _KEY))
    last = path.where("compaction").groupBy("file").agg(F.min_by(F.struct("id", "steps", "first_kept"), "steps").alias("c")).select("file", "c.first_kept", F.col("c.id").alias("c_id"), F.col("c.steps").alias("c_steps"))
    kept = path.select("file", F.col("id").alias("first_kept"), F.col("steps").alias("kept_steps"))
    bounds = last.join(kept, ["file", "first_kept"], "left")
    length = path.groupBy("file").agg(F.max("steps").alias("most"))
    seen = path.join(bounds.drop("first_kept"), "file", "left").join(length, "file")
    after = F.col("c_steps").isNull() | (F.col("steps") <= F.col("c_steps"))
    before = (F.col("steps") <= F.col("kept_steps")) & (F.col("kept_steps") > F.col("c_steps")) & ~F.coalesce("system", F.lit(False))
    place = F.when(F.col("id") == F.col("c_id"), 0).otherwise(F.col("most") - F.col("steps") + 1)
    return seen.where(after | F.coalesce(before, F.lit(False))).select(*_KEY, place.cast("bigint").alias("place"))


def route_at(records: DataFrame, leaves: DataFrame) -> DataFrame:
    """Columns file, provider, model, thinking: for each leaf the last that is stated on its whole path, compacted or not.

    records has, besides, provider, model and thinking, null where a record does not state them.
    """
    path = paths_to(records, leaves).join(records.select(*_KEY, "provider", "model", "thinking"), _KEY)
    nearest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("steps"))).alias(c)
    return path.groupBy("file").agg(*[nearest(c) for c in ("provider", "model", "thinking")])


def surface_after_restores(events: DataFrame) -> DataFrame:
    """Columns file, seq: what is on the surface after each file's last event.

    events has file, seq and restores: null for an event that adds to the surface, else the seq
    whose surface an undo or rewind brings back (below the first: an empty one). Restoring what an
    earlier undo has left undoes that undo. A seq that no event has, or that is not before the
    event, is taken as the nearest event before it and the event itself.
    """
    own = events.select("file", "seq", F.when(F.col("restores").isNotNull(), F.least("restores", F.col("seq") - 1)).alias("asked"))
    back = own.where(F.col("asked").isNotNull())
    # The nearest event at or before what is asked for, and the one just before: one as-of pass over both kinds of rows.
    points = events.select("file", F.col("seq").alias("at"), F.lit(0).alias("kind"), "seq", F.lit(None).cast("bigint").alias("of"))
    asked = back.select("file", F.col("asked").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("seq"), F.col("seq").alias("of"))
    so_far = Window.partitionBy("file").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = points.unionByName(asked).withColumn("near", F.last("seq", True).over(so_far)).where("kind = 1").select("file", F.col("of").alias("seq"), F.col("near").alias("restored"))
    lag = F.lag("seq").over(Window.partitionBy("file").orderBy("seq"))
    version = settle(own.withColumn("before", lag).join(found, ["file", "seq"], "left").select("file", F.col("seq").alias("id"), F.when(F.col("asked").isNull(), F.col("before")).otherwise(F.col("restored")).alias("parent"), F.col("asked").isNull().alias("adds")))
    path = paths_to(version, version.groupBy("file").agg(F.max("id").alias("id")))
    return path.join(version.where("adds"), _KEY, "left_semi").select("file", F.col("id").alias("seq"))


#: Records of a file up to which its forest is walked inside one task, beside others of about as many records in all.
IN_TASK = 100_000
_WHOLE = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.StringType)


def nested(records: DataFrame, order: list[str], in_task: int = IN_TASK) -> DataFrame:
    """Columns file, id, parent, root, depth, size, place: the walk through each file's forest, children after their parent.

    order: columns that order siblings, and the roots of a file; equal ones go by id. place: number in
    the walk, from 0; size: records at and under one, so its subtree has the places from its own on
    to size further. Records of a cycle, which no root reaches, become roots of their own. in_task:
    files of more records go by joins; the result is the same.
    """
    records = settle(records.select(*_KEY, "parent", *[c for c in order if c not in (*_KEY, "parent")]))
    if not all(isinstance(records.schema[c].dataType, _WHOLE) for c in ("id", "parent")) or records.schema["id"].dataType != records.schema["parent"].dataType:
        return _nested_by_joins(records, order)
    large = settle(records.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > in_task).select("file"))
    if large.isEmpty():
        return _nested_in_tasks(records, order, in_task)
    by_joins = _nested_by_joins(records.join(large, "file", "left_semi"), order)
    return by_joins.unionByName(_nested_in_tasks(records.join(large, "file", "left_anti"), order, in_task))


def _nested_in_tasks(records: DataFrame, order: list[str], in_task: int) -> DataFrame:
    known = records.where(F.col("file").isNotNull() & F.col("id").isNotNull())
    count = known.count()
    packs = max(1, ceil(count / in_task), min(known.sparkSession.sparkContext.defaultParallelism, count // 10_000))
    dealt = known.withColumn("_pack", F.pmod(F.xxhash64("file"), F.lit(packs)))
    # One exchange serves the numbers and the walk: siblings come in the order of their numbers.
    dealt = dealt.repartition("_pack") if packs > 1 else dealt
    numbered = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_pack", "file").orderBy(*order, "id"))).select("_pack", *_KEY, "parent", "_n")
    kind = records.schema["id"].dataType
    schema = T.StructType([T.StructField("file", records.schema["file"].dataType), T.StructField("id", kind), T.StructField("parent", kind), T.StructField("root", kind), *[T.StructField(c, T.LongType()) for c in ("depth", "size", "place")]])

    def walk(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        files, ids, parents = (group.column(c) for c in ("file", "id", "parent"))
        up, root, depth, size, place = _walk(*[c.to_pandas(types_mapper=pd.ArrowDtype) for c in (files, ids, parents)], group.column("_n").to_numpy())
        at = lambda k: pa.array(np.where(k < 0, 0, k), mask=k < 0)
        return pa.table({"file": files, "id": ids, "parent": ids.take(at(up)), "root": ids.take(at(root)), "depth": depth, "size": size, "place": place})

    return numbered.groupBy("_pack").applyInArrow(walk, schema)


def _walk(files: pd.Series, ids: pd.Series, parents: pd.Series, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """For records of whole files: number of the parent (-1: none) and of the root, depth, size and place. n orders the siblings of a file."""
    count = len(ids)
    file, _ = pd.factorize(files)
    code, _ = pd.factorize(pd.concat([ids, parents], ignore_index=True))
    own, parent = code[:count], code[count:]
    span = int(code.max(initial=0)) + 1
    key, asked = file.astype(np.int64) * span + own, file.astype(np.int64) * span + parent
    by_key = np.argsort(key)
    found = by_key[np.minimum(np.searchsorted(key[by_key], asked), count - 1)]
    up = np.where((parent >= 0) & (parent != own) & (key[found] == asked), found, -1)
    most = ceil(log2(max(2, count))) + 1

    def climb(start: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the jumps of each record end, its root, and the sum over it and all above it."""
        jump, root = start.copy(), np.where(start < 0, np.arange(count), start)
        for _ in range(most):
            live = np.flatnonzero(jump >= 0)
            if not len(live):
                break
            over = jump[live]
            more, far, next_one = sums[over], root[over], jump[over]
            sums[live] += more
            root[live] = far
            jump[live] = next_one
        return jump, root, sums

    jump, root, depth = climb(up, (up >= 0).astype(np.int64))
    if (jump >= 0).any():
        # After as many steps as there are records every jump that has not left the forest ends on a cycle, and all of one are met.
        up[np.unique(jump[jump >= 0])] = -1
        _, root, depth = climb(up, (up >= 0).astype(np.int64))
    size, jump = np.ones(count, np.int64), up.copy()
    while (jump >= 0).any():
        live = np.flatnonzero(jump >= 0)
        size += np.bincount(jump[live], size[live], count).astype(np.int64)
        jump[live] = jump[jump[live]]
    # A record comes one after its parent and after all that earlier siblings hold.
    family = np.where(up < 0, -1 - file, up)
    in_order = np.lexsort((n, family))
    held = np.cumsum(size[in_order]) - size[in_order]
    first = np.flatnonzero(np.append(True, np.diff(family[in_order]) != 0)) if count else np.zeros(0, np.int64)
    held -= np.repeat(held[first], np.diff(np.append(first, count)))
    offset = np.empty(count, np.int64)
    offset[in_order] = held
    return up, root, depth, size, climb(up, offset + (up >= 0))[2]


def _nested_by_joins(records: DataFrame, order: list[str]) -> DataFrame:
    links = settle(_linked(records))
    most = ceil(log2(max(2, links.count()))) + 1
    for _ in range(2):
        state = settle(links.select(*_KEY, "up", F.coalesce("up", "id").alias("root"), F.col("up").isNotNull().cast("bigint").alias("depth"), F.lit(1).cast("bigint").alias("size")))
        rounds = 0
        while rounds < most and not state.where(F.col("up").isNotNull()).isEmpty():
            under = state.where(F.col("up").isNotNull()).groupBy("file", F.col("up").alias("id")).agg(F.sum("size").alias("more"))
            far = _above(state, "root", "depth")
            state = settle(far.join(under, _KEY, "left").select(*_KEY, F.col("above_up").alias("up"), F.coalesce("above_root", "root").alias("root"), (F.col("depth") + F.coalesce("above_depth", F.lit(0))).alias("depth"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
            rounds += 1
        # After as many steps as there are records every jump that has not left the forest ends on a cycle, and all of one are met.
        cyclic = state.where(F.col("up").isNotNull()).select("file", F.col("up").alias("id")).distinct()
        if rounds < most or cyclic.isEmpty():
            break
        links = settle(links.join(cyclic.withColumn("cut", F.lit(True)), _KEY, "left").select(*_KEY, F.when(F.col("cut").isNull(), F.col("up")).alias("up")))
    keyed = links.withColumnRenamed("up", "parent").join(state.select(*_KEY, "root", "depth", "size"), _KEY).join(records.select(*_KEY, *[F.col(c).alias(f"by{k}") for k, c in enumerate(order)]), _KEY)
    # A record comes one after its parent and after all that earlier siblings hold.
    earlier = running_sums(keyed, ["file", "parent"], [*[f"by{k}" for k in range(len(order))], "id"], {"held": F.col("size")}, before=True)
    settled = settle(earlier.select(*_KEY, "parent", "root", "depth", "size", (F.col("held") + F.col("parent").isNotNull().cast("bigint")).alias("offset")))
    state = settled.select(*_KEY, F.col("parent").alias("up"), "offset")
    while not state.where(F.col("up").isNotNull()).isEmpty():
        state = settle(_above(state, "offset").select(*_KEY, F.col("above_up").alias("up"), (F.col("offset") + F.coalesce("above_offset", F.lit(0))).alias("offset")))
    return settled.drop("offset").join(state.select(*_KEY, F.col("offset").alias("place")), _KEY)


def family_page(walk: DataFrame, cap: int = 25) -> DataFrame:
    """Columns file, root, id, place, more: the first `cap` records of each family in the order of nested(), at any depth, and how many follow them."""
    top = walk.where(F.col("parent").isNull()).select("file", F.col("id").alias("root"), F.col("place").alias("at"), F.greatest(F.col("size") - cap, F.lit(0)).alias("more"))
    return walk.select("file", "id", "root", "place").join(top, ["file", "root"]).where(F.col("place") - F.col("at") < cap).select("file", "root", "id", (F.col("place") - F.col("at")).alias("place"), "more")
