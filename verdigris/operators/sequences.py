"""Sequences of events: runs of tool calls of one shape, and directed cycles of dependencies."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repeated_runs(calls: DataFrame, signature: str, threshold: int, task: str = "task_id", order: tuple[str, ...] = ("timestamp", "event_id"), event: str = "event_id") -> DataFrame:
    """A row for each run of calls of equal signature, when its length reaches ``threshold``: (task, signature, first_event, last_event).

    ``calls`` holds only the calls that count, so others between them don't break a run. Longer runs are still one row, which ends where the threshold was met.
    """
    walk = Window.partitionBy(task).orderBy(*order)
    changed = ~F.col(signature).eqNullSafe(F.lag(signature).over(walk)) | (F.row_number().over(walk) == 1)
    islands = calls.withColumn("_island", F.sum(F.when(changed, 1).otherwise(0)).over(walk.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(task, "_island").orderBy(*order)
    numbered = islands.withColumn("_at", F.row_number().over(run)).withColumn("first_event", F.first(event).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where(F.col("_at") == threshold).select(task, signature, "first_event", F.col(event).alias("last_event"))


def cycles_of(edges: Iterable[tuple[str, str]]) -> list[tuple[str, ...]]:
    """Directed cycles, one for each back edge of a depth-first walk in sorted order, rotated to begin with the least node; sorted."""
    after: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    state: dict[str, int] = {}
    found: set[tuple[str, ...]] = set()
    for root in sorted(after):
        if root in state:
            continue
        path, work = [], [(root, iter(after[root]))]
        state[root] = 1
        path.append(root)
        while work:
            node, rest = work[-1]
            nxt = next(rest, None)
            if nxt is None:
                state[node] = 2
                path.pop()
                work.pop()
            elif state.get(nxt) == 1:
                loop = path[path.index(nxt) :]
                least = loop.index(min(loop))
                found.add(tuple(loop[least:] + loop[:least]))
            elif nxt not in state:
                state[nxt] = 1
                path.append(nxt)
                work.append((nxt, iter(after[nxt])))
    return sorted(found)


def cycle_findings(edges: DataFrame, task: str = "task_id", source: str = "source_event_id", target: str = "target_event_id") -> DataFrame:
    """(task_id, cycle) for every directed cycle within a task; the graph of one task is walked in one place."""
    named = edges.select(F.col(task).cast("string").alias("task_id"), F.col(source).cast("string").alias("a"), F.col(target).cast("string").alias("b"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        loops = cycles_of(zip(rows["a"], rows["b"], strict=True))
        return pd.DataFrame({"task_id": pd.Series([rows["task_id"].iloc[0]] * len(loops), dtype=object), "cycle": pd.Series([list(x) for x in loops], dtype=object)})

    # Only tasks that can have one: a node with both an incoming and an outgoing edge.
    inner = named.join(named.select("task_id", F.col("b").alias("a")).distinct(), ["task_id", "a"], "left_semi")
    return named.join(inner.select("task_id").distinct(), "task_id", "left_semi").groupBy("task_id").applyInPandas(walk, "task_id string, cycle array<string>")
