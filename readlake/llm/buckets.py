"""Pairs within the buckets of sorted rows, many buckets at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal (bucket, part) of sorted rows."""
    held: list[pa.RecordBatch] = []

    def ends(batch: pa.RecordBatch) -> np.ndarray:
        bucket, part = batch["bucket"].to_numpy(), batch["part"].to_numpy()
        return np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and (held[-1]["bucket"][-1], held[-1]["part"][-1]) != (batch["bucket"][0], batch["part"][0]):
            yield pa.Table.from_batches(held)
            held = []
        cuts = ends(batch)
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def pairs_within(sizes: np.ndarray, most: int, lefts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs i < j within consecutive groups of the given sizes, at most about ``most`` at a
    time: (group, i, j). A row of a large group stands against its followers in one piece. Where
    ``lefts`` of a group is not negative, only its first so many rows stand against the others."""
    first = np.cumsum(sizes) - sizes
    row_group = np.repeat(np.arange(len(sizes)), sizes)
    after = np.repeat(first + sizes, sizes) - np.arange(sizes.sum()) - 1  # followers of each row
    follower = np.arange(sizes.sum()) + 1
    if lefts is not None:
        cross, bound = np.repeat(lefts >= 0, sizes), np.repeat(first + lefts, sizes)
        after = np.where(cross, np.where(follower <= bound, np.repeat(sizes - lefts, sizes), 0), after)
        follower = np.where(cross, bound, follower)
    total = np.cumsum(after)
    begin = 0
    while begin < len(after):
        done = total[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(total, done + most, "right")))
        n = after[begin:stop]
        i = np.repeat(np.arange(begin, stop), n)
        j = np.repeat(follower[begin:stop], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if len(i):
            yield row_group[i], i, j
        begin = stop
