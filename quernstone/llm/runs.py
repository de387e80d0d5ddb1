"""Rows of equal keys in sorted partitions, with memory bounded for keys of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def runs(batches: Iterator[pd.DataFrame], keys: list[str], limit: int | None) -> Iterator[tuple[bool, pd.DataFrame, np.ndarray]]:
    """Yields (whole, rows, starts) from batches sorted by ``keys``.

    Whole: rows of complete keys of at most ``limit`` rows, of two or more rows each;
    starts has where each key begins, and the end. Otherwise: rows, in pieces, of keys
    with more rows than the limit. Keys of one row are left out.
    """
    held: pd.DataFrame | None = None
    hot: tuple | None = None

    def flush(rows: pd.DataFrame, last: bool) -> Iterator[tuple[bool, pd.DataFrame, np.ndarray]]:
        nonlocal held, hot
        named = rows[keys].to_numpy()
        cuts = np.flatnonzero((named[1:] != named[:-1]).any(1)) + 1
        starts = np.concatenate(([0], cuts, [len(rows)]))
        size = np.diff(starts)
        over = size > (limit or len(rows))
        if hot is not None and tuple(named[0]) == hot:
            over[0] = True
        held = None
        done = np.ones(len(size), bool)
        if not last:
            done[-1] = over[-1]
            hot = tuple(named[-1]) if over[-1] else None
            if not over[-1]:
                held = rows.iloc[starts[-2] :]
        of = np.repeat(np.arange(len(size)), size)
        if (deferred := (over & done)[of]).any():
            yield False, rows[deferred], np.zeros(0, int)
        whole = done & ~over & (size > 1)
        if whole.any():
            yield True, rows[whole[of]], np.concatenate(([0], np.cumsum(size[whole])))

    for batch in batches:
        if len(batch):
            yield from flush(batch if held is None else pd.concat([held, batch], ignore_index=True), False)
    if held is not None:
        yield from flush(held, True)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of 0..n-1 reaches by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            break
    return label
