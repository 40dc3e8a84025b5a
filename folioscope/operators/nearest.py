"""The nearest span to the right, left, top and bottom of each span.

Spans go by document to one task each, sorted, and a task compares them in numpy: small documents
pair by pair, longer ones within the corridor or, if that holds fewer spans, within a window along the
direction looked in. A window is as good as the
whole document once it holds a span nearer than anything beyond it can be; only spans without such a
neighbour look through a wider window. Documents of more spans than a task should hold are left to
the caller (see ``spans.neighbours``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Slack of a corridor, in points.
TOLERANCE = 5.0
DIRECTIONS = ("right", "left", "top", "bottom")
#: Spans up to which all pairs of a document are compared at once.
PAIR_ALL = 64
#: First window, and how much wider each next one is.
WINDOW, WIDER = 256.0, 8.0
#: Pairs compared at a time.
PAIRS = 2_000_000


def _ranges(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, member) of the ranges lo..hi, in chunks of about PAIRS members."""
    sizes = hi - lo
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        n = sizes[at:to]
        which = np.repeat(np.arange(at, to), n)
        yield which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:to], n)
        at = to


def _between(sorted_: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = np.searchsorted(sorted_, least, side="left"), np.searchsorted(sorted_, most, side="right")
    return lo, np.maximum(lo, hi)


class _Side:
    """Spans of whole documents seen along one axis: u across the direction, v along it."""

    def __init__(self, u0, u1, v0, v1, idx):
        self.u0, self.u1, self.v0, self.v1, self.idx = u0, u1, v0, v1, idx

    def look(self, mine: np.ndarray, lo: np.ndarray, hi: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest row (-1: none) and squared distance of the rows ``mine``, on the far and on the near
        side, among order[lo:hi] of each."""
        best, dist = np.full((2, len(mine)), -1, np.int64), np.full((2, len(mine)), np.inf)
        for which, member in _ranges(lo, hi):
            a, b = mine[which], order[member]
            inside = (self.u0[b] >= self.u0[a] - TOLERANCE) & (self.u1[b] <= self.u1[a] + TOLERANCE) & (self.idx[a] != self.idx[b])
            which, a, b = which[inside], a[inside], b[inside]
            du = (self.u0[b] + self.u1[b]) / 2 - (self.u0[a] + self.u1[a]) / 2
            dv = (self.v0[b] + self.v1[b]) / 2 - (self.v0[a] + self.v1[a]) / 2
            d2 = du * du + dv * dv
            for side, beyond in enumerate((self.v0[b] >= self.v1[a], self.v1[b] <= self.v0[a])):
                w, bb, dd = which[beyond], b[beyond], d2[beyond]
                first = np.lexsort((self.idx[bb], dd, w))
                w, bb, dd = w[first], bb[first], dd[first]
                lead = np.ones(len(w), bool)
                lead[1:] = w[1:] != w[:-1]
                best[side, w[lead]], dist[side, w[lead]] = bb[lead], dd[lead]
        return best, dist

    def nearest(self, starts: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.idx)
        best, dist = np.full((2, n), -1, np.int64), np.full((2, n), np.inf)
        small = np.repeat(sizes <= PAIR_ALL, sizes)
        at, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        mine = np.nonzero(small & wanted)[0]
        best[:, mine], dist[:, mine] = self.look(mine, at[mine], at[mine] + size[mine], np.arange(n))
        for s, k in zip(starts[sizes > PAIR_ALL].tolist(), sizes[sizes > PAIR_ALL].tolist()):
            rows = np.arange(s, s + k)
            by_v, by_u = rows[np.argsort(self.v0[rows], kind="stable")], rows[np.argsort(self.u0[rows], kind="stable")]
            # spans upside down may reach farther than their first edge tells
            slack = max(0.0, float(np.nanmax(self.v0[rows] - self.v1[rows], initial=0.0)))
            slack_u = max(0.0, float(np.nanmax(self.u0[rows] - self.u1[rows], initial=0.0))) + TOLERANCE
            mine, width = rows[wanted[rows]], WINDOW
            lo_u, hi_u = _between(self.u0[by_u], self.u0[mine] - TOLERANCE, self.u1[mine] + slack_u)
            while len(mine):
                lo, hi = _between(self.v0[by_v], self.v0[mine] - width - slack, self.v1[mine] + width + slack)
                # the whole corridor where it holds fewer spans than the window
                whole = hi_u - lo_u <= hi - lo
                for which, at, to, order in ((whole, lo_u, hi_u, by_u), (~whole, lo, hi, by_v)):
                    best[:, mine[which]], dist[:, mine[which]] = self.look(mine[which], at[which], to[which], order)
                # beyond the window nothing is nearer than half its width
                left = ~(whole | (np.sqrt(dist[:, mine].max(axis=0)) <= width / 2) | ((lo == 0) & (hi == k)))
                mine, lo_u, hi_u, width = mine[left], lo_u[left], hi_u[left], width * WIDER
        return best, dist


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of ``batches``, sorted by their first column, in tables of whole documents."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0)
        if held and held[-1].column(0)[-1] == key[0] and key[0] == key[-1]:
            held.append(batch)
            continue
        # the last document of the batch may go on in the next one
        last = key[-1]
        cut = batch.num_rows
        while cut and key[cut - 1] == last:
            cut -= 1
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and held[-1].column(0)[-1] != last:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def with_nearest(batches: Iterator[pa.RecordBatch], directions: tuple[str, ...], give: Callable) -> Iterator[pa.RecordBatch]:
    """Calls ``give(table, best, dist)`` for tables of whole documents whose columns begin with doc_id,
    span_idx, x0, y0, x1, y1, wanted; ``best`` and ``dist`` map directions to row numbers and distances."""
    for t in _documents(batches):
        t = t.combine_chunks()
        keys = t.column(0).combine_chunks()
        key = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
        sizes = np.diff(np.append(starts, len(key)))
        idx, x0, y0, x1, y1, wanted = (t.column(c).to_numpy() for c in range(1, 7))
        best, dist = {}, {}
        for names, side in ((("right", "left"), (y0, y1, x0, x1)), (("top", "bottom"), (x0, x1, y0, y1))):
            if set(names) & set(directions):
                b, d = _Side(*side, idx).nearest(starts, sizes, wanted)
                for k, name in enumerate(names):
                    best[name], dist[name] = b[k], np.sqrt(d[k])
        yield from give(t, best, dist)
