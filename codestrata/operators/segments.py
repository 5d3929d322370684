"""Crossing segments with whole coordinates, counted by order along grid columns and not pair by pair.

Between two neighbouring borders (whole x at which a segment begins or ends) segments that reach both cross as often as
their order changes, so a column costs its segments and the logarithm of their number, however many pairs cross. What
remains are segments that begin on others, counted by their common points, and upright ones, counted by rank. A segment
is taken as reaching a little beyond both ends, since a mere touch is a crossing; parallel segments do not cross.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows worked on at once, if no single cell has more.
CHUNK_ROWS = 1 << 17
#: Coordinates as seen from a cell stay below this, so that no product leaves 64 bits.
FARTHEST = 1 << 30
#: Below this one float tells two different heights or slopes apart.
NEAR = 1 << 16


def _ratio(num: np.ndarray, den: np.ndarray, near: bool) -> tuple[np.ndarray, ...]:
    """Sort keys of exact fractions, the least first: equal fractions have equal keys, others keys in their order."""
    if near:
        return (num / den,)
    whole, rest = np.divmod(num, den)
    high, rest = np.divmod(rest << 26, den)
    return rest / den, high, whole


def _starts(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where rows with new keys begin in ``order``."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    return np.flatnonzero(new)


def _inversions(ranks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Pairs out of order in each group: ``ranks`` holds 0 to n - 1 of every group, group after group.

    Rows are dealt by one bit of their rank after the other, the highest first; a pair out of order is met at the bit
    in which its ranks first differ.
    """
    n = len(ranks)
    sizes = np.diff(np.append(starts, n))
    base = np.repeat(starts, sizes).astype(np.int32)
    place = np.arange(n, dtype=np.int32)
    found = np.zeros(len(starts), np.int64)
    now = ranks.astype(np.int32)
    for bit in reversed(range(int(sizes.max() - 1).bit_length())):
        one = (now >> bit) & 1
        ones = np.cumsum(one, dtype=np.int32) - one
        block = base + ((now >> (bit + 1)) << (bit + 1))
        ones -= ones[block]
        zero = one == 0
        found += np.add.reduceat(np.where(zero, ones, 0), starts, dtype=np.int64)
        dealt = np.empty_like(now)
        dealt[np.where(zero, place - ones, block + (1 << bit) + ones)] = now
        now = dealt
    return found


def _equal_pairs(n_groups: int, group: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Pairs of rows of each group with equal keys."""
    order = np.lexsort((*keys, group))
    starts = _starts(order, group, *keys)
    sizes = np.diff(np.append(starts, len(order)))
    found = np.zeros(n_groups, np.int64)
    np.add.at(found, group[order[starts]], sizes * (sizes - 1) // 2)
    return found


def crossing_pairs(group: np.ndarray, n_groups: int, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, width: int) -> np.ndarray:
    """Crossing pairs of each group, as far as they first meet at 0 <= x < ``width`` or within a border's reach of it.

    Every segment has a length, and begins at its smaller x (its smaller y, if upright). A crossing at a border belongs
    to the side before it, a touch by a segment that begins there to the side behind it.
    """
    found = np.zeros(n_groups, np.int64)
    if len(group) < 2:
        return found
    far = max(int(np.abs(v).max()) for v in (x1, y1, x2, y2))
    if far >= FARTHEST:
        raise OverflowError(f"segment reaches {far} units from its cell; products of its parts leave 64 bits")
    near = max(far, width) < NEAR
    upright = np.flatnonzero(x1 == x2)
    v_group, v_x, v_low, v_high = group[upright], x1[upright], y1[upright], y2[upright]
    # the others by slope once: where two meet, sorts that keep this order put the steeper one above
    leaning = np.flatnonzero(x1 != x2)
    slope = _ratio((y2 - y1)[leaning], (x2 - x1)[leaning], near)
    order = np.lexsort(slope)
    starts = _starts(order, *slope)
    slope_id = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    leaning = leaning[order]
    group, x1, y1, x2, y2 = (v[leaning] for v in (group, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    key = group.astype(np.uint16) if n_groups <= 1 << 16 else group
    borders = np.unique(np.clip(np.concatenate([x1, x2, v_x, [0, width]]), 0, width))
    for k, following in zip(borders[:-1], borders[1:]):
        here = np.flatnonzero((x1 <= k) & (x2 >= k))
        raised = y1[here] * dx[here] + (k - x1[here]) * dy[here]
        # segments that reach both borders: changes of order
        on = x2[here] >= following
        both = here[on]
        if len(both) > 1:
            left = np.lexsort((*_ratio(raised[on], dx[both], near), key[both]))
            right = np.lexsort((*_ratio(y1[both] * dx[both] + (following - x1[both]) * dy[both], dx[both], near), key[both]))
            rank = np.empty(len(both), np.int64)
            rank[right] = np.arange(len(both))
            starts = _starts(left, key[both])
            sizes = np.diff(np.append(starts, len(both)))
            changed = _inversions(rank[left] - np.repeat(starts, sizes), starts)
            found[group[both[left[starts]]]] += changed
        # segments that begin here on others of another slope
        begun = x1[here] == k
        if begun.any():
            whole = raised % dx[here] == 0
            point, g, y, s = here[whole], group[here[whole]], (raised // dx[here])[whole], slope_id[here[whole]]
            found += _equal_pairs(n_groups, g, y) - _equal_pairs(n_groups, g, y, s)
            old = x1[point] < k
            found -= _equal_pairs(n_groups, g[old], y[old]) - _equal_pairs(n_groups, g[old], y[old], s[old])
        # upright segments here: the others that pass between their ends
        at = np.flatnonzero(v_x == k)
        if len(at):
            g = group[here].astype(np.int64) << 32
            floors, ceilings = np.sort(g + raised // dx[here]), np.sort(g - (-raised // dx[here]))
            asked = v_group[at].astype(np.int64) << 32
            passed = np.searchsorted(ceilings, asked + v_high[at], "right") - np.searchsorted(floors, asked + v_low[at], "left")
            np.add.at(found, v_group[at], passed)
    return found


def _related(n_cells: int, cell: np.ndarray, first: np.ndarray, ends: tuple[np.ndarray, ...], width: int, rows: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Crossing pairs of each cell among ``rows`` with equal ``keys``, without those that an earlier row of cells has too."""
    at = cell[rows]
    order = np.lexsort((*keys, at))
    starts = _starts(order, at, *keys)
    sizes = np.diff(np.append(starts, len(order)))
    fresh = np.add.reduceat(first[rows[order]].astype(np.int64), starts) if len(order) else sizes
    kept = (sizes > 1) & (fresh > 0)
    inside = np.repeat(kept, sizes)
    group = np.repeat(np.cumsum(kept) - 1, sizes)[inside]
    rows = rows[order][inside]
    n = int(kept.sum())
    later = ~first[rows]
    found = crossing_pairs(group, n, *[e[rows] for e in ends], width) - crossing_pairs(group[later], n, *[e[rows[later]] for e in ends], width)
    out = np.zeros(n_cells, np.int64)
    np.add.at(out, at[order][starts[kept]], found)
    return out


def _unrelated(n_cells: int, cell: np.ndarray, first: np.ndarray, ends: tuple[np.ndarray, ...], width: int, name: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Crossing pairs of each cell that share neither a node nor a name.

    All pairs, less those at each node; pairs that have both nodes in common are taken off twice and so come back once.
    The same again among rows of one name, where a cell has several of them.
    """
    def apart(rows: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        two = a[rows] != b[rows]
        again = rows[two]
        low, high = np.minimum(a[again], b[again]), np.maximum(a[again], b[again])
        doubled = [np.concatenate([k, k[two]]) for k in keys]
        one = _related(n_cells, cell, first, ends, width, np.concatenate([rows, again]), *doubled, np.concatenate([a[rows], b[again]]))
        return (_related(n_cells, cell, first, ends, width, rows, *keys) - one
                + _related(n_cells, cell, first, ends, width, again, *[k[two] for k in keys], low, high))

    rows = np.arange(len(cell))
    order = np.lexsort((name, cell))
    starts = _starts(order, cell, name)
    sizes = np.diff(np.append(starts, len(order)))
    named = order[np.repeat(sizes > 1, sizes)]
    found = apart(rows)
    return found - apart(named, name[named]) if len(named) else found


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Whole numbers for the values of columns of one type: equal for equal values."""
    joined = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks()
    codes = joined.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _cell_starts(table: pa.Table) -> np.ndarray:
    keys = [_codes(table["map_id"])[0], table["_cx"].to_numpy(), table["_cy"].to_numpy()]
    return _starts(np.arange(table.num_rows), *keys)


def _count(table: pa.Table, starts: np.ndarray, width: int) -> pa.RecordBatch:
    """Crossings of the cells of a table, added up by map."""
    cell = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
    cx, cy = table["_cx"].to_numpy() * width, table["_cy"].to_numpy() * width
    x1, y1, x2, y2 = (table[c].to_numpy() - corner for c, corner in (("x1", cx), ("y1", cy), ("x2", cx), ("y2", cy)))
    turned = (x1 > x2) | ((x1 == x2) & (y1 > y2))
    ends = (np.where(turned, x2, x1), np.where(turned, y2, y1), np.where(turned, x1, x2), np.where(turned, y1, y2))
    (name,), (a, b) = _codes(table["seg_id"]), _codes(table["a"], table["b"])
    first = table["_first"].to_numpy()
    found = _unrelated(len(starts), cell, first, ends, width, name, a, b)
    counted = pa.table({"map_id": table["map_id"].take(pa.array(starts)), "crossings": found})
    summed = counted.group_by("map_id").aggregate([("crossings", "sum")]).select(["map_id", "crossings_sum"]).rename_columns(["map_id", "crossings"])
    return summed.combine_chunks().to_batches()


def cell_counter(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow pass over rows sorted by ``map_id, _cx, _cy``: crossings of whole cells by map, a bounded number of rows at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waits, goal = 0, CHUNK_ROWS
        for batch in batches:
            held.append(batch)
            waits += batch.num_rows
            if waits < goal:
                continue
            table = pa.Table.from_batches(held)
            starts = _cell_starts(table)
            last = int(starts[-1])  # the last cell may go on
            if last:
                yield from _count(table.slice(0, last).combine_chunks(), starts[:-1], width)
            held, waits = table.slice(last).to_batches(), waits - last
            goal = max(CHUNK_ROWS, 2 * waits)
        if waits:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from _count(table, _cell_starts(table), width)

    return run
