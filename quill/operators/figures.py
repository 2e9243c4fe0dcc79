"""What polygons says of a figure, in arrays: the work of a task on the figures that Spark has dealt to it.

Rows are edges or pieces: f, the figure's number, m, the member's, and e, four
columns of ends. No step looks at one figure at a time; pairs are met in slices
of PAIRS, so memory grows with the edges that are given, not with their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of rows that are looked at together.
PAIRS = 1 << 17


def codes(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row by its distinct values in rising order, the first row of each number)."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, order[new]


def slices(start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) for each place from start to stop of each row."""
    n = np.maximum(stop - start, 0)
    total = np.cumsum(n)
    first = 0
    while first < len(n):
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + PAIRS, "right")))
        own = n[first:last]
        row = np.repeat(np.arange(first, last), own)
        yield row, np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own) + start[row]
        first = last


def _rounded(v: np.ndarray) -> np.ndarray:
    """Halves away from zero, as Spark rounds."""
    whole = np.trunc(v)
    return whole + np.where(np.abs(v - whole) >= 0.5, np.sign(v), 0.0) + 0.0


def crossings(f: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge, x, y): where edges are to be cut, by ends of others on them or by others across them."""
    low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    order = np.lexsort((low[:, 0], f))
    # Behind each edge in rising x stand those that it reaches.
    n = len(f)
    asked = np.lexsort((np.repeat((0, 1), n), np.concatenate([low[order, 0], high[order, 0] + 1]), np.concatenate([f[order]] * 2)))
    reach = np.empty(n, np.int64)
    reach[asked[asked >= n] - n] = np.cumsum(asked < n)[asked >= n]
    found = []
    for row, place in slices(np.arange(1, n + 1), reach):
        i, j = order[row], order[place]
        near = (low[i, 1] <= high[j, 1] + 1) & (low[j, 1] <= high[i, 1] + 1)
        i, j = np.minimum(i[near], j[near]), np.maximum(i[near], j[near])
        turns, hits = {}, []
        for edge, other in ((i, j), (j, i)):
            ax, ay, dx, dy = e[edge, 0], e[edge, 1], e[edge, 2] - e[edge, 0], e[edge, 3] - e[edge, 1]
            for end in (0, 2):
                x, y = e[other, end] - ax, e[other, end + 1] - ay
                turn, along, square = dx * y - dy * x, x * dx + y * dy, dx * dx + dy * dy
                turns[edge is i, end] = turn
                hits.append((edge, other, end, (np.abs(turn) <= np.sqrt(square)) & (along > 0) & (along < square)))
        touching = np.logical_or.reduce([h[3] for h in hits])
        found += [(edge[h], e[other[h], end], e[other[h], end + 1]) for edge, other, end, h in hits]
        s, t = turns[False, 0], turns[False, 2]
        across = ~touching & (np.sign(s) * np.sign(t) < 0) & (np.sign(turns[True, 0]) * np.sign(turns[True, 2]) < 0)
        i, j, s, t = i[across], j[across], s[across], t[across]
        x, y = (_rounded(e[i, k] + (e[i, k + 2] - e[i, k]) * s / (s - t)) for k in (0, 1))
        found += [(i, x, y), (j, x, y)]
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0), np.empty(0))


def pieces(f: np.ndarray, m: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """(f, m, e, n): edges cut at all meetings, equal pieces of a member once, with their number."""
    edge, x, y = crossings(f, e)
    along = (x - e[edge, 0]) * (e[edge, 2] - e[edge, 0]) + (y - e[edge, 1]) * (e[edge, 3] - e[edge, 1])
    at, none = np.arange(len(f)), np.zeros(len(f))
    of, kind = np.concatenate([at, edge, at]), np.repeat((0, 1, 2), (len(f), len(edge), len(f)))
    x, y = np.concatenate([e[:, 0], x, e[:, 2]]), np.concatenate([e[:, 1], y, e[:, 3]])
    order = np.lexsort((y, x, np.concatenate([none, along, none]), kind, of))
    of, x, y = of[order], x[order], y[order]
    kept = (of[1:] == of[:-1]) & ((x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    of, p = of[1:][kept], np.stack([x[:-1], y[:-1], x[1:], y[1:]], 1)[kept]
    dx, dy = p[:, 2] - p[:, 0], p[:, 3] - p[:, 1]
    rising = np.where(np.abs(dx) >= np.abs(dy), dx > 0, dy > 0)
    p = np.where(rising[:, None], p, p[:, [2, 3, 0, 1]])
    code, first = codes(f[of], m[of], *p.T)
    return f[of][first], m[of][first], p[first], np.bincount(code, minlength=len(first))


def middles(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(axis, at, height) of the middle of each edge: it looks across its longer axis."""
    axis = np.where(np.abs(e[:, 2] - e[:, 0]) >= np.abs(e[:, 3] - e[:, 1]), 0, 1)
    x, y = (e[:, 0] + e[:, 2]) / 2, (e[:, 1] + e[:, 3]) / 2
    return axis, np.where(axis == 0, x, y), np.where(axis == 0, y, x)


def below(pf: np.ndarray, axis: np.ndarray, at: np.ndarray, height: np.ndarray, f: np.ndarray, m: np.ndarray, e: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(point, member, c): how many edges of each member lie below each point; own: the edge that does not count for a point, by its ends."""
    found = []
    for a in (0, 1):
        ua, va, ub, vb = e[:, [a, 1 - a, 2 + a, 3 - a]].T
        some, points = np.flatnonzero(ua != ub), np.flatnonzero(axis == a)
        if not len(some) or not len(points):
            continue
        lo, hi = np.minimum(ua, ub)[some], np.maximum(ua, ub)[some]
        figures, of = np.unique(f[some], return_inverse=True)
        n, corner, end = np.bincount(of), np.full(len(figures), np.inf), np.full(len(figures), -np.inf)
        np.minimum.at(corner, of, lo)
        np.maximum.at(end, of, hi)
        # Bands as wide as an edge in the mean: an edge stands in about two.
        width = np.maximum(np.maximum(np.bincount(of, hi - lo), end - corner) / n, 1.0)
        bands = ((end - corner) // width).astype(np.int64) + 1
        base = np.cumsum(bands) - bands
        band = lambda k, v: ((v - corner[k]) // width[k]).astype(np.int64)  # noqa: B023, E731
        first, last = band(of, lo), band(of, hi)
        spans = last - first + 1
        edge = np.repeat(np.arange(len(some)), spans)
        key = base[of][edge] + first[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(spans) - spans, spans)
        order = np.lexsort((m[some][edge], key))
        key, edge = key[order], edge[order]
        # Points outside the edges of their figure have none below.
        k = np.minimum(np.searchsorted(figures, pf[points]), len(figures) - 1)
        inside = (figures[k] == pf[points]) & (at[points] >= corner[k]) & (at[points] < end[k])
        points, k = points[inside], k[inside]
        asked = base[k] + band(k, at[points])
        for row, place in slices(np.searchsorted(key, asked, "left"), np.searchsorted(key, asked, "right")):
            p, j = points[row], edge[place]
            met = (lo[j] <= at[p]) & (at[p] < hi[j])
            p, j = p[met], some[j[met]]
            met = va[j] + (vb[j] - va[j]) * (at[p] - ua[j]) / (ub[j] - ua[j]) < height[p]
            if own is not None:
                met &= (own[p] != e[j]).any(1)
            p, j = p[met], j[met]
            # Edges of a band are sorted by member.
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1]) | (m[j][1:] != m[j][:-1])
            starts = np.flatnonzero(new)
            found.append((p[starts], m[j][starts], np.diff(np.append(starts, len(p)))))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def sides(f: np.ndarray, m: np.ndarray, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(f, e) of different pieces, and (piece, member, below, above): the members that cover a side of each."""
    odd = n % 2 == 1
    f, m, e = f[odd], m[odd], e[odd]
    of, first = codes(f, *e.T)
    pf, pe = f[first], e[first]
    point, member, c = below(pf, *middles(pe), f, m, e, pe)
    point, member = np.concatenate([point, of]), np.concatenate([member, m])
    code, one = codes(point, member)
    own = np.bincount(code, np.repeat((0, 1), (len(c), len(of))), len(one)).astype(np.int64)
    under = np.bincount(code, np.concatenate([c, np.zeros(len(of), np.int64)]), len(one)).astype(np.int64)
    low, high = under % 2 == 1, (under + own) % 2 == 1
    some = low | high
    return pf, pe, point[one][some], member[one][some], low[some], high[some]


def outline(f: np.ndarray, m: np.ndarray, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(f, e): the edges between what some member of pieces covers and what none does, with the covered side on the left."""
    pf, pe, point, _, low, high = sides(f, m, e, n)
    low, high = np.bincount(point, low, len(pf)) > 0, np.bincount(point, high, len(pf)) > 0
    flat = np.abs(pe[:, 2] - pe[:, 0]) >= np.abs(pe[:, 3] - pe[:, 1])
    ahead, kept = np.where(flat, high, low), low != high
    return pf[kept], np.where(ahead[:, None], pe, pe[:, [2, 3, 0, 1]])[kept]


def rings(f: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The ring of each edge of outlines, as polygons.rings has it; -1 for an edge on a way that ends."""
    n = len(f)
    leaves = np.concatenate([np.arange(n), np.full(n, -1)])
    comes = np.concatenate([np.full(n, -1), np.arange(n)])
    x, y = np.concatenate([e[:, 0], e[:, 2]]), np.concatenate([e[:, 1], e[:, 3]])
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    angle = np.concatenate([np.arctan2(dy, dx), np.arctan2(-dy, -dx)])
    corner, _ = codes(np.concatenate([f, f]), x, y)
    order = np.lexsort((comes, angle, corner))
    corner, leaves, comes = corner[order], leaves[order], comes[order]
    # The last edge that leaves before a row; without one, the last of its corner.
    at = np.maximum.accumulate(np.where(leaves >= 0, np.arange(2 * n), -1))
    end = np.searchsorted(corner, corner, "right") - 1
    place = np.where((at >= 0) & (corner[at] == corner), at, at[end])
    place = np.where((place >= 0) & (corner[place] == corner), place, -1)
    ahead = np.full(n + 1, n)
    into = comes >= 0
    ahead[comes[into]] = np.where(place[into] >= 0, leaves[place[into]], n)
    # The number n stands for nowhere.
    ring, longest = np.arange(n + 1), int(np.bincount(f).max()) if n else 0
    for _ in range(max(longest, 1).bit_length()):
        ring, ahead = np.minimum(ring, ring[ahead]), ahead[ahead]
    return np.where(ahead[:n] < n, ring[:n], -1)


def parts(f: np.ndarray, e: np.ndarray, ring: np.ndarray, unit: float) -> tuple[np.ndarray, ...]:
    """(f, ring, part, area): each ring's signed area, holes below zero, and the outer ring that it belongs to; -1 without one."""
    of, first = codes(ring)
    rf, name = f[first], ring[first]
    ax, ay, bx, by = e.T / unit
    area = np.bincount(of, ax * by - bx * ay, len(first)) / 2
    outer = area > 0
    part = np.where(outer, name, -1)
    order = np.lexsort((*e.T[::-1], of))
    one = e[order[np.searchsorted(of[order], np.arange(len(first)))]]
    holes, around = np.flatnonzero(~outer), outer[of]
    point, member, c = below(rf[holes], *middles(one[holes]), f[around], ring[around], e[around])
    point, member = point[c % 2 == 1], member[c % 2 == 1]
    size = area[np.searchsorted(name, member)]
    order = np.lexsort((member, size, point))
    hole, least = np.unique(point[order], return_index=True)
    part[holes[hole]] = member[order][least]
    return rf, name, part, area


def largest(f: np.ndarray, m: np.ndarray, e: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """(f, e): the edges of each figure's largest part, as polygons.largest_part has it."""
    f, m, e, n = pieces(f, m, e)
    loose = np.isin(f, f[n % 2 == 0])
    f, e = outline(f[~loose], m[~loose], e[~loose], n[~loose])
    ring = rings(f, e)
    f, e, ring = f[ring >= 0], e[ring >= 0], ring[ring >= 0]
    rf, name, part, area = parts(f, e, ring, unit)
    some = part >= 0
    rf, name, part, area = rf[some], name[some], part[some], area[some]
    group, at = codes(part)
    total = np.round(-np.bincount(group, area, len(at)), 6)
    # Of near equals the first by its leftmost edge; the edge of a part is that of its outer ring.
    order = np.lexsort((*e.T[::-1], ring))
    least = e[order[np.searchsorted(ring[order], part[at])]]
    order = np.lexsort((part[at], *least.T[::-1], total, rf[at]))
    _, best = np.unique(rf[at][order], return_index=True)
    kept = np.isin(ring, name[np.isin(part, part[at][order][best])])
    return f[kept], e[kept]


def against(f: np.ndarray, m: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The figures in which member 1 covers what member 0 does not."""
    pf, _, point, member, low, high = sides(*pieces(f, m, e))
    cover = lambda k, side: np.bincount(point[member == k], side[member == k], len(pf)) > 0
    return np.unique(pf[(cover(1, low) & ~cover(0, low)) | (cover(1, high) & ~cover(0, high))])
