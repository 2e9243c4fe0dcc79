"""SVG path data in plain Python: a parser, a writer, and measures of a path. Used inside Arrow functions.

A segment is (kind, points): L, Q and C with two to four complex points, and A
with (start, radius, rotation, large, sweep, end).
"""

from __future__ import annotations

import cmath
import math
import decimal
import re
from functools import lru_cache
from itertools import compress, groupby

import numpy as np

_COMMAND = re.compile(r"[MmZzLlHhVvCcSsQqTtAa]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
#: Fixed value: what counts as a number when path data is rounded.
_NUMBER = re.compile(r"-?\d+\.?\d*")
_ARGS = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
_JUNK = re.compile(r"[^\s,MmZzLlHhVvCcSsQqTtAa0-9eE.+-]")


class BadPath(ValueError):
    """Path data that does not follow the grammar."""


def _tokens(d: str) -> list[str]:
    if _JUNK.search(d):
        raise BadPath(d[:40])
    out: list[str] = []
    command = ""
    at = 0
    while m := _COMMAND.search(d, at):
        if m[0].isalpha():
            command, at = m[0].upper(), m.end()
            out.append(m[0])
            n = 0
            continue
        # The two flags of an arc may stand without blanks.
        if command == "A" and n % 7 in (3, 4) and m[0][0] in "01":
            out.append(m[0][0])
            at = m.start() + 1
        else:
            out.append(m[0])
            at = m.end()
        n += 1
    return out


def parse(d: str) -> list[tuple]:
    """Segments of path data, in absolute coordinates; closing a subpath is a line."""
    tokens = _tokens(d)
    out: list[tuple] = []
    at = first = 0j
    last_control: complex | None = None
    i, command = 0, ""
    while i < len(tokens):
        if tokens[i].isalpha():
            command = tokens[i]
            i += 1
        elif not command or command in "Zz":
            raise BadPath(d[:40])
        kind, relative = command.upper(), command.islower()
        n = _ARGS[kind]
        try:
            v = [float(t) for t in tokens[i : i + n]]
        except ValueError as e:
            raise BadPath(d[:40]) from e
        if len(v) < n:
            raise BadPath(d[:40])
        i += n
        base = at if relative else 0j
        point = lambda k: base + complex(v[k], v[k + 1])  # noqa: B023, E731
        control = None
        if kind == "M":
            at = first = point(0)
            command = "l" if relative else "L"
        elif kind == "Z":
            if at != first:
                out.append(("L", (at, first)))
            at = first
        elif kind in "LHV":
            end = point(0) if kind == "L" else complex(v[0] + base.real, at.imag) if kind == "H" else complex(at.real, v[0] + base.imag)
            out.append(("L", (at, end)))
            at = end
        elif kind in "CS":
            smooth = out and out[-1][0] == "C" and last_control is not None
            a = point(0) if kind == "C" else 2 * at - last_control if smooth else at
            b, end = (point(2), point(4)) if kind == "C" else (point(0), point(2))
            out.append(("C", (at, a, b, end)))
            at, control = end, b
        elif kind in "QT":
            smooth = out and out[-1][0] == "Q" and last_control is not None
            a = point(0) if kind == "Q" else 2 * at - last_control if smooth else at
            end = point(2) if kind == "Q" else point(0)
            out.append(("Q", (at, a, end)))
            at, control = end, a
        else:
            end = point(5)
            out.append(("A", (at, complex(abs(v[0]), abs(v[1])), v[2], v[3] != 0, v[4] != 0, end)))
            at = end
        last_control = control
    return out


def _arc(points: tuple) -> tuple[complex, complex, complex, float, float] | None:
    """Centre, radii, unit vector of the rotation, first angle and sweep of an arc; None for a straight one."""
    start, radius, rotation, large, sweep, end = points
    rx, ry = radius.real, radius.imag
    if rx == 0 or ry == 0 or start == end:
        return None
    turn = cmath.exp(1j * math.radians(rotation))
    half = (start - end) / 2 / turn
    x, y = half.real, half.imag
    scale = (x / rx) ** 2 + (y / ry) ** 2
    if scale > 1:
        rx, ry = rx * math.sqrt(scale), ry * math.sqrt(scale)
    rest = max(0.0, 1 / max(scale, 1) - 1 if scale > 1 else (rx * ry) ** 2 / ((rx * y) ** 2 + (ry * x) ** 2) - 1)
    factor = math.sqrt(rest) * (-1 if large == sweep else 1)
    local = complex(factor * rx * y / ry, -factor * ry * x / rx)
    centre = local * turn + (start + end) / 2
    a = cmath.phase(complex((x - local.real) / rx, (y - local.imag) / ry))
    b = cmath.phase(complex((-x - local.real) / rx, (-y - local.imag) / ry))
    delta = (b - a) % (2 * math.pi)
    return centre, complex(rx, ry), turn, a, delta if sweep else delta - 2 * math.pi


def point(segment: tuple, t: float) -> complex:
    kind, p = segment
    if kind == "A":
        arc = _arc(p)
        if arc is None:
            return p[0] + (p[5] - p[0]) * t
        centre, radius, turn, a, delta = arc
        angle = a + delta * t
        return centre + turn * complex(radius.real * math.cos(angle), radius.imag * math.sin(angle))
    s = 1 - t
    if kind == "L":
        return s * p[0] + t * p[1]
    if kind == "Q":
        return s * s * p[0] + 2 * s * t * p[1] + t * t * p[2]
    return s**3 * p[0] + 3 * s * s * t * p[1] + 3 * s * t * t * p[2] + t**3 * p[3]


def end_points(segment: tuple) -> tuple[complex, complex]:
    return segment[1][0], segment[1][-1]


def length(segment: tuple, error: float = 1e-6) -> float:
    kind, p = segment
    if kind == "L" or (kind == "A" and _arc(p) is None):
        a, b = end_points(segment)
        return abs(b - a)

    def between(t0, t1, a, b, depth):
        middle = (t0 + t1) / 2
        m = point(segment, middle)
        straight, bent = abs(b - a), abs(m - a) + abs(b - m)
        if depth > 4 and bent - straight <= error or depth > 16:
            return bent
        return between(t0, middle, a, m, depth + 1) + between(middle, t1, m, b, depth + 1)

    return between(0.0, 1.0, point(segment, 0), point(segment, 1), 0)


def _turning_points(segment: tuple) -> list[float]:
    """Places inside a segment where x or y may be extreme."""
    kind, p = segment
    out: list[float] = []
    if kind == "A" and (arc := _arc(p)):
        _, radius, turn, a, delta = arc
        phi = cmath.phase(turn)
        for angle in (math.atan2(-radius.imag * math.sin(phi), radius.real * math.cos(phi)), math.atan2(radius.imag * math.cos(phi), radius.real * math.sin(phi))):
            for k in range(-4, 5):
                out.append((angle + k * math.pi - a) / delta if delta else -1.0)
    for part in ("real", "imag"):
        if kind == "Q":
            a, b, c = (getattr(z, part) for z in p)
            if (bend := a - 2 * b + c) != 0:
                out.append((a - b) / bend)
        elif kind == "C":
            a, b, c, d = (getattr(z, part) for z in p)
            q2, q1, q0 = -a + 3 * b - 3 * c + d, 2 * (a - 2 * b + c), b - a
            if abs(q2) < 1e-12:
                if q1:
                    out.append(-q0 / q1)
            elif (disc := q1 * q1 - 4 * q2 * q0) >= 0:
                out += [(-q1 + s * math.sqrt(disc)) / (2 * q2) for s in (1, -1)]
    return [t for t in out if 0 < t < 1]


def bounds(segments: list[tuple]) -> tuple[float, float, float, float]:
    """(xmin, ymin, xmax, ymax), exact for every kind of segment; zeros for an empty path."""
    points = [q for s in segments for q in (*end_points(s), *(point(s, t) for t in _turning_points(s)))]
    if not points:
        return 0.0, 0.0, 0.0, 0.0
    xs, ys = [q.real for q in points], [q.imag for q in points]
    return min(xs), min(ys), max(xs), max(ys)


def curve_ratio(segments: list[tuple]) -> float:
    return sum(kind != "L" for kind, _ in segments) / len(segments) if segments else 0.0


def ring(segments: list[tuple], samples: int = 64) -> list[tuple[float, float]] | None:
    """Points at equal shares of the path's length; None with fewer than three of them.

    Samples that repeat the point before are left out. A ring that crosses itself is given as it is.
    """
    return rings([segments], samples)[0]


def rings(paths: list[list[tuple]], samples: int = 64) -> list[list[tuple[float, float]] | None]:
    """ring of many paths; those of as many segments are sampled together."""
    out: list = [None] * len(paths)
    by_size: dict[int, list[int]] = {}
    lengths = [[length(s) for s in segments] for segments in paths]
    for at, own in enumerate(lengths):
        if sum(own) >= 1e-6:
            by_size.setdefault(len(own), []).append(at)
    for some in by_size.values():
        segment, share = _places(np.array([lengths[at] for at in some]), np.array([sum(lengths[at]) for at in some]), samples)
        a, b = (np.take_along_axis(np.array([[end_points(s)[k] for s in paths[at]] for at in some]), segment, 1) for k in (0, 1))
        x, y = ((1 - share) * a.real + share * b.real).tolist(), ((1 - share) * a.imag + share * b.imag).tolist()
        for i, at in enumerate(some):
            found = zip(x[i], y[i])
            if any(kind != "L" for kind, _ in paths[at]):
                found = ((q.real, q.imag) for q in (point(paths[at][k], t) for k, t in zip(segment[i].tolist(), share[i].tolist())))
            points = [q for q, _ in groupby(found)]
            out[at] = points if len(set(points)) > 2 else None
    return out


def _places(lengths: np.ndarray, total: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, share of it) of each sample of paths with equally many segments, lengths: (path, segment)."""
    goal = total[:, None] * np.arange(samples) / samples
    at, left = np.zeros(goal.shape, np.int64), np.ones(goal.shape, bool)
    for k in range(lengths.shape[1] - 1):
        own = lengths[:, k, None]
        left &= (goal > own) | (own == 0)
        if not left.any():
            break
        goal = np.where(left, goal - own, goal)
        at += left
    whole = np.take_along_axis(lengths, at, 1)
    return at, np.where(whole > 0, np.clip(goal / np.where(whole > 0, whole, 1.0), 0.0, 1.0), 0.0)


def _text(z: complex) -> str:
    return f"{z.real},{z.imag}"


def write(segments: list[tuple]) -> str:
    """Path data of segments, absolute; where one does not start at the end before, a new subpath starts."""
    out, at = [], None
    for kind, p in segments:
        if at is None or p[0] != at:
            out.append(f"M {_text(p[0])}")
        if kind == "A":
            out.append(f"A {_text(p[1])} {p[2]} {int(p[3])},{int(p[4])} {_text(p[5])}")
        else:
            out.append(f"{kind} {' '.join(map(_text, p[1:]))}")
        at = p[-1]
    return " ".join(out)


#: Digits that the largest double needs, and its smallest fraction.
_EXACT = decimal.Context(prec=1200, rounding=decimal.ROUND_HALF_EVEN)


@lru_cache(maxsize=50_000)
def _rounded(number: str, precision: int) -> str:
    near = _EXACT.quantize(decimal.Decimal(float(number)), decimal.Decimal((0, (1,), -precision)))
    return f"{near.normalize(_EXACT):f}" if precision > 0 else str(int(near))


def round_numbers(d: str, precision: int) -> str:
    """Every run of digits with an optional sign and point, rounded half to even on its exact value, without trailing zeros."""
    return _NUMBER.sub(lambda found: _rounded(found[0], precision), d)


def simplified(d: str, precision: int, tolerance: float, enabled: bool = True, remove_degenerate: bool = True) -> str:
    """Without segments shorter than the tolerance (all kept if not remove_degenerate), and rounded; d itself if nothing would be left or it is no path."""
    if not enabled:
        return round_numbers(d, precision)
    try:
        segments = parse(d)
    except BadPath:
        return d
    kept = [s for s in segments if not remove_degenerate or length(s) >= tolerance]
    return round_numbers(write(kept), precision) if kept else d


def measures(d: str) -> tuple[tuple[float, float, float, float], int, float]:
    """(bounds, number of segments, share of curves) from one parse; zeros for what is no path."""
    try:
        segments = parse(d)
    except BadPath:
        return (0.0, 0.0, 0.0, 0.0), 0, 0.0
    return bounds(segments), len(segments), curve_ratio(segments)


# ---- rings -------------------------------------------------------------------


def is_simple(points: list[tuple[float, float]], step: float = 1e-6) -> bool:
    """Whether a ring surely neither crosses nor touches itself, nor turns back on itself, by steps of `step`."""
    return are_simple([points], step)[0]


#: Pairs of edges whose boxes are compared together.
PAIRS = 1 << 17


def are_simple(rings: list[list[tuple[float, float]]], step: float = 1e-6) -> list[bool]:
    """is_simple of many rings; those of as many points are looked at together."""
    out, by_size = [False] * len(rings), {}
    for at, points in enumerate(rings):
        by_size.setdefault(len(points), []).append(at)
    for n, own in by_size.items():
        for first in range(0, len(own) if n > 2 else 0, max(1, PAIRS // (n * n))):
            some = own[first : first + max(1, PAIRS // (n * n))]
            for at, simple in zip(some, _simple(np.round(np.array([rings[k] for k in some]) / step)).tolist()):
                out[at] = simple
    return out


def _simple(p: np.ndarray) -> np.ndarray:
    """are_simple of rings of equally many points, p: (ring, point, 2)."""
    q, n = np.roll(p, -1, axis=1), p.shape[1]
    way = q - p
    # Boxes first, of edges that are no neighbours: most are apart.
    near = np.triu(np.ones((n, n), bool), 2)
    near[0, n - 1] = False
    for k in range(2):
        low, high = np.minimum(p[..., k], q[..., k]), np.maximum(p[..., k], q[..., k]) + 1
        near = near & (low[:, :, None] <= high[:, None]) & (low[:, None] <= high[:, :, None])
    # Of a flat array the places are found much faster than of one with axes.
    at = np.flatnonzero(near)
    ring, i, j = at // (n * n), at // n % n, at % n
    reach = np.hypot(way[..., 0], way[..., 1])

    def across(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether edge b has no end clear of edge a's line, or one on each side."""
        turn = lambda v: way[ring, a, 0] * (v[ring, b, 1] - p[ring, a, 1]) - way[ring, a, 1] * (v[ring, b, 0] - p[ring, a, 0])
        from_, to = (np.where(np.abs(t) <= reach[ring, a], 0, t) for t in (turn(p), turn(q)))
        return np.sign(from_) * np.sign(to) <= 0

    after = np.roll(way, -1, axis=1)
    back = (np.abs(way[..., 0] * after[..., 1] - way[..., 1] * after[..., 0]) <= reach) & ((way * after).sum(-1) <= 0)
    out = ~back.any(1)
    out[ring[across(i, j) & across(j, i)]] = False
    return out


def corners(points: list[tuple[float, float]], unit: float = 1e6) -> list[tuple[float, float]]:
    """A ring without the points that lie, in whole steps of 1 / unit, on the straight way from the point before to the next."""
    return all_corners([points], unit)[0]


def all_corners(rings: list[list[tuple[float, float]]], unit: float = 1e6) -> list[list[tuple[float, float]]]:
    """corners of many rings; those of as many points are looked at together."""
    out, by_size = list(rings), {}
    for at, points in enumerate(rings):
        by_size.setdefault(len(points), []).append(at)
    for some in by_size.values():
        p = np.array([rings[at] for at in some]) * unit
        whole = np.trunc(p)
        p = whole + np.where(np.abs(p - whole) >= 0.5, np.sign(p), 0.0)
        into = p - np.roll(p, 1, axis=1)
        # Products of longer ways are not exact.
        exact = (np.isfinite(p) & (np.abs(p) < 2**52) & (np.abs(into) < 2**31)).all((1, 2))
        into = np.where(exact[:, None, None], into, 0.0).astype(np.int64)
        way = np.roll(into, -1, axis=1)
        straight = (into[..., 0] * way[..., 1] == into[..., 1] * way[..., 0]) & ((into * way).sum(-1) > 0)
        for at, kept in zip(some, (~straight).tolist()):
            out[at] = list(compress(rings[at], kept))
    return out
