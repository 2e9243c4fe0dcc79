"""Planar regions as rows of edges: repair, union and containment by joins.

A region is given by straight edges with two sets of columns: `keys` name the
figure that an edge belongs to, `member` one of the regions laid over each other
in it. A member covers the points from which a ray crosses its edges an odd
number of times.

Edges are cut where they meet others of their figure; candidates meet in grid
cells. Then each piece knows, by counting pieces below it, which members cover
its two sides. Everything else is read off the sides: the outline of a union,
whether one member holds another. Pieces below are met in bands across the
figure. Figures of up to AT_ONCE edges are settled where their edges are dealt
to, many in a task (`figures`); no larger one is gathered in one place, and no
ring travels as an array.

Coordinates are whole multiples of 1 / UNIT, kept in doubles; what is closer
than one such step is taken as touching.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from . import figures

UNIT = 1e6
ENDS = ("ax", "ay", "bx", "by")
EDGE = ", ".join(f"{c} double" for c in ENDS)

#: Edges of a figure that one task settles, and edges that it takes together.
AT_ONCE = 20_000
TOGETHER = 20_000


def snapped(c: Column) -> Column:
    return F.round(c * UNIT)


def ring_edges(rows: DataFrame, keys: list[str], member: Column, ring: str = "polygon") -> DataFrame:
    """The edges of rings (arrays of points; null: none), the last point joined to the first."""
    r = rows.filter(F.size(ring) > 0).select(*keys, member.alias("member"), F.col(ring).alias("_ring"), F.posexplode(ring).alias("_i", "p"))
    q = F.col("_ring")[(F.col("_i") + 1) % F.size("_ring")]
    ends = {"ax": F.col("p.x"), "ay": F.col("p.y"), "bx": q["x"], "by": q["y"]}
    return r.select(*keys, "member", *(snapped(c).alias(name) for name, c in ends.items())).filter("ax <> bx OR ay <> by")


def _together(edges: DataFrame, keys: list[str], work: Callable[..., tuple], out: str) -> DataFrame:
    """(keys, out): what work(figures, members, ends) makes of whole figures: the figure's number, then a column for each of out."""
    member = edges.schema["member"].dataType
    own = [F.col(f"member.{c}").alias(f"_m{i}") for i, c in enumerate(member.names)] if isinstance(member, T.StructType) else [F.col("member").alias("_m0")]
    n = len(keys)

    def settled(table: pa.Table, first: np.ndarray) -> list[pa.RecordBatch]:
        f = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(table))))
        columns = [c.to_numpy() for c in table.columns[n:]]
        member, _ = figures.codes(*columns[:-4])
        of, *made = work(f, member, np.stack(columns[-4:], 1))
        named = table.select(keys).take(pa.array(first[of]))
        return pa.table([*named.columns, *made], names=names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in shared.whole_groups(batches, n, TOGETHER):
            yield from settled(table, first)

    schema = T.StructType([*(edges.schema[k] for k in keys), *(T.StructType.fromDDL(out) if out else [])])
    names = schema.names
    # By the keys in another order than joins have: what a join has dealt out would be left in as few tasks as its bytes ask for.
    return shared.dealt(edges.dropna(subset=keys).select(*keys, *own, *ENDS), *reversed(keys)).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _settled(edges: DataFrame, keys: list[str], work: Callable[..., tuple], out: str, by_joins: Callable[[DataFrame], DataFrame], at_once: int, sizes: DataFrame | None = None) -> DataFrame:
    """Figures of up to at_once edges by work, where they are dealt to; larger ones by joins. sizes: (keys, _n), as many edges as each figure has at most, if known."""
    sizes = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if sizes is None else sizes
    large = sizes.filter(F.col("_n") > at_once).select(*keys).transform(shared.stored)
    if large.isEmpty():
        return _together(edges, keys, work, out)
    return _together(edges.join(large, keys, "left_anti"), keys, work, out).unionByName(by_joins(edges.join(large, keys, "left_semi")))


def _gridded(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the figure's corner (_x, _y) and the width _s of its cells: as many to a side as the root of its edges."""
    lo, hi = (lambda k: F.min(F.least(f"a{k}", f"b{k}"))), (lambda k: F.max(F.greatest(f"a{k}", f"b{k}")))
    figures = edges.groupBy(*keys).agg(lo("x").alias("_x"), lo("y").alias("_y"), F.greatest(hi("x") - lo("x"), hi("y") - lo("y"), F.lit(1.0)).alias("_w"), F.count(F.lit(1)).alias("_n"))
    return edges.join(figures.select(*keys, "_x", "_y", (F.col("_w") / F.ceil(F.sqrt("_n"))).alias("_s")), keys)


def _celled(edges: DataFrame) -> DataFrame:
    """An edge in each grid cell that it passes, or passes within two steps of."""
    cell = lambda v, at: F.floor((v - F.col(at)) / F.col("_s")).cast("long")
    e = edges.withColumn("_l", F.least("ax", "bx")).withColumn("_r", F.greatest("ax", "bx"))
    e = e.withColumn("cx", F.explode(F.sequence(cell(F.col("_l") - 2, "_x"), cell(F.col("_r") + 2, "_x"))))
    # The part of the edge inside the column of cells.
    wall = lambda k: F.greatest("_l", F.least("_r", F.col("_x") + (F.col("cx") + k) * F.col("_s") + (4 * k - 2)))
    at = lambda x: F.col("ay") + (F.col("by") - F.col("ay")) * (x - F.col("ax")) / (F.col("bx") - F.col("ax"))
    upright = F.col("ax") == F.col("bx")
    first, last = F.when(upright, F.col("ay")).otherwise(at(wall(0))), F.when(upright, F.col("by")).otherwise(at(wall(1)))
    e = e.withColumn("_f", first).withColumn("_g", last)
    return e.withColumn("cy", F.explode(F.sequence(cell(F.least("_f", "_g") - 2, "_y"), cell(F.greatest("_f", "_g") + 2, "_y")))).drop("_l", "_r", "_f", "_g", "_x", "_y", "_s")


def _crossings(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(id, x, y): where edges are to be cut, by ends of others on them or by others across them."""
    met = _celled(_gridded(edges, keys)).drop("member")
    a = met.select(*keys, "cx", "cy", F.col("id").alias("i"), *(F.col(c).alias(f"a_{c}") for c in ENDS))
    b = met.select(*keys, "cx", "cy", F.col("id").alias("j"), *(F.col(c).alias(f"b_{c}") for c in ENDS))
    # Boxes first: most neighbours in a cell are apart.
    apart = lambda k: (F.least(f"a_a{k}", f"a_b{k}") > F.greatest(f"b_a{k}", f"b_b{k}") + 1) | (F.least(f"b_a{k}", f"b_b{k}") > F.greatest(f"a_a{k}", f"a_b{k}") + 1)
    p = a.join(b, [*keys, "cx", "cy"]).filter("i < j").filter(~apart("x") & ~apart("y"))

    def turn(edge: str, end: str) -> Column:
        """Twice the area of an edge and an end of the other: its sign is the end's side."""
        x, y = F.col(f"{end}x") - F.col(f"{edge}_ax"), F.col(f"{end}y") - F.col(f"{edge}_ay")
        return (F.col(f"{edge}_bx") - F.col(f"{edge}_ax")) * y - (F.col(f"{edge}_by") - F.col(f"{edge}_ay")) * x

    def touches(edge: str, end: str) -> Column:
        dx, dy = F.col(f"{edge}_bx") - F.col(f"{edge}_ax"), F.col(f"{edge}_by") - F.col(f"{edge}_ay")
        along = (F.col(f"{end}x") - F.col(f"{edge}_ax")) * dx + (F.col(f"{end}y") - F.col(f"{edge}_ay")) * dy
        return (F.abs(turn(edge, end)) <= F.sqrt(dx * dx + dy * dy)) & (along > 0) & (along < dx * dx + dy * dy)

    cut = lambda i, x, y: F.struct(F.col(i).alias("id"), x.alias("x"), y.alias("y"))
    ends = [("i", "a", "b_a"), ("i", "a", "b_b"), ("j", "b", "a_a"), ("j", "b", "a_b")]
    hits = [F.when(touches(edge, end), cut(i, F.col(f"{end}x"), F.col(f"{end}y"))) for i, edge, end in ends]
    s, t = turn("b", "a_a"), turn("b", "a_b")
    across = (F.signum(s) * F.signum(t) < 0) & (F.signum(turn("a", "b_a")) * F.signum(turn("a", "b_b")) < 0)
    x, y = (F.round(F.col(f"a_a{k}") + (F.col(f"a_b{k}") - F.col(f"a_a{k}")) * s / (s - t)) for k in "xy")
    p = p.select(F.array(*hits).alias("hits"), F.when(across, F.array(cut("i", x, y), cut("j", x, y))).alias("across"))
    touching = F.array_compact("hits")
    return p.select(F.explode(F.when(F.size(touching) > 0, touching).otherwise(F.col("across"))).alias("c")).select("c.*")


def pieces(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges cut at all meetings: (keys, member, ax, ay, bx, by, n), equal pieces of a member once, with their number.

    A piece has its ends in rising order along its longer axis.
    """
    edges = edges.withColumn("id", F.monotonically_increasing_id()).transform(shared.stored)
    cuts = _crossings(edges, keys).groupBy("id").agg(F.collect_set(F.struct("x", "y")).alias("cuts"))
    along = lambda p: (p["x"] - F.col("ax")) * (F.col("bx") - F.col("ax")) + (p["y"] - F.col("ay")) * (F.col("by") - F.col("ay"))
    end = lambda e: F.struct(F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y"))
    stops = F.transform(F.array_sort(F.transform("cuts", lambda p: F.struct(along(p).alias("t"), p.alias("p")))), lambda v: v["p"])
    line = edges.join(cuts, "id", "left").withColumn("p", F.concat(F.array(end("a")), F.coalesce(stops, F.array().cast("array<struct<x:double,y:double>>")), F.array(end("b"))))
    each = F.explode(F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("p"), F.slice("p", 2, F.size("p") - 1).alias("q")))
    parts = line.select(*keys, "member", each.alias("e")).select(*keys, "member", F.col("e.p").alias("p"), F.col("e.q").alias("q")).filter("p <> q")
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    rising = F.when(F.abs(dx) >= F.abs(dy), dx > 0).otherwise(dy > 0)
    pick = lambda k, yes, no: F.when(rising, F.col(f"{yes}.{k}")).otherwise(F.col(f"{no}.{k}"))
    parts = parts.select(*keys, "member", pick("x", "p", "q").alias("ax"), pick("y", "p", "q").alias("ay"), pick("x", "q", "p").alias("bx"), pick("y", "q", "p").alias("by"))
    return parts.groupBy(*keys, "member", *ENDS).agg(F.count(F.lit(1)).alias("n"))


def below(points: DataFrame, edges: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, names, member, c): how many edges of each member lie below each point; none: no row.

    points: keys, names, axis, at, height. Along axis 0 a point looks down, along
    axis 1 to the left. edges: keys, member, ends. An edge does not count for a
    point named by its own ends, if names has ends.
    """
    e = _gridded(edges, keys)
    grid = e.select(*keys, "_x", "_y", "_s").distinct()
    flat = lambda axis, u, v, corner: e.select(
        *keys, "member", F.lit(axis).alias("axis"), *(F.col(c).alias(f"e_{c}") for c in ENDS), F.col(f"a{u}").alias("ua"), F.col(f"a{v}").alias("va"), F.col(f"b{u}").alias("ub"), F.col(f"b{v}").alias("vb"),
        F.col(corner).alias("_c"), "_s",
    )
    spans = flat(0, "x", "y", "_x").unionByName(flat(1, "y", "x", "_y")).filter("ua <> ub").withColumn("lo", F.least("ua", "ub")).withColumn("hi", F.greatest("ua", "ub"))
    band = lambda v: F.floor((v - F.col("_c")) / F.col("_s")).cast("long")
    spans = spans.withColumn("band", F.explode(F.sequence(band(F.col("lo")), band(F.col("hi"))))).drop("_c", "_s")
    asked = points.join(grid, keys).withColumn("_c", F.when(F.col("axis") == 0, F.col("_x")).otherwise(F.col("_y"))).withColumn("band", band(F.col("at"))).drop("_c", "_s", "_x", "_y")
    met = asked.join(spans, [*keys, "axis", "band"]).filter("lo <= at AND at < hi")
    if set(ENDS) <= set(names):
        met = met.filter("NOT (ax = e_ax AND ay = e_ay AND bx = e_bx AND by = e_by)")
    reach = F.col("va") + (F.col("vb") - F.col("va")) * (F.col("at") - F.col("ua")) / (F.col("ub") - F.col("ua"))
    return met.filter(reach < F.col("height")).groupBy(*keys, *names, "member").agg(F.count(F.lit(1)).alias("c"))


def _middles(edges: DataFrame) -> DataFrame:
    """Adds axis, at and height of the middle of each edge: it looks across its longer axis."""
    axis = F.when(F.abs(F.col("bx") - F.col("ax")) >= F.abs(F.col("by") - F.col("ay")), 0).otherwise(1)
    x, y = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    return edges.withColumn("axis", axis).withColumn("at", F.when(F.col("axis") == 0, x).otherwise(y)).withColumn("height", F.when(F.col("axis") == 0, y).otherwise(x))


def sides(cut: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ends, member, below, above): the members that cover a side of each piece. below: the smaller coordinates across the piece.

    A piece that a member has an even number of times bounds nothing of it.
    """
    odd = cut.filter("n % 2 = 1").select(*keys, "member", *ENDS).transform(shared.stored)
    points = _middles(odd.select(*keys, *ENDS).distinct())
    counts = below(points, odd, keys, list(ENDS)).withColumn("own", F.lit(0))
    both = counts.unionByName(odd.withColumn("c", F.lit(0)).withColumn("own", F.lit(1)))
    both = both.groupBy(*keys, *ENDS, "member").agg((F.sum("c") % 2 == 1).alias("below"), ((F.sum("c") + F.sum("own")) % 2 == 1).alias("above"))
    return both.filter("below OR above")


def outline(cut: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ends): the edges between what some member covers and what none does, with the covered side on the left."""
    s = sides(cut, keys).groupBy(*keys, *ENDS).agg(F.max("below").alias("below"), F.max("above").alias("above")).filter("below <> above")
    flat = F.abs(F.col("bx") - F.col("ax")) >= F.abs(F.col("by") - F.col("ay"))
    ahead = F.when(flat, F.col("above")).otherwise(F.col("below"))
    turned = {"ax": "bx", "ay": "by", "bx": "ax", "by": "ay"}
    return s.select(*keys, *(F.when(ahead, F.col(c)).otherwise(F.col(o)).alias(c) for c, o in turned.items()))


def rings(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `ring` to the edges of outlines: at a corner with several ways the region's narrowest wedge is followed, so parts that touch in a point stay apart.

    Rings take their number by doubling: after k rounds an edge knows the least number among the 2^k edges behind it.
    """
    e = edges.withColumn("id", F.monotonically_increasing_id()).transform(shared.stored)
    angle = lambda x, y: F.atan2(y, x)
    out = e.select(*keys, F.col("ax").alias("x"), F.col("ay").alias("y"), angle(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("w"), F.col("id").alias("leaves"), F.lit(None).cast("long").alias("comes"))
    into = e.select(*keys, F.col("bx").alias("x"), F.col("by").alias("y"), angle(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")).alias("w"), F.lit(None).cast("long").alias("leaves"), F.col("id").alias("comes"))
    round_ = Window.partitionBy(*keys, "x", "y").orderBy("w", "comes")
    before = F.last("leaves", True).over(round_.rowsBetween(Window.unboundedPreceding, -1))
    last = F.last("leaves", True).over(round_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ways = out.unionByName(into).withColumn("next", F.coalesce(before, last)).filter("comes is not null").select(F.col("comes").alias("id"), "next", F.col("comes").alias("ring")).transform(shared.stored)
    longest = e.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        far = ways.select(F.col("id").alias("next"), F.col("next").alias("_n"), F.col("ring").alias("_r"))
        ways = ways.join(far, "next").select("id", F.col("_n").alias("next"), F.least("ring", "_r").alias("ring")).transform(shared.stored)
    return e.join(ways.select("id", "ring"), "id").drop("id")


def parts(ringed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, part, area): each ring's signed area, holes below zero, and the outer ring of the part it belongs to."""
    doubled = F.sum(F.col("ax") / UNIT * (F.col("by") / UNIT) - F.col("bx") / UNIT * (F.col("ay") / UNIT))
    sized = ringed.groupBy(*keys, "ring").agg((doubled / 2).alias("area"), F.min(F.struct(*ENDS)).alias("one")).transform(shared.stored)
    outer = sized.filter("area > 0")
    holes = sized.filter("area <= 0")
    points = _middles(holes.select(*keys, F.col("ring").alias("hole"), "one.*")).drop(*ENDS)
    around = ringed.join(outer.select(*keys, "ring"), [*keys, "ring"]).withColumnRenamed("ring", "member")
    held = below(points, around, keys, ["hole"]).filter("c % 2 = 1").join(outer.select(*keys, F.col("ring").alias("member"), F.col("area").alias("_a")), [*keys, "member"])
    of = held.groupBy(*keys, "hole").agg(F.min(F.struct("_a", "member"))["member"].alias("part"))
    lone = outer.select(*keys, "ring", F.col("ring").alias("part"), "area")
    return lone.unionByName(holes.select(*keys, F.col("ring").alias("hole"), "area").join(of, [*keys, "hole"], "left").select(*keys, F.col("hole").alias("ring"), "part", "area"))


def union(edges: DataFrame, keys: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """(keys, ends): the outline of all members of each figure together, as outline has it."""

    def work(f: np.ndarray, m: np.ndarray, e: np.ndarray) -> tuple:
        of, made = figures.outline(*figures.pieces(f, m, e))
        return of, *made.T

    return _settled(edges, keys, work, EDGE, lambda large: outline(pieces(large, keys), keys), at_once)


def union_parts(edges: DataFrame, keys: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """(keys, ring, part, area) of the outline of all members of each figure together, as parts has it."""

    def work(f: np.ndarray, m: np.ndarray, e: np.ndarray) -> tuple:
        of, made = figures.outline(*figures.pieces(f, m, e))
        ring = figures.rings(of, made)
        of, ring, part, area = figures.parts(of[ring >= 0], made[ring >= 0], ring[ring >= 0], UNIT)
        return of, ring, pa.array(part, mask=part < 0), area

    return _settled(edges, keys, work, "ring long, part long, area double", lambda large: parts(rings(outline(pieces(large, keys), keys), keys), keys), at_once)


def largest_part(edges: DataFrame, keys: list[str], at_once: int = AT_ONCE, sizes: DataFrame | None = None) -> DataFrame:
    """(keys, ends): of each figure, taken as one member by the even-odd rule, the edges of its largest part (of equals the first by its leftmost edge).

    A figure in which some stretch is run through an even number of times leaves
    loose lines besides areas; such a figure has no edges here, nor one without area.
    """

    def work(f: np.ndarray, m: np.ndarray, e: np.ndarray) -> tuple:
        of, made = figures.largest(f, m, e, UNIT)
        return of, *made.T

    return _settled(edges, keys, work, EDGE, lambda large: _largest_by_joins(large, keys), at_once, sizes)


def _largest_by_joins(edges: DataFrame, keys: list[str]) -> DataFrame:
    """What largest_part says of figures of any size."""
    cut = pieces(edges, keys).transform(shared.stored)
    loose = cut.filter("n % 2 = 0").select(*keys).distinct()
    ringed = rings(outline(cut.join(loose, keys, "left_anti"), keys), keys).transform(shared.stored)
    own = parts(ringed, keys)
    first = ringed.groupBy(*keys, F.col("ring").alias("part")).agg(F.min(F.struct(*ENDS)).alias("_first"))
    sizes = own.groupBy(*keys, "part").agg(F.sum("area").alias("_area")).join(first, [*keys, "part"])
    # Areas are sums of doubles: of near equals the first.
    best = sizes.groupBy(*keys).agg(F.min(F.struct(F.round(-F.col("_area"), 6), "_first", "part"))["part"].alias("part"))
    kept = own.join(best, [*keys, "part"]).select(*keys, "ring")
    return ringed.join(kept, [*keys, "ring"]).select(*keys, *ENDS)


def held(pairs: DataFrame, outlines: DataFrame, owner: list[str], outer: str, inner: str, at_once: int = AT_ONCE) -> DataFrame:
    """The rows of pairs (owner, outer, inner) whose inner region lies in its outer one; without an outline of either, too.

    outlines: owner, region, ends. Both outlines are laid over each other; a
    piece with a side that only the inner region covers speaks against the pair.
    """
    keys = [*owner, outer, inner]
    # Pairs with both outlines, by the edges that they have together.
    sizes, known = outlines.groupBy(*owner, "region").agg(F.count(F.lit(1)).alias("_n")), pairs.select(*keys).withColumn("_edges", F.lit(0).cast("long"))
    for name in (outer, inner):
        known = known.join(shared.shuffled(sizes.withColumnRenamed("region", name)), [*owner, name]).select(*keys, (F.col("_edges") + F.col("_n")).alias("_edges"))
    known = known.transform(shared.stored)

    def both(some: DataFrame) -> DataFrame:
        one = [some.select(*keys).join(shared.shuffled(outlines.withColumnRenamed("region", name)), [*owner, name]).select(*keys, F.lit(k).alias("member"), *ENDS) for k, name in enumerate((outer, inner))]
        return one[0].unionByName(one[1])

    few = known.filter(F.col("_edges") <= at_once)
    against = _together(both(few), keys, lambda f, m, e: (figures.against(f, m, e),), "")
    many = known.filter(F.col("_edges") > at_once)
    if not many.isEmpty():
        against = against.unionByName(_against_by_joins(both(many), keys))
    return pairs.join(shared.shuffled(against), keys, "left_anti")


def _against_by_joins(both: DataFrame, keys: list[str]) -> DataFrame:
    """(keys): the figures in which member 1 covers what member 0 does not."""
    s = sides(pieces(both, keys), keys)
    flag = lambda k, side: F.max(F.when(F.col("member") == k, F.col(side)).otherwise(False))
    over = s.groupBy(*keys, *ENDS).agg(*(flag(k, side).alias(f"{side}{k}") for k in (0, 1) for side in ("below", "above")))
    return over.filter("(below1 AND NOT below0) OR (above1 AND NOT above0)").select(*keys).distinct()
