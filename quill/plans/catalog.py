"""Registered queries over the proxy tables, and the SQL each is checked against.

A query without SQL is one whose operator SQL cannot say: path data,
communities. Tests hold those against small fixtures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import color, geometry
from ..operators import features, graph, grouping, hierarchy, merging, output, pixels, polygons, raster, stats
from ..sources import svg
from . import proxies
from .proxies import PALETTE, SHAPES_SQL
from .vectorize import Engine

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


_r = lambda c, n=6: F.round(c, n)


# ---- scalar functions --------------------------------------------------------


@query(SHAPES_SQL + "SELECT path_idx, r::INT AS r, g::INT AS g, b::INT AS b, round(ll, 6) AS l, round(la, 6) AS a, round(lb, 6) AS lab_b FROM s")
def color_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = color.hex_to_rgb(F.col("fill"))
    return proxies.shapes(spark, sf_dir).select("path_idx", rgb["r"].alias("r"), rgb["g"].alias("g"), rgb["b"].alias("b"), _r(F.col("lab.l")).alias("l"), _r(F.col("lab.a")).alias("a"), _r(F.col("lab.b")).alias("lab_b"))


@query(SHAPES_SQL + """, n AS (SELECT *, lead(fill) OVER w AS f2, lead(ll) OVER w AS l2, lead(la) OVER w AS a2, lead(lb) OVER w AS b2 FROM s WINDOW w AS (PARTITION BY image_id ORDER BY path_idx))
SELECT path_idx, round(sqrt(pow(ll - l2, 2) + pow(la - a2, 2) + pow(lb - b2, 2)), 6) AS apart,
  fill = f2 OR coalesce(sqrt(pow(ll - l2, 2) + pow(la - a2, 2) + pow(lb - b2, 2)) < 60, false) AS alike FROM n WHERE f2 IS NOT NULL""")
def color_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("image_id").orderBy("path_idx")
    n = proxies.shapes(spark, sf_dir).withColumn("f2", F.lead("fill").over(w)).withColumn("l2", F.lead("lab").over(w)).filter("f2 is not null")
    return n.select("path_idx", _r(color.delta_e(F.col("lab"), F.col("l2"))).alias("apart"), color.colors_similar(F.col("fill"), F.col("f2"), 60.0).alias("alike"))


@query(SHAPES_SQL + "SELECT path_idx, area, cx, cy, round(CASE WHEN y1 - y0 < 1e-6 THEN 1.0 ELSE (x1 - x0)::DOUBLE / (y1 - y0) END, 6) AS aspect_ratio FROM s WHERE area >= 500")
def box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxies.shapes(spark, sf_dir).filter("area >= 500").select("path_idx", "area", F.col("centroid.x").alias("cx"), F.col("centroid.y").alias("cy"), _r(F.col("aspect_ratio")).alias("aspect_ratio"))


#: Transforms that reach every branch of the rule; # stands for the row's number.
TRANSFORMS = ("translate(#)", "translate(#,2)", "translate(3 #)", "translate(1,2,3)", "translate(x) translate(5,#)", "translate(,1)", "translate(1d)", "translate(1-2)", "scale(2)",
              "translate( -#.5 , 4e1 )", "rotate(3) translate(#)", "translate(1 , )", "TRANSLATE(4)", "translate(.5,#.)")


@query("WITH t AS (SELECT p_partkey, replace([" + ", ".join(f"'{t}'" for t in TRANSFORMS) + f"][(p_partkey % {len(TRANSFORMS)})::INT + 1], '#', p_partkey::VARCHAR) AS t FROM part)" + r""",
u AS (SELECT p_partkey, regexp_extract(t, 'translate\(\s*([-\d.+eE]+)(?:[,\s]+([-\d.+eE]+))?\s*\)', ['x', 'y']) AS p FROM t),
v AS (SELECT p_partkey, try_cast(p.x AS DOUBLE) AS x, CASE WHEN p.y = '' THEN 0.0::DOUBLE ELSE try_cast(p.y AS DOUBLE) END AS y FROM u)
SELECT p_partkey, CASE WHEN x IS NULL OR y IS NULL THEN 0.0::DOUBLE ELSE x END AS tx, CASE WHEN x IS NULL OR y IS NULL THEN 0.0::DOUBLE ELSE y END AS ty FROM v""")
def translate_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.element_at(F.array(*map(F.lit, TRANSFORMS)), (k % len(TRANSFORMS)).cast("int") + 1)
    t = geometry.parse_translate(F.replace(text, F.lit("#"), k.cast("string")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", t["tx"].alias("tx"), t["ty"].alias("ty"))


@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 100.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 4 THEN 0.5::DOUBLE WHEN 5 THEN 80.0::DOUBLE WHEN 6 THEN 70.0::DOUBLE WHEN 7 THEN (c_custkey % 90 + 2)::DOUBLE ELSE (c_custkey % 90 + 2)::DOUBLE END AS w,
  CASE c_custkey % 8 WHEN 0 THEN 50.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 4 THEN 0.4::DOUBLE WHEN 5 THEN 60.0::DOUBLE WHEN 6 THEN 1.0::DOUBLE WHEN 7 THEN 33.0::DOUBLE ELSE 60.0::DOUBLE END AS h FROM customer""")
def document_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    own = F.concat((k % 90 + 2).cast("string"), F.lit("px"))
    # 4: sides under 1 stay without attributes; 5: a bad third part hides the fourth; 6: the fourth is bad; 7: a small third gives way.
    box = F.when(k % 8 == 0, "0 0 100 50").when(k % 8 == 1, "0,0,100,50").when(k % 8 == 4, "0 0 0.5 0.4").when(k % 8 == 5, "0 0 x 50").when(k % 8 == 6, "0 0 70 y").when(k % 8 == 7, "0 0 0.5 33")
    width = F.when(k % 8 == 5, "80").when(k % 8 == 6, "9px").when(k % 8 == 4, "50%").when(k % 8 != 1, own)
    height = F.when((k % 8).isin(2, 3, 5), "60pt").when(k % 8 == 7, "9")
    d = geometry.dimensions(box, width, height)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", d["w"].alias("w"), d["h"].alias("h"))


@query(r"""SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$', 0), '\.[^.]*$', '') AS stem, lower(regexp_extract(url, '\.([^./]+)$', 1)) AS suffix FROM pages""")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", svg.stem(F.col("url")).alias("stem"), svg.suffix(F.col("url")).alias("suffix"))


@query(r"""WITH t AS (SELECT page_id, replace(replace(html, '<p', '<g'), '</p', '</g') || '<g id="a"/>' || chr(10) || '  <b/><g><g> </g> </g> <i/>' AS h FROM pages)
SELECT page_id, md5(regexp_replace(regexp_replace(h, '<g[^>]*/>\s*', '', 'g'), '<g[^>]*>\s*</g>\s*', '', 'g')) AS digest FROM t""")
def empty_groups_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.concat(F.replace(F.replace("html", F.lit("<p"), F.lit("<g")), F.lit("</p"), F.lit("</g")), F.lit('<g id="a"/>\n  <b/><g><g> </g> </g> <i/>'))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(output.remove_empty_groups(h).cast("binary")).alias("digest"))


@query("SELECT event_id, event_type IN ('image/png', 'image/jpeg', 'image/jpg', 'image/webp') AS accepted, greatest(0, least(255, floor(value)))::INT AS byte FROM events")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", svg.accepted(F.col("event_type")).alias("accepted"), color.to_byte(F.col("value")).alias("byte"))


# ---- sources -----------------------------------------------------------------


@query(SHAPES_SQL + "SELECT image_id, (path_idx - min(path_idx) OVER (PARTITION BY image_id))::INT AS ordinal, fill, area, x0::DOUBLE AS xmin, y0::DOUBLE AS ymin, x1::DOUBLE AS xmax, y1::DOUBLE AS ymax, 4 AS complexity FROM s")
def svg_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = svg.parse_elements(proxies.svg_documents(spark, sf_dir))
    p = svg.derived(svg.projected(found))
    return p.select("image_id", F.col("path_idx").alias("ordinal"), "fill", "area", "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax", "complexity")


@query("SELECT DISTINCT p_partkey // 100 AS image_id, NULL::VARCHAR AS width, '0 0 700 600' AS view_box, 'http://www.w3.org/2000/svg' AS xmlns, 700.0::DOUBLE AS w, 600.0::DOUBLE AS h FROM part")
def svg_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return svg.metadata(svg.parse_elements(proxies.svg_documents(spark, sf_dir))).select("image_id", "width", "view_box", "xmlns", "w", "h")


# ---- joins and hierarchy -----------------------------------------------------

_PAIRS = SHAPES_SQL + """, pairs AS (SELECT a.image_id, a.path_idx AS parent, b.path_idx AS child, a.area AS parent_area FROM s a JOIN s b ON a.image_id = b.image_id AND a.path_idx <> b.path_idx
  AND a.area * 10 > b.area * 11 AND a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1),
parents AS (SELECT image_id, child, parent FROM pairs QUALIFY row_number() OVER (PARTITION BY image_id, child ORDER BY parent_area, parent) = 1)
"""
_DEPTHS = _PAIRS.replace("WITH base", "WITH RECURSIVE base") + """, depth AS (
  SELECT image_id, path_idx, 0 AS depth FROM s WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.image_id = s.image_id AND p.child = s.path_idx)
  UNION ALL SELECT p.image_id, p.child, d.depth + 1 FROM depth d JOIN parents p ON p.image_id = d.image_id AND p.parent = d.path_idx)
"""


@query(SHAPES_SQL + """SELECT a.image_id, a.path_idx AS i, b.path_idx AS j FROM s a JOIN s b ON a.image_id = b.image_id AND a.fill = b.fill AND a.path_idx < b.path_idx
  AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = proxies.grouped(spark, sf_dir).withColumn("group_idx", F.lit(0)).withColumn("transform", F.lit(None).cast("string"))
    return merging.mergeable_pairs(one).select("image_id", "i", "j")


@query(_PAIRS + "SELECT image_id, child, parent FROM parents")
def containment_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxies.tree(spark, sf_dir)[1]


@query(_PAIRS + "SELECT image_id, path_idx AS group_idx FROM s WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.image_id = s.image_id AND p.child = s.path_idx)")
def hierarchy_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.roots(*proxies.tree(spark, sf_dir))


@query(_DEPTHS + "SELECT d.image_id, d.path_idx AS group_idx, p.parent AS parent_idx, depth FROM depth d LEFT JOIN parents p ON p.image_id = d.image_id AND p.child = d.path_idx")
def hierarchy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.depths(*proxies.tree(spark, sf_dir))


@query(_DEPTHS + "SELECT image_id, depth, count(*) AS n FROM depth GROUP BY image_id, depth")
def hierarchy_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.depths(*proxies.tree(spark, sf_dir)).groupBy("image_id", "depth").agg(F.count(F.lit(1)).alias("n"))


@query(_PAIRS + "SELECT image_id, parent AS parent_idx, string_agg(child::VARCHAR, ',' ORDER BY child) AS children FROM parents GROUP BY image_id, parent")
def hierarchy_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.children(hierarchy.depths(*proxies.tree(spark, sf_dir))).select("image_id", "parent_idx", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


# ---- polygons ----------------------------------------------------------------

_BARS = SHAPES_SQL + """, e AS (SELECT *, greatest(0, least(10, (x1 - x0) // 3, (y1 - y0) // 3)) AS edge FROM s), f AS (SELECT *, path_idx % 3 = 0 OR edge = 0 AS solid FROM e),
bars AS (
  SELECT image_id, path_idx, x0 AS l, y0 AS b, x1 AS r, y1 AS t FROM f WHERE solid
  UNION ALL SELECT image_id, path_idx, x0, y0, x1, y0 + edge FROM f WHERE NOT solid UNION ALL SELECT image_id, path_idx, x0, y1 - edge, x1, y1 FROM f WHERE NOT solid
  UNION ALL SELECT image_id, path_idx, x0, y0, x0 + edge, y1 FROM f WHERE NOT solid UNION ALL SELECT image_id, path_idx, x1 - edge, y0, x1, y1 FROM f WHERE NOT solid)
"""


@query(SHAPES_SQL + """, k AS (SELECT *, path_idx % 13 + 1 AS k, x1 - x0 AS w, y1 - y0 AS h FROM s)
SELECT image_id, path_idx, CASE path_idx % 4 WHEN 0 THEN w * h WHEN 1 THEN CASE path_idx // 4 % 2 WHEN 0 THEN w * h / 4.0::DOUBLE ELSE w * h * 9 / 8.0::DOUBLE END ELSE greatest(w * h, k * k) END::DOUBLE AS area FROM k WHERE path_idx % 4 <> 3""")
def repaired_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that cross or touch themselves become their largest part; those that leave a loose line have none."""
    keys = ["image_id", "path_idx"]
    rings = proxies.crossing_rings(spark, sf_dir)
    found = polygons.largest_part(polygons.ring_edges(rings, keys, F.lit(0)), keys, sizes=rings.select(*keys, F.size("polygon").alias("_n")))
    doubled = (F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / polygons.UNIT**2
    return found.groupBy(*keys).agg(_r(F.sum(doubled) / 2, 3).alias("area"))


@query(_BARS + """, g AS (SELECT *, path_idx // 10 AS grp FROM bars), xs AS (SELECT DISTINCT image_id, grp, unnest([l, r]) AS v FROM g), ys AS (SELECT DISTINCT image_id, grp, unnest([b, t]) AS v FROM g),
xi AS (SELECT *, row_number() OVER (PARTITION BY image_id, grp ORDER BY v) AS i, lead(v) OVER (PARTITION BY image_id, grp ORDER BY v) AS w FROM xs), yi AS (SELECT *, row_number() OVER (PARTITION BY image_id, grp ORDER BY v) AS j, lead(v) OVER (PARTITION BY image_id, grp ORDER BY v) AS w FROM ys),
cells AS (SELECT DISTINCT g.image_id, g.grp, i, j, (xi.w - xi.v) * (yi.w - yi.v) AS area FROM g JOIN xi ON xi.image_id = g.image_id AND xi.grp = g.grp AND xi.v >= g.l AND xi.v < g.r JOIN yi ON yi.image_id = g.image_id AND yi.grp = g.grp AND yi.v >= g.b AND yi.v < g.t),
corners AS (SELECT image_id, grp, i + di AS i, j + dj AS j, sum(1 << (2 * di + dj)) AS mask FROM cells, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj) GROUP BY ALL),
euler AS (SELECT image_id, grp, sum(CASE WHEN mask IN (1, 2, 4, 8) THEN 1 WHEN mask IN (7, 11, 13, 14) THEN -1 WHEN mask IN (6, 9) THEN 2 ELSE 0 END) // 4 AS n FROM corners GROUP BY ALL)
SELECT image_id, grp AS group_idx, sum(area)::DOUBLE AS area, any_value(n)::BIGINT AS parts_less_holes FROM cells JOIN euler USING (image_id, grp) GROUP BY image_id, grp""")
def union_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten shapes together: the area of their union, and how many more parts than holes it has."""
    keys = ["image_id", "group_idx"]
    bars = proxies.bars(spark, sf_dir).withColumn("group_idx", F.floor(F.col("path_idx") / 10))
    rings = polygons.union_parts(polygons.ring_edges(bars, keys, F.struct("path_idx", "part")), keys)
    return rings.groupBy(*keys).agg(_r(F.sum("area"), 3).alias("area"), F.sum(F.when(F.col("area") > 0, 1).otherwise(-1)).alias("parts_less_holes"))


@query(_BARS[: _BARS.index(",\nbars")] + """
SELECT p.image_id, p.path_idx AS parent, c.path_idx AS child, (p.edge > 0 AND NOT p.solid) AS hollow FROM f p JOIN f c ON p.image_id = c.image_id AND p.path_idx <> c.path_idx
  AND p.area * 10 > c.area * 11 AND p.x0 <= c.x0 AND p.y0 <= c.y0 AND p.x1 >= c.x1 AND p.y1 >= c.y1
WHERE p.solid OR greatest(p.x0 + p.edge, c.x0) >= least(p.x1 - p.edge, c.x1) OR greatest(p.y0 + p.edge, c.y0) >= least(p.y1 - p.edge, c.y1) OR (NOT c.solid
  AND greatest(p.x0 + p.edge, c.x0) >= c.x0 + c.edge AND least(p.x1 - p.edge, c.x1) <= c.x1 - c.edge AND greatest(p.y0 + p.edge, c.y0) >= c.y0 + c.edge AND least(p.y1 - p.edge, c.y1) <= c.y1 - c.edge)""")
def interior_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and boxes: which lies in the area of which, and not only in its box."""
    boxes, _ = proxies.tree(spark, sf_dir)
    bars = proxies.bars(spark, sf_dir).withColumnsRenamed({"path_idx": "group_idx", "part": "path_idx"}).withColumn("simple", F.lit(True))
    pairs = polygons.held(hierarchy.containment_pairs(boxes), hierarchy.outlines(bars), ["image_id"], "parent", "child")
    hollow = bars.groupBy("image_id", F.col("group_idx").alias("parent")).agg((F.count(F.lit(1)) > 1).alias("hollow"))
    return pairs.join(hollow, ["image_id", "parent"]).select("image_id", "parent", "child", "hollow")


# ---- features, graphs and clusters -------------------------------------------

_APART = "CASE WHEN a.ll IS NULL OR b.ll IS NULL THEN CASE WHEN a.fill = b.fill THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END ELSE sqrt(pow(a.ll - b.ll, 2) + pow(a.la - b.la, 2) + pow(a.lb - b.lb, 2)) END"
_GAP = "sqrt(pow(greatest(0.0, a.x0 - b.x1, b.x0 - a.x1), 2) + pow(greatest(0.0, a.y0 - b.y1, b.y0 - a.y1), 2))"
_FEATURES = SHAPES_SQL + """, m AS (SELECT *, max(area) OVER (PARTITION BY image_id) AS ma, max(complexity) OVER (PARTITION BY image_id) AS mc FROM s),
f AS (SELECT image_id, path_idx, [cx / 700, cy / 600, coalesce(ll / 100, 0) * 2, coalesce((la + 128) / 256, 0.5) * 2, coalesce((lb + 128) / 256, 0.5) * 2, ln(1 + area) / ln(1 + ma) * 0.5,
  least((x1 - x0)::DOUBLE / (y1 - y0), 10) / 10 * 0.3, ln(1.0::DOUBLE + complexity) / ln(1.0::DOUBLE + mc) * 0.3, curve_ratio * 0.3]::DOUBLE[] AS v FROM m)
"""
_EPS = 0.35


@query(SHAPES_SQL + f"""SELECT * FROM (SELECT a.image_id, a.path_idx AS i, b.path_idx AS j, {_GAP} AS gap, {_APART} AS apart FROM s a JOIN s b ON a.image_id = b.image_id AND a.path_idx < b.path_idx) p
WHERE gap <= 50 AND apart <= 25""".replace("SELECT * FROM (", "SELECT image_id, i, j, round(((1 - gap / 50) + (1 - apart / 25)) / 2, 6) AS weight FROM (", 1))
def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.similarity_edges(proxies.shapes(spark, sf_dir)).withColumn("weight", _r(F.col("weight")))


@query(_FEATURES + "SELECT image_id, path_idx, " + ", ".join(f"round(v[{k}], 6) AS f{k}" for k in range(1, 10)) + " FROM f")
def path_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = features.with_features(proxies.shapes(spark, sf_dir))
    return p.select("image_id", "path_idx", *(_r(F.element_at("features", k)).alias(f"f{k}") for k in range(1, 10)))


@query(_FEATURES + f"SELECT a.image_id, a.path_idx AS i, b.path_idx AS j FROM f a JOIN f b ON a.image_id = b.image_id AND a.path_idx < b.path_idx AND list_distance(a.v, b.v) <= {_EPS}")
def eps_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.neighbours(features.with_features(proxies.shapes(spark, sf_dir)), _EPS)


@query(_FEATURES.replace("WITH base", "WITH RECURSIVE base") + f""", e AS (SELECT a.image_id, a.path_idx AS i, b.path_idx AS j FROM f a JOIN f b ON a.image_id = b.image_id AND list_distance(a.v, b.v) <= {_EPS}),
r AS (SELECT image_id, path_idx, path_idx AS reached FROM f UNION SELECT r.image_id, r.path_idx, e.j FROM r JOIN e ON e.image_id = r.image_id AND e.i = r.reached)
SELECT image_id, path_idx, min(reached) AS label FROM r GROUP BY image_id, path_idx""")
def eps_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.density_clusters(features.with_features(proxies.shapes(spark, sf_dir)), _EPS)


@query(_FEATURES.replace("WITH base", "WITH RECURSIVE base") + f""", e AS (SELECT a.image_id, a.path_idx AS i, b.path_idx AS j FROM f a JOIN f b ON a.image_id = b.image_id AND list_distance(a.v, b.v) <= {_EPS}),
core AS (SELECT image_id, i AS path_idx FROM e GROUP BY image_id, i HAVING count(*) >= 3), ce AS (SELECT e.* FROM e JOIN core a ON a.image_id = e.image_id AND a.path_idx = i JOIN core b ON b.image_id = e.image_id AND b.path_idx = j),
r AS (SELECT image_id, path_idx, path_idx AS reached FROM core UNION SELECT r.image_id, r.path_idx, ce.j FROM r JOIN ce ON ce.image_id = r.image_id AND ce.i = r.reached), l AS (SELECT image_id, path_idx, min(reached) AS label FROM r GROUP BY ALL),
near AS (SELECT e.image_id, e.i AS path_idx, min(label) AS label FROM e JOIN l ON l.image_id = e.image_id AND l.path_idx = e.j GROUP BY ALL)
SELECT f.image_id, f.path_idx, coalesce(l.label, near.label, -1)::INT AS label FROM f LEFT JOIN l ON l.image_id = f.image_id AND l.path_idx = f.path_idx LEFT JOIN near ON near.image_id = f.image_id AND near.path_idx = f.path_idx""")
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.density_clusters(features.with_features(proxies.shapes(spark, sf_dir)), _EPS, min_samples=3)


@query()
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = proxies.shapes(spark, sf_dir)
    return graph.communities(s, grouping.similarity_edges(s, 80.0, 40.0))


@query(SHAPES_SQL + """, g AS (SELECT image_id, path_idx % 20 AS label, avg(cy) AS y, avg(cx) AS x, min(path_idx) AS first FROM s GROUP BY image_id, path_idx % 20),
o AS (SELECT image_id, label, row_number() OVER (PARTITION BY image_id ORDER BY y, x, first) - 1 AS group_idx FROM g)
SELECT s.image_id, path_idx, group_idx::INT AS group_idx, (row_number() OVER (PARTITION BY s.image_id, group_idx ORDER BY path_idx) - 1)::INT AS member_ord FROM s JOIN o ON o.image_id = s.image_id AND o.label = s.path_idx % 20""")
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = proxies.shapes(spark, sf_dir)
    return grouping.ordered_groups(s, s.select("image_id", "path_idx", (F.col("path_idx") % proxies.GROUPS).alias("label"))).select("image_id", "path_idx", "group_idx", "member_ord")


# ---- aggregates --------------------------------------------------------------


@query(SHAPES_SQL + """, k AS (SELECT *, path_idx % 20 AS grp FROM s), m AS (SELECT *, avg(ll) OVER w AS ml, avg(la) OVER w AS ma, avg(lb) OVER w AS mb FROM k WINDOW w AS (PARTITION BY image_id, grp)),
top AS (SELECT image_id, grp, fill FROM k GROUP BY image_id, grp, fill QUALIFY row_number() OVER (PARTITION BY image_id, grp ORDER BY count(*) DESC, min(path_idx)) = 1)
SELECT m.image_id, m.grp::INT AS group_idx, round(coalesce(any_value(ml), 50), 6) AS l, round(coalesce(any_value(ma), 0), 6) AS a, round(coalesce(any_value(mb), 0), 6) AS b,
  round(coalesce(avg(sqrt(pow(ll - ml, 2) + pow(la - ma, 2) + pow(lb - mb, 2))), 0), 6) AS variance, CASE WHEN count(ll) > 0 THEN any_value(top.fill) ELSE arg_min(m.fill, path_idx) END AS dominant_fill,
  CASE WHEN count(ll) > 0 THEN count(DISTINCT m.fill) ELSE 0 END AS unique_colors FROM m JOIN top ON top.image_id = m.image_id AND top.grp = m.grp GROUP BY m.image_id, m.grp""")
def color_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stats.color_stats(proxies.grouped(spark, sf_dir))
    return c.select("image_id", "group_idx", *(_r(F.col(f"mean_lab.{x}")).alias(x) for x in "lab"), _r(F.col("variance")).alias("variance"), "dominant_fill", "unique_colors")


@query(SHAPES_SQL + "SELECT image_id, fill, count(*) AS n, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, min(path_idx))::INT AS rank FROM s GROUP BY image_id, fill QUALIFY rank <= 5")
def dominant_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dominant_colors(proxies.shapes(spark, sf_dir), 5)


@query(SHAPES_SQL + """SELECT image_id, (path_idx % 20)::INT AS group_idx, min(x0)::DOUBLE AS xmin, min(y0)::DOUBLE AS ymin, max(x1)::DOUBLE AS xmax, max(y1)::DOUBLE AS ymax, ((max(x1) - min(x0)) * (max(y1) - min(y0)))::DOUBLE AS area,
  CASE WHEN min(fill) = max(fill) THEN min(fill) END AS fill FROM s GROUP BY image_id, path_idx % 20""")
def group_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = proxies.grouped(spark, sf_dir)
    return stats.boxes(g).join(stats.unanimous(g, "fill", "fill"), list(stats.GROUP)).select("image_id", "group_idx", "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax", "area", "fill")


@query(SHAPES_SQL + "SELECT image_id, count(*) AS n_paths, count(DISTINCT path_idx % 20) AS n_groups FROM s GROUP BY image_id")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.totals(proxies.grouped(spark, sf_dir))


_PIXELS = "WITH px AS (SELECT l_orderkey % 16 AS image_id, l_orderkey * 8 + l_linenumber AS i, l_orderkey * 7 % 256 AS c0, l_partkey * 3 % 200 AS c1, l_suppkey % 64 * (l_orderkey % 4) AS c2 FROM lineitem)"


@query(_PIXELS + """, t AS (SELECT image_id, count(DISTINCT (c0, c1, c2)) AS n_unique, (stddev_pop(c0) + stddev_pop(c1) + stddev_pop(c2)) / 3 AS sd FROM px GROUP BY image_id)
SELECT image_id, n_unique, round(sd, 6) AS spread, CASE WHEN n_unique <= 16 THEN 0 ELSE greatest(8, least(64, CASE WHEN sd > 30 OR n_unique > 2048 THEN 64 WHEN sd > 20 OR n_unique > 1024 THEN 32 WHEN sd > 12 OR n_unique > 512 THEN 24 ELSE 16 END)) END AS k FROM t""")
def palette_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.palette_size(proxies.pixels(spark, sf_dir)).withColumn("spread", _r(F.col("spread")))


_CENTRES = [[10.0, 20.0, 30.0], [200.0, 100.0, 50.0], [90.0, 150.0, 10.0], [128.0, 128.0, 128.0]]


@query(_PIXELS + ", d AS (SELECT image_id, [" + ", ".join(f"pow(c0 - {a}, 2) + pow(c1 - {b}, 2) + pow(c2 - {c}, 2)" for a, b, c in _CENTRES) + "] AS d FROM px) SELECT image_id, (list_position(d, list_min(d)) - 1)::INT AS centre, count(*) AS n FROM d GROUP BY ALL")
def nearest_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = raster.nearest([F.col(c).cast("double") for c in ("c0", "c1", "c2")], _CENTRES)
    return proxies.pixels(spark, sf_dir).groupBy("image_id", best.alias("centre")).agg(F.count(F.lit(1)).alias("n"))


@query(_PIXELS + """SELECT image_id, i, c0::INT AS c0, c1::INT AS c1, c2::INT AS c2 FROM px QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY md5('42|' || image_id || '|' || i), i, c0, c1, c2) <= 500""")
def pixel_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.sampled(proxies.pixels(spark, sf_dir), 500, key=("i",))


_SHARP = ", ".join(f"greatest(0, least(255, 5 * p.c{k} - u.c{k} - d.c{k} - l.c{k} - r.c{k}))::INT AS c{k}" for k in range(3))


@query(proxies.IMAGE_SQL + f"""SELECT p.image_id, p.y, p.x, {_SHARP} FROM px p
JOIN px u ON u.image_id = p.image_id AND u.x = p.x AND u.y = CASE WHEN p.y = 0 THEN least(1, p.h - 1) ELSE p.y - 1 END JOIN px d ON d.image_id = p.image_id AND d.x = p.x AND d.y = CASE WHEN p.y = p.h - 1 THEN greatest(0, p.h - 2) ELSE p.y + 1 END
JOIN px l ON l.image_id = p.image_id AND l.y = p.y AND l.x = CASE WHEN p.x = 0 THEN 1 ELSE p.x - 1 END JOIN px r ON r.image_id = p.image_id AND r.y = p.y AND r.x = CASE WHEN p.x = p.w - 1 THEN p.w - 2 ELSE p.x + 1 END""")
def sharpened_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.sharpened(proxies.image_pixels(spark, sf_dir)).select("image_id", "y", "x", *pixels.COLOURS)


_BACK = [[m * w for m, w in zip(row, color.WHITE)] for row in raster.inverse_xyz()]
_LAB8 = _PIXELS + """, k AS (SELECT DISTINCT c0, c1, c2 FROM px), lin AS (SELECT *, list_transform([c2 / 255.0::DOUBLE, c1 / 255.0::DOUBLE, c0 / 255.0::DOUBLE], lambda v: CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END) AS c FROM k),
xyz AS (SELECT *, list_transform([(0.4124564 * c[1] + 0.3575761 * c[2] + 0.1804375 * c[3]) / 0.95047, 0.2126729 * c[1] + 0.7151522 * c[2] + 0.0721750 * c[3], (0.0193339 * c[1] + 0.1191920 * c[2] + 0.9503041 * c[3]) / 1.08883],
  lambda t: CASE WHEN t > pow(6.0 / 29, 3) THEN pow(t, 1.0::DOUBLE / 3) ELSE t / (3 * pow(6.0 / 29, 2)) + 4.0::DOUBLE / 29 END) AS f FROM lin),
lab AS (SELECT c0, c1, c2, greatest(0, least(255, round((116 * f[2] - 16) * 255 / 100)))::INT AS l, greatest(0, least(255, round(500 * (f[1] - f[2]) + 128)))::INT AS a, greatest(0, least(255, round(200 * (f[2] - f[3]) + 128)))::INT AS b FROM xyz),
g AS (SELECT *, (l * 100 / 255.0::DOUBLE + 16) / 116 AS fy FROM lab), inv AS (SELECT *, list_transform([fy + (a - 128) / 500.0::DOUBLE, fy, fy - (b - 128) / 200.0::DOUBLE], lambda v: CASE WHEN v > 6.0::DOUBLE / 29 THEN v * v * v ELSE 3 * pow(6.0::DOUBLE / 29, 2) * (v - 4.0::DOUBLE / 29) END) AS t FROM g),
back AS (SELECT *, list_transform([""" + ", ".join(" + ".join(f"({m!r}::DOUBLE) * t[{i + 1}]" for i, m in enumerate(row)) for row in _BACK) + """], lambda v: round(255 * CASE WHEN greatest(0, least(1, v)) <= 0.0031308 THEN 12.92 * greatest(0, least(1, v)) ELSE 1.055 * pow(greatest(0, least(1, v)), 1.0::DOUBLE / 2.4) - 0.055 END)) AS r FROM inv)
"""


@query(_LAB8 + "SELECT c0::INT AS c0, c1::INT AS c1, c2::INT AS c2, l, a, b, greatest(0, least(255, r[3]))::INT AS b0, greatest(0, least(255, r[2]))::INT AS b1, greatest(0, least(255, r[1]))::INT AS b2 FROM back")
def pixel_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours as bytes of CIELAB, and what is left of them on the way back."""
    old = proxies.pixels(spark, sf_dir).select(*pixels.COLOURS).distinct().withColumns({f"o{k}": F.col(f"c{k}") for k in range(3)})
    lab = pixels.with_lab8(old).withColumns({"l": F.col("c0"), "a": F.col("c1"), "b": F.col("c2")})
    return pixels.without_lab8(lab).select(*(F.col(f"o{k}").alias(f"c{k}") for k in range(3)), "l", "a", "b", *(F.col(f"c{k}").alias(f"b{k}") for k in range(3)))


@query(proxies.IMAGE_SQL + """, k AS (SELECT DISTINCT image_id, c0, c1, c2 FROM px), seeds AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY c0, c1, c2) - 1 AS j FROM k QUALIFY j < 6),
best AS (SELECT px.image_id, px.y, px.x, px.c0, px.c1, px.c2, s.j FROM px JOIN seeds s ON s.image_id = px.image_id QUALIFY row_number() OVER (PARTITION BY px.image_id, px.y, px.x ORDER BY pow(px.c0 - s.c0, 2) + pow(px.c1 - s.c1, 2) + pow(px.c2 - s.c2, 2), s.j) = 1)
SELECT image_id, j::INT AS j, round(avg(c0), 6) AS c0, round(avg(c1), 6) AS c1, round(avg(c2), 6) AS c2, count(*) AS n FROM best GROUP BY image_id, j""")
def palette_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of k-means from six given colours of each image."""
    px = proxies.image_pixels(spark, sf_dir)
    order = F.row_number().over(Window.partitionBy("image_id").orderBy(*pixels.COLOURS)) - 1
    seeds = px.select("image_id", *pixels.COLOURS).distinct().withColumn("j", order).filter("j < 6")
    return pixels.one_round(px, seeds).select("image_id", "j", *(_r(F.col(c)).alias(c) for c in pixels.COLOURS), "n")


@query()
def quantized_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Engine().settings["preprocessing"] | {"quantize_n_colors": 8}
    return pixels.quantized(proxies.image_pixels(spark, sf_dir), p).select("image_id", "y", "x", *pixels.COLOURS)


@query()
def denoised_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.denoised(proxies.image_pixels(spark, sf_dir)).select("image_id", "y", "x", *pixels.COLOURS)


_REGIONS = proxies.IMAGE_SQL + """, n AS (SELECT a.image_id, a.y * a.w + a.x AS p, b.y * b.w + b.x AS q FROM px a JOIN px b ON a.image_id = b.image_id AND a.c0 = b.c0 AND a.c1 = b.c1 AND a.c2 = b.c2 AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
reach AS (SELECT image_id, (y * w + x)::BIGINT AS p, (y * w + x)::BIGINT AS q FROM px UNION SELECT r.image_id, r.p, n.q::BIGINT FROM reach r JOIN n ON n.image_id = r.image_id AND n.p = r.q),
named AS (SELECT image_id, p, min(q) AS region, count(*) AS size FROM reach GROUP BY image_id, p)
"""


@query(_REGIONS + "SELECT px.image_id, y, x, region, size FROM px JOIN named ON named.image_id = px.image_id AND named.p = y * w + x")
def pixel_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.regions(proxies.image_pixels(spark, sf_dir)).select("image_id", "y", "x", "region", "size")


@query(_REGIONS + """, sides AS (SELECT a.image_id, a.y * a.w + a.x AS p, 4 - count(n.q) AS sides FROM px a LEFT JOIN n ON n.image_id = a.image_id AND n.p = a.y * a.w + a.x GROUP BY ALL)
SELECT named.image_id, region, sum(sides)::BIGINT AS sides, any_value(size)::DOUBLE AS area FROM named JOIN sides ON sides.image_id = named.image_id AND sides.p = named.p GROUP BY named.image_id, region""")
def region_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sides round each region, and the area that they enclose."""
    sides = pixels.outlines(pixels.regions(proxies.image_pixels(spark, sf_dir)))
    enclosed = F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2
    return sides.groupBy("image_id", "region").agg(F.count(F.lit(1)).alias("sides"), enclosed.alias("area"))


@query()
def traced_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.traced(proxies.image_pixels(spark, sf_dir))


@query()
def vectorized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pixels to grouped documents."""
    docs = pixels.traced(pixels.sharpened(proxies.image_pixels(spark, sf_dir))).transform(shared.stored)  # traced once, read by each stage
    return Engine().run(docs)


# ---- order-dependent merges and output ---------------------------------------


# One step looks at one group of an image; after the last one the pass is folded, until a pass moves nothing.
_MEAN = "CASE WHEN {0}.n > 0 THEN [{0}.l / {0}.n, {0}.a / {0}.n, {0}.b / {0}.n] ELSE [50.0::DOUBLE, 0, 0] END"
_TAKERS = f"""list_filter(range(1, j), lambda i: leads[i] = i AND list_distance({_MEAN.format("gs[i]")}, {_MEAN.format("gs[j]")}) <= 25
  AND sqrt(pow(greatest(0, gs[i].x0 - gs[j].x1, gs[j].x0 - gs[i].x1), 2) + pow(greatest(0, gs[i].y0 - gs[j].y1, gs[j].y0 - gs[i].y1), 2)) <= 50)"""
_OF = lambda f, c: f"{f}(list_transform(own, lambda o: gs[o].{c}))"
_FOLDED = f"""list_transform(list_transform(list_sort(list_distinct(leads)), lambda k: list_filter(range(1, len(gs) + 1), lambda i: leads[i] = k)), lambda own:
  {{'l': {_OF("list_sum", "l")}, 'a': {_OF("list_sum", "a")}, 'b': {_OF("list_sum", "b")}, 'n': {_OF("list_sum", "n")}::BIGINT, 'x0': {_OF("list_min", "x0")}, 'y0': {_OF("list_min", "y0")}, 'x1': {_OF("list_max", "x1")}, 'y1': {_OF("list_max", "y1")}, 'held': {_OF("flatten", "held")}}})"""


@query(SHAPES_SQL.replace("WITH base", "WITH RECURSIVE base") + f""", k AS (SELECT *, path_idx % 20 AS grp, row_number() OVER (PARTITION BY image_id, path_idx % 20 ORDER BY path_idx) AS ord FROM s),
g AS (SELECT image_id, grp, {{'l': coalesce(sum(ll), 0)::DOUBLE, 'a': coalesce(sum(la), 0)::DOUBLE, 'b': coalesce(sum(lb), 0)::DOUBLE, 'n': count(ll), 'x0': min(x0)::DOUBLE, 'y0': min(y0)::DOUBLE, 'x1': max(x1)::DOUBLE, 'y1': max(y1)::DOUBLE, 'held': [grp]}} AS one FROM k GROUP BY image_id, grp),
r AS (SELECT image_id, list(one ORDER BY grp) AS gs, []::BIGINT[] AS leads, 1::BIGINT AS j, false AS done FROM g GROUP BY image_id
  UNION ALL SELECT image_id, CASE WHEN j > len(gs) THEN {_FOLDED} ELSE gs END, CASE WHEN j > len(gs) THEN [] ELSE list_append(leads, coalesce({_TAKERS}[1], j)) END, CASE WHEN j > len(gs) THEN 1 ELSE j + 1 END, j > len(gs) AND len(list_distinct(leads)) = len(gs) FROM r WHERE NOT done),
f AS (SELECT image_id, unnest(range(1, len(gs) + 1)) AS m, gs FROM r WHERE done), h AS (SELECT image_id, m, unnest(gs[m].held) AS grp, unnest(range(1, len(gs[m].held) + 1)) AS place FROM f)
SELECT k.image_id, path_idx, (m - 1)::INT AS group_idx, (row_number() OVER (PARTITION BY k.image_id, m ORDER BY place, ord) - 1)::INT AS member_ord FROM k JOIN h ON h.image_id = k.image_id AND h.grp = k.grp""")
def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merge_groups(proxies.grouped(spark, sf_dir)).select("image_id", "path_idx", "group_idx", "member_ord")


_TOUCHED = "list_filter(leads, lambda t: t.x0 <= n.x1 AND n.x0 <= t.x1 AND t.y0 <= n.y1 AND n.y0 <= t.y1)"
_LEAD_SQL = f"""
n AS (SELECT *, row_number() OVER (PARTITION BY image_id, group_idx, fill, transform ORDER BY path_idx) AS nth, min(path_idx) OVER (PARTITION BY image_id, group_idx, fill, transform) AS first_idx, 'M ' || concat_ws(' ', x0, y0, 'L', x1, y0, 'L', x1, y1, 'L', x0, y1, 'Z') AS d FROM k),
r AS (SELECT n.*, path_idx AS lead, [{{'p': path_idx, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] AS leads FROM n WHERE nth = 1
  UNION ALL SELECT n.*, coalesce({_TOUCHED}[1].p, n.path_idx), CASE WHEN len({_TOUCHED}) > 0 THEN leads ELSE list_append(leads, {{'p': n.path_idx, 'x0': n.x0, 'y0': n.y0, 'x1': n.x1, 'y1': n.y1}}) END
  FROM r JOIN n ON n.image_id = r.image_id AND n.group_idx = r.group_idx AND n.fill = r.fill AND n.transform = r.transform AND n.nth = r.nth + 1)
SELECT image_id, group_idx::INT AS group_idx, lead AS path_idx, (row_number() OVER (PARTITION BY image_id, group_idx ORDER BY min(first_idx), lead) - 1)::INT AS member_ord, string_agg(d, ' ' ORDER BY path_idx) AS d FROM r GROUP BY image_id, group_idx, lead"""


@query(SHAPES_SQL.replace("WITH base", "WITH RECURSIVE base") + ", k AS (SELECT image_id, path_idx % 20 AS group_idx, path_idx, fill, transform, x0, y0, x1, y1 FROM s)," + _LEAD_SQL)
def merged_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merged_paths(proxies.grouped(spark, sf_dir), Engine().settings).select("image_id", "group_idx", "path_idx", "member_ord", "d")


@query(SHAPES_SQL.replace("WITH base", "WITH RECURSIVE base") + f", k AS (SELECT image_id, path_idx % 2 AS group_idx, path_idx, {proxies._listed(PALETTE)}[path_idx % 3 + 1] AS fill, '' AS transform, x0, y0, x1, y1 FROM s)," + _LEAD_SQL)
def merged_paths_of_few_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of some fifty paths in three fills, of which many touch."""
    fill = F.element_at(F.array(*map(F.lit, PALETTE)), (F.col("path_idx") % 3 + 1).cast("int"))
    s = proxies.shapes(spark, sf_dir).withColumn("fill", fill).withColumn("transform", F.lit(None).cast("string"))
    s = s.withColumn("group_idx", (F.col("path_idx") % 2).cast("int")).withColumn("member_ord", F.col("path_idx"))
    return merging.merged_paths(s, Engine().settings).select("image_id", "group_idx", "path_idx", "member_ord", "d")


@query()
def simplified_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.simplified_paths(proxies.shapes(spark, sf_dir), Engine().settings).select("image_id", "path_idx", "d")


@query(SHAPES_SQL + """SELECT path_idx, '<path d="M ' || concat_ws(' ', x0, y0, 'L', x1, y0, 'L', x1, y1, 'L', x0, y1, 'Z') || '"' || CASE WHEN fill <> '#ff0000' THEN ' fill="' || fill || '"' ELSE '' END || ' transform="' || transform || '"/>' AS element FROM s""")
def path_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = output.path_element(F.col("d"), F.col("fill"), F.col("stroke"), F.col("opacity"), F.col("transform"), F.lit("#ff0000"))
    return proxies.shapes(spark, sf_dir).select("path_idx", e.alias("element"))


@query()
def vectorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine().run(proxies.svg_documents(spark, sf_dir))


@query()
def vectorized_by_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine({"clustering": {"method": "graph"}, "hierarchy": {"containment_method": "bbox"}}).run(proxies.svg_documents(spark, sf_dir))


assert len(PALETTE) == 12
