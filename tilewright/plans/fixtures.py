"""Cells, rasters, slides and grids derived from the driver's tables by whole-number arithmetic, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COPY = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in window coordinates, from events."""
    events = table(spark, sf_dir, "events")
    n = events.count()
    g = max(2, int((n / 400) ** 0.5))
    e = F.col("event_id")
    rows = events.select(
        (F.col("user_id") % 4).alias("slide"), e.alias("seq"),
        (F.floor(37 * e / 11) % g).alias("icol"), (F.floor(53 * e / 7) % g).alias("irow"),
        (8 + e % 17).alias("w"), (8 + (3 * e) % 13).alias("h"), F.col("event_type").alias("cell_type"), (F.col("value") / 500).alias("prob"),
    )
    rows = rows.withColumns({"x": (7919 * F.col("seq")) % (785 - F.col("w")), "y": (104729 * F.col("seq")) % (785 - F.col("h"))})
    snap = lambda v, size: F.when(F.col(v) < 6, 0).when(F.col(v) + F.col(size) > 778, 784 - F.col(size)).otherwise(F.col(v))
    rows = rows.withColumns({"x0": snap("x", "w"), "y0": snap("y", "h")})
    rows = rows.withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.col("h"), "area": F.col("w") * F.col("h")})
    rows = rows.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
    return rows.select("slide", "seq", "icol", "irow", "y0", "y1", "x0", "x1", "cx", "cy", "area", "cell_type", "prob")


DET = """
sized AS (SELECT user_id % 4 slide, event_id seq, (SELECT greatest(2, floor(sqrt(count(*) / 400.0))::bigint) FROM events) g,
  8 + event_id % 17 w, 8 + (3 * event_id) % 13 h, event_type cell_type, value / 500 prob FROM events),
placed AS (SELECT *, (7919 * seq) % (785 - w) x, (104729 * seq) % (785 - h) y FROM sized),
snapped AS (SELECT *, CASE WHEN x < 6 THEN 0 WHEN x + w > 778 THEN 784 - w ELSE x END x0, CASE WHEN y < 6 THEN 0 WHEN y + h > 778 THEN 784 - h ELSE y END y0 FROM placed),
det AS (SELECT slide, seq, floor(37 * seq / 11.0)::bigint % g icol, floor(53 * seq / 7.0)::bigint % g irow, y0, y0 + h y1, x0, x0 + w x1,
  (x0 + x0 + w) / 2.0::double cx, (y0 + y0 + h) / 2.0::double cy, w * h area, cell_type, prob FROM snapped)"""

FLAGGED = """
flagged0 AS (SELECT *, (least(y0, y1, x0, x1) >= 64 AND greatest(y0, y1, x0, x1) <= 720) safe, (greatest(y0, y1, x0, x1) = 784 OR least(y0, y1, x0, x1) = 0) touching,
  (y0 = 0)::int at_top, (y1 = 784)::int at_down, (x0 = 0)::int at_left, (x1 = 784)::int at_right, icol * 656 - 64 off_x, irow * 656 - 64 off_y FROM det),
flagged AS (SELECT *, CASE WHEN at_top + at_down + at_left + at_right = 1 THEN [[icol + at_right - at_left, irow + at_down - at_top]]
  WHEN at_top + at_right = 2 AND at_down + at_left = 0 THEN [[icol, irow - 1], [icol + 1, irow - 1], [icol + 1, irow]]
  WHEN at_right + at_down = 2 AND at_top + at_left = 0 THEN [[icol + 1, irow], [icol + 1, irow + 1], [icol, irow + 1]]
  WHEN at_down + at_left = 2 AND at_top + at_right = 0 THEN [[icol, irow + 1], [icol - 1, irow + 1], [icol - 1, irow]]
  WHEN at_left + at_top = 2 AND at_down + at_right = 0 THEN [[icol - 1, irow], [icol - 1, irow - 1], [icol, irow - 1]] END near FROM flagged0),
projected AS (SELECT * REPLACE (y0 + off_y AS y0, y1 + off_y AS y1, x0 + off_x AS x0, x1 + off_x AS x1, round_even(cx + off_x, 0) AS cx, round_even(cy + off_y, 0) AS cy) FROM flagged)"""

RETAINED = """
rivals AS (SELECT DISTINCT slide, icol, irow FROM projected WHERE NOT safe),
retained AS (SELECT * FROM projected p WHERE safe OR NOT touching OR (near IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rivals r WHERE r.slide = p.slide AND r.icol = near[1][1] AND r.irow = near[1][2])))"""

FIRST = """
firsts AS (SELECT * FROM retained QUALIFY row_number() OVER (PARTITION BY slide, trunc(cx), trunc(cy) ORDER BY safe DESC, seq) = 1)"""

#: The bucket join only speeds DuckDB up; the conditions after it decide.
EDGES = """
bucketed AS (SELECT f.*, bx.b bx, by_.b by_ FROM firsts f, unnest(range(floor(x0 / 64.0)::bigint, floor(x1 / 64.0)::bigint + 1)) bx(b), unnest(range(floor(y0 / 64.0)::bigint, floor(y1 / 64.0)::bigint + 1)) by_(b)),
edges AS (SELECT DISTINCT a.slide, a.seq seq_a, b.seq seq_b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) inter, a.area area_a, b.area area_b
  FROM bucketed a JOIN bucketed b ON a.slide = b.slide AND a.bx = b.bx AND a.by_ = b.by_ AND a.seq < b.seq AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
  WHERE (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) * 100 >= least(a.area, b.area))"""

ROOTS = """
both_ways AS (SELECT seq_a a, seq_b b FROM edges UNION SELECT seq_b, seq_a FROM edges),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
roots AS (SELECT node, min(other) root FROM reach GROUP BY node),
rooted AS (SELECT f.*, coalesce(root, seq) root FROM firsts f LEFT JOIN roots ON seq = node),
largest AS (SELECT * FROM rooted QUALIFY row_number() OVER (PARTITION BY slide, root ORDER BY area DESC, safe DESC, seq) = 1)"""

CHAIN = ",".join((DET, FLAGGED, RETAINED, FIRST, EDGES, ROOTS))


def ras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 rasters, packed, from embeddings: values v as doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a pixel: vec_id, y, x, v, q (0 to 255), cls."""
    from ..functions.packed import quantised

    rows = ras(spark, sf_dir).withColumn("q", quantised(F.col("v")))
    rows = rows.select("vec_id", F.posexplode(F.arrays_zip("v", "q")).alias("pos", "p"))
    return rows.select("vec_id", F.floor(F.col("pos") / 8).alias("y"), (F.col("pos") % 8).cast("long").alias("x"), F.col("p.v").alias("v"), F.col("p.q").alias("q"), (F.col("p.q") % 4).alias("cls"))


RAS = """
pix0 AS (SELECT vec_id, unnest(range(64)) pos, unnest(embedding)::double v FROM embeddings),
pix1 AS (SELECT *, min(v) OVER (PARTITION BY vec_id) low, max(v) OVER (PARTITION BY vec_id) high FROM pix0),
pix AS (SELECT vec_id, pos, pos // 8 y, pos % 8 x, v, CASE WHEN high > low THEN floor((v - low) / (high - low) * 255)::int ELSE 0 END q, CASE WHEN high > low THEN (v - low) / (high - low) ELSE 0 END unit,
  CASE WHEN high > low THEN floor((v - low) / (high - low) * 255)::int ELSE 0 END % 4 cls FROM pix1)"""


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides with properties as a scanner gives them, from part: mpp, or a resolution with a unit, or neither."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        k.alias("slide_id"),
        F.when(size % 7 != 0, 0.2 + size * 0.01).alias("mpp_x"),
        F.when(k % 5 == 0, 0.5).when(k % 5 > 1, 10000.0 + k).alias("x_resolution"),
        F.when(k % 4 == 0, "cm").when(k % 4 == 1, "inch").when(k % 4 == 2, "millimeter").otherwise("pixel").alias("resolution_unit"),
        F.lit(18).alias("n_levels"),
    )
    names = {"openslide.mpp-x": F.col("mpp_x").cast("string"), "tiff.XResolution": F.col("x_resolution").cast("string"), "tiff.ResolutionUnit": F.col("resolution_unit")}
    entries = F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in names.items()])
    return rows.withColumn("properties", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))


SLIDES = """
sl0 AS (SELECT p_partkey slide_id, CASE WHEN p_size % 7 <> 0 THEN 0.2::double + p_size * 0.01::double END mpp_x,
  CASE WHEN p_partkey % 5 = 0 THEN 0.5::double WHEN p_partkey % 5 > 1 THEN 10000.0::double + p_partkey END x_resolution,
  CASE p_partkey % 4 WHEN 0 THEN 10000.0::double WHEN 1 THEN 25400.0::double WHEN 2 THEN 1000.0::double END per_unit, 18 n_levels FROM part),
sl AS (SELECT slide_id, n_levels, coalesce(mpp_x, CASE WHEN x_resolution < 1 THEN x_resolution ELSE per_unit / x_resolution END) mpp FROM sl0)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked-for tiles of each slide, from orders; numbered row by row."""
    from ..operators.tiling import numbered

    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("slide"), (k % 60).alias("col"), (F.floor(k / 60) % 60).alias("row")).distinct()
    return numbered(rows)


GRID = """
grid0 AS (SELECT DISTINCT o_custkey % 4 slide, o_orderkey % 60 col, (o_orderkey // 60) % 60 AS row_ FROM orders),
grid AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY row_, col) tile_seq FROM grid0)"""
