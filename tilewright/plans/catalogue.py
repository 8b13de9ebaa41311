"""The queries by name, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import col

from ..functions import geometry, packed, raster
from ..functions.arrangement import repaired
from ..operators import assign, dedup, pyramid, segments, tiling, tissue
from ..operators.project import project
from ..sources import documents, files, maps
from ..sources.shared import stored
from . import fixtures as fx
from .chain import fix_borders as chain
from .chain import overlaps, unique_cells

QUERIES: dict = {}
SQL: dict[str, str] = {}
CLASSES = {0: "background", 1: "round", 2: "long", 3: "small"}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- slides


def _mpp():
    return pyramid.mpp_of(col("properties"))


@query(f"WITH {fx.SLIDES} SELECT slide_id, round(mpp, 6) mpp, CASE WHEN mpp IS NULL THEN 'no_resolution' ELSE 'ok' END status FROM sl")
def slide_resolution(spark, sf_dir):
    rows = fx.slides(spark, sf_dir).withColumn("mpp", _mpp())
    return rows.select("slide_id", r6("mpp").alias("mpp"), F.when(col("mpp").isNull(), "no_resolution").otherwise("ok").alias("status"))


@query(f"WITH {fx.SLIDES} SELECT slide_id, l::int AS level, round(coalesce(mpp, 0.25) * pow(2, n_levels - 1 - l), 6) level_mpp FROM sl, unnest(range(18)) x(l)")
def level_ladder(spark, sf_dir):
    return pyramid.ladder(fx.slides(spark, sf_dir).withColumn("mpp", _mpp())).select("slide_id", "level", r6("level_mpp").alias("level_mpp"))


_STEPS = "steps AS (SELECT slide_id, l, coalesce(mpp, 0.25) * pow(2, n_levels - 1 - l) m FROM sl, unnest(range(18)) x(l))"
_NEAR = "SELECT slide_id, arg_min(l, (abs(m - {t}), l)) AS best, min(abs(m - {t})) / {t} off FROM steps GROUP BY slide_id"


@query(f"WITH {fx.SLIDES}, {_STEPS} SELECT slide_id, best::int AS level, CASE WHEN off > 0.2 THEN 'mpp_not_available' ELSE 'ok' END status FROM ({_NEAR.format(t='8.0')})")
def nearest_level(spark, sf_dir):
    level, _, status = pyramid.nearest_level(col("mpp"), col("n_levels"), 8.0)
    return fx.slides(spark, sf_dir).withColumn("mpp", _mpp()).select("slide_id", level.alias("level"), status.alias("status"))


@query(f"""WITH {fx.SLIDES}, {_STEPS}, fine AS ({_NEAR.format(t='0.25')}), half AS ({_NEAR.format(t='0.5')}),
chosen AS (SELECT slide_id, CASE WHEN f.off <= 0.2 THEN 0.25 WHEN h.off <= 0.2 THEN 0.5 END::double mpp, CASE WHEN f.off <= 0.2 THEN f.best WHEN h.off <= 0.2 THEN h.best END::int AS level FROM fine f JOIN half h USING (slide_id))
SELECT slide_id, mpp, level, CASE WHEN mpp IS NULL THEN 'mpp_not_available' ELSE 'ok' END status, CASE mpp WHEN 0.25 THEN 10 WHEN 0.5 THEN 5 END min_size, CASE mpp WHEN 0.25 THEN 21 WHEN 0.5 THEN 11 END kernel FROM chosen""")
def preferred_mpp(spark, sf_dir):
    # a column of its own: it is worked out once, not wherever it is used
    chosen, level, status = pyramid.preferred(col("finest"), col("n_levels"))
    rows = fx.slides(spark, sf_dir).withColumn("finest", _mpp()).select("slide_id", chosen.alias("mpp"), level.alias("level"), status.alias("status"))
    least, kernel = pyramid.parameters(col("mpp"))
    return rows.withColumns({"min_size": least, "kernel": kernel})


@query(f"WITH {fx.SLIDES} SELECT slide_id, round(min(coalesce(mpp, 0.25) * pow(2, n_levels - 1 - l)), 6) least_mpp, count(*) levels FROM sl, unnest(range(18)) x(l) GROUP BY slide_id")
def slide_summary(spark, sf_dir):
    rows = pyramid.ladder(fx.slides(spark, sf_dir).withColumn("mpp", _mpp()))
    return rows.groupBy("slide_id").agg(r6(F.min("level_mpp")).alias("least_mpp"), F.count("*").alias("levels"))


# ---------------------------------------------------------------- tiles


@query(f"WITH {fx.GRID} SELECT DISTINCT slide, floor(col * 224 / 328.0)::bigint col, floor(row_ * 224 / 328.0)::bigint AS row FROM grid")
def retile_windows(spark, sf_dir):
    return tiling.retile(fx.grid(spark, sf_dir), 224, tiling.core_size(), 16, 17)


@query(f"WITH {fx.GRID} SELECT slide, col, row_ AS row, tile_seq FROM grid WHERE tile_seq <= 100")
def first_n_tiles(spark, sf_dir):
    return tiling.first_tiles(fx.grid(spark, sf_dir).drop("tile_seq"), 100)


@query(f"WITH {fx.GRID} SELECT slide, col, row_ AS row, count(*) OVER (PARTITION BY slide) slide_length, 16 AS level FROM grid")
def tile_metadata(spark, sf_dir):
    return tiling.with_metadata(fx.grid(spark, sf_dir).drop("tile_seq"), 16)


@query("SELECT p_partkey slide_id, c col, r AS row FROM part, unnest(range((p_size + 3) // 4)) a(c), unnest(range((2 * p_size + 3) // 4)) b(r)")
def tile_grid(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "part").select(col("p_partkey").alias("slide_id"), col("p_size").alias("width"), (2 * col("p_size")).alias("height"))
    return tiling.grid(rows, 4).select("slide_id", col("col").cast("long").alias("col"), col("row").cast("long").alias("row"))


@query(f"WITH {fx.GRID} SELECT slide, tile_seq, (tile_seq - 1) // 8 AS batch, 'batch_' || lpad(((tile_seq - 1) // 8)::varchar, 5, '0') AS name FROM grid")
def batch_index(spark, sf_dir):
    number, name = tiling.batches(col("tile_seq"), 8)
    return fx.grid(spark, sf_dir).select("slide", "tile_seq", number.alias("batch"), name.alias("name"))


# ---------------------------------------------------------------- rasters


def _packed(spark, sf_dir):
    return fx.ras(spark, sf_dir).withColumn("q", packed.quantised(col("v")))


@query(f"WITH {fx.RAS} SELECT v.vec_id, (p // 10)::bigint y, (p % 10)::bigint x, coalesce(q, 0)::int q FROM (SELECT vec_id, unnest(range(100)) p FROM embeddings) v LEFT JOIN pix ON pix.vec_id = v.vec_id AND pix.y = p // 10 AND pix.x = p % 10 AND p % 10 < 8 AND p // 10 < 8")
def pad_tiles(spark, sf_dir):
    rows = _packed(spark, sf_dir).select("vec_id", F.posexplode(tiling.pad(col("q"), 8, 8, 10)).alias("p", "q"))
    return rows.select("vec_id", F.floor(col("p") / 10).alias("y"), (col("p") % 10).cast("long").alias("x"), "q")


_CHANNELS = "chan AS (SELECT vec_id, y, x, q r, (q * 7) % 256 g, (q * 13) % 256 b FROM pix)"


@query(f"WITH {fx.RAS}, {_CHANNELS} SELECT vec_id, y, x, round((r / 255.0::double - 0.485) / 0.229, 6) r, round((g / 255.0::double - 0.456) / 0.224, 6) g, round((b / 255.0::double - 0.406) / 0.225, 6) b, round(0.2125::double * r + 0.7152::double * g + 0.0722::double * b, 6) gray FROM chan")
def channel_normalise(spark, sf_dir):
    rows = fx.pixels(spark, sf_dir).select("vec_id", "y", "x", col("q").alias("r"), ((col("q") * 7) % 256).alias("g"), ((col("q") * 13) % 256).alias("b"))
    return rows.select("vec_id", "y", "x", *[r6(packed.normalised(col(c), i)).alias(c) for i, c in enumerate("rgb")], r6(packed.gray(col("r"), col("g"), col("b"))).alias("gray"))


_OTSU = """
hist AS (SELECT vec_id, q::bigint v, count(*) n FROM pix GROUP BY ALL),
sums AS (SELECT *, sum(n) OVER (PARTITION BY vec_id ORDER BY v) w, sum(n * v) OVER (PARTITION BY vec_id ORDER BY v) s, sum(n) OVER (PARTITION BY vec_id) n_all, sum(n * v) OVER (PARTITION BY vec_id) s_all FROM hist),
vars AS (SELECT *, CASE WHEN w < n_all THEN round((s * n_all - s_all * w)::double * (s * n_all - s_all * w)::double / (w * (n_all - w))::double, 6) ELSE -1.0 END between_ FROM sums),
thresholds AS (SELECT vec_id, v threshold FROM vars QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY between_ DESC, v) = 1)"""


@query(f"WITH {fx.RAS}, {_OTSU} SELECT * FROM thresholds")
def otsu_threshold(spark, sf_dir):
    return tissue.otsu(fx.pixels(spark, sf_dir))


_BLOCKS = "blocks AS (SELECT vec_id, y // 4 AS row, x // 4 col, avg((q > threshold)::int) share FROM pix JOIN thresholds USING (vec_id) GROUP BY ALL)"


@query(f"WITH {fx.RAS}, {_OTSU}, {_BLOCKS} SELECT * FROM blocks")
def tissue_blocks(spark, sf_dir):
    rows = fx.pixels(spark, sf_dir)
    return tissue.blocks(tissue.bright(rows, tissue.otsu(rows)), 4, 8, 8)


@query(f"WITH {fx.RAS}, {_OTSU}, {_BLOCKS} SELECT vec_id, col, row FROM blocks WHERE share < 0.2")
def tissue_detect(spark, sf_dir):
    return tissue.tissue_tiles(fx.pixels(spark, sf_dir), 4, 8, 8).select("vec_id", "col", "row")


@query(f"WITH {fx.RAS} SELECT vec_id, y // 2 AS y, x // 2 AS x, avg(q) q FROM pix GROUP BY vec_id, y // 2, x // 2")
def thumbnail(spark, sf_dir):
    return tissue.thumbnail(fx.pixels(spark, sf_dir), 2, ("q",), ("vec_id",))


@query(f"WITH {fx.RAS} SELECT vec_id, pos::int pos, round(unit, 6) value FROM pix")
def minmax_map(spark, sf_dir):
    rows = fx.ras(spark, sf_dir).select("vec_id", F.posexplode(packed.minmax(col("v"))).alias("pos", "value"))
    return rows.withColumn("value", r6("value"))


_AROUND = "around AS (SELECT vec_id, pos, y, x, q, dy, dx, CASE WHEN y + dy < 0 THEN 1 WHEN y + dy > 7 THEN 6 ELSE y + dy END yy, CASE WHEN x + dx < 0 THEN 1 WHEN x + dx > 7 THEN 6 ELSE x + dx END xx FROM pix, unnest([-1, 0, 1]) a(dy), unnest([-1, 0, 1]) b(dx))"
_NEXT = "FROM around a JOIN pix p ON p.vec_id = a.vec_id AND p.y = a.yy AND p.x = a.xx GROUP BY a.vec_id, a.pos"


def _filtered(spark, sf_dir, **kernels):
    rows = _packed(spark, sf_dir).select("vec_id", F.arrays_zip(*[packed.filtered(col("q"), 8, 8, k).alias(n) for n, k in kernels.items()]).alias("z"))
    rows = rows.select("vec_id", F.posexplode("z").alias("pos", "z"))
    return rows.select("vec_id", "pos", *[col(f"z.{n}").cast("long").alias(n) for n in kernels])


@query(f"WITH {fx.RAS}, {_AROUND} SELECT a.vec_id, a.pos::int pos, sum(p.q * (2 - abs(dy)) * (2 - abs(dx)))::bigint g16 {_NEXT}")
def gauss3(spark, sf_dir):
    return _filtered(spark, sf_dir, g16=packed.GAUSS)


@query(f"WITH {fx.RAS}, {_AROUND} SELECT a.vec_id, a.pos::int pos, sum(p.q * dx * (2 - abs(dy)))::bigint gx, sum(p.q * dy * (2 - abs(dx)))::bigint gy {_NEXT}")
def sobel3(spark, sf_dir):
    return _filtered(spark, sf_dir, gx=packed.SOBEL_X, gy=packed.SOBEL_Y)


_LABELS = """
fg AS (SELECT vec_id, pos, y, x, cls FROM pix WHERE q >= 128),
steps AS (SELECT a.vec_id, a.pos a, b.pos b FROM fg a JOIN fg b ON a.vec_id = b.vec_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
reach(vec_id, a, b) AS (SELECT vec_id, pos, pos FROM fg UNION SELECT r.vec_id, r.a, s.b FROM reach r JOIN steps s ON s.vec_id = r.vec_id AND s.a = r.b),
named AS (SELECT vec_id, a pos, min(b) inst FROM reach GROUP BY ALL),
inst AS (SELECT f.*, inst FROM fg f JOIN named USING (vec_id, pos))"""


def _stacked(column: pd.Series) -> np.ndarray:
    """A batch of packed 8 x 8 rasters as (n, 8, 8)."""
    return np.concatenate(column.to_list()).reshape(-1, 8, 8) if len(column) else np.zeros((0, 8, 8), int)


def _kernel_rows(size: int) -> str:
    smooth, slope = raster.kernels(size)
    return ", ".join(f"({i - size // 2}, {int(a)}, {int(b)})" for i, (a, b) in enumerate(zip(smooth, slope, strict=True)))


_MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"


@query(f"""WITH {fx.RAS}, k(d, smooth, slope) AS (VALUES {_kernel_rows(11)}),
rows_ AS (SELECT a.vec_id, a.y, a.x, sum(p.q * smooth)::bigint s, sum(p.q * slope)::bigint g FROM pix a, k JOIN pix p ON p.vec_id = a.vec_id AND p.y = a.y AND p.x = {_MIRROR.format('(a.x + d)')} GROUP BY ALL)
SELECT a.vec_id, (a.y * 8 + a.x)::int pos, sum(p.g * smooth)::bigint gx, sum(p.s * slope)::bigint gy FROM rows_ a, k JOIN rows_ p ON p.vec_id = a.vec_id AND p.x = a.x AND p.y = {_MIRROR.format('(a.y + d)')} GROUP BY ALL""")
def sobel11(spark, sf_dir):
    """The derivative kernel of the coarser working resolution, all rasters of a batch at once."""

    def run(batches):
        for batch in batches:
            x = _stacked(batch.column(1).to_pandas())
            both = [np.rint(raster.sobel(x, 11, axis)).astype(np.int64).ravel() for axis in (1, 0)]
            ids, pos = np.repeat(batch.column(0).to_numpy(), 64), np.tile(np.arange(64, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids, pos, *both)], ["vec_id", "pos", "gx", "gy"])

    return _packed(spark, sf_dir).select("vec_id", "q").mapInArrow(run, "vec_id long, pos int, gx long, gy long")


_DISC = ", ".join(f"({y - 2}, {x - 2})" for y, x in zip(*np.nonzero(raster.DISC), strict=True))


@query(f"""WITH {fx.RAS}, disc(dy, dx) AS (VALUES {_DISC}), on_ AS (SELECT vec_id, y, x, (q >= 128)::int m FROM pix),
eroded AS (SELECT a.vec_id, a.y, a.x, min(p.m) m FROM on_ a, disc JOIN on_ p ON p.vec_id = a.vec_id AND p.y = a.y + dy AND p.x = a.x + dx GROUP BY ALL)
SELECT a.vec_id, (a.y * 8 + a.x)::int pos, max(p.m)::int opened FROM eroded a, disc JOIN eroded p ON p.vec_id = a.vec_id AND p.y = a.y + dy AND p.x = a.x + dx GROUP BY ALL""")
def opening5(spark, sf_dir):
    @F.pandas_udf("array<int>")
    def opened(q: pd.Series) -> pd.Series:
        x = _stacked(q)
        return pd.Series(list(raster.opening(x >= 128).astype(np.int32).reshape(len(x), 64)))

    return _packed(spark, sf_dir).select("vec_id", F.posexplode(opened("q")).alias("pos", "opened"))


def _instances(spark, sf_dir):
    """Foreground pixels with the least position of their component: labelled tile by tile in numpy."""
    @F.pandas_udf("array<int>")
    def labelled(q: pd.Series) -> pd.Series:
        at = _stacked(q) >= 128
        n = len(at)
        labels = raster.label(np.pad(at, ((0, 0), (0, 1), (0, 0))).reshape(9 * n, 8)).reshape(n, 9, 8)[:, :8].reshape(-1)  # an empty row between rasters
        _, first = np.unique(labels, return_index=True)
        if not labels.all():
            first[0] = -1
        else:
            first = np.concatenate(([-1], first))
        out = np.where(first[labels] < 0, -1, first[labels] % 64).reshape(n, 64).astype(np.int32)
        return pd.Series(list(out))

    rows = _packed(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip("q", labelled("q").alias("inst"))).alias("pos", "p"))
    rows = rows.select("vec_id", "pos", col("p.inst").alias("inst"), (col("p.q") % 4).alias("cls")).where("inst >= 0")
    return rows.withColumns({"y": F.floor(col("pos") / 8), "x": (col("pos") % 8).cast("long")})


@query(f"WITH RECURSIVE {fx.RAS}, {_LABELS} SELECT vec_id, inst::int inst, count(*) size FROM inst GROUP BY ALL HAVING count(*) >= 3")
def pixel_components(spark, sf_dir):
    return _instances(spark, sf_dir).groupBy("vec_id", "inst").agg(F.count("*").alias("size")).where("size >= 3")


@query(f"WITH RECURSIVE {fx.RAS}, {_LABELS} SELECT vec_id, inst::int inst, min(y) y0, max(y) + 1 y1, min(x) x0, max(x) + 1 x1, round(avg(x), 6) cx, round(avg(y), 6) cy FROM inst GROUP BY ALL")
def instance_bbox_centroid(spark, sf_dir):
    g = _instances(spark, sf_dir).groupBy("vec_id", "inst")
    return g.agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), r6(F.avg("x")).alias("cx"), r6(F.avg("y")).alias("cy"))


_MAJORITY = """
votes0 AS (SELECT vec_id, inst, cls, count(*) n FROM inst GROUP BY vec_id, inst, cls),
votes AS (SELECT *, sum(n) OVER (PARTITION BY vec_id, inst) size FROM votes0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY vec_id, inst ORDER BY n DESC, cls) k FROM votes),
picked AS (SELECT vec_id, inst::int inst, cls, round(n / (size + 1e-6), 6) prob FROM ordered WHERE cls <> 0 AND k <= 2 QUALIFY row_number() OVER (PARTITION BY vec_id, inst ORDER BY k) = 1)"""


def _majority(spark, sf_dir):
    from pyspark.sql import Window

    votes = _instances(spark, sf_dir).groupBy("vec_id", "inst", "cls").agg(F.count("*").alias("n"))
    w = Window.partitionBy("vec_id", "inst")
    rows = votes.withColumns({"size": F.sum("n").over(w), "k": F.row_number().over(w.orderBy(F.desc("n"), "cls"))}).where("cls <> 0 AND k <= 2")
    best = rows.groupBy("vec_id", "inst").agg(F.min_by(F.struct("cls", "n", "size"), "k").alias("b"))
    return best.select("vec_id", "inst", col("b.cls").alias("cls"), r6(col("b.n") / (col("b.size") + 1e-6)).alias("prob"))


@query(f"WITH RECURSIVE {fx.RAS}, {_LABELS}, {_MAJORITY} SELECT * FROM picked")
def majority_class(spark, sf_dir):
    return _majority(spark, sf_dir)


@query(f"WITH RECURSIVE {fx.RAS}, {_LABELS}, {_MAJORITY}, names(cls, name) AS (VALUES (0, 'background'), (1, 'round'), (2, 'long'), (3, 'small')) SELECT vec_id, inst, name FROM picked JOIN names USING (cls)")
def class_names(spark, sf_dir):
    names = spark.createDataFrame(list(CLASSES.items()), "cls int, name string")  # a row a class
    return _majority(spark, sf_dir).join(F.broadcast(names), "cls").select("vec_id", "inst", "name")


@query(f"""WITH {fx.RAS}, soft AS (SELECT vec_id, y, x, v, exp(v - max(v) OVER w) e, max(v) OVER w high FROM pix WINDOW w AS (PARTITION BY vec_id, y))
SELECT vec_id, y::int channel_row, round(max(CASE WHEN x = 1 THEN e END) / sum(e), 6) p1, min(CASE WHEN v = high THEN x END)::int AS cls FROM soft GROUP BY vec_id, y""")
def map_heads(spark, sf_dir):
    rows = fx.ras(spark, sf_dir).withColumn("channel_row", F.explode(F.sequence(F.lit(0), F.lit(7))))
    part = F.slice("v", col("channel_row") * 8 + 1, F.lit(8))
    return rows.select("vec_id", "channel_row", r6(F.element_at(packed.softmax(part), 2)).alias("p1"), packed.arg_max(part).alias("cls"))


# ---------------------------------------------------------------- cells


@query(f"WITH {fx.DET}, {fx.FLAGGED} SELECT slide, seq, off_x, off_y, y0, y1, x0, x1, cx, cy FROM projected")
def project_cells(spark, sf_dir):
    return project(fx.det(spark, sf_dir)).select("slide", "seq", "off_x", "off_y", "y0", "y1", "x0", "x1", "cx", "cy")


@query(f"WITH {fx.DET}, {fx.FLAGGED} SELECT slide, seq, safe, touching, at_top, at_down, at_left, at_right FROM flagged")
def cell_flags(spark, sf_dir):
    return project(fx.det(spark, sf_dir)).select("slide", "seq", "safe", "touching", "at_top", "at_down", "at_left", "at_right")


@query(f"WITH {fx.DET}, {fx.FLAGGED} SELECT slide, seq, (i - 1)::int AS ordinal, near[i][1] || '_' || near[i][2] tile FROM flagged, unnest(range(1, 4)) t(i) WHERE near IS NOT NULL AND i <= len(near)")
def neighbour_tiles(spark, sf_dir):
    rows = project(fx.det(spark, sf_dir)).select("slide", "seq", F.posexplode("border_tiles").alias("ordinal", "t"))
    return rows.select("slide", "seq", "ordinal", F.concat_ws("_", "t.col", "t.row").alias("tile"))


def _stored_cells(spark, sf_dir):
    """The cells as a table of their own, as detections are: the chain reads them several times, and would repeat the expressions that they come from."""
    return stored(fx.det(spark, sf_dir), "detections")


@query(f"WITH {fx.DET}, {fx.FLAGGED}, {fx.RETAINED} SELECT slide, seq, safe, touching FROM retained")
def border_retention(spark, sf_dir):
    return dedup.retain_border(project(_stored_cells(spark, sf_dir))).select("slide", "seq", "safe", "touching")


_COPIES = f"doubled AS (SELECT * FROM retained UNION ALL SELECT * REPLACE (seq + {fx.COPY} AS seq, false AS safe) FROM retained WHERE seq % 10 = 0)"


@query(f"WITH {fx.DET}, {fx.FLAGGED}, {fx.RETAINED}, {_COPIES} SELECT slide, seq, safe FROM doubled QUALIFY row_number() OVER (PARTITION BY slide, trunc(cx), trunc(cy) ORDER BY safe DESC, seq) = 1")
def keep_first(spark, sf_dir):
    rows = dedup.retain_border(project(_stored_cells(spark, sf_dir)))
    copies = rows.where("seq % 10 = 0").withColumns({"seq": col("seq") + fx.COPY, "safe": F.lit(False)})
    return dedup.keep_first(rows.unionByName(copies)).select("slide", "seq", "safe")


def _pairs(spark, sf_dir):
    return overlaps(project(_stored_cells(spark, sf_dir)))


@query(f"WITH {','.join((fx.DET, fx.FLAGGED, fx.RETAINED, fx.FIRST, fx.EDGES))} SELECT slide, seq_a, seq_b, inter, round(inter / area_a::double, 6) ratio_a, round(inter / area_b::double, 6) ratio_b FROM edges")
def overlap_edges(spark, sf_dir):
    _, edges = _pairs(spark, sf_dir)
    return edges.select(col("slide_a").alias("slide"), "seq_a", "seq_b", col("box_area").alias("inter"), r6("ratio_a").alias("ratio_a"), r6("ratio_b").alias("ratio_b"))


#: Octagons as half-planes nx * X + ny * Y <= d, relative to the corner of cell a's box. The common area of two is that of the points where two of their sixteen
#: lines cross within all of them, taken in the order of their angle.
_POLY = """
meets AS (SELECT DISTINCT a.slide, a.seq sa, b.seq sb, a.x0 ox, a.y0 oy FROM bucketed a JOIN bucketed b ON a.slide = b.slide AND a.bx = b.bx AND a.by_ = b.by_ AND a.seq < b.seq AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
sides AS (SELECT sa, sb, s, (x0 - ox)::double x0, (x1 - ox)::double x1, (y0 - oy)::double y0, (y1 - oy)::double y1, (x1 - x0) / 4::double a, (y1 - y0) / 4::double b
  FROM (SELECT *, sa seq, 0 s FROM meets UNION ALL SELECT *, sb, 8 FROM meets) JOIN firsts f USING (seq)),
planes AS (SELECT sa, sb, s + k k, [-1, 1, 0, 0, -b, b, b, -b][k] nx, [0, 0, -1, 1, -a, -a, a, a][k] ny,
  [-x0, x1, -y0, y1, -(b * x0 + a * y0 + a * b), b * x1 - a * y0 - a * b, b * x1 + a * y1 - a * b, -b * x0 + a * y1 - a * b][k] d FROM sides, unnest(range(1, 9)) t(k)),
crossed AS (SELECT l.sa, l.sb, (l.d * m.ny - m.d * l.ny) / (l.nx * m.ny - m.nx * l.ny) px, (l.nx * m.d - m.nx * l.d) / (l.nx * m.ny - m.nx * l.ny) py
  FROM planes l JOIN planes m ON l.sa = m.sa AND l.sb = m.sb AND l.k < m.k WHERE l.nx * m.ny <> m.nx * l.ny),
corners AS (SELECT DISTINCT sa, sb, round(px, 11) px, round(py, 11) py FROM (SELECT c.sa, c.sb, px, py FROM crossed c JOIN planes p ON c.sa = p.sa AND c.sb = p.sb GROUP BY ALL HAVING max(p.nx * px + p.ny * py - p.d) <= 1e-9)),
turned AS (SELECT *, atan2(py - avg(py) OVER w, px - avg(px) OVER w) angle FROM corners WINDOW w AS (PARTITION BY sa, sb)),
ring AS (SELECT *, coalesce(lead(px) OVER w, first_value(px) OVER w) qx, coalesce(lead(py) OVER w, first_value(py) OVER w) qy FROM turned WINDOW w AS (PARTITION BY sa, sb ORDER BY angle)),
common AS (SELECT sa, sb, abs(sum(px * qy - qx * py)) / 2 inter FROM ring GROUP BY ALL)"""


@query(f"""WITH {','.join((fx.DET, fx.FLAGGED, fx.RETAINED, fx.FIRST, fx.EDGES, _POLY))}
SELECT m.slide, sa seq_a, sb seq_b, round(inter, 6) inter FROM meets m JOIN common USING (sa, sb) JOIN firsts a ON a.seq = sa JOIN firsts b ON b.seq = sb WHERE inter / (0.875 * least(a.area, b.area)) >= 0.01""")
def overlap_edges_poly(spark, sf_dir):
    """The same with octagons in the boxes, verified on the polygons."""
    cells = project(_stored_cells(spark, sf_dir))
    a, b = (col("x1") - col("x0")) / 4, (col("y1") - col("y0")) / 4
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, x1, y0, y1 = (col(c) for c in ("x0", "x1", "y0", "y1"))
    ring = F.array(at(x0 + a, y0), at(x1 - a, y0), at(x1, y0 + b), at(x1, y1 - b), at(x1 - a, y1), at(x0 + a, y1), at(x0, y1 - b), at(x0, y0 + b))
    # a corner cut off an octagon has an eighth of a quarter of the box
    cells = cells.withColumn("contour", ring).withColumn("area", col("area") * 0.875)
    _, edges = overlaps(cells, polygons=True)
    return edges.select(col("slide_a").alias("slide"), "seq_a", "seq_b", r6("inter").alias("inter"))


@query("""WITH bows AS (SELECT event_id, (4 + event_id % 9)::double a, (1 + event_id % 5)::double b, (1 + event_id % 7)::double c FROM events)
SELECT event_id, round(a * greatest(b, c) * greatest(b, c) / (2 * (b + c)), 6) area, CASE WHEN b = c THEN NULL ELSE round(CASE WHEN b > c THEN 0 ELSE a * b / (b + c) END, 6) END AS left, CASE WHEN b = c THEN NULL ELSE round(CASE WHEN b > c THEN a * b / (b + c) ELSE a END, 6) END AS right FROM bows""")
def bow_ties(spark, sf_dir):
    """Rings of two triangles that cross in a point: the larger one stays."""
    k = col("event_id")
    sizes = fx.table(spark, sf_dir, "events").select("event_id", (4 + k % 9).cast("double").alias("a"), (1 + k % 5).cast("double").alias("b"), (1 + k % 7).cast("double").alias("c"))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    rows = repaired(sizes.withColumn("contour", F.array(at(zero, zero), at(col("a"), col("c")), at(col("a"), zero), at(zero, col("b")))))
    across = F.filter("outline", lambda v, i: i % 2 == 0)
    side = lambda f: F.when(col("b") != col("c"), r6(f(across)))
    return rows.select("event_id", r6("area").alias("area"), side(F.array_min).alias("left"), side(F.array_max).alias("right"))


@query(f"WITH RECURSIVE {fx.CHAIN} SELECT node seq, root FROM roots")
def components(spark, sf_dir):
    from ..operators.components import components as found

    _, edges = _pairs(spark, sf_dir)
    return found(edges, "seq_a", "seq_b").select(col("node").alias("seq"), "root")


@query(f"WITH RECURSIVE {fx.CHAIN} SELECT slide, root, count(*) size, string_agg(seq::varchar, ',' ORDER BY seq) members FROM rooted GROUP BY slide, root HAVING count(*) > 1")
def component_members(spark, sf_dir):
    from ..operators.components import components as found

    cells, edges = _pairs(spark, sf_dir)
    rows = cells.join(found(edges, "seq_a", "seq_b"), F.col("seq") == F.col("node")).groupBy("slide", "root")
    return rows.agg(F.count("*").alias("size"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list("seq")), lambda x: x.cast("string"))).alias("members"))


@query(f"WITH RECURSIVE {fx.CHAIN} SELECT slide, root, seq, area FROM largest")
def max_area_cell(spark, sf_dir):
    return unique_cells(_stored_cells(spark, sf_dir)).select("slide", "root", "seq", "area")


@query(f"WITH {fx.DET}, {fx.FLAGGED} SELECT slide, seq, y0 * 0.5 y0, y1 * 0.5 y1, x0 * 0.5 x0, x1 * 0.5 x1, cx * 0.5 cx, cy * 0.5 cy FROM projected".replace("0.5", "0.5::double"))
def rescale_cells(spark, sf_dir):
    return assign.rescale(project(fx.det(spark, sf_dir)), pyramid.scale(17, 16)).select("slide", "seq", "y0", "y1", "x0", "x1", "cx", "cy")


_HALF = "half AS (SELECT slide s, seq, safe, cell_type, prob, y0 * 0.5::double y0, y1 * 0.5::double y1, x0 * 0.5::double x0, x1 * 0.5::double x1, cx * 0.5::double cx, cy * 0.5::double cy FROM {source})"
_TILED = "tiled AS (SELECT g.*, h.*, row_number() OVER (PARTITION BY slide, tile_seq ORDER BY safe DESC, seq) - 1 k FROM grid g LEFT JOIN half h ON s = slide AND floor(cx / 224)::bigint = col AND floor(cy / 224)::bigint = row_)"
_LOCAL = "y0 - row_ * 224 y0, y1 - row_ * 224 y1, x0 - col * 224 x0, x1 - col * 224 x1, cx - col * 224 cx, cy - row_ * 224 cy"


@query(f"WITH {fx.DET}, {fx.FLAGGED}, {fx.GRID}, {_HALF.format(source='projected')}, {_TILED} SELECT slide, tile_seq, col, row_ AS row, seq, {_LOCAL} FROM tiled")
def back_assign(spark, sf_dir):
    rows = assign.assign(fx.grid(spark, sf_dir), assign.rescale(project(fx.det(spark, sf_dir)), 0.5))
    return rows.select("slide", "tile_seq", "col", "row", "seq", "y0", "y1", "x0", "x1", "cx", "cy")


@query(f"WITH {fx.DET}, {fx.FLAGGED}, {fx.GRID}, {_HALF.format(source='projected')}, {_TILED} SELECT slide, tile_seq, seq, CASE WHEN seq IS NOT NULL THEN k END::int cell_id FROM tiled")
def number_cells(spark, sf_dir):
    rows = assign.assign(fx.grid(spark, sf_dir), assign.rescale(project(fx.det(spark, sf_dir)), 0.5))
    return assign.number(rows).select("slide", "tile_seq", "seq", "cell_id")


@query(f"WITH {fx.DET} SELECT seq, 5 AS points, area::double area FROM det")
def ring_close_area(spark, sf_dir):
    at = lambda x, y: F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))
    rows = fx.det(spark, sf_dir).withColumn("ring", F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1")))
    rings = rows.withColumn("whole", geometry.closed(col("ring")))
    return rings.select("seq", F.size("whole").alias("points"), geometry.shoelace(col("whole")).alias("area"))


def _document_rows(spark, sf_dir):
    """Cells in their windows as tiles of a document."""
    from pyspark.sql import Window

    at = Window.partitionBy("slide", "icol", "irow").orderBy("seq")
    rows = fx.det(spark, sf_dir).withColumn("cell_id", F.row_number().over(at) - 1)
    corner = lambda x, y: F.array(col(x).cast("double"), col(y).cast("double"))
    return rows.select(
        "slide", (col("irow") * 100_000 + col("icol")).alias("tile_seq"), F.lit(17).alias("level"), col("icol").alias("x"), col("irow").alias("y"), F.lit(784).alias("width"), F.lit(784).alias("height"),
        "cell_id", "cell_type", col("prob").alias("confidence"), F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")).alias("coordinates"), F.array("cx", "cy").alias("centroid"),
    )


@query(f"""WITH {fx.DET} SELECT slide, 'cells' model_name, 0.25::double inference_mpp, 17 AS level, icol::int x, irow::int y, 784 width, 784 height, (row_number() OVER (PARTITION BY slide, icol, irow ORDER BY seq) - 1)::double cell_id,
cell_type, prob confidence, cx, cy, x0::double first_x, y1::double last_y, 4 AS points FROM det""")
def json_round_trip(spark, sf_dir):
    text = documents.to_text(documents.nest(_document_rows(spark, sf_dir), "cells", 0.25))
    rows = documents.cells_of(documents.parse(text), "slide")
    return rows.select(
        "slide", "model_name", "inference_mpp", "level", "x", "y", "width", "height", "cell_id", "cell_type", "confidence",
        col("centroid")[0].alias("cx"), col("centroid")[1].alias("cy"), col("coordinates")[0][0].alias("first_x"), col("coordinates")[3][1].alias("last_y"), F.size("coordinates").alias("points"),
    )


@query(f"WITH RECURSIVE {fx.CHAIN}, {fx.GRID}, {_HALF.format(source='largest')}, {_TILED} SELECT slide, tile_seq, col, row_ AS row, seq, CASE WHEN seq IS NOT NULL THEN k END::int cell_id, cell_type, {_LOCAL} FROM tiled")
def fix_borders(spark, sf_dir):
    rows = chain(_stored_cells(spark, sf_dir), fx.grid(spark, sf_dir), ratio=0.5)
    return rows.select("slide", "tile_seq", "col", "row", "seq", "cell_id", "cell_type", "y0", "y1", "x0", "x1", "cx", "cy")


# ---------------------------------------------------------------- files and maps


@query("SELECT page_id, coalesce(regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+'), false) is_url FROM pages")
def url_predicate(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", files.is_url(col("url")).alias("is_url"))


@query("""WITH names AS (SELECT p_size, p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'maps' ELSE concat('maps_', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.npy' ELSE '' END) END AS name FROM part)
SELECT p_partkey, name, row_number() OVER (PARTITION BY p_size ORDER BY try_cast(nullif(regexp_extract(name, '([0-9]+)(\\.[^./]*)?$', 1), '') AS hugeint) NULLS FIRST, name, p_partkey) place FROM names""")
def suffix_order(spark, sf_dir):
    """Files of a group in the order of the number at the end of their names."""
    k = col("p_partkey")
    name = F.when(k % 5 == 0, "maps").otherwise(F.concat(F.lit("maps_"), k.cast("string"), F.when(k % 3 == 0, ".npy").otherwise("")))
    rows = fx.table(spark, sf_dir, "part").select("p_size", "p_partkey", name.alias("name"))
    order = Window.partitionBy("p_size").orderBy(files.suffix_number(col("name")), "name", "p_partkey")
    return rows.select("p_partkey", "name", F.row_number().over(order).cast("long").alias("place"))


@query()
def collect_paths(spark, sf_dir):
    rows = files.collect_paths(spark, [f"{sf_dir}/r*.parquet", f"{sf_dir}/*.parquet"])
    return rows.select("arg", F.element_at(F.split("path", "/"), -1).alias("name"))


@query()
def file_hash(spark, sf_dir):
    return files.hashes(spark, f"{sf_dir}/region.parquet")


_BASINS = f"""{fx.RAS},
inner_ AS MATERIALIZED (SELECT vec_id, pos, y, x, v, q FROM pix WHERE q < 200),
beside AS MATERIALIZED (SELECT p.vec_id, p.pos, p.v, n.pos npos, n.v nv FROM inner_ p JOIN inner_ n ON p.vec_id = n.vec_id AND abs(p.y - n.y) + abs(p.x - n.x) = 1),
marker AS MATERIALIZED (SELECT vec_id, pos, v FROM inner_ p WHERE q < 90 AND NOT EXISTS (SELECT 1 FROM beside b WHERE b.vec_id = p.vec_id AND b.pos = p.pos AND b.nv <= b.v)),
wet AS MATERIALIZED (SELECT * FROM beside b ANTI JOIN marker m ON m.vec_id = b.vec_id AND m.pos = b.pos),
floods(vec_id, pos, height) AS (SELECT vec_id, pos, v FROM marker UNION SELECT w.vec_id, w.pos, greatest(f.height, w.v) FROM floods f JOIN wet w ON w.vec_id = f.vec_id AND w.npos = f.pos),
height_of AS MATERIALIZED (SELECT vec_id, pos, min(height) h FROM floods GROUP BY ALL),
from_ AS MATERIALIZED (SELECT w.vec_id, w.pos, w.npos FROM wet w JOIN height_of h ON h.vec_id = w.vec_id AND h.pos = w.npos QUALIFY h = min(h) OVER (PARTITION BY w.vec_id, w.pos)),
named(vec_id, pos, label) AS (SELECT vec_id, pos, pos + 1 FROM marker UNION SELECT f.vec_id, f.pos, n.label FROM named n JOIN from_ f ON f.vec_id = n.vec_id AND f.npos = n.pos),
basin AS MATERIALIZED (SELECT vec_id, pos // 8 y, pos % 8 x, pos, label FROM named)"""


def _basins(spark, sf_dir):
    rows = fx.ras(spark, sf_dir).withColumn("q", packed.quantised(col("v"))).withColumn("inside", F.transform("q", lambda q: q < 200))
    rows = rows.withColumn("least", segments.minima(col("v"), 8, 8, col("inside")))
    number = F.transform(F.arrays_zip("least", "q"), lambda s, i: F.when(s["least"] & (s["q"] < 90), i + 1).otherwise(0))
    return segments.basins(rows.withColumn("markers", number), "vec_id", 8, 8, "v")


@query(f"WITH RECURSIVE {_BASINS} SELECT vec_id, y, x, label FROM basin")
def watershed_basins(spark, sf_dir):
    """Rasters flooded from their deep minima: shallow ones are drowned by the flood that comes first, and basins touch."""
    return _basins(spark, sf_dir)


@query(f"""WITH RECURSIVE {_BASINS},
ways AS (SELECT d::bigint d, [0, 1, 1, 1, 0, -1, -1, -1][d + 1] dy, [1, 1, 0, -1, -1, -1, 0, 1][d + 1] dx FROM range(8) t(d)),
alike AS MATERIALIZED (SELECT a.vec_id, a.label, a.pos, d, b.pos npos FROM basin a, ways JOIN basin b ON b.vec_id = a.vec_id AND b.label = a.label AND b.y = a.y + dy AND b.x = a.x + dx),
turns AS MATERIALIZED (SELECT vec_id, label, pos, look, d, npos FROM alike, (SELECT look::bigint look FROM range(8) t(look)) QUALIFY row_number() OVER (PARTITION BY vec_id, label, pos, look ORDER BY (d - look + 15) % 8) = 1),
starts AS MATERIALIZED (SELECT t.* FROM turns t JOIN (SELECT vec_id, label, min(pos) pos FROM basin GROUP BY ALL) USING (vec_id, label, pos) WHERE look = 4),
walk(vec_id, label, i, pos, d, npos) AS (SELECT vec_id, label, 0, pos, d, npos FROM starts
  UNION ALL SELECT w.vec_id, w.label, w.i + 1, t.pos, t.d, t.npos FROM walk w JOIN turns t ON t.vec_id = w.vec_id AND t.label = w.label AND t.pos = w.npos AND t.look = (w.d + 4) % 8
  JOIN starts s ON s.vec_id = w.vec_id AND s.label = w.label WHERE t.pos <> s.pos OR t.d <> s.d),
bends AS (SELECT *, coalesce(lag(d) OVER (PARTITION BY vec_id, label ORDER BY i), last_value(d) OVER (PARTITION BY vec_id, label ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) before,
  count(*) OVER (PARTITION BY vec_id, label) n FROM walk)
SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id, label ORDER BY i) - 1 AS ordinal, pos % 8 x, pos // 8 y FROM bends WHERE n > 2 AND d <> before""")
def basin_corners(spark, sf_dir):
    """Corner points of the border of every basin."""
    return segments.corners(_basins(spark, sf_dir), "vec_id", 8, 8)


@query("""WITH keys AS (SELECT n_regionkey::varchar slide_id, (n_nationkey % 5)::int icol, (n_nationkey // 5)::int irow FROM nation),
hashed AS (SELECT *, (ascii(slide_id) * 7919 + icol * 104729 + irow * 1299709 + i * 15485863) % 2147483647 h FROM keys, unnest(range(6)) t(i)),
sized AS (SELECT *, 5 + h % 8 r FROM hashed),
placed AS (SELECT *, i % 3 * 42 + r + 2 + h // 256 % (38 - 2 * r) x, i // 3 * 42 + r + 2 + h // 65536 % (38 - 2 * r) y FROM sized)
SELECT slide_id, icol, irow, (y - r)::double top, (y + r + 1)::double down, (x - r)::double AS left, (x + r + 1)::double AS right, x::double cx, y::double cy, ['Round', 'Long', 'Small', 'Large'][1 + h // 16 % 4] cell_type, 1.0::double prob FROM placed""")
def segment_tiles(spark, sf_dir):
    """Synthetic maps of one window for each nation's region, segmented, outlined and classified: every disc at its place."""
    keys = fx.table(spark, sf_dir, "nation").select(col("n_regionkey").cast("string").alias("slide_id"), (col("n_nationkey") % 5).cast("int").alias("icol"), F.floor(col("n_nationkey") / 5).cast("int").alias("irow"))
    provider = maps.Discs()
    cells = maps.cells_of(maps.detect(maps.predict(keys, provider), provider.classes, provider.mpp))
    return cells.select("slide_id", "icol", "irow", "top", "down", "left", "right", r6("cx").alias("cx"), r6("cy").alias("cy"), "cell_type", r6("prob").alias("prob"))


@query(f"""WITH {fx.GRID}, mixed AS (SELECT *, (row_ * 73856093 + col * 19349663 + 7 * 83492791) % 4294967291 m FROM grid)
SELECT slide, col, row_ AS row FROM mixed QUALIFY row_number() OVER (PARTITION BY slide ORDER BY m, row_, col) <= 50""")
def random_subset(spark, sf_dir):
    return tiling.random_tiles(fx.grid(spark, sf_dir).drop("tile_seq"), 50, 7)


@query("""WITH lines AS (SELECT l_orderkey, l_orderkey % 10 <> 0 ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS n, l_partkey, l_quantity::double l_quantity FROM lineitem)
SELECT l_orderkey, ok, n::int AS position, l_partkey part, l_quantity quantity FROM lines WHERE ok UNION ALL SELECT DISTINCT l_orderkey, ok, NULL, NULL, NULL FROM lines WHERE NOT ok""")
def zip_lists(spark, sf_dir):
    """Lists of one order's lines side by side; orders whose lists differ in length are flagged."""
    both = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", col("l_quantity").cast("double").alias("q"))))
    rows = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(both.alias("b"))
    short = F.when(col("l_orderkey") % 10 == 0, F.size("b") - 1).otherwise(F.size("b"))
    rows = rows.select("l_orderkey", F.transform("b", lambda x: x["l_partkey"]).alias("part"), F.transform(F.slice("b", F.lit(1), short), lambda x: x["q"]).alias("quantity"))
    return documents.from_lists(rows, ("part", "quantity"))


def flagship(spark, sf_dir) -> DataFrame:
    return fix_borders(spark, sf_dir)
