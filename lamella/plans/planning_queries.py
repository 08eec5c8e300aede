"""Queries of the row generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import polygons as poly
from ..operators import costs
from ..operators import planning as plan
from .registry import query

TILES = """
    with n as (select image_id, size_x, size_y, cast(greatest(1, round_even(size_x / 1024.0e0, 0)) as bigint) as nx, cast(greatest(1, round_even(size_y / 1024.0e0, 0)) as bigint) as ny from {images}),
    c as (select n.*, i, j, cast(size_x as double) / nx as ux, cast(size_y as double) / ny as uy from n, unnest(range(nx)) as a(i), unnest(range(ny)) as b(j)),
    e as (select image_id, j * nx + i as tile_idx, greatest(0, i * ux - 0.25e0 * ux / 2) as xa, least(size_x, (i + 1) * ux + 0.25e0 * ux / 2) as xz, greatest(0, j * uy - 0.25e0 * uy / 2) as ya, least(size_y, (j + 1) * uy + 0.25e0 * uy / 2) as yz from c),
    tiles as (select image_id, tile_idx, cast(round_even(xa, 0) as bigint) as x0, cast(round_even(ya, 0) as bigint) as y0, cast(round_even(xz - xa, 0) as bigint) as w, cast(round_even(yz - ya, 0) as bigint) as h from e)
"""


@query("tile_plan", TILES + "select * from tiles")
def tile_plan(fx):
    return plan.tile_plan(fx.images, 1024)


def _asked(fx):
    tile = F.when(F.col("image_id") % 4 == 0, F.lit(None)).when(F.col("image_id") % 4 == 1, 0).when(F.col("image_id") % 4 == 2, 20000).otherwise(1536).cast("long")
    return fx.images.select("image_id", "size_x", "size_y", tile.alias("tile_px"), (F.col("image_id") % 8 + 1).cast("int").alias("host_id"))


@query(
    "tile_plan_resolved",
    """with c as (select host_id, least(case when ram_gb >= 24 then 4096 when ram_gb >= 12 then 3072 when ram_gb >= 8 then 2048 else 1536 end, case when device = 'cpu' then 2048 else 99999 end) as cap from {hosts}),
    r as (select image_id, greatest(size_x, size_y) as ls, cast(image_id % 8 + 1 as int) as host_id, case image_id % 4 when 0 then 768 when 1 then 0 when 2 then 20000 else 1536 end as asked from {images}),
    e as (select *, asked <= 0 or least(asked, cap) >= ls as whole from r join c using (host_id)),
    t as (select *, cast(case when whole then ls else least(asked, cap) end as bigint) as tile_px from e)
    select image_id, host_id, whole, tile_px, case when whole then 0.0e0 else 0.25e0 end as overlap, 1024.0e0 / greatest(tile_px, 1) as upscale from t""",
)
def tile_plan_resolved(fx):
    return plan.tile_plan_resolved(_asked(fx), costs.host_budget(fx.hosts).select("host_id", "tile_cap_px"))


@query(
    "prompt_grid",
    TILES + """select image_id, tile_idx, count(*) as n_points, min(x) as first_x, max(x) as last_x, min(y) as first_y, max(y) as last_y, sum(x) as sum_x, sum(y) as sum_y, sum(p * x) as moment_x, sum(p * y) as moment_y
    from (select image_id, tile_idx, p, x0 + (p % 32 + 0.5e0) / 32 * w as x, y0 + (p // 32 + 0.5e0) / 32 * h as y from tiles, unnest(range(0, 1024)) as t(p)) group by image_id, tile_idx""",
)
def prompt_grid(fx):
    """The points of all tiles, told by a row of sums for each tile (exact, as 32 divides them in binary)."""
    points = plan.prompt_grid(plan.tile_plan(fx.images, 1024), 32)
    ends = [f(c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("first", F.min), ("last", F.max), ("sum", F.sum))]
    moments = [F.sum(F.col("point_idx") * F.col(c)).alias(f"moment_{c}") for c in ("x", "y")]
    return points.groupBy("image_id", "tile_idx").agg(F.count("*").alias("n_points"), *ends, *moments)


@query(
    "crop_boxes",
    """with g as (select image_id, size_x, size_y, layer, cast(1 << layer as bigint) as m from {images}, unnest(range(1, 4)) as l(layer)),
    o as (select *, 512.0e0 / 1500 * least(size_x, size_y) * 2 / m as ov from g), c as (select *, (size_x + (m - 1) * ov) / m as cw, (size_y + (m - 1) * ov) / m as ch from o)
    select image_id, layer, i * m + j as crop_idx, i * (cw - ov) as x0, j * (ch - ov) as y0, cw as w, ch as h from c, unnest(range(m)) as a(i), unnest(range(m)) as b(j)""",
)
def crop_boxes(fx):
    return plan.crop_boxes(fx.images, 3)


@query("pass_count", "select req_id, cast(sum(4.0e0 ** k) as bigint) as passes, cast(sum(4.0e0 ** k * floor(pps / 2.0e0 ** k) ** 2) as bigint) as prompts from {requests}, unnest(range(crop_layers + 1)) as t(k) group by req_id")
def pass_count(fx):
    return plan.pass_count(fx.requests)


@query("overview_zoom", "select image_id, case when greatest(size_x, size_y) <= 4096 then 1.0e0 else 4096.0e0 / greatest(size_x, size_y) end as zoom from {images}")
def overview_zoom(fx):
    return plan.overview_zoom(fx.images, 4096)


@query(
    "region_clamp",
    """with r as (select image_id, size_x, size_y, (image_id * 7919) % 12000 - 1000 as x, (image_id * 6007) % 12000 - 1000 as y, (image_id * 31) % 3000 as w, (image_id * 37) % 3000 as h from {images}),
    a as (select *, greatest(0, least(x, size_x - 1)) as cx, greatest(0, least(y, size_y - 1)) as cy from r)
    select image_id, cx as x, cy as y, greatest(1, least(w, size_x - cx)) as w, greatest(1, least(h, size_y - cy)) as h from a""",
)
def region_clamp(fx):
    ask = fx.images.select("image_id", "size_x", "size_y", F.expr("(image_id * 7919) % 12000 - 1000 as x"), F.expr("(image_id * 6007) % 12000 - 1000 as y"), F.expr("(image_id * 31) % 3000 as w"), F.expr("(image_id * 37) % 3000 as h"))
    return plan.region_clamp(ask)


LEVELS = """
    with recursive lv as (select image_id, size_x as ox, size_y as oy, cast(0 as bigint) as level, size_x, size_y from {images}
      union all select image_id, ox, oy, level + 1, cast(greatest(1, round_even(ox * 0.5e0 ** (level + 1), 0)) as bigint), cast(greatest(1, round_even(oy * 0.5e0 ** (level + 1), 0)) as bigint) from lv
      where level < 6 and greatest(size_x, size_y) > 1500)
"""


@query(
    "pyramid_plan",
    LEVELS + """, c as (select *, cast(2 ** level as bigint) as s, least(3072, size_x - b.cx * 3072) as w, least(3072, size_y - a.cy * 3072) as h, b.cx as cx, a.cy as cy
      from lv, unnest(range(cast(ceil(size_y / 3072.0e0) as bigint))) as a(cy), unnest(range(cast(ceil(size_x / 3072.0e0) as bigint))) as b(cx))
    select image_id, level, cx as bx, cy as "by", w, h, cx * 3072 * s as src_x, cy * 3072 * s as src_y, w * s as src_w, h * s as src_h from c""",
)
def pyramid_plan(fx):
    return plan.pyramid_plan(fx.images)


@query("pyramid_rollup", "select image_id, level, cast(floor(x / 2.0e0 ** level) as bigint) as x, cast(floor(y / 2.0e0 ** level) as bigint) as y, avg(v) as v, count(*) as n from {pixels}, unnest(range(4)) as t(level) group by all")
def pyramid_rollup(fx):
    return plan.pyramid_rollup(fx.pixels, 4)


@query("box_polygon", TILES + "select image_id, tile_idx, cast(k as bigint) as k, cast(case when k in (0, 3) then x0 else x0 + w end as double) as x, cast(case when k in (0, 1) then y0 else y0 + h end as double) as y from tiles, unnest(range(4)) as t(k)")
def box_polygon(fx):
    boxes = plan.box_polygon(plan.tile_plan(fx.images, 1024))
    return boxes.select("image_id", "tile_idx", F.posexplode("polygon").alias("k", "v")).select("image_id", "tile_idx", F.col("k").cast("long").alias("k"), "v.x", "v.y")


@query(
    "representative_tile",
    TILES + """, d as (select t.*, size_x, size_y, (x0 + w / 2 - size_x / 2) ** 2 + (y0 + h / 2 - size_y / 2) ** 2 as d2 from tiles t join {images} i using (image_id)),
    r as (select *, row_number() over (partition by image_id order by d2, tile_idx) as rn from d)
    select image_id, case when 1024 >= greatest(size_x, size_y) then 0 else tile_idx end as tile_idx, case when 1024 >= greatest(size_x, size_y) then 0 else x0 end as x0, case when 1024 >= greatest(size_x, size_y) then 0 else y0 end as y0,
    case when 1024 >= greatest(size_x, size_y) then size_x else w end as w, case when 1024 >= greatest(size_x, size_y) then size_y else h end as h from r where rn = 1""",
)
def representative_tile(fx):
    return plan.representative_tile(plan.tile_plan(fx.images, 1024), fx.images, 1024)


RING = """with v as (select *, lead(x) over p as nx, lead(y) over p as ny, first_value(x) over p as fx, first_value(y) over p as fy from {corners} window p as (partition by mask_id order by k))"""


@query("polygon_area", RING + "select image_id, mask_id, abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2 as polygon_area from v group by image_id, mask_id")
def polygon_area(fx):
    return fx.sections.select("image_id", "mask_id", poly.area("polygon").alias("polygon_area"))


@query("polygon_centroid", "select image_id, mask_id, avg(x) as x, avg(y) as y from {corners} group by image_id, mask_id")
def polygon_centroid(fx):
    return fx.sections.select("image_id", "mask_id", poly.centroid("polygon").alias("c")).select("image_id", "mask_id", "c.x", "c.y")


@query("polygon_bbox", "select image_id, mask_id, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1, cast(trunc(min(x)) as bigint) as ix0, cast(trunc(max(y)) as bigint) as iy1 from {corners} group by image_id, mask_id")
def polygon_bbox(fx):
    both = fx.sections.select("image_id", "mask_id", poly.bbox("polygon").alias("b"), poly.bbox("polygon", whole=True).alias("i"))
    return both.select("image_id", "mask_id", "b.*", F.col("i.x0").alias("ix0"), F.col("i.y1").alias("iy1"))


@query("mask_bbox_xyxy", "select image_id, mask_id, cast(trunc(cx - w / 2) as bigint) as x0, cast(trunc(cy - h / 2) as bigint) as y0, cast(trunc(cx - w / 2 + w) as bigint) as x1, cast(trunc(cy - h / 2 + h) as bigint) as y1 from {detections}")
def mask_bbox_xyxy(fx):
    x, y = F.col("cx") - F.col("w") / 2, F.col("cy") - F.col("h") / 2
    cut = lambda v, name: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long").alias(name)
    return fx.detections.select("image_id", "mask_id", cut(x, "x0"), cut(y, "y0"), cut(x + F.col("w"), "x1"), cut(y + F.col("h"), "y1"))


MINOR = """
    d as (select a.image_id, a.mask_id, a.k as ka, b.k as kb, (b.x - a.x) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) as dx, (b.y - a.y) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) as dy
      from {corners} a join {corners} b on a.mask_id = b.mask_id and (a.x <> b.x or a.y <> b.y)),
    s as (select d.image_id, d.mask_id, ka, kb, max(x * dx + y * dy) - min(x * dx + y * dy) as u, max(y * dx - x * dy) - min(y * dx - x * dy) as v from d join {corners} c on c.mask_id = d.mask_id group by all),
    minor as (select image_id, mask_id, least(u, v) as minor_axis from (select *, row_number() over (partition by mask_id order by round(u * v, 6), least(u, v)) as rn from s) where rn = 1)
"""


@query("polygon_minor_axis", "with " + MINOR + "select * from minor")
def polygon_minor_axis(fx):
    return fx.sections.select("image_id", "mask_id", poly.minor_axis("polygon").alias("minor_axis"))


@query("polygon_valid", "select image_id, mask_id, count(*) as n_vertices from {corners} group by image_id, mask_id having count(*) >= 3")
def polygon_valid(fx):
    return fx.sections.where(poly.valid("polygon")).select("image_id", "mask_id", F.size("polygon").cast("long").alias("n_vertices"))


CHAIN = "with v as (select image_id, tile_idx, cast(row_number() over (partition by image_id order by mask_id) - 1 as bigint) as i, count(*) over (partition by image_id) as n, cx as x, cy as y from {detections})"


def _chains(fx):
    rows = fx.detections.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("mask_id", "cx", "cy"))).alias("v"))
    return rows.select("image_id", F.transform("v", lambda v: poly.point(v["cx"], v["cy"])).alias("polygon"))


@query("polygon_resample", CHAIN + """, k as (select image_id, n, r, case when n > 20 then cast(round_even(r * (n - 1) / 19.0e0, 0) as bigint) else r end as i from (select distinct image_id, n from v), unnest(range(least(n, 20))) as t(r))
    select image_id, r as k, x, y from k join v using (image_id, i)""")
def polygon_resample(fx):
    return _chains(fx).select("image_id", F.posexplode(poly.resample("polygon", 20)).alias("k", "v")).select("image_id", F.col("k").cast("long").alias("k"), "v.x", "v.y")


@query(
    "largest_contour",
    RING + """, c as (select image_id, tile_idx, mask_id, count(*) as n, abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2 as a from v group by all),
    r as (select *, row_number() over (partition by image_id, tile_idx order by n desc, mask_id) as rv, row_number() over (partition by image_id, tile_idx order by a desc, mask_id) as ra from c)
    select image_id, tile_idx, max(n) filter (rv = 1) as vertices, max(a) filter (rv = 1) as area_by_vertices, max(a) filter (ra = 1) as area_by_area from r group by image_id, tile_idx""",
)
def largest_contour(fx):
    sets = fx.sections.groupBy("image_id", "tile_idx").agg(F.sort_array(F.collect_list(F.struct("mask_id", "polygon"))).alias("v"))
    sets = sets.withColumn("contours", F.transform("v", lambda v: v["polygon"])).withColumn("v", poly.largest_contour("contours")).withColumn("a", poly.largest_contour("contours", by="area"))
    return sets.select("image_id", "tile_idx", F.size("v").cast("long").alias("vertices"), poly.area("v").alias("area_by_vertices"), poly.area("a").alias("area_by_area"))


@query("tile_to_image", TILES + "select c.image_id, mask_id, k, x + x0 as x, y + y0 as y from {corners} c join tiles t on c.image_id = t.image_id and c.tile_idx = t.tile_idx")
def tile_to_image(fx):
    tiles = plan.tile_plan(fx.images, 1024).select("image_id", "tile_idx", "x0", "y0")
    shifted = fx.sections.join(tiles, ["image_id", "tile_idx"]).withColumn("polygon", poly.moved("polygon", lambda x, y: x + F.col("x0"), lambda x, y: y + F.col("y0")))
    return shifted.select("image_id", "mask_id", F.posexplode("polygon").alias("k", "v")).select("image_id", "mask_id", F.col("k").cast("long").alias("k"), "v.x", "v.y")
