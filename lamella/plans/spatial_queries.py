"""Queries of spatial joins, frames, clustering and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import polygons as poly
from ..operators import clustering, filters, frames, ordering, spatial
from ..operators import planning as plan
from .filter_queries import BANDS, bands
from .planning_queries import RING
from .registry import query


def _greedy(order: str, clash: str, extra: str) -> str:
    """The sequential rule as a recursive table: one step per rank, the kept ones in a list."""
    return f"""with recursive r as (select *, row_number() over (partition by image_id order by {order}) as rk from {{detections}}),
    g as (select image_id, cast(0 as bigint) as rk, cast([] as {extra}[]) as kept, cast(null as bigint) as mask_id, false as ok from (select distinct image_id from r)
      union all select g.image_id, r.rk, case when len(list_filter(g.kept, lambda e: {clash})) > 0 then g.kept else list_append(g.kept, {{SHAPE}}) end, r.mask_id, len(list_filter(g.kept, lambda e: {clash})) = 0
      from g join r on r.image_id = g.image_id and r.rk = g.rk + 1)
    select image_id, mask_id from g where ok"""


@query(
    "cross_tile_dedup",
    _greedy("tile_idx, area desc, mask_id", "abs(r.cx - e.x) < 0.5e0 * sqrt(greatest(r.area, 1)) and abs(r.cy - e.y) < 0.5e0 * sqrt(greatest(r.area, 1))", "struct(x double, y double)").replace("{SHAPE}", "struct_pack(x := r.cx, y := r.cy)"),
)
def cross_tile_dedup(fx):
    return spatial.cross_tile_dedup(fx.detections).select("image_id", "mask_id")


_W, _H = "greatest(0, least(r.cx + r.w / 2, e.x + e.w / 2) - greatest(r.cx - r.w / 2, e.x - e.w / 2))", "greatest(0, least(r.cy + r.h / 2, e.y + e.h / 2) - greatest(r.cy - r.h / 2, e.y - e.h / 2))"
_IOU = f"{_W} * {_H} > 0.3e0 * (r.w * r.h + e.w * e.h - {_W} * {_H})"
_BOX = ("struct(x double, y double, w double, h double)", "struct_pack(x := r.cx, y := r.cy, w := r.w, h := r.h)")


@query("box_nms", _greedy("pred_iou desc, mask_id", _IOU, _BOX[0]).replace("{SHAPE}", _BOX[1]))
def box_nms(fx):
    return spatial.box_nms(fx.detections, 0.3).select("image_id", "mask_id")


@query("crop_merge_nms", _greedy("stability desc, mask_id", _IOU, _BOX[0]).replace("{SHAPE}", _BOX[1]))
def crop_merge_nms(fx):
    return spatial.box_nms(fx.detections, 0.3, order="stability").select("image_id", "mask_id")


def _inside(points: str) -> str:
    """Points in polygons by crossing counts over the edge rows."""
    return f"""e as (select image_id, mask_id, x as ax, y as ay, coalesce(nx, fx) as bx, coalesce(ny, fy) as "by" from v where mask_id % 11 <> 0),
    box as (select image_id, mask_id, min(ax) as x0, max(ax) as x1, min(ay) as y0, max(ay) as y1 from e group by all),
    near as (select p.*, b.mask_id from {points} p join box b on b.image_id = p.image_id and p.x between x0 and x1 and p.y between y0 and y1),
    hit as (select n.image_id, point_id, n.mask_id from near n join e using (mask_id) group by all
      having count(*) filter ((ay > n.y) <> ("by" > n.y) and n.x < (bx - ax) * (n.y - ay) / nullif("by" - ay, 0) + ax) % 2 = 1
        or bool_or((bx - ax) * (n.y - ay) - ("by" - ay) * (n.x - ax) = 0 and n.x between least(ax, bx) and greatest(ax, bx) and n.y between least(ay, "by") and greatest(ay, "by")))"""


@query(
    "click_to_section",
    RING + ", p as (select *, click_id as point_id from {clicks}), " + _inside("p") + """, best as (select point_id, arg_min(mask_id, (area, mask_id)) as mask_id from hit join {detections} using (mask_id) group by point_id)
    select image_id, click_id, mask_id from {clicks} left join best on click_id = point_id""",
)
def click_to_section(fx):
    return spatial.click_to_section(fx.clicks, fx.sections)


@query(
    "seed_coverage",
    RING + """, p as (select image_id, k as point_id, (k % 24 + 0.5e0) / 24 * 512 as x, (k // 24 + 0.5e0) / 24 * 512 as y from (select distinct image_id from {detections}), unnest(range(576)) as t(k)), """ + _inside("p")
    + """, a as (select image_id, mask_id, abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2 as a from v where mask_id % 11 <> 0 group by all), n as (select mask_id, count(*) as n from hit group by mask_id)
    select image_id, a.mask_id, coalesce(n, 0) as n_points, a * (24 / 512.0e0) ** 2 as expected, coalesce(n, 0) >= 2 as reached from a left join n using (mask_id)""",
)
def seed_coverage(fx):
    tiles = fx.detections.select("image_id").distinct().selectExpr("image_id", "0 as tile_idx", "0 as x0", "0 as y0", "512 as w", "512 as h")
    points = plan.prompt_grid(tiles, 24).withColumnRenamed("point_idx", "point_id")
    return spatial.seed_coverage(points, fx.sections, 512.0, 24)


MARKERS = "select image_id, fid_key * 10 + k as marker_id, x + 3 * k as x, y from {fiducials} cross join (select cast(0 as bigint) as k union all select 1 union all select 2 union all select 3 union all select 4) ks"


@query(
    "marker_import",
    """with recursive m as (select *, row_number() over (partition by image_id order by marker_id) as rk from (""" + MARKERS + """)),
    f as (select image_id, list(struct_pack(x := x, y := y)) as fs from {fiducials} group by image_id),
    g as (select image_id, cast(0 as bigint) as rk, fs as known, cast(null as bigint) as marker_id, cast(null as double) as x, cast(null as double) as y, false as ok from f
      union all select g.image_id, m.rk, case when len(list_filter(g.known, lambda e: sqrt((e.x - m.x) ** 2 + (e.y - m.y) ** 2) < 4)) > 0 then g.known else list_append(g.known, struct_pack(x := m.x, y := m.y)) end, m.marker_id, m.x, m.y,
        len(list_filter(g.known, lambda e: sqrt((e.x - m.x) ** 2 + (e.y - m.y) ** 2) < 4)) = 0 from g join m on m.image_id = g.image_id and m.rk = g.rk + 1)
    select image_id, marker_id, x, y from g where ok""",
)
def marker_import(fx):
    return spatial.marker_import(fx.spark.sql(MARKERS, fiducials=fx.fiducials), fx.fiducials).select("image_id", "marker_id", "x", "y")


@query("fiducial_distances", "select a.image_id, 'fiducial_' || a.idx || '-fiducial_' || b.idx as name, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as distance from {fiducials} a join {fiducials} b on a.image_id = b.image_id and a.idx < b.idx")
def fiducial_distances(fx):
    return spatial.fiducial_distances(fx.fiducials)


GEO = """geo as (select image_id, zoom, origin_x, origin_y, scale_m, case when size_s = 1 then image_id * 1000.0e0 end as sx, case when size_s = 1 then image_id * 500.0e0 end as sy, size_x / 2 as px, size_y / 2 as py from {images} where image_id % 9 <> 0)"""


def _geometry(fx):
    return frames.geometry_of(fx.images.where("image_id % 9 <> 0"))


def _corner_rows(df):
    return df.select("image_id", "mask_id", F.posexplode_outer("polygon").alias("k", "v")).select("image_id", "mask_id", F.coalesce("k", F.lit(0)).cast("long").alias("k"), "v.x", "v.y")


@query("to_fullres", "with " + GEO + " select image_id, mask_id, k, case when zoom is null then x else origin_x + x / zoom end as x, case when zoom is null then y else origin_y + y / zoom end as y from {corners} left join geo using (image_id)")
def to_fullres(fx):
    return _corner_rows(frames.to_fullres(fx.sections, _geometry(fx)))


@query("to_overview", "with " + GEO + " select image_id, mask_id, k, case when zoom is null then x else (x - origin_x) * zoom end as x, case when zoom is null then y else (y - origin_y) * zoom end as y from {corners} left join geo using (image_id)")
def to_overview(fx):
    return _corner_rows(frames.to_overview(fx.sections, _geometry(fx)))


STAGE = "with " + GEO + """, s as (select image_id, mask_id, k, sx + (y - py) * scale_m * 1e6 as x, sy + (x - px) * scale_m * 1e6 as y from {corners} left join geo using (image_id))"""


@query("to_stage_um", STAGE + " select image_id, mask_id, case when x is null then 0 else k end as k, x, y from s where x is not null or k = 0")
def to_stage_um(fx):
    return _corner_rows(frames.to_stage_um(fx.sections, _geometry(fx)))


@query("from_stage_um", STAGE + " select c.image_id, c.mask_id, case when s.x is null then 0 else c.k end as k, case when s.x is null then null else c.x end as x, case when s.x is null then null else c.y end as y from s join {corners} c using (mask_id, k) where s.x is not null or c.k = 0")
def from_stage_um(fx):
    geometry = _geometry(fx)
    return _corner_rows(frames.from_stage_um(frames.to_stage_um(fx.sections, geometry), geometry)).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query(
    "frame_migrate",
    "with b as (" + BANDS + """), r as (select image_id, case when image_id % 6 = 0 then 1.0e0 else 1.0e0 / (1 + image_id % 3) / zoom end as r from {images})
    select c.image_id, mask_id, k, x * r as x, y * r as y, min_area * r * r as min_area, max_area * r * r as max_area, (20.0e0 + c.image_id % 7) * r as section_px from {corners} c join r using (image_id) left join b using (image_id)""",
)
def frame_migrate(fx):
    per = fx.images.select("image_id").join(bands(fx), "image_id", "left").withColumn("section_px", 20.0 + F.col("image_id") % 7)
    new = fx.images.withColumn("zoom", F.when(F.col("image_id") % 6 == 0, F.col("zoom")).otherwise(1.0 / (1 + F.col("image_id") % 3)))
    out = frames.frame_migrate(fx.sections, per, fx.images, new)
    return out.select("image_id", "mask_id", F.posexplode("polygon").alias("k", "v"), "min_area", "max_area", "section_px").select("image_id", "mask_id", F.col("k").cast("long").alias("k"), "v.x", "v.y", "min_area", "max_area", "section_px")


IDX = "d as (select image_id, mask_id, row_number() over (partition by image_id order by area desc, mask_id) - 1 as idx, area from {detections})"


def indexed(fx):
    return filters.masks_by_area(fx.detections).select("image_id", "mask_id", F.col("position").alias("idx"), "area")


def _dbscan(base: str, p: str) -> str:
    """Labels of base(image_id, ord, idx, area, eps, ms): counts by a RANGE frame per row, cores by gaps, borders by nearest cores."""
    return f"""{p}n as (select *, count(*) over (partition by image_id, ord order by area range between eps preceding and eps following) >= ms as core from {base}),
    {p}g as (select *, last_value(case when core then area end ignore nulls) over (partition by image_id, ord order by area, idx rows between unbounded preceding and 1 preceding) as prev from {p}n),
    {p}r as (select *, case when core then sum(case when core and (prev is null or area - prev > eps) then 1 else 0 end) over (partition by image_id, ord order by area, idx) end as run from {p}g),
    {p}c as (select image_id, ord, run, min(area) as lo, max(area) as hi, min(idx) as found from {p}r where core group by all),
    {p}f as (select r.image_id, r.ord, r.idx, r.area, r.eps, r.ms, min(c.found) as found from {p}r r left join {p}c c on c.image_id = r.image_id and c.ord = r.ord and (r.run = c.run or (not r.core and exists (select 1 from {p}r q where q.image_id = c.image_id and q.ord = c.ord and q.run = c.run and abs(q.area - r.area) <= r.eps))) group by all),
    {p}l as (select *, case when found is null then -1 else dense_rank() over (partition by image_id, ord, found is null order by found) - 1 end as label from {p}f)"""


@query("area_dbscan", "with " + IDX + ", base as (select image_id, 0 as ord, idx, area, 150.0e0 as eps, 3 as ms from d), " + _dbscan("base", "z") + " select image_id, idx, area, label from zl")
def area_dbscan(fx):
    return clustering.area_dbscan(indexed(fx), 150.0, 3)


CHOICE = """, top as (select image_id, ord, label, count(*) as n, any_value(eps) as eps, any_value(ms) as ms, list(idx order by idx) as members from zl where label >= 0 group by image_id, ord, label),
    best as (select * from (select *, row_number() over (partition by image_id, ord order by n desc, label) as rn from top) where rn = 1),
    votes as (select image_id, members, count(*) as votes, min(ord) as first_ord from best group by image_id, members),
    won as (select * from (select *, row_number() over (partition by image_id order by votes desc, first_ord) as rn from votes) where rn = 1),
    chosen as (select w.image_id, w.members, b.eps, b.ms from won w join best b on b.image_id = w.image_id and b.ord = w.first_ord)"""
SWEEP = IDX + ", base as (select image_id, s * 4 + m - 1 as ord, idx, area, 100 + 110.0e0 * s as eps, m as ms from d, unnest(range(11)) as a(s), unnest(range(1, 5)) as b(m)), " + _dbscan("base", "z") + CHOICE
EPS = [100 + 110.0 * s for s in range(11)]


@query("area_sweep_consensus", "with " + SWEEP + " select image_id, unnest(members) as idx, eps, ms as min_samples from chosen")
def area_sweep_consensus(fx):
    return clustering.area_sweep_consensus(indexed(fx), EPS, [1, 2, 3, 4]).withColumn("min_samples", F.col("min_samples").cast("long"))


IN_BAND = "bands as (" + BANDS + """), raw as (select image_id, mask_id, area from {detections} where pred_iou > 0.3), inb as (select r.* from raw r left join bands b using (image_id) where area between coalesce(min_area, 0) and coalesce(max_area, 'infinity'::double)),
    d as (select image_id, mask_id, mask_id as idx, area, count(*) over (partition by image_id) as nb from inb), span as (select image_id, greatest(1, min(area)) as lo, max(area) + 1 as hi from d where nb >= 3 group by image_id),
    base as (select image_id, s * 3 + m - 2 as ord, idx, area, lo + s * (hi - lo) / 11 as eps, m as ms from d join span using (image_id), unnest(range(12)) as a(s), unnest(range(2, 5)) as b(m)), """ + _dbscan("base", "z") + CHOICE + """,
    kept as (select image_id, unnest(members) as mask_id from chosen union all select image_id, mask_id from d where nb < 3)"""


def _raw(fx):
    return fx.detections.where("pred_iou > 0.3").select("image_id", "mask_id", F.col("mask_id").alias("idx"), "area")


def _final(fx):
    return clustering.finalize_sections(filters.size_band(_raw(fx), bands(fx)))


@query("finalize_sections", "with " + IN_BAND + " select image_id, mask_id from kept")
def finalize_sections(fx):
    return _final(fx).select("image_id", "mask_id")


FUNNEL = "with " + IN_BAND + " select r.image_id, count(*) as n_raw, count(inb.mask_id) as n_band, count(kept.mask_id) as n_kept from raw r left join inb using (image_id, mask_id) left join kept using (image_id, mask_id) group by r.image_id"


@query("filter_funnel", FUNNEL)
def filter_funnel(fx):
    return filters.filter_funnel(_raw(fx), bands(fx), _final(fx))


@query(
    "cluster_profile",
    "with " + SWEEP + ", again as (select d.image_id, 0 as ord, idx, area, c.eps, c.ms from d join (select distinct image_id, eps, ms from chosen) c using (image_id)), " + _dbscan("again", "y")
    + """, s as (select image_id, label, count(*) as n, min(area) as least, max(area) as largest, avg(area) as mean from yl group by image_id, label)
    select image_id, label, n, least, largest, mean, label >= 0 and row_number() over (partition by image_id order by case when label >= 0 then n else -1 end desc, label) = 1 as is_main,
    cast(case when mean < 0 then 0 when mean >= 50000 then 11 else floor(mean / 5000.0e0) + 1 end as bigint) as bin from s""",
)
def cluster_profile(fx):
    chosen = clustering.area_sweep_consensus(indexed(fx), EPS, [1, 2, 3, 4]).select("image_id", "eps", "min_samples").distinct()
    return clustering.cluster_profile(indexed(fx), chosen)


NORM = """u as (select image_id, section_id, k, cast(vec[k] as double) as v from {thumbs}, unnest(range(1, len(vec) + 1)) as t(k)), c as (select *, v - avg(v) over (partition by section_id) as w from u),
    nrm as (select image_id, section_id, k, case when sqrt(sum(w * w) over (partition by section_id)) > 1e-6 then w / sqrt(sum(w * w) over (partition by section_id)) else w end as w from c)"""


@query("thumb_normalise", "with " + NORM + " select image_id, section_id, k - 1 as k, round(w, 6) as w from nrm")
def thumb_normalise(fx):
    return ordering.thumb_normalise(fx.thumbs).select("image_id", "section_id", F.posexplode("vec").alias("k", "w")).select("image_id", "section_id", F.col("k").cast("long").alias("k"), F.round("w", 6).alias("w"))


SIM = NORM + """, sim as (select a.image_id, a.section_id as i, b.section_id as j, case when a.section_id = b.section_id then 1.0e0 else greatest(-1, least(1, sum(a.w * b.w))) end as s from nrm a join nrm b on a.image_id = b.image_id and a.k = b.k group by a.image_id, a.section_id, b.section_id)"""


@query("similarity_pairs", "with " + SIM + " select image_id, i, j, round(s, 6) as s from sim")
def similarity_pairs(fx):
    return ordering.similarity_pairs(fx.thumbs).withColumn("s", F.round("s", 6))


GREEDY = "with recursive " + SIM + """, sums as (select image_id, i, round(sum(s), 9) as t from sim group by image_id, i), m as materialized (select image_id, i, j, round(s, 9) as s from sim),
    g as (select image_id, cast(0 as bigint) as position, arg_min(i, (t, i)) as section_id, [arg_min(i, (t, i))] as seen from sums group by image_id
      union all select image_id, position, section_id, list_append(seen, section_id) from (select g.image_id, g.position + 1 as position, g.seen, arg_max(m.j, (m.s, -m.j)) as section_id from g join m on m.image_id = g.image_id and m.i = g.section_id and not list_contains(g.seen, m.j) group by g.image_id, g.position, g.seen))"""


@query("order_greedy", GREEDY + " select image_id, position, section_id from g")
def order_greedy(fx):
    return ordering.order_greedy(fx.thumbs)


@query("order_sections", GREEDY + " select image_id, position, section_id from g")
def order_sections(fx):
    return ordering.order_sections(fx.thumbs, "greedy")[0]


@query("apply_order", GREEDY + " select image_id, section_id, 'section_' || (position + 1) as new_id from g")
def apply_order(fx):
    order, _ = ordering.order_sections(fx.thumbs)
    return ordering.apply_order(fx.thumbs.select("image_id", "section_id"), order).select("image_id", "section_id", "new_id")


@query("order_quality", GREEDY + ", st as (select image_id, section_id as j, lag(section_id) over (partition by image_id order by position) as i from g) select st.image_id, round(avg(s), 6) as quality from st left join sim on sim.image_id = st.image_id and sim.i = st.i and sim.j = st.j group by st.image_id")
def order_quality(fx):
    return ordering.order_quality(ordering.order_greedy(fx.thumbs), fx.thumbs).withColumn("quality", F.round("quality", 6))


@query("order_spectral")
def order_spectral(fx):
    return ordering.order_spectral(fx.thumbs).select("image_id", "position", "section_id", (F.col("residual") < 1e-6).alias("settled"))
