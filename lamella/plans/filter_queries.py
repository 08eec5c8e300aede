"""Queries of filters, costs and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as cal
from ..operators import costs, filters
from ..operators import planning as plan
from .planning_queries import MINOR, RING, TILES
from .registry import query

BANDS = "select image_id, median(area) * 0.5e0 as min_area, median(area) * 2.0e0 as max_area from {detections} where image_id % 5 <> 0 group by image_id"


def bands(fx):
    return fx.detections.where("image_id % 5 <> 0").groupBy("image_id").agg((F.percentile("area", 0.5) * 0.5).alias("min_area"), (F.percentile("area", 0.5) * 2.0).alias("max_area"))


@query("quality_gate", "select image_id, mask_id, pred_iou, stability from {detections} where pred_iou > 0.7 and stability >= 0.92")
def quality_gate(fx):
    return filters.quality_gate(fx.detections).select("image_id", "mask_id", "pred_iou", "stability")


@query(
    "stability_score",
    """with l as (select p_partkey % 100 as image_id, p_partkey % 7 as mask_id, (p_retailprice - 1400) / 150 as logit from {part})
    select cast(image_id as bigint) as image_id, cast(mask_id as bigint) as mask_id, count(*) filter (logit > 1.0e0) / cast(nullif(count(*) filter (logit > -1.0e0), 0) as double) as stability from l group by image_id, mask_id""",
)
def stability_score(fx):
    logits = fx.part.select((F.col("p_partkey") % 100).cast("long").alias("image_id"), (F.col("p_partkey") % 7).cast("long").alias("mask_id"), ((F.col("p_retailprice") - 1400) / 150).alias("logit"))
    return filters.stability_score(logits)


@query(
    "tile_edge_reject",
    TILES + """, m as (select image_id, mask_id, tile_idx, (mask_id * 31) % 1200 as lx, (mask_id * 37) % 1200 as ly, w as bw, h as bh from {detections})
    select m.image_id, mask_id from m join tiles t on m.image_id = t.image_id and m.tile_idx = t.tile_idx join {images} i on i.image_id = m.image_id
    where not ((lx <= 2 and x0 > 0) or (ly <= 2 and y0 > 0) or (lx + bw >= t.w - 2 and x0 + t.w < size_x) or (ly + bh >= t.h - 2 and y0 + t.h < size_y))""",
)
def tile_edge_reject(fx):
    masks = fx.detections.selectExpr("image_id", "mask_id", "tile_idx", "(mask_id * 31) % 1200 as bx", "(mask_id * 37) % 1200 as by", "w as bw", "h as bh")
    return filters.tile_edge_reject(masks, plan.tile_plan(fx.images, 1024), fx.images).select("image_id", "mask_id")


@query("size_band", "with b as (" + BANDS + ") select d.image_id, mask_id, area from {detections} d left join b using (image_id) where area between coalesce(min_area, 0) and coalesce(max_area, 'infinity'::double)")
def size_band(fx):
    return filters.size_band(fx.detections, bands(fx)).select("image_id", "mask_id", "area")


@query("median_band", "with m as (select image_id, median(area) as md from {detections} group by image_id) select d.image_id, mask_id, area from {detections} d join m using (image_id) where area between 0.2e0 * md and 5.0e0 * md")
def median_band(fx):
    return filters.median_band(fx.detections).select("image_id", "mask_id", "area")


@query(
    "shape_gate",
    RING + ", pa as (select image_id, mask_id, abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2 as a, count(*) as n from v group by image_id, mask_id)," + MINOR.replace("select image_id, mask_id, least(u, v) as minor_axis", "select image_id, mask_id, least(u, v) as minor_axis, round(u * v, 6) as rect")
    + " select pa.image_id, pa.mask_id from pa join minor using (mask_id) join {images} i on i.image_id = pa.image_id where n >= 3 and rect / nullif(minor_axis, 0) / nullif(minor_axis, 0) <= 8 and a / nullif(rect, 0) >= 0.55 and a <= 0.5 * size_x * size_y",
)
def shape_gate(fx):
    return filters.shape_gate(fx.sections, fx.images, least_fill=0.55).select("image_id", "mask_id")


@query("best_mask_per_prompt", "select image_id, prompt_id, mask_id, pred_iou from (select image_id, mask_id // 3 as prompt_id, mask_id, pred_iou, row_number() over (partition by image_id, mask_id // 3 order by pred_iou desc, mask_id) as rn from {detections}) where rn = 1")
def best_mask_per_prompt(fx):
    return filters.best_mask_per_prompt(fx.detections.withColumn("prompt_id", F.expr("mask_id div 3")))


@query("masks_by_area", "select image_id, mask_id, row_number() over (partition by image_id order by area desc, mask_id) - 1 as position from {detections}")
def masks_by_area(fx):
    return filters.masks_by_area(fx.detections).select("image_id", "mask_id", "position")


@query("section_ids", "select image_id, mask_id, 'section_' || row_number() over (partition by image_id order by mask_id) as section_id from {detections}")
def section_ids(fx):
    return filters.section_ids(fx.detections).select("image_id", "mask_id", "section_id")


@query(
    "run_summary",
    """with g as (select image_id, tile_idx, count(*) as n_masks, count(*) filter (pred_iou > 0.7) as n_sections from {detections} group by image_id, tile_idx)
    select *, cast(sum(n_sections) over (partition by image_id order by tile_idx) as bigint) as running from g
    union all select image_id, null, cast(sum(n_masks) as bigint), cast(sum(n_sections) as bigint), cast(sum(n_sections) as bigint) from g group by image_id""",
)
def run_summary(fx):
    return filters.run_summary(fx.detections.withColumn("confirmed", F.col("pred_iou") > 0.7))


HOST = """h as (select *, case device when 'cuda' then case when vram_gb >= 10 then 'large' when vram_gb >= 6 then 'base_plus' else 'small' end
      when 'mps' then case when ram_gb >= 16 then 'base_plus' else 'small' end else case when ram_gb >= 24 then 'small' else 'tiny' end end as model,
      1073741824.0e0 * case when device = 'cuda' and vram_gb > 0 then 0.5e0 * vram_gb when device = 'mps' then greatest(0.5e0, least(0.2e0 * avail_gb, 0.15e0 * ram_gb)) else greatest(0.6e0, 0.35e0 * avail_gb) end as mem_budget_bytes,
      case device when 'cuda' then 64 when 'mps' then 24 else 12 end as points_per_batch,
      case when ram_gb >= 24 then 12000 when ram_gb >= 12 then 9000 when ram_gb >= 8 then 6000 else 4096 end as overview_cap_px,
      least(case when ram_gb >= 24 then 4096 when ram_gb >= 12 then 3072 when ram_gb >= 8 then 2048 else 1536 end, case when device = 'cpu' then 2048 else 9999 end) as tile_cap_px,
      greatest(1, least(cores, 8)) as threads from {hosts})"""
#: Requests dealt over the hosts, so that the work grows with the tables.
ASKED = """a as (select req_id, image_id, pps, crop_layers, cast(req_id % 8 + 1 as int) as host_id, req_id % 13 as n_tiles from {requests})"""


def asked(fx):
    return fx.requests.selectExpr("req_id", "image_id", "pps", "crop_layers", "cast(req_id % 8 + 1 as int) as host_id", "req_id % 13 as n_tiles")


@query("model_choice", "with " + HOST + ", " + ASKED + " select req_id, model from a join h using (host_id)")
def model_choice(fx):
    return asked(fx).join(F.broadcast(fx.hosts), "host_id").select("req_id", costs.model_choice().alias("model"))


@query(
    "host_budget",
    "with " + HOST + ", " + ASKED + """ select req_id, device, model, mem_budget_bytes, cast(points_per_batch as bigint) as points_per_batch, cast(overview_cap_px as bigint) as overview_cap_px, cast(tile_cap_px as bigint) as tile_cap_px, cast(threads as bigint) as threads,
    device || ', ' || cast(ram_gb as bigint) || ' GB RAM, ' || model || ', batch ' || points_per_batch || ', tiles ' || tile_cap_px || ' px, overview ' || overview_cap_px || ' px' as summary from a join h using (host_id)""",
)
def host_budget(fx):
    rows = asked(fx).join(F.broadcast(costs.host_budget(fx.hosts)), "host_id")
    return rows.select("req_id", "device", "model", "mem_budget_bytes", "points_per_batch", "overview_cap_px", "tile_cap_px", "threads", "summary")


@query(
    "safe_batch",
    "with " + HOST + ", " + ASKED + """, s as (select req_id, mem_budget_bytes as budget, points_per_batch as requested, 256 + 256 * (req_id % 16) as tile_px, 0.1e0 * (req_id % 6) as overlap, 2048 + req_id % 4096 as size_x, 1024 + req_id % 3000 as size_y, 1 + 2 * (req_id % 2) as mpp from a join h using (host_id)),
    p as (select *, greatest(1.0e0, mpp * least(size_y, ceil(tile_px * (1 + greatest(0, overlap)))) * least(size_x, ceil(tile_px * (1 + greatest(0, overlap)))) * 4 * 1.2e0) as per from s)
    select req_id, cast(greatest(1, least(requested, greatest(1, floor(budget / per)))) as bigint) as batch from p""",
)
def safe_batch(fx):
    rows = asked(fx).join(F.broadcast(costs.host_budget(fx.hosts)), "host_id").selectExpr(
        "req_id", "mem_budget_bytes as budget", "points_per_batch as requested", "256 + 256 * (req_id % 16) as tile_px", "0.1e0 * (req_id % 6) as overlap", "2048 + req_id % 4096 as size_x", "1024 + req_id % 3000 as size_y", "1 + 2 * (req_id % 2) as masks_per_point"
    )
    return costs.safe_batch(rows)


@query(
    "run_estimate",
    "with " + HOST + ", " + ASKED + """, p as (select req_id, case when req_id % 17 = 0 then 'tpu' else device end as device, case when req_id % 19 = 0 then 'huge' else model end as model, pps, n_tiles, mem_budget_bytes as budget, avail_gb from a join h using (host_id)),
    r as (select p.*, coalesce(c.seconds, 20.0e0) * greatest(0.4e0, (greatest(pps, 1) / 32.0e0) ** 1.3e0) * greatest(1, n_tiles) as sec, budget / 1073741824.0e0 + 0.5e0 as peak from p
      left join {pass_rates} c on c.device = case when p.device in (select device from {pass_rates}) then p.device else 'cpu' end and c.model = p.model)
    select req_id, sec as seconds, sec / 60 as minutes, peak as peak_gb, case when device = 'cpu' and sec > 180 then 'slow' when peak > 0.8e0 * avail_gb then 'memory' else '' end as warning from r""",
)
def run_estimate(fx):
    rows = asked(fx).join(F.broadcast(costs.host_budget(fx.hosts)), "host_id")
    rows = rows.selectExpr("req_id", "case when req_id % 17 = 0 then 'tpu' else device end as device", "case when req_id % 19 = 0 then 'huge' else model end as model", "pps", "n_tiles", "mem_budget_bytes as budget", "avail_gb")
    return costs.run_estimate(rows, fx.pass_rates)


SET = "select image_id, size_x, size_y, (image_id * 512) % 4096 as tile_px, 0.1e0 * (image_id % 5) as overlap, 20.0e0 + image_id % 90 as section_px from {images}"


@query(
    "effect_readout",
    "with s as (" + SET + """), e as (select *, case when tile_px > 0 then tile_px else greatest(size_x, size_y) end as eff from s)
    select image_id, cast(case when eff >= greatest(size_x, size_y) then 1 else ceil(size_y / greatest(1.0e0, eff * (1 - overlap))) * ceil(size_x / greatest(1.0e0, eff * (1 - overlap))) end as bigint) as n_tiles, section_px * 1024.0e0 / greatest(eff, 1) as apparent_px from e""",
)
def effect_readout(fx):
    return costs.effect_readout(fx.images.selectExpr("image_id", "size_x", "size_y", "(image_id * 512) % 4096 as tile_px", "0.1e0 * (image_id % 5) as overlap", "20.0e0 + image_id % 90 as section_px"))


@query("apparent_size", "with s as (" + SET + "), a as (select image_id, section_px * 1024.0e0 / greatest(tile_px, 1) as apparent from s) select *, case when apparent >= 16 then 'reliable' when apparent < 8 then 'unreliable' else 'marginal' end as band from a")
def apparent_size(fx):
    a = fx.images.selectExpr("image_id", "(20.0e0 + image_id % 90) * 1024.0e0 / greatest((image_id * 512) % 4096, 1) as apparent")
    return a.withColumn("band", F.when(F.col("apparent") >= 16, "reliable").when(F.col("apparent") < 8, "unreliable").otherwise("marginal"))


@query(
    "model_resolve",
    "with " + HOST + ", " + ASKED + """, r as (select req_id, case req_id % 6 when 0 then 'Auto' when 1 then '' when 2 then 'tiny' when 3 then 'small' when 4 then 'base_plus' else 'large' end as pref, model, case when req_id % 2 = 0 then 'sam2.1_hiera_base_plus.pt' else 'sam2.1_hiera_tiny.pt' end as active from a join h using (host_id)),
    v as (select *, case when pref in ('Auto', '') then model else pref end as variant from r)
    select req_id, variant, case when variant in ('small', 'base_plus') then 'sam2.1_hiera_' || variant || '.pt' else active end as checkpoint, variant not in ('small', 'base_plus') and not contains(active, variant) as fell_back from v""",
)
def model_resolve(fx):
    rows = asked(fx).join(F.broadcast(costs.host_budget(fx.hosts)), "host_id").selectExpr(
        "req_id", "case req_id % 6 when 0 then 'Auto' when 1 then '' when 2 then 'tiny' when 3 then 'small' when 4 then 'base_plus' else 'large' end as preference", "model as host_model", "case when req_id % 2 = 0 then 'sam2.1_hiera_base_plus.pt' else 'sam2.1_hiera_tiny.pt' end as active"
    )
    inventory = fx.spark.createDataFrame([("sam2.1_hiera_small.pt",), ("sam2.1_hiera_base_plus.pt",)], "file string")
    return costs.model_resolve(rows, inventory)


FILES = "'models/' || case {p}_partkey % 7 when 0 then 'sam2.1_Hiera_TINY.pt' when 1 then 'x_small.pth' when 2 then 'sam2_b+.bin' when 3 then 'bplus.onnx' when 4 then 'vit_large.pt' when 5 then 'vit_h.pth' else 'base_plus_large.pt' end || ''"


@query(
    "model_config",
    "with f as (select p_partkey as part_id, " + FILES.replace("{p}", "p") + """ as file from {part}), n as (select *, lower(regexp_extract(file, '([^/]*)$', 1)) as name from f)
    select part_id, file, 'configs/sam2.1/sam2.1_hiera_' || case when contains(name, 'tiny') then 't' when contains(name, 'small') then 's' when contains(name, 'base_plus') or contains(name, 'b+') or contains(name, 'bplus') then 'b+' when contains(name, 'large') then 'l' else 'b+' end || '.yaml' as config,
    name like '%.pt' or contains(name, 'sam2') as new_family from n""",
)
def model_config(fx):
    files = fx.part.selectExpr("p_partkey as part_id", FILES.replace("{p}", "p") + " as file")
    return files.join(costs.model_config(files.select("file").distinct()), "file").select("part_id", "file", "config", "new_family")


@query("ruler", "select meas_id, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / (125.28e0 * mag) as mm, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / (125.28e0 * mag) / nullif(original_mm, 0) as ratio from {measurements}")
def ruler(fx):
    return costs.ruler(fx.measurements)


SETTINGS = """st as (select i.image_id, case when i.image_id % 11 = 0 then null else zoom end as zoom, case when i.image_id % 3 = 0 then null else 3072.0e0 end as ov_given, case when i.image_id % 4 = 0 then null else tile_cap_px end as tile_cap,
      case when i.image_id % 4 = 0 then null else points_per_batch end as batch, case when i.image_id % 4 = 0 then null else model end as model, is_slide from {images} i join h on h.host_id = i.image_id % 8 + 1)"""


def settings(fx):
    hosts = costs.host_budget(fx.hosts).select(F.col("host_id").cast("long").alias("host_id"), "tile_cap_px", "points_per_batch", "model")
    rows = fx.images.withColumn("host_id", F.col("image_id") % 8 + 1).join(F.broadcast(hosts), "host_id")
    return rows.selectExpr(
        "image_id", "case when image_id % 11 = 0 then null else zoom end as zoom", "case when image_id % 3 = 0 then null else 3072.0e0 end as ov_given", "case when image_id % 4 = 0 then null else tile_cap_px end as tile_cap",
        "case when image_id % 4 = 0 then null else points_per_batch end as batch", "case when image_id % 4 = 0 then null else model end as model", "is_slide",
    )


def _calibration_sql(stats: str, settings_name: str, prefix: str) -> str:
    p = prefix
    return f"""{p}b as (select s.*, coalesce(n, 0) as n_examples, n is null as error, ma as median_area, mi as minor_px, coalesce(nullif(zoom, 0), 1.0e0) as z, sqrt(ma) as section_px from {settings_name} s left join {stats} x using (image_id)),
    {p}o as (select *, coalesce(ov_given, greatest(round_even(40 * section_px, 0), 2048.0e0)) as ov_long, coalesce(tile_cap, 4096) as cap from {p}b),
    {p}t as (select *, minor_px * 1024.0e0 / greatest(ov_long, 1) as apparent, case when n_examples = 0 then null else least(case when minor_px >= 24 then case when ov_long > 1024 then 1024.0e0 else ov_long end else floor(least(greatest(round_even(minor_px * 1024.0e0 / 24, 0), 256), ov_long)) end, cap) end as tile_px from {p}o),
    {p}p as (select *, least(greatest(ceil(tile_px * sqrt(2.0e0 / greatest(median_area, 1))), 16), 128) as pps_raw, section_px * 1024.0e0 / greatest(tile_px, 1) as d, 1.5e0 * section_px / greatest(tile_px, 1) as share, greatest(1, ceil(24.0e0 / greatest(apparent, 1e-6))) as need from {p}t),
    {p}c as (select image_id, n_examples, error, median_area, minor_px, section_px, section_px / z as section_px_full, minor_px / z as minor_px_full, median_area / (z * z) as median_area_full,
      ov_long, tile_px, tile_px < ov_long as tiled, case when not error then pps_raw end as pps, median_area * (pps_raw / greatest(tile_px, 1)) ** 2 as points, case when not error then least(greatest(share, 0.15e0), 0.5e0) end as tile_overlap, case when not error then least(greatest(share, 0.2e0), 0.6e0) end as crop_overlap,
      case when error then null when d >= 16 then 0 else 1 end as crop_layers, case when error then null when d >= 16 then 1 else 2 end as crop_downscale, case when d >= 20 then 0.85e0 when d >= 10 then 0.8e0 when not error then 0.75e0 end as iou_threshold, case when d >= 20 then 0.96e0 when d >= 10 then 0.95e0 when not error then 0.92e0 end as stability_threshold,
      0.5e0 * median_area as min_area, 2.0e0 * median_area as max_area, round_even(0.05e0 * median_area, 0) as cleanup_floor, coalesce(batch, 16) as batch, coalesce(model, 'base_plus') as model,
      case when ov_given is not null and not error then apparent end as whole_image_section_px,
      case when ov_given is not null and not error then 1024.0e0 * least(greatest(need, 1), least(greatest(1, floor(ov_given / z / 1024)), case when tile_cap is not null then greatest(1, floor(tile_cap / 1024.0e0)) else need end)) end as recommended_overview from {p}p)"""


EXAMPLES = RING.replace("with v as", "v as") + ", pa as (select image_id, mask_id, abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2 as a from v group by image_id, mask_id), " + MINOR
STATS = "ex as (select image_id, count(*) as n, median(a) as ma, median(minor_axis) as mi from pa join minor using (image_id, mask_id) where a > 0 group by image_id)"
CALIBRATED = "with " + HOST + ", " + SETTINGS + ", " + EXAMPLES + ", " + STATS + ", " + _calibration_sql("ex", "st", "q")


def examples(fx):
    return fx.sections.select("image_id", "polygon")


#: Doubles that went through medians and roots are rounded on both sides.
ROUNDED = ("median_area", "minor_px", "section_px", "section_px_full", "minor_px_full", "median_area_full", "points", "tile_overlap", "crop_overlap", "min_area", "max_area", "whole_image_section_px")
REPLACE = " replace (" + ", ".join([f"round({c}, 6) as {c}" for c in ROUNDED] + [f"cast({c} as bigint) as {c}" for c in ("crop_layers", "crop_downscale", "batch")]) + ")"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ROUNDED})


@query("calibrate", CALIBRATED + " select *" + REPLACE + " from qc")
def calibrate(fx):
    return _rounded(cal.calibrate(examples(fx), settings(fx).drop("is_slide")))


@query(
    "calibrate_two_pass",
    CALIBRATED + """, redo as (select st.*, recommended_overview, recommended_overview / ov_given as r from st join qc using (image_id) where is_slide and recommended_overview is not null and recommended_overview <> ov_given),
    ex2 as (select image_id, count(*) as n, median(a * r * r) as ma, median(minor_axis * r) as mi from pa join minor using (image_id, mask_id) join redo using (image_id) where a > 0 group by image_id),
    st2 as (select image_id, coalesce(nullif(zoom, 0), 1.0e0) * r as zoom, recommended_overview as ov_given, tile_cap, batch, model, is_slide from redo), """ + _calibration_sql("ex2", "st2", "w")
    + " select *" + REPLACE + ", 1 as pass from qc where image_id not in (select image_id from redo) union all select *" + REPLACE + ", 2 from wc",
)
def calibrate_two_pass(fx):
    return _rounded(cal.calibrate_two_pass(examples(fx), settings(fx)))


@query(
    "calibration_summary",
    CALIBRATED + """ select image_id, case when error then 'no usable example' else 'calibrated from ' || n_examples || ' examples: section ~' || cast(round_even(section_px, 0) as bigint) || 'px (thin ~' || cast(round_even(minor_px, 0) as bigint) || 'px, area ' || cast(round_even(median_area, 0) as bigint) || '); '
    || case when tiled then 'tiles' else 'single tile' end || ' tile_px=' || cast(tile_px as bigint) || ', points_per_side=' || cast(pps as bigint) || ', pred_iou=' || printf('%.2f', iou_threshold) end as summary from qc""",
)
def calibration_summary(fx):
    return cal.calibration_summary(cal.calibrate(examples(fx), settings(fx).drop("is_slide")))


CUTS = """a as (select image_id, quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.995) as hi, max(v) as top from {pixels} group by image_id),
    b as (select p.image_id, quantile_cont(v, 0.995) as hi2 from {pixels} p join a using (image_id) where v < top group by p.image_id),
    c as (select image_id, lo, case when hi >= top and hi2 is not null then hi2 else hi end as h from a left join b using (image_id)), cuts as (select image_id, lo, case when h <= lo then lo + 1 else h end as hi from c)"""


@query("contrast_cuts", "with " + CUTS + " select * from cuts")
def contrast_cuts(fx):
    return cal.contrast_cuts(fx.pixels)


@query("contrast_apply", "with " + CUTS + " select image_id, x, y, v, cast(floor(power(least(greatest((v - lo) / (hi - lo), 0), 1), 0.8e0) * 255) as bigint) as byte from {pixels} join cuts using (image_id)")
def contrast_apply(fx):
    return cal.contrast_apply(fx.pixels, cal.contrast_cuts(fx.pixels), 0.8)
