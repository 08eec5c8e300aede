"""Example views over the star-schema tables: the only place that knows their names.

The SQL reads the same in Spark and DuckDB; ``{name}`` stands for a base table or an
earlier view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"}

VIEWS: dict[str, str] = {
    "images": """
        select cast(c_custkey as bigint) as image_id, cast(2048 + (c_custkey * 977) % 8192 as bigint) as size_x,
               cast(2048 + (c_custkey * 1543) % 8192 as bigint) as size_y, c_custkey % 3 <> 0 as is_slide,
               1.0e0 / (1 + c_custkey % 4) as zoom, cast((c_custkey * 31) % 100 as double) as origin_x, cast((c_custkey * 17) % 100 as double) as origin_y,
               case when c_custkey % 7 = 0 then null else 0.000001e0 * (1 + c_custkey % 3) end as scale_m,
               cast(case when c_custkey % 5 = 0 then 2 else 1 end as bigint) as size_s
        from {customer} where c_custkey in (select user_id from {events})""",
    "detections": """
        select cast(user_id as bigint) as image_id, cast(event_id as bigint) as mask_id, cast(event_id % 9 as bigint) as tile_idx,
               cast(1 + floor(value * 100) as double) as area, (event_id * 37) % 1000 / 1000.0e0 as pred_iou, (event_id * 53) % 1000 / 1000.0e0 as stability,
               cast((event_id * 7919) % 512 as double) as cx, cast((event_id * 104729) % 512 as double) as cy,
               cast(4 + (event_id * 13) % 60 as double) as w, cast(4 + (event_id * 17) % 60 as double) as h
        from {events}""",
    "corners": """
        select image_id, mask_id, tile_idx, area, k, case when k in (0, 3) then cx - w / 2 else cx + w / 2 end as x, case when k in (0, 1) then cy - h / 2 else cy + h / 2 end as y
        from {detections} cross join (select cast(0 as bigint) as k union all select 1 union all select 2 union all select 3) ks
        where k < case when mask_id % 11 = 0 then 2 when mask_id % 11 = 1 then 3 else 4 end""",
    "fiducials": """
        select cast(s_nationkey as bigint) as image_id, cast(s_suppkey as bigint) as fid_key, cast((s_suppkey * 389) % 4096 as double) as x, cast((s_suppkey * 733) % 4096 as double) as y,
               cast(row_number() over (partition by s_nationkey order by s_suppkey) as bigint) as idx
        from {supplier}""",
    "clicks": """
        select cast(user_id as bigint) as image_id, cast(event_id as bigint) as click_id, cast((event_id * 7919) % 512 + event_id % 7 - 3 as double) as x,
               cast((event_id * 104729) % 512 + event_id % 5 - 2 as double) as y
        from {events} where event_type = 'click'""",
    "measurements": """
        select cast(o_orderkey as bigint) as meas_id, cast(o_orderkey % 2048 as double) as x1, cast((o_orderkey * 7) % 2048 as double) as y1,
               cast((o_orderkey * 11) % 2048 as double) as x2, cast((o_orderkey * 13) % 2048 as double) as y2, 0.75e0 + (o_orderkey % 3) * 0.25e0 as mag,
               cast(1 + o_orderkey % 5 as double) as original_mm
        from {orders}""",
    "pixels": """
        select cast(p_partkey % 10 as bigint) as image_id, cast(p_partkey % 64 as bigint) as x, cast((p_partkey * 5) % 64 as bigint) as y,
               case when p_partkey % 50 = 0 then cast(65535 as bigint) else cast(floor(p_retailprice) as bigint) end as v
        from {part}""",
    "requests": """
        select cast(o_orderkey as bigint) as req_id, cast(o_custkey as bigint) as image_id, cast(16 + 8 * (o_orderkey % 5) as bigint) as pps, cast(o_orderkey % 4 as bigint) as crop_layers
        from {orders}""",
    "thumbs": """
        select cast(label as bigint) as image_id, cast(vec_id as bigint) as section_id, embedding as vec from {embeddings}""",
    "hosts": """
        select * from (values (1, 'cuda', 64.0e0, 48.0e0, 12.0e0, 16), (2, 'cuda', 16.0e0, 10.0e0, 4.0e0, 8), (3, 'cuda', 32.0e0, 20.0e0, 8.0e0, 12),
               (4, 'mps', 24.0e0, 12.0e0, 0.0e0, 10), (5, 'mps', 8.0e0, 3.0e0, 0.0e0, 8), (6, 'cpu', 32.0e0, 24.0e0, 0.0e0, 4), (7, 'cpu', 4.0e0, 1.0e0, 0.0e0, 2), (8, 'cpu', 10.0e0, 6.0e0, 0.0e0, 1))
        as t(host_id, device, ram_gb, avail_gb, vram_gb, cores)""",
    "pass_rates": """
        select * from (values ('cuda', 'tiny', 0.3e0), ('cuda', 'small', 0.5e0), ('cuda', 'base_plus', 0.9e0), ('cuda', 'large', 1.6e0), ('mps', 'tiny', 1.5e0), ('mps', 'small', 2.5e0),
               ('mps', 'base_plus', 4.0e0), ('mps', 'large', 7.0e0), ('cpu', 'tiny', 12.0e0), ('cpu', 'small', 22.0e0), ('cpu', 'base_plus', 45.0e0), ('cpu', 'large', 90.0e0))
        as t(device, model, seconds)""",
}


def _needed(sql: str) -> list[str]:
    """Views that the text names, in the order of VIEWS."""
    todo, seen = set(re.findall(r"\{(\w+)\}", sql)), set()
    while todo:
        name = todo.pop()
        if name in VIEWS and name not in seen:
            seen.add(name)
            todo |= set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return [v for v in VIEWS if v in seen]


def oracle(sql: str) -> str:
    """The SQL with the views that it names as common table expressions, for DuckDB."""
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    ctes = [f"{v} as ({plain(VIEWS[v])})" for v in _needed(sql)]
    body = plain(sql).strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive"):
        return f"with recursive {', '.join(ctes)}, {body[14:]}"
    if body.lower().startswith("with "):
        return f"with {', '.join(ctes)}, {body[5:]}"
    return f"with {', '.join(ctes)} {body}"


class Fixtures:
    """DataFrames of the views over one folder of tables: ``Fixtures(spark, dir).detections``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                needs = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
                self._made[name] = self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in needs})
        return self._made[name]

    @property
    def sections(self) -> DataFrame:
        """detections with a polygon: the rectangle around the centre, a triangle or two vertices."""
        from ..functions.polygons import polygon_of_rows

        return polygon_of_rows(self.detections)


