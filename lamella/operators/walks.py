"""The greedy order of an image's sections, from lists of nearest neighbours that are filled again when they run out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .blocks import BLOCK, kind, over_pairs, packed


def neighbour_lists(blocks: DataFrame, most: int) -> DataFrame:
    """(image_id, section_id, near, total): each section's up to ``most`` nearest others of its image, the
    smaller id first on ties of similarities rounded to 9 digits, and the sum over all, itself included."""

    def best(products: Iterator[tuple]) -> Iterator[dict]:
        now, held = None, {}
        for image, g, a, own, _, other, s in products:
            if (image, g) != now:
                yield from (lists(now[0], *one) for one in held.values())
                now, held = (image, g), {}
            ids, near, ranks, total = held.get(a) or (own, np.empty((len(own), 0), "i8"), np.empty((len(own), 0)), np.zeros(len(own)))
            names = np.concatenate([near, np.broadcast_to(other, s.shape)], axis=1)
            marks = np.concatenate([ranks, np.where(own[:, None] == other[None, :], np.inf, -np.round(s, 9))], axis=1)
            order = np.lexsort((names, marks), axis=1)[:, :most]
            held[a] = ids, np.take_along_axis(names, order, 1), np.take_along_axis(marks, order, 1), total + s.sum(axis=1)
        yield from (lists(now[0], *one) for one in held.values())

    def lists(image, ids: np.ndarray, near: np.ndarray, _ranks: np.ndarray, total: np.ndarray) -> dict:  # noqa: ANN001
        others = [row[row != me] for me, row in zip(ids, near, strict=True)]  # itself is last, if the list is long enough for it
        return {"image_id": [image] * len(ids), "section_id": ids, "near": others, "total": np.round(total, 9)}

    return over_pairs(blocks, best, f"image_id {kind(blocks, 'image_id')}, section_id long, near array<long>, total double")


def stretch(lists: DataFrame) -> DataFrame:
    """(image_id, position, section_id, left) of lists(image_id, section_id, near, total, position): one image's
    walk, from the section that has a position (the first of least total if none has) until a list holds no
    section that is left.  ``left`` is the number of sections that the walk did not reach."""

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("section_id")
        begun = group[group["position"].notna()]
        at = begun.iloc[0] if len(begun) else group.loc[group["total"].idxmin()]
        near = dict(zip(group["section_id"], group["near"], strict=True))
        path, seen = [int(at["section_id"])], {int(at["section_id"])}
        while True:
            onward = next((int(j) for j in near[path[-1]] if int(j) not in seen), None)
            if onward is None:
                break
            path.append(onward)
            seen.add(onward)
        first = int(at["position"]) if len(begun) else 0
        rows = pd.DataFrame({"position": np.arange(first, first + len(path)), "section_id": path, "left": len(group) - len(path)})
        rows.insert(0, "image_id", group["image_id"].iloc[0])
        return rows.iloc[1:] if len(begun) else rows

    return lists.groupBy("image_id").applyInPandas(walk, f"image_id {kind(lists, 'image_id')}, position long, section_id long, left long")


def greedy_order(thumbs: DataFrame, most: int = 256, block: int = BLOCK) -> DataFrame:
    """(image_id, position, section_id) of normalised thumbs(image_id, section_id, vec).

    Starts at the section with the least total similarity, then goes on to the most similar one that is left;
    the first on ties.  A task holds the ``most`` nearest of each section of an image, never all pairs.  Where a
    list has run out, the lists of the sections that are left are made anew; between two times an image's walk
    goes on by at least ``most`` sections, so an image of n sections takes n / most rounds at worst.
    """
    left = cut(thumbs.where("image_id is not null and section_id is not null").select("image_id", "section_id", "vec"))
    ends, done = None, None
    while True:
        lists = neighbour_lists(packed(left, block), most)
        lists = lists.withColumn("position", F.lit(None).cast("long")) if ends is None else lists.join(ends, ["image_id", "section_id"], "left")
        part = cut(stretch(lists))
        done = part if done is None else done.union(part)
        ends = part.where("left > 0").groupBy("image_id").agg(F.max_by(F.struct("section_id", "position"), "position").alias("e")).select("image_id", "e.*")
        if ends.isEmpty():
            return done.select("image_id", "position", "section_id")
        passed = part.join(ends, ["image_id", "section_id"], "left_anti")
        left = cut(left.join(ends.select("image_id"), "image_id", "left_semi").join(passed, ["image_id", "section_id"], "left_anti"))
