"""The spectral order of an image's sections, by block Lanczos steps over blocks of the similarity matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, forget, shuffles_go
from .blocks import BLOCK, groups, kind, numbers, over_pairs, packed, side, sizes, to_groups

#: Vectors of a step, for images of at least 64 times as many sections: each step costs a few jobs whatever they are, and
#: takes with w vectors about as many steps as the gap to the w-th eigenvalue, and not to the next one, asks for.
WIDTH = 32
#: Vectors of all steps of an image at most.
VECTORS = 2048
#: Vectors that an image holds at most: before a step would lead over it, the KEPT vectors of the least values that
#: the basis can give take its place, and the newest vectors go on from them.
HELD, KEPT = 384, 128
#: The share of the tolerance at which an image leaves: what is held brings it nearer by less a step than all vectors did.
LEAVES = 0.1
#: A new vector's length as a share of the largest degree, at which the space counts as exhausted.
EXHAUSTED = 1e-7
#: Rows of a step, one a block: basis holds the vectors so far, the constant one first, of which the last ``width`` are new;
#: y the Laplacian times the new ones; dots the block's shares of the products of basis and y, basis and new, y and y.
STATE = "a int, n long, width int, degree binary, basis binary, y binary, dots binary"
#: The next new vectors, by rows; off is the share of the products of y without its parts along the basis.
FRESH = "a int, width int, v binary, off binary"
#: Rows of a step, one an image: products of the next basis without its new vectors, with the Laplacian times it and with itself; what
#: takes y off the basis and makes it new vectors; the least vector in terms of the basis; what makes the next basis of it (empty: it stays).
SMALL = "top double, h binary, nn binary, along binary, mix binary, u binary, turn binary"


def times(blocks: DataFrame, vectors: DataFrame, dealt: tuple[DataFrame, int, int]) -> DataFrame:
    """(image_id, a, wv): the matrix max(similarity, 0) without its diagonal times vectors(image_id, a, v), by blocks of rows.

    The matrix is made block by block where it is needed and never kept.  A task holds a group of blocks of rows, by which
    all blocks of the image come with their vectors; ``dealt`` is what ``_dealt`` gave.
    """
    sent = to_groups(blocks.join(vectors.select("image_id", F.col("a").alias("b"), "v"), ["image_id", "b"]), *dealt)

    def multiply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own, waiting, sums = None, [], [], []

        def put(b: int, m: np.ndarray, v: np.ndarray) -> None:
            for k, (a, rows) in enumerate(own):
                w = rows @ m.T
                np.clip(w, 0.0, 1.0, out=w)
                if a == b:
                    np.fill_diagonal(w, 0.0)
                sums[k] += w @ v

        def settle() -> None:
            sums[:] = [np.zeros((len(m), v.shape[1])) for _, m, v in waiting]
            for one in waiting:
                put(*one)
            waiting.clear()

        def done() -> pd.DataFrame:
            if waiting:
                settle()
            return pd.DataFrame({"image_id": [now[0]] * len(own), "a": [a for a, _ in own], "wv": [y.tobytes() for y in sums]})

        for part in parts:
            for image, b, width, data, v, home, g in part[["image_id", "b", "width", "data", "v", "home", "g"]].itertuples(index=False):
                m = numbers(data, width)
                v = numbers(v).reshape(len(m), -1)
                if (image, g) != now:
                    if now is not None:
                        yield done()
                    now, own, sums = (image, g), [], []
                if home == g:  # the task's own blocks come first
                    own.append((b, m))
                    waiting.append((b, m, v))
                    continue
                if waiting:
                    settle()
                put(b, m, v)
        if now is not None:
            yield done()

    return sent.mapInPandas(multiply, f"image_id {kind(blocks, 'image_id')}, a int, wv binary")


def _dealt(blocks: DataFrame) -> tuple[DataFrame, int, int]:
    """The groups of all images, the blocks of a group, and the number of parts."""
    images, cores = sizes(blocks), blocks.sparkSession.sparkContext.defaultParallelism
    k = side(images, cores)
    parts = max(cores, min(4 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(-(-n // k) * many for n, many in images)))
    return cut(groups(blocks, images, k, parts)), k, parts


def _rows(df: DataFrame, change: Callable, schema: str) -> DataFrame:
    """change of each row (a named tuple) into a tuple of the schema's columns."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([change(r) for r in part.itertuples(index=False)], columns=names)

    return df.mapInPandas(run, schema)


def _dense(blocks: DataFrame) -> DataFrame:
    """(image_id, section_id, x, residual) of images of one block, by a full decomposition."""

    def solve(products: Iterator[tuple]) -> Iterator[dict]:
        for image, _, _, ids, _, _, s in products:
            w = np.maximum(s, 0.0)
            np.fill_diagonal(w, 0.0)
            lap = np.diag(w.sum(axis=1)) - w
            x, residual = np.zeros(len(ids)), 0.0
            if len(ids) > 2:
                # the constant vector is moved to the far end, so that of several zeros another one is taken
                values, vectors = np.linalg.eigh(lap + (2 * lap.trace() + 1) / len(ids))
                x = vectors[:, 0] - vectors[:, 0].mean()
                x /= max(np.linalg.norm(x), 1e-300)
                residual = float(np.linalg.norm(lap @ x - (x @ lap @ x) * x))
            yield {"image_id": [image] * len(ids), "section_id": ids, "x": x, "residual": [residual] * len(ids)}

    return over_pairs(blocks, solve, f"image_id {kind(blocks, 'image_id')}, section_id long, x double, residual double")


def _shares(basis: np.ndarray, y: np.ndarray, width: int) -> bytes:
    """The products of a block: basis and y, basis and its last ``width`` vectors, y and y."""
    return np.concatenate([(basis @ y).ravel(), (basis @ basis[-width:].T).ravel(), (y.T @ y).ravel()]).tobytes()


def _begin(blocks: DataFrame, dealt: tuple[DataFrame, int, int]) -> DataFrame:
    """The first state: degrees, and a fixed start whose constant part is not taken off yet."""
    image = f"image_id {kind(blocks, 'image_id')}"
    sized = blocks.select("image_id", F.col("b").alias("a"), F.size("ids").alias("m"))
    ones = _rows(sized, lambda r: (r.image_id, r.a, np.ones(r.m).tobytes()), f"{image}, a int, v binary")
    before = F.coalesce(F.sum("m").over(Window.partitionBy("image_id").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = sized.withColumn("before", before).withColumn("n", F.sum("m").over(Window.partitionBy("image_id")))

    def start(r) -> tuple:  # noqa: ANN001
        m = len(numbers(r.wv))
        k, j = np.arange(1.0, m + 1)[:, None] + r.before, np.arange(max(1, min(WIDTH, r.n // 64)))
        y, basis = np.sin(k * k * (1.7 + 0.37 * j) + k * (j + 1)), np.full((1, m), 1 / np.sqrt(r.n))
        return r.image_id, r.a, r.n, 1, r.wv, basis.tobytes(), y.tobytes(), _shares(basis, y, 1)

    return _rows(times(blocks, ones, dealt).join(sized, ["image_id", "a"]), start, f"{image}, {STATE}")


def _least(h: np.ndarray, nn: np.ndarray, live: np.ndarray) -> np.ndarray:
    """The vectors of the least values in terms of the basis without the constant one, by columns, the least first.

    The products of the basis with itself take part, so rounding in its making costs no accuracy.
    """
    some = np.flatnonzero(live[1:]) + 1
    out = np.zeros((len(live), len(some)))
    if len(some):
        low = np.linalg.inv(np.linalg.cholesky(nn[np.ix_(some, some)]))
        a = low @ h[np.ix_(some, some)] @ low.T
        out[some] = low.T @ np.linalg.eigh((a + a.T) / 2)[1]
    return out


def _small(state: DataFrame, before: DataFrame | None) -> DataFrame:
    """The images' rows: sums of what the blocks told, put to those of the steps before."""
    image = f"image_id {kind(state, 'image_id')}"

    def weigh(told: pd.DataFrame, old: pd.DataFrame | None) -> pd.DataFrame:
        told = told.sort_values("a")
        flat, c, width = np.sum([numbers(x) for x in told["dots"]], axis=0), int(told["c"].iloc[0]), int(told["width"].iloc[0])
        p = int(told["p"].iloc[0])
        along, new, yy = flat[: c * p].reshape(c, p), flat[c * p : c * (p + width)].reshape(c, width), flat[c * (p + width) :].reshape(p, p)
        h, nn = np.zeros((c, c)), np.zeros((c, c))
        nn[:, c - width :], nn[c - width :] = new, new.T
        if old is not None:
            h[:, c - width :], h[c - width :] = along, along.T
            h[: c - width, : c - width], nn[: c - width, : c - width] = numbers(old["h"].iloc[0], c - width), numbers(old["nn"].iloc[0], c - width)
        top, live = float(told["top"].max()), np.diag(nn) > 0.5
        off = np.zeros((c, p))
        off[live] = np.linalg.solve(nn[np.ix_(live, live)], along[live])
        size, turn = np.linalg.eigh(yy - along.T @ off)
        keep = size > (EXHAUSTED * top if old is not None else EXHAUSTED) ** 2
        mix = turn * np.where(keep, 1 / np.sqrt(np.where(keep, size, 1.0)), 0.0)
        least = _least(h, nn, live)
        u = least[:, 0] if least.shape[1] else np.zeros(c)
        turn = np.zeros((c, 0))
        if c + p > HELD and least.shape[1]:
            turn = np.hstack([np.eye(c, 1), least[:, :KEPT]])
            h, nn = turn.T @ h @ turn, turn.T @ nn @ turn
        row = {"h": h, "nn": nn, "along": off, "mix": mix, "u": u, "turn": turn}
        return pd.DataFrame({"image_id": told["image_id"].iloc[:1], "top": [top], **{name: [x.tobytes()] for name, x in row.items()}})

    def share(r) -> tuple:  # noqa: ANN001
        m = len(numbers(r.degree))
        return r.image_id, r.a, r.width, len(numbers(r.basis)) // m, len(numbers(r.y)) // m, float(numbers(r.degree).max()), r.dots

    told = _rows(state, share, f"{image}, a int, width int, c int, p int, top double, dots binary").groupBy("image_id")
    if before is None:
        return told.applyInPandas(lambda g: weigh(g, None), f"{image}, {SMALL}")

    def both(told: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        return weigh(told, old) if len(told) else pd.DataFrame({c.split()[0]: [] for c in f"{image}, {SMALL}".split(", ")})

    return told.cogroup(before.groupBy("image_id")).applyInPandas(both, f"{image}, {SMALL}")


def _orthogonal(state: DataFrame, small: DataFrame) -> DataFrame:
    """The next new vectors: y without its parts along the basis."""

    def take_off(r) -> tuple:  # noqa: ANN001
        m = len(numbers(r.degree))
        basis, y = numbers(r.basis, m), numbers(r.y).reshape(m, -1)
        y = y - basis.T @ numbers(r.along, y.shape[1])
        return r.image_id, r.a, y.shape[1], (y @ numbers(r.mix, y.shape[1])).tobytes(), (y.T @ y).tobytes()

    rows = state.select("image_id", "a", "degree", "basis", "y").join(small.select("image_id", "along", "mix"), "image_id")
    return _rows(rows, take_off, f"image_id {kind(state, 'image_id')}, {FRESH}")


def _judged(fresh: DataFrame, small: DataFrame, tolerance: float) -> DataFrame:
    """(image_id, width, u, ended): the least vector in terms of the basis, and whether it lacks at most LEAVES x tolerance x (largest degree)."""

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("a")
        p, off, u = int(group["width"].iloc[0]), np.sum([numbers(x) for x in group["off"]], axis=0), numbers(group["u"].iloc[0])
        lack = float(np.sqrt(max(u[-p:] @ off.reshape(p, p) @ u[-p:], 0.0)))
        return pd.DataFrame({"image_id": group["image_id"].iloc[:1], "width": [p], "u": [u.tobytes()], "ended": [lack <= max(LEAVES * tolerance * group["top"].iloc[0], 1e-300)]})

    # the image's vector stands beside one of its rows only
    told = fresh.select("image_id", "a", "width", "off").join(small.select("image_id", F.lit(0).alias("a"), "top", "u"), ["image_id", "a"], "left")
    return told.groupBy("image_id").applyInPandas(judge, f"image_id {kind(fresh, 'image_id')}, width int, u binary, ended boolean")


def _onward(state: DataFrame, fresh: DataFrame, small: DataFrame, blocks: DataFrame, dealt: tuple[DataFrame, int, int]) -> DataFrame:
    """The next state: the new vectors put to the basis, and the Laplacian times them."""

    def put(r) -> tuple:  # noqa: ANN001
        degree = numbers(r.degree)
        m = len(degree)
        basis, v = numbers(r.basis, m), numbers(r.v, r.p)
        if len(r.turn):
            basis = numbers(r.turn).reshape(len(basis), -1).T @ basis
        basis, y = np.vstack([basis, v.T]), degree[:, None] * v - numbers(r.wv, r.p)
        return r.image_id, r.a, r.n, r.p, r.degree, basis.tobytes(), y.tobytes(), _shares(basis, y, r.p)

    new = fresh.select("image_id", "a", F.col("width").alias("p"), "v").join(times(blocks, fresh, dealt), ["image_id", "a"]).join(small.select("image_id", "turn"), "image_id")
    return _rows(state.select("image_id", "a", "n", "degree", "basis").join(new, ["image_id", "a"]), put, f"image_id {kind(state, 'image_id')}, {STATE}")


def _with_residual(found: DataFrame, blocks: DataFrame, dealt: tuple[DataFrame, int, int]) -> DataFrame:
    """(image_id, section_id, x, residual) of found(image_id, a, degree, v)."""
    image = f"image_id {kind(found, 'image_id')}"

    def share(r) -> tuple:  # noqa: ANN001
        x = numbers(r.v)
        lx = numbers(r.degree) * x - numbers(r.wv)
        return r.image_id, r.a, r.v, lx.tobytes(), float(x @ lx), float(x @ x)

    rows = cut(_rows(found.join(times(blocks, found, dealt), ["image_id", "a"]), share, f"{image}, a int, v binary, lx binary, xlx double, xx double"))
    value = rows.groupBy("image_id").agg((F.sum("xlx") / F.sum("xx")).alias("value"))
    off = _rows(rows.join(value, "image_id"), lambda r: (r.image_id, float(np.sum((numbers(r.lx) - r.value * numbers(r.v)) ** 2))), f"{image}, off double")
    residual = off.groupBy("image_id").agg(F.sqrt(F.sum("off")).alias("residual"))
    listed = _rows(rows.join(blocks.select("image_id", F.col("b").alias("a"), "ids"), ["image_id", "a"]), lambda r: (r.image_id, r.ids, numbers(r.v)), f"{image}, ids array<long>, x array<double>")
    pairs = listed.select("image_id", F.explode(F.arrays_zip("ids", "x")).alias("p")).select("image_id", F.col("p.ids").alias("section_id"), "p.x")
    return pairs.join(residual, "image_id")


def spectral_vectors(thumbs: DataFrame, tolerance: float = 1e-8, steps: int = 400, check: int = 3, block: int = BLOCK) -> DataFrame:
    """(image_id, section_id, x, residual) of normalised thumbs: the unit eigenvector of the second-smallest eigenvalue of
    the Laplacian of max(similarity, 0), and the length of what the Laplacian times x lacks to a multiple of x.

    Images of up to ``block`` sections are solved in one task each.  All larger ones take block Lanczos steps together: the matrix,
    made where it is needed, times up to WIDTH vectors, and sums by image, each new vector orthogonal to all that are held.  Every ``check``
    steps the images leave whose vector lacks at most LEAVES x tolerance x (largest degree); after ``steps`` steps, or VECTORS vectors, all do, and
    the residual tells how good they are.  A block of rows with its vectors is a row of at most some 8 * block * (HELD + WIDTH) bytes; what
    a step has written goes when the next one has read it.
    """
    blocks = cut(packed(thumbs, block))
    wide = blocks.where("b > 0").select("image_id").distinct()
    out = _dense(blocks.join(wide, "image_id", "left_anti"))
    large = cut(blocks.join(wide, "image_id", "left_semi"))
    if large.isEmpty():
        return out
    with shuffles_go(thumbs.sparkSession):
        dealt = _dealt(large)
        return out.union(_with_residual(_lanczos(large, dealt, tolerance, steps, check), large, dealt))


def _lanczos(large: DataFrame, dealt: tuple[DataFrame, int, int], tolerance: float, steps: int, check: int) -> DataFrame:
    """(image_id, a, degree, v) of all images, by steps that they take together."""
    state, small, found = cut(_begin(large, dealt)), None, []

    def best(r) -> tuple:  # noqa: ANN001
        return r.image_id, r.a, r.degree, (numbers(r.u) @ numbers(r.basis, len(numbers(r.degree)))).tobytes()

    for k in range(steps + 1):
        old, small = small, cut(_small(state, small))
        fresh, judged = cut(_orthogonal(state, small)), None
        goes_on, new = state, fresh
        if k and (k == steps or k % check == 0):
            last = (F.col("width") * (k + check) > VECTORS) & (F.col("width") > 1) | F.lit(k == steps)
            judged = cut(_judged(fresh, small, tolerance).withColumn("ended", F.col("ended") | last))
            ended = state.select("image_id", "a", "degree", "basis").join(judged.where("ended").select("image_id", "u"), "image_id")
            found.append(cut(_rows(ended, best, f"image_id {kind(large, 'image_id')}, a int, degree binary, v binary")))
            left = judged.where("not ended").select("image_id")
            if left.isEmpty():
                forget(state, fresh, small, old, judged)
                break
            goes_on, new = (df.join(left, "image_id", "left_semi") for df in (state, fresh))
        before, state = state, cut(_onward(goes_on, new, small, large, dealt))
        forget(before, fresh, old, judged)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every


def spectral_order(thumbs: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """(image_id, position, section_id, residual): sections by ``spectral_vectors``, rounded to 9 digits, the smaller id
    first on ties.  The sign is free: the end whose least section_id is smaller comes first."""
    rows = cut(spectral_vectors(thumbs, **how).withColumn("x", F.round("x", 9)))
    ends = rows.groupBy("image_id").agg((F.min_by("section_id", F.struct("x", "section_id")) > F.min_by("section_id", F.struct(-F.col("x"), "section_id"))).alias("turned"))
    along = F.row_number().over(Window.partitionBy("image_id").orderBy(F.when(F.col("turned"), -F.col("x")).otherwise(F.col("x")), "section_id")) - 1
    return rows.join(ends, "image_id").select("image_id", along.cast("long").alias("position"), "section_id", "residual")
