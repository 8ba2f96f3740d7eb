"""Raster kernels for glyphs: NumPy on one mask, and Arrow wrappers that give feature columns."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from inkgrid.session import map_arrow

#: Sides and margin of a mask, cells of a signature, passes of thinning, and weights of the glyph distance.
SIDE, PAD, CELLS, PASSES = 48, 4, 4, 100
WEIGHTS = {"chamfer": 0.30, "jaccard": 0.50, "aspect": 0.15, "holes": 0.50, "height": 2.5, "base": 1.5, "ends": 0.10, "junctions": 0.10}
STEPS = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def rasterise(polylines: list[list[tuple[float, float]]], side: int = SIDE, pad: int = PAD) -> np.ndarray:
    """A mask of polylines, their proportions kept, centred with a margin."""
    mask = np.zeros((side, side), bool)
    points = np.array([p for line in polylines for p in line], float).reshape(-1, 2)
    if not len(points):
        return mask
    low, extent = points.min(axis=0), np.ptp(points, axis=0)
    scale = (side - 1 - 2 * pad) / max(extent.max(), 1e-9)
    shift = (side - 1 - extent * scale) / 2
    for line in polylines:
        ends = (np.array(line, float) - low) * scale + shift
        for a, b in pairwise(ends) if len(ends) > 1 else [(ends[0], ends[0])]:
            n = int(np.abs(b - a).max()) + 1
            dots = np.rint(a + (b - a) * np.linspace(0, 1, n + 1)[:, None]).astype(int)
            mask[np.clip(dots[:, 1], 0, side - 1), np.clip(dots[:, 0], 0, side - 1)] = True
    return mask


def rasterise_mask(mask: np.ndarray, side: int = SIDE, pad: int = PAD) -> tuple[np.ndarray, float]:
    """A bitmap's ink cropped, scaled to the standard mask (a cell is set where any ink falls in it) and centred; and its aspect."""
    out = np.zeros((side, side), bool)
    ys, xs = np.nonzero(mask)
    if not len(xs):
        return out, 1.0
    y, x = ys - ys.min(), xs - xs.min()
    h, w = int(y.max()) + 1, int(x.max()) + 1
    inner = side - 2 * pad
    nh, nw = (max(1, round(n * inner / max(w, h))) for n in (h, w))
    top, left = pad + (inner - nh) // 2, pad + (inner - nw) // 2
    small = np.zeros((nh, nw), bool)
    if nh >= h:  # every cell of the larger mask takes the pixel it lies in
        grid = np.zeros((h, w), bool)
        grid[y, x] = True
        small = grid[np.ix_(np.arange(nh) * h // nh, np.arange(nw) * w // nw)]
    else:
        small[y * nh // h, x * nw // w] = True
    out[top : top + nh, left : left + nw] = small
    return out, w / h


def rasterise_in(polylines: list[list[tuple[float, float]]], box: tuple[float, float, float, float], side: int = 32) -> np.ndarray:
    """A mask of polylines within a box, a pixel free around it: the pixels of each edge by integer steps along its longer axis."""
    mask = np.zeros((side, side), bool)
    w, h = max(box[2] - box[0], 1e-6), max(box[3] - box[1], 1e-6)
    scale = (side - 3) / max(w, h)
    shift = np.array([(side - w * scale) / 2, (side - h * scale) / 2])
    for line in polylines:
        cells = np.rint((np.array(line, float) - box[:2]) * scale + shift).astype(int)
        for a, b in pairwise(cells):
            n = int(np.abs(b - a).max())
            steps = np.arange(n + 1)[:, None]
            dots = a + np.floor((2 * steps * (b - a) + n) / (2 * n)).astype(int) if n else a[None, :]
            inside = ((dots >= 0) & (dots < side)).all(axis=1)
            mask[dots[inside, 1], dots[inside, 0]] = True
    return mask


def neighbours(mask: np.ndarray) -> np.ndarray:
    """The eight neighbours of every pixel, clockwise from above."""
    padded = np.pad(mask, 1)
    return np.stack([padded[1 + dy : padded.shape[0] - 1 + dy, 1 + dx : padded.shape[1] - 1 + dx] for dy, dx in STEPS])


def thin(mask: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning."""
    mask = mask.copy()
    for _ in range(PASSES):
        changed = False
        for odd in (False, True):
            p = neighbours(mask)
            count = p.sum(axis=0)
            turns = (~p & np.roll(p, -1, axis=0)).sum(axis=0)
            n, e, s, w = p[0], p[2], p[4], p[6]
            open_ = ~(n & e & w) & ~(n & s & w) if odd else ~(n & e & s) & ~(e & s & w)
            gone = mask & (count >= 2) & (count <= 6) & (turns == 1) & open_
            changed |= bool(gone.any())
            mask &= ~gone
        if not changed:
            break
    return mask


def labels(mask: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, int]:
    """Connected areas, numbered from 1, by spreading the least number."""
    number = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    steps = STEPS if diagonal else STEPS[::2]
    while True:
        padded = np.pad(number, 1)
        near = np.stack([padded[1 + dy : padded.shape[0] - 1 + dy, 1 + dx : padded.shape[1] - 1 + dx] for dy, dx in steps])
        best = np.where(mask, np.minimum(number, np.where(near > 0, near, mask.size + 1).min(axis=0)), 0)
        if (best == number).all():
            break
        number = best
    values, flat = np.unique(number, return_inverse=True)
    flat = flat.reshape(mask.shape)
    return (flat if values[0] == 0 else flat + 1), int((values > 0).sum())


def holes(mask: np.ndarray) -> int:
    """Areas of background that don't reach the border."""
    return labels(np.pad(~mask, 1, constant_values=True))[1] - 1


def topology(skeleton: np.ndarray) -> tuple[int, int]:
    """Ends and junctions of a skeleton; junction pixels that touch count once."""
    near = neighbours(skeleton).sum(axis=0)
    return int((skeleton & (near == 1)).sum()), labels(skeleton & (near >= 3), diagonal=True)[1]


def distances(mask: np.ndarray) -> np.ndarray:
    """Distance of every pixel to the nearest one of the mask."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return np.full(mask.shape, float(max(mask.shape)))
    gy, gx = np.mgrid[: mask.shape[0], : mask.shape[1]]
    return np.sqrt(((gy[..., None] - ys) ** 2 + (gx[..., None] - xs) ** 2).min(axis=-1))


def chamfer(a: np.ndarray, b: np.ndarray) -> float:
    """Mean distance between two skeletons, both ways."""
    if not a.any() or not b.any():
        return float(max(a.shape))
    return float((distances(b)[a].mean() + distances(a)[b].mean()) / 2)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """1 less the shared part of two masks, each a pixel wider."""
    a, b = a | neighbours(a).any(axis=0), b | neighbours(b).any(axis=0)
    union = (a | b).sum()
    return 1 - float((a & b).sum() / union) if union else 0.0


def signature(mask: np.ndarray) -> list[float]:
    """Shares of ink in a grid of cells."""
    step = mask.shape[0] // CELLS
    return mask[: step * CELLS, : step * CELLS].reshape(CELLS, step, CELLS, step).mean(axis=(1, 3)).ravel().tolist()


def features(polylines: list[list[tuple[float, float]]]) -> dict:
    mask = rasterise(polylines)
    skeleton = thin(mask)
    points = np.array([p for line in polylines for p in line], float).reshape(-1, 2)
    wide, tall = np.ptp(points, axis=0) if len(points) else (0.0, 0.0)
    ends, junctions = topology(skeleton)
    return {"aspect": float(wide / tall) if tall else None, "holes": holes(mask), "ends": ends, "junctions": junctions, "ink": float(mask.mean()), "signature": signature(mask), "mask": np.packbits(mask).tobytes()}


def unpack(mask: bytes, side: int = SIDE) -> np.ndarray:
    return np.unpackbits(np.frombuffer(mask, np.uint8), count=side * side).reshape(side, side).astype(bool)


def distance(a: dict, b: dict) -> float:
    """The weighted distance of two glyphs: masks, proportions, holes, size and place on the line, ends and junctions."""
    sa, sb = thin(unpack(a["mask"])), thin(unpack(b["mask"]))
    ratio = min(abs(float(np.log((a["aspect"] or 1e-3) / (b["aspect"] or 1e-3)))), 1.2)
    gap = lambda k: abs((a.get(k) or 0) - (b.get(k) or 0))
    w = WEIGHTS
    return w["chamfer"] * chamfer(sa, sb) + w["jaccard"] * jaccard(sa, sb) + w["aspect"] * ratio + w["holes"] * gap("holes") + w["height"] * gap("height") + w["base"] * gap("base") + w["ends"] * min(gap("ends"), 4) + w["junctions"] * min(gap("junctions"), 4)


TYPES = [("aspect", pa.float64(), "double"), ("holes", pa.int32(), "int"), ("ends", pa.int32(), "int"), ("junctions", pa.int32(), "int"), ("ink", pa.float64(), "double"), ("signature", pa.list_(pa.float64()), "array<double>"), ("mask", pa.binary(), "binary")]


def with_features(glyphs: DataFrame, polylines: str = "polylines") -> DataFrame:
    """glyphs with the features of their polylines (an array of arrays of (x, y))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(batch.schema.get_field_index(polylines)).to_pylist()
            rows = [features([[(p["x"], p["y"]) for p in line] for line in glyph or []]) for glyph in lines]
            extra = [pa.array([r[name] for r in rows], t) for name, t, _ in TYPES]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *(name for name, _, _ in TYPES)])

    extra = StructType.fromDDL(", ".join(f"{name} {ddl}" for name, _, ddl in TYPES))
    return map_arrow(glyphs, run, StructType([*glyphs.schema.fields, *extra.fields]))


def classify(glyphs: DataFrame, bank: list[dict], keep: int = 6) -> DataFrame:
    """glyphs (with features) with alternatives: the nearest characters of a bank of features with their distances.

    The bank is a fixed set of prototypes (character and features), sent to the workers as it is.
    """
    element = pa.list_(pa.struct([("character", pa.string()), ("distance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, list] = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["mask"] not in memo:
                    best: dict[str, float] = {}
                    for p in bank:
                        best[p["character"]] = min(best.get(p["character"], np.inf), distance(row, p))
                    memo[row["mask"]] = [{"character": c, "distance": d} for d, c in sorted((d, c) for c, d in best.items())[:keep]]
                out.append(memo[row["mask"]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, element)], [*batch.schema.names, "alternatives"])

    extra = StructType.fromDDL("alternatives array<struct<character: string, distance: double>>")
    return map_arrow(glyphs, run, StructType([*glyphs.schema.fields, *extra.fields]))


def assign(costs: np.ndarray, duplicate: float = 0.45, reject: float = 3.4, slots: int = 3) -> list[int]:
    """The cheapest assignment of clusters (rows) to characters (columns); -1 where rejecting is cheaper.

    A character has slots, each one dearer by duplicate; the Hungarian method with potentials finds the optimum.
    """
    n, m = costs.shape
    wide = np.concatenate([costs + k * duplicate for k in range(slots)] + [np.full((n, n), reject)], axis=1)
    columns = wide.shape[1]
    u, v, match, way = np.zeros(n + 1), np.zeros(columns + 1), np.zeros(columns + 1, int), np.zeros(columns + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(columns + 1, np.inf), np.zeros(columns + 1, bool)
        while True:
            used[j0] = True
            slack = np.concatenate(([np.inf], wide[match[j0] - 1] - u[match[j0]] - v[1:]))
            better = ~used & (slack < least)
            least[better], way[better] = slack[better], j0
            j1 = int(np.where(used, np.inf, least).argmin())
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, columns + 1):
        if match[j] and j <= m * slots:
            out[match[j] - 1] = (j - 1) % m
    return out
