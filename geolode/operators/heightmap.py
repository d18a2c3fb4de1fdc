"""Heightmaps of patches: triangulation and interpolation of sparse samples, many patches at a time.

A patch's context has some dozens to hundreds of samples (one point in 50,000 of a 960 m window); however many it has, all of them count. Spark deals patches out, joins their
contexts and sorts each task's rows by patch; the task triangulates a few hundred patches in step with each other, as arrays over all of them, and interpolates one after another in
blocks of bounded size beside the samples themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.functions import columns as C
from geolode.operators.raster import rounded

LEAST_SAMPLES, UNSEEN, OUTSIDE = 25, -2, -1
#: Corners that close the hull; their values are unknown.
CORNERS = np.array([(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)])

#: Grid points of faces' boxes, and distances to samples, that are handled at once; side of the blocks of grid points that share their candidates, and samples up to which they do.
CELLS, DISTANCES, BLOCK, SHARED = 1 << 18, 1 << 20, 8, 5000
#: Patches, and samples, that are triangulated together; patches of a batch of results.
TOGETHER, SAMPLES, HANDED = 256, 1 << 16, 32

Model = Callable[[dict[str, np.ndarray]], np.ndarray]


def grid_points(extent: float, resolution: int) -> np.ndarray:
    """resolution x resolution points from -extent / 2 on, rows of one y after another."""
    at = -extent / 2 + np.arange(resolution) * (extent / resolution)
    x, y = np.meshgrid(at, at)
    return np.column_stack([x.ravel(), y.ravel()])


def triangulate(points: np.ndarray) -> np.ndarray:
    """Delaunay faces (vertex numbers, counter-clockwise, sorted) of one set of points."""
    return triangulate_all(points, [len(points)])[1]


def triangulate_all(points: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Delaunay faces of sets of points, which follow each other: each face's set, and its vertex numbers there, counter-clockwise; sorted. By insertion into an enclosing triangle.

    Points are inserted in the order of their coordinates, so a permutation of the input gives the same faces. Of equal points the first counts.
    A face whose circle lies wholly before the point that is inserted is final, so each insertion looks at the few faces near the front only. The sets go in step: each
    gets its next point in the same turn.
    """
    sizes = np.asarray(sizes, int)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    far = np.ones(len(sizes))
    np.maximum.at(far, owner, np.abs(points).max(1, initial=0.0))
    far *= 1e4
    # each set's points, and then the three of its enclosing triangle
    begin = np.cumsum(sizes) - sizes + 3 * np.arange(len(sizes))
    at, edge = np.arange(len(points)) + 3 * owner, begin + sizes
    x, y, outer = np.empty(len(points) + 3 * len(sizes)), np.empty(len(points) + 3 * len(sizes)), np.ones(len(points) + 3 * len(sizes), bool)
    x[at], y[at], outer[at] = points[:, 0], points[:, 1], False
    x[edge], x[edge + 1], x[edge + 2] = -far, far, 0.0
    y[edge], y[edge + 1], y[edge + 2] = -far, -far, far
    all_owners = np.repeat(np.arange(len(sizes)), sizes + 3)
    many = len(x)
    # turns: the k-th distinct point of every set
    order = at[np.lexsort((points[:, 1], points[:, 0], owner))]
    if len(order):
        new = np.ones(len(order), bool)
        new[1:] = (all_owners[order[1:]] != all_owners[order[:-1]]) | (x[order[1:]] != x[order[:-1]]) | (y[order[1:]] != y[order[:-1]])
        order = order[new]
    owned = all_owners[order]
    turn = np.arange(len(order)) - np.searchsorted(owned, owned)
    by_turn = np.argsort(turn, kind="stable")
    cuts = np.searchsorted(turn[by_turn], np.arange(1, turn.max(initial=0) + 1))

    def circled(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        return a, b, c, *_circle((x[a], y[a]), (x[b], y[b]), (x[c], y[c]))

    front = circled(edge, edge + 1, edge + 2)
    final = []
    inserted = np.empty(len(sizes), int)
    for some in np.split(by_turn, cuts) if len(order) else []:
        inserted[:] = -1
        inserted[owned[some]] = order[some]
        a, b, c, cx, cy, r = front
        k = inserted[all_owners[a]]
        dx, dy = x[k] - cx, y[k] - cy
        active = k >= 0
        hit = active & (dx * dx + dy * dy < r)
        past = ~active | (~hit & (dx > 0) & (dx * dx > r))
        final.append((a[past], b[past], c[past]))
        # the holes' borders: edges that only one face of a hole has
        ha, hb, hc = a[hit], b[hit], c[hit]
        codes = np.unique(np.concatenate([ha * many + hb, hb * many + hc, hc * many + ha]))
        u, v = codes // many, codes % many
        back = v * many + u
        place = np.minimum(np.searchsorted(codes, back), max(len(codes) - 1, 0))
        border = codes[place] != back
        u, v = u[border], v[border]
        stay = ~(hit | past)
        front = tuple(np.concatenate([f[stay], n]) for f, n in zip(front, circled(u, v, inserted[all_owners[u]]), strict=True))
    found = np.stack([np.concatenate([f[k] for f in final] + [front[k]]) for k in range(3)], 1)
    found = found[~outer[found].any(1)]
    owners = all_owners[found[:, 0]]
    # each face from its smallest vertex on, the faces in order
    found = found - begin[owners, None]
    first = found.argmin(1)[:, None]
    found = np.take_along_axis(found, (first + np.arange(3)) % 3, 1)
    order = np.lexsort((*found.T[::-1], owners))
    return owners[order], found[order]


def _circle(a: tuple, b: tuple, c: tuple) -> tuple:
    """Centres (x and y) and squared radii, a hair more, of the circles around triangles (numbers or arrays of them)."""
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    d = 2 * (bx * cy - by * cx)
    d = np.where(np.abs(d) >= 1e-300, d, 1e-300)
    bb, cc = bx * bx + by * by, cx * cx + cy * cy
    with np.errstate(over="ignore", invalid="ignore"):
        ux, uy = (cy * bb - by * cc) / d, (bx * cc - cx * bb) / d
        return a[0] + ux, a[1] + uy, (ux * ux + uy * uy) * (1 + 1e-12)


def locate(points: np.ndarray, faces: np.ndarray, extent: float, resolution: int, edge: int = 0, to: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The lowest face that holds each grid point (OUTSIDE if none) and the three weights there, of the to x to grid points from edge on. Each face looks only at the grid points of its box."""
    to = resolution if to is None else to
    step, low = extent / resolution, -extent / 2
    at = low + np.arange(resolution) * step
    found, weights = np.full(to * to, OUTSIDE), np.zeros((to * to, 3))
    corners = points[faces]
    first = np.clip(np.ceil((corners.min(1) - low) / step - 1e-6), edge, edge + to).astype(int)
    last = np.clip(np.floor((corners.max(1) - low) / step + 1e-6) + 1, edge, edge + to).astype(int)
    a, b, c = corners[:, 0], corners[:, 1], corners[:, 2]
    whole = (b[:, 1] - c[:, 1]) * (a[:, 0] - c[:, 0]) + (c[:, 0] - b[:, 0]) * (a[:, 1] - c[:, 1])
    wide = np.maximum(last - first, 0)
    size = np.where(whole != 0, wide[:, 0] * wide[:, 1], 0)
    # faces one after another, as many at once as have so many grid points in their boxes
    upto = np.cumsum(size)
    some = np.flatnonzero(size)
    for part in np.split(some, np.flatnonzero(np.diff(upto[some] // CELLS)) + 1) if len(some) else []:
        n = size[part]
        each = lambda v, part=part, n=n: np.repeat(v[part], n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        down, across = np.divmod(k, each(wide[:, 0]))
        i, j = each(first[:, 0]) + across, each(first[:, 1]) + down
        x, y = at[i] - each(c[:, 0]), at[j] - each(c[:, 1])
        over = each(whole)
        u = (each(b[:, 1] - c[:, 1]) * x + each(c[:, 0] - b[:, 0]) * y) / over
        v = (each(c[:, 1] - a[:, 1]) * x + each(a[:, 0] - c[:, 0]) * y) / over
        w = 1 - u - v
        cell = (j - edge) * to + (i - edge)
        # from the last face to the first, so that the lowest one stays
        inside = np.flatnonzero((u >= -1e-9) & (v >= -1e-9) & (w >= -1e-9) & (found[cell] == OUTSIDE))[::-1]
        cell = cell[inside]
        found[cell] = each(np.arange(len(faces)))[inside]
        weights[cell] = np.stack([u[inside], v[inside], w[inside]], 1)
    return found, weights


def nearest(points: np.ndarray, extent: float, resolution: int, edge: int = 0, to: int | None = None) -> np.ndarray:
    """Number of the nearest point for each of the to x to grid points from edge on, the first of equals; some rows of the grid at a time, or in blocks that share the points that may be nearest."""
    at = (-extent / 2 + np.arange(resolution) * (extent / resolution))[edge : edge + (resolution if to is None else to)]
    if len(at) % BLOCK == 0 and len(at) > 2 * BLOCK and len(points) <= SHARED and np.isfinite(points).all():
        return _nearest_in_blocks(points, at)
    rows, columns = np.divmod(np.arange(len(at) ** 2), len(at))
    return nearest_at(points, at[columns], at[rows])


def nearest_at(points: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of the nearest point for each place, the first of equals; every distance, so many at a time."""
    many = min(max(1, len(points)), DISTANCES)
    some = max(1, DISTANCES // many)
    best, found = np.full(len(x), np.inf), np.zeros(len(x), int)
    for k in range(0, len(x), some):
        rows = slice(k, k + some)
        for first in range(0, len(points), many):
            dx, dy = (v[rows, None] - points[first : first + many, a] for a, v in enumerate((x, y)))
            d2 = dx * dx + dy * dy
            at = d2.argmin(1)
            least = d2[np.arange(len(at)), at]
            nearer = least < best[rows]
            best[rows], found[rows] = np.where(nearer, least, best[rows]), np.where(nearer, at + first, found[rows])
    return found


def _nearest_in_blocks(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    n, blocks = len(at), at.reshape(-1, BLOCK)
    gap, reach = [], []
    for a in range(2):
        before, behind = blocks[:, :1] - points[:, a], points[:, a] - blocks[:, -1:]
        gap.append(np.maximum(np.maximum(before, behind), 0) ** 2)
        reach.append(np.maximum(-before, -behind) ** 2)
    # a point whose nearest place in a block is further than another's furthest is nearest to no place there
    bound = (reach[1][:, None] + reach[0]).min(2)
    by, bx, k = np.nonzero(gap[1][:, None] + gap[0] <= bound[:, :, None] * (1 + 1e-9) + 1e-12)
    which = by * len(blocks) + bx
    found = np.empty((len(blocks) ** 2, BLOCK, BLOCK), int)
    begin = np.searchsorted(which, np.arange(len(found) + 1))
    some = max(1, DISTANCES // (BLOCK * BLOCK))
    cuts = [0]
    while cuts[-1] < len(found):  # whole blocks, so many pairs at a time
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(begin, begin[cuts[-1]] + some, "right")) - 1))
    for low, high in zip(cuts, cuts[1:], strict=False):
        pairs = slice(begin[low], begin[high])
        dx, dy = blocks[bx[pairs]] - points[k[pairs], :1], blocks[by[pairs]] - points[k[pairs], 1:]
        d2 = (dx * dx)[:, None, :] + (dy * dy)[:, :, None]
        starts = begin[low:high] - begin[low]
        least = np.minimum.reduceat(d2, starts, axis=0)
        number = np.where(d2 == least[which[pairs] - low], k[pairs, None, None], len(points))
        found[low:high] = np.minimum.reduceat(number, starts, axis=0)
    side = len(blocks)
    return found.reshape(side, side, BLOCK, BLOCK).swapaxes(1, 2).reshape(n * n)


def interpolate(points: np.ndarray, values: np.ndarray, resolution: int, extent: float = 1.0, edge: int = 0, to: int | None = None, faces: np.ndarray | None = None, near: bool = True) -> dict[str, np.ndarray]:
    """Rasters of values (n, k): nearest, linear (nearest where no face of known corners is) and mask (0 or OUTSIDE), of the to x to grid points from edge on; faces are those of points and CORNERS.

    Without near there is no nearest raster, and only grid points that need one look for a nearest point.
    """
    to = resolution if to is None else to
    padded = np.vstack([points, CORNERS])
    if faces is None:
        faces = triangulate(padded)
    found, weights = locate(padded, faces, extent, resolution, edge, to)
    touches = (faces >= len(points)).any(1)
    mask = np.where((found == OUTSIDE) | touches[found], OUTSIDE, 0)
    known = np.flatnonzero(mask == 0)
    rasters = {"mask": mask, "face": found}
    if near:
        rasters["nearest"] = values[nearest(points, extent, resolution, edge, to)]
        linear = rasters["nearest"].copy()
    else:
        at = -extent / 2 + np.arange(resolution) * (extent / resolution)
        unknown = np.flatnonzero(mask)
        linear = np.empty((to * to, values.shape[1]))
        linear[unknown] = values[nearest_at(points, at[edge + unknown % to], at[edge + unknown // to])]
    corners, w = faces[found[known]], weights[known]
    linear[known] = values[corners[:, 0]] * w[:, :1] + values[corners[:, 1]] * w[:, 1:2] + values[corners[:, 2]] * w[:, 2:]
    return rasters | {"linear": linear}


def model_input(rasters: dict[str, np.ndarray], resolution: int) -> dict[str, np.ndarray]:
    """What a learned model gets: height (1 x n x n) and colour (3 x n x n) maps of both interpolations."""
    out = {}
    for kind in ("nearest", "linear"):
        image = rasters[kind].reshape(resolution, resolution, -1)
        out[f"patch_hm_{kind}"], out[f"patch_rgb_{kind}"] = image[None, :, :, 0], np.moveaxis(image[:, :, 1:], 2, 0)
    return out


def crop(raster: np.ndarray, resolution: int, to: int) -> np.ndarray:
    edge = (resolution - to) // 2
    return raster.reshape(resolution, resolution, -1)[edge : edge + to, edge : edge + to].reshape(to * to, -1)


def masked_colours(colours: np.ndarray, mask: np.ndarray, side: int) -> np.ndarray:
    """Colours (0 to 1) of side x side texels as bytes, which are cut, not rounded; 0 where a texel or one beside it lies in no face of known corners."""
    out = np.pad(mask.reshape(side, side) == OUTSIDE, 1)
    near = np.any([out[a : a + side, b : b + side] for a in range(3) for b in range(3)], axis=0).ravel()
    return np.where(near[:, None], 0.0, np.floor(np.clip(colours, 0.0, 1.0) * 255.0))


def by_patch(context: DataFrame, order: list[str]) -> DataFrame:
    """context dealt over all shuffle partitions by patch, and sorted by patch there.

    A patch is little data and much work. Adaptive execution would put many into one task for their size, but for a number of
    partitions that is asked for, by a key of its own: the join before has dealt by px and py already.
    """
    parts = int(context.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = context.select("px", "py", *order).withColumn("deal", F.xxhash64("px", "py")).repartition(parts, "deal").drop("deal")
    return dealt.sortWithinPartitions("px", "py")


def whole_patches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns of rows sorted by patch, whole patches at a time (up to TOGETHER of them, or SAMPLES rows but for a larger one), and where each patch begins, with the end."""
    kept: list[dict[str, np.ndarray]] = []
    for batch in batches:
        rows = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(batch.schema.names)}
        if not len(rows["px"]):
            continue
        # what was kept is of one patch
        if kept and (kept[-1]["px"][-1], kept[-1]["py"][-1]) != (rows["px"][0], rows["py"][0]):
            yield from _parts(_joined(kept))
            kept = []
        last = int(np.flatnonzero((rows["px"] == rows["px"][-1]) & (rows["py"] == rows["py"][-1]))[0])
        if last:
            yield from _parts(_joined([*kept, {n: v[:last] for n, v in rows.items()}]))
            kept = []
        kept.append({n: v[last:] for n, v in rows.items()})
    if kept:
        yield from _parts(_joined(kept))


def _joined(some: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return some[0] if len(some) == 1 else {n: np.concatenate([rows[n] for rows in some]) for n in some[0]}


def _parts(rows: dict[str, np.ndarray]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    begin = np.concatenate([[0], np.flatnonzero((np.diff(rows["px"]) != 0) | (np.diff(rows["py"]) != 0)) + 1, [len(rows["px"])]])
    at = 0
    while at < len(begin) - 1:
        end = min(max(at + 1, int(np.searchsorted(begin, begin[at] + SAMPLES, "right")) - 1), at + TOGETHER, len(begin) - 1)
        yield {n: v[begin[at] : begin[end]] for n, v in rows.items()}, begin[at : end + 1] - begin[at]
        at = end


class Samples:
    """Patches' distinct samples: normalised places and values (height, r, g, b), how many rows and which mean height each patch has, and on demand their triangulations with CORNERS."""

    def __init__(self, rows: dict[str, np.ndarray], begin: np.ndarray) -> None:
        self.px, self.py, self.n = rows["px"][begin[:-1]], rows["py"][begin[:-1]], np.diff(begin)
        part = np.repeat(np.arange(len(self.n)), self.n)
        order = np.lexsort([rows[c] for c in ("b", "g", "r", "lz", "ly", "lx") if c in rows] + [part])
        rows = {c: v[order] for c, v in rows.items()}
        xy = np.column_stack([(rows[f"l{a}"] - (rows[f"p{a}"] + 0.5) * C.PATCH) / C.RADIUS * C.STRETCH for a in "xy"])
        # the first of equal places
        at = np.lexsort((xy[:, 1], xy[:, 0], part))
        new = np.ones(len(at), bool)
        new[1:] = (part[at[1:]] != part[at[:-1]]) | (xy[at[1:]] != xy[at[:-1]]).any(1)
        at = at[new]
        self.xy, self.begin = xy[at], np.searchsorted(part[at], np.arange(len(self.n) + 1))
        if "lz" in rows:
            self.base = np.array([rows["lz"][a:b].mean() for a, b in zip(begin, begin[1:], strict=False)])
            height = (rows["lz"][at] - self.base[part[at]]) / C.RADIUS * 10
            self.values = np.column_stack([height, *[rows[c][at] / 256.0 for c in "rgb" if c in rows]])

    def of(self, k: int) -> slice:
        return slice(self.begin[k], self.begin[k + 1])

    def faces(self, some: np.ndarray) -> dict[int, np.ndarray]:
        """Faces of some patches, triangulated together."""
        if not len(some):
            return {}
        padded = [np.vstack([self.xy[self.of(k)], CORNERS]) for k in some]
        owners, found = triangulate_all(np.concatenate(padded), [len(p) for p in padded])
        return dict(zip(some.tolist(), np.split(found, np.searchsorted(owners, np.arange(1, len(some)))), strict=True))


def heightmaps(
    context: DataFrame, resolution: int = C.CONTEXT_TEXELS, learned: int = C.TEXELS, method: str = "linear", model: Model | None = None, means: bool = False, fields: tuple[str, ...] = ("height", "red", "green", "blue", "mask"),
    masked: bool = False, decimals: int | None = None,
) -> DataFrame:
    """A row per patch of context (px, py, lx, ly, lz, r, g, b): its central learned x learned raster of heights and colours, those that fields names.

    Fewer than LEAST_SAMPLES samples make a blank patch. Samples are normalised around the patch's centre and mean height; model, if any, maps the
    input maps to height (and colour) maps of the learned size, in normalised heights. With means, the means of the rasters stand for them, and there is no mask.
    With masked, colours are bytes as ``masked_colours`` makes them; with decimals, heights and colours are rounded.
    """
    fields = tuple(f for f in fields if not (means and f == "mask"))
    kinds = {f: "double" if means else "array<int>" if f == "mask" else "array<double>" for f in fields}
    coloured = model is not None or set(fields) & set(COLOURS)
    edge = (resolution - learned) // 2
    # heights of the nearest samples need no faces
    flat = method == "nearest" and model is None and "mask" not in fields and not masked
    exact = (lambda v: v) if decimals is None else (lambda v: rounded(v, decimals))

    def one(s: Samples, k: int, faces: np.ndarray | None) -> dict[str, object]:
        xy, values, radius = s.xy[s.of(k)], s.values[s.of(k)], C.RADIUS
        if flat:
            picture = values[nearest(xy, 1.0, resolution, edge, learned)]
        elif model is None:
            rasters = interpolate(xy, values, resolution, 1.0, edge, learned, faces, near=method == "nearest")
            picture, mask = rasters[method], rasters["mask"]
        else:
            rasters = interpolate(xy, values, resolution, faces=faces)
            picture, mask = crop(rasters[method], resolution, learned), crop(rasters["mask"][:, None], resolution, learned)[:, 0]
            made = model(model_input(rasters, resolution))
            picture = np.column_stack([made.reshape(len(made), -1).T, picture[:, len(made) :]])
            radius = C.RADIUS_OUT
        if masked:
            picture = np.column_stack([picture[:, 0], masked_colours(picture[:, 1:], mask, learned)])
        if means:
            height, colours = picture[:, 0].mean() / 10 * radius + s.base[k], picture[:, 1:].mean(0)
        else:
            height, colours = picture[:, 0] / 10 * radius + s.base[k], picture[:, 1:].T
        found = {"height": exact(height)} | {n: exact(v) for n, v in zip(COLOURS, colours, strict=False)}
        return found if means or flat else found | {"mask": mask.astype(np.int32)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.float64() if means else pa.list_(pa.int32() if f == "mask" else pa.float64()) for f in fields]
        for rows, begin in whole_patches(batches):
            s = Samples(rows, begin)
            blank = s.n < LEAST_SAMPLES
            faces = {} if flat else s.faces(np.flatnonzero(~blank))
            for low in range(0, len(s.n), HANDED):
                some = range(low, min(low + HANDED, len(s.n)))
                maps = [dict.fromkeys(fields) if blank[k] else one(s, k, faces.get(k)) for k in some]
                part = slice(some.start, some.stop)
                heads = [pa.array(s.px[part], pa.int32()), pa.array(s.py[part], pa.int32()), pa.array(s.n[part], pa.int32()), pa.array(blank[part], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*heads, *[pa.array([m[f] for m in maps], t) for f, t in zip(fields, types, strict=True)]], ["px", "py", "n", "blank", *fields])

    schema = ", ".join(["px int, py int, n int, blank boolean", *[f"{f} {kinds[f]}" for f in fields]])
    return by_patch(context, ["lx", "ly", "lz", *("rgb" if coloured else "")]).mapInArrow(run, schema)


COLOURS = ("red", "green", "blue")


def faces(context: DataFrame) -> DataFrame:
    """px, py, face and its vertices v0, v1, v2: numbers of the patch's distinct samples in order of lx, ly; corners come last. area is a face's, of the 4 that all faces of a patch cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in whole_patches(batches):
            s = Samples(rows, begin)
            for k, found in s.faces(np.arange(len(s.n))).items():
                whole = np.vstack([s.xy[s.of(k)], CORNERS])
                a, b, c = (whole[found[:, j]] for j in range(3))
                area = ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / 2
                numbers = [np.full(len(found), s.px[k]), np.full(len(found), s.py[k]), np.arange(len(found)), *found.T]
                yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.int32()) for v in numbers], pa.array((found >= len(whole) - len(CORNERS)).any(1)), pa.array(area)], [f.split()[0] for f in FACES.split(", ")])

    return by_patch(context, ["lx", "ly"]).mapInArrow(run, FACES)


FACES = "px int, py int, face int, v0 int, v1 int, v2 int, padded boolean, area double"


def exploded(maps: DataFrame, size: int = C.TEXELS) -> DataFrame:
    """px, py, i, j, height and, where maps have them, colours and mask of every texel."""
    names = [n for n in ("height", *COLOURS, "mask") if n in maps.columns]
    cells = maps.filter("NOT blank").select("px", "py", F.posexplode(F.arrays_zip(*names)).alias("k", "cell"))
    return cells.select("px", "py", (F.col("k") % size).alias("i"), F.floor(F.col("k") / size).cast("int").alias("j"), *[f"cell.{n}" for n in names])


def cropped(maps: DataFrame, resolution: int = C.CONTEXT_TEXELS, to: int = C.TEXELS) -> DataFrame:
    """maps with the middle to x to texels of their heights."""
    edge = (resolution - to) // 2
    rows = F.transform(F.sequence(F.lit(edge), F.lit(edge + to - 1)), lambda j: F.slice("height", j * resolution + edge + 1, F.lit(to)))
    return maps.withColumn("height", F.flatten(rows))


INPUTS = "px int, py int, base double, patch_hm_nearest array<double>, patch_hm_linear array<double>, patch_rgb_nearest array<double>, patch_rgb_linear array<double>"
MAPS = tuple(c.split()[0] for c in INPUTS.split(", ")[3:])


def _inputs(batches: Iterator[pa.RecordBatch], resolution: int) -> Iterator[tuple[int, int, float, dict[str, np.ndarray]]]:
    """px, py, mean height and the input maps of each patch that has enough samples."""
    for rows, begin in whole_patches(batches):
        s = Samples(rows, begin)
        for k, found in s.faces(np.flatnonzero(s.n >= LEAST_SAMPLES)).items():
            yield s.px[k], s.py[k], s.base[k], model_input(interpolate(s.xy[s.of(k)], s.values[s.of(k)], resolution, faces=found), resolution)


def model_inputs(context: DataFrame, resolution: int = C.CONTEXT_TEXELS) -> DataFrame:
    """The input maps of each patch that has enough samples, flat, channel by channel."""
    kinds = [pa.int32(), pa.int32(), pa.float64(), *[pa.list_(pa.float64())] * len(MAPS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _some(_inputs(batches, resolution), HANDED):
            columns = [*list(zip(*some, strict=True))[:3], *[[m[3][n].ravel() for m in some] for n in MAPS]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["px", "py", "base", *MAPS])

    return by_patch(context, ["lx", "ly", "lz", *"rgb"]).mapInArrow(run, INPUTS)


def _some(rows: Iterator, most: int) -> Iterator[list]:
    kept = []
    for row in rows:
        kept.append(row)
        if len(kept) == most:
            yield kept
            kept = []
    if kept:
        yield kept


def infer(context: DataFrame, model: Model, batch: int = 16, resolution: int = C.CONTEXT_TEXELS) -> DataFrame:
    """px, py and the heights that a model of stacked maps (batch x channels x n x n) gives, however many it gets at once. Maps are made in the task that asks the model, so they never leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _some(_inputs(batches, resolution), batch):
            made = model({n: np.stack([m[3][n] for m in some]) for n in MAPS})[:, 0].reshape(len(some), -1)
            heights = made / 10 * C.RADIUS_OUT + np.array([m[2] for m in some])[:, None]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in some], pa.int32()), pa.array([m[1] for m in some], pa.int32()), pa.array(list(heights), pa.list_(pa.float64()))], ["px", "py", "height"])

    return by_patch(context, ["lx", "ly", "lz", *"rgb"]).mapInArrow(run, "px int, py int, height array<double>")
