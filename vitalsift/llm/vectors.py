"""Near-duplicate embeddings: every pair compared in tiles, leading principal coordinates first.

All vectors are turned into the axes of their second moment, strongest axis first, which leaves
every dot product as it is. After the leading coordinates a pair's cosine is at most the sum so
far plus the product of the two remaining norms. With each remaining norm as one more
coordinate, one matrix product gives that bound for a whole tile; only pairs whose bound reaches
the threshold go on to further coordinates, and most stop after the first step.

Vectors are ordered along the strongest axis and cut into tiles of bounded size. Two unit vectors
with a cosine of at least t are at most sqrt(2 - 2 t) apart on any axis, so tiles further apart than that are
never paired. A task holds two tiles and returns, per vector, how many others it is linked to,
and one edge to the smallest vector it is connected to inside the task: never the pairs.
Equal vectors form one class, compared once and counted by its copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalsift.llm.common import Workspace, components, roots_of

THRESHOLD = 0.95
TILE_BYTES = 2 << 20
STRIP = 256
#: Ranges along the strongest axis; what more vectors a range holds is cut into more tiles.
RANGES = 1024
PAIRS_AT_ONCE = 1 << 16
#: Steps end where this share of the vectors' energy remains; the last step has all coordinates.
REMAINING = (0.7, 0.4)
_SLACK = 1e-9

_ARROW_UNIT = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("unit", pa.binary())])
_ARROW_TURNED = pa.schema([
    ("id", pa.int64()), ("class", pa.int64()), ("copies", pa.int64()), ("lead", pa.float64()), ("turned", pa.binary()),
])
_ARROW_FOUND = pa.schema([("id", pa.int64()), ("class", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, dims, units = batch.column(0), [], []
        for vector in batch.column(1):
            values = vector.values
            if values is None or not len(values) or values.null_count:
                found = None
            else:
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(x).max()
                # Scaled first, so that squares neither overflow nor vanish.
                found = x / top if np.isfinite(top) and top > 0 else None
            dims.append(None if found is None else len(found))
            # Adding zero turns negative zeros into positive ones: equal vectors, equal bytes.
            units.append(None if found is None else (found / np.sqrt(found @ found) + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(dims, pa.int32()), pa.array(units, pa.binary())], schema=_ARROW_UNIT
        )


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _moments(dim: int):
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"moment": [total.tobytes()]})

    return moments


def _sum_moments(dim: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            for one in batch.column(0).to_pylist():
                total += np.frombuffer(one).reshape(dim, dim)
        yield pa.RecordBatch.from_pydict({"moment": [total.tobytes()]})

    return add


def principal_axes(units: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes as columns, strongest first, and the share of energy left after each.

    Second moments are added up inside the tasks and then by eight tasks, so the driver gets
    eight matrices however many vectors there are.
    """
    partial = units.select("unit").mapInArrow(_moments(dim), "moment binary")
    rows = partial.repartition(8).mapInArrow(_sum_moments(dim), "moment binary").collect()
    total = sum(np.frombuffer(bytes(r["moment"])).reshape(dim, dim) for r in rows)
    strength, axes = np.linalg.eigh(total)
    order = np.argsort(-strength, kind="stable")
    share = np.maximum(strength[order], 0) / max(strength.sum(), 1e-300)
    return axes[:, order], 1 - np.cumsum(share)


def _turner(axes: np.ndarray):
    dim = len(axes)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = _matrix(batch.column(3), dim) @ axes
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(turned[:, 0]), pa.array([row.tobytes() for row in turned], pa.binary())],
                schema=_ARROW_TURNED,
            )

    return turn


def linked_pairs(
    x: np.ndarray, y: np.ndarray, steps: list[int], threshold: float, same: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of ``x`` and ``y`` whose dot product reaches the threshold.

    ``steps`` are numbers of leading coordinates, the last of them all. With ``same`` the two
    tiles are one, and pairs have the smaller index first.
    """
    first = steps[0]
    rest = lambda z, k: np.sqrt((z[:, k:] ** 2).sum(axis=1))
    bound_x = np.column_stack([x[:, :first], rest(x, first)])
    bound_y = np.column_stack([y[:, :first], rest(y, first)]).T.copy()
    tails = [(rest(x, k), rest(y, k)) for k in steps[1:]]
    for at in range(0, len(x), STRIP):
        near = bound_x[at : at + STRIP] @ bound_y >= threshold - _SLACK
        left, right = np.nonzero(near)
        left += at
        if same:
            left, right = left[left < right], right[left < right]
        for cut in range(0, len(left), PAIRS_AT_ONCE):
            a, b = left[cut : cut + PAIRS_AT_ONCE], right[cut : cut + PAIRS_AT_ONCE]
            total, done = np.einsum("ij,ij->i", x[a, :first], y[b, :first]), first
            for k, (tail_x, tail_y) in zip(steps[1:], tails, strict=True):
                total = total + np.einsum("ij,ij->i", x[a, done:k], y[b, done:k])
                done = k
                slack = _SLACK if k < x.shape[1] else 0.0
                keep = total + tail_x[a] * tail_y[b] >= threshold - slack
                a, b, total = a[keep], b[keep], total[keep]
            if len(a):
                yield a, b


def _tile_comparer(dim: int, steps: list[int], threshold: float):
    def compare(rows: dict) -> pa.RecordBatch:
        order = np.argsort(rows["id"], kind="stable")
        ids, classes, copies = (np.array(rows[c], np.int64)[order] for c in ("id", "class", "copies"))
        side = np.array(rows["side"])[order]
        turned = np.frombuffer(b"".join(rows["turned"]), np.float64).reshape(-1, dim)[order]
        same = not side.any()
        mine = np.flatnonzero(side == 0)
        yours = mine if same else np.flatnonzero(side)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for a, b in linked_pairs(turned[mine], turned[yours], steps, threshold, same):
            a, b = mine[a], yours[b]
            links += np.bincount(a, copies[b], len(ids)).astype(np.int64)
            links += np.bincount(b, copies[a], len(ids)).astype(np.int64)
            label = roots_of(label[a], label[b], len(ids))[label]
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array(z, pa.int64()) for z in (ids[at], classes[at], links[at], ids[label[at]])], schema=_ARROW_FOUND
        )

    def compare_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("id", "class", "copies", "side", "turned")
        held = {n: [] for n in names}
        key = None
        for batch in batches:
            columns = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names}
            p, q = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(p) != 0) | (np.diff(q) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(p)], strict=True):
                if key != (p[a], q[a]) and held["id"]:
                    yield compare(held)
                    held = {n: [] for n in names}
                key = (p[a], q[a])
                for n in names:
                    held[n] += columns[n][a:b]
        if held["id"]:
            yield compare(held)

    return compare_all


def _compare_dimension(work: Workspace, classes: DataFrame, dim: int, threshold: float, tile_bytes: int) -> DataFrame:
    """(id, class, links, root) of the classes of one vector length that have links."""
    name = f"dim-{dim}"
    own = classes.filter(F.col("dim") == dim)
    axes, left = principal_axes(own, dim)
    steps = sorted({dim, *(min(dim, int(np.argmax(left <= r)) + 1) for r in REMAINING)})
    turned = work.store(f"{name}-turned", own.select("id", "class", "copies", "unit").mapInArrow(
        _turner(axes), "id long, class long, copies long, lead double, turned binary"
    ))
    # Ranges along the strongest axis; a range with many equal values is cut further by a hash.
    size = max(256, tile_bytes // (8 * dim))
    n = turned.count()
    parts = min(-(-n // size), RANGES)
    found = turned.agg(F.percentile_approx("lead", [k / parts for k in range(1, parts)] or [0.5], 100 * parts).alias("q")).first()["q"]
    bounds = sorted(set(found or [])) if parts > 1 else []
    # One more than the bounds at or below the value.
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    if groups:
        lead = F.col("lead")
        coarse = F.array(*[F.lit(g[0]) for g in groups])
        fine = F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups])
        group = F.size(F.filter(coarse, lambda b: b <= lead))
        inside = F.size(F.filter(F.get(fine, F.greatest(group - 1, F.lit(0))), lambda b: b <= lead))
        ranged = turned.withColumn("range", F.when(group == 0, 0).otherwise((group - 1) * step + inside))
    else:
        ranged = turned.withColumn("range", F.lit(0))
    # On the driver and in a broadcast: size and ends of at most RANGES ranges, whatever the table holds.
    ranges = ranged.groupBy("range").agg(F.count("*").alias("n"), F.min("lead").alias("low"), F.max("lead").alias("high")).orderBy("range").collect()
    lows, highs = (np.array([r[c] for r in ranges]) for c in ("low", "high"))
    blocks = np.array([-(-r["n"] // size) for r in ranges], np.int64)
    first = np.cumsum(blocks) - blocks
    at = np.arange(len(ranges))
    last = np.maximum(np.searchsorted(lows, highs + np.sqrt(2 - 2 * threshold) + _SLACK, side="right") - 1, at)
    # The first partner of a range is the first one that reaches up to it.
    begin = np.minimum(np.searchsorted(np.maximum.accumulate(last), at, side="left"), at)
    # All tiles of a range have the same partners: the tiles of neighbouring ranges, from low to high.
    places = turned.sparkSession.createDataFrame(
        [(r["range"], *map(int, (first[k], blocks[k], first[begin[k]], first[last[k]] + blocks[last[k]] - 1))) for k, r in enumerate(ranges)],
        "range int, first int, blocks int, low int, high int",
    )
    tiled = ranged.join(F.broadcast(places), "range").withColumn(
        "tile", F.col("first") + F.pmod(F.xxhash64("id", "class"), F.col("blocks")).cast("int")
    )
    rows = tiled.withColumn("other", F.explode(F.sequence("low", "high"))).select(
        F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"),
        "id", "class", "copies", (F.col("tile") > F.col("other")).cast("int").alias("side"), "turned",
    )
    return (
        rows.repartition("p", "q").sortWithinPartitions("p", "q")
        .mapInArrow(_tile_comparer(dim, steps, threshold), "id long, class long, links long, root long")
    )


def find_near_duplicates(
    work: Workspace, embeddings: DataFrame, threshold: float = THRESHOLD, tile_bytes: int = TILE_BYTES
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row of ``embeddings``.

    Rows are linked when their cosine in double precision is at least ``threshold``. Vectors that
    are null, empty, zero, or hold null or non-finite numbers link with nothing, and no vector links with one
    of another length. ``n_links`` counts other rows; a component is named by its smallest
    vec_id, whose row is kept. Rows that share an id are vectors of their own for ``n_links`` and one
    for components. A null id takes no part: no links, no component, kept. Other columns
    (labels) are ignored; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    units = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    units = units.mapInArrow(_units, "vec_id long, dim int, unit binary")
    units = work.store("units", units.withColumn("digest", F.md5("unit")))
    own = units.filter("vec_id is not null and dim is not null")
    classes = work.store("classes", own.groupBy("dim", "digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    full = work.store("class-vectors", classes.join(
        own.select(F.col("vec_id").alias("id"), "dim", "digest", "unit"), ["id", "dim", "digest"]
    ).dropDuplicates(["id", "dim", "digest"]).withColumn("class", F.xxhash64("digest")))
    found = spark.createDataFrame([], "id long, class long, links long, root long")
    for row in classes.select("dim").distinct().orderBy("dim").collect():
        found = found.union(_compare_dimension(work, full, row["dim"], threshold, tile_bytes))
    found = work.store("found", found)
    connected = components(work, found.select(F.col("id").alias("a"), F.col("root").alias("b")).filter("a != b"))
    links = found.groupBy(F.col("id"), F.col("class")).agg(F.sum("links").alias("links"))
    named = work.store("named", full.select("dim", "digest", "id", "class", "copies")
        .join(links, ["id", "class"], "left").join(connected, "id", "left")
        .select(
            "dim", "digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        ))
    rows = units.select("vec_id", "dim", "digest").join(named, ["dim", "digest"], "left")
    known = F.col("vec_id").isNotNull()
    component = F.when(known, F.coalesce("component_id", "vec_id"))
    return rows.select(
        "vec_id", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"), (component.isNull() | (component == F.col("vec_id"))).alias("kept"),
    )
