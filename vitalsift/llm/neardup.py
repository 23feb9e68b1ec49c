"""Near-duplicate documents: SetSketch registers banded for candidates, links checked on full sets.

Documents with equal shingle sets form one class and a class takes part once. Four registers make
a band; classes that agree in a band share a bucket. Emitting all pairs of a bucket would square
its size. First every member is compared with the bucket's smallest, its centre, and the links
make components. What can still connect two components are pairs of other members that lie in
different ones: members outside a bucket's largest component, compared with all members.
Those are compared inside tasks, block by block, each pair in the first band it agrees in, on
registers alone. Members that may reach the threshold with another then bring their full sets to
the same blocks. Only links leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalsift.llm.common import Workspace, components, small_batches, text_slices
from vitalsift.llm.shingles import SLICE_BYTES, SetSketch, ShingleHasher, reaches

# At a similarity of 0.75 a pair misses all 32 bands with odds of 5 in a million.
BANDS, ROWS = 32, 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
# An estimate this far below the threshold is more than five standard errors away.
MARGIN = 0.14
BLOCK = 256
PAIRS_AT_ONCE = 1 << 14
GROUP_BYTES = 16 << 20

SKETCH = "doc_id long, n_shingles int, h1 long, h2 long, registers binary"
_ARROW_SKETCH = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()),
    ("registers", pa.binary()),
])
_ARROW_SET = pa.schema([("id", pa.int64()), ("hashes", pa.binary()), ("registers", pa.binary())])
_tools: dict = {}


def tools() -> tuple[ShingleHasher, SetSketch]:
    if not _tools:
        _tools["all"] = (ShingleHasher(), SetSketch())
    return _tools["all"]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, sketch = tools()
    for part, data, offsets in text_slices(batches, "text", SLICE_BYTES):
        n, h1, h2, registers = [], [], [], []
        for hashes in hasher.sets(data, offsets):
            n.append(len(hashes))
            with np.errstate(over="ignore"):
                h1.append(hashes.sum(dtype=np.uint64))
                h2.append((hashes * (hashes >> np.uint64(17) | np.uint64(1))).sum(dtype=np.uint64))
            registers.append(sketch.registers(hashes).tobytes())
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(n, pa.int32()), pa.array(np.array(h1, np.uint64).view(np.int64)),
             pa.array(np.array(h2, np.uint64).view(np.int64)), pa.array(registers, pa.binary())],
            schema=_ARROW_SKETCH,
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, sketch = tools()
    for part, data, offsets in text_slices(batches, "text", SLICE_BYTES):
        sets = list(hasher.sets(data, offsets))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([s.tobytes() for s in sets], pa.binary()),
             pa.array([sketch.registers(s).tobytes() for s in sets], pa.binary())],
            schema=_ARROW_SET,
        )


def _verifier(percent: int, margin: float):
    """Keeps the pairs whose estimate is near enough and whose full sets reach the threshold."""
    floor = percent / 100 - margin

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, set_a, set_b, reg_a, reg_b = (c.to_pylist() for c in batch.columns)
            x = np.frombuffer(b"".join(reg_a), np.uint16).reshape(len(a), -1)
            y = np.frombuffer(b"".join(reg_b), np.uint16).reshape(len(a), -1)
            n_a, n_b = np.array([len(s) // 8 for s in set_a]), np.array([len(s) // 8 for s in set_b])
            above, below = (x > y).sum(axis=1), (x < y).sum(axis=1)
            likely = reaches(floor, above, below, x.shape[1] - above - below, n_a, n_b)
            likely &= 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
            found = []
            for k in np.flatnonzero(likely).tolist():
                if _is_link(np.frombuffer(set_a[k], np.uint64), np.frombuffer(set_b[k], np.uint64), percent):
                    found.append(k)
            yield pa.RecordBatch.from_pydict(
                {"a": [a[k] for k in found], "b": [b[k] for k in found]}, schema=_ARROW_PAIR
            )

    return verify


_ARROW_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


_PLACE = ["band", "key", "i", "j"]
_MEMBER = [*_PLACE, "side", "rest", "id", "comp", "n", "registers"]
_MEMBER_SCHEMA = "band int, key long, i int, j int, side int, rest boolean, id long, comp long, n int, registers binary"


def _block_pairs(percent: int, margin: float, with_sets: bool):
    """Pairs of members of two blocks that lie in different components and may be links.

    Rows come sorted by bucket and block pair; ``side`` 0 is a block of members outside the largest
    component, ``side`` 1 one of all members. Without sets the members of such pairs are
    returned, each once per block pair; with sets the links. Several groups are worked off
    together, a bounded number of bytes at a time.
    """
    floor = percent / 100 - margin
    names = [*_MEMBER, *(["hashes"] if with_sets else [])]

    def worked(rows: dict, groups: list[tuple[int, int]]) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(rows["registers"]), np.uint16).reshape(len(rows["id"]), -1)
        bands = x[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
        ids, comps, side, band, n = (np.array(rows[c], np.int64) for c in ("id", "comp", "side", "band", "n"))
        rest = np.array(rows["rest"], bool)
        sets = [np.frombuffer(h, np.uint64) for h in rows["hashes"]] if with_sets else []
        links: list[tuple[int, int]] = []
        needed = np.zeros(len(ids), bool)
        for begin, end in groups:
            left, right = begin + np.flatnonzero(side[begin:end] == 0), begin + np.flatnonzero(side[begin:end])
            step = max(1, PAIRS_AT_ONCE // max(1, len(right)))
            for at in range(0, len(left), step):
                part = left[at : at + step]
                a, b = np.repeat(part, len(right)), np.tile(right, len(part))
                fits = (comps[a] != comps[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
                # Two members outside the largest component meet twice.
                fits &= ~rest[b] | (ids[a] < ids[b])
                a, b = a[fits], b[fits]
                # A pair that agrees in several bands is compared in the first of them.
                first = (bands[a] == bands[b]).all(axis=2).argmax(axis=1) == band[begin]
                a, b = a[first], b[first]
                above, below = (x[a] > x[b]).sum(axis=1), (x[a] < x[b]).sum(axis=1)
                near = reaches(floor, above, below, x.shape[1] - above - below, n[a], n[b])
                a, b = a[near], b[near]
                needed[a] = needed[b] = True
                if with_sets:
                    links += [
                        (min(ids[k], ids[j]), max(ids[k], ids[j])) for k, j in zip(a.tolist(), b.tolist(), strict=True)
                        if _is_link(sets[k], sets[j], percent)
                    ]
        if with_sets:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], schema=_ARROW_PAIR)
        kept = np.flatnonzero(needed).tolist()
        types = [pa.int32(), pa.int64(), *[pa.int32()] * 3, pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        columns = [pa.array([rows[c][k] for k in kept], t) for c, t in zip(_MEMBER, types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=_MEMBER)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {c: [] for c in names}
        groups: list[tuple[int, int]] = []
        key, begun, held = None, 0, 0
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names}
            for k, own in enumerate(zip(*(columns[c] for c in _PLACE), strict=True)):
                if own != key and len(rows["id"]) > begun:
                    groups.append((begun, len(rows["id"])))
                    begun = len(rows["id"])
                    if held >= GROUP_BYTES:
                        yield worked(rows, groups)
                        rows, groups, begun, held = {c: [] for c in names}, [], 0, 0
                key = own
                for c in names:
                    rows[c].append(columns[c][k])
                held += len(columns["registers"][k]) + (len(columns["hashes"][k]) if with_sets else 0)
        if rows["id"]:
            yield worked(rows, [*groups, (begun, len(rows["id"]))])

    return pairs


def _is_link(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    at = np.searchsorted(right, left)
    at[at == len(right)] = 0
    both = int((right[at] == left).sum())
    return 100 * both >= percent * (len(left) + len(right) - both)


def _links(work: Workspace, name: str, pairs: DataFrame, sets: DataFrame, percent: int, margin: float) -> DataFrame:
    """The pairs (a, b) that are links. ``sets`` is stored, so a hot centre's pairs can be split."""
    pairs = work.store(f"{name}-pairs", pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct())
    of = lambda side: sets.select(F.col("id").alias(side), F.col("hashes").alias(f"set_{side}"), F.col("registers").alias(f"reg_{side}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b", "reg_a", "reg_b")
    return work.store(name, joined.mapInArrow(_verifier(percent, margin), "a long, b long"))


def _with_components(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, "id", "left").withColumn("comp", F.coalesce("component_id", "id")).drop("component_id")


def find_near_duplicates(
    work: Workspace, documents: DataFrame, percent: int = PERCENT, margin: float = MARGIN
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``documents``.

    Two documents are linked when 100 * intersection >= percent * union of their shingle sets;
    a component is what links connect, named by its smallest id, and its row of that id is
    kept. A null or empty text, or one without words, has no shingles and no links. Rows with the
    same id are one document, linked by any of its texts, and have one component. A null id has no component and is
    kept. Other columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text"))
    sketches = work.store("sketches", texts.mapInArrow(_sketch, SKETCH))
    whole = ["h1", "h2", "n_shingles"]
    known = sketches.filter("n_shingles > 0 and doc_id is not null")
    classes = work.store("classes", known.groupBy(*whole).agg(F.min("doc_id").alias("id")))
    # Every class once, with the registers of its smallest document.
    own = [classes[c].eqNullSafe(known[c]) for c in whole]
    reps = work.store("representatives", known.join(classes, [known["doc_id"] == classes["id"], *own]).select(
        "id", known["n_shingles"].alias("n"), "registers"
    ).dropDuplicates(["id", "n", "registers"]))

    width = 2 * ROWS
    bands = reps.select("id", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("registers", k * width + 1, F.lit(width)))
    )).alias("band", "key"))
    buckets = work.store("buckets", bands.groupBy("band", "key").agg(
        F.min("id").alias("centre"), F.count("*").alias("size")
    ).filter("size > 1"))
    members = work.store("members", bands.join(buckets, ["band", "key"]))

    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    sets = work.store("sets", texts.join(wanted, "doc_id", "left_semi").mapInArrow(_full_sets, "id long, hashes binary, registers binary"))

    edges = _links(work, "star", members.select(F.col("centre").alias("a"), F.col("id").alias("b")), sets, percent, margin)
    lowest, same = _same_ids(work, sketches, known, classes)
    edges = edges.unionByName(same)
    found = components(work, edges, "star-components")
    # The centre has been compared with its whole bucket. The rest is done where all other
    # members lie in one component.
    placed = work.store("placed", _with_components(members.filter("id != centre"), found))
    sizes = placed.groupBy("band", "key", "comp").agg(F.count("*").alias("size"))
    mixed = work.store("mixed", sizes.groupBy("band", "key").agg(
        F.max_by("comp", F.struct("size", "comp")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("most")
    ).filter("most < all").select("band", "key", "main", "all", (F.col("all") - F.col("most")).alias("others")))
    more = _remaining(work, placed.drop("size").join(mixed, ["band", "key"]), reps, sets, percent, margin)
    # Components that such links connect get the smallest name among them.
    named_of = lambda side: found.select(F.col("id").alias(side), F.col("component_id").alias(f"{side}_comp"))
    between = more.join(named_of("a"), "a", "left").join(named_of("b"), "b", "left").select(
        F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")
    )
    merged = components(work, between, "merged")
    found = _merge(work, found, merged)

    named = work.store("named", _with_components(classes, found).select(*whole, F.col("comp").alias("component_id")).distinct())
    # Rows without shingles belong to the component of the other rows of their id.
    ids = _with_components(lowest, found).select("doc_id", F.col("comp").alias("component_id"))
    rows = sketches.filter("n_shingles > 0").select("doc_id", *whole).join(named, whole, "left").unionByName(
        sketches.filter("n_shingles = 0").select("doc_id", *whole).join(ids, "doc_id", "left"),
    ).select(
        "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
    return rows.withColumn("kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def _same_ids(work: Workspace, sketches: DataFrame, known: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids with several texts: ``doc_id`` and the smallest ``id`` of its classes, and edges from that to the others."""
    whole = ["h1", "h2", "n_shingles"]
    differ = [f(c).alias(f"{name}_{c}") for c in whole for name, f in (("low", F.min), ("high", F.max))]
    repeated = work.store("repeated", sketches.filter("doc_id is not null").groupBy("doc_id").agg(*differ).filter(
        " or ".join(f"low_{c} < high_{c}" for c in whole)
    ).select("doc_id"))
    own = known.select("doc_id", *whole).join(repeated, "doc_id", "left_semi")
    shared = work.store("shared", own.join(classes, whole).select("doc_id", "id").distinct())
    lowest = work.store("lowest", shared.groupBy("doc_id").agg(F.min("id").alias("id")))
    edges = shared.join(lowest.withColumnRenamed("id", "low"), "doc_id").select(F.col("low").alias("a"), F.col("id").alias("b"))
    return lowest, edges.filter("a != b").distinct()


def keep_one(work: Workspace, documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each group of near-duplicates: that of the smallest doc_id.

    Groups are made of rows, so texts that have nothing in common stay although their rows share
    an id, and copies go although they have none; a row with an id is kept before one without.
    Of rows with one id in a group the smallest digest of the text decides. A null or empty text, or
    one without words, is no duplicate and stays. An empty table gives no rows.
    """
    rows = work.store("rows", documents.withColumn("_row", F.monotonically_increasing_id()))
    found = find_near_duplicates(work, rows.select(F.col("_row").alias("doc_id"), "text"))
    groups = work.store("groups", found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")))
    # Only rows of groups of two or more are compared.
    shared = groups.groupBy("_group").agg(F.count("*").alias("n")).filter("n > 1").select("_group")
    shared = work.store("shared_groups", shared)
    copies = rows.join(groups.join(shared, "_group", "left_semi"), "_row").select(
        "_group", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.md5("text").alias("digest"), "_row").alias("place")
    )
    kept = work.store("kept", copies.groupBy("_group").agg(F.min("place").alias("place")).select("_group", F.col("place._row").alias("_row")))
    gone = groups.join(shared, "_group", "left_semi").select("_row").join(kept.select("_row"), "_row", "left_anti")
    return rows.join(work.store("gone", gone), "_row", "left_anti").select(*documents.columns)


def _merge(work: Workspace, found: DataFrame, merged: DataFrame) -> DataFrame:
    """Components ``found``, renamed where ``merged`` connects them, with nodes only it has."""
    names = merged.select(F.col("id").alias("component_id"), F.col("component_id").alias("new"))
    renamed = found.join(names, "component_id", "left").select("id", F.coalesce("new", "component_id").alias("component_id"))
    alone = merged.join(found.select("id"), "id", "left_anti")
    return work.store("components", renamed.unionByName(alone))


def _copies(open_: DataFrame, reps: DataFrame) -> DataFrame:
    """The members of mixed buckets, once for every pair of blocks that they are compared in.

    Members outside the largest component are cut into blocks, and so are all members. A member of
    the largest component is copied once per block of the others, and one of the others once per block
    of all, so a bucket that is nearly one component costs little more than its size.
    """
    def blocks(name: str):
        return F.ceil(F.col(name) / BLOCK).cast("int")

    hashed = F.xxhash64("id")
    rows = (
        open_.join(reps.select("id", "n", "registers"), "id")
        .withColumns({"rest": F.col("comp") != F.col("main"), "own": F.pmod(hashed, blocks("all")).cast("int")})
        .withColumn("lead", F.pmod(hashed, blocks("others")).cast("int"))
    )
    leads = rows.filter("rest").withColumns({"i": F.col("lead"), "j": F.explode(F.sequence(F.lit(0), blocks("all") - 1)), "side": F.lit(0)})
    others = rows.withColumns({"i": F.explode(F.sequence(F.lit(0), blocks("others") - 1)), "j": F.col("own"), "side": F.lit(1)})
    return leads.select(*_MEMBER).unionByName(others.select(*_MEMBER))


def _remaining(work: Workspace, open_: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, margin: float) -> DataFrame:
    """Links between members of one bucket that are in different components.

    Copies carry registers; full sets follow for members that may be linked by these.
    """
    dealt = lambda rows: rows.repartition(*_PLACE).sortWithinPartitions(*_PLACE)
    near = work.store("near", dealt(_copies(open_, reps)).mapInArrow(_block_pairs(percent, margin, False), _MEMBER_SCHEMA))
    found = dealt(near.join(sets, ["id", "registers"])).mapInArrow(_block_pairs(percent, margin, True), "a long, b long")
    return work.store("remaining", found)
