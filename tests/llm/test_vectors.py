import numpy as np

from brute import Groups
from vitalsift.llm import vectors
from vitalsift.llm.common import Workspace

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, threshold=0.95):
    def usable(i, x):
        return i is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)

    good = [(k, i, np.array(x)) for k, (i, x) in enumerate(rows) if usable(i, x)]
    groups, links = Groups(i for i, _ in rows if i is not None), [0] * len(rows)
    for p, (k, i, x) in enumerate(good):
        for m, j, y in good[p + 1 :]:
            if len(x) == len(y):
                u, v = x / np.abs(x).max(), y / np.abs(y).max()
                if u @ v >= threshold * np.sqrt((u @ u) * (v @ v)):
                    links[k] += 1
                    links[m] += 1
                    groups.join(i, j)
    return sorted((str(i), links[k], "None" if i is None else str(groups.find(i))) for k, (i, _) in enumerate(rows))


def found_in(spark, rows, schema=SCHEMA, **options):
    table = spark.createDataFrame(rows, schema).repartition(5)
    out = vectors.find_near_duplicates(Workspace(spark, "vectors"), table, **options).collect()
    assert all(r["kept"] == (r["component_id"] is None or r["vec_id"] == r["component_id"]) for r in out)
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in out)


def test_links_and_components_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    vectors_ = []
    for _ in range(12):
        centre = rng.normal(size=16)
        vectors_ += [(centre + rng.normal(size=16) * 0.3 * rng.random()).tolist() for _ in range(rng.choice([1, 2, 30, 60]))]
    vectors_ += [vectors_[0]] * 30
    vectors_ += [[0.0] * 16, None, [], [1.0, None], [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [3.0],
                 [-1.0], [1e300] * 16, [1e-300] * 16, [-0.0, 1.0], [0.0, 2.0]]
    ids = rng.permutation(len(vectors_)).tolist()
    ids[3] = None
    rows = list(zip(ids, vectors_, strict=True))
    # Tiles of 256 vectors, the least there is; several of them.
    assert found_in(spark, rows, tile_bytes=1) == brute(rows)


def test_many_tiles(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8)) * np.array([6, 2, 1, 1, 1, 1, 1, 1])
    rows = [(int(k), (base[k % 60] + rng.normal(size=8) * 0.25).tolist()) for k in range(1_500)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    groups = Groups(range(1_500))
    for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        groups.join(int(a), int(b))
    expected = sorted((str(k), int(near[k].sum()) - 1, str(groups.find(k))) for k in range(1_500))
    assert found_in(spark, rows, tile_bytes=1) == expected


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(3)
    x, y = (rng.normal(size=(300, 32)) + 2 * rng.normal(size=(1, 32)) for _ in range(2))
    x, y = (z / np.linalg.norm(z, axis=1)[:, None] for z in (x, y))
    for threshold in (-0.2, 0.3, 0.8):
        got = {(a, b) for left, right in vectors.linked_pairs(x, y, [4, 16, 32], threshold, False) for a, b in zip(left, right, strict=True)}
        assert got == set(zip(*np.nonzero(x @ y.T >= threshold), strict=True))


def test_no_rows_extra_columns_and_repeated_ids(spark):
    assert found_in(spark, []) == []
    schema = "vec_id long, embedding array<float>, label int, dim int, id long, class long, copies long, range int"
    rows = [(1, [1.0, 0.0], None, 9, 1, 2, 3, 4), (1, [0.0, 1.0], 2, 9, 1, 2, 3, 4), (2, [1.0, 0.01], 2, None, 1, 2, 3, 4), (2, [1.0, 0.01], 2, 9, 1, 2, 3, 4)]
    assert found_in(spark, rows, schema) == [("1", 0, "1"), ("1", 2, "1"), ("2", 2, "1"), ("2", 2, "1")]
