import numpy as np
import pytest

from dossierspark.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, least=0.93):
    good = [r[1] is not None and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) for r in rows]
    links, root = [0] * len(rows), list(range(len(rows)))
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if good[i] and good[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[i] += 1
                    links[j] += 1
                    p, q = root[i], root[j]
                    root = [q if r == p else r for r in root]
    least_id = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    return sorted((r[0], links[i], least_id[root[i]], r[0] == least_id[root[i]]) for i, r in enumerate(rows))


def clustered(n, seed, spread=0.03):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, 16))
    x = centres[rng.integers(0, len(centres), n)]
    return (x + rng.normal(size=x.shape) * spread * np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, E.near_duplicates(df).collect()))


def test_against_brute_force(spark):
    x = clustered(150, 0, 0.08)
    rows = [(1000 - i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(2000 + i, x[0].tolist(), 0) for i in range(5)] + [(2000, x[0].tolist(), 0)]
    nan, inf = float("nan"), float("inf")
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [None] + [1.0] * 15, 1), (3003, [nan] * 16, 1), (3004, [inf] * 16, 1), (3005, x[0].tolist(), None), (3006, [1.0, 2.0], 0), (3007, [1.0, 2.0], 0), (3008, [], 0)]
    assert run(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == []


def test_components_of_any_size(spark):
    x = np.random.default_rng(7).normal(size=8)
    rows = [(1, x * 1e200, 1), (2, x * 1e-200, 1), (3, x * 3, 1), (4, -x, 1), (5, x[:7], 1), (6, x[:7] * 1e300, 1), (7, np.full(8, 1.7e308), 1)]
    df = spark.createDataFrame([(i, [float(y) for y in v], c) for i, v, c in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


@pytest.mark.parametrize("cell_rows", [30, 120, 700])
def test_blocks_and_cells_recall(spark, monkeypatch, cell_rows):
    """The farthest partners a link allows: recall by number of cells, 0.9 at least."""
    monkeypatch.setattr(E, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(E, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(350, 64))
    near = base + rng.normal(size=base.shape) * 0.36 * np.linalg.norm(base, axis=1, keepdims=True) / 8
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, near]).astype(np.float32))]
    want, got = brute(rows), run(spark, rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    print(f"{-(-700 // cell_rows)} cells: recall {found / there:.3f}")
    assert there > 300 and 0.9 * there <= found <= there
    assert all(g[1] <= w[1] for g, w in zip(got, want))


@pytest.mark.parametrize("cell_rows", [250, 2000])
def test_recall_over_shifted_vectors(spark, monkeypatch, cell_rows):
    """Every vector of the table beside a copy shifted by a seeded noise: thousands of links, several cells."""
    monkeypatch.setattr(E, "CELL_ROWS", cell_rows)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label").toPandas()
    x = np.array(table["embedding"].tolist(), np.float32)
    noise = np.random.default_rng(8).normal(size=x.shape)
    shifted = (x + noise * (0.33 * np.linalg.norm(x, axis=1) / np.linalg.norm(noise, axis=1))[:, None]).astype(np.float32)
    ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
    rows = [(int(i), v.tolist(), int(c), "x") for i, v, c in zip(np.r_[ids, ids + 10**6], np.concatenate([x, shifted]), np.r_[labels, labels])]
    got = {r["vec_id"]: r["n_links"] for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    u = E.unit(np.concatenate([x, shifted]).astype(np.float64))
    want = ((u @ u.T >= 0.93) & (np.r_[labels, labels][:, None] == np.r_[labels, labels][None, :])).sum(axis=1) - 1
    found = sum(got.values())
    print(f"{-(-len(rows) // cell_rows)} cells: {want.sum()} link ends, recall {found / want.sum():.3f}")
    assert want.sum() >= 4000 and 0.9 * want.sum() <= found <= want.sum()
    assert all(got[r[0]] <= w for r, w in zip(rows, want))
