from pathlib import Path

import duckdb
import numpy as np
import pytest

from metaspan.llm import vector_join as v


def brute(rows):
    unit = {k: v.unit(x) if label is not None else None for k, (_, x, label) in enumerate(rows)}
    near = {k: [] for k in unit}
    for a in unit:
        for b in unit:
            if a != b and unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                near[a].append(b)
    out = []
    for k in near:
        seen, todo = {k}, [k]
        while todo:
            for o in near[todo.pop()]:
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
        least = min(rows[o][0] for o in seen)
        out.append((rows[k][0], len(near[k]), least, rows[k][0] == least))
    return sorted(out)


@pytest.mark.parametrize("sizes", [(2000, 1024), (10, 7)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(v, "CELL", sizes[0])
    monkeypatch.setattr(v, "BLOCK", sizes[1])
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(30):
        base, label = rng.normal(size=8), int(rng.integers(0, 3))
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (base + rng.normal(size=8) * rng.choice([0, 0.05, 0.15])).tolist(), label))
    rows += [(900 + k, x, 1) for k, x in enumerate([None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None], [float("inf")] * 8, [1e300] * 8, [1e-300] * 8, [1.0], [2.0]])]
    rows += [(950, [1.0] * 8, None), (951, [1.0] * 8, None), (952, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS id", "2 AS n", "3 AS cell").repartition(3)
    assert sorted(tuple(r) for r in v.link_vectors(df).collect()) == brute(rows)


def test_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in v.link_vectors(df).fillna(-1).collect()) == [(-1, 0, -1, False), (1, 1, 1, True), (1, 1, 1, True)]
    assert v.link_vectors(df.limit(0)).count() == 0


def test_table_equals_oracle(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    got = v.link_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect()
    assert sorted(tuple(r) for r in got) == sorted(c.sql(v.oracle()).fetchall())


def test_many_cells_are_stored_once(spark, monkeypatch):
    """Random directions are nearly as far from one pivot as from any other: what is written must not grow with the number of cells."""
    monkeypatch.setattr(v, "CELL", 100)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    x[2000:2900] = x[rng.integers(0, 40, 900)] + rng.normal(size=(900, 64)) * rng.choice([0, 0.05, 0.12, 0.16], (900, 1))
    x = x.astype(np.float32)
    rows = [(k, y.tolist(), k % 10 // 9) for k, y in enumerate(x)]
    folder = Path(v.frames.shared_folder(spark).removeprefix("file://"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    got = sorted(tuple(r) for r in v.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect())
    assert size() - before < 3 * x.nbytes
    assert got == brute([(k, y, label) for k, y, label in rows])
    assert len({r[2] for r in got}) < 2900 and max(r[1] for r in got) > 10
