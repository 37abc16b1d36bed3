"""What a task holds of sparse cells: small row groups, few open pairs, cells cut by their entries."""

import math
import os
import random
from collections import Counter

import pyarrow.parquet as pq

from phrasegraph.operators import sparse_cells as SC
from phrasegraph.plans.durable import steps


def texts(n=220):
    dice = random.Random(3)
    bags = []
    for k in range(n):
        if bags and dice.random() < 0.4:
            bag = Counter(dice.choice(bags))
            bag[f"t{dice.randrange(60)}"] += 1
        else:
            bag = Counter(f"t{dice.randrange(60)}" for _ in range(dice.choice([5, 40, 400])))
        bags.append(bag)
    return bags


def cosine(a, b):
    dot = sum(n * b[t] for t, n in a.items())
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def frame(spark, bags):
    return spark.createDataFrame([(k, t, float(n)) for k, b in enumerate(bags) for t, n in b.items()], "id long, term string, w double")


def test_pairs_are_the_same_however_few_are_held(spark, monkeypatch):
    bags = texts()
    cells = SC.sparse_cells(frame(spark, bags), 50)
    want = {(i, j) for i in range(len(bags)) for j in range(i + 1, len(bags)) if cosine(bags[i], bags[j]) > 0.9 + 1e-9}
    monkeypatch.setattr(SC, "HELD", 64)
    # Parts of rows are met in turn, none with many more pairs than are to be held.
    rows = [SC._rows(batch, k, "") for batch in cells.packed.toArrow().to_batches() for k in range(len(batch))]
    for a in rows:
        parts = list(SC._met(a, a, True, 0.9))
        assert all(len(i) <= 64 + len(a.ids) for i, _ in parts)
        keep = a.folded @ a.folded.T > 0.9 - SC.SLACK
        assert sorted((x, y) for i, j in parts for x, y in zip(i.tolist(), j.tolist())) == [
            (x, y) for x in range(len(a.ids)) for y in range(x + 1, len(a.ids)) if keep[x, y]
        ]
    met = set()
    for n, a in enumerate(rows):
        for m, b in enumerate(rows[n:]):
            for i, j in SC._met(a, b, m == 0, 0.9):
                i, j = SC.barred(a, i, b, j, 0.9)
                above = SC.exact_cosines(a, i, b, j) > 0.9
                met |= {tuple(sorted(p)) for p in zip(a.ids[i[above]].tolist(), b.ids[j[above]].tolist())}
    assert want <= met <= {(i, j) for i in range(len(bags)) for j in range(len(bags)) if cosine(bags[i], bags[j]) > 0.9 - 1e-9}


def test_cells_of_long_rows_have_fewer_of_them(spark):
    bags = [Counter({f"t{(k * 7 + x) % 900}": 1 for x in range(600)}) for k in range(120)]
    cells = SC.sparse_cells(frame(spark, bags), 50)
    # 600 entries count for about five rows.
    assert cells.rows.sum() == 120 and cells.rows.max() <= 40


def test_cells_are_written_in_small_row_groups(spark):
    with steps(spark) as scope:
        dice = random.Random(1)
        wide = spark.createDataFrame([(k, bytearray(dice.randbytes(1 << 20))) for k in range(40)], "id long, m binary").coalesce(1)
        out = scope.keep(wide, large_rows=True)
        folder = out._step_path.removeprefix("file:")
        files = [f"{folder}/{x}" for x in os.listdir(folder) if x.endswith(".parquet")]
        groups = [pq.ParquetFile(f).metadata.row_group(k).num_rows for f in files for k in range(pq.ParquetFile(f).num_row_groups)]
        # A row has a megabyte.
        assert sum(groups) == 40 and max(groups) <= 10
        assert out.selectExpr("sum(length(m))").first()[0] == 40 << 20
