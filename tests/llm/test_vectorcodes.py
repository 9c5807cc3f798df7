"""Product codes against plain Python integers, with the edge cases of the operator."""

import hashlib
import math
import random

import numpy as np
import pytest

from curvetrail.llm import vectorcodes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def plain(rows, parts, entries, rounds, scale=256):
    """rows: (id, vector, label)."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = width // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: [min((far(cut(v, p), c), e) for e, c in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        got = [(v, near(v)) for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for v, n in got if n[p][1] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    fit = lambda x: x if x < 1 << 63 else None
    out = [(i, "".join(f"{e:02x}" for _, e in near(v)), fit(sum(d for d, _ in near(v))), lab) for i, v, lab in kept]
    total = {}
    for _, _, d, lab in out:
        total.setdefault(lab, []).append(d)
    total = {k: None if None in v else fit(sum(v)) for k, v in total.items()}
    return [(i, code, d, total[lab], digest) for i, code, d, lab in out]


def same(spark, rows, parts=4, entries=3, rounds=2):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in vc.compress(df, parts=parts, entries=entries, rounds=rounds).collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(plain(rows, parts, entries, rounds), key=key)


def test_codes(spark):
    rng = random.Random(1)
    rows = [(i * 7 % 101, [rng.choice([0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(90)]
    rows += [(500, None, 1), (501, [None] * 8, 1), (502, [0.0] * 7 + [float("nan")], 2), (503, [float("inf")] + [0.0] * 7, 2)]
    same(spark, rows)


def test_codes_of_odd_rows(spark):
    """Repeated ids and rows, null ids, short and empty vectors, fewer vectors than entries, ties of entries."""
    same(spark, [(1, [1.0] * 8, 1), (1, [1.0] * 8, 1), (1, [-1.0] * 8, None), (None, [0.1] * 8, 3), (None, [0.2] * 8, None)], entries=4)
    same(spark, [(3, [1.0, 2.0, 3.0], 1), (2, [], 1), (1, [0.5] * 9, 2)], entries=5)
    same(spark, [(3, [], None)], entries=2)
    same(spark, [(1, None, 1)])
    assert vc.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([], SCHEMA), entries=257)


def test_codes_beyond_64_bits(spark):
    """Components whose squares no long holds: exact codes, null errors."""
    rng = random.Random(2)
    rows = [(i, [rng.choice([1e30, -3e20, 1e9, 0.5]) * rng.random() for _ in range(4)], i % 2) for i in range(30)]
    rows += [(100 + i, [rng.uniform(-2e6, 2e6) for _ in range(4)], 5) for i in range(30)]
    same(spark, rows, parts=2, entries=4)


def test_one_label_of_most_rows(spark):
    rows = [(i, [float(i % 5), 0.0], 1 if i % 10 else i) for i in range(200)]
    same(spark, rows, parts=2, entries=2)
