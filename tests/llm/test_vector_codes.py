"""Vector codes against a plain Lloyd iteration in whole integers."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from changeflow.llm import vector_codes as vc

COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    length = max((n, size) for size, n in Counter(len(v) for _, v, _ in kept).items())[1]
    kept = [r for r in kept if len(r[1]) == length]
    cuts = [length * p // 4 for p in range(5)]
    first = sorted(kept, key=lambda r: (math.inf if r[0] is None else r[0], r[1]))[:entries]
    books = [[r[1][a:b] for r in first] for a, b in zip(cuts, cuts[1:])]

    def nearest(p, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[nearest(p, v[a:b])[1]].append(v[a:b])
            for e, held in members.items():
                books[p][e] = [sum(x) // len(held) for x in zip(*held)]
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    out, by_label = [], defaultdict(int)
    for i, v, label in kept:
        found = [nearest(p, v[a:b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    return sorted(((i, code, error, by_label[label], sha) for i, code, error, label in out), key=repr)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(n, length, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(length)] for _ in range(5)]
    return [(i, [c + spread * rng.gauss(0, 0.3) for c in rng.choice(centres)], rng.choice([1, 2, None])) for i in range(n)]


def as_floats(spark, rows):
    """The frame, and its rows as single-precision numbers."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df, [(r.vec_id, r.embedding, r.label) for r in df.collect()]


@pytest.mark.parametrize("cell,entries", [(4096, 256), (7, 256), (20, 9)])
def test_against_brute_force(spark, monkeypatch, cell, entries):
    monkeypatch.setattr(vc, "CELL_ROWS", cell)
    monkeypatch.setattr(vc, "BUCKET_ROWS", 300)
    monkeypatch.setattr(vc, "ENTRIES", entries)
    rows = vectors(300, 12, 3)
    rows += [(1000 + i, rows[7][1], 5) for i in range(150)] + [rows[4], rows[4]]          # a hot vector, repeated rows
    rows += [(2000, None, 1), (2001, [], 1), (2002, [1.0] * 11 + [None], 1), (2003, [math.nan] * 12, 1),
             (2004, [math.inf] + [0.0] * 11, 2), (2005, [0.5] * 8, 1), (None, [0.25] * 12, None), (-5, [0.0] * 12, 9)]
    df, plain = as_floats(spark, rows)
    assert got(vc.digest(df)) == brute(plain, entries)


def test_small_uneven_large_and_empty(spark):
    for rows in (vectors(3, 6, 1), vectors(40, 2, 2), [(1, [10000.5, -9000.25, 3.0, 1e-9], 0), (2, [9999.0, 8.0, -3.5, 0.0], 0)]):
        df, plain = as_floats(spark, rows)
        assert got(vc.digest(df)) == brute(plain)
    df, _ = as_floats(spark, vectors(3, 8, 1))
    assert got(vc.digest(df.limit(0))) == []
    assert got(vc.digest(df.selectExpr("vec_id", "cast(null AS array<float>) AS embedding", "label"))) == []
    with pytest.raises(Exception, match="a component is beyond"):
        vc.digest(spark.createDataFrame([(1, [1e30] * 4, 1)], SCHEMA)).collect()


def test_clashing_columns(spark):
    rows = vectors(30, 8, 4)
    df, plain = as_floats(spark, rows)
    clash = df.selectExpr("*", "1 AS code", "'x' AS error", "2 AS position", "3 AS entry", "4 AS salt", "5 AS n")
    assert got(vc.digest(clash)) == brute(plain)


def test_only_movers_are_shuffled(spark, monkeypatch):
    """Owners read their members without an exchange, and what migrates in a
    round are the members whose entry changes."""
    monkeypatch.setattr(vc, "BUCKET_ROWS", 200)
    df, _ = as_floats(spark, vectors(300, 8, 5))
    plans, moves = [], []
    owners, receive = vc.Residents.owners, vc.Residents.receive

    def watched(self, run, schema):
        out = owners(self, run, schema)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    def counted(self, moved):
        moves.append(moved.count())
        return receive(self, moved)
    monkeypatch.setattr(vc.Residents, "owners", watched)
    monkeypatch.setattr(vc.Residents, "receive", counted)
    vc.digest(df).collect()
    assert len(plans) == 7 and not any("Exchange" in p for p in plans)
    assert moves[0] == 1200 and all(m < 600 for m in moves[1:]) and len(moves) == 4
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("members_")]
