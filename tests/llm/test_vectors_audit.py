"""Vector search, clustering and the filter audit against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import clustering, filter_audit, vector_search
from tallyline.llm.vectors import LIMIT, grid_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, key long, vector string, q int, cells int, hits int, cluster int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, 4, 5, 6) for i, v in rows], SCHEMA).repartition(3)


def vectors(seed=1, n=230, dims=64):
    draw = random.Random(seed)
    point = lambda: [draw.gauss(0, 0.12) for _ in range(dims)]
    hubs = [point() for _ in range(6)]
    rows = [(i, [x + draw.gauss(0, 0.03) for x in draw.choice(hubs)]) for i in range(n)]
    rows += [(n + i, hubs[0]) for i in range(90)]  # one hot vector
    rows += [(-50, point()), (1000, None), (1001, [None] + point()[1:]), (1002, [math.nan] + point()[1:]), (1003, [math.inf] + point()[1:])]
    rows += [(1050, [0.0] * dims), (1100, hubs[1]), (1101, hubs[1]), (7, point()), (None, hubs[2]), rows[3], rows[3], rows[50]]
    return rows


def grid(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return tuple(math.floor(scale * float(np.float32(x))) for x in v)


def best(rows, modulus, k):
    known = sorted({(i, g) for i, v in rows if i is not None and (g := grid(v, 256)) is not None})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, g in known:
        if i % modulus == 0:
            ranked = sorted((-dot(g, h), j) for j, h in known if (j, h) != (i, g))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(ranked[:k])]
    return sorted(out)


@pytest.mark.parametrize("case", ["usual", "passes", "few", "ragged", "coarse"])
def test_vector_search(spark, monkeypatch, case):
    rows, k = vectors(), 5
    if case == "passes":  # several blocks of queries, and candidates passed on early
        monkeypatch.setattr(vector_search, "QUERY_BLOCK", 3)
        monkeypatch.setattr(vector_search, "HELD", 20)
        monkeypatch.setattr(vector_search, "STEP", 64)
    if case == "few":
        rows = rows[:3] + [(50, rows[4][1])]
    if case == "ragged":
        rows += [(2000, [0.5] * 3), (2050, [0.25] * 70), (2100, [])]
    if case == "coarse":  # bounds so wide that most of the work falls to the exact reads
        monkeypatch.setattr(vector_search, "CELLS", 2)
    got = vector_search.exact_top_k(grid_vectors(table(spark, rows), 256), F.col("vec_id") % 50 == 0, k)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == best(rows, 50, k)


def test_vector_search_of_nothing(spark):
    for rows in ([], [(3, [0.1] * 64)], [(50, [0.1] * 64)], [(50, None)]):
        assert vector_search.exact_top_k(grid_vectors(table(spark, rows), 256), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(2)
    x = np.floor(draw.normal(0, 40, (3000, 32)))
    x[0, 0], x[1, 1] = 5000, -7000  # outside the sample's marks
    cells = vector_search.Cells(x[100:], x.min(0), x.max(0))
    mid, half = cells.decode(cells.encode(x))
    assert (np.abs(x - mid) <= half).all()
    q = x[:5]
    exact, centre, around = q @ x.T, q @ mid.T, np.abs(q) @ half.T
    assert (np.abs(exact - centre) <= around + 1e-6).all()
    kth = np.sort(centre - around, axis=1)[:, -6]
    assert ((centre + around >= kth[:, None]).sum(axis=1) < 60).all()


def test_components_out_of_range(spark):
    with pytest.raises(Exception, match="out of range"):
        grid_vectors(table(spark, [(1, [float(LIMIT)])]), 256).collect()


def means(rows, k, rounds, scale=64, dims=64):
    kept = [(i, g) for i, v in rows if (g := grid(v, scale)) is not None and len(g) == dims]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [list(g) for _, g in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda g: min((square(g, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        mine = [near(g)[1] for _, g in kept]
        for j in range(len(cents)):
            members = [g for (_, g), m in zip(kept, mine, strict=True) if m == j]
            if members:
                cents[j] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    return sorted([(i is None, i or 0, near(g)[1], near(g)[0]) for i, g in kept]), cents


@pytest.mark.parametrize("case", ["usual", "few", "same", "large"])
def test_clusters(spark, case):
    rows, k, rounds = vectors(5), 16, 3
    rows += [(3000, [0.1] * 63), (3001, [0.1] * 65)]
    if case == "few":
        rows, k = rows[:5] + rows[-2:], 16
    if case == "same":  # equal centroids: the larger numbers stay empty
        rows = [(i, rows[i % 3][1]) for i in range(40)]
    if case == "large":  # components beyond what floats hold exactly
        rows = [(i, [x * 2**19 for x in v]) for i, v in rows if grid(v, 1) is not None]
    found, cents = clustering.cluster_vectors(grid_vectors(table(spark, rows), 64, dims=64), k, rounds)
    want, want_cents = means(rows, k, rounds)
    assert cents == want_cents
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"]) for r in found.collect()) == want
    out = clustering.with_inertia(found, cents).collect()
    assert len(out) == len(want) and {r["inertia"] for r in out} == {sum(w[3] for w in want)}
    for r in out:
        assert r["cluster_inertia"] == sum(w[3] for w in want if w[2] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[r["cluster"]])).encode()).hexdigest()
    if case == "usual":  # bounds spare scans: without them every vector has four
        assert sum(r["scans"] for r in out) < 0.85 * 4 * len(out)


def test_clusters_of_nothing(spark):
    found, cents = clustering.cluster_vectors(grid_vectors(table(spark, [(1, None), (2, [0.5])]), 64, dims=64))
    assert cents == [] and clustering.with_inertia(found, cents).count() == 0


def test_drift_is_a_bound():
    draw = np.random.default_rng(3)
    tighter = away = 0
    for _ in range(400):
        d = int(draw.integers(2, 8))
        own, before = draw.normal(0, 3, d), draw.normal(0, 3, d)
        after = before + draw.normal(0, draw.choice([0.1, 1, 4]), d)
        radius = float(draw.choice([0.2, 1, 4]))
        x = draw.normal(size=(4000, d))
        x = own + radius * x / np.linalg.norm(x, axis=1, keepdims=True) * draw.random((4000, 1)) ** (1 / d)
        seen = (np.linalg.norm(x - before, axis=1) - np.linalg.norm(x - after, axis=1)).max()
        bound, full = clustering.drift(own, radius, before, after), np.linalg.norm(after - before)
        assert seen <= bound + 1e-9 and bound <= full + 1e-12
        tighter += bound < 0.9 * full
        away += bound < 0
    assert tighter > 100 and away > 10


AUDIT = "doc_id long, text string, lang string, n long, mask int, part string, digest string, cells int, quality int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def audit_rows():
    draw = random.Random(4)
    rows = []
    for i in range(120):
        words = [draw.choice("abcdefghij") * draw.randint(1, 30) for _ in range(draw.choice([0, 20, 199, 200, 400]))]
        if i % 3:
            words = [f"{w}{j}" if j % 3 else w for j, w in enumerate(words)]
        if i % 4 == 0:
            words = [w.upper() for w in words]
        text = draw.choice([" ", "\t", "\n", "  "]).join(words) + draw.choice(["", "", " 100%", "#", " é&"])
        rows.append((i, text, draw.choice(["en", "de", None, ""])))
    rows += [(500 + i, rows[8][1], "en") for i in range(60)]  # a hot text
    rows += [(900, None, "en"), (901, "", None), (902, None, "xx"), (None, rows[8][1], "en"), (None, None, None), rows[5], rows[8], rows[8], (5, "another text", "en")]
    return rows + [(903, "w" * 100_000 + " " + " ".join(map(str, range(50_000))), "en")]


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = []
    for i, text, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        fails.append({k for k, v in f.items() if v})
    out = []
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for n, letter in enumerate(order):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                shapley[letter] += len(gone)
                steps.append(["".join(order), n + 1, len(left), len(gone), sum(letter in f for _, f in mine) - len(gone), sum(f == {letter} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
        out += [(part, *s, shapley[s[0][s[1] - 1]]) for s in steps]
    return sorted(out)


def test_filter_audit(spark):
    rows = audit_rows()
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 110, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (77_777, 1, 1), (6, None, None)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    docs = spark.createDataFrame([(i, t, p, 1, 2, "x", "y", 3, 4) for i, t, p in rows], AUDIT).repartition(3)
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.interaction_report(*filter_audit.failure_cells(docs, marks))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)


def test_filter_audit_of_nothing(spark):
    docs, marks = spark.createDataFrame([], AUDIT), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interaction_report(*filter_audit.failure_cells(docs, marks)).count() == 0
    one = spark.createDataFrame([(1, "a", None, 1, 2, "x", "y", 3, 4)], AUDIT)
    assert filter_audit.interaction_report(*filter_audit.failure_cells(one, marks)).count() == 600


def test_gray_states():
    cells = np.random.default_rng(1).integers(0, 9, (3, 16, 2))
    states = filter_audit.gray_states(cells)
    for s in range(16):
        assert (states[:, s] == cells[:, [m for m in range(16) if not m & s]].sum(axis=1)).all()
