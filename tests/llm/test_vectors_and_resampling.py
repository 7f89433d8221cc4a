"""Hard negatives, importance resampling and vector near-duplicates against plain Python, odd rows among the rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenframe.llm import embedding_dedup, hard_negatives, resampling

NAN, INF = float("nan"), float("inf")
#: Columns with the names of working columns.
CLASH = "id v n list slice block rank score links kept rid far".split()
DDL = "vec_id long, embedding array<double>, label int, " + ", ".join(f"{c} string" for c in CLASH)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], DDL)


def odd_rows(d):
    one = [1.0] + [0.0] * (d - 1)
    return [(None, one, 1), (5001, None, 1), (5002, [], 2), (5003, [NAN, *one[1:]], 3), (5004, [INF, *one[1:]], 3), (5005, [None, *one[1:]], 3), (5006, one, None), (5007, [1.0, 2.0], 4), (5008, [0.0] * d, 4)]


# ---------------------------------------------------------------------------------------------------- hard negatives


def hard_negatives_of(rows, d):
    """By all pairs; rows (id, vector, label), as the contract says."""
    live = {}
    for i, v, label in sorted((r for r in rows if r[0] is not None and r[1] and r[2] is not None and len(r[1]) == d and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2], r[1])):
        live.setdefault(i, ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (la, va) in live.items():
        if a % 100:
            continue
        s = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, lab) for i, (lab, v) in live.items() if i != a)
        for ps, p, _ in [x for x in s if x[2] == la][:5]:
            fit = [(n, ns) for ns, n, lab in s if lab != la and 80 * -ps <= 100 * -ns <= 100 * -ps][:5]
            out += [(a, p, k, n, -ps, -ns) for k, (n, ns) in enumerate(fit, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    r, d = np.random.default_rng(5), 8
    base = r.normal(size=(700, d))
    base[200:420] = base[200]  # a third of the rows is one vector
    base[420:520] = base[420] + 0.01 * r.normal(size=(100, d))
    rows = [(i, [float(x) for x in v], int(r.integers(0, 10))) for i, v in enumerate(base)]
    return rows + odd_rows(d) + rows[:120] + [(100, rows[101][1], 12)], d


@pytest.mark.parametrize(("lists", "size", "block", "first"), [(256, 8192, 1024, 8), (6, 40, 3, 1), (1, 100, 2, 3)])
def test_hard_negatives_are_those_of_all_pairs(spark, vectors, lists, size, block, first):
    rows, d = vectors
    got = hard_negatives.mine(hard_negatives.rows_of(frame(spark, rows)), lists=lists, size=size, block=block, first=first)
    want = hard_negatives_of(rows, d)
    assert len(want) > 60 and sorted(map(tuple, got.collect())) == want


def test_lists_outside_a_window_are_not_visited(spark):
    r = np.random.default_rng(3)
    middles = 4 * np.eye(8)
    rows = [(i, [float(x) for x in middles[i % 8] + 0.05 * r.normal(size=8)], i % 3) for i in range(800)]
    index = hard_negatives.Index(hard_negatives.rows_of(frame(spark, rows)), lists=8)
    whole = {"a_v": (middles[0] * 256).tobytes(), "w_at": np.zeros(1, np.int64).tobytes(), "block": 0}
    asked = lambda low, high, ahead: sum(len(x["list"]) for x in hard_negatives._needed(whole | {"w_low": np.array([low]).tobytes(), "w_high": np.array([high]).tobytes()}, index.c, index.radii, 1, ahead))
    assert asked(900_000, 1 << 40, True) == 1 and asked(900_000, 1 << 40, False) == 0 and asked(-(1 << 40), 1 << 40, False) == len(index.c) - 1


def test_hard_negatives_of_nothing_and_of_huge_components(spark):
    assert hard_negatives.mine(hard_negatives.rows_of(frame(spark, odd_rows(8)[1:7]))).count() == 0
    rows = [(0, [3e9, 1.0], 1), (1, [3e9, 2.0], 1), (2, [2.9e9, 1.0], 2), (3, [-1e308, 0.0], 2), (4, [0.1, 0.1], 2)]
    got = hard_negatives.mine(hard_negatives.rows_of(frame(spark, rows), scale=1.0, relabel="label")).collect()
    assert [(x.anchor_id, x.positive_id, x.negative_id, x.positive_score, x.negative_score) for x in got] == [(0, 1, 2, 9 * 10**18 + 2, 87 * 10**17 + 1)]


# ----------------------------------------------------------------------------------------------- importance resampling


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def buckets_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünder", "한글", "\U0001f600x", "a" * 47, "b" * 48, "c" * 49, "d" * 300, "İß", "x_y", "UPPER"]
    make = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ",", "\n", "\x00", "\x1f"]) for _ in range(n))
    rows = [(i, make(r.randrange(0, 120))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \t,.;\n"), (303, make(150_000)), (304, "same text " * 30), (304, "same text " * 30), (-5, make(40)), (None, make(50))]
    return rows, [(1, rows[3][1]), (2, None), (3, "w1 w2 w3 w4"), (None, "한글 w5")]


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_crcs_of_runs_follow_from_those_of_words(monkeypatch, texts, chunk):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    batch = [t for _, t in texts[0][:60]]
    got = [[] for _ in batch]
    for at, b in resampling.features(resampling.Words(), [resampling.words(t) for t in batch]):
        for i, x in zip(at.tolist(), b.tolist(), strict=True):
            got[i].append(x)
    assert [sorted(x) for x in got] == [sorted(buckets_of(t)[1]) for t in batch]


def test_weights_scores_and_ranks(spark, texts):
    docs, target = texts
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, rank string, score string")
    t = spark.createDataFrame(target, "item_id long, text string")
    rows = resampling.ranked(resampling.scored(d, t))
    got = sorted(((x.doc_id, x.n_features, x.weight, x.score, x.rank) for x in rows.collect()), key=repr)
    s, u = Counter(), Counter()
    for _, text in docs:
        s.update(buckets_of(text)[1])
    for _, text in target:
        u.update(buckets_of(text)[1])
    sa, ua = sum(s.values()), sum(u.values())
    gain = lambda b: math.floor(1000 * math.log((u[b] + 1) * (sa + 10_000) / ((s[b] + 1) * (ua + 10_000))))
    want = []
    for i, text in docs:
        n, f = buckets_of(text)
        w = sum(map(gain, f))
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(f), w, None if i is None else w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    fit = sorted((x for x in want if x[5] >= 20 and x[0] is not None), key=lambda x: (-x[3], x[0]))
    for k, x in enumerate(fit[: 5 * len(fit) // 100], 1):
        x[4] = k
    assert got == sorted((tuple(x[:5]) for x in want), key=repr) and sum(x[4] is not None for x in got) > 8
    kept = resampling.resampled(d, t)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == {x[0] for x in got if x[4]}
    assert resampling.ranked(resampling.scored(d.limit(0), t)).count() == 0 and resampling.scored(d, t.limit(0)).count() == len(docs)


# --------------------------------------------------------------------------------------------- vector near-duplicates


def groups_of(rows, d):
    live = [k for k, (_, v, _) in enumerate(rows) if v and len(v) == d and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[k][1] for k in live])
    top = {k: k for k in range(len(rows))}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    s = x @ x.T / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((x * x).sum(1)))
    near = s >= 0.9
    number = dict(zip(live, (near.sum(1) - 1).tolist(), strict=True))
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = find(live[i]), find(live[j])
        top[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[find(k)] = min((y for y in (i, least.get(find(k))) if y is not None), default=None)
    return sorted(((i, number.get(k, 0), least[find(k)], i is None or i == least[find(k)]) for k, (i, _, _) in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def close():
    r, d = np.random.default_rng(8), 32
    x = r.normal(size=(900, d))
    x[100:300] = x[100] + 0.3 * r.normal(size=(200, d))  # about the limit
    x[300:600] = x[300]  # a third of the rows is one vector
    x[600:700] = x[600] * r.uniform(0.1, 9, size=(100, 1)) + 0.02 * r.normal(size=(100, d))
    for k in range(701, 740):  # a chain
        x[k] = x[k - 1] / np.linalg.norm(x[k - 1]) + 0.4 * r.normal(size=d) / math.sqrt(d)
    rows = [(int(i), [float(np.float32(y)) for y in v], 1) for i, v in zip(r.permutation(len(x)) + 10, x, strict=True)]
    at = [1.0] + [0.0] * (d - 1)
    limit = [(2, at, 1), (3, [9.0, 3.0, 3.0, 1.0] + [0.0] * (d - 4), 1), (4, [9.0, 3.0, 3.0, 1.0001] + [0.0] * (d - 4), 1)]  # 3 is at 0.9 exactly
    return rows + limit + odd_rows(d) + rows[:20] + [(None, rows[150][1], 1)], d


@pytest.mark.parametrize(("width", "size"), [(16, 16_384), (8, 60), (4, 300)])
def test_links_and_components_are_those_of_all_pairs(spark, close, width, size):
    rows, d = close
    got = sorted(map(tuple, embedding_dedup.groups(frame(spark, rows), width=width, size=size).collect()), key=repr)
    assert got == groups_of(rows, d) and len({x[2] for x in got}) < 700


def test_vectors_that_have_no_links(spark):
    rows = odd_rows(4)
    got = embedding_dedup.groups(frame(spark, rows[1:]).limit(0))
    assert got.count() == 0 and got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = embedding_dedup.groups(frame(spark, rows[1:5]))
    assert all(x.n_links == 0 and x.component_id == x.vec_id and x.kept for x in got.collect()) and got.count() == 4
    kept = embedding_dedup.first_of_each(frame(spark, [(1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (3, [0.0, 1.0], 1), (None, [1.0, 0.0], 1)]))
    assert kept.columns[:3] == ["vec_id", "embedding", "label"] and sorted(str(x.vec_id) for x in kept.collect()) == ["1", "3", "None"]


def test_a_pair_is_within_budget_of_a_block(close):
    rows, d = close
    x = embedding_dedup.units(np.array([v for i, v, _ in rows[:140] + rows[701:900]]))
    plan = embedding_dedup.Plan(x, len(x), 0.9, 4)
    y = x @ plan.rotation
    for i in range(100, 180):
        gap = (y - y[i]) ** 2
        parts = np.add.reduceat(gap, plan.starts, axis=1)
        linked = x @ x[i] >= 0.9
        assert plan.number > 1 and (parts[linked] <= plan.budget).any(1).all()


@pytest.mark.parametrize("dense", [1 << 17, -1])
def test_two_slices_by_all_pairs(close, dense, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "DENSE", dense)
    rows, d = close
    x = embedding_dedup.units(np.array([v for i, v, _ in rows[:260] + rows[600:900]]))
    plan = embedding_dedup.Plan(x, len(x), 0.9, 4)
    turned = (x @ plan.rotation).astype(np.float32)
    slices = [(np.arange(0, 300), 300), (np.arange(300, len(x)), len(x))]
    pack = lambda at, tag: {f"ids{tag}": at.astype(np.int64).tobytes(), f"ns{tag}": np.ones(len(at), np.int64).tobytes(), f"x{tag}": turned[at].tobytes()}
    links, edges, unsure = np.zeros(len(x), int), [], []
    for k in range(plan.number):
        for same, left, right in ((True, slices[0][0], None), (True, slices[1][0], None), (False, slices[0][0], slices[1][0])):
            row = {"block": k, "same": same, **pack(left, ""), **(pack(right, "_b") if right is not None else {})}
            for got in embedding_dedup._compared(row, plan):
                for a, b, n in zip(got["a"].tolist(), got["b"].tolist(), got["links"].tolist(), strict=True):
                    if n < 0:
                        unsure.append((a, b))
                    else:
                        links[a] += n
                        edges.append((a, b))
    near = x @ x.T >= 0.9
    for a, b in unsure:
        assert abs(x[a] @ x[b] - 0.9) < 1e-4
        links[[a, b]] += int(near[a, b])
        edges += [(a, b)] if near[a, b] else []
    assert links.tolist() == (near.sum(1) - 1).tolist() and links.sum() > 10_000
    i, j = np.nonzero(near)
    a, b = np.array(edges).T
    assert embedding_dedup._firsts(len(x), i, j).tolist() == embedding_dedup._firsts(len(x), a, b).tolist()
