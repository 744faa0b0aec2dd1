"""Whitening, source divergence and nearest neighbours against brute force, on awkward rows and hot groups."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotline.llm import divergence, forest, queries, whitening

VEC = "vec_id long, embedding array<float>, id int, v string, `key` string, label int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "k", 0) for i, v in rows], VEC)


def awkward_vectors(n=300, dim=6, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    hot = rows[7][1]
    rows += [(1000 + i, hot) for i in range(n // 2)]  # a third of all rows are one vector
    return rows + [(None, rows[1][1]), (5000, None), (5001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5002, [float("nan")] * dim), (5003, [float("inf")] + [0.0] * (dim - 1)), (5004, [0.5, -0.5]), (5005, []), (5006, [0.0] * dim), (3, rows[3][1])]


def taking_part(rows, dim):
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    return [i for i, _ in ok], np.array([[*v, *[0.0] * (dim - len(v))] for _, v in ok], dtype=np.float32).astype(float)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_against_plain(spark, weights):
    rows = awkward_vectors()
    ids, v = taking_part(rows, 6)
    x = np.floor(256 * v).astype(int)
    fit = np.unique(x, axis=0) if weights == "one" else x
    n, total = len(fit), fit.sum(axis=0)
    z = fit - total / n
    var, axes = np.linalg.eigh(z.T @ z / n)
    var, axes = var[::-1], axes[:, ::-1]
    got = whitening.whiten(vectors_of(spark, rows), weights=weights).toPandas()
    assert len(got) == 4 * len(ids) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    key = lambda i: -1 if i is None or np.isnan(i) else int(i)
    want = defaultdict(list)
    for i, r in zip(ids, x, strict=True):
        want[key(i)].append((int(((n * r - total) ** 2).sum()), (r - total / n) @ axes[:, :4] / np.sqrt(var[:4])))
    for c in range(4):
        part = got[got["component"] == c + 1]
        assert abs(part["explained"].iloc[0] - var[c] / var.sum()) < 1e-12
        signs = []
        for i, d, w in zip(part["id"], part["deviation"], part["whitened"], strict=True):
            assert int(d) in [x[0] for x in want[key(i)]]
            y = next(x[1][c] for x in want[key(i)] if x[0] == int(d))
            assert abs(abs(w) - abs(y)) < 1e-9
            if abs(y) > 1e-6:
                signs.append(np.sign(w) == np.sign(y))
        assert len(set(signs)) == 1


def test_whitening_without_variance_and_beyond_a_long(spark):
    one = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted((r.id, r.component, r.whitened, r.explained, int(r.deviation), r.identity_error) for r in one) == [(i, c, 0.0, 0.0, 0, 0.0) for i in (1, 2) for c in (1, 2)]
    assert whitening.whiten(vectors_of(spark, [])).count() == 0 and whitening.whiten(vectors_of(spark, [(1, None), (2, [])])).count() == 0
    big = whitening.whiten(vectors_of(spark, [(1, [2.0**50, 0.0]), (2, [0.0, 2.0**50]), (3, [0.0, 0.0])])).collect()
    x, total = {1: (2**58, 0), 2: (0, 2**58), 3: (0, 0)}, 2**58
    assert {r.id: int(r.deviation) for r in big} == {i: sum((3 * c - total) ** 2 for c in v) for i, v in x.items()}
    with pytest.raises(OverflowError):
        whitening.whiten(vectors_of(spark, [(1, [3e30])]))


def plain_audit(rows, least, top=50):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = {k: k + 32 for k in range(65, 91)}
    docs = [(lang or "", source or "", term.findall((t or "").translate(lower))) for _, t, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = {t for t, n in Counter(t for d in own for t in set(d[2])).items() if n >= least}
        share = lambda c, k=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in k) + 5 * len(k)) for t in k}
        q = share(Counter(t for d in own for t in d[2]))
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}
        p = {s: share(c) for s, c in counts.items()}
        for s in p:
            far = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(far)}
            over = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(over)}
    return out


def audit_rows(n=160, seed=5):
    rng = np.random.default_rng(seed)
    vocabulary = [*"abcdefgh", "É", "é", "Straße", "naïve", "日本", "x1y", "A-B", "ab_cd"]
    make = lambda: " ".join(rng.choice(vocabulary, size=rng.integers(0, 30)))
    rows = [(i, make(), ["en", "de", None][i % 3], ["p", "q", "r", None, ""][i % 5]) for i in range(n)]
    same = "the Same TEXT again a b"
    rows += [(n + i, same, "en", ["p", "q", "s"][i % 3]) for i in range(n // 2)]  # a third of all rows are one text
    return rows + [(None, None, "en", "p"), (1, "", "fr", "lonely"), (1, "", "fr", "lonely"), (2, "only here", "fr", "other"), (3, "z " * 3_000_000, "en", "q"), (4, "\x00a\x7fb", "en", "t")]


@pytest.mark.parametrize("sizes", [(128, 200_000), (2, 3)])
def test_source_divergence_against_plain(spark, monkeypatch, sizes):
    monkeypatch.setattr(divergence, "BLOCK", sizes[0])
    monkeypatch.setattr(divergence, "PART", sizes[1])
    rows = audit_rows()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, term string, count int, value int")
    got = [tuple(r) for r in divergence.audit(df, 8).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, 8)


def test_source_divergence_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.audit(df).count() == 0
    alone = spark.createDataFrame([(1, "a b", "en", "p"), (2, "c", "en", "q")], df.schema)
    assert {tuple(r) for r in divergence.audit(alone).collect()} == {("en", "p", "pair", "q", 0, 1), ("en", "q", "pair", "p", 0, 1)}


def test_words_are_counted_alike_in_long_texts(monkeypatch):
    text = "Ab cd-É AB ".encode() * 10
    want = divergence.words_of(text)
    monkeypatch.setattr(divergence, "LONG", 5)
    assert divergence.words_of(text) == want == Counter({b"ab": 20, b"cd": 10, "É".encode(): 10})


def nearest_plain(rows, dim, asks, k):
    ids, v = taking_part(rows, dim)
    best = {}
    for i, x in zip(ids, v, strict=True):
        if i is not None and x.any():
            best[i] = max(best.get(i, tuple(x)), tuple(x))
    ids, v = np.array(list(best)), np.array(list(best.values()))
    out = {}
    for i in asks(ids):
        far = np.sqrt(np.square(v - v[ids == i]).sum(axis=1))
        order = [j for j in np.lexsort((ids, far)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(far[j])) for j in order]
    return out


def test_nearest_neighbours_of_a_small_table_are_exact(spark):
    rows = awkward_vectors() + [(3, [9.0] * 6)]
    got = defaultdict(list)
    for r in forest.neighbours(vectors_of(spark, rows), F.col("id") % 10 == 0, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    assert dict(got) == nearest_plain(rows, 6, lambda ids: ids[ids % 10 == 0], 10)
    few = forest.neighbours(vectors_of(spark, rows[:4]), F.col("id") == 0).collect()
    assert len(few) == 3
    assert forest.neighbours(vectors_of(spark, []), F.col("id") == 0).count() == 0
    assert forest.neighbours(vectors_of(spark, [(1, None), (2, [0.0])]), F.col("id") >= 0).count() == 0


def test_nearest_neighbours_recall_and_blocks(spark, monkeypatch):
    """Vectors without structure, the hardest case, with leaves searched in part, and queries in several blocks."""
    monkeypatch.setattr(forest, "LEAST", 500)
    monkeypatch.setattr(forest, "BLOCK_BYTES", 1 << 17)
    x = np.random.default_rng(4).normal(size=(8000, 32)).astype(np.float32)
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    got = forest.neighbours(vectors_of(spark, rows), F.col("id") % 100 == 0).collect()
    want = nearest_plain(rows, 32, lambda ids: ids[ids % 100 == 0], 10)
    assert len(got) == 800 and all(r.score == dict(want[r.query_id]).get(r.id, r.score) for r in got)
    recall = len({(r.query_id, r.id) for r in got} & {(q, i) for q, o in want.items() for i, _ in o}) / 800
    assert 0.9 <= recall
    all_rows = forest.neighbours(vectors_of(spark, rows), F.col("id") % 400 == 0, effort=4.0).collect()
    assert {(r.query_id, r.rank, r.id) for r in all_rows} == {(q, n + 1, i) for q, o in want.items() if q % 400 == 0 for n, (i, _) in enumerate(o)}


def test_the_queue_takes_leaves_by_falling_margin():
    x = np.random.default_rng(1).normal(size=(2000, 8))
    f = forest.grow(x, 3)
    leaf = forest.leaves_of(f, x)
    sizes = np.array([np.bincount(leaf[:, t], minlength=f.leaves) for t in range(3)])
    assert (sizes.sum(axis=1) == 2000).all() and f.leaves == 32
    for q in x[:5]:
        margin = f.normals @ q - f.cuts
        bound = np.full((3, f.leaves), np.inf)
        for t in range(3):
            for one in range(f.leaves):
                node = one + f.leaves - 1
                while node:
                    up = (node - 1) // 2
                    bound[t, one] = min(bound[t, one], margin[t, up] if node == 2 * up + 2 else -margin[t, up])
                    node = up
        took = forest.visited(f, q, sizes, 900)
        assert took.any() and 900 <= sizes[took].sum() < 900 + sizes.max() and bound[took].min() >= bound[~took].max()


def test_queries_of_the_new_operators(spark):
    sf = "/root/testdata/sf0.001"
    q = queries.QUERIES
    assert q["op11_embedding_whitening"](spark, sf).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(q["op11_embedding_whitening"](spark, sf).dtypes)["deviation"] == "bigint"
    assert q["op13_nearest_neighbours"](spark, sf).columns == ["query_id", "rank", "vec_id", "score"]
