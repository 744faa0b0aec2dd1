"""The classifiers against plain versions, and operators on tables with clashing columns."""

import math
import random
from collections import Counter

import numpy as np

from shotline.llm import maxscore, quality, queries, toxicity, urls, warc, words

WORD = set("0123456789abcdefghijklmnopqrstuvwxyz_ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def split(text):
    """Words of a text: runs of ASCII letters, digits, underscores and other characters beyond ASCII."""
    out, now = [], ""
    for c in text + " ":
        if c in WORD or ord(c) > 127:
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def surface(text):
    """The features of quality, one by one."""
    raw = text.encode()
    n, found = len(raw), split(text)
    count, kinds, length = len(found), len(set(found)), sum(len(w.encode()) for w in found)
    again = sum(a == b for a, b in zip(found, found[1:])) / max(count, 1)
    share = [math.sqrt(raw.count(bytes([b])) / max(n, 1)) for b in range(256)]
    upper, digit = sum(65 <= b < 91 for b in raw), sum(48 <= b < 58 for b in raw)
    return share + [
        math.log1p(n) / 10, math.log1p(count) / 10, length / max(count, 1) / 10, kinds / max(count, 1), kinds / max(math.sqrt(count), 1) / 20,
        count / (raw.count(b"\n") + 1) / 50, length / max(n, 1), upper / max(n, 1), digit / max(n, 1), float(n == 0), again, math.sqrt(again),
    ]


def plain_fit(p, u, step_of, steps=300):
    mean, scale = u.mean(0), u.std(0) + 1e-2
    p, u = (np.hstack([(x - mean) / scale, np.ones((len(x), 1))]) for x in (p, u))
    w = m = v = np.zeros(p.shape[1])
    for t in range(1, steps + 1):
        g = step_of(w, p, u) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return lambda x: sigmoid(np.hstack([(x - mean) / scale, np.ones((len(x), 1))]) @ w)


def corpus(n=240, seed=11):
    rng = random.Random(seed)
    good, bad, rude = ["river", "stone", "Étude", "gently", "morning", "walks"], ["CLICK", "777", "$$$", "win", "win"], ["vile", "curse", "filth"]
    docs, quality_of, toxic_of = [], {}, {}
    for i in range(n):
        is_good, is_toxic = rng.random() < 0.6, rng.random() < 0.3
        pick = [rng.choice(good if is_good else bad) for _ in range(rng.randrange(5, 60))] + ([rng.choice(rude) for _ in range(rng.randrange(2, 6))] if is_toxic else [])
        rng.shuffle(pick)
        docs.append((i, " ".join(pick) + ("\n" if i % 7 == 0 else "") + "."))
        quality_of[i], toxic_of[i] = int(is_good), int(is_toxic)
    return docs, quality_of, toxic_of


def test_quality_against_a_plain_version(spark):
    docs, label, _ = corpus()
    known = {i: y for i, y in label.items() if i % 3}
    f = {i: np.array(surface(t)) for i, t in docs}
    every = np.array([f[i] for i, _ in docs])
    positive = np.array([f[i] for i in sorted(i for i, y in known.items() if y == 1)])

    def apart(w, p, u):
        return u.T @ sigmoid(u @ w) / len(u) - p.T @ sigmoid(-(p @ w)) / len(p)

    model = plain_fit(positive[::2], every, apart)
    bins = lambda x: np.bincount(np.minimum(model(x) * 1000, 999).astype(int), minlength=1000)
    above = [x[::-1].cumsum()[::-1] / x.sum() for x in (bins(positive[1::2]), bins(every))]
    prior = min(max(min(u / p for p, u in zip(*above, strict=True) if p >= 0.5), 0.01), 0.99)

    def risk(w, p, u):
        push = u.T @ sigmoid(u @ w) / len(u) - prior * (p.T @ sigmoid(p @ w)) / len(p)
        below = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        return -push if below < 0 else push - prior * (p.T @ sigmoid(-(p @ w))) / len(p)

    want = dict(zip([i for i, _ in docs], plain_fit(positive, every, risk)(every), strict=True))
    d = spark.createDataFrame(docs, "id long, text string").coalesce(1)
    k = spark.createDataFrame(list(known.items()), "id long, label int")
    got = {r.id: r.score for r in quality.score(d, quality.train(d, k)).collect()}
    off = np.array([abs(got[i] - want[i]) for i in want])
    assert off.max() < 0.1 and off.mean() < 0.01 and sum((got[i] >= 0.5) == (label[i] == 1) for i in got) >= 0.95 * len(got)


def bag(text):
    out = Counter()
    for w in split(text.lower()):
        out[w] += 1
        for size in (4, 5, 6, 7):
            if len(w.encode()) > size:
                out[w.encode()[:size], size] += 1
    return out


def plain_category(bags, extra, y, steps=400):
    """Chi-squared choice (all with any, there are few) and L1 logistic regression, in steps as large as toxicity takes."""
    n, ones = len(y), max(1.0, float(sum(y)))
    total, hits = Counter(), Counter()
    for b, t in zip(bags, y, strict=True):
        for k, c in b.items():
            total[k] += c
            hits[k] += c * t
    chosen = [k for k in total if total[k] >= 3 and (hits[k] - total[k] * ones / n) ** 2 > 0]
    x = np.array([[b[k] for k in chosen] for b in bags], dtype=float).reshape(n, -1)
    w, e, c = np.zeros(len(chosen)), np.zeros(extra.shape[1]), math.log(ones / max(1.0, n - ones))
    gw, ge, gc = 1e-8, 1e-8, 1e-8
    for _ in range(steps):
        off = (sigmoid(np.clip(x @ w + extra @ e + c, -30, 30)) - y) / n
        dw, de, dc = off @ x, extra.T @ off, off.sum()
        gw, ge, gc = gw + dw**2, ge + de**2, gc + dc**2
        step = 0.6 / np.sqrt(gw)
        w = w - step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * 1e-4, 0)
        e, c = e - 0.3 * de / np.sqrt(ge), c - 0.3 * dc / math.sqrt(gc)
    return lambda bags, extra: sigmoid(np.clip(np.array([sum(b[k] * v for k, v in zip(chosen, w, strict=True)) for b in bags]) + extra @ e + c, -30, 30))


def chains(docs, label, known, chained=True):
    """p of each category for all documents; without chained, no category sees another."""
    ids = sorted(known)
    bags = {i: bag(t) for i, t in docs}
    fold = {i: int(words.mix(np.array([i], dtype=np.int64).view(np.uint64))[0] % 5) for i in ids}
    learn, use = np.zeros((len(ids), 0)), np.zeros((len(docs), 0))
    out = []
    for c in range(2):
        y = np.array([float(label[i][c]) for i in ids])
        own, all_of = (learn, use) if chained else (learn[:, :0], use[:, :0])
        m = plain_category([bags[i] for i in ids], own, y)
        out.append(m([bags[i] for i, _ in docs], all_of))
        held = np.zeros(len(ids))
        for j in range(5):
            at = [k for k, i in enumerate(ids) if fold[i] != j]
            part = plain_category([bags[ids[k]] for k in at], own[at], y[at])
            left = [k for k, i in enumerate(ids) if fold[i] == j]
            if left:
                held[left] = part([bags[ids[k]] for k in left], own[left])
        learn, use = np.hstack([learn, held[:, None]]), np.hstack([use, out[-1][:, None]])
    return out


def test_toxicity_chain_against_a_plain_version(spark):
    docs, good, toxic = corpus(120)
    label = {i: (good[i], toxic[i]) for i, _ in docs}
    known = [i for i, _ in docs if i % 4]
    want = chains(docs, label, known)
    d = spark.createDataFrame(docs, "id long, text string").repartition(3)
    k = spark.createDataFrame([(i, *label[i]) for i in known], "id long, first int, second int")
    got = {r.id: (r.p_first, r.p_second) for r in toxicity.score(d, toxicity.train(d, k, ["first", "second"]), ["first", "second"]).collect()}
    for c in range(2):
        off = np.array([abs(got[i][c] - want[c][n]) for n, (i, _) in enumerate(docs)])
        assert off.max() < 0.05 and off.mean() < 0.005


def test_a_chain_helps_where_categories_depend_on_each_other(spark):
    """The second category is the first one or a rare mark; few rows show its own words, many the first one's."""
    rng = random.Random(12)
    strong, weak = [f"s{i}" for i in range(40)], [f"w{i}" for i in range(40)]
    docs, label = [], {}
    for i in range(600):
        first = rng.random() < 0.5
        docs.append((i, " ".join(rng.choices(strong if first else weak, k=2) + rng.choices([f"n{j}" for j in range(300)], k=12))))
        label[i] = (int(first), int(first) if rng.random() < 0.7 else int(rng.random() < 0.5))
    learn = [i for i in label if i < 300]
    d = spark.createDataFrame(docs, "id long, text string")
    loss = {}
    for name, categories in (("chain", ["first", "second"]), ("alone", ["second"])):
        k = spark.createDataFrame([(i, *label[i]) for i in learn], "id long, first int, second int").select("id", *categories)
        p = {r.id: r.p_second for r in toxicity.score(d, toxicity.train(d, k, categories), categories).collect()}
        loss[name] = np.mean([-math.log(max(1e-9, p[i] if label[i][1] else 1 - p[i])) for i in label if i >= 300])
    assert loss["chain"] < loss["alone"]


def test_maxscore_in_blocks_of_queries_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 64)
    monkeypatch.setattr(maxscore, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(maxscore, "STEP", 16)
    rng = np.random.default_rng(13)
    x = rng.integers(-3, 4, (400, 6)) * (rng.random((400, 6)) < 0.5)  # many zeros and ties
    rows = [(i, [float(c) / 256 for c in r], 7, [9.0], "s", -1) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, v array<double>, shard string, query_id int")
    q = maxscore.quantised(df)
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in maxscore.top_k(q, q.filter("id % 5 = 0"), 5).collect()}
    want = {}
    for i in range(0, 400, 5):
        best = sorted((-int(x[i] @ x[j]), j) for j in range(400) if j != i)[:5]
        want |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(best)}
    assert got == want


def test_archives_and_urls_of_tables_with_clashing_columns(spark):
    rows = [(1, "http://a.org/x", "p" * 1200, "c", "f", 1, "d"), (2, "http://a.org/y", "p" * 1200, "c", "f", 2, "d"), (2, "http://b.com/de/z", None, "c", "f", 2, "d"), (None, None, "q", "c", "f", 2, "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, `__html` string, file string, at int, `__digest` string")
    got = sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == [(-1, 1, "response", None), (1, 1200, "revisit", 2), (2, 0, "response", None), (2, 1200, "response", None)]
    judged = sorted((r.page_id or -1, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, queries.RULES).collect())
    assert judged == [(-1, "", "", None, "allow"), (1, "a.org", "/x", "org/", "allow"), (2, "a.org", "/y", "org/", "allow"), (2, "b.com", "/de/z", "com/de/", "block")]


def test_archives_beyond_the_broadcast_with_a_popular_page(spark, monkeypatch):
    rows = [(i, "http://a.org/", ("p" * 1500 if i % 3 else "" if i % 2 else f"{i}" * 1000)) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = [tuple(r) for r in warc.round_trip(pages).collect()]
    monkeypatch.setattr(warc, "FEW", 0)
    assert sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str) == sorted(plain, key=str) and len(plain) == 120
