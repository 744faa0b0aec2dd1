"""The operators against brute force, held-out labels and awkward rows."""

import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shotline.llm import decontam, jaccard, lines, lm, maxscore, mixing, quality, queries, shared, urls, warc, words

WORD = re.compile(r"[0-9a-z_\x80-\U0010ffff]+")
SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, `set` string, `id` int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "x", 1) for i, t, s in rows], DOC)


def awkward():
    a = " ".join(f"w{i}" for i in range(40))
    b = a.replace("w20 ", "z20 ").replace("w0 ", "y0 ")
    long = " ".join(f"k{i % 997}x{i}" for i in range(30_000))
    return [(1, a, "p"), (2, a, "p"), (3, b, "q"), (4, None, None), (5, "", "p"), (6, "one two", "q"), (7, long, "q"), (8, f"{a}\nshort\n{a}", "p"), (9, a, "p"), (9, a, "p"), (None, a, "p"), (10, "one two", None), (11, long + " end", "p")]


def shingle_set(t):
    w = WORD.findall((t or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def sim(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("empty", [False, True])
def test_jaccard_classes(spark, empty):
    rows = [] if empty else awkward()
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in jaccard.classes(docs_of(spark, rows)).collect()}
    sets = {i: shingle_set(t) for i, t, _ in rows if i is not None}
    rep = {i: min((j for j in sets if sets[j] == s), default=i) if s else i for i, s in sets.items()}
    near = {i: {rep[j] for j in sets if rep[j] != rep[i] and sim(sets[i], sets[j]) >= 0.8} for i in sets}
    assert {i: (x[0], x[1]) for i, x in got.items()} == {i: (rep[i], len(near[i])) for i in sets}
    assert all(got[i][2] == got[j][2] for i in near for j in near[i])


def test_jaccard_runs_reach_the_recall_at_full_depth():
    x = np.random.default_rng(2).integers(0, 1 << 63, (400, 100)).astype(np.uint64)
    found = 0
    for row in x:  # a pair of 100 and 80 tokens, the smaller within the larger
        once = [np.uint64(k) for k in words.seeded(5, 20)]
        h = np.array([words.mix(row ^ k) for k in once]).astype(np.float64)
        found += (h[:, :80] < 2.0**64 / 80).any(axis=1).sum()
    chance = found / 8000
    for depth in (1, 2, 3):
        assert (1 - chance**depth) ** jaccard.runs_for(0.9999, 0.8, depth) < 3e-4
    assert abs(chance - 0.632) < 0.02


@pytest.mark.parametrize("empty", [False, True])
def test_line_dedup(spark, empty):
    rows = [] if empty else [r for r in awkward() if r[0] not in (None, 9)] + [(12, "\n".join(" ".join(f"l{j + k}" for j in range(30)) for k in range(6)), "p")]
    got = {(r.doc, r.line) for r in lines.later_matches(docs_of(spark, rows)).collect()}
    seen, want = [], set()
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(WORD.findall(line.lower()))
            if len(s) >= 5:
                if any(sim(s, o) >= 0.8 for o in seen):
                    want.add((i, k))
                seen.append(s)
    assert got == want
    out = lines.dedup(docs_of(spark, rows))
    assert out.columns == docs_of(spark, rows).columns
    assert {r.doc_id for r in out.collect()} >= {i for i, t, _ in rows if not t}


def test_short_lines_are_deduplicated_too(spark):
    texts = ["one two\n---\na b c d", "two  One\n---\na b c d e\nx", "x\nx y\nx y z", "x y z\nz y x w\nnew", "\n\none\nONE one"]
    rows = [(i + 1, t, "p") for i, t in enumerate(texts)] + [(9, None, "p"), (None, "one two", "p")]
    seen, want = [], {}
    for i, t, _ in rows:
        if i is not None:
            want[i] = []
            for k, line in enumerate((t or "").split("\n")):
                s = frozenset(WORD.findall(line.lower()))
                if any(sim(s, o) >= 0.8 for o in seen):
                    want[i].append(k)
                seen.append(s)
    assert want[2] == [0, 2] and want[3] == [0] and want[4] == [0] and want[5] == [3]
    got = {r.doc_id: r.removed_lines for r in lines.report(docs_of(spark, rows)).collect() if r.doc_id is not None}
    assert got == want
    left = {r.doc_id: r.text for r in lines.dedup(docs_of(spark, rows)).collect()}
    assert left[2] == "---\nx" and left[3] == "x y\nx y z" and left[4] == "z y x w\nnew"


def test_decontamination(spark):
    item = " ".join(f"b{i}" for i in range(30))
    edited = item.replace("b5 ", "").replace("b17 ", "new b17x ")
    far = " ".join(f"b{i}" if i % 2 else f"n{i}" for i in range(30))
    rows = [(1, f"start {item} end", "p"), (2, f"a b {edited} c", "p"), (3, far, "p"), (4, None, None), (5, "", "p"), (6, item[:60], "p")]
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0)], "item_id long, text string, edits int")
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.matches(docs_of(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1] == 0 and 0 < got[2, 1] <= 6
    kept = decontam.clean(docs_of(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 6}
    assert decontam.matches(docs_of(spark, []), bench).count() == 0 and decontam.matches(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_maxscore(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8)).round(1)
    v[rng.random((400, 8)) < 0.6] = 0
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (None, [1.0] * 8), (3, [float(x) for x in v[3]])]
    q = maxscore.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in maxscore.top_k(q, q.filter("id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    x = np.floor(256 * v.astype(np.float32).astype(np.float64)).astype(np.int64)
    for i in range(0, 400, 50):
        s = sorted((-int(x[i] @ x[j]), j) for j in range(400) if j != i)[:5]
        assert sorted(got[i]) == [(k + 1, j, -n) for k, (n, j) in enumerate(s)]
    none = q.limit(0)
    assert maxscore.top_k(none, none).count() == 0


def test_urls(spark):
    cases = {
        "http://A.example.ORG/en/1x?q": ("a.example.org", "/en/1x", "example.org/en/1", "block"), "https://x.org": ("x.org", "", None, "allow"), "http://x.org/#a": ("x.org", "/", "org/", "allow"),
        "http://notorg/": ("notorg", "/", None, "allow"), "http://s.com/de/": ("s.com", "/de/", "com/de/", "block"), "nourl": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, queries.RULES).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.judge(pages.limit(0), queries.RULES).count() == 0 and urls.judge(pages, []).count() == len(cases)


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = urls.build(universe.filter("hash(key) % 7 = 0"), universe)
    rows = universe.select("key", (F.expr("hash(key) % 7 = 0")).alias("y"), F.xxhash64("key").alias("a"), F.xxhash64(F.lit("second"), "key").alias("b")).toPandas()
    assert len(cascade) > 1 and (urls.contains(cascade, rows["a"].to_numpy(), rows["b"].to_numpy()) == rows["y"].to_numpy()).all()


def test_warc_rejects_magic_in_payloads(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "x" * 1500 + "é"
    rows = [(1, "u", fake), (2, "u", big), (3, None, big), (4, "a\r\nb", None), (5, "u", "small"), (6, "u", "small"), (7, "u", fake * 30), (None, "u", big)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    import hashlib

    assert set(got) == {r[0] for r in rows}
    for i, _, t in rows:
        b = (t or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
    assert (got[2].record_type, got[2].refers_to, got[3].record_type, got[None].refers_to) == ("revisit", 3, "response", 3)
    assert got[5].record_type == got[6].record_type == "response"


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op4_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.95
    none = quality.score(docs_of(spark, awkward()), quality.train(docs_of(spark, []).select(F.col("doc_id").alias("id"), "text"), spark.createDataFrame([], "id long, label int")), "text", "s")
    assert {r.s for r in none.collect()} == {0.5}


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_toxicity(spark, sf).withColumnRenamed("toxic", "flag").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("crc32(cast(doc_id as string)) % 5 = 0").collect()
    assert np.mean([r.flag == r.toxic for r in rows]) > 0.98
    found = sum(r.flag * r.toxic for r in rows)
    assert found >= 0.9 * sum(r.toxic for r in rows) and found >= 0.9 * sum(r.flag for r in rows)


def test_mixing_meets_its_rates(spark):
    rows = [(i, "x" * 10, "a" if i % 4 else "b") for i in range(4000)]
    out = mixing.copies(docs_of(spark, rows), {"a": 1.0, "b": 1.0}).groupBy("source").count().collect()
    assert all(abs(r["count"] / 2000 - 1) < 0.1 for r in out)
    again = mixing.copies(docs_of(spark, awkward()))
    assert again.columns == [*docs_of(spark, []).columns, "copy", "n_copies", "shuffle_key"]
    assert [r.shuffle_key for r in again.collect()] == [r.shuffle_key for r in mixing.copies(docs_of(spark, awkward())).collect()]
    assert mixing.copies(docs_of(spark, [])).count() == 0


def test_lm_base_score_and_distribution(spark):
    rows = [(i, t, s) for i, t, s in awkward() if i is None or i != 7]
    got = lm.score(docs_of(spark, rows)).collect()
    train = [t for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "") + [None]
    count = {}
    for t in train:
        for w in tokens(t):
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for r in got:
        if r.doc_id in (1, 4, 6):
            w = tokens(dict((i, t) for i, t, _ in rows)[r.doc_id])
            assert (r.n_tokens, r.train_tokens) == (len(w), n)
            assert math.isclose(r.base_score, sum(math.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
            assert r.score < 0
    classes = lm.Classes(np.ones(lm.IDS, dtype=np.int64), lm.TOKENIZER)
    p = lm.parts(lm.initial(classes))
    g = np.tile(np.append(np.random.default_rng(0).normal(size=lm.WIDTH), 1).astype(np.float32), (lm.CLASSES, 1))
    logp, _ = lm.heads(p, g, np.arange(lm.CLASSES))
    assert abs(np.exp(logp).sum() - 1) < 1e-3


def test_lm_learns_from_every_document_and_every_id(spark):
    names = spark.range(40).select("id", F.md5(F.col("id").cast("string")).alias("text"), F.lit(False).alias("held"), F.lit(0).alias("block"))
    counts, ids = np.zeros(lm.IDS, dtype=np.int64), set()
    for r in names.collect():
        for i in lm.encoder(lm.TOKENIZER).encode(f" {r.text}"):
            counts[i] += 1
            ids.add(i)
    counts[lm.END] = 40
    classes = lm.Classes(counts, lm.TOKENIZER)
    assert len({int(classes.of[i]) for i in ids} | {0}) == len(ids) + 1
    every = lm.Classes(np.ones(lm.IDS, dtype=np.int64), lm.TOKENIZER)
    assert len(np.unique(every.of)) == lm.IDS
    before, after = lm.parts(lm.initial(classes))["emb"], lm.parts(lm.train(names, int(counts.sum()), classes, lm.TOKENIZER))["emb"]
    moved = (before != after).any(axis=1)
    assert moved[[int(classes.of[i]) for i in ids]].all()  # each id is followed by another or by an end


def _small_model():
    counts = np.zeros(lm.IDS, dtype=np.int64)
    counts[[262, 290, 286, 318, 287, 257]], counts[lm.END] = 50, 10
    classes = lm.Classes(counts, lm.TOKENIZER)
    rng = np.random.default_rng(4)
    flat = lm.initial(classes) + rng.normal(size=lm.size_of(classes.groups)).astype(np.float32) * 0.3
    seen = np.array([262, 290, 286, 318, 287, 257])
    sizes = [1, 3, 32, 33, 75, 200]
    ids = np.concatenate([np.append(rng.choice(seen, n - 1), lm.END) for n in sizes])
    return classes, flat, ids, np.append(0, np.cumsum(sizes))


def test_lm_scores_each_id_once_like_plain_masked_attention():
    classes, flat, ids, begin = _small_model()
    p = {k: v.astype(np.float64) for k, v in lm.parts(flat).items()}
    y = classes.of[ids].astype(np.int64)
    n, scored = classes.groups, np.zeros(len(ids), dtype=int)

    def logp(before, target):
        e = p["emb"][before] + p["pos"][: len(before)]
        q, k, v = e[-1] @ p["qkv"][:, : lm.WIDTH], e @ p["qkv"][:, lm.WIDTH : 2 * lm.WIDTH], e @ p["qkv"][:, 2 * lm.WIDTH :]
        a = np.exp(k @ q / math.sqrt(lm.WIDTH))
        g = np.append(e[-1] + (a / a.sum()) @ v @ p["o"], 1)
        up, low = g @ p["group"], g @ p["slot"][target // n]
        return up[target // n] - np.log(np.exp(up).sum()) + low[target % n] - np.log(np.exp(low).sum())

    want = np.zeros(len(begin) - 1)
    for t, (a, b) in enumerate(zip(begin[:-1], begin[1:])):
        start = a
        while start < b:
            for i in range(start if start == a else start + lm.CONTEXT, min(b, start + lm.LENGTH)):
                before = [0 if j == a else y[j - 1] for j in range(start, i + 1)]
                want[t] += logp(before, y[i]) + classes.within[ids[i]]
                scored[i] += 1
            if start + lm.LENGTH >= b:
                break
            start += lm.LENGTH - lm.CONTEXT
    assert (scored == 1).all()
    assert np.allclose(lm.score_texts(flat, ids, begin, classes), want, rtol=1e-4)


def test_lm_gradient_equals_finite_differences():
    classes, flat, ids, begin = _small_model()
    y = classes.of[ids]
    x = lm.inputs(y, begin)
    text, first, opens = lm.windows(begin)
    target, counts = lm.cut(begin[text + 1], first, opens)

    def loss(w):
        p = lm.parts(w)
        return -float(lm.heads(p, lm.forward(p, x[target])[-1][counts], y[target[counts]])[0].astype(np.float64).mean())

    p, grad = lm.parts(flat), np.zeros_like(flat)
    kept = lm.forward(p, x[target])
    _, below = lm.heads(p, kept[-1][counts], y[target[counts]], grad)
    dg = np.zeros((*target.shape, lm.WIDTH), dtype=np.float32)
    dg[counts] = below
    lm.backward(p, kept, dg, grad)
    for own in lm.parts(np.arange(len(flat))).values():
        at = own.ravel()[np.argsort(-np.abs(grad[own.ravel()]))[:4]]
        for i in at:
            up, down = flat.copy(), flat.copy()
            up[i] += 0.01
            down[i] -= 0.01
            assert math.isclose((loss(up) - loss(down)) / 0.02, grad[i], rel_tol=0.05, abs_tol=2e-4)


def edit_distance(a, b):
    """Least edits between a and any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(8)
    vocab = [f"v{i}" for i in range(60)]
    items = {i: list(rng.choice(vocab, n)) for i, n in enumerate((1, 3, 7, 8, 12, 12, 25, 40, 90))}
    items[20] = list(items[6])
    rows = [(0, None), (1, ""), (2, " ".join(f"k{i % 997}x{i}" for i in range(30_000)) + " " + " ".join(items[7]))]
    for d in range(3, 40):
        words_ = list(rng.choice(vocab, 30))
        part = list(items[int(rng.choice(list(items)))])
        for _ in range(int(rng.integers(0, 1 + len(part) // 4))):
            at = int(rng.integers(len(part)))
            part[at : at + 1] = [[], ["q"], [part[at], "q"]][int(rng.integers(3))]
            part = part or ["q"]
        rows.append((d, " ".join(words_[:15] + part + words_[15:])))
    rows += [(3, rows[5][1]), (None, rows[5][1])]  # a repeated doc_id and none
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(6, "zz " * 9), (None, "v1"), (30, None)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for d, t in rows:
        for i, w in [*items.items(), (6, ["zz"] * 9)]:
            if d is not None and t:
                e = edit_distance(w, WORD.findall(t))
                if e <= decontam.edits(len(w)):
                    want[d, i] = min(e, want.get((d, i), e))
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.matches(docs, bench).collect()}
    assert got == want and any(e > 0 for e in got.values())


def test_decontamination_recall_at_the_largest_distance(spark):
    rng = np.random.default_rng(9)
    rows, items = [], []
    for i in range(160):
        n = int(rng.choice([8, 10, 20, 30, 60]))
        item = [f"a{i}w{j}" for j in range(n)]
        near = list(item)
        for e in range(decontam.edits(n)):
            at = int(rng.integers(len(near)))
            near[at : at + 1] = [[], [f"z{i}e{e}"], [near[at], f"z{i}e{e}"]][int(rng.integers(3))]
        items.append((i, " ".join(item)))
        rows.append((i, " ".join([f"d{i}k{j}" for j in range(20)] + near + [f"e{i}k{j}" for j in range(20)])))
    got = decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).filter("doc_id = item_id").count()
    assert got >= 0.99 * len(rows)


def test_mixing_takes_any_column_name_and_large_rates(spark):
    rows = [(i, "x" * 10, "a", 1, 2, 3) for i in range(50)] + [(99, "y", "b", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, cdf int, Copy int, n_copies int")
    out = mixing.copies(docs, {"a": 1.0, "b": 1.0})
    assert out.columns == ["doc_id", "text", "source", "cdf", "copy", "n_copies", "shuffle_key"]
    got = out.groupBy("source").agg(F.count("*").alias("n"), F.max("copy").alias("most")).collect()
    assert {r.source: abs(r.n / (250.5 if r.source == "b" else 25.05) - 1) < 0.5 for r in got} == {"a": True, "b": True}


def test_maxscore_with_large_components(spark):
    v = [[1e7, -2.0, 0.5], [1.1e7, 1.0, -0.25], [9e6, 0.0, 1.0], [-1e7, 5.0, 0.0], [1e7, 1.0, 0.1]]
    q = maxscore.quantised(spark.createDataFrame([(i * 50, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>"))
    x = [[math.floor(256 * c) for c in r] for r in v]
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in maxscore.top_k(q, q, 2).collect()}
    for i in range(5):
        s = sorted((-sum(a * b for a, b in zip(x[i], x[j])), j * 50) for j in range(5) if j != i)[:2]
        assert [got[i * 50, k + 1] for k in range(2)] == [(j, -n) for n, j in s]
    huge = maxscore.quantised(spark.createDataFrame([(0, [1e15]), (50, [1e15])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="doesn't fit a long"):
        maxscore.top_k(huge, huge).collect()


def test_sparse_maxscore_traverses_essential_postings(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6000, 24)).round(2) * (rng.random((6000, 24)) < 0.1)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    q = maxscore.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in maxscore.top_k(q, q.filter("id % 600 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    x = np.floor(256 * v).astype(np.int64)
    for i in range(0, 6000, 600):
        s = sorted((-int(n), j) for j, n in enumerate(x @ x[i]) if j != i)[:5]
        assert sorted(got[i]) == [(k + 1, j, -n) for k, (n, j) in enumerate(s)]


def test_jaccard_with_every_bucket_split(spark):
    docs = docs_of(spark, awkward())
    rows = lambda **how: sorted(map(tuple, jaccard.classes(docs, **how).collect()))
    assert rows(limit=1, depth=3) == rows()
    with pytest.raises(RuntimeError, match="settled"):
        jaccard.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), rounds=1)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 7]


def test_archives_of_many_members_and_large_pages(spark, tmp_path):
    import gzip

    records = b"".join(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" % i) for i in range(5))
    (tmp_path / "part-0.gz").write_bytes(records)
    (tmp_path / "part-1.gz").write_bytes(records[:-20])
    assert warc.read(spark, str(tmp_path)).count() == 9
    pages = spark.range(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.expr("repeat('abcdefghij', 5000000)").alias("html")).union(spark.range(10, 200).selectExpr("id", "'u'", "concat('p', id)"))
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 193 and got[2].payload_bytes == 50_000_000 and got[0].refers_to == 2 and got[0].record_type == "revisit"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_long_url_lists_are_joined(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.example.org/en/1x"), (2, "https://x.org/"), (3, None), (3, "http://s.com/de/")], "page_id long, url string")
    rows = lambda: sorted(map(str, urls.judge(pages, queries.RULES).collect()))
    want = rows()
    monkeypatch.setattr(urls, "MOST_BITS", 1)
    assert rows() == want


def test_quality_risk_gradient_and_prior():
    rng = np.random.default_rng(10)
    p, u, w = rng.normal(size=(40, 5)), rng.normal(size=(60, 5)), rng.normal(size=5)
    for risk in (quality.apart, lambda w, p, u: quality.pu_risk(w, p, u, 0.3)):
        value, grad = risk(w, p, u)
        for i in range(5):
            e = np.eye(5)[i] * 1e-6
            assert math.isclose((risk(w + e, p, u)[0] - risk(w - e, p, u)[0]) / 2e-6, grad[i], rel_tol=1e-4, abs_tol=1e-6)
    value, grad = quality.pu_risk(w * 9, p, -p, 0.99)  # the negative part is below zero here
    fp, fu = p @ (w * 9), -p @ (w * 9)
    if np.logaddexp(0, fu).mean() < 0.99 * np.logaddexp(0, fp).mean():
        assert math.isclose(value, 0.99 * np.logaddexp(0, -fp).mean())
    score = lambda n, good: np.bincount(np.clip((rng.normal(0.8 if good else 0.2, 0.1, n) * quality.BINS), 0, quality.BINS - 1).astype(int), minlength=quality.BINS)
    assert abs(quality.least_ratio(score(2000, True), score(600, True) + score(1400, False)) - 0.3) < 0.04


def test_quality_prior_needs_no_negatives(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ones = labels.filter("quality = 1").select(F.col("doc_id").alias("id"), F.lit(1).alias("label"))
    a = quality.train(docs, ones)
    b = quality.train(docs, ones.unionByName(docs.select("id", F.lit(0).alias("label"))))
    assert (a["w"] == b["w"]).all() and abs(a["prior"][0] - labels.agg(F.avg("quality")).first()[0]) < 0.06


def test_awkward_rows_of_fitted_models(spark):
    rows = awkward()
    docs = docs_of(spark, rows).select(F.col("doc_id").alias("id"), "text")
    labels = spark.createDataFrame([(1, 1), (9, 1), (3, 0), (None, 1), (2, None)], "id long, label int")
    s = quality.score(docs, quality.train(docs, labels), "text", "s").collect()
    assert len(s) == len(rows) and all(0 <= r.s <= 1 for r in s)
    from shotline.llm import toxicity

    kinds = spark.createDataFrame([(1, 1, 0), (9, 0, 1), (9, 1, None), (3, 0, 0), (None, 1, 1)], "id long, a int, b int")
    for data in (docs, docs.limit(0)):
        models = toxicity.train(data, kinds, ["a", "b"])
        out = toxicity.score(docs, models, ["a", "b"]).collect()
        assert len(out) == len(rows) and all(0 <= r.p_a <= 1 and 0 <= r.p_b <= 1 for r in out)
    again = [toxicity.score(docs, toxicity.train(docs.repartition(n), kinds, ["a", "b"]), ["a", "b"]).orderBy("id", "p_b").collect() for n in (1, 7)]
    assert again[0] == again[1]


def test_lm_takes_empty_tables_and_awkward_rows(spark):
    assert lm.score(docs_of(spark, [])).count() == 0
    got = lm.score(docs_of(spark, [(4, None, "p"), (None, None, "p"), (4, "", "p")])).collect()
    assert len(got) == 3 and all(r.n_tokens == 1 and r.score <= 0 for r in got)


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline

    texts = ["\n".join(" ".join(f"{c}{k}w{j}" for j in range(12)) for k in range(3)) for c in "abcdefg"]
    texts[1] = texts[0].replace("a0w0", "x") + "\n" + texts[1]
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t)) for i, t in enumerate(texts)] + [(20, texts[2], "en", None, 1), (21, texts[6] + "\nnew line of words", "en", "s", 1), (None, texts[3], "en", "s", 1), (22, None, "en", "s", 0), (23, "", None, "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    seen, want = [], {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        kept = []
        for line in (t or "").split("\n"):
            s = frozenset(WORD.findall(line.lower()))
            if not (s and any(sim(s, o) >= 0.8 for o in seen)):
                kept.append(line)
            seen.append(s)
        if not t or "".join(kept).strip():
            want[i] = "\n".join(kept) if t else t
    got = {r.doc_id: r.text for r in stage["line dedup"](spark, docs, SF).collect()}
    assert got.pop(None) == texts[3] and got == want
    sets = {r[0]: shingle_set(r[1]) for r in rows if r[0] is not None}
    groups = {i: min(j for j in sets if i == j or sim(sets[i], sets[j]) >= 0.8) for i in sets}
    got = [r.doc_id for r in stage["near duplicates"](spark, docs, SF).collect()]
    assert sorted(x for x in got if x is not None) == sorted(set(groups.values())) and None in got
    (_, last) = corpus_pipeline.STAGES[-1]
    out = last(spark, docs, SF)
    counts = {(r.doc_id, r.copy) for r in out.collect()}
    assert all(c == 1 or (i, c - 1) in counts for i, c in counts)


def test_hashes_follow_words():
    import pyarrow as pa

    texts = ["a b a", None, "", "A\nb", "x" * 9000]
    b = next(words.batches(pa.array(texts)))
    assert b.row.tolist() == [0, 0, 0, 3, 3, 4] and b.hash[0] == b.hash[2] == b.hash[3] and b.hash[1] == b.hash[4]


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
    assert {"copy", "n_copies"} <= set(corpus_pipeline.run(spark, SF).columns)


def test_jaccard_paths_cost_no_more_with_many_split_ones():
    texts = pa.array([" ".join(f"w{(i * 31 + j * j) % 997}" for j in range(60)) for i in range(300)])
    sets = [jaccard.Sets(b, 5) for b in words.batches(texts)]

    def walk(heavy):
        begin = time.process_time()
        found = [(own.tolist(), node.tolist(), depth) for x in sets for own, node, depth in jaccard._paths(x, 32, heavy, 0.8)]
        return time.process_time() - begin, found

    none, many = jaccard.Heavy(np.zeros(0, np.uint64)), jaccard.Heavy(words.seeded(99, 40_000))
    assert walk(none)[1] == walk(many)[1]
    assert min(walk(many)[0] for _ in range(5)) < 4 * min(walk(none)[0] for _ in range(5)) + 0.05  # a sort of all for each lookup takes over twenty times as long
    split = walk(none)[1][0][1][0]
    some = walk(jaccard.Heavy(np.append(words.seeded(99, 40_000), np.uint64(split))))[1]
    assert {d for _, _, d in some} == {1, 2} and all(split not in nodes for _, nodes, _ in some)


def test_packing_many_small_pieces_costs_no_more():
    pack = shared.blobs(lm.TOTAL, 4, 50_000)

    def cost(pieces, rows):
        e = np.zeros(rows, lm.TOTAL)
        begin = time.process_time()
        out = list(pack((np.arange(rows) % 4, e) for _ in range(pieces)))
        assert sum(len(x.as_py()) for b in out for x in b.column("blob")) == pieces * rows * lm.TOTAL.itemsize
        return (time.process_time() - begin) / pieces

    cost(100, 4)
    assert cost(12_000, 4) < 5 * cost(1_500, 4)  # what is held was counted anew for each piece
