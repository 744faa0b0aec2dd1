"""LM scoring: a causal self-attention model over subword ids, trained in numpy inside Spark tasks.

The text of a document is its words, runs of bytes other than white space, with A-Z lower-cased; each word is encoded
with a space before it by a public byte-level BPE vocabulary (read from a file, never trained), and one end id
follows.  One layer of masked self-attention over the classes of the ids before it predicts the class of the next id
in two steps, first a group of classes, then a class of that group.  Every id seen in the documents to learn from is a
class of its own, so the classes grow with the vocabulary seen; ids never seen share the last class of a group and are
told apart by smoothed counts.  A score is the sum of the log10 probabilities of all ids, the end included, which is a proper distribution over
id sequences.

To score, windows of LENGTH ids overlap by CONTEXT ids: the first CONTEXT positions of a window, but for a text's
first, are context only, so that each id is scored once.

Training: all documents to learn from, in ROUNDS parts; in each round every task starts from the same weights, takes
Adam steps over each window of its own part once, in random order, and the weights are averaged by Spark.  So every id
to learn from is a target once.  Counts of ids and words cover all documents to learn from, too.

The baseline is the smoothed unigram model of words.  Words are counted block by block: a task sends each word of a
block of documents once, with its count, to the word's partition, and gets the total back for its block, so that a
frequent word costs a row a block.  Words are told apart by 64-bit hashes.

Null texts count as empty: they have the end only.  Repeated doc_ids are scored row by row; a null doc_id counts as
held out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotline.llm import shared, words
from shotline.llm.quality import remainder

if TYPE_CHECKING:
    import tiktoken

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
IDS = 50_257
END = 50_256
LENGTH, CONTEXT = 32, 4
WIDTH = 16
ROUNDS = 3
#: Windows of a step at most; a part with few windows takes smaller steps, STEPS of them at least.
BATCH, STEPS = 384, 200
#: Weights that travel together from the training tasks to their mean.
PIECE = 4096
#: Ids of the corpus for each training task, which holds a part of ROUNDS of them at once.
IDS_A_TASK = 9_000_000
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PAIR = np.dtype([("word", "<u8"), ("block", "<i4"), ("count", "<i8")])
TOTAL = np.dtype([("word", "<u8"), ("count", "<i8")])

_ENCODERS: dict[str, tiktoken.Encoding] = {}


def encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary at path; a word with the space before it is one piece."""
    import tiktoken  # only here, so that other queries work without it

    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("bpe", pat_str=r" [^ ]+", mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


_OPENING: dict[str, np.ndarray] = {}


def opening(path: str) -> np.ndarray:
    """Of each id, whether its bytes begin with a space."""
    if path not in _OPENING:
        enc = encoder(path)
        _OPENING[path] = np.array([enc.decode_single_token_bytes(i)[:1] == b" " for i in range(END)])
    return _OPENING[path]


class Words:
    """Words of a block of texts: the distinct ones as hashes and bytes, and each occurrence by its number and row."""

    def __init__(self, texts: pa.Array):
        raw, offsets = words.text_bytes(texts)
        self.n = len(offsets) - 1
        hashes, rows, numbers, spans, self.pieces = [], [], [], [], []
        for a, b in words.groups(offsets):
            buf, at = LOWER[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
            if not len(buf):
                continue
            inside = ~SPACE[buf]
            edge = at[(at > 0) & (at < len(buf))]
            before, after = np.zeros_like(inside), np.zeros_like(inside)
            before[1:], after[:-1] = inside[:-1], inside[1:]
            before[edge], after[edge - 1] = False, False
            starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
            own, first, number = np.unique(words.hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
            hashes.append(own)
            numbers.append(number.astype(np.int32))
            rows.append((np.searchsorted(at[1:], starts, "right") + a).astype(np.int32))
            spans.append(np.stack([np.full(len(first), len(self.pieces)), starts[first], ends[first]], axis=1).astype(np.int32))
            self.pieces.append(buf.tobytes())
        self.row = np.concatenate([np.zeros(0, dtype=np.int32), *rows])
        self.hash, first, number = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *hashes]), return_index=True, return_inverse=True)
        self.span = np.concatenate([np.zeros((0, 3), dtype=np.int32), *spans])[first]
        begin = np.cumsum([0, *map(len, hashes)])
        self.number = np.concatenate([np.zeros(0, dtype=np.int32), *(number[a:b].astype(np.int32)[x] for a, b, x in zip(begin[:-1], begin[1:], numbers, strict=True))])

    def encoded(self, path: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all distinct words in a row, where each word's begin): only a word's first id begins with a space."""
        if not len(self.hash):
            return np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        enc = encoder(path)
        text = b"".join(b" " + self.pieces[p][a:b] for p, a, b in self.span.tolist()).decode("utf-8", "replace")
        flat = enc.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        return flat, np.append(np.flatnonzero(opening(path)[flat]), len(flat))

    def sequences(self, path: str, at_once: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Of the texts a to b, piece by piece of about at_once words: (a, b, their ids, each text's followed by END, where each begins)."""
        flat, at = self.encoded(path)
        cut, a = np.searchsorted(self.row, np.arange(self.n + 1)), 0
        while a < self.n:
            b = min(self.n, max(a + 1, int(np.searchsorted(cut, cut[a] + at_once, "right")) - 1))
            number = self.number[cut[a] : cut[b]]
            size = np.diff(at)[number]
            begin = np.append(0, np.cumsum(np.bincount(self.row[cut[a] : cut[b]] - a, weights=size, minlength=b - a).astype(np.int64) + 1))
            out = np.full(begin[-1], END, dtype=np.int32)
            free = np.ones(len(out), dtype=bool)
            free[begin[1:] - 1] = False
            out[free] = flat[np.arange(size.sum()) + np.repeat(at[number] - (np.cumsum(size) - size), size)]
            yield a, b, out, begin
            a = b


def groups_for(seen: int) -> int:
    """Groups, and slots of each, in which seen ids and the end's have a slot of their own beside the groups' last."""
    n = 2
    while n * (n - 1) < seen + 1:
        n += 1
    return n


CLASSES = groups_for(END) ** 2  # with all ids seen; class 0 is the end's, and the start's


class Classes:
    """Classes of ids and the log probabilities of ids within them, from counts of ids.

    Class c is slot c % groups of group c // groups.  Ids that are alike in spelling share a group.
    """

    def __init__(self, counts: np.ndarray, path: str):
        enc = encoder(path)
        spelled = [enc.decode_single_token_bytes(i) for i in range(END)]
        own = np.flatnonzero(counts[:END])
        own = np.array(sorted(own.tolist(), key=spelled.__getitem__), dtype=np.int64)
        self.groups = n = groups_for(len(own))
        place = np.arange(1, len(own) + 1)  # place 0 is the end's
        self.of = np.zeros(IDS, dtype=np.int32)
        first = np.array([b[0] for b in spelled])
        self.of[:END] = (first % n) * n + n - 1
        self.of[own] = place // (n - 1) * n + place % (n - 1)
        self.of[END] = 0
        smooth = counts + 1.0
        share = np.bincount(self.of, weights=smooth, minlength=n * n)
        self.within = np.log(smooth / share[self.of]).astype(np.float32)
        self.share = np.maximum(share, 1e-3).reshape(n, n)


def shapes(groups: int) -> dict[str, tuple[int, ...]]:
    """group and slot have a last row for the biases."""
    return {"emb": (groups**2, WIDTH), "pos": (LENGTH, WIDTH), "qkv": (WIDTH, 3 * WIDTH), "o": (WIDTH, WIDTH), "group": (WIDTH + 1, groups), "slot": (groups, WIDTH + 1, groups)}


def size_of(groups: int) -> int:
    return sum(int(np.prod(x)) for x in shapes(groups).values())


def groups_of(size: int) -> int:
    """The groups of a model of so many weights."""
    n = int(np.sqrt((size - size_of(0)) / (2 * WIDTH + 1)))
    assert size_of(n) == size
    return n


SCALE = np.float32(WIDTH**-0.5)
SEEN = np.tril(np.ones((LENGTH, LENGTH), dtype=np.float32))


def parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(groups_of(len(flat))).items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(classes: Classes) -> np.ndarray:
    flat = (np.random.default_rng(3).standard_normal(size_of(classes.groups)) * 0.15).astype(np.float32)
    p = parts(flat)
    p["group"][-1] = np.log(classes.share.sum(1) / classes.share.sum())
    p["slot"][:, -1] = np.log(classes.share / classes.share.sum(1, keepdims=True))
    return flat


def forward(p: dict[str, np.ndarray], x: np.ndarray) -> tuple:
    """Activations for classes x (windows x LENGTH), the last what the outputs read; a position sees itself and what is before."""
    e = p["emb"].take(x, axis=0)
    e += p["pos"]
    qkv = e @ p["qkv"]
    q, k, v = qkv[..., :WIDTH] * SCALE, qkv[..., WIDTH : 2 * WIDTH], qkv[..., 2 * WIDTH :]
    a = q @ k.transpose(0, 2, 1)
    np.exp(np.clip(a, -40, 40, out=a), out=a)
    a *= SEEN
    total = (a @ np.ones(LENGTH, dtype=np.float32))[:, :, None]
    c = a @ v
    c /= total
    g = np.empty((*x.shape, WIDTH + 1), dtype=np.float32)
    np.add(c @ p["o"], e, out=g[..., :WIDTH])
    g[..., WIDTH] = 1
    return x, e, q, k, v, a, total, c, g


def backward(p: dict[str, np.ndarray], kept: tuple, dg: np.ndarray, grad: np.ndarray) -> None:
    """Set in grad the gradient below the last activations; kept's attention is used up."""
    x, e, q, k, v, a, total, c, _ = kept
    a /= total
    d = parts(grad)
    flat = lambda t: t.reshape(-1, t.shape[-1])
    d["o"][:] = flat(c).T @ flat(dg)
    dc = dg @ p["o"].T
    dqkv = np.empty((*x.shape, 3 * WIDTH), dtype=np.float32)
    dqkv[..., 2 * WIDTH :] = a.transpose(0, 2, 1) @ dc
    da = dc @ v.transpose(0, 2, 1)
    da -= (dc[..., None, :] @ c[..., :, None])[..., 0]  # the sum of da * a of each row
    a *= da
    dqkv[..., :WIDTH] = (a @ k) * SCALE
    dqkv[..., WIDTH : 2 * WIDTH] = a.transpose(0, 2, 1) @ q
    d["qkv"][:] = flat(e).T @ flat(dqkv)
    de = dqkv @ p["qkv"].T
    de += dg
    d["pos"][:] = de.sum(0)
    de, x = flat(de), x.ravel()
    for j in range(WIDTH):
        d["emb"][:, j] = np.bincount(x, weights=de[:, j], minlength=len(d["emb"]))


def _softmax(g: np.ndarray, weight: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log probabilities of y, exponentials, their sums) of a softmax of g @ weight."""
    z = g @ weight
    np.clip(z, -60, 60, out=z)
    own = z[np.arange(len(y)), y]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], dtype=z.dtype)
    return own - np.log(total), z, total


def _error(ez: np.ndarray, total: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Gradient by the logits of the mean of n losses."""
    ez *= (1 / (total * np.float32(n)))[:, None]
    ez[np.arange(len(y)), y] -= np.float32(1 / n)
    return ez


def heads(p: dict[str, np.ndarray], g: np.ndarray, y: np.ndarray, grad: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probabilities of classes y from activations g (positions x WIDTH + 1); with grad, also minus their gradient by g."""
    n = p["group"].shape[1]
    order = np.argsort((y // n).astype(np.int16), kind="stable")
    g, group, slot = g[order], y[order] // n, y[order] % n
    edge = np.searchsorted(group, np.arange(n + 1)).tolist()
    logp, ez, total = _softmax(g, p["group"], group)
    dg = None
    if grad is not None:
        d = parts(grad)
        ez = _error(ez, total, group, len(y))
        d["group"][:], dg = g.T @ ez, ez @ p["group"][:-1].T
    for k in range(n):
        own = slice(edge[k], edge[k + 1])
        if edge[k] < edge[k + 1]:
            more, ez, total = _softmax(g[own], p["slot"][k], slot[own])
            logp[own] += more
            if grad is not None:
                ez = _error(ez, total, slot[own], len(y))
                d["slot"][k] = g[own].T @ ez
                dg[own] += ez @ p["slot"][k, :-1].T
    out = np.empty_like(logp)
    out[order] = logp
    if dg is not None:
        back = np.empty_like(dg)
        back[order] = dg
        dg = back
    return out, dg


def windows(begin: np.ndarray, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first target's number, whether it is its text's first) of the windows of all texts, which overlap by context."""
    size = np.diff(begin)
    count = 1 + np.maximum(0, -(-(size - LENGTH) // (LENGTH - context)))
    text = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, begin[text] + k * (LENGTH - context), k == 0


def inputs(y: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The class before each target; before a text's first id it is END's."""
    x = np.zeros_like(y)
    x[1:] = y[:-1]
    x[begin[:-1]] = 0
    return x


def cut(last: np.ndarray, first: np.ndarray, opens: np.ndarray, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """(target numbers, whether a target counts) of windows; last: where their texts end."""
    target = first[:, None] + np.arange(LENGTH)
    counts = target < last[:, None]
    counts[:, :context] &= opens[:, None]
    return np.minimum(target, last[:, None] - 1, out=target), counts


def score_texts(flat: np.ndarray, ids: np.ndarray, begin: np.ndarray, classes: Classes, at_once: int = 128, blocks: int = 8) -> np.ndarray:
    """Natural log probability of each text; at_once windows go through the attention, blocks times as many to the outputs."""
    p = parts(flat)
    total = np.add.reduceat(classes.within[ids], begin[:-1], dtype=np.float64)
    y = classes.of[ids]
    x = inputs(y, begin)
    text, first, opens = windows(begin)
    last = begin[text + 1]
    for a in range(0, len(text), at_once * blocks):
        found, targets, rows = [], [], []
        for b in range(a, min(a + at_once * blocks, len(text)), at_once):
            own = slice(b, b + at_once)
            target, counts = cut(last[own], first[own], opens[own])
            found.append(forward(p, x[target])[-1][counts])
            targets.append(y[target[counts]])
            rows.append(np.repeat(text[own], counts.sum(axis=1)))
        logp, _ = heads(p, np.concatenate(found), np.concatenate(targets))
        total += np.bincount(np.concatenate(rows), weights=logp, minlength=len(total))
    return total


def learn(flat: np.ndarray, ids: np.ndarray, begin: np.ndarray, classes: Classes, rate: float, seed: int) -> np.ndarray:
    """Weights after Adam steps over all windows of these texts, each taken once, in random order.

    To learn from, windows don't overlap: all their ids are targets.
    """
    text, first, opens = windows(begin, 0)
    last, y = begin[text + 1], classes.of[ids]
    x = inputs(y, begin)
    order = np.random.default_rng(seed).permutation(len(text))
    batch = max(64, min(BATCH, len(order) // STEPS))
    steps = -(-len(order) // batch)
    flat = flat.copy()
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    p, grad = parts(flat), np.zeros_like(flat)
    for step in range(1, steps + 1):
        own = order[(step - 1) * batch : step * batch]
        target, counts = cut(last[own], first[own], opens[own], 0)
        grad[:] = 0
        kept = forward(p, x[target])
        _, below = heads(p, kept[-1][counts], y[target[counts]], grad)
        dg = np.zeros((*x[target].shape, WIDTH), dtype=np.float32)
        dg[counts] = below
        backward(p, kept, dg, grad)
        rate_now = np.float32(rate * (1 - 0.9 * step / steps))
        m *= np.float32(0.9)
        m += np.float32(0.1) * grad
        v *= np.float32(0.99)
        v += np.float32(0.01) * grad * grad
        flat -= rate_now * (m / np.float32(1 - 0.9**step)) / (np.sqrt(v / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return flat


def _count(docs: DataFrame, blocks: int, path: str) -> tuple[DataFrame, np.ndarray]:
    """((part, blob) of words by block with their counts to learn from, counts of ids)."""
    pack = shared.blobs(PAIR, blocks)

    def entries(parted: Iterator[pa.RecordBatch], want: str) -> Iterator:
        got = [b for b in parted if b.num_rows]
        table = pa.Table.from_batches(got) if got else None
        ids = np.zeros(IDS, dtype=np.int64)
        for block in np.unique(np.asarray(table.column("block"))) if got else ():
            own = table.filter(pa.array(np.asarray(table.column("block")) == block))
            w = Words(own.column("text"))
            learns = ~np.asarray(own.column("held").combine_chunks().cast(pa.int8())).astype(bool)
            count = np.bincount(w.number, weights=learns[w.row], minlength=len(w.hash)).astype(np.int64)
            rows = np.zeros(len(w.hash), dtype=PAIR)
            rows["word"], rows["block"], rows["count"] = w.hash, block, count
            flat, at = w.encoded(path)
            ids += np.bincount(flat, weights=np.repeat(count, np.diff(at)), minlength=IDS).astype(np.int64)
            ids[END] += int(learns.sum())
            yield w.hash % np.uint64(blocks), rows
        if want == "ids":
            yield ids

    def run(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(entries(parted, "ids"))
        yield from pack(iter(found[:-1]))
        ids = found[-1]
        yield pa.record_batch({"part": pa.array([-1], pa.int32()), "blob": pa.array([ids.tobytes()], pa.binary())})

    made = shared.materialize(docs.repartition(blocks, "block").mapInArrow(run, "part int, blob binary"))

    def add(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(IDS, dtype=np.int64)
        for b in parted:
            for x in b.column("blob"):
                total += np.frombuffer(x.as_py(), dtype=np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch({"i": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    table = made.filter("part = -1").select("blob").mapInArrow(add, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(IDS, dtype=np.int64)
    counts[np.asarray(table.column("i"))] = np.asarray(table.column("n"))
    return made.filter("part >= 0"), counts


def _totals(pairs: DataFrame, blocks: int) -> DataFrame:
    """(part, blob) by block: its words with their counts in all blocks; also rows with part -1: known words and tokens."""
    pack = shared.blobs(TOTAL, blocks)

    def total(key: tuple, table: pa.Table) -> pa.Table:
        e = shared.unpack(table, PAIR)
        word, number = np.unique(e["word"], return_inverse=True)
        count = np.bincount(number, weights=e["count"], minlength=len(word)).astype(np.int64)
        out = np.zeros(len(e), dtype=TOTAL)
        out["word"], out["count"] = e["word"], count[number]
        sums = np.array([(count > 0).sum(), count.sum()], dtype=np.int64)
        rest = list(pack(iter([(e["block"], out)])))
        return pa.Table.from_batches([*rest, pa.record_batch({"part": pa.array([-1], pa.int32()), "blob": pa.array([sums.tobytes()], pa.binary())})])

    return pairs.groupBy("part").applyInArrow(total, "part int, blob binary")


def train(docs: DataFrame, n_ids: int, classes: Classes, path: str) -> np.ndarray:
    """Weights learnt from all documents that aren't held out; docs: (id, text, held, block)."""
    context = docs.sparkSession.sparkContext
    flat = initial(classes)
    tables = context.broadcast(classes)
    tasks = max(1, -(-n_ids // IDS_A_TASK))
    for step in range(ROUNDS):
        sent = context.broadcast(flat)
        part = F.pmod(F.xxhash64("id", F.length("text"), F.lit(9)), F.lit(ROUNDS)) == step

        def run(parted: Iterator[pa.RecordBatch], sent=sent, step=step) -> Iterator[pa.RecordBatch]:
            texts = [b.column("text") for b in parted if b.num_rows]
            if texts:
                found = list(Words(pa.chunked_array(texts).combine_chunks()).sequences(path))
                ids, begin = np.concatenate([x[2] for x in found]), np.append(0, np.cumsum(np.concatenate([np.diff(x[3]) for x in found])))
                new = learn(sent.value, ids, begin, tables.value, 0.02 / (step + 1), step).astype("<f4")
                at = range(0, len(new), PIECE)
                yield pa.record_batch({"at": pa.array(at, pa.int32()), "weights": pa.array([new[a : a + PIECE].tobytes() for a in at], pa.binary())})

        kind = "at int, weights binary"
        table = docs.filter(~F.col("held") & part).select("text").repartition(tasks).mapInArrow(run, kind).groupBy("at").applyInArrow(_mean, kind).toArrow()
        if table.num_rows:
            flat = np.frombuffer(b"".join(table.sort_by("at").column("weights").to_pylist()), dtype="<f4").copy()
    return flat


def _mean(table: pa.Table) -> pa.Table:
    """The mean of a piece's weights over all tasks."""
    total, n = None, table.num_rows
    for x in table.column("weights"):
        w = np.frombuffer(x.as_py(), dtype="<f4").astype(np.float64)
        total = w if total is None else total + w
    return pa.table({"at": table.column("at").slice(0, 1), "weights": pa.array([(total / n).astype("<f4").tobytes()], pa.binary())})


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    blocks = shared.partitions(docs, 8)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), (remainder(key, 10) == 0).alias("held"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.length("text")), F.lit(blocks)).cast("int"))
    pairs, counts = _count(rows, blocks, path)
    found = shared.materialize(_totals(pairs, blocks))
    known = n_words = 0
    for x in found.filter("part = -1").select("blob").toLocalIterator():
        a, b = np.frombuffer(bytes(x.blob), dtype=np.int64)
        known, n_words = known + int(a), n_words + int(b)
    n_ends = int(counts[END])
    classes = Classes(counts, path)
    model = rows.sparkSession.sparkContext.broadcast((train(rows, int(counts.sum()), classes, path), classes))
    n, distinct = n_words + n_ends, known + (n_ends > 0)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        flat, own = model.value
        w = Words(left.column("text").combine_chunks())
        total = np.zeros(len(w.hash), dtype=np.int64)
        if right.num_rows:
            e = shared.unpack(right, TOTAL)
            at = np.minimum(np.searchsorted(w.hash, e["word"]), max(len(w.hash) - 1, 0))
            total[at] = e["count"]
        base = np.log10((total + 0.1) / (n + 0.1 * (distinct + 1)))
        end = np.log10((n_ends + 0.1) / (n + 0.1 * (distinct + 1)))
        size = np.bincount(w.row, minlength=w.n)
        score = [score_texts(flat, ids, begin, own) for _, _, ids, begin in w.sequences(path)]
        return pa.table({
            "doc_id": left.column("id"), "held_out": left.column("held"), "n_tokens": (size + 1).astype(np.int64),
            "n_known": (np.bincount(w.row, weights=total[w.number] > 0, minlength=w.n) + (n_ends > 0)).astype(np.int64),
            "train_tokens": np.full(w.n, n, dtype=np.int64),
            "base_score": np.bincount(w.row, weights=base[w.number], minlength=w.n) + end,
            "score": np.concatenate(score) / np.log(10),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    back = found.filter("part >= 0").withColumnRenamed("part", "block")
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, schema)
