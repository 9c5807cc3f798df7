"""Toxicity of a text by subword vectors.

A word's vector is the mean of those of its character n-grams and of the whole word (hashed into BUCKETS), a bag of
WINDOW words is the mean of its words, and a linear softmax over two classes reads the bag. A label is of a whole
document while toxic words are few, so bags are windows, and a document's evidence is minus the log of the probability
that all its windows are clean: the sum of -log softmax(clean) over them, each less what an empty window has. A logistic of log(SOFTEN + that sum) is its score.

Vectors, softmax and logistic are trained together in numpy, from a random start, by mini-batches of documents with
per-row step sizes (Adagrad), until the loss of documents that are held back stops falling (at most EPOCHS passes). The
logistic is then fitted again on the documents held back, both labels with the same weight. Misspellings share n-grams
with the words they come from.

The sample to fit on is bounded (about FIT_DOCS documents of each label, chosen by a hash of the id, and FIT_CHARS
characters of texts; in that order); the model's size is fixed. n-grams of fewer than MIN_DOCS documents of the sample
keep the zero vector. A null or empty text has no window: its score is that of no evidence. With no labelled rows, or
only one label, all scores are 0. Rows that repeat an id count once in the fit if their texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvetrail.llm.common import char_grams, letters_only, materialize, pieces, sample_share, word_codes, word_hashes

FIT_DOCS, FIT_CHARS, WINDOW, BUCKETS, DIM = 1200, 12_000_000, 2, 1 << 18, 8
GRAM_SIZES = (3, 4, 5, 6)
MIN_DOCS, EPOCHS, BATCH, RATE, SOFT, DECAY, PATIENCE, CLOSE, SOFTEN = 3, 40, 128, 0.15, 2.5, 1e-6, 2, 0.002, 0.3


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and of the whole word, ordered by word, and the word that each is of."""
    buckets, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for at in range(0, len(words), 20_000):
        part = words.slice(at, 20_000)
        parts = [char_grams(part, n) for n in GRAM_SIZES] + [(word_hashes(part), np.arange(len(part)))]
        owner = np.concatenate([o for _, o in parts])
        order = np.argsort(owner, kind="stable")
        owners.append((owner[order] + at).astype(np.int32))
        buckets.append((np.concatenate([g for g, _ in parts]) % np.uint64(BUCKETS)).astype(np.int32)[order])
    return np.concatenate(buckets), np.concatenate(owners)


def _spread(begin: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places begin[i]..begin[i + 1] of each i in `of` in turn, and how many each has."""
    n = begin[of + 1] - begin[of]
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[of], n), n


def _documents_with(codes: np.ndarray, starts: np.ndarray, bucket: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """In how many documents each n-gram bucket occurs."""
    every = np.zeros(BUCKETS, np.int64)
    for a, b in zip(starts, starts[1:]):
        every[np.unique(bucket[_spread(begin, np.unique(codes[a:b]))[0]])] += 1
    return every


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def windows_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's window (every WINDOW words of a text), and where each text's windows begin."""
    size = np.diff(starts)
    first = np.concatenate([[0], np.cumsum(-(-size // WINDOW))])
    inside = np.arange(size.sum()) - np.repeat(starts[:-1] - starts[0], size)
    return np.repeat(first[:-1], size) + inside // WINDOW, first


def evidence(value: np.ndarray, starts: np.ndarray, bias: float) -> np.ndarray:
    """How much less likely all windows of a text are clean than as many empty ones (in log), from the values of its words
    in turn. A window of unknown words is like an empty one, so a long text in an unknown tongue has no evidence."""
    window, first = windows_of(starts)
    z = np.bincount(window, weights=value, minlength=first[-1]) / WINDOW + bias
    sums = np.concatenate([[0.0], np.cumsum(np.maximum(0, _softplus(z) - _softplus(bias)))])
    return sums[first[1:]] - sums[first[:-1]]


class Model:
    """weight: what each n-gram bucket adds to the difference of the two softmax inputs (its vector times the
    difference of the class vectors), which is all that scoring needs."""

    def __init__(self, weight: np.ndarray | None, bias: float = 0.0, scale: float = 1.0, shift: float = 0.0):
        self.weight, self.bias, self.scale, self.shift = weight, bias, scale, shift

    def word_values(self, words: pa.Array) -> np.ndarray:
        norm = pc.dictionary_encode(letters_only(words))
        distinct = norm.dictionary
        bucket, owner = _grams(distinct)
        n = np.maximum(np.bincount(owner, minlength=len(distinct)), 1)
        value = np.bincount(owner, weights=self.weight[bucket], minlength=len(distinct)) / n
        value[np.asarray(pc.equal(pc.binary_length(distinct), 0))] = 0
        return value[np.asarray(norm.indices, dtype=np.int64)]

    def predict(self, texts: pa.Array) -> np.ndarray:
        if self.weight is None:
            return np.zeros(len(texts))
        codes, words, starts = word_codes(texts)
        value = self.word_values(words)[codes] if len(codes) else np.zeros(0)
        return _sigmoid(self.scale * np.log(SOFTEN + evidence(value, starts, self.bias)) + self.shift)


class _Fit:
    """Parameters with Adagrad sums, over words whose n-grams are known."""

    def __init__(self, used: int, bucket: np.ndarray, begin: np.ndarray, share: np.ndarray, seed: int):
        self.rng = np.random.default_rng(seed)
        self.vectors = self.rng.normal(0, 0.05, (used, DIM)).astype(np.float32)
        self.soft = self.rng.normal(0, SOFT, DIM).astype(np.float32)  # of toxic less that of clean
        self.flat = np.array([-5.0, -2.0])  # bias of a window, shift of a document
        self.seen = [np.full(used, 1e-8, np.float32), np.full(DIM, 1e-8, np.float32), np.full(2, 1e-8)]
        self.bucket, self.begin, self.share = bucket, begin, share

    def forward(self, codes: np.ndarray, starts: np.ndarray):
        """Of the texts that these words are of: all that the gradient needs, and the input of the logistic."""
        words, place = np.unique(codes, return_inverse=True)
        spot, n = _spread(self.begin, words)
        rows, row = np.unique(self.bucket[spot], return_inverse=True)
        owner = np.repeat(np.arange(len(words)), n)
        pull = self.share[words]
        vec = np.stack([np.bincount(owner, weights=self.vectors[rows, k][row], minlength=len(words)) * pull for k in range(DIM)], 1)
        window, first = windows_of(starts)
        bag = np.stack([np.bincount(window, weights=vec[place, k], minlength=first[-1]) for k in range(DIM)], 1) / WINDOW
        z = bag @ self.soft + self.flat[0]
        sums = np.concatenate([[0.0], np.cumsum(_softplus(z))])
        own = sums[first[1:]] - sums[first[:-1]]
        return own, z, bag, window, first, place, owner, pull, rows, row, len(words)

    def step(self, codes: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        own, z, bag, window, first, place, owner, pull, rows, row, n_words = self.forward(codes, starts)
        g = (_sigmoid(own + self.flat[1]) - y) * weight
        gz = np.repeat(g, np.diff(first)) * _sigmoid(z)
        word = np.bincount(place, weights=gz[window], minlength=n_words) / WINDOW * pull
        along = np.bincount(row, weights=word[owner], minlength=len(rows))
        grad_soft = gz @ bag + DECAY * self.soft
        grad_vec = along[:, None] * self.soft[None, :] + DECAY * self.vectors[rows]
        self.seen[0][rows] += (grad_vec**2).mean(1)
        self.vectors[rows] -= (RATE * grad_vec / np.sqrt(self.seen[0][rows])[:, None]).astype(np.float32)
        grad_flat = np.array([gz.sum(), g.sum()])
        for value, grad, seen in ((self.soft, grad_soft, self.seen[1]), (self.flat, grad_flat, self.seen[2])):
            seen += grad**2
            value -= (RATE * grad / np.sqrt(seen)).astype(value.dtype)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Scale and shift of the best logistic of x, both labels with the same weight (Newton steps)."""
    mid, wide = x.mean(), max(x.std(), 1e-9)
    u, part = (x - mid) / wide, np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = _sigmoid(a * u + b)
        r, h = (p - y) * part, p * (1 - p) * part + 1e-9
        ga, gb = (r * u).sum() + 1e-4 * a, r.sum()
        haa, hab, hbb = (h * u * u).sum() + 1e-4, (h * u).sum(), h.sum()
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return a / wide, b - a * mid / wide


def train(texts: pa.Array, labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS, trace: list | None = None) -> Model:
    """labels: 0 or 1 for each text. trace takes the loss of the documents held back after each pass."""
    if not len(texts) or labels.min() == labels.max():
        return Model(None)
    codes, words, starts = word_codes(texts)
    if not len(words):
        return Model(None)
    norm = pc.dictionary_encode(letters_only(words))
    codes = np.asarray(norm.indices, dtype=np.int32)[codes]
    bucket, owner = _grams(norm.dictionary)
    n_words = len(norm.dictionary)
    del norm, words
    share = 1 / np.maximum(np.bincount(owner, minlength=n_words), 1)
    begin = np.searchsorted(owner, np.arange(n_words + 1))
    often = _documents_with(codes, starts, bucket, begin) >= MIN_DOCS
    used, renumber = np.flatnonzero(often), np.cumsum(often) - 1
    if not len(used):
        return Model(None)
    keep = often[bucket]
    begin = np.concatenate([[0], np.cumsum(keep)])[begin]
    fit = _Fit(len(used), renumber[bucket[keep]], begin, share, seed)
    order = fit.rng.permutation(len(labels))
    held = np.zeros(len(labels), bool)
    for y in (0, 1):  # every fifth of each label, one at least
        held[order[labels[order] == y][::5]] = True
    learn, back = np.flatnonzero(~held), np.flatnonzero(held)
    if len(np.unique(labels[learn])) < 2:
        learn = back
    weight = np.where(labels == 1, 1 / (labels[learn] == 1).mean(), 1 / (labels[learn] == 0).mean()) / 2

    def words_of(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spot, n = _spread(starts, docs)
        return codes[spot], np.concatenate([[0], np.cumsum(n)])

    def loss(docs: np.ndarray) -> float:
        own = np.concatenate([fit.forward(*words_of(docs[i : i + BATCH]))[0] for i in range(0, len(docs), BATCH)])
        z, y = own + fit.flat[1], labels[docs]
        return float(((_softplus(z) - y * z) * weight[docs]).mean())

    best, left = (np.inf,), PATIENCE
    for _ in range(epochs):
        fit.rng.shuffle(learn)
        for at in range(0, len(learn), BATCH):
            docs = learn[at : at + BATCH]
            fit.step(*words_of(docs), labels[docs], weight[docs] / len(docs))
        now = loss(back)
        if trace is not None:
            trace.append(now)
        if now < best[0] - CLOSE:
            best, left = (now, fit.vectors.copy(), fit.soft.copy(), float(fit.flat[0])), PATIENCE
        elif not (left := left - 1):
            break
    _, vectors, soft, bias = best
    table = np.zeros(BUCKETS)
    table[used] = vectors @ soft
    value = np.bincount(np.repeat(np.arange(n_words), np.diff(begin)), weights=table[used][fit.bucket], minlength=n_words) * share
    held_codes, held_starts = words_of(back)
    own = evidence(value[held_codes], held_starts, bias)
    return Model(table, bias, *map(float, logistic(np.log(SOFTEN + own), labels[back])))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> Model:
    """labels: key and a 0/1 label (nulls are passed over); both inputs hold only rows to learn from."""
    labels = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    sizes = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("label") == name, F.lit(min(1.0, fit_docs / n))).otherwise(share)
    # the limit proves the size that is broadcast; the share alone already gives about 2 * fit_docs
    unit = sample_share(F.col(key))
    sample = F.broadcast(labels.where(unit < share).orderBy(unit, key).limit(4 * fit_docs))
    drawn = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(sample, key).select(key, "label", "text").distinct()
    drawn = materialize(drawn.select(key, "label", "text", F.sha1("text").alias("digest")), "toxicity-sample")
    # what comes to the driver is bounded in rows and in characters: whole texts, in the order of the same hash
    sized = drawn.select(key, "digest", F.length("text").alias("n")).orderBy(unit, key, "digest").limit(4 * fit_docs).collect()
    total = np.cumsum([r["n"] for r in sized])
    chosen = [(r[0], r["digest"]) for r in sized[: max(1, int(np.searchsorted(total, fit_chars, "right")))]]
    if not chosen:
        return Model(None)
    chosen = docs.sparkSession.createDataFrame(chosen, drawn.select(key, "digest").schema)
    rows = sorted(tuple(r) for r in drawn.join(F.broadcast(chosen), [key, "digest"]).select(key, "digest", "label", "text").collect())
    labels_of = np.array([r[2] for r in rows], dtype=int)
    texts = pa.array([r[3] for r in rows], pa.string())
    del rows
    return train(texts, labels_of)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", extra: Column | None = None) -> DataFrame:
    """id, held_out (extra, carried along), score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.predict(batch.column(2)), pa.float64())], names=["id", "held_out", "score"])

    rows = docs.select(F.col(key).cast("long").alias("id"), (F.lit(False) if extra is None else extra).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, score double")


def keep_below(docs: DataFrame, model: Model, limit: float, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores under limit."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array(shared.value.predict(batch.column(at).cast(pa.string())) < limit))

    return docs.mapInArrow(run, docs.schema)
