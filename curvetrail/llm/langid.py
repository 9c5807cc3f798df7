"""Language of a text, word first.

Each word that the model knows adds its log frequency in each language. A word it does not know backs off to the
character n-grams of <word>, the longest of which any is known (5, 4, ... 1), at their mean log frequency. The language
with the largest sum wins; the score is its share of the likelihood at equal priors.

The model is fitted on a bounded sample: of the labelled documents of each language about FIT_DOCS, chosen by a hash of
their id, whole texts. All words of that sample are in it, those seen once too; the sample is its bound.
Texts without a letter (null and empty ones as well) are "und" with score 0; so is every text if nothing is labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvetrail.llm.common import char_grams, letters_only, pieces, sample_share, word_codes

FIT_DOCS, LONGEST = 1500, 5


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts by language within a batch."""
    for batch in pieces(batches):
        langs = batch.column(0).to_pylist()
        codes, words, starts = word_codes(batch.column(1))
        norm = pc.dictionary_encode(letters_only(words))
        small = np.asarray(norm.indices, dtype=np.int64)[codes] if len(codes) else codes
        names = sorted(set(langs))
        owner = np.repeat([names.index(x) for x in langs], np.diff(starts))
        if not len(small):
            continue
        cell, n = np.unique(owner * len(norm.dictionary) + small, return_counts=True)
        word = norm.dictionary.cast(pa.string()).take(pa.array(cell % len(norm.dictionary)))
        yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(cell // len(norm.dictionary))), word, pa.array(n, pa.int64())], names=["lang", "word", "n"])


class Model:
    def __init__(self, rows: list[tuple[str, str, int]]):
        self.langs = sorted({r[0] for r in rows})
        words = sorted({r[1] for r in rows})
        count = np.zeros((len(words), len(self.langs)))
        place, lang = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(self.langs)}
        for x, w, n in rows:
            count[place[w], lang[x]] += n
        self.words = pa.array(words, pa.string())
        self.scores = np.log((count + 0.1) / (count.sum(0) + 0.1 * max(1, len(words))))
        self.grams = {}
        for n in range(1, LONGEST + 1):
            grams, owner = char_grams(self.words, n)
            known, place = np.unique(grams, return_inverse=True)
            table = np.stack([np.bincount(place, weights=count[owner, i], minlength=len(known)) for i in range(len(self.langs))], axis=1) if len(known) else np.zeros((0, len(self.langs)))
            self.grams[n] = known, np.log((table + 0.1) / (table.sum(0) + 0.1 * max(1, len(known))))

    def word_scores(self, words: pa.Array) -> np.ndarray:
        """Log frequency of each word in each language, backed off where it is unknown."""
        out = np.zeros((len(words), len(self.langs)))
        at = pc.index_in(words.cast(pa.string()), value_set=self.words)
        known = np.asarray(at.is_valid())
        out[known] = self.scores[np.asarray(at.drop_null(), dtype=np.int64)]
        left = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            grams, owner = char_grams(words.take(pa.array(left)), n)
            table, logs = self.grams[n]
            if not len(table) or not len(grams):
                continue
            spot = np.minimum(np.searchsorted(table, grams), len(table) - 1)
            hit = table[spot] == grams
            owner, spot = owner[hit], spot[hit]
            hits = np.bincount(owner, minlength=len(left))
            for i in range(len(self.langs)):
                total = np.bincount(owner, weights=logs[spot, i], minlength=len(left))
                out[left, i] = np.where(hits > 0, total / np.maximum(hits, 1), 0)
            left = left[hits == 0]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        codes, words, starts = word_codes(texts)
        norm = letters_only(words)
        has = np.asarray(pc.greater(pc.binary_length(norm), 0)) if len(words) else np.zeros(0, bool)
        n = len(starts) - 1
        if not self.langs or not len(codes):
            return ["und"] * n, np.zeros(n)
        coded = pc.dictionary_encode(norm)
        scores = self.word_scores(coded.dictionary)[np.asarray(coded.indices, dtype=np.int64)] * has[:, None]
        cut = lambda x: np.concatenate([[0], np.cumsum(x)])[starts]
        sums = np.stack([np.diff(cut(scores[codes, i])) for i in range(len(self.langs))], axis=1)
        some = np.diff(cut(has[codes])) > 0
        best = sums.argmax(1)
        share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        return [self.langs[b] if s else "und" for b, s in zip(best, some)], np.where(some, share, 0.0)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_docs: int = FIT_DOCS) -> Model:
    """labelled: rows to learn from; those with a null label are passed over."""
    labelled = labelled.where(F.col(lang).isNotNull())
    sizes = labelled.groupBy(lang).count().collect()
    if not sizes:
        return Model([])
    share = F.lit(0.0)
    for name, n in sizes:
        share = F.when(F.col(lang) == name, F.lit(min(1.0, fit_docs / n))).otherwise(share)
    sample = labelled.where(sample_share(F.col(key)) < share).select(F.col(lang).cast("string"), F.col(text).cast("string"))
    counts = sample.mapInArrow(_count, "lang string, word string, n long").where("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return Model(list(zip(*(c.to_pylist() for c in counts.toArrow().columns))))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", extra: Column | None = None) -> DataFrame:
    """id, lang_pred, score; extra: a boolean column that is carried along as held_out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names, score = shared.value.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(key).cast("long").alias("id"), (F.lit(False) if extra is None else extra).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double")
