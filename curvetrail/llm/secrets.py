"""Credential spans in texts: fixed patterns, and formats learnt from what they find.

One pass over the texts gives the spans of the base patterns. A bounded sample of distinct values that they labelled
(FIT_VALUES of each kind, FIT_CHARS characters) becomes a prefix tree for each kind; states whose outgoing frequencies agree within a
Hoeffding bound are merged (the red-blue order), which gives a probabilistic automaton of the format. A second pass
scores every candidate of every document by its mean log-likelihood a symbol under each automaton, and those at least
as likely as most labelled values (QUANTILE) become spans of kind "grammar". Candidates are all runs of token
characters outside base spans, from the least length of a labelled value on; a base span in a run splits it.

All matching is on UTF-8 bytes (the patterns are ASCII); spans are in code points. A null or empty text has no spans;
an empty table gives an empty result; repeated rows each give a row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curvetrail.llm.common import materialize, pieces

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_HEADS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Least lengths: the value of assign, all of access and hex, and a candidate, which is the least of these.
LEAST = {"assign": 8, "access": 16, "hex": 32, "candidate": 8}

#: Distinct labelled values of each kind that an automaton is fitted on, and their characters together, at most. Values are
#: taken whole, in the order of their hashes, whatever their length.
FIT_VALUES, FIT_CHARS = 400, 200_000
ALPHA, QUANTILE = 0.05, 0.1
#: Verdicts on candidates that a task remembers, and the longest candidate of these; words come again and again.
VERDICTS, VERDICT_LENGTH = 1 << 16, 256

_HEX, _TOKEN = np.zeros(256, bool), np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True

FOUND = "id long, found array<struct<kind:string,start:int,end:int,value:string>>"


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.append(edge, len(mask))
    start, end = edge[::2], edge[1::2]
    keep = end - start >= least
    return start[keep], end[keep]


def find_spans(texts: list[bytes], accept: Callable[[bytes], bool] | None = None) -> list[list[tuple[str, int, int, bytes]]]:
    """For each text: kind, start, end (code points) and value of base spans and of the candidates that accept takes."""
    data = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    found: list[list[tuple[str, int, int, int, int]]] = [[] for _ in texts]

    for a, b in zip(*_runs(_HEX[raw], LEAST["hex"])):
        found[np.searchsorted(starts, a, "right") - 1].append(("hex", a, b, a, b))
    at, last = data.find(b"AKIA"), 0
    while at >= 0:
        if at >= last and (m := ACCESS.match(data, at)):
            last = m.end()
            if last - at >= LEAST["access"]:
                found[np.searchsorted(starts, at, "right") - 1].append(("access", at, last, at, last))
        at = data.find(b"AKIA", at + 1)
    low, heads = data.lower(), []
    for head in ASSIGN_HEADS:
        at = low.find(head)
        while at >= 0:
            heads.append(at)
            at = low.find(head, at + 1)
    last = 0
    for at in sorted(heads):
        if at >= last and (m := ASSIGN.match(data, at)):
            last = m.end()
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                found[np.searchsorted(starts, at, "right") - 1].append(("assign", at, last, m.start(2), last))
    if accept:
        token = _TOKEN[raw]
        for _, x, y, _, _ in [span for own in found for span in own]:
            token[x:y] = False
        for x, y in zip(*(e.tolist() for e in _runs(token, LEAST["candidate"]))):
            if accept(data[x:y]):
                found[np.searchsorted(starts, x, "right") - 1].append(("candidate", x, y, x, y))
    out = []
    for i, spans in enumerate(found):
        if not spans:
            out.append([])
            continue
        chars = np.concatenate([[0], np.cumsum((raw[starts[i] : starts[i + 1]] & 0xC0) != 0x80)])
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0]) if s[0] in KINDS else 3))
        out.append([(k, int(chars[s - starts[i]]), int(chars[e - starts[i]]), data[v:w]) for k, s, e, v, w in spans])
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    for batch in pieces(batches):
        spans = find_spans([x.as_py() or b"" for x in batch.column(1)])
        rows = [[{"kind": k, "start": s, "end": e, "value": v.decode()} for k, s, e, v in x] for x in spans]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["id", "found"])


# ---------------------------------------------------------------- grammar inference


def symbols(value: str) -> list[str]:
    """A character of the first four as it is (prefixes matter), a later one as its class."""
    kind = lambda c: "d" if c.isdigit() else "h" if "a" <= c <= "f" else "l" if "g" <= c <= "z" else "u" if "A" <= c <= "Z" else c
    return [c if i < 4 and not ("0" <= c <= "9" or "a" <= c <= "f") else kind(c) for i, c in enumerate(value)]


class Automaton:
    """A prefix tree of labelled values whose compatible states are merged."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends, self.seen = [0], [0]
        for value in values:
            state = 0
            self.seen[0] += 1
            for s in symbols(value):
                if s not in self.next[state]:
                    self.next[state][s] = len(self.next)
                    for part, new in ((self.next, {}), (self.count, {}), (self.ends, 0), (self.seen, 0)):
                        part.append(new)
                self.count[state][s] = self.count[state].get(s, 0) + 1
                state = self.next[state][s]
                self.seen[state] += 1
            self.ends[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _near(self, f: int, n: int, g: int, m: int) -> bool:
        return not (n and m) or abs(f / n - g / m) <= self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen[a], self.seen[b]
            if not self._near(self.ends[a], n, self.ends[b], m):
                return False
            for s in self.count[a].keys() | self.count[b].keys():
                if not self._near(self.count[a].get(s, 0), n, self.count[b].get(s, 0), m):
                    return False
                if s in self.next[a] and s in self.next[b]:
                    todo.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """The tree below b goes into the states from a on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for s, n in self.count[b].items():
                self.count[a][s] = self.count[a].get(s, 0) + n
                if s in self.next[a]:
                    todo.append((self.next[a][s], self.next[b][s]))
                else:
                    self.next[a][s] = self.next[b][s]

    def _merge_all(self) -> None:
        red = [0]
        blue = [(0, s) for s in sorted(self.next[0])]
        while blue:
            parent, s = blue.pop(0)
            b = self.next[parent][s]
            if b in red:
                continue
            for r in red:
                if self._compatible(r, b):
                    self.next[parent][s] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
            blue = [(r, x) for r in red for x in sorted(self.next[r]) if self.next[r][x] not in red]
        self.states = len(red)

    def score(self, value: str) -> float:
        """Mean log2-likelihood of a symbol, the end counted; an unseen step costs 12 bits."""
        state, total, parts = 0, 0.0, symbols(value)
        for s in parts:
            if n := self.count[state].get(s, 0):
                total += math.log2(n / self.seen[state])
                state = self.next[state][s]
            else:
                total -= 12
        total += math.log2(self.ends[state] / self.seen[state]) if self.ends[state] else -12
        return total / (len(parts) + 1)


def fit_formats(spark: SparkSession, found: DataFrame, fit_values: int = FIT_VALUES, fit_chars: int = FIT_CHARS) -> dict[str, tuple[Automaton, float]]:
    """An automaton and the least accepted score for each base kind that has values."""
    values = found.select(F.explode("found").alias("f")).select("f.kind", "f.value")
    out = {}
    for kind in KINDS:
        of = values.where(F.col("kind") == kind).select("value").distinct()
        order = [F.xxhash64("value"), F.col("value")]
        taken = of.orderBy(*order).limit(fit_values)  # few rows: their characters are added up in one task
        taken = taken.withColumn("upto", F.sum(F.length("value")).over(W.orderBy(*order))).where(F.col("upto") <= fit_chars)
        sample = [r[0] for r in taken.select("value").collect()]
        if sample:
            model = Automaton(sample)
            scores = sorted(model.score(v) for v in sample)
            out[kind] = (model, scores[int(QUANTILE * len(scores))])
    return out


def _best(models: dict[str, tuple[Automaton, float]]) -> Callable[[bytes], tuple[float, str]]:
    """Of a candidate: the largest score over a format's threshold, and the format."""
    fits = lambda value: max(((m.score(value.decode()) - least, k) for k, (m, least) in models.items()), default=(-math.inf, ""))
    known = lru_cache(VERDICTS)(fits)
    return lambda value: known(value) if len(value) <= VERDICT_LENGTH else fits(value)


def _judge(models: dict[str, tuple[Automaton, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("format", pa.string())]))
        best = _best(models)
        for batch in pieces(batches):
            rows = []
            for found in find_spans([x.as_py() or b"" for x in batch.column(1)], lambda value: best(value)[0] >= 0):
                spans = []
                for k, start, end, value in found:
                    score, format = best(value) if k == "candidate" else (None, None)
                    spans.append({"kind": "grammar" if k == "candidate" else k, "start": start, "end": end, "score": score, "format": format})
                rows.append(spans)
            base = [[s for s in spans if s["kind"] in KINDS] for spans in rows]
            text = lambda spans: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
            count = lambda k: pa.array([sum(s["kind"] == k for s in x) for x in base], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, kind), *map(count, KINDS), pa.array([hashlib.sha256(text(x).encode()).hexdigest() for x in base]), pa.array([text(x) for x in rows])],
                names=["id", "found", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", fit_values: int = FIT_VALUES) -> DataFrame:
    """id, found (kind, start, end, score over the format's threshold, format), counts by base kind, digest and list of spans."""
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    models = fit_formats(spark, materialize(source.mapInArrow(_scan, FOUND).where("size(found) > 0"), "secrets"), fit_values)
    return source.mapInArrow(
        _judge(models),
        "id long, found array<struct<kind:string,start:int,end:int,score:double,format:string>>, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )


def mask(docs: DataFrame, put: str, text: str = "text", length: str = "n_chars", fit_values: int = FIT_VALUES) -> DataFrame:
    """docs with put in place of each found value, and length (where there is such a column) as it is then."""
    spark = docs.sparkSession
    found = materialize(docs.select(F.lit(0).cast("long"), F.col(text).cast("binary")).mapInArrow(_scan, FOUND).where("size(found) > 0"), "secrets")
    models = fit_formats(spark, found, fit_values)
    at, new = docs.columns.index(text), put.encode()

    def masked(data: bytes, spans: list[tuple[str, int, int, bytes]]) -> bytes:
        chars, out, last = data.decode("utf-8", "replace"), [], 0
        for _, _, end, value in spans:
            start = end - len(value)
            if start >= last:
                out += [chars[last:start].encode(), new]
            last = max(last, end)
        return b"".join([*out, chars[last:].encode()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _best(models)
        for batch in pieces(batches):
            kind = batch.schema.field(at).type
            texts = [None if x is None else x.encode() for x in batch.column(at).to_pylist()]
            spans = find_spans([t or b"" for t in texts], lambda value: best(value)[0] >= 0)
            rows = [t if not s else masked(t, s) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([pa.array([None if r is None else r.decode() for r in rows], kind) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(length, F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col(length)).cast(docs.schema[length].dataType)) if length in docs.columns else out
