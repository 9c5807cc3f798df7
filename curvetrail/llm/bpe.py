"""Byte-level BPE: texts to token ids and back, by the ranks of a vocabulary file, on DuckDB within each partition.

A text is split by the vocabulary's pattern; the pieces of a block that are not known yet become token-position rows of
single bytes, and one recursive query contracts them: every round joins neighbouring tokens with the merge table and
contracts each piece's leftmost pair of least rank, until no pair of any piece is in the table. Pieces never meet, so
documents need no shuffle. A second query joins ids with the vocabulary and aggregates the bytes in order.

Rows: a null text counts as empty and has no ids; rows that repeat an id or a text stay as they are; an empty table gives
an empty table; only the two named columns are read. A piece may be as long as its text (a text without white space): from
LONG bytes on, a round contracts all places of the least rank that the order of merges allows, which ends alike in far
fewer rounds. Ids that the vocabulary has not, and null ids, have no bytes: their row decodes to null.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvetrail.llm.common import pieces

#: Pieces of a longer text are taken in blocks of so many.
BLOCK_PIECES = 300_000
#: Bytes of unknown pieces that one query contracts; ids that one query decodes.
ROUND_BYTES, DECODE_IDS = 1 << 19, 1 << 18
#: Pieces whose ids a worker keeps. When there are more, it starts anew.
KNOWN_PIECES = 400_000
#: Bytes from which a piece is contracted at all allowed places of a round at once.
LONG = 48
#: Ids are packed into a pair as left * SHIFT + right.
SHIFT = 1 << 31

#: Neighbours that the merge table has. A piece ends with a free place, so the last token of a piece meets no other.
_PAIRS = """SELECT p.word, p.place, p.after AS second, q.after, m.merged, m.safe FROM bpe p
  JOIN bpe q ON q.place = p.after JOIN merges m ON m.pair = p.token::BIGINT * 2147483648 + q.token"""

#: Each piece's leftmost pair of least rank.
_LEFTMOST = f"""SELECT word, (least & 4294967295)::INT AS place, (least >> 32)::INT AS merged, (ends >> 32)::INT AS second, (ends & 4294967295)::INT AS after FROM (
  SELECT word, min(merged::BIGINT << 32 | place) AS least, arg_min(second::BIGINT << 32 | after, merged::BIGINT << 32 | place) AS ends FROM ({_PAIRS}) GROUP BY word)"""

#: Its pairs of least rank from left to right, each second one of those that overlap, if contracting one makes no pair of
#: lower rank; else the leftmost.
_ALL = f"""SELECT word, place, merged, second, after FROM (
  SELECT *, row_number() OVER chain AS nth, row_number() OVER piece AS spot FROM (
    SELECT *, sum(starts) OVER (PARTITION BY word ORDER BY place) AS island FROM (
      SELECT *, (lag(second) OVER (PARTITION BY word ORDER BY place) IS DISTINCT FROM place)::INT AS starts FROM (
        SELECT *, min(merged) OVER (PARTITION BY word) AS least FROM ({_PAIRS})) WHERE merged = least))
  WINDOW chain AS (PARTITION BY word, island ORDER BY place), piece AS (PARTITION BY word ORDER BY place))
  WHERE CASE WHEN safe THEN nth % 2 = 1 ELSE spot = 1 END"""

_CONTRACT = """WITH RECURSIVE bpe AS (
  SELECT word, place, place + 1 AS after, token, 0 AS round FROM bytes
  UNION ALL ({step})),
ended AS (SELECT word, max(round) AS round FROM bpe GROUP BY word)
SELECT word, token FROM bpe JOIN ended USING (word, round) ORDER BY place"""

#: A chosen pair's first place takes the merged token, its second place goes; pieces without a pair are left behind.
_CONTRACT_ONE = _CONTRACT.format(step=f"""
  SELECT t.word, t.place, CASE WHEN t.place = c.place THEN c.after ELSE t.after END, CASE WHEN t.place = c.place THEN c.merged ELSE t.token END, t.round + 1
  FROM bpe t JOIN ({_LEFTMOST}) c ON c.word = t.word WHERE t.place <> c.second""")
_CONTRACT_ALL = _CONTRACT.format(step=f"""WITH c AS MATERIALIZED ({_ALL})
  SELECT t.word, t.place, coalesce(c.after, t.after), coalesce(c.merged, t.token), t.round + 1
  FROM bpe t LEFT JOIN c ON c.place = t.place WHERE t.word IN (SELECT word FROM c) AND t.place NOT IN (SELECT second FROM c)""")

_DECODE = """SELECT part, unhex(string_agg(v.hex, '' ORDER BY i.place)) AS piece, count(*) = count(v.hex) AS known
FROM ids i LEFT JOIN vocabulary v ON v.token = i.token GROUP BY part ORDER BY part"""


def read_ranks(path: str) -> list[bytes | None]:
    """The tokens of a rank file (base64 token and rank in each line), by rank; ranks without a token are None. The file
    is read on the driver: what workers get of it is as large as the file."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    tokens: list[bytes | None] = [None] * (1 + max(int(r) for _, r in rows))
    for token, rank in rows:
        tokens[int(rank)] = base64.b64decode(token)
    lacking = [b for b in range(256) if bytes([b]) not in set(tokens)]
    if lacking:
        raise ValueError(f"no token for the bytes {lacking}")
    return tokens


def merge_table(tokens: list[bytes | None]) -> pa.Table:
    """All pairs of tokens that together are a token: pair, merged (its rank), safe (no pair that has the merged token in it
    has a lower rank)."""
    rank = {t: r for r, t in enumerate(tokens) if t is not None}
    rows = [(a, b, r) for t, r in rank.items() for k in range(1, len(t)) if (a := rank.get(t[:k])) is not None and (b := rank.get(t[k:])) is not None]
    left, right, merged = np.array(rows, np.int64).reshape(-1, 3).T
    least = np.full(len(tokens), len(tokens), np.int64)
    np.minimum.at(least, left, merged)
    np.minimum.at(least, right, merged)
    return pa.table({"pair": left * SHIFT + right, "merged": merged.astype(np.int32), "safe": least[merged] > merged})


class Coder:
    """A worker's DuckDB session with the merge table and the vocabulary, and the pieces that it knows."""

    def __init__(self, tokens: list[bytes | None]):
        import duckdb

        self.rank = {t: r for r, t in enumerate(tokens) if t is not None}
        self.bytes = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self.tokens, self.tables = tokens, set()

    def need(self, name: str) -> None:
        """Makes the merge table or the vocabulary when it is first needed: most workers only encode or only decode."""
        if name in self.tables:
            return
        if name == "merges":
            given = merge_table(self.tokens)
        else:
            given = pa.table({"token": pa.array(self.rank.values(), pa.int32()), "hex": pa.array([t.hex() for t in self.rank], pa.string())})
        self.query(f"CREATE TABLE {name} AS SELECT * FROM given", given=given)
        self.tables.add(name)

    def query(self, sql: str, **tables: pa.Table) -> pa.Table | None:
        for name, table in tables.items():
            self.db.register(name, table)
        try:
            out = self.db.sql(sql)
            return out.to_arrow_table() if out is not None else None
        finally:
            for name in tables:
                self.db.unregister(name)

    def contract(self, words: list[bytes], sql: str) -> list[bytes]:
        """The ids of each piece (32 bits each), none of them a token by itself."""
        self.need("merges")
        data, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        rows = pa.table({"word": word, "place": np.arange(len(data), dtype=np.int32) + word, "token": self.bytes[data]})
        out = self.query(sql, bytes=rows)
        word, token = out.column(0).to_numpy(), np.ascontiguousarray(out.column(1).to_numpy(), dtype=np.int32)
        ends = np.searchsorted(word, np.arange(len(words)), "right") * 4
        flat = token.tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def learn(self, words: list[str]) -> None:
        """Contracts pieces in blocks of about ROUND_BYTES; a piece that is a token needs no round."""
        rest: dict[bool, list[tuple[str, bytes]]] = {False: [], True: []}
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            if (own := self.rank.get(raw)) is not None:
                self.known[w] = own.to_bytes(4, "little")
            else:
                rest[len(raw) >= LONG].append((w, raw))
        for long, sql in ((False, _CONTRACT_ONE), (True, _CONTRACT_ALL)):
            some, size = [], 0
            for pair in rest[long] + [None]:
                if some and (pair is None or size + len(pair[1]) > ROUND_BYTES):
                    for (w, _), ids in zip(some, self.contract([r for _, r in some], sql)):
                        self.known[w] = ids
                    some, size = [], 0
                if pair is not None:
                    some.append(pair)
                    size += len(pair[1])

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """The ids (32 bits each) of each list of pieces, in turn."""
        new = set().union(*texts)
        if len(self.known) + len(new) > KNOWN_PIECES:
            self.known = {}
        self.learn(list(new.difference(self.known)))
        return [b"".join(map(self.known.__getitem__, t)) for t in texts]

    def decode(self, ids: np.ndarray, known: np.ndarray, part: np.ndarray, parts: int) -> tuple[list[bytes], list[bool]]:
        """The bytes of each part's ids in order, and whether the vocabulary has all of them."""
        self.need("vocabulary")
        out, whole = [b""] * parts, [True] * parts
        if len(ids):
            rows = pa.table({"part": part, "place": np.arange(len(ids), dtype=np.int32), "token": pa.array(ids, mask=~known)})
            got = self.query(_DECODE, ids=rows)
            for p, data, ok in zip(*(c.to_pylist() for c in got.columns)):
                out[p], whole[p] = data or b"", ok
        return out, whole


_CODERS: dict[int, tuple[list, Coder]] = {}


def coder(tokens: list[bytes | None]) -> Coder:
    """The worker's session for this vocabulary: made once, not for each task."""
    key = hash(tuple(tokens))
    if key not in _CODERS or _CODERS[key][0] != tokens:
        _CODERS.clear()
        _CODERS[key] = (tokens, Coder(tokens))
    return _CODERS[key][1]


def _split(pattern, text: str) -> Iterator[list[str]]:
    """The pieces of a text in blocks; what no alternative of the pattern matches is no piece."""
    if len(text) <= BLOCK_PIECES:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while some := list(itertools.islice(found, BLOCK_PIECES)):
        yield some


def encode(docs: DataFrame, tokens: list[bytes | None], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each row's whole text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, split = coder(tokens), regex.compile(pattern)
        for batch in pieces(batches):
            rows: list[bytes] = []
            some: list[list[str]] = []  # texts that are encoded together
            for text in batch.column(1).to_pylist():
                blocks = _split(split, text or "")
                first, second = next(blocks, []), next(blocks, None)
                some.append(first)
                if second is not None or sum(map(len, some)) > BLOCK_PIECES:
                    rows += own.encode(some)
                    some = []
                if second is not None:
                    rows[-1] = b"".join([rows[-1], *(own.encode([b])[0] for b in itertools.chain([second], blocks))])
            rows += own.encode(some)
            offsets = np.cumsum([0, *(len(row) // 4 for row in rows)])
            values = pa.array(np.frombuffer(b"".join(rows), np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=["id", "ids"])

    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def decode(coded: DataFrame, tokens: list[bytes | None]) -> DataFrame:
    """(id, ids) to (id, ids, decoded): the bytes of each row's ids in order. Null ids decode to null. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokens)
        for batch in batches:
            lists = batch.column(1)
            offsets, flat = np.asarray(lists.offsets, dtype=np.int64), lists.values
            known = np.asarray(pc.is_valid(flat))
            ids = np.asarray(pc.fill_null(flat, 0), dtype=np.int32)
            at = 0
            while at < batch.num_rows:  # rows of about DECODE_IDS together; a longer row by itself in blocks
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + DECODE_IDS, "right")) - 1)
                end = min(end, batch.num_rows)
                a, b = int(offsets[at]), int(offsets[end])
                if end == at + 1:
                    got = [own.decode(ids[x : min(b, x + DECODE_IDS)], known[x : min(b, x + DECODE_IDS)], np.zeros(min(b, x + DECODE_IDS) - x, np.int32), 1) for x in range(a, b, DECODE_IDS)]
                    out, whole = [b"".join(x[0] for x, _ in got)], [all(y[0] for _, y in got)]
                else:
                    part = np.repeat(np.arange(end - at, dtype=np.int32), np.diff(offsets[at : end + 1]))
                    out, whole = own.decode(ids[a:b], known[a:b], part, end - at)
                valid = np.asarray(lists.slice(at, end - at).is_valid())
                some = batch.slice(at, end - at)
                decoded = pa.array([x if ok and v else None for x, ok, v in zip(out, whole, valid)], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), decoded], names=["id", "ids", "decoded"])
                at = end

    kind = coded.schema["id"].dataType.simpleString()
    return coded.select("id", "ids").mapInArrow(run, f"id {kind}, ids array<int>, decoded binary")
