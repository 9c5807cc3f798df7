"""Baseline JPEG in numpy: payloads stored as luminance blocks, and the reader for such and other baseline images.

store_bytes() lays each byte as one 8x8 block of even grey: the quantized DC coefficient is a level from -128 to 127 with
a DC step of 8, so the DC-only thumbnail of the image has one 8-bit sample (level + 128) for each byte. The bytes of an
image take levels by how often they are in it (0, 1, -1, 2 ...), which keeps the coded differences short; a comment
segment lists them in that order, as a palette does, so the payload comes back exactly. Rows are 64 blocks wide, a restart
marker ends every INTERVAL blocks; a payload over FRAME_ROWS rows is cut into several images.

read_images() parses markers, Huffman-decodes the scan of one or three components at any sampling, and keeps the DC
coefficients of the luminance. All restart intervals of a batch are decoded in step, a symbol each at a time, so numpy
works on long arrays. AC coefficients are decoded and passed over.

Null payloads count as empty; an empty payload is 64 zero bytes. Equal payloads give equal files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvetrail.llm.common import pieces

WIDE = 64
INTERVAL = 4 * WIDE
FRAME_ROWS = 8000  # a side has 65,535 samples at most: 8,191 blocks
#: Bytes that are coded or decoded at a time in a worker (an image of FRAME_ROWS rows at most where that is more), so a
#: text of any length costs a few times its own size and a constant.
GROUP_BYTES = 1 << 20
#: Options for a Parquet table of files: a task holds one row group of them.
SMALL_GROUPS = {"parquet.block.size": 16 << 20, "parquet.enable.dictionary": "false", "compression": "zstd"}

# Code lengths for the DC categories 0..8 of ranked bytes and the sole AC symbol (end of block), chosen freely.
DC_SYMBOLS = [2, 3, 1, 4, 5, 0, 6, 7, 8]
DC_LENGTHS = [2, 2, 3, 3, 3, 4, 5, 6, 7]
EOB_LENGTH = 1
#: What the comment segment with the ranked bytes begins with.
RANKED = b"ranked\x00"
#: The sample of each rank: level 0, 1, -1, 2, -2 ... 127, -127, -128, plus 128.
SAMPLE_OF_RANK = np.array([128 + ((r + 1) // 2 if r % 2 else -(r // 2)) for r in range(255)] + [0], np.uint8)


def canonical(symbols: list[int], lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Huffman codes as the standard assigns them: in order of length."""
    code, last, out = 0, 0, {}
    for s, n in zip(symbols, lengths):
        code <<= n - last
        out[s] = (code, n)
        code, last = code + 1, n
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def ranked_bytes(data: np.ndarray) -> np.ndarray:
    """The byte values of data, the most frequent first, ties by value."""
    counts = np.bincount(data, minlength=256)
    return np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype(np.uint8)


def _header(rows: int, ranked: bytes) -> bytes:
    table = lambda kind, symbols, lengths: bytes([kind]) + bytes(lengths.count(n) for n in range(1, 17)) + bytes(symbols)
    return (
        b"\xff\xd8"
        + _segment(0xFE, RANKED + ranked)
        + _segment(0xDB, b"\x00" + bytes([8] + [1] * 63))
        + _segment(0xC0, b"\x08" + (8 * rows).to_bytes(2, "big") + (8 * WIDE).to_bytes(2, "big") + b"\x01\x01\x11\x00")
        + _segment(0xC4, table(0x00, DC_SYMBOLS, DC_LENGTHS))
        + _segment(0xC4, table(0x10, [0], [EOB_LENGTH]))
        + _segment(0xDD, INTERVAL.to_bytes(2, "big"))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def _code_of_diff() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference -255..255 (at 255 + difference): all bits of the block, and how many."""
    codes = canonical(DC_SYMBOLS, DC_LENGTHS)
    value, size = np.zeros(511, np.uint32), np.zeros(511, np.uint8)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, length = codes[n]
        extra = d if d >= 0 else d + (1 << n) - 1
        value[d + 255] = ((code << n) | extra) << EOB_LENGTH  # end of block: one zero bit
        size[d + 255] = length + n + EOB_LENGTH
    return value, size


_VALUE, _SIZE = _code_of_diff()


def encode_rows(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples, uint8 [n, INTERVAL], of which a row has its count, to the entropy-coded bytes of each row, one row after
    another, stuffed; and each row's bytes."""
    level = rows.astype(np.int16) - 128
    diff = np.diff(level, axis=1, prepend=np.int16(0)) + 255
    value, size = _VALUE[diff], _SIZE[diff].astype(np.int64)
    if (counts < rows.shape[1]).any():
        beyond = np.arange(rows.shape[1]) >= counts[:, None]
        value[beyond] = size[beyond] = 0
    bits = size.sum(axis=1)
    row_bytes = (bits + 7) // 8
    base = np.concatenate([[0], np.cumsum(row_bytes)])
    start = np.cumsum(size, axis=1) - size + base[:-1, None] * 8
    total = int(base[-1])
    # each block has at most 16 bits: it lies within 3 bytes
    out = np.zeros(total + 3, np.int64)
    first = start >> 3
    word = value.astype(np.int64) << (24 - size - (start & 7))
    for k in range(3):
        # no two blocks share a bit, so a sum is an or
        out += np.bincount((first + k).ravel(), weights=((word >> (16 - 8 * k)) & 255).ravel(), minlength=total + 3).astype(np.int64)[: total + 3]
    pad = (row_bytes * 8 - bits).astype(np.int64)
    out[base[1:] - 1] |= (1 << pad) - 1
    flat = out[:total].astype(np.uint8)
    full = flat == 0xFF
    if full.any():
        at = np.flatnonzero(full)
        flat = np.insert(flat, at + 1, 0)
        row_bytes = row_bytes + np.add.reduceat(full.astype(np.int64), base[:-1])
    return flat, row_bytes


def store_bytes(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as one image, or several in a row."""
    if not payloads:
        return []
    # short payloads are coded together, a long one image by image
    frames = [(t, p[at : at + FRAME_ROWS * WIDE]) for t, p in enumerate(payloads) for at in range(0, len(p), FRAME_ROWS * WIDE)]
    out: list[list[bytes]] = [[] for _ in payloads]
    at = 0
    while at < len(frames):
        end, size = at, 0
        while end < len(frames) and (end == at or size + len(frames[end][1]) <= GROUP_BYTES):
            size += len(frames[end][1])
            end += 1
        lanes = [-(-len(f) // INTERVAL) for _, f in frames[at:end]]
        rows, counts, heads, r = np.zeros((sum(lanes), INTERVAL), np.uint8), np.full(sum(lanes), INTERVAL), [], 0
        for (_, frame), n in zip(frames[at:end], lanes):
            raw, sample = np.frombuffer(frame, np.uint8), np.zeros(256, np.uint8)
            ranked = ranked_bytes(raw)
            sample[ranked] = SAMPLE_OF_RANK[: len(ranked)]
            rows[r : r + n].reshape(-1)[: len(raw)] = sample[raw]
            counts[r + n - 1] = len(raw) - (n - 1) * INTERVAL
            heads.append(_header(len(raw) // WIDE, ranked.tobytes()))
            r += n
        data, sizes = encode_rows(rows, counts)
        data, ends, r = data.tobytes(), np.concatenate([[0], np.cumsum(sizes)]).tolist(), 0
        for (t, _), n, head in zip(frames[at:end], lanes, heads):
            parts = out[t]
            parts.append(head)
            for i in range(n):
                parts.append(data[ends[r + i] : ends[r + i + 1]])
                parts.append(bytes((0xFF, 0xD0 + i % 8 if i < n - 1 else 0xD9)))
            r += n
        at = end
    return [b"".join(parts) for parts in out]


class Image:
    """What the markers of one image say; scan is its entropy-coded part."""

    __slots__ = ("components", "dc", "ac", "height", "order", "quant", "ranked", "restart", "scan", "width")

    def pixels(self, samples: np.ndarray) -> np.ndarray:
        """The bytes that samples stand for: the samples themselves where no ranked bytes are given."""
        if self.ranked is None:
            return samples
        table = np.zeros(256, np.uint8)
        table[SAMPLE_OF_RANK[: len(self.ranked)]] = np.frombuffer(self.ranked, np.uint8)
        return table[samples]


def parse_images(data: bytes) -> list[Image]:
    """The images of a file: markers up to the scan, then the scan up to the end marker."""
    out, at = [], 0
    while at + 2 <= len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError(f"no image at byte {at}")
        at += 2
        im, quant, tables = Image(), {}, {}
        im.restart, im.ranked = 0, None
        while True:
            if data[at] != 0xFF:
                raise ValueError(f"no marker at byte {at}")
            kind, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")  # the DC step
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC0 or kind == 0xC1:
                im.height, im.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                im.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif kind == 0xC4:
                while body:
                    count = sum(body[1:17])
                    lengths = tuple(n + 1 for n in range(16) for _ in range(body[1 + n]))
                    tables[body[0]] = (tuple(body[17 : 17 + count]), lengths)
                    body = body[17 + count :]
            elif kind == 0xFE and body.startswith(RANKED):
                im.ranked = body[len(RANKED) :]
            elif kind == 0xDD:
                im.restart = int.from_bytes(body[:2], "big")
            elif kind == 0xDA:
                names = [body[1 + 2 * i] for i in range(body[0])]
                use = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                im.components = [c for name in names for c in im.components if c[0] == name]
                im.dc = [tables[use[c[0]] >> 4] for c in im.components]
                im.ac = [tables[0x10 | use[c[0]] & 15] for c in im.components]
                im.quant = [quant[c[3]] for c in im.components]
                break
        end = at
        while True:  # the scan ends at a marker that is neither a stuffed byte nor a restart
            end = data.index(b"\xff", end)
            if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                end += 2
                continue
            break
        im.scan = data[at:end]
        if data[end + 1] != 0xD9:
            raise ValueError("more than one scan")
        at = end + 2
        # the blocks of a unit: which component each belongs to
        single = len(im.components) == 1
        im.order = [i for i, c in enumerate(im.components) for _ in range(1 if single else c[1] * c[2])]
        out.append(im)
    return out


_PEEK: dict[tuple, np.ndarray] = {}


def _peek(table: tuple) -> np.ndarray:
    """For the next 16 bits: symbol + 256 * code length (0: no code)."""
    if table not in _PEEK:
        out = np.zeros(1 << 16, np.int32)
        for s, (code, n) in canonical(list(table[0]), list(table[1])).items():
            out[code << (16 - n) : (code + 1) << (16 - n)] = s + 256 * n
        _PEEK[table] = out
    return _PEEK[table]


def _decode_lanes(words: np.ndarray, bit: np.ndarray, blocks: np.ndarray, order: list[int], dc: list, ac: list) -> np.ndarray:
    """Decodes lanes in step. words: 8 bytes from each byte on, as big-endian numbers; bit: where each lane begins;
    blocks: how many blocks it has. Gives the DC levels [lane, block]."""
    n, most = len(bit), int(blocks.max(initial=0))
    longest = np.argsort(-blocks, kind="stable")  # the lanes that still have blocks come first
    left = np.searchsorted(-blocks[longest], -np.arange(most), "left")
    out = np.zeros((most, n), np.int16)
    pred = [np.zeros(n, np.int64) for _ in dc]
    bit = bit[longest]
    u = np.uint64
    for b in range(most):
        c = order[b % len(order)]
        live = int(left[b])
        at = bit[:live]
        w = words[at >> 3] << (at & 7).astype(u)
        hit = _peek(dc[c])[(w >> u(48)).astype(np.int64)]
        size, length = (hit & 15).astype(np.int64), (hit >> 8).astype(np.int64)
        if not length.all():
            raise ValueError("a code that is in no table")
        v = ((w << length.astype(u)) >> u(1) >> (63 - size).astype(u)).astype(np.int64)
        low = v < (1 << size >> 1)
        v = v - low * ((1 << size) - 1)
        pred[c][:live] += v
        out[b, :live] = pred[c][:live]
        used = length + size
        # AC: the usual case is that the block ends at once
        hit = _peek(ac[c])[((w << used.astype(u)) >> u(48)).astype(np.int64)]
        at = at + used
        at += hit >> 8
        more = np.flatnonzero((hit & 255) != 0)
        if len(more):
            k = np.zeros(len(more), np.int64)
            here, sym = at[more], (hit & 255).astype(np.int64)[more]
            open_ = np.arange(len(more))
            while len(open_):
                here[open_] += sym[open_] & 15
                k[open_] += (sym[open_] >> 4) + 1
                open_ = open_[k[open_] < 63]
                if not len(open_):
                    break
                x = words[here[open_] >> 3] << (here[open_] & 7).astype(u)
                hit = _peek(ac[c])[(x >> u(48)).astype(np.int64)]
                here[open_] += hit >> 8
                sym[open_] = hit & 255
                open_ = open_[sym[open_] != 0]
            at[more] = here
        bit[:live] = at
    back = np.empty((n, most), np.int16)
    back[longest] = out.T
    return back


def _groups(images: list[tuple[int, Image]], members: list[int]) -> Iterator[list[int]]:
    """Members in turn, about GROUP_BYTES of scans at a time."""
    group, size = [], 0
    for i in members:
        if group and size + len(images[i][1].scan) > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(images[i][1].scan)
    if group:
        yield group


def read_images(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """Width, height and DC-only luminance thumbnail (uint8, one sample a block) of each image of each file."""
    images = [(f, im) for f, data in enumerate(files) for im in parse_images(data)]
    out: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in files]
    kinds: dict[tuple, list[int]] = {}
    for i, (_, im) in enumerate(images):
        kinds.setdefault((tuple(im.order), tuple(im.dc), tuple(im.ac)), []).append(i)
    thumbs: dict[int, np.ndarray] = {}
    for (order, dc, ac), members in ((kind, group) for kind, every in kinds.items() for group in _groups(images, every)):
        raw = np.frombuffer(b"\xff\xd0".join(images[i][1].scan for i in members) + b"\xff\xd0" + bytes(8), np.uint8)
        lead = np.flatnonzero(raw[:-1] == 0xFF)
        follow = raw[lead + 1]
        marks = lead[(follow >= 0xD0) & (follow <= 0xD7)]
        keep = np.ones(len(raw), bool)
        keep[lead[follow == 0] + 1] = False
        keep[marks] = keep[marks + 1] = False
        clean = raw[keep]
        ends = marks - np.searchsorted(lead[follow == 0], marks) - 2 * np.arange(len(marks))  # where each interval ends in clean
        begin = np.concatenate([[0], ends[:-1]])
        clean = np.concatenate([clean, np.zeros(8, np.uint8)])
        words = np.zeros(len(clean) - 7, np.uint64)
        for k in range(8):
            words = (words << np.uint64(8)) | clean[k : len(clean) - 7 + k]
        units, plan = [], []
        for i in members:
            im = images[i][1]
            single = len(im.components) == 1
            hs, vs = (1, 1) if single else (max(c[1] for c in im.components), max(c[2] for c in im.components))
            across, down = -(-im.width // (8 * hs)), -(-im.height // (8 * vs))
            total, step = across * down, im.restart or across * down
            units += [min(step, total - a) for a in range(0, total, step)]
            plan.append((i, across, down, -(-total // step)))
        levels = _decode_lanes(words, begin * 8, np.array(units) * len(order), list(order), list(dc), list(ac))
        lane = 0
        for i, across, down, count in plan:
            im = images[i][1]
            part = [levels[lane + j, : units[lane + j] * len(order)] for j in range(count)]
            flat = np.concatenate(part).reshape(across * down, len(order))
            lane += count
            h, v = (1, 1) if len(im.components) == 1 else im.components[0][1:3]
            grid = flat[:, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            grid = grid[: -(-im.height // 8), : -(-im.width // 8)]
            # a block's mean is its DC coefficient over 8, rounded half up
            thumbs[i] = im.pixels(np.clip((grid.astype(np.int64) * im.quant[0] + 4 >> 3) + 128, 0, 255).astype(np.uint8))
    for i, (f, im) in enumerate(images):
        out[f].append((im.width, im.height, thumbs[i]))
    return out


def thumb_hash(thumb: np.ndarray) -> str:
    """64-bit difference hash: cell means of an 8 x 9 grid, each compared with the next in its row."""
    rows = np.arange(9) * thumb.shape[0] // 8
    cols = np.arange(10) * thumb.shape[1] // 9
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    sums[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    r0, r1, c0, c1 = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1), cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    r0, c0 = np.minimum(r0, thumb.shape[0] - 1), np.minimum(c0, thumb.shape[1] - 1)
    r1, c1 = np.minimum(r1, thumb.shape[0]), np.minimum(c1, thumb.shape[1])
    cell = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    mean = cell / ((r1 - r0)[:, None] * (c1 - c0)[None, :])
    bits = (mean[:, 1:] > mean[:, :-1]).ravel()
    return np.packbits(bits).tobytes().hex()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts = [x.as_py() or b"" for x in batch.column(1)]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP_BYTES):
                size += len(texts[end])
                end += 1
            files = store_bytes([x + bytes(-len(x) % WIDE or (0 if x else WIDE)) for x in texts[at:end]])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array([len(x) for x in texts[at:end]], pa.int64()), pa.array(files, pa.binary())], names=["id", "n_bytes", "media"])
            at = end


def store_media(docs: DataFrame, key: str = "doc_id", payload: str = "text") -> DataFrame:
    """id, n_bytes (before padding) and media: the JPEG file of each row's payload in UTF-8."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(payload).cast("binary").alias("payload"))
    return rows.mapInArrow(_store, "id long, n_bytes long, media binary")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "thumb_hash", "frames"]
    for batch in pieces(batches):
        files = [x.as_py() for x in batch.column(2)]
        at = 0
        while at < len(files):
            end, size = at, 0
            while end < len(files) and (end == at or size + len(files[end]) <= 2 * GROUP_BYTES):
                size += len(files[end])
                end += 1
            rows = []
            for data, images in zip(files[at:end], read_images(files[at:end])):
                payload = b"".join(t.tobytes() for _, _, t in images)
                prints = ",".join(thumb_hash(t) for _, _, t in images)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), images[0][0], sum(x[1] for x in images), prints, len(images)))
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)
            at = end


def media_features(media: DataFrame) -> DataFrame:
    """Reads id, n_bytes, media: sizes and digests of the thumbnail samples and the file, dimensions, thumbnail hashes."""
    return media.mapInArrow(
        _features,
        "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width long, height long, thumb_hash string, frames long",
    )
