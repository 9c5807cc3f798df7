"""Folders of pictures as a table: spark.read.format("clips").load(root), or readStream for folders that keep coming.

A clip is a folder below root; its frames are its picture files, in order of the number at the end of their names (files
without one follow, by name). Clips are the partitions, so they are listed and read in parallel, and a filter on video_id
leaves the others unlisted. Options: labels (a file of lines `name total first last ...`; a frame in an interval has label
1, of a listed clip others have 0, of an unlisted clip null); marker (a file name: only clips that have it are complete
and count). As a stream, clips come in the order of their names, so names have to grow (a time stamp, a number).

Frames: video_id string, frame_id long, pos long, path string, label int. Paths may be in any file system that pyarrow knows.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from curvetrail.sources.text import PICTURES

SCHEMA = "video_id string, frame_id long, pos long, path string, label int"


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(quote(path, safe=":/?&=%@+,;~"))
    return fs.LocalFileSystem(), path


def _listed(path: str) -> list:
    from pyarrow import fs

    system, folder = _open(path)
    return system.get_file_info(fs.FileSelector(folder, allow_not_found=True))


def clips_of(root: str, marker: str | None = None) -> list[str]:
    """The names of the clips below root, in order."""
    from pyarrow import fs

    names = sorted(f.base_name for f in _listed(root) if f.type == fs.FileType.Directory)
    return [n for n in names if not marker or any(f.base_name == marker for f in _listed(posixpath.join(root, n)))]


def frames_of(paths: list[str]) -> list[tuple[int, int, str]]:
    """(frame_id, pos, path) of a clip's pictures. frame_id is the number in the name if all have one and they differ."""
    rows = []
    for path in paths:
        stem, dot, ending = posixpath.basename(path).rpartition(".")
        if dot and ending.lower() in PICTURES:
            number = re.search(r"([0-9]+)$", stem)
            rows.append((number is None, int(number[1]) if number else 0, "" if number else stem, posixpath.basename(path), path))
    rows.sort()
    own = {r[1] for r in rows if not r[0]}
    numbered = len(own) == len(rows)
    return [(r[1] if numbered else i, i, r[4]) for i, r in enumerate(rows)]


def labels_of(path: str | None) -> dict[str, list[tuple[int, int]]]:
    """Intervals by name; lines that are no labels are passed over, of a name's lines the last counts, negative intervals
    label nothing. A label file has a line a clip, so it is read as a whole."""
    if not path:
        return {}
    system, file = _open(path)
    with system.open_input_stream(file) as f:
        lines = f.read().decode("utf-8", "replace").splitlines()
    out = {}
    for line in lines:
        words = line.split()
        if len(words) >= 2 and len(words) % 2 == 0 and not line.startswith("#") and all(re.fullmatch(r"[+-]?[0-9]+", w) for w in words[1:]):
            n = [int(w) for w in words[2:]]
            out[words[0]] = [(min(a, b), max(a, b)) for a, b in zip(n[::2], n[1::2]) if a >= 0 and b >= 0]
    return out


class Clip(InputPartition):
    def __init__(self, name: str, spans: list[tuple[int, int]] | None):
        super().__init__(name)
        self.name, self.spans = name, spans


class _Reading:
    def __init__(self, options):
        self.root, self.marker = options["path"], options.get("marker")
        self.labels = options.get("labels")

    def clips(self, names: list[str]) -> list[Clip]:
        labels = labels_of(self.labels)
        return [Clip(n, labels.get(n)) for n in names]

    def rows(self, clip: Clip) -> Iterator[tuple]:
        folder = posixpath.join(self.root, clip.name)
        for frame, pos, path in frames_of([posixpath.join(folder, f.base_name) for f in _listed(folder)]):
            label = None if clip.spans is None else int(any(a <= frame <= b for a, b in clip.spans))
            yield clip.name, frame, pos, path, label


class ClipReader(_Reading, DataSourceReader):
    wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Names of clips are taken here; all else is left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("video_id",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f

    def partitions(self) -> list[Clip]:
        return self.clips([n for n in clips_of(self.root, self.marker) if self.wanted is None or n in self.wanted])

    def read(self, partition: Clip) -> Iterator[tuple]:
        if isinstance(partition, Clip):  # an empty root has one partition without a clip
            yield from self.rows(partition)


class ClipStream(_Reading, DataSourceStreamReader):
    """The offset is the name of the last clip that was read."""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(clips_of(self.root, self.marker), default="")}

    def partitions(self, start: dict, end: dict) -> list[Clip]:
        return self.clips([n for n in clips_of(self.root, self.marker) if start["after"] < n <= end["after"]])

    def read(self, partition: Clip) -> Iterator[tuple]:
        if isinstance(partition, Clip):
            yield from self.rows(partition)


class Clips(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clips"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ClipReader:
        return ClipReader(self.options)

    def streamReader(self, schema) -> ClipStream:
        return ClipStream(self.options)


def register(spark) -> None:
    """Makes the format known to the session. Filters are pushed down where the session allows it for Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Clips)
