"""Packing by non-negative least squares.

A worker tokenises each document and cuts it into full windows and one rest.  Only the histogram of piece lengths (as
many numbers as a window has tokens) reaches the driver, whatever the corpus holds.  There the combinations of two
or three lengths that fill a window exactly are the columns of a system whose rows are the lengths, all of them; non-negative
least squares, solved until no repeat count would move by more than a tolerance, gives each column a repeat count, which is
rounded down.  What is left is packed greedily, largest first, again as patterns with repeat counts.

Pieces then take their places: a piece's rank among those of its length (rank within a hash bucket plus the count in
the buckets before; there are as many buckets as pieces ask for, so no length gathers in one task) picks the pattern, the sequence and the offset.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import ChainMap, Counter
from collections.abc import Iterable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import Table, durable
from tidelog.llm.pieces import slices

WINDOW, END_ID = 2048, 1
#: Pieces of one length are ranked in buckets of about so many.
BUCKET_ROWS = 100_000
#: Repeat counts are solved to this, or to this share of the largest count.
TOLERANCE, SHARE = 0.05, 1e-4
#: Columns that join the working set at once, and sweeps over it before all columns are priced again.
JOINING, SWEEPS = 3_000, 20
TABLE = 400_000

#: Characters that normalisation leaves alone but for their case, and whose kind is plain: white space, printable ASCII, precomposed letters.
_PLAIN = re.compile(r"[\t-\r\x20-~À-ÖØ-öø-ÿ]*")
#: What words of plain characters fall into, in lower case: contractions, letters, single digits, marks.
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_SHOWN = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
#: Byte-level vocabularies write each byte as a visible character: itself, or the next one from 256 on.
_VISIBLE = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """Ids of texts as little-endian unsigned 32-bit bytes, piece by piece.

    The vocabulary drops white space and merges within pieces only: contractions, runs of letters, digits, runs of
    marks.  Texts of plain characters are cut into pieces here, and a piece that is not in the table goes straight to
    the library's model.  Other texts are cut at white space; their words that are not plain take the library's
    whole way.  All of this is tried on probes when a vocabulary is loaded; where it fails, whole texts are
    encoded by the library.
    """

    def __init__(self, path: str, table: int = TABLE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ids = [struct.pack("<I", i) for i in range(self.library.get_vocab_size())]
        self.pieces, self.words = Table(table), Table(table // 4)
        self.by_piece = True
        probes = ["The Übung, ends! don't x|y l'été ß 12 $$$ ÀÉ. <b> a%b I'LL .'s'' 'tis", "\u00a0 ñandú?! \U0001f600 e\u0301x the", *self.special, ""]
        self.by_piece = self.encode(probes) == self._ask(probes)

    def _ask(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in found]

    def _piece(self, text: str) -> bytes:
        shown = text if text.isascii() else text.encode().decode("latin-1").translate(_VISIBLE)
        return b"".join([self.ids[t.id] for t in self.model.tokenize(shown)])

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _cut(self, text: str) -> list[str]:
        """Pieces of a text; a word that is not plain stands whole, behind a NUL that no piece holds."""
        if self._plain(text):
            return _PIECE.findall(text.lower())
        keys = []
        for word in _SPACE.split(text):  # ASCII white space only: a part of what the vocabulary drops
            keys += _PIECE.findall(word.lower()) if self._plain(word) else ["\0" + word]
        return keys

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._ask(texts)
        out: list[bytes] = []
        for lo in range(0, len(texts), 256):
            cut = [self._cut(t) for t in texts[lo : lo + 256]]
            wanted = set().union(*cut)
            odd = {w for w in wanted if w[0] == "\0"}
            known = self.pieces.fill(wanted - odd, lambda new: map(self._piece, new))
            if odd:
                words = self.words.fill(odd, lambda new: self._ask([w[1:] for w in new]))
                known = ChainMap(words, known)
            out += [b"".join(map(known.__getitem__, keys)) for keys in cut]
            self.pieces.trim()
            self.words.trim()
        return out


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def cut_documents(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None, window: int) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens of each piece: full windows, then what is left."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = T.StructField("id", source.schema["id"].dataType)
    schema = T.StructType([kind, *T._parse_datatype_string("start long, length long, ids_crc32 long, doc_tokens long").fields])
    end = struct.pack("<I", END_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_tokens(vocabulary or default_vocabulary())
        for batch in batches:
            for part in slices(batch):
                take, rows = [], []
                for i, ids in enumerate(codec.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        take.append(i)
                        rows.append((start, len(piece) // 4, zlib.crc32(piece), n))
                columns = [pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take, pa.int64())), *columns], names=schema.names)

    return source.mapInArrow(run, schema)


class Place(NamedTuple):
    """Pieces of one length with ranks from `rank` on: `each` sequences from `sequence` on, `copies` pieces in each."""

    length: int
    rank: int
    each: int
    copies: int
    sequence: int
    offset: int


def combinations_filling(lengths: Iterable[int], window: int) -> np.ndarray:
    """All pairs and triples of present lengths that add up to `window`, largest first; a pair's third length is 0."""
    present = np.zeros(window + 1, bool)
    present[[k for k in lengths if 0 < k < window]] = True
    sizes = np.flatnonzero(present)
    second = sizes[(2 * sizes <= window) & present[window - sizes]]
    parts = [np.stack([window - second, second, np.zeros_like(second)], axis=1)]
    for first in sizes[3 * sizes >= window]:
        second = sizes[(sizes <= first) & (2 * sizes >= window - first) & (sizes < window - first)]
        second = second[present[window - first - second]]
        parts.append(np.stack([np.full(len(second), first), second, window - first - second], axis=1))
    return np.concatenate(parts)


def column_norms(columns: np.ndarray) -> np.ndarray:
    """The squared norm of each column: the squares of how often it holds its lengths."""
    a, b, c = columns.T
    same = (a == b).astype(int) + (b == c)  # lengths fall, so equal ones are neighbours
    return np.where(c == 0, np.where(a == b, 4.0, 2.0), np.array([3.0, 5.0, 9.0])[same])


def repeat_counts(histogram: Mapping[int, int], columns: np.ndarray, tolerance: float | None = None) -> np.ndarray:
    """Non-negative least squares: x >= 0 with the columns times x closest to the histogram.

    Coordinate descent over a working set: the columns in use, and those whose count would move most.  All columns are
    priced after each pass over it; it ends when none of them would move by more than `tolerance`.
    """
    rest = np.zeros(1 + max([int(columns.max(initial=0)), *histogram]), float)
    for k, v in histogram.items():
        rest[k] = v
    tolerance = max(TOLERANCE, SHARE * rest.max()) if tolerance is None else tolerance
    a, b, c = columns.T
    norms, x = column_norms(columns), np.zeros(len(columns))
    while True:
        rest[0] = 0
        step = np.maximum((rest[a] + rest[b] + rest[c]) / norms, -x)
        moving = np.flatnonzero(np.abs(step) > tolerance)
        if not len(moving):
            return x
        if len(moving) > JOINING:
            moving = moving[np.argpartition(-np.abs(step[moving]), JOINING)[:JOINING]]
        work = np.union1d(moving, np.flatnonzero(x > 0))
        x[work], rest = _descend(rest.tolist(), x[work].tolist(), columns[work].tolist(), norms[work].tolist(), tolerance / 2)


def _descend(rest: list[float], x: list[float], columns: list[list[int]], norms: list[float], tolerance: float) -> tuple[list[float], np.ndarray]:
    for _ in range(SWEEPS):
        largest = 0.0
        for j, (i, k, m) in enumerate(columns):
            step = max((rest[i] + rest[k] + (rest[m] if m else 0.0)) / norms[j], -x[j])
            if step:
                x[j] += step
                rest[i] -= step
                rest[k] -= step
                rest[m] -= step
                largest = max(largest, abs(step))
        if largest <= tolerance:
            break
    return x, np.array(rest)


def plan(histogram: Mapping[int, int], window: int = WINDOW) -> list[Place]:
    """Places for all pieces of a histogram of lengths (1 to window); sequences count from 0."""
    left = {k: int(v) for k, v in histogram.items() if v > 0}
    used = dict.fromkeys(left, 0)
    places: list[Place] = []
    sequences = 0

    def take(pattern: Mapping[int, int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for length, copies in pattern.items():
            places.append(Place(length, used[length], times, copies, sequences, offset))
            used[length] += times * copies
            left[length] -= times * copies
            offset += length * copies
        sequences += times

    if left.get(window):
        take({window: 1}, left[window])
    columns = combinations_filling(left, window)
    x = repeat_counts({k: v for k, v in left.items() if k < window}, columns)
    whole = np.flatnonzero(x >= 1)
    for count, *lengths in sorted(zip((-x[whole]).tolist(), *columns[whole].T.tolist(), strict=True)):
        pattern = Counter(v for v in lengths if v)
        if times := min(int(-count), *(left[v] // n for v, n in pattern.items())):
            take(pattern, times)
    order = sorted((k for k, v in left.items() if v > 0), reverse=True)
    while order:
        pattern, room = {}, window
        for length in order:
            if copies := min(left[length], room // length):
                pattern[length] = copies
                room -= copies * length
        take(pattern, min(left[v] // n for v, n in pattern.items()))
        order = [k for k in order if left[k] > 0]
    return places


def _ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """`pieces` with their rank among those of one length."""
    filed = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "start"), F.lit(buckets)).cast("int"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "start", "ids_crc32"))
    counts = filed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "bucket", before.alias("before"))
    return filed.withColumn("within", within).join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1)


def _seated(places: list[Place]):
    by: dict[int, list[Place]] = {}
    for p in sorted(places, key=lambda p: p.rank):
        by.setdefault(p.length, []).append(p)
    tables = {k: np.array([tuple(p)[1:] for p in v], np.int64) for k, v in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                table = tables[int(k)]
                row = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                turn = rank[own] - row[:, 0]
                sequence[own] = row[:, 3] + turn % row[:, 1]
                offset[own] = row[:, 4] + turn // row[:, 1] * k
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "start", "length", "ids_crc32", "doc_tokens")]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence), pa.array(offset)], names=names)

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, window: int = WINDOW, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """One row per piece: `id_col`, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece with the end id alone.  Rows that repeat an id are packed each by itself; equal
    pieces tie and may trade places.  A document of any length is cut into full windows.  Other columns are not
    read, so their names cannot clash; an empty table gives an empty result.
    """
    pieces = durable(cut_documents(docs, id_col, text_col, vocabulary, window))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a window's lengths at most
    buckets = 1 + max(histogram.values(), default=0) // bucket_rows
    ranked = _ranked(pieces, buckets).select("id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    kind = T.StructField("id", pieces.schema["id"].dataType)
    more = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = ranked.mapInArrow(_seated(plan(histogram, window)), T.StructType([kind, *T._parse_datatype_string(more).fields]))
    return placed.withColumnRenamed("id", id_col)
