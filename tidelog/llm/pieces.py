"""SentencePiece encoding and decoding through a table of distinct chunks.

In the vocabulary no piece holds a white-space marker after another character, so no merge crosses the border in
front of a marker.  A text is cut there into marked words ("chunks"), each distinct chunk is segmented once, and its
ids are joined back by position.  The table of known chunks lives in the Python worker, holds about `TABLE` chunks
at most and drops those out of use, so memory is bounded while every chunk of a batch is still segmented once.

`Pieces` reads from the model file how it normalises and looks through its pieces when it loads; for a vocabulary with
crossing pieces, or one that changes texts otherwise than by markers, it falls back to segmenting whole texts.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import Table

MARK = "▁"
TABLE = 300_000


def default_model() -> str:
    """The path of the public vocabulary with byte fallback, as installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(message: bytes) -> dict[int, list]:
    """The fields of a serialised protocol buffer message by number: integers, or the bytes of everything else."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            value, at = message[at : at + size], at + size
        out.setdefault(tag >> 3, []).append(value)
    return out


def only_marks(model: bytes) -> bool:
    """Whether a model changes a text only by writing markers for spaces, one more of them in front.

    Fixed values: numbers of the published message format. The model's training settings are field 2 (24 there: markers
    behind words), its normaliser's are field 3: 2 the character map, 3 a marker in front, 4 no repeated spaces, 5 markers for
    spaces; 3 to 5 hold where they are not set.
    """
    fields = _fields(model)
    training, normaliser = (_fields(fields[n][-1]) if n in fields else {} for n in (2, 3))
    last = lambda settings, n, default: settings.get(n, [default])[-1]
    plain = not last(normaliser, 2, b"") and last(normaliser, 3, 1) and not last(normaliser, 4, 1) and last(normaliser, 5, 1)
    return bool(plain and not last(training, 24, 0))


class Pieces:
    """Encoder and decoder for one model file; equal to the library's encode(text) and decode(ids)."""

    def __init__(self, model: str, table: int = TABLE):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.table = Table(table)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        crosses = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        with open(model, "rb") as f:
            self.by_chunk = not crosses and only_marks(f.read())
        self.ids_of = {p: i for i, p in enumerate(pieces)}
        self.is_byte = np.array([self.library.is_byte(i) for i in range(len(pieces))])
        self.newline, self.tab = self.ids_of.get("<0x0A>", -1), self.ids_of.get("<0x09>", -1)

    def chunks(self, text: str) -> list[str]:
        """The marked words of a text: each is a run of markers and the characters up to the next one."""
        return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", MARK + text.replace(" ", MARK)) if text else []

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks that begin with a marker: the library puts one marker in front of what it is given."""
        return self.library.encode([c[1:] for c in chunks], num_threads=1)

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks; a lone marker is what the library gives no ids for, as it is asked for the empty text."""
        return [array("i", ids or [self.ids_of[MARK]]).tobytes() for ids in self._segment(chunks)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as 32-bit integers."""
        if not self.by_chunk:
            return [np.array(ids, np.int32) for ids in self.library.encode(texts, num_threads=1)]
        out: list[np.ndarray] = []
        for lo in range(0, len(texts), 256):
            parts = [self.chunks(t) for t in texts[lo : lo + 256]]
            known = self.table.fill(set().union(*parts), self._ids)
            out += [np.frombuffer(b"".join(map(known.__getitem__, part)), np.int32) for part in parts]
            self.table.trim()
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.library.decode([x.tolist() for x in ids]) if ids else []


_loaded: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """The worker's encoder for a model file."""
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per input row: `id_col`, ids (array of int), decoded (string).

    A null or empty text has no ids and decodes to the empty string.  Very long texts are encoded whole.  Repeated rows
    give repeated results.  Other columns are not read, so their names cannot clash; an empty table gives an empty result.
    """
    return _mapped(docs, id_col, text_col, model, digests=False)


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Like `encode_documents`, with digests in place of ids and text: n_tokens, ids_sha256, decoded_sha256."""
    return _mapped(docs, id_col, text_col, model, digests=True)


def _mapped(docs: DataFrame, id_col: str, text_col: str, model: str | None, digests: bool) -> DataFrame:
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = T.StructField(id_col, source.schema["id"].dataType)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces(model or default_model())
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = codec.encode(texts)
                decoded = codec.decode(ids)
                if digests:
                    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                    columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(",".join(map(str, x.tolist()))) for x in ids]), pa.array([sha(x) for x in decoded])]
                else:
                    names = [id_col, "ids", "decoded"]
                    columns = [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return source.mapInArrow(run, T.StructType([id_type, *T._parse_datatype_string(more).fields]))
