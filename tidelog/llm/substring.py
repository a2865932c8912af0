"""Substring dedup by relative Lempel-Ziv parsing against an indexed reference that is held in blocks.

The reference of a document is all that starts before it.  The greedy parse asks at each start for a factor: the
place of the earliest equal run of `SPAN` words, made longer word by word as far as source and document agree.  The
next factor is asked for at the first start that the last one does not hold whole, so the sequences across a factor's
boundary are checked like all others.  Factors of `SPAN` words or more become duplicate spans, shorter ones are
literals.  Words are compared as they are; hashes only decide which block is asked.

Blocks: of the `SPAN - GRAM + 1` word k-grams in a sequence the one with the smallest hash is its anchor.  Equal
sequences have equal anchors, so a text is cut into pieces, one per run of starts that share an anchor's place
(`2 * SPAN - GRAM` words at most), and a piece can only match pieces of its own anchor.  Pieces whose anchor stands at one
place in the corpus are literals and stay at home.  The others are shuffled by anchor: a partition is a reference
block, sorted by anchor and place, and indexes each distinct sequence of an anchor with its first place as
the parse goes through it.  A document asks every block that could hold one of its sequences; asking blocks that
cannot would grow with the square of the corpus.  Factors that go on from piece to piece are joined afterwards.

Skew: a task parses its own pieces against each other first, so equal pieces leave it once per buffer however often they
stand there.  An anchor with more than `HOT` places would make a large group of pieces that differ around it; its
pieces are cut into single sequences and shuffled by those, which spreads them and loses no match.  Hot
anchors are named by a bit table of fixed size (`TABLE_BITS`), so every task decides alike; a bit shared by two
anchors only means that both are spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import durable, durable_table, free_names
from tidelog.llm.pieces import slices

SPAN, GRAM = 20, 8
#: Anchors that a task holds at once; of pieces it holds `PIECE_BYTES` times as many bytes.
BUFFER, PIECE_BYTES = 300_000, 100
HOT, TABLE_BITS = 4_096, 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _own(rid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key of its own for a place, to spread what needs no block."""
    return _mixed(_mixed(rid.astype(np.uint64)) + at.astype(np.uint64))


def anchors(words: list[bytes], span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first start and number of starts of each run of sequences that share an anchor's place."""
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), "<u8")
    size = len(words) - gram + 1
    grams = h[:size].copy()
    for k in range(1, gram):
        grams *= _FACTOR
        grams += h[k : k + size]
    grams = _mixed(grams)
    # of equal hashes the first counts, so the places never go back and each one's starts are a run
    place = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams, span - gram + 1).argmin(axis=1)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return grams[place[first]], first, np.diff(first, append=n)


def _anchor_rows(span: int, gram: int, buffer: int) -> Callable:
    """(rid, text) to (way, key, rid, at, n): one row per piece; at is its first start times 2**32 plus its starts.

    Of the pieces of one key that a task holds, the first travels by the key with their number n.  The others are
    known to be shared; their n is 0, and they travel by a way of their own, not all to the key's one task.
    """

    def flush(held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, at = (np.concatenate([h[i] for h in held]) for i in (1, 2))
        rid = np.repeat(np.array([h[0] for h in held], np.int64), [len(h[1]) for h in held])
        order = np.argsort(key, kind="stable")
        key, at, rid = key[order], at[order], rid[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.zeros(len(key), np.int32)
        n[first] = np.diff(first, append=len(key))
        way = np.where(n > 0, key, _own(rid, at))
        return pa.RecordBatch.from_arrays([_signed(way), _signed(key), pa.array(rid), pa.array(at), pa.array(n)], names=["way", "key", "rid", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                for rid, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    key, start, starts = anchors((text or b"").split(), span, gram)
                    if len(key):
                        held.append((rid, key, (start << 32) | starts))
                        size += len(key)
                        if size >= buffer:
                            yield flush(held)
                            held, size = [], 0
        if held:
            yield flush(held)

    return run


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text) with the text compressed: it is shuffled once, and makes up most of what is."""
    codec = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for part in slices(batch):
            texts = [None if t is None else codec.compress(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], names=["rid", "packed"])


def _texts(column: pa.Array) -> list[bytes | None]:
    codec = zstandard.ZstdDecompressor()
    return [None if t is None else codec.decompress(t) for t in column.to_pylist()]


class Block:
    """The index of one anchor's part of the reference: it parses pieces in the order of their places and takes them in."""

    def __init__(self, span: int):
        self.span = span
        self.whole: dict[bytes, tuple[int, int]] = {}  # a piece's text to its first place
        self.waiting: list[tuple[bytes, int, int]] = []  # pieces that nothing has been held against so far
        self.known: list[tuple[list[bytes], int, int]] = []
        self.first: dict[bytes, tuple[int, int]] = {}  # a sequence to the piece and word where it stands first

    def _sequence(self, words: list[bytes], j: int) -> bytes:
        return b" ".join(words[j : j + self.span])

    def _take(self, words: list[bytes], rid: int, start: int, starts: list[int]) -> None:
        self.first.update((self._sequence(words, j), (len(self.known), j)) for j in starts)
        self.known.append((words, rid, start))

    def parse(self, text: bytes, rid: int, start: int) -> list[tuple[int, int, int, int]]:
        """The piece's factors: first start, number of starts, and the place of the source (document, word)."""
        if source := self.whole.get(text):
            return [(start, text.count(b" ") + 2 - self.span, *source)]
        self.whole[text] = rid, start
        if not self.known and not self.waiting:
            self.waiting.append((text, rid, start))
            return []
        for other, r, s in self.waiting:
            words = other.split(b" ")
            self._take(words, r, s, list(range(len(words) - self.span + 1)))
        self.waiting.clear()
        words, span, factors, literals = text.split(b" "), self.span, [], []
        j, n = 0, len(words)
        while j + span <= n:
            hit = self.first.get(self._sequence(words, j))
            if hit is None:
                literals.append(j)
                j += 1
                continue
            source, at = self.known[hit[0]], hit[1]
            end, on = j + span, at + span
            while end < n and on < len(source[0]) and words[end] == source[0][on]:
                end, on = end + 1, on + 1
            factors.append((start + j, end - j - span + 1, source[1], source[2] + at))
            j = end - span + 1  # the first sequence that crosses the factor's boundary
        self._take(words, rid, start, literals)
        return factors


PIECES = "key long, rid long, at long, words binary, from_rid long, from_at long"
FACTORS = "rid long, at long, from_rid long, from_at long"


def _piece_rows(span: int, held_bytes: int, hot: bytes) -> Callable:
    """(rid, packed, places) to PIECES: a row with words is a piece for its block, one without is a factor found here."""
    bits = np.frombuffer(hot, np.uint8)

    def flush(held: list[tuple[int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda p: p[:2])
        first: dict[bytes, tuple[int, int]] = {}
        out, done = [], []
        for rid, start, starts, key, text in held:
            source = first.setdefault(text, (rid, start))
            if source == (rid, start):
                out.append((key, rid, (start << 32) | starts, text))
                continue
            last = done[-1] if done else None
            if last and last[0] == rid and last[1] + last[2] == start and last[3] == source[0] and last[4] + last[2] == source[1]:
                last[2] += starts
            else:
                done.append([rid, start, starts, *source])
        none = pa.nulls(len(out), pa.int64())
        key, rid, at, text = zip(*out, strict=True)
        longs = lambda x: pa.array(list(x), pa.int64())
        yield pa.RecordBatch.from_arrays([longs(key), longs(rid), longs(at), pa.array(text, pa.binary()), none, none], names=["key", "rid", "at", "words", "from_rid", "from_at"])
        if done:
            rid, start, starts, from_rid, from_at = (np.array(c, np.int64) for c in zip(*done, strict=True))
            at = (start << 32) | starts
            arrays = [_signed(_own(rid, at)), pa.array(rid), pa.array(at), pa.nulls(len(done), pa.binary()), pa.array(from_rid), pa.array(from_at)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "rid", "at", "words", "from_rid", "from_at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                for rid, text, places in zip(part.column(0).to_pylist(), _texts(part.column(1)), part.column(2), strict=True):
                    words = (text or b"").split()
                    keys, ats = (places.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    spread = bits[keys & ((1 << TABLE_BITS) - 1)]
                    for key, at, alone in zip(keys.tolist(), ats.tolist(), spread.tolist(), strict=True):
                        start, starts = at >> 32, at & 0xFFFFFFFF
                        if alone:
                            for j in range(start, start + starts):
                                sequence = b" ".join(words[j : j + span])
                                held.append((rid, j, 1, xxhash.xxh3_64_intdigest(sequence) - (1 << 63), sequence))
                                size += len(sequence) + 200
                        else:
                            piece = b" ".join(words[start : start + starts + span - 1])
                            held.append((rid, start, starts, key, piece))
                            size += len(piece) + 200
                        if size >= held_bytes:
                            yield from flush(held)
                            held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _block_rows(span: int) -> Callable:
    """PIECES, sorted by key and place, to FACTORS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, Block(span)
        for batch in batches:
            out = []
            for key, rid, at, words, from_rid, from_at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words is None:
                    out.append((rid, at, from_rid, from_at))
                    continue
                if key != now:
                    now, block = key, Block(span)
                out += [(rid, (start << 32) | starts, *source) for start, starts, *source in block.parse(words, rid, at >> 32)]
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["rid", "at", "from_rid", "from_at"])

    return run


def joined(found: list[dict], span: int) -> list[tuple[int, int, int, int]]:
    """A document's factors in order: start, length in words, source document and word.

    Factors of neighbouring pieces that go on along the same source are one.
    """
    out: list[list[int]] = []
    for at, rid, word in sorted((f["at"], f["from_rid"], f["from_at"]) for f in found):
        start, starts = at >> 32, at & 0xFFFFFFFF
        last = out[-1] if out else None
        if last and last[2] == rid and start - last[0] == word - last[3] and start <= last[0] + last[1] - span + 1:
            last[1] = max(last[1], start - last[0] + starts + span - 1)
        else:
            out.append([start, starts + span - 1, rid, word])
    return [tuple(f) for f in out]


def covered(n_words: int, at: np.ndarray, span: int) -> np.ndarray:
    """Which of a document's words its factors cover, as packed in FACTORS."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, at >> 32, 1)
    np.add.at(edges, (at >> 32) + (at & 0xFFFFFFFF) + span - 1, -1)
    return np.cumsum(edges)[:-1] > 0


def _found(spans: pa.Array) -> list[np.ndarray | None]:
    """The packed starts of each document's factors; None where it has none."""
    return [s.values.field(0).to_numpy() if s.is_valid else None for s in spans]


def _kept_rows(span: int, keep: str) -> Callable:
    """(rid, packed, spans) to n_words, n_removed and the kept text or its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n_words, n_removed, kept = [], [], []
                for text, found in zip(_texts(part.column(1)), _found(part.column(2)), strict=True):
                    words = (text or b"").split()
                    stay = words
                    if found is not None:
                        gone = covered(len(words), found, span)
                        stay = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(stay))
                    text_now = b" ".join(stay)
                    if keep == "digest":
                        kept.append(hashlib.sha256(text_now).hexdigest())
                    else:
                        kept.append(None if text is None else text_now.decode() if found is not None else text.decode())
                arrays = [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["rid", "n_words", "n_removed", "kept"])

    return run


def _ordered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rid, text) of each row; rid is a long in the order of the documents.  Also rid to id, where the two differ.

    Integer ids that do not repeat serve as they are.  Else rid numbers the distinct (id, text) in their order, by
    partition and place after a global sort, so null ids come first and texts that share an id get an order too.
    """
    clean = isinstance(docs.schema["id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    if clean and docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").isEmpty():
        return docs.select(F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("rid"), "text"), None
    marked = docs.withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    names = _named(docs)
    other = names.select(F.col("id").alias("n_id"), F.col("h").alias("n_h"), "rid")
    with_rid = marked.join(other, F.col("id").eqNullSafe(F.col("n_id")) & (F.col("h") == F.col("n_h")))
    return with_rid.select("rid", "text"), names


def _named(docs: DataFrame) -> DataFrame:
    """id, h (of the text) and rid, which counts up in the order of (id, h)."""
    marked = docs.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return durable(marked.distinct().orderBy("id", "h").select("id", "h", F.monotonically_increasing_id().alias("rid")))


def pack_texts(rows: DataFrame) -> DataFrame:
    # rid is declared as never null, so that both joins by it ask for the very same shuffle
    return rows.mapInArrow(_packed_rows, T.StructType([T.StructField("rid", T.LongType(), False), T.StructField("packed", T.BinaryType())]))


def _hot_bits(shared: DataFrame, hot: int) -> bytes:
    """One byte per value of a key's low `TABLE_BITS` bits: 1 where a key with more than `hot` places has that value."""
    low = F.col("key").bitwiseAND(F.lit((1 << TABLE_BITS) - 1)).cast("int")
    found = shared.where(F.col("total") > hot).select(low.alias("low")).distinct().collect()  # as many as the table has entries, at most
    bits = np.zeros(1 << TABLE_BITS, np.uint8)
    bits[[r.low for r in found]] = 1
    return bits.tobytes()


def parse(rows: DataFrame, packed: DataFrame, span: int = SPAN, gram: int = GRAM, buffer: int = BUFFER, hot: int = HOT) -> DataFrame:
    """FACTORS of all documents, piece by piece: runs of starts whose sequence of `span` words stands earlier, with a source.

    `rows` are (rid, text); `packed` the same from `pack_texts`, so that a caller's own join by rid can share its shuffle.
    """
    found = rows.mapInArrow(_anchor_rows(span, gram, buffer), "way long, key long, rid long, at long, n int")
    total = F.sum("n").over(Window.partitionBy("way"))
    # kept, since it is read twice: for the hot anchors, and for the places
    shared = durable_table(found.withColumn("total", total).where("total > 1 or n = 0").select("key", "rid", "at", "total"))
    places = shared.groupBy("rid").agg(F.collect_list(F.struct("key", "at")).alias("places"))
    asked = packed.join(places, "rid").select("rid", "packed", "places")
    pieces = asked.mapInArrow(_piece_rows(span, buffer * PIECE_BYTES, _hot_bits(shared, hot)), PIECES)
    return pieces.repartition("key").sortWithinPartitions("key", "rid", "at").mapInArrow(_block_rows(span), FACTORS)


def _spans(factors: DataFrame) -> DataFrame:
    """(rid, spans): one row per document with factors."""
    return factors.groupBy("rid").agg(F.collect_list(F.struct("at", "from_rid", "from_at")).alias("spans"))


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, buffer: int = BUFFER, keep: str = "text", hot: int = HOT
) -> DataFrame:
    """One row per input row: `id_col`, n_words, n_removed, and kept (the text) or kept_sha256 if `keep` is "digest".

    A word goes if a run of `span` words that covers it also starts earlier: in a document with a smaller id, or in
    the same one at an earlier word.  Runs are judged on the input.  kept joins the words that stay by one space;
    with `keep` "text" an untouched text comes back as it was.  Null and empty texts have no words (null stays null).
    Very long texts are read whole; one task holds one such text at a time.
    Rows that repeat id and text are one document and get the same result each.  Of different texts with one id the
    one with the smaller SHA-256 comes first; null ids come before all others.  Other columns are not read; an empty
    table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows, names = _ordered(source)
    packed = pack_texts(rows)
    once = rows if names is None else rows.dropDuplicates(["rid"])
    spans = _spans(parse(once, packed if names is None else pack_texts(once), span, gram, buffer, hot))
    out = packed.join(spans, "rid", "left").select("rid", "packed", "spans")
    out = out.mapInArrow(_kept_rows(span, keep), "rid long, n_words long, n_removed long, kept string")
    if names is None:
        out = out.withColumn("id", F.col("rid").cast(source.schema["id"].dataType))
    else:
        out = out.join(names.select("rid", "id"), "rid")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").alias("kept_sha256" if keep == "digest" else "kept"))


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, buffer: int = BUFFER, hot: int = HOT) -> DataFrame:
    """The parse itself, one row per factor of `span` words or more: `id_col`, start, length, source_id, source_start.

    The source starts earlier and holds the same words.  Integer ids that are unique and not null are asked for;
    texts as in `substring_dedup`.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows, names = _ordered(source)
    if names is not None:
        raise ValueError(f"{id_col} must be unique integers")
    spans = _spans(parse(rows, pack_texts(rows), span, gram, buffer, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(rid, *f) for rid, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in joined(found, span)]
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=[id_col, "start", "length", "source_id", "source_start"])

    return spans.mapInArrow(run, T.StructType([T.StructField(n, T.LongType()) for n in (id_col, "start", "length", "source_id", "source_start")]))


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", span: int = SPAN) -> DataFrame:
    """`docs` with repeated passages taken out of the text column, and `count_col` (if there) set to its new length.

    Every row stays, even one that loses all its words.  Rows come back as they were where nothing repeats; null and
    empty texts stay as they are.  Rows that repeat an id, or have none, take the general path of `substring_dedup`.
    All columns come back whatever their names; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows, names = _ordered(source)
    c_rid, c_of, c_spans, c_h, c_id, c_nh = free_names(docs, 6)
    if names is None:
        spans = _spans(parse(rows, pack_texts(rows), span))
        marked = docs.withColumn(c_rid, F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    else:
        once = rows.dropDuplicates(["rid"])
        spans = _spans(parse(once, pack_texts(once), span))
        hashed = docs.withColumn(c_h, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
        full = names.select(F.col("id").alias(c_id), F.col("h").alias(c_nh), F.col("rid").alias(c_rid))
        marked = hashed.join(full, F.col(id_col).eqNullSafe(F.col(c_id)) & (F.col(c_h) == F.col(c_nh)))
    found = marked.join(spans.select(F.col("rid").alias(c_of), F.col("spans").alias(c_spans)), F.col(c_rid) == F.col(c_of), "left")
    wanted = found.select(*docs.columns, c_spans)
    at, out_at = docs.columns.index(text_col), docs.columns.index(count_col) if count_col in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = part.columns[:-1]
                texts = []
                for text, found in zip(part.column(at).to_pylist(), _found(part.column(part.num_columns - 1)), strict=True):
                    if found is not None:
                        words = text.encode().split()
                        gone = covered(len(words), found, span).tolist()
                        text = b" ".join([w for w, g in zip(words, gone, strict=True) if not g]).decode()
                    texts.append(text)
                columns[at] = pa.array(texts, pa.string())
                if out_at >= 0:
                    columns[out_at] = pa.array([None if t is None else len(t) for t in texts], part.schema.field(out_at).type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])

    return wanted.mapInArrow(run, docs.schema)


#: The digest form in SQL: every sequence's first place by its whole text.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS seq FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM d)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY seq ORDER BY doc_id, p) AS turn FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM r WHERE turn > 1),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
