"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn by its code point.  A letter trigram is bound into one vector: the element-wise product of
its letters' vectors, permuted once and twice for the first two places.  A document bundles (adds up) its
trigrams' vectors, a language's prototype bundles its documents' unit vectors, and a text is given the language
whose prototype is nearest by cosine.  Prototypes are centred on their common mean, which holds what
the languages share.

The fit reads at most `SAMPLE` documents with a language, those with the smallest hash of their id: a documented
bound.  Executors bundle; one row per task and language reaches the driver's sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import held_out
from tidelog.llm.pieces import slices

DIMENSIONS, SAMPLE, SEED = 2048, 20_000, 7
#: A worker keeps so many trigrams' vectors at most, and bundles so many at once.
TABLE, AT_ONCE = 20_000, 2_000
#: Bits of a code point.
POINT = 21
UNKNOWN = "und"
SPACE = 32


@lru_cache(1)
def _letters() -> np.ndarray:
    """By code point, what is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def letter_runs(text: str) -> np.ndarray:
    """The code points of a text's letters in lower case, one space in front of, between and behind its runs of them."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    code = np.where(_letters()[code], code, SPACE)
    return code[np.concatenate([[True], (code[1:] != SPACE) | (code[:-1] != SPACE)])]


@lru_cache(4096)
def _letter_vector(point: int) -> np.ndarray:
    return np.random.default_rng((SEED, point)).choice(np.array([-1, 1], np.int8), DIMENSIONS)


def _bind(grams: np.ndarray) -> np.ndarray:
    """One vector per trigram; a trigram is three code points in one number."""
    parts = np.concatenate([grams >> 2 * POINT, grams >> POINT & (1 << POINT) - 1, grams & (1 << POINT) - 1])
    points, at = np.unique(parts, return_inverse=True)
    letters = np.stack([_letter_vector(int(p)) for p in points])
    first, second, third = at.reshape(3, -1)
    return np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[second] * letters[third]


class Profiles:
    """Bundles texts; a trigram's vector is bound when it is first met and kept in a table of bounded size."""

    def __init__(self):
        self.bound = np.zeros((TABLE, DIMENSIONS), np.int8)
        self.keys = self.rows = np.zeros(0, np.int64)

    def _vectors(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of sorted, different trigrams, `AT_ONCE` at most; a full table starts anew."""
        at = np.searchsorted(self.keys, grams)
        new = grams[np.append(self.keys, -1)[at] != grams]
        if len(self.keys) + len(new) > TABLE:
            self.keys = self.rows = np.zeros(0, np.int64)
            new = grams
        if len(new):
            rows = np.arange(len(self.keys), len(self.keys) + len(new))
            self.bound[rows] = _bind(new)
            at = np.searchsorted(self.keys, new)
            self.keys, self.rows = np.insert(self.keys, at, new), np.insert(self.rows, at, rows)
        return self.bound[self.rows[np.searchsorted(self.keys, grams)]]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The unit vector of a whole text; None where it has no letter."""
        if not text or not any(map(str.isalpha, text)):
            return None
        code = letter_runs(text)
        grams, counts = np.unique(code[:-2] << 2 * POINT | code[1:-1] << POINT | code[2:], return_counts=True)
        total = np.zeros(DIMENSIONS, np.float32)
        for lo in range(0, len(grams), AT_ONCE):
            part = slice(lo, lo + AT_ONCE)
            total += counts[part].astype(np.float32) @ self._vectors(grams[part]).astype(np.float32)
        length = float(np.linalg.norm(total))
        return total / length if length else None


_profiles: Profiles | None = None


def profiles() -> Profiles:
    global _profiles
    _profiles = _profiles or Profiles()
    return _profiles


def _bundle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch):
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if (v := profiles().bundle(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["lang", "sums"]
    )


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their centred unit prototypes; from rows of (text, lang)."""
    parts = rows.select("text", "lang").mapInArrow(_bundle_batches, "lang string, sums array<double>")
    added = parts.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("s"))
    found = added.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x.s).alias("v")).orderBy("lang").collect()
    if not found:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    unit = np.array([np.array(r.v) / max(np.linalg.norm(r.v), 1e-9) for r in found])
    centred = unit - unit.mean(axis=0) if len(unit) > 1 else unit
    return [r.lang for r in found], (centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def training_rows(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """text and lang of at most `sample` documents outside the held-out fold; the chosen ids are broadcast.

    Ids that repeat or are null are left out of the choice.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("id"))).groupBy(F.col("id").alias("c_id"))
    chosen = known.agg(F.min("lang").alias("c_lang"), F.count(F.lit(1)).alias("n")).where("n = 1").orderBy(F.xxhash64("c_id"), "c_id").limit(sample)
    return rows.join(F.broadcast(chosen), F.col("id") == F.col("c_id")).select("text", F.col("c_lang").alias("lang"))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, lang_pred, score (the cosine moved to 0 to 1).

    A null text, one without a letter, and any text where no language was learned give `und` and score 0.  Very long
    texts are bundled whole, `AT_ONCE` different trigrams at a time.  Ties go to
    the first language by name.  Other columns are not read; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    langs, prototypes = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names, marks = [], []
                for text in part.column(1).to_pylist():
                    v = profiles().bundle(text) if langs else None
                    near = prototypes @ v if v is not None else None
                    best = int(near.argmax()) if near is not None else None
                    names.append(UNKNOWN if best is None else langs[best])
                    marks.append(0.0 if best is None else min(1.0, max(0.0, (1 + float(near[best])) / 2)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(marks, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = source.schema["id"].dataType
    return source.mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def judge_language(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`id_col`, held_out, lang_pred, score of every document; learns outside the held-out fold.

    A null id is not held out.  Rows that repeat are judged alike.  Null, empty and very long texts, other columns and
    empty tables are treated as `identify` says.
    """
    found = identify(docs, fit(training_rows(docs, sample, id_col, text_col, lang_col)), id_col, text_col)
    return found.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "lang_pred", "score")
