"""Scalar functions over bytes and strings.

Those that built-in functions express stay in the JVM.  Byte-serial codes (CRC-32C, FNV, the 64-bit hash) run over
Arrow batches, position by position for all values of a batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.schema import MAX_SEQ

U32, U64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF


def to_hex(data: Column) -> Column:
    """Upper-case hexadecimal digits."""
    return F.hex(data)


def difference_offset(a: Column, b: Column) -> Column:
    """Length of the common prefix of two byte strings."""
    bounded = F.least(F.octet_length(a), F.octet_length(b))
    byte = lambda x, i: F.substring(F.hex(x), 2 * i + 1, F.lit(2))
    first = F.array_min(F.filter(F.sequence(F.lit(0), F.greatest(bounded - 1, F.lit(0))), lambda i: (i < bounded) & (byte(a, i) != byte(b, i))))
    return F.coalesce(first, bounded)


def starts_with_ci(text: Column, prefix: Column) -> Column:
    """Prefix test that ignores the case of A-Z."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.startswith(fold(text), fold(prefix))


def parse_u64(text: Column) -> Column:
    """Digits with an optional plus sign as decimal(20,0); null for anything else and beyond 64 bits."""
    number = F.expr("null").cast("decimal(20,0)")
    digits = F.regexp_extract(text, r"^\+?0*([0-9]{1,20})$", 1)
    value = F.when(digits != "", F.rpad(digits, 20, " ")).otherwise(None)
    parsed = F.trim(value).try_cast("decimal(20,0)")
    return F.when(parsed <= F.lit(str(U64)).cast("decimal(20,0)"), parsed).otherwise(number)


def parse_bool(text: Column) -> Column:
    """The words for true and false, in any case."""
    low = F.lower(text)
    return F.when(low.isin("true", "1", "yes", "on"), True).when(low.isin("false", "0", "no", "off"), False)


def split_nonempty(text: Column, delimiter: str) -> Column:
    """Parts between single delimiters; empty ones dropped."""
    return F.filter(F.split(text, "\\Q" + delimiter + "\\E"), lambda x: x != "")


def pack_seq(seq: Column, code: Column) -> Column:
    """Sequence number and record kind in one long."""
    return F.shiftleft(seq.cast("long"), 8).bitwiseOR(code.cast("long"))


def unpack_seq(packed: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, 8).bitwiseAND(F.lit(MAX_SEQ)), packed.bitwiseAND(F.lit(255)).cast("int")


def fixed_be(number: Column, width: int) -> Column:
    """Big-endian bytes of a non-negative number, `width` of them."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * width, "0"))


def reversed_bytes(data: Column, width: int) -> Column:
    return F.concat(*[F.substring(data, i, 1) for i in range(width, 0, -1)])


def fixed_le(number: Column, width: int) -> Column:
    return reversed_bytes(fixed_be(number, width), width)


def from_fixed_be(data: Column, width: int = 8) -> Column:
    """The unsigned number (width 8: modulo 2**64 as a long) in the first `width` bytes; null if there are fewer."""
    taken = F.conv(F.hex(F.substring(data, 1, width)), 16, 10).cast("decimal(20,0)")
    signed = F.when(taken >= F.lit(str(1 << 63)).cast("decimal(20,0)"), taken - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(taken)
    return F.when(F.octet_length(data) >= width, signed.cast("long"))


def from_fixed_le(data: Column, width: int = 8) -> Column:
    return F.when(F.octet_length(data) >= width, from_fixed_be(reversed_bytes(F.substring(data, 1, width), width), width))


def varint(number: int) -> bytes:
    """Seven bits a byte, lowest first; the high bit says that more follow."""
    out = bytearray()
    while number > 0x7F:
        out.append(number & 0x7F | 0x80)
        number >>= 7
    return bytes([*out, number])


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """A varint and the place behind it; ValueError if it breaks off or goes beyond 64 bits."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("not a varint")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            if value > U64:
                raise ValueError("beyond 64 bits")
            return value, at


def _crc_table() -> list[int]:
    """The reflected table of the Castagnoli polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


_CRC = _crc_table()
#: Fixed value: what masking adds.
MASK_DELTA = 0xA282EAD8


def crc32c_of(data: bytes, before: int = 0) -> int:
    crc = before ^ U32
    for byte in data:
        crc = crc >> 8 ^ _CRC[(crc ^ byte) & 0xFF]
    return crc ^ U32


def mask_of(crc: int) -> int:
    """A CRC as stored beside its data: turned right by 15 bits, plus a constant."""
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & U32


def unmask_of(masked: int) -> int:
    turned = (masked - MASK_DELTA) & U32
    return (turned << 15 | turned >> 17) & U32


#: FNV-1a's 32-bit offset basis and prime; the 64-bit hash's primes.
FNV_BASIS, FNV_PRIME = 0x811C9DC5, 0x01000193
HASH64_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F)


def fnv32_of(data: bytes, seed: int = 0) -> int:
    state = (FNV_BASIS ^ seed) & U32
    for byte in data:
        state = (state ^ byte) * FNV_PRIME & U32
    return state


def hash64_of(data: bytes, seed: int = 0) -> int:
    """A turn and multiply per byte, then a finisher of three shifts; used for tests and fixtures."""
    first, second = HASH64_PRIMES
    state = (seed + first) & U64
    for byte in data:
        state = (state ^ byte) * second & U64
        state = (state << 31 | state >> 33) & U64
    state = (state ^ state >> 33) * second & U64
    state = (state ^ state >> 29) * first & U64
    return state ^ state >> 32


def _buffers(data: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a binary array, and where each value begins and ends (null: empty)."""
    whole = data.cast(pa.large_binary())
    whole = pa.concat_arrays([whole]) if whole.offset else whole
    edges = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    body = whole.buffers()[2]
    return np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8), edges[:-1], edges[1:]


#: Fewer values than this are not worth a step of the whole batch.
TOGETHER = 16


def _serial(step: Callable, scalar_step: Callable, start: int, finish: Callable, kind: type) -> Callable[[Column], Column]:
    """A byte-serial code over Arrow batches: byte positions are gone through one by one, all values of a batch at once.

    `step` takes the states and the bytes as arrays; the rest of the few longest values goes through `scalar_step`.
    """

    def codes(data: pa.Array) -> pa.Array:
        body, begin, end = _buffers(data)
        order = np.argsort(begin - end, kind="stable")  # longest first
        begin, end = begin[order], end[order]
        sizes, state, at = end - begin, np.full(len(order), start, np.uint64), 0
        n = len(order)
        while (n := int(np.searchsorted(-sizes[:n], -at, side="left"))) >= TOGETHER:
            state[:n] = step(state[:n], body[begin[:n] + at].astype(np.uint64))
            at += 1
        for i in range(n):
            one = int(state[i])
            for byte in body[begin[i] + at : end[i]].tolist():
                one = scalar_step(one, byte)
            state[i] = one
        out = np.empty(len(order), np.uint64)
        out[order] = finish(state)
        return pa.array(out.astype(kind).astype(np.int64) if kind is np.uint32 else out.view(np.int64), pa.int64(), mask=data.is_null().to_numpy(zero_copy_only=False))

    def call(data: Column) -> Column:
        def run(x: pa.Array) -> pa.Array:
            return codes(x)

        return F.arrow_udf(run, T.LongType())(data)

    call.codes = codes
    return call


def _u(n: int) -> np.uint64:
    return np.uint64(n)


_CRC_ARRAY = np.array(_CRC, np.uint64)


def _crc_steps(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return state >> _u(8) ^ _CRC_ARRAY[((state ^ byte) & _u(0xFF)).astype(np.intp)]


def _crc_step(state: int, byte: int) -> int:
    return state >> 8 ^ _CRC[(state ^ byte) & 0xFF]


def _fnv_steps(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return (state ^ byte) * _u(FNV_PRIME) & _u(U32)


def _hash64_steps(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    state = (state ^ byte) * _u(HASH64_PRIMES[1])
    return state << _u(31) | state >> _u(33)


def _hash64_step(state: int, byte: int) -> int:
    state = (state ^ byte) * HASH64_PRIMES[1] & U64
    return (state << 31 | state >> 33) & U64


def _hash64_end(state: np.ndarray) -> np.ndarray:
    first, second = map(_u, HASH64_PRIMES)
    state = (state ^ state >> _u(33)) * second
    state = (state ^ state >> _u(29)) * first
    return state ^ state >> _u(32)


def _masks(state: np.ndarray) -> np.ndarray:
    crc = state ^ _u(U32)
    return (crc >> _u(15) | crc << _u(17)) + _u(MASK_DELTA) & _u(U32)


crc32c = _serial(_crc_steps, _crc_step, U32, lambda s: s ^ _u(U32), np.uint32)
masked_crc32c = _serial(_crc_steps, _crc_step, U32, _masks, np.uint32)
fnv32 = _serial(_fnv_steps, lambda s, b: (s ^ b) * FNV_PRIME & U32, FNV_BASIS, lambda s: s, np.uint32)
hash64 = _serial(_hash64_steps, _hash64_step, HASH64_PRIMES[0], _hash64_end, np.uint64)


def unmasked_crc32c(masked: Column) -> Column:
    """The CRC of a masked one; JVM-side."""
    turned = F.pmod(masked.cast("long") - F.lit(MASK_DELTA), F.lit(1 << 32))
    return F.shiftleft(turned, 15).bitwiseAND(F.lit(U32)).bitwiseOR(F.shiftright(turned, 17))


def decode_varint(data: Column) -> Column:
    """The number (as a long, so modulo 2**64) whose varint `data` begins with; an error where none does.  JVM-side, ten bytes at most."""
    byte = [F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("long") for i in range(10)]
    value, ends = F.lit(0).cast("long"), F.lit(False)
    for i in reversed(range(10)):  # what follows counts only behind a byte with its high bit set
        more = byte[i] >= 128
        low = F.shiftleft(byte[i].bitwiseAND(F.lit(127)), 7 * i)
        value = F.when(more, low.bitwiseOR(value)).otherwise(low)
        last = byte[i] <= 1 if i == 9 else F.lit(True)
        ends = F.when(more, ends).otherwise((F.octet_length(data) > i) & last)
    return F.when(data.isNotNull(), F.when(ends, value).otherwise(F.raise_error(F.lit("not a varint")).cast("long")))


def encode_varint(number: Column) -> Column:
    """Varint bytes of a long, read as unsigned; JVM-side, ten bytes at most."""
    parts = []
    for i in range(10):
        low = F.shiftrightunsigned(number.cast("long"), 7 * i)
        more = F.shiftrightunsigned(low, 7) != 0
        byte = low.bitwiseAND(F.lit(127)).bitwiseOR(F.when(more, F.lit(128)).otherwise(F.lit(0)))
        if i == 9:
            byte = low.bitwiseAND(F.lit(1))
        shown = F.unhex(F.lpad(F.hex(byte), 2, "0"))
        parts.append(shown if i == 0 else F.when(low != 0, shown).otherwise(F.unhex(F.lit(""))))
    return F.concat(*parts)


def length_prefixed(data: Column) -> Column:
    return F.concat(encode_varint(F.octet_length(data)), data)


def _byte(data: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")


def _raised(byte: Column) -> Column:
    return F.unhex(F.lpad(F.hex((byte + 1).cast("long")), 2, "0"))


def separator(start: Column, limit: Column) -> Column:
    """`keys.shortest_separator` over columns."""
    at = difference_offset(start, limit)
    own, other = _byte(start, at), _byte(limit, at)
    short = F.concat(F.substring(start, F.lit(1), at), _raised(own))
    return F.when((at < F.least(F.octet_length(start), F.octet_length(limit))) & (own < 255) & (own + 1 < other), short).otherwise(start)


def successor(key: Column) -> Column:
    """`keys.short_successor` over columns."""
    full = (F.length(F.regexp_extract(F.hex(key), "^(?:FF)*", 0)) / 2).cast("int")
    return F.when(full < F.octet_length(key), F.concat(F.substring(key, F.lit(1), full), _raised(_byte(key, full)))).otherwise(key)
