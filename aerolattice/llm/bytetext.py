"""Whole Arrow text columns as flat bytes: words, hashes and bounded slices, without a Python loop over characters.

Texts are handled as UTF-8. Lower-casing touches A-Z only, and a null text is an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 16

U = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Spark's setting for the bytes of an Arrow batch, its default, and the bound for operators that hold several forms of a
#: batch at once (text, hashes, arrays): with the default a batch of ordinary texts is ten thousand rows whatever they hold.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT = 64 << 20
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, or of one row if that is longer; a session that sets its own bound keeps it."""
    if spark.conf.get(BATCH_SETTING, None) in (None, f"{BATCH_DEFAULT}b"):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by their exact place even if other columns differ from them in case alone."""
    if all([c.lower() for c in df.columns].count(name.lower()) == 1 for name in names):
        return df.select(*names)
    spread = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return spread.select(*[F.col(f"_c{df.columns.index(name)}").alias(name) for name in names])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


GOLDEN = U(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    BYTE_CODE = mix((np.arange(256, dtype=np.uint64) + U(1)) * GOLDEN)
BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.ones(1, dtype=np.uint64)
        step = base
        while len(out) < count:
            out = np.concatenate([out, out * U(step)])
            step = step * step % (1 << 64)
    return out


_tables: dict[str, np.ndarray] = {}


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < count:
        _tables["up"], _tables["down"] = _powers(BASE, count), _powers(BASE_INVERSE, count)
    return _tables["up"], _tables["down"]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that are no part of a word: the space and \x09-\x0D.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that are no part of a word of letters and digits, after lower-casing: all ASCII but 0-9 and a-z.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(48, 58), *range(97, 123)]] = False


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the n + 1 places at which its values begin and end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def slices(data: np.ndarray, places: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole values of about `limit` bytes, or one longer value: first, end, bytes, places."""
    first, count = 0, len(places) - 1
    while first < count:
        end = max(first + 1, int(np.searchsorted(places, places[first] + limit, "right")) - 1)
        yield first, end, data[places[first] : places[end]], places[first : end + 1] - places[first]
        first = end


def words(data: np.ndarray, places: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the places of each value's first word among them."""
    inside = ~gaps[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[places] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[places] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, places)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of code(byte k) * BASE^k over i <= k < j."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand.

    Long spans can be made to collide on purpose: use it where equal hashes are compared again or only name features.
    """
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


#: Spans of more bytes are hashed one by one.
LONG = 64
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, eight bytes a step, each mixed in before the next.

    Unlike sums of powers, which have spans of equal hash that anybody can write down, nothing but chance makes two equal.
    """
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    with np.errstate(over="ignore"):
        out = mix(sizes.astype(np.uint64) * GOLDEN + U(1))
        at, done = np.flatnonzero((sizes > 0) & (sizes <= LONG)), 0
        while len(at):
            rest = sizes[at] - done
            taken = eight[starts[at] + done] & LOW_BYTES[np.minimum(rest, 8)]
            out[at] = mix((out[at] ^ taken) * U(0x9FB21C651E98DF25) + GOLDEN)
            at, done = at[rest > 8], done + 8
    for i in np.flatnonzero(sizes > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def word_hashes(data: np.ndarray, places: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all values, and the places of each value's first word among them."""
    data = LOWER[data]
    starts, ends, at = words(data, places, gaps)
    return byte_hashes(data, starts, ends), at


def shingle_hashes(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of each value (all its words if fewer, none without words), and their places."""
    counts = np.diff(at)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(hashes), np.uint64)
        for k in range(n):
            rolled[: len(hashes) - k] = mix(rolled[: len(hashes) - k] * U(3) + hashes[k:] + U(k + 1))
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes)) - at[:-1][owner]
    keep = place + n <= counts[owner]
    short = np.flatnonzero((counts > 0) & (counts < n))
    for doc in short:
        value = U(0)
        with np.errstate(over="ignore"):
            for k, h in enumerate(hashes[at[doc] : at[doc + 1]]):
                value = mix(np.array([value * U(3) + h + U(k + 1)], np.uint64))[0]
        rolled[at[doc]] = mix(np.array([value ^ U(int(counts[doc]))], np.uint64))[0]
        keep[at[doc]] = True
    sizes = np.bincount(owner[keep], minlength=len(counts)) if len(owner) else np.zeros(len(counts), np.int64)
    return rolled[keep], np.concatenate([[0], np.cumsum(sizes)])


def text_list(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]
