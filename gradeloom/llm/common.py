"""Helpers shared by the operators of this subpackage.

Texts reach Python as Arrow batches. They are worked on as one array of bytes:
lower-casing, splitting and hashing are array operations, so no Python code runs
per character. Work is cut into blocks of whole texts of about ``BLOCK`` bytes,
which bounds the memory of a task; only a single longer text makes a larger one.
"""

from __future__ import annotations

import builtins
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gradeloom.session import scratch_path

BLOCK = 2 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.RandomState(11).randint(1, 2**63 - 1, size=256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker.

    Functions travel to tasks by value, so a module-level variable would start
    anew in every task.
    """
    return builtins.__dict__.setdefault("_gradeloom_worker_cache", {})


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the argument changes half the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Of every byte at the first 64 places of a word; those beyond are computed when met.
_PLACE_CODES = mix64(mix64(np.arange(64 * 256, dtype=np.uint64) * _ODD) + _ODD)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and the offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    if pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, bounds


def blocks(bounds: np.ndarray, most: int = BLOCK, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of texts, each of ``most`` bytes and ``rows`` texts at most unless one text is longer."""
    n, start = len(bounds) - 1, 0
    while start < n:
        stop = int(np.searchsorted(bounds, bounds[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), start + rows, n)
        yield start, stop
        start = stop


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache()
    if "powers" not in cache or len(cache["powers"][0]) < n:
        size = max(n, BLOCK + 1)
        out = []
        for base in (_BASE, _BASE_INVERSE):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        if size > 4 * BLOCK:
            return tuple(out)
        cache["powers"] = tuple(out)
    return cache["powers"]


def running_sums(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes' codes times the powers of a base, from the left."""
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_CODES[data] * _powers(len(data))[0][: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end), from their ``running_sums``."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    inverse = _powers(len(sums) - 1)[1]
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words [start, end), which do not overlap.

    Every byte counts with a random value of its own for every place in the word,
    so unlike the hashes of spans these have no algebra by which words collide.
    """
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
    code = data[place + np.repeat(starts, sizes)].astype(np.int64) + 256 * place
    values = _PLACE_CODES[np.minimum(code, len(_PLACE_CODES) - 1)]
    far = np.flatnonzero(code >= len(_PLACE_CODES))
    values[far] = mix64(mix64(code[far].astype(np.uint64) * _ODD) + _ODD)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    return mix64(sums[before + sizes] - sums[before] + sizes.astype(np.uint64) * _ODD)


def runs_of(kept: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``True``; runs end at the cuts between texts."""
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    last = kept.copy()
    last[:-1] &= ~kept[1:]
    inner = cuts[1:-1]
    inner = inner[(inner > 0) & (inner < len(kept))]
    first[inner] = kept[inner]
    last[inner - 1] = kept[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts, A-Z lower-cased.

    Returns the bytes, the starts and ends of the words in them, the hashes of
    the words and, per text, the number of the first word (one entry more).
    """
    data = LOWER[raw[bounds[0] : bounds[-1]]]
    cuts = bounds - bounds[0]
    starts, ends = runs_of(~_SPACE[data], cuts)
    return data, starts, ends, word_hashes(data, starts, ends), np.searchsorted(starts, cuts)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words; runs may cross texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for j in range(1, size):
        out *= _ODD
        out += words[j : j + n]
    return mix64(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one after the other."""
    total = int(counts.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total) + shift


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet under the shared checkpoint folder and read back.

    Executors that are lost later cost a read, not a recomputation. Nothing reads the
    shuffles of the write again, so their files go with its end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a frame made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
