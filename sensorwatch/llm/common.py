"""Shared pieces: Arrow passes, tables in the cluster's shared folder, word hashes in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
# Word separators of the word-based operators: space and the control characters 9 to 13.
SPACES = bytes([32, 9, 10, 11, 12, 13])
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Unset, a temporary one serves a local session only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_written: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: a lost executor costs a re-read only."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete work tables (as ``written`` returned them) that later work tables have taken the place of; nothing may read them any more."""
    for df in tables:
        if df.work_path in _written:
            _written.remove(df.work_path)
            _delete(df.sparkSession, df.work_path)


def clear(spark: SparkSession) -> None:
    """Delete the work tables this session has written, once their results are stored elsewhere."""
    while _written:
        _delete(spark, _written.pop())


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]], schema: str | StructType, rows: int = 512) -> DataFrame:
    """One Arrow pass; ``fn`` turns up to ``rows`` rows at a time into column arrays."""
    names = schema.fieldNames() if isinstance(schema, StructType) else StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_arrays(fn(batch.slice(low, rows)), names=names)

    return df.mapInArrow(run, schema)


def binary(rows: list[bytes | None]) -> pa.Array:
    return pa.array(rows, pa.binary())


def python_texts(column: pa.Array) -> list[str]:
    """Texts as Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


# ---------------------------------------------------------------- words in numpy

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED = _BYTE[_LOWER]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_IS_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept per worker."""
    if which not in _powers or len(_powers[which]) < n:
        steps = np.full(max(n, 1 << 20), _BASE if which == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """Words of consecutive documents: hashes, byte spans and each document's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, prefixes: tuple[int, ...] = (), letters: bool = False):
        """``letters``: every ASCII byte but letters and digits separates; ``prefixes``: also hash so many first bytes."""
        n = len(data)
        self.data, self.offsets = data, offsets
        word = _IS_LETTER[data] if letters else ~_IS_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, word[:-1]
            after[-1], after[:-1] = False, word[1:]
        self.start = np.flatnonzero(word & (~before | edge[:n]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWERED if lower else _BYTE)[data] * _power("up", n), out=total[1:])
        back = _power("down", max(n, 1))
        self.hash = mix((total[self.end] - total[self.start]) * back[self.start]) if n else np.zeros(0, np.uint64)
        stops = [np.minimum(self.start + p, self.end) for p in prefixes]
        self.prefixes = [mix((total[s] - total[self.start]) * back[self.start]) if n else np.zeros(0, np.uint64) for s in stops]
        self.first = np.searchsorted(self.start, offsets)


def word_hash(word: str) -> int:
    """The hash that ``Words`` gives a single lower-case word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Words(data, np.array([0, len(data)])).hash[0])


def text_chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts, about ``most`` bytes each (one text at least)."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high, whole[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and each document's first one; a shorter document is one shingle."""
    h, first = words.hash, words.first
    n = len(h)
    counts = np.diff(first)
    rolled = np.full(n, U64(k), np.uint64)
    for j in range(k):
        rolled[: max(n - j, 0)] = rolled[: max(n - j, 0)] * U64(0xD6E8FEB86659FD93) + h[j:]
    rolled = mix(rolled)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        value = int(counts[d])
        for w in h[first[d] : first[d + 1]]:
            value = (value * 0xD6E8FEB86659FD93 + int(w)) % 2**64
        rolled[first[d]] = mix(np.array([value], np.uint64))[0]
    keep = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(made)[:-1]]), made) + np.arange(int(made.sum()))
    return rolled[keep], np.concatenate([[0], np.cumsum(made)])


def count_words(column: str | object):
    """Words of a text column (null: none), JVM side."""
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
