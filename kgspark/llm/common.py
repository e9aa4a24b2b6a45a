"""What the operators of this subpackage share: chunks of text, words, hashes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.sources.staging import drop_staged, new_path, shared_dir, stage

__all__ = ["chunks", "documents", "drop_staged", "free_names", "give_back", "held_out", "new_path", "one_row_each", "shared_dir", "stage", "texts_of", "words_of"]

#: Constants of the splitmix64 finaliser.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
ODD = np.uint64(0x9E3779B97F4A7C15)

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as it takes to differ from the table's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def one_row_each(docs: DataFrame, *keys: Column) -> DataFrame:
    """One row for each value of the keys, of several the one whose columns have the least hash.  An aggregate: repeats
    are dropped before the shuffle, so they don't meet in one task."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    names = [f"k{i}" for i in range(len(keys))]
    rows = docs.select(*[k.alias(n) for k, n in zip(keys, names)], whole.alias("row"), hashed.alias("hash"))
    return rows.groupBy(*names).agg(F.min_by("row", "hash").alias("row")).select("row.*")


def give_back() -> None:
    """Return freed memory to the system: the allocators keep it, and on the driver it stands beside the JVM's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def held_out(doc_id):
    """True where crc32 of doc_id as text leaves no remainder by 5: labels of these rows are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def chunks(batch: pa.RecordBatch, column: str, max_bytes: int = 3 << 20):
    """Slices of a batch whose texts have about max_bytes together; one row at least in each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    a = batch.column(column)
    if not pa.types.is_large_string(a.type):
        a = a.cast(pa.large_string())
    return pc.fill_null(a, "")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without the code points 9-13 and 32) of the texts in order, and each word's row."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    rows = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():
        flat, rows = flat.filter(full), rows[keep]
    return flat, rows


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * MIX[0]
    h = h ^ (h >> np.uint64(27))
    h = h * MIX[1]
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), ODD, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in one array, and where each word starts (with the end as last)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    return codes, starts


def hash_words(words: list[str]) -> np.ndarray:
    """One uint64 a word: a polynomial over its code points, mixed.  Words must not be empty."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes, starts = code_points(words)
    lengths = np.diff(starts)
    place = np.arange(len(codes)) - np.repeat(starts[:-1], lengths)
    sums = np.add.reduceat((codes + np.uint64(1)) * powers(int(lengths.max()))[place], starts[:-1])
    return mix(sums ^ lengths.astype(np.uint64) * MIX[1])


def sums_by(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)[:n]


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
