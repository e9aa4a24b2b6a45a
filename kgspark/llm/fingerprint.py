"""Lempel-Ziv phrase fingerprints of documents, and their likeness to neighbours.

Method: a text is parsed left to right into the shortest phrases that its own dictionary does not have
yet (Lempel-Ziv 1978); the set of phrase hashes is the document, and its SIGNATURE smallest hashes are
the fingerprint, which is returned whole, so any two returned fingerprints can be compared (signature_of(),
likeness()).  Likeness is the share of common hashes among the SIGNATURE smallest of both sets
together: an estimate of the sets' Jaccard similarity, and exact for sets that small.

The parse of an edited text begins as that of the text itself, so the dictionary is built once up to the
place of the edit and goes on from there.

Neighbours: rows are ordered by (doc_id, text hash), nulls first, in ranges.  Ranges begin at doc_ids of the table; the rows of the doc_id at
which a range begins are sent to the range before as well (those of the first range to the last), so each task has its successor without
looking at another.  Texts are compressed before that exchange.

A doc_id of more than HOT_ROWS rows, or of a share of the table (null is one of them), has ranges of its own, which begin at
text hashes of its rows: the order is the same as that of other doc_ids.  Equal rows of such a doc_id are counted first and
travel as one; all but the last of them are followed by an equal one.

Cases: null or empty text: no phrases, and the fingerprint of the empty set; two empty sets have likeness
1, an empty and a full one 0.  Repeated doc_ids: neighbours in order of text hash.  A single document: it is
its own neighbour.  Repeated rows: a row each, neighbours of each other.  Ties (rows equal in doc_id and text) have the
same values whatever their order.  Empty table: no rows.  Very long texts: whole; a range is streamed row by row.
Columns but doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import ODD, chunks, documents, mix, powers, stage, texts_of

SIGNATURE = 128
#: Rows of a range of doc_ids, about; and the most ranges, so that their bounds stay small on the driver.
RANGE_ROWS = 1500
MOST_RANGES = 100_000
#: Rows from which a doc_id has ranges of its own, at least, and as a share of the table.
HOT_ROWS = 1 << 14
HOT_SHARE = 10_000
#: The least text hash: all of a doc_id.
LEAST = -(1 << 63)
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))


def parse(text: str, at: int, stop: int, seen: set, starts: list[int]) -> int:
    """Add the starts of phrases in text from `at` on; returns where the next phrase would begin.  A phrase
    that the end cuts short is not counted."""
    add, put = seen.add, starts.append
    to = at + 1
    while to <= stop:
        phrase = text[at:to]
        if phrase in seen:
            to += 1
        else:
            add(phrase)
            put(at)
            at = to
            to += 1
    return at


@lru_cache(maxsize=1)
def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD^place and its inverse for n places."""
    back = np.full(n, INVERSE, dtype=np.uint64)
    back[0] = 1
    return powers(n), np.multiply.accumulate(back)


class Prefix:
    """Hashes of substrings of a text: sums of (code point + 1) x ODD^place, shifted back to place 0."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        up, self.back = tables(max(1 << 17, 1 << len(codes).bit_length()))
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=self.sums[1:])

    def of(self, bounds: np.ndarray) -> np.ndarray:
        """One hash of 32 bits for each phrase between two neighbouring bounds."""
        return (mix((self.sums[bounds[1:]] - self.sums[bounds[:-1]]) * self.back[bounds[:-1]]) >> np.uint64(32)).astype(np.uint32)


def smallest(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes)[:SIGNATURE] if len(hashes) <= 4 * SIGNATURE else np.unique(np.partition(hashes, 3 * SIGNATURE)[: 3 * SIGNATURE])[:SIGNATURE]


class Parsed:
    """A text's signature, and its parse up to the place where an edit may begin."""

    def __init__(self, text: str):
        self.text, self.keep = text, len(text) - len(text) // 4
        self.seen: set[str] = set()
        self.starts: list[int] = []
        self.at = parse(text, 0, self.keep, self.seen, self.starts)
        starts = list(self.starts)
        end = parse(text, self.at, len(text), set(self.seen), starts)
        self.hashes = Prefix(text).of(np.array([*starts, end], dtype=np.int64))
        self.signature = smallest(self.hashes)

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The text with its last quarter replaced, and the signature of that; to be called once."""
        text = self.text[: self.keep] + following[: len(self.text) - self.keep]
        shared = len(self.starts)
        end = parse(text, self.at, len(text), self.seen, self.starts)
        more = Prefix(text).of(np.array([*self.starts[shared:], end], dtype=np.int64))
        return text, smallest(np.concatenate([self.hashes[:shared], more]))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SIGNATURE]
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True).sum() / len(union))


def name(s: np.ndarray) -> str:
    """The fingerprint as text: the signature's hashes, ascending, eight hexadecimal digits each."""
    return s.astype(">u4").tobytes().hex()


def signature_of(fingerprint: str) -> np.ndarray:
    """The signature that name() wrote: likeness() of two of them is that of their documents."""
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
COLUMNS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


DEALT = pa.schema([("part", pa.int32()), ("guest", pa.bool_()), ("doc_id", pa.int64()), ("order", pa.int64()), ("packed", pa.binary()), ("times", pa.int64())])


def key_of(doc: int | None, order: int) -> tuple[bool, int, int]:
    """Place of a row in the order: nulls first, then doc_id, then text hash."""
    return doc is not None, doc or 0, order


def ranges(rows: DataFrame, hot: DataFrame, hot_ids: list, n: int) -> list[tuple[bool, int, int]]:
    """Keys at which ranges begin, ascending: LEAST as text hash stands for all of a doc_id.  rows: those of other doc_ids, hot: the
    distinct rows of hot_ids."""
    of_a_range = max(RANGE_ROWS, -(-n // MOST_RANGES))
    ids = rows.select("doc_id")
    count, low, nulls = ids.agg(F.count("doc_id"), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    found = {key_of(None, LEAST)} if nulls else set()
    if count:
        parts = max(count // of_a_range, 1)
        # percentile_approx returns values of the column
        at = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * max(parts, 100)).alias("p")).first()["p"] if parts > 1 else []
        found |= {key_of(d, LEAST) for d in (low, *at)}
    if hot_ids:
        first = hot.groupBy("doc_id").agg(F.min("order").alias("order"))
        # one of of_a_range rows, chosen by hash
        some = hot.filter(F.pmod(F.xxhash64("order", F.lit(1)), F.lit(of_a_range)) == 0).select("doc_id", "order")
        found |= {key_of(*r) for r in first.union(some).collect()}
    return sorted(found)


def neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited form, and the likeness to it and to the next document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("order"))
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    hot_ids = [r["doc_id"] for r in counts.filter(F.col("n") > max(HOT_ROWS, n // HOT_SHARE)).select("doc_id").collect()]  # HOT_SHARE at most
    once = F.lit(1).cast("long").alias("times")
    if not hot_ids:
        return in_ranges(rows.select("*", once), ranges(rows, rows, hot_ids, n))
    is_hot = F.coalesce(F.col("doc_id").isin([d for d in hot_ids if d is not None]), F.lit(None in hot_ids))
    hot = stage(rows.filter(is_hot).groupBy("doc_id", "text", "order").agg(F.count("*").alias("times")), "hot-rows")
    others = rows.filter(~is_hot)
    return in_ranges(others.select("*", once).unionByName(hot), ranges(others, hot, hot_ids, n))


def compared(doc: int | None, own: Parsed, following: Parsed) -> tuple:
    """The row of a document and its successor."""
    edited, other = own.edited(following.text)
    return doc, len(own.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), name(own.signature), name(other), likeness(own.signature, other), likeness(own.signature, following.signature)


def in_ranges(rows: DataFrame, starts: list[tuple[bool, int, int]]) -> DataFrame:
    """The same for rows (doc_id, text, order, times: so many equal ones) dealt into the ranges that begin at starts."""
    n = max(len(starts), 1)
    sent = rows.sparkSession.sparkContext.broadcast(starts)

    def deal(batches):
        pack, starts = zstandard.ZstdCompressor(level=3), sent.value
        for batch in (part for whole in batches for part in chunks(whole, "text")):
            out = [[] for _ in DEALT]

            def put(*values):
                for column, value in zip(out, values):
                    column.append(value)

            for doc, text, order, times in zip(batch.column("doc_id").to_pylist(), texts_of(batch).to_pylist(), batch.column("order").to_pylist(), batch.column("times").to_pylist()):
                packed = pack.compress(text.encode("utf-8", "surrogatepass"))
                part = bisect_right(starts, key_of(doc, order)) - 1
                put(part, False, doc, order, packed, times)
                if starts[part] in (key_of(doc, order), key_of(doc, LEAST)):
                    put((part - 1) % n, True, doc, order, packed, 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, DEALT.types)], schema=DEALT)

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        out: list[list] = [[] for _ in COLUMNS]
        before = None  # (range, doc_id, parsed) that waits for its successor

        def taken():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, COLUMNS.types)], schema=COLUMNS)

        for batch in batches:
            for part, guest, doc, packed, times in zip(*(batch.column(c) for c in ("part", "guest", "doc_id", "packed", "times"))):
                part, guest, doc, times = part.as_py(), guest.as_py(), doc.as_py(), times.as_py()
                waits = before is not None and before[0] == part
                if guest and not waits:
                    continue  # only the first guest is a successor
                text = unpack.decompress(packed.as_py()).decode("utf-8", "surrogatepass")
                now = Parsed(text)
                if waits:
                    for column, value in zip(out, compared(before[1], before[2], now)):
                        column.append(value)
                before = None if guest else (part, doc, now)
                if times > 1:
                    # each but the last is followed by an equal row; edited() is for one call, so on a copy
                    same = compared(doc, Parsed(text), now)
                    for _ in range(times - 1):
                        for column, value in zip(out, same):
                            column.append(value)
                        if len(out[0]) >= 500:
                            yield taken()
                            out = [[] for _ in COLUMNS]
                if len(out[0]) >= 500:
                    yield taken()
                    out = [[] for _ in COLUMNS]
        if out[0]:
            yield taken()

    dealt = rows.select("doc_id", "text", "order", "times").mapInArrow(deal, "part int, guest boolean, doc_id long, order long, packed binary, times long")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "order").mapInArrow(run, SCHEMA)


def op8_fingerprint(spark, sf_dir):
    return neighbours(documents(spark, sf_dir))
