"""Near-duplicate documents by SimHash fingerprints and a pigeonring search.

Fingerprint: every run of `shingle` words (repeats included) is hashed; a bit is 1 if more than half of the
hashes have it.  Fingerprints at `max_bits` differing bits or fewer link; documents of linked
fingerprints are one component.

Method: 64 bits are cut into a ring of max_bits + k segments.  With at most max_bits differing bits, k
segments at least are equal, so each fingerprint is filed under every choice of k segments, and only
fingerprints that meet in such a bucket are looked at.  There the pigeonring filter comes first: for some
start, each chain of the next n segments must differ in no more than n x max_bits / segments bits.  What
passes has its full distance taken.

Scale: fingerprints are grouped first, so copies of one text cost one row however many there are.  k is
chosen from the number of distinct fingerprints by the expected work of filing against comparing (exact
for every k).  A bucket is searched as a growing component: what is linked leaves the unvisited rest, so a
dense group of n near copies costs about n comparisons of blocks and yields n - 1 links, never all
pairs.  Buckets expected above `split` rows are dealt to several tasks in pairs of blocks, so no task
holds more than two blocks.  Components come from alternating star contractions on links written to the
shared folder; nothing of the corpus reaches the driver but counts.

Cases: no words (null, empty, blank): fingerprint 0, linked like any other.  Fewer words than a shingle:
the whole sequence is the one shingle.  Null doc_id: such a document takes part; component_id is the
smallest doc_id that is not null, or null if there is none.  Repeated rows: a row each.  Ties: exactly half of the
hashes with a bit leave it 0.  Empty table: no rows.  Very long texts: hashed in blocks, so memory is bounded by the
text itself.  Columns but doc_id and text, whatever their names, are not read; deduplicate() returns them as they are.

Deduplication (deduplicate()) keeps one document of each group of similar sets of shingles.  There, candidates meet in the
bands of a MinHash and each link is decided by the exact similarity of the two sets.
"""

from __future__ import annotations

import itertools
import re
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import ODD, arrow_rows, chunks, documents, free_names, mix, one_row_each, stage, texts_of

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Rows of a bucket from which it is dealt to several tasks.
SPLIT = 20_000
#: Share of fingerprints by which such buckets are found: one in SAMPLE.
SAMPLE = 64
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BLOCK = 1 << 15
#: Rows of a bucket up to which all its pairs are looked at, and pairs looked at together.
SMALL = 512
PAIRS = 1 << 18
#: Further words of 64 bits in a wide fingerprint.
WIDE = 3


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


PRINTS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64()), ("size", pa.int32()), ("wide", pa.binary())])
PRINTS_DDL = "doc_id long, key long, fp long, size int, wide binary"


def wide_majority(hashes: np.ndarray) -> bytes:
    """The fingerprint's 64 bits and WIDE x 64 more from other hashes of the same shingles."""
    more = [hashes] + [mix(hashes + np.uint64(n * int(ODD) % 2**64)) for n in range(1, WIDE + 1)]
    return b"".join(majority(h).to_bytes(8, "little") for h in more)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, wide: bool = False) -> DataFrame:
    """doc_id, key (a hash of the text), fp (the fingerprint as a signed long), size (number of shingles) and,
    if asked for, wide (the longer fingerprint): no shuffle."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [shingle_hashes(t, shingle) for t in texts_of(part).cast(pa.large_binary()).to_pylist()]
                prints = np.array([majority(h) for h in found], dtype=np.uint64)
                more = [wide_majority(h)[8:] if wide else None for h in found]
                yield arrow_rows(PRINTS, doc_id=part.column("doc_id"), key=part.column("key"), fp=prints.view(np.int64), size=np.array([len(h) for h in found], dtype=np.int32), wide=more)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key")).mapInArrow(run, PRINTS_DDL)


def cuts_of(segments: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment of the ring."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def choose_exact(n: int, max_bits: int) -> int:
    """Number of equal segments in a key with the least expected work for n fingerprints; two at least, as
    one segment gives few and large buckets."""

    def work(k: int) -> float:
        # filing a row costs about as much as 250 comparisons
        return comb(max_bits + k, k) * n * (250 + n / 2 / 2 ** (64 * k / (max_bits + k)))

    return min((k for k in range(2, 7) if comb(max_bits + k, k) < 1 << 11), key=work)


def segment_values(fp: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    return np.stack([(fp >> np.uint64(a)) & np.uint64((1 << n) - 1) for a, n in cuts])


#: The number of the choice stands above these bits of a key, the chosen segments below.
KEY_BITS = 52


def filed(prints: DataFrame, max_bits: int, k: int) -> DataFrame:
    """One row for each choice of k of the segments: key, fp, size, wide."""
    cuts = cuts_of(max_bits + k)
    choices = list(itertools.combinations(range(len(cuts)), k))
    schema = pa.schema([("key", pa.int64()), *(PRINTS.field(c) for c in ("fp", "size", "wide"))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                values = segment_values(part.column("fp").to_numpy().view(np.uint64), cuts)
                for c, choice in enumerate(choices):
                    key = np.zeros(part.num_rows, dtype=np.uint64)
                    for s in choice:
                        key = (key << np.uint64(cuts[s][1])) | values[s]
                    key |= np.uint64(c << KEY_BITS)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(part.column(x) for x in ("fp", "size", "wide"))], schema=schema)

    return prints.select("fp", "size", "wide").mapInArrow(run, "key long, fp long, size int, wide binary")


class Prints:
    """Fingerprints of a bucket with what a link also depends on."""

    def __init__(self, fp: np.ndarray, size: np.ndarray, wide: np.ndarray | None):
        self.fp, self.size, self.wide = fp, size, wide

    def __getitem__(self, at) -> Prints:
        return Prints(self.fp[at], self.size[at], None if self.wide is None else self.wide[at])

    def __len__(self) -> int:
        return len(self.fp)


class Ring:
    """Which fingerprints link.  wide_bits: what wide fingerprints may differ by altogether; similarity: the
    least ratio of the numbers of shingles."""

    def __init__(self, max_bits: int, k: int, similarity: float = 0.0, wide_bits: int | None = None):
        self.max_bits, self.cuts, self.similarity, self.wide_bits = max_bits, cuts_of(max_bits + k), similarity, wide_bits
        self.choices = list(itertools.combinations(range(max_bits + k), k))
        self.budget = [n * max_bits // len(self.cuts) for n in range(len(self.cuts) + 1)]

    def segment(self, x: np.ndarray, s: int) -> np.ndarray:
        first, bits = self.cuts[s % len(self.cuts)]
        return np.bitwise_count((x >> np.uint64(first)) & np.uint64((1 << bits) - 1))

    def chains(self, x: np.ndarray, starts) -> np.ndarray:
        """Places in x (differing bits) where, from one of the starts, the chain of each length is within
        its budget.  A start must be an equal segment, so in a bucket the bucket's own segments do: among
        the choices of k equal segments of a pair, one has its good start."""
        found = np.zeros(len(x), dtype=bool)
        for start in starts:
            at = np.flatnonzero(~found)
            total = np.zeros(len(at), dtype=np.uint8)
            for n in range(1, len(self.cuts) + 1):
                total = total + self.segment(x[at] if n > 1 or found.any() else x, start + n - 1)
                within = total <= self.budget[n]
                at, total = at[within], total[within]
                if not len(at):
                    break
            found[at] = True
        return np.flatnonzero(found)

    def check(self, a: Prints, i: np.ndarray, b: Prints, j: np.ndarray, starts) -> np.ndarray:
        """Which of the pairs (a[i], b[j]) link, as positions: chains first, then full distances."""
        x = a.fp[i] ^ b.fp[j]
        at = self.chains(x, starts)
        at = at[np.bitwise_count(x[at]) <= self.max_bits]
        if self.similarity and len(at):
            m, n = a.size[i[at]], b.size[j[at]]
            at = at[np.minimum(m, n) >= self.similarity * np.maximum(m, n)]
        if self.wide_bits is not None and len(at):
            far = np.bitwise_count(a.fp[i[at]] ^ b.fp[j[at]]).astype(np.int64) + np.bitwise_count(a.wide[i[at]] ^ b.wide[j[at]]).sum(axis=1, dtype=np.int64)
            at = at[far <= self.wide_bits]
        return at

    def linked(self, a: Prints, b: Prints, starts) -> np.ndarray:
        out = np.zeros((len(a), len(b)), dtype=bool)
        i, j = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
        at = self.check(a, i, b, j, starts)
        out[i[at], j[at]] = True
        return out

    def small(self, p: Prints, starts_at: np.ndarray, ends: np.ndarray, starts) -> tuple[np.ndarray, np.ndarray]:
        """All links of many buckets of one choice, each of at most SMALL rows: their pairs in one array, a
        bounded number at a time."""
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        sizes = ends - starts_at
        pairs = np.cumsum(sizes * (sizes - 1) // 2)
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + PAIRS, side="right")))
            rows = np.concatenate([np.arange(s, e) for s, e in zip(starts_at[at:to].tolist(), ends[at:to].tolist())])
            after = np.repeat(ends[at:to], sizes[at:to]) - rows - 1  # partners that follow in the bucket
            i = np.repeat(rows, after)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
            hit = self.check(p, i, p, j, starts)
            left.append(i[hit])
            right.append(j[hit])
            at = to
        return np.concatenate(left), np.concatenate(right)

    def forest(self, p: Prints, starts) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect what is connected in this bucket: at most one less than its rows."""
        left: list = [np.zeros(0, dtype=np.int64)]
        right: list = [np.zeros(0, dtype=np.int64)]
        lonely = np.ones(len(p), dtype=bool)

        def rows_against(n: int) -> int:
            return max(1, min(256, 4 * PAIRS // max(n, 1)))

        # first drop what has no neighbour at all, block by block; who is known to have one is not asked again,
        # so the others are compared with all rows and not only with later ones
        blocks = range(0, len(p), rows_against(len(p)))
        for at in blocks:
            block = np.arange(at, min(at + blocks.step, len(p)))
            block = block[lonely[block]]
            if len(block):
                m = self.linked(p[block], p, starts)
                m[np.arange(len(block)), block] = False
                lonely[block] &= ~m.any(axis=1)
                lonely &= ~m.any(axis=0)
        # then grow components; what is reached is not compared with each other
        rest = np.flatnonzero(~lonely)
        while len(rest):
            front, rest = rest[:1], rest[1:]
            while len(front) and len(rest):
                n = rows_against(len(rest))
                block, front = front[:n], front[n:]
                m = self.linked(p[block], p[rest], starts)
                hit = m.any(axis=0)
                left.append(block[np.argmax(m[:, hit], axis=0)])
                right.append(rest[hit])
                front, rest = np.r_[front, rest[hit]], rest[~hit]
        return np.concatenate(left), np.concatenate(right)


def spanning(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of these links a set without circles that connects the same."""
    parent: dict[int, int] = {}
    kept = []
    for n, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        while (x := parent.get(a, a)) != a:
            parent[a] = parent.get(x, x)
            a = x
        while (x := parent.get(b, b)) != b:
            parent[b] = parent.get(x, x)
            b = x
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(n)
    return left[kept], right[kept]


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def bucket_links(rows: DataFrame, ring: Ring, by: list[str]) -> DataFrame:
    """rows, dealt and sorted by `by`: links within each bucket.  A bucket is what lies between two changes of
    the `by` columns; batches are joined only as far as one bucket reaches."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table):
            columns = {c: table.column(c).to_numpy() for c in {*by, "key", "fp", "size"}}
            fp = columns["fp"]
            wide = None
            if ring.wide_bits is not None:
                wide = np.frombuffer(b"".join(table.column("wide").to_pylist()), dtype="<u8").reshape(len(fp), -1)
            p = Prints(fp.view(np.uint64), columns["size"].astype(np.int64), wide)
            change = np.zeros(len(fp), dtype=bool)
            change[0] = True
            for c in by:
                change[1:] |= columns[c][1:] != columns[c][:-1]
            starts = np.flatnonzero(change)
            ends = np.r_[starts[1:], len(fp)]
            out_a, out_b = [], []
            choice = columns["key"][starts] >> KEY_BITS
            for c in np.unique(choice).tolist():
                of = choice == c
                few, many = of & (ends - starts <= SMALL), of & (ends - starts > SMALL)
                i, j = spanning(*ring.small(p, starts[few], ends[few], ring.choices[c]))
                out_a.append(fp[i])
                out_b.append(fp[j])
                for s, e in zip(starts[many].tolist(), ends[many].tolist()):
                    i, j = ring.forest(p[s:e], ring.choices[c])
                    out_a.append(fp[s:e][i])
                    out_b.append(fp[s:e][j])
            yield arrow_rows(LINKS, a=np.concatenate(out_a), b=np.concatenate(out_b))

        def key_at(table, i):
            return tuple(table.column(c)[i].as_py() for c in by)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            first, last = key_at(batch, 0), key_at(batch, batch.num_rows - 1)
            if first == last:
                continue
            table = pa.Table.from_batches(held)
            # the last bucket may go on in the next batch
            lead = pa.table({c: batch.column(c) for c in by})
            same = np.ones(batch.num_rows, dtype=bool)
            for c, v in zip(by, last):
                same &= lead.column(c).to_numpy() == v
            tail = int(np.argmax(same))
            yield from solve(table.slice(0, table.num_rows - batch.num_rows + tail))
            held = [batch.slice(tail)]
        if held:
            yield from solve(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a long, b long")


def links(prints: DataFrame, max_bits: int = MAX_BITS, similarity: float = 0.0, wide_bits: int | None = None, split: int = SPLIT, exact: int | None = None) -> DataFrame:
    """prints: distinct fingerprints (fp, size, wide) -> links (a, b) that connect all linked ones."""
    n = prints.count()
    k = exact or choose_exact(n, max_bits)
    ring = Ring(max_bits, k, similarity, wide_bits)
    rows = filed(prints, max_bits, k)
    part = filed(prints.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0), max_bits, k)
    hot = stage(part.groupBy("key").count().filter(F.col("count") * SAMPLE > split).select("key", F.ceil(F.col("count") * SAMPLE / split).cast("int").alias("blocks")), "hot")
    if hot.isEmpty():
        dealt = rows.repartition("key").sortWithinPartitions("key")
        return bucket_links(dealt, ring, ["key"])
    # a hot bucket becomes tasks (i, j), i <= j, of its blocks; each row goes to those of its own block
    one = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    one = one.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one = one.select("key", "fp", "size", "wide", F.least(own, F.col("other")).alias("i"), F.greatest(own, F.col("other")).alias("j"))
    dealt = one.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return bucket_links(dealt, ring, ["key", "i", "j"])


def components(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) -> node, root: the smallest node of each component, by alternating large and small
    stars.  Each round is an aggregate and a join on the node; hubs are split by adaptive execution."""
    both = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    now = stage(pairs.filter(F.col("a") != F.col("b")).select(*both).distinct(), "links")
    seen = None
    while True:
        # large star: every higher neighbour of a node goes to the node's lowest neighbour (or itself)
        around = now.select(F.col("low").alias("u"), F.col("high").alias("v")).union(now.select(F.col("high").alias("u"), F.col("low").alias("v")))
        lowest = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = around.filter(F.col("v") > F.col("u")).join(lowest, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).filter(F.col("low") != F.col("high")).distinct()
        # small star: a node and its lower neighbours go to the lowest of them
        lowest = large.groupBy(F.col("high").alias("h")).agg(F.min("low").alias("m"))
        moved = large.join(lowest, large["high"] == lowest["h"])
        small = moved.select(F.col("m").alias("x"), F.col("low").alias("y")).union(lowest.select(F.col("m").alias("x"), F.col("h").alias("y")))
        now = stage(small.filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).distinct(), "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("high").alias("node"), F.col("low").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, similarity: float = 0.0, wide_bits: int | None = None) -> DataFrame:
    """doc_id, key, fp, component_id of every document."""
    prints = stage(fingerprints(docs, shingle, wide_bits is not None), "prints")
    same = ["fp"] if wide_bits is None else ["fp", "wide"]
    each = prints.groupBy(*same).agg(F.min("doc_id").alias("first"), F.max("size").alias("size"))
    if wide_bits is None:
        each = each.withColumn("wide", F.lit(None).cast("binary"))
    each = stage(each, "distinct")
    roots = components(links(each, max_bits, similarity, wide_bits))
    joined = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.select("fp", "root").distinct().join(ids, "root").select(F.col("fp").alias("__fp"), "component_id", "root")
    return prints.join(named, prints["fp"] == named["__fp"]).select("doc_id", "key", "fp", "component_id", "root")


#: For a stage that keeps one document of each group: the shingles of a set and the least Jaccard similarity.
SIMILAR = {"shingle": 5, "similarity": 0.8}
#: Bands of a MinHash and values in each: a pair of similarity 0.8 shares a band in all but 5 of 100,000 cases.
BANDS = 25
ROWS = 5
#: Members of a bucket, and shingles of them all, that a task compares with as many others.
MEMBERS = 1024
ITEMS = 1 << 20

SKETCHES = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64()), ("print", pa.int64()), ("size", pa.int32()), ("bands", pa.list_(pa.int64()))])
SKETCHES_DDL = "doc_id long, key long, fp long, print long, size int, bands array<long>"
_N = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)
_TIMES, _PLUS = (mix(_N * ODD) | np.uint64(1))[:, None], mix(_N * ODD + ODD)[:, None]


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band; two sets share a band's with the chance of their similarity to the power of ROWS."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[None, at : at + 1024] * _TIMES + _PLUS).min(axis=1), out=least)
    values = mix(least + _N).reshape(BANDS, ROWS)
    return mix((values * _TIMES[:ROWS, 0]).sum(axis=1, dtype=np.uint64) + _N[:BANDS])


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, key (a hash of the text), fp (a hash of the set of shingles), print (the fingerprint of the shingles), size (of that
    set) and bands."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                prints, sets = [], []
                for t in texts_of(part).cast(pa.large_binary()).to_pylist():
                    h = shingle_hashes(t, shingle)
                    prints.append(majority(h))
                    sets.append(np.unique(h))
                fp = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) if len(h) else 0 for h in sets], dtype=np.uint64)
                bands = [band_keys(h).view(np.int64) if len(h) else [] for h in sets]
                yield arrow_rows(SKETCHES, doc_id=part.column("doc_id"), key=part.column("key"), fp=fp.view(np.int64), print=np.array(prints, dtype=np.uint64).view(np.int64), size=np.array([len(h) for h in sets], dtype=np.int32), bands=bands)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key")).mapInArrow(run, SKETCHES_DDL)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """fp, text -> fp, items (the set of shingles)."""
    schema = pa.schema([("fp", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts_of(part).cast(pa.large_binary()).to_pylist()]
                yield arrow_rows(schema, fp=part.column("fp"), items=sets)

    return texts.select("fp", "text").mapInArrow(run, "fp long, items array<long>")


def links_across(table: pa.Table, similarity: float) -> pa.RecordBatch:
    """Links between members (fp, root, half, items) of different roots; if there are two halves, one end in
    each.  What a link has connected is not compared again."""
    fp, half = table.column("fp").to_numpy(), table.column("half").to_numpy()
    _, group = np.unique(table.column("root").to_numpy(), return_inverse=True)
    items = table.column("items").combine_chunks()
    starts = items.offsets.to_numpy() - items.offsets[0].as_py()
    words, codes = np.unique(items.flatten().to_numpy(), return_inverse=True)
    sizes = np.diff(starts)
    two = half.min() != half.max()
    a, b = [], []
    for i in range(len(fp)):
        able = (group != group[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]))
        able &= half > half[i] if two else np.arange(len(fp)) > i
        if not able.any():
            continue
        mark = np.zeros(len(words), dtype=np.int64)
        mark[codes[starts[i] : starts[i + 1]]] = 1
        both = np.add.reduceat(mark[codes], starts[:-1])
        for j in np.flatnonzero(able & (both >= similarity * (sizes + sizes[i] - both))).tolist():
            if group[i] != group[j]:
                a.append(fp[i])
                b.append(fp[j])
                group[group == group[j]] = group[i]
    return arrow_rows(LINKS, a=np.array(a, dtype=np.int64), b=np.array(b, dtype=np.int64))


def in_parts(n) -> Column:
    """Parts in which a set goes out that n others are compared with, so no task meets them all."""
    return F.greatest(F.lit(1), F.pow(F.lit(2.0), F.ceil(F.log2(n / MEMBERS)))).cast("int")


def by_fingerprints(each: DataFrame, max_bits: int) -> DataFrame:
    """each: distinct sets (fp, print, size) -> a, b, parts, part: a set, and the print whose first set (the least fp) it is to be compared
    with: its own, or one that the search links to it, then a is a first set, too.  In a bucket's links the first end is what many are linked
    to, so that one is b and goes out in parts."""
    firsts = each.groupBy("print").agg(F.min("fp").alias("first"), F.max("size").alias("size"))
    of_print = stage(firsts.select(F.col("print").alias("fp"), "size", F.lit(None).cast("binary").alias("wide"), "first"), "firsts")
    found = links(of_print.drop("first"), max_bits).select(F.col("b").alias("__a"), F.col("a").alias("b")).distinct()
    apart = found.join(of_print.select(F.col("fp").alias("__a"), F.col("first").alias("a")), "__a").select("a", "b")
    equal = each.select(F.col("fp").alias("a"), F.col("print").alias("b")).join(of_print.select(F.col("first").alias("a")), "a", "left_anti")
    pairs = stage(apart.unionByName(equal), "met")
    # one row for each MEMBERS pairs at most
    hubs = pairs.groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") > MEMBERS).select("b", in_parts(F.col("n")).alias("parts"))
    pairs = pairs.join(stage(hubs, "hubs"), "b", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return pairs.select("a", "b", "parts", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))


def alike(pairs: DataFrame, sets: DataFrame, asked: DataFrame, similarity: float) -> DataFrame:
    """a, b: those of the pairs (a, b, parts, part) that the sets (fp, items) decide to be links; asked: b, fp and items of what is compared."""
    each = pairs.select("b", "parts").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = pairs.join(sets.select(F.col("fp").alias("a"), F.col("items").alias("x")), "a")
    right = each.join(asked.select("b", F.col("fp").alias("__b"), F.col("items").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    met = left.join(right, ["b", "parts", "part"]).filter(both >= similarity * (F.size("x") + F.size("y") - both))
    return met.select(F.least("a", "__b").alias("a"), F.greatest("a", "__b").alias("b"))


def similar_groups(docs: DataFrame, shingle: int, similarity: float, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, key, root of every document; one root for what is linked by a Jaccard similarity of the sets of shingles.

    Fingerprints come first: the search of near_duplicates() names pairs at max_bits differing bits or fewer.  A similarity of 0.8 is
    about ten bits apart, further than that search can go, so sets that share a band of their MinHash meet in a bucket, too.
    All members of a bucket are compared with two of them; only in buckets that this and the fingerprints' links leave in several components
    are all members of different components compared, too.  Every link is decided on the sets themselves."""
    prints = stage(sketches(docs, shingle), "sketches")
    each = stage(prints.groupBy("fp").agg(F.min("print").alias("print"), F.max("size").alias("size"), F.first("bands").alias("bands")), "distinct")
    # texts without words have one fp
    near_prints = stage(by_fingerprints(each.filter("size > 0").select("fp", "print", "size"), max_bits), "near-prints")
    filed = each.select("fp", "size", F.explode("bands").alias("bucket"))
    one = F.struct("fp", "size")
    buckets = filed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("items"), F.min(one).alias("low"), F.max(one).alias("high"), F.bit_xor(F.xxhash64("fp")).alias("mark")).filter("n > 1")
    # buckets with the same members count once
    buckets = buckets.groupBy("n", "items", "low", "high", "mark").agg(F.min("bucket").alias("bucket")).drop("mark")
    members = stage(filed.join(buckets, "bucket"), "members")

    firsts = each.filter("size > 0").groupBy("print").agg(F.min("fp").alias("fp"))
    asked = firsts.join(near_prints.select(F.col("b").alias("print")).distinct(), "print", "left_semi")
    needed = members.select("fp").union(near_prints.select("a")).union(asked.select("fp")).distinct()
    reps = prints.join(needed, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id", "key")).alias("r"))
    reps = reps.select("fp", F.col("r.doc_id").alias("__doc"), F.col("r.key").alias("__key"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("key"), "text")
    texts = texts.join(reps, texts["doc"].eqNullSafe(F.col("__doc")) & (texts["key"] == F.col("__key"))).groupBy("fp").agg(F.first("text").alias("text"))
    sets = stage(shingle_sets(texts, shingle), "sets")

    near = F.least("size", "other.size") >= similarity * F.greatest("size", "other.size")
    # the two that all are compared with go out in parts, as many as their bucket is large
    ends = F.explode(F.array("low", "high")).alias("other")
    pairs = members.select("fp", "size", ends, in_parts(F.col("n")).alias("parts")).filter((F.col("fp") != F.col("other.fp")) & near)
    pairs = pairs.select(F.col("fp").alias("a"), F.col("other.fp").alias("b"), "parts", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part")).distinct()
    by_print = alike(near_prints, sets, asked.select(F.col("print").alias("b"), "fp").join(sets, "fp"), similarity)
    by_band = alike(pairs, sets, sets.withColumn("b", F.col("fp")), similarity)
    first = stage(by_print.union(by_band).distinct(), "links")

    # up to three members: the two have been compared with all
    rest = members.filter("n > 3").join(components(first), F.col("fp") == F.col("node"), "left").select("bucket", "n", F.col("items").alias("all_items"), "fp", F.coalesce("root", "fp").alias("root"))
    mixed = rest.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("bucket")
    rest = rest.join(mixed, "bucket", "left_semi").withColumn("blocks", F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("all_items") / ITEMS)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rest = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("bucket", "fp", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(sets, "fp")
    rest = rest.select("bucket", "i", "j", "fp", "root", F.col("own").alias("half"), "items")

    def solve(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([links_across(table, similarity)])

    more = stage(rest.groupBy("bucket", "i", "j").applyInArrow(solve, "a long, b long"), "links")
    roots = first if more.isEmpty() else first.union(more)
    return prints.join(components(roots), F.col("fp") == F.col("node"), "left").select("doc_id", "key", F.coalesce("root", "fp").alias("root"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one document of each group: the one with the smallest doc_id (nulls last; among
    equal ones the smallest text hash).  Of repeated rows one stays."""
    found = similar_groups(docs, **(SIMILAR | options)).groupBy("doc_id", "key").agg(F.min("root").alias("root"), F.count("*").alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "rows")
    doc, key, rows = free_names(docs, "__doc", "__key", "__rows")
    kept = found.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias(doc), F.col("k.key").alias(key), F.col("k.rows").alias(rows))
    kept = stage(kept, "kept")
    same = docs["doc_id"].cast("long").eqNullSafe(kept[doc]) & (F.xxhash64(docs["text"]) == kept[key])
    out = docs.join(kept.filter(kept[rows] == 1), same, "left_semi")
    repeated = kept.filter(kept[rows] > 1)
    if repeated.isEmpty():
        return out
    again = docs.join(repeated, same, "left_semi")
    return out.unionByName(one_row_each(again, again["doc_id"].cast("long"), F.xxhash64(again["text"])))


def op9_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
