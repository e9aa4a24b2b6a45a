"""Best-fit packing of token pieces into sequences of a fixed capacity.

Method: a configuration linear program over the length histogram (a configuration is a multiset of
lengths that fits one sequence; every length must be covered as often as it occurs).  It is solved by
multiplicative weights: a length's price falls exponentially as it is covered, and a knapsack dynamic program
over the prices finds configurations.  One table of the program prices the best configuration around every length; those whose
worth is within GAP of the best enter, by a share of what is open, so configurations are taken fractions of times.
Rounding: the fractional solution is rounded down; what is open then is covered by whole sequences at the same
prices, and at last, where few pieces of a length are left, sequence by sequence by a knapsack over the pieces themselves (the longest one, and the
others that fill its sequence best).  Repair: the fullest sequences stand, and best fit places what the others hold, for several shares
(SHARES) of pieces that stand; of equal results the one with the most from the program is taken.  plan() reports that share.

Only the histogram (at most `capacity` numbers) and bucket counts (at most MOST_BUCKETS + capacity numbers)
reach the driver.  Pieces are numbered inside (length, bucket) groups, dealt by a hash of the row's number, so
their size is even whatever repeats; pieces of full capacity need no place and are never shuffled.

Cases: null or empty text: the piece [0].  Repeated rows: each is packed.  Null doc_id: packed like any
other.  Ties: pieces of one length are interchangeable, any of them gets any of their places.  Empty table: no rows.
Very long texts: pieces of the capacity, the first one may be shorter.  Columns but doc_id and text, whatever
their names, are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import arrow_rows, chunks, documents, stage, texts_of

CAPACITY = 2048
#: Groups in which pieces are numbered, besides one for each length: pieces of a group, and the most groups.
BUCKET_ROWS = 1 << 10
MOST_BUCKETS = 1 << 16
#: How fast prices fall with coverage, and how much more than in proportion the longest piece is worth.
RATE = 0.5
BONUS = 0.3
#: By which share a configuration may be worth less than the best one; what part of the open pieces a step covers.
GAP = 0.002
PART = 4
#: Configurations that a step finds before it gives up on rounding some down.
LEAST = 3
#: Rounds of the fractional solution at most, and the share of a length's count that it may leave open.
ROUNDS = 120
LEFT_OPEN = 0.02
#: Shares of the pieces that configurations place, of which the one with the fewest sequences is taken.
SHARES = (1.0, 0.99, 0.98, 0.97, 0.96, 0.95, 0.93, 0.91, 0.75, 0.5, 0.0)
#: Sequences of a piece of full capacity are numbered from here on.
FULL = 1 << 50

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def byte_bpe(vocabulary: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken from the same vocabulary: the same ids
    (tests compare them), at a quarter of the time."""
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    from kgspark.llm.tokens import byte_letters

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def library(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def token_ids(vocabulary: str, text: str) -> np.ndarray:
    """The text's ids.  tiktoken's pattern gives up on runs of about a million white space characters; such texts
    are encoded by tokenizers itself."""
    try:
        return byte_bpe(vocabulary).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(library(vocabulary).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokens of every text and a closing 0, cut from the end into pieces of the capacity."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                out = [[] for _ in PIECES]
                for doc, text in zip(part.column("doc_id").to_pylist(), texts_of(part).to_pylist()):
                    ids = np.append(token_ids(vocabulary, text), np.uint32(0)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    for n, (a, b) in enumerate(zip(range(first - capacity, len(ids), capacity), range(first, len(ids) + 1, capacity))):
                        a = max(a, 0)
                        for column, value in zip(out, (doc, n, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                            column.append(value)
                yield arrow_rows(PIECES, **dict(zip(PIECES.names, out)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES_DDL)


def numbered(cut: DataFrame) -> DataFrame:
    """pieces() with a number in __row by which repeated rows differ; it holds for what has been staged."""
    return cut.withColumn("__row", F.monotonically_increasing_id())


def knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """prices[n] of a piece of length n -> for each room the greatest sum of prices that fits, and a length to begin
    with (0: nothing uses this room in full)."""
    best = np.zeros(len(prices))
    pick = np.zeros(len(prices), dtype=np.int64)
    for room in range(1, len(prices)):
        value, first = prices[room], room
        if half := room // 2:  # of two pieces or more one is at most half the room
            gains = prices[1 : half + 1] + best[room - 1 : room - half - 1 : -1]
            at = int(gains.argmax())
            if gains[at] > value:
                value, first = gains[at], at + 1
        if best[room - 1] >= value:
            value, first = best[room - 1], 0
        best[room], pick[room] = value, first
    return best, pick


def configuration(pick: np.ndarray, room: int, lead: int) -> dict[int, int]:
    """The multiset of lengths that the table of knapsack() has around a piece of length lead."""
    found, room = {lead: 1}, room - lead
    while room > 0:
        n = int(pick[room])
        if n:
            found[n] = found.get(n, 0) + 1
        room -= n or 1
    return found


def fullest(left: np.ndarray, open_: list[int], capacity: int) -> dict[int, int]:
    """The longest piece that is left (open_: the lengths, ascending), and of the others those that fill its sequence best: a bounded knapsack
    over sums as bits of one number, longer pieces before shorter ones."""
    lead = open_[-1]
    room = capacity - lead
    reach, steps = 1, []  # bit n: some of the pieces so far have length n together
    within = (1 << (room + 1)) - 1
    for n in reversed(open_[: bisect_right(open_, room)]):
        for _ in range(min(int(left[n]) - (n == lead), room // n)):
            more = (reach | reach << n) & within
            if more == reach:
                break
            reach = more
            steps.append((n, reach))
        if reach >> room & 1:
            break
    config, at = {lead: 1}, reach.bit_length() - 1
    while at:
        # the first step that reaches this sum: its piece is in it
        low, high = 0, len(steps) - 1
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if steps[middle][1] >> at & 1 else (middle + 1, high)
        n = steps[low][0]
        config[n] = config.get(n, 0) + 1
        at -= n
        steps = steps[:low]
    return config


def priced(left: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Prices of lengths: the multiplicative weights, which fall with the share that has been covered."""
    size = np.arange(len(need))
    return np.where(left > 0, size * (1 + BONUS * size / (len(need) - 1)) * np.exp(-RATE * (1 - left / np.maximum(need, 1e-12))), 0.0)


def worthwhile(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[list[int], np.ndarray, float]:
    """(lengths around which a configuration is worth almost as much as the best one, the table's picks, the best worth)."""
    best, pick = knapsack(prices)
    worth = prices[lengths] + best[capacity - lengths]
    return lengths[(prices[lengths] > 0) & (worth >= (1 - GAP) * best[capacity])].tolist(), pick, best[capacity]


def fractional(need: np.ndarray) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """The linear program by multiplicative weights: how often each configuration {length: times} is taken, so that lengths are covered
    up to LEFT_OPEN of their counts and none more often than it occurs; and the bound that prices gave (by duality)."""
    capacity = len(need) - 1
    lengths = np.flatnonzero(need)[::-1]
    left = need.astype(float)
    taken: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
    bound = 0.0
    for _ in range(ROUNDS):
        if not left.any():
            break
        prices = priced(left, need)
        leads, pick, best = worthwhile(prices, lengths, capacity)
        bound = max(bound, float((prices * need).sum() / best))
        for lead in leads:
            config = configuration(pick, capacity, lead)
            step = min(left[n] / times for n, times in config.items())
            if step <= 0:
                continue
            step = step if step < 0.05 else max(step / PART, 0.05)
            taken[tuple(sorted(config.items()))] += step
            for n, times in config.items():
                left[n] -= times * step
                if left[n] < LEFT_OPEN * need[n]:
                    left[n] = 0.0
    return taken, bound


def solve(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], float]:
    """(configuration, number of sequences) that cover every length exactly as often as it occurs, and the bound from
    below.  The fractional solution is rounded down; what is open after that is covered by whole sequences at the same prices."""
    need = np.zeros(capacity + 1, dtype=np.int64)
    need[list(histogram)] = list(histogram.values())
    lengths = np.flatnonzero(need)[::-1]
    left = need.copy()
    out: list[tuple[dict[int, int], int]] = []

    def take(config: dict[int, int], n: int) -> None:
        out.append((config, n))
        for length, times in config.items():
            left[length] -= times * n

    x, bound = fractional(need)
    for config, times in x.items():
        if times >= 1:
            take(dict(config), int(times))
    while left.any():
        leads, pick, _ = worthwhile(priced(left, need), lengths, capacity)
        found = 0
        for lead in leads:
            if left[lead] <= 0:
                continue
            config = configuration(pick, capacity, lead)
            whole = int(min(left[n] // times for n, times in config.items()))
            if whole > 0:
                take(config, max(1, whole // PART))
                found += 1
        if found < LEAST:
            open_ = np.flatnonzero(left).tolist()
            for _ in range(4 * LEAST):
                if open_:
                    take(fullest(left, open_, capacity), 1)
                    open_ = [n for n in open_ if left[n]]
    return out, bound


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, over counts: equal sequences are kept together, so the work follows the
    number of lengths and not of pieces."""
    rooms: dict[int, list] = defaultdict(list)
    keys: list[int] = []

    def put(room: int, config: dict, n: int) -> None:
        if not rooms[room]:
            insort(keys, room)
        rooms[room].append((config, n))

    for i in range(len(lengths) - 1, -1, -1):
        size, left = int(lengths[i]), int(counts[i])
        while left > 0:
            at = bisect_left(keys, size)
            if at == len(keys):
                room, config, n = capacity, {}, left // (capacity // size) + 1
            else:
                room = keys[at]
                config, n = rooms[room].pop()
                if not rooms[room]:
                    keys.pop(at)
            each = room // size
            full = min(n, left // each)
            if full:
                put(room - each * size, config | {i: each}, full)
            left -= full * each
            if n > full and config:
                if 0 < left < each:
                    put(room - left * size, config | {i: left}, 1)
                    left, full = 0, full + 1
                if n > full:
                    put(room, config, n - full)
            elif n > full and 0 < left < each:
                put(room - left * size, {i: left}, 1)
                left = 0
    return [x for group in rooms.values() for x in group]


@dataclass
class Plan:
    """configs: (configuration {length: times}, number of sequences) that hold exactly the pieces of the histogram;
    placed: how many of the pieces configurations of the program place, best fit the others; bound: no packing
    has fewer sequences."""

    configs: list[tuple[dict[int, int], int]]
    placed: int
    bound: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.configs)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    if not histogram:
        return Plan([], 0, 0)
    solved, dual = solve(histogram, capacity)
    bound = max(-(-sum(n * c for n, c in histogram.items()) // capacity), int(np.ceil(dual - 1e-6)))
    pieces = sum(histogram.values())
    plans = []
    # the fullest sequences stand; what the others hold is repaired
    solved.sort(key=lambda x: -sum(n * times for n, times in x[0].items()))
    for share in SHARES:
        left, taken, placed = dict(histogram), [], 0
        for config, n in solved:
            if placed >= share * pieces:
                break
            for length, times in config.items():
                left[length] -= times * n
            placed += n * sum(config.values())
            taken.append((config, n))
        rest = {n: c for n, c in sorted(left.items()) if c > 0}
        lengths = np.array(list(rest), dtype=np.int64)
        more = best_fit(lengths, np.array(list(rest.values()), dtype=np.int64), capacity)
        plans.append(Plan(taken + [({int(lengths[i]): times for i, times in c.items()}, n) for c, n in more], placed, bound))
    return min(plans, key=lambda p: p.sequences)  # of equal ones the first, which has the most of the program


def places(configs: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of consecutive numbers: (length, first number) -> first sequence, pieces of
    this length in a sequence, offset of the first of them."""
    rows, given, sequence = [], defaultdict(int), 0
    for config, n in configs:
        offset = 0
        for length, times in sorted(config.items(), reverse=True):
            rows.append((length, given[length], sequence, times, offset))
            given[length] += times * n
            offset += times * length
        sequence += n
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"at": (a[:, 0] << 48) + a[:, 1], "first": a[:, 1], "sequence": a[:, 2], "times": a[:, 3], "offset": a[:, 4]}


def pack(cut: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Give every row of cut (the columns of numbered(); it must be stable, as a staged table is) its
    sequence_id and offset."""
    spark = cut.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram.pop(capacity, None)
    size = max(bucket_rows, -(-sum(histogram.values()) // MOST_BUCKETS))
    table = spark.sparkContext.broadcast(places(plan(histogram, capacity).configs))
    # the number of buckets of each length; only lengths with more than `size` pieces are listed
    many = {n: -(-c // size) for n, c in histogram.items() if c > size}
    parts = F.lit(1)
    if many:
        split = F.create_map(*[F.lit(x) for kv in many.items() for x in kv])
        parts = F.coalesce(F.element_at(split, F.col("length").cast("int")), F.lit(1))
    rest = cut.filter(F.col("length") < capacity).withColumn("__bucket", F.pmod(F.xxhash64("__row"), parts).cast("int"))
    before: dict[tuple[int, int], int] = {}
    given: dict[int, int] = defaultdict(int)
    for r in sorted(rest.groupBy("length", "__bucket").agg(F.count("*").alias("n")).collect()):
        before[r["length"], r["__bucket"]] = given[r["length"]]
        given[r["length"]] += r["n"]
    offsets = spark.sparkContext.broadcast(before)
    order = Window.partitionBy("length", "__bucket").orderBy("__row")
    rest = rest.withColumn("__n", F.row_number().over(order))
    schema = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
    ddl = f"{PIECES_DDL}, sequence_id long, offset long"

    def place(batches):
        t, b = table.value, offsets.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            bucket = batch.column("__bucket").to_numpy()
            number = batch.column("__n").to_numpy().astype(np.int64) - 1
            number += np.fromiter((b[k] for k in zip(length.tolist(), bucket.tolist())), dtype=np.int64, count=len(length))
            run = np.searchsorted(t["at"], (length << 48) + number, side="right") - 1
            since = number - t["first"][run]
            sequence = t["sequence"][run] + since // t["times"][run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PIECES.names), pa.array(sequence), pa.array(t["offset"][run] + since % t["times"][run] * length)], schema=schema)

    full = cut.filter(F.col("length") == capacity).withColumn("sequence_id", F.lit(FULL) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return rest.mapInArrow(place, ddl).unionByName(full.drop("__row"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(stage(numbered(pieces(docs, vocabulary, capacity)), "pieces"), capacity)


def op1_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
