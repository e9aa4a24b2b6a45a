"""Alignment of the tokens of two tokenizers, and the links between their ids over a corpus.

Method: the tokens of a whole Arrow batch are laid end to end with the documents' byte offsets; the byte ends of A's and B's
tokens are counted in one bincount, and a place where both end is a cut.  Prefix sums over the cuts, taken at the documents' first
and last tokens, give each document's groups.  Tokens have no empty bytes, so just one A token and one B token end at a cut: a
group has one link.

Two ids can only be linked if the bytes of one end with the bytes of the other.  These pairs are listed from the two
vocabularies (suffix_pairs(): of every token as many as it has suffixes; 0.3 million for the two used here), so counts of links
are an array of that length whatever the corpus: each task adds up its own, Spark adds those of tasks, and the result is
broadcast.  Documents go through the tokenizers once; their distinct pairs with their numbers are staged for the look-up.

Cases: null or empty text, and a text that the joined bytes of A's or B's tokens don't give back (literal U+2581, say): no tokens,
zeros and '' .  Null doc_id: a row like any other.  Repeated rows: a row each, and each counts.  Ties: ids that share an id's highest count
are all its best.  Empty table: no rows.  Very long texts: whole, in one chunk of their own.  Columns but doc_id and text, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import chunks, documents, stage, texts_of
from kgspark.llm.packing import byte_bpe
from kgspark.llm.tokens import byte_letters

#: What sentencepiece writes for a space.
SPACE = "▁"


@lru_cache(maxsize=2)
def byte_library(vocabulary: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


@lru_cache(maxsize=2)
def pieces_model(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def byte_ids(vocabulary: str, text: str) -> np.ndarray:
    """Ids of the byte-level BPE.  tiktoken's pattern gives up on runs of about a million white space characters; such texts are
    encoded by tokenizers itself."""
    try:
        return byte_bpe(vocabulary).encode_to_numpy(text, disallowed_special=())
    except ValueError:
        return np.array(byte_library(vocabulary).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=2)
def byte_tokens(vocabulary: str) -> list[bytes]:
    """The bytes of every id of a byte-level BPE file; b"" where there is no id."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    added = {t["content"] for t in spec["added_tokens"]}
    entries = {i: bytes(byte_of[c] for c in token) for token, i in spec["model"]["vocab"].items() if token not in added}
    return [entries.get(i, b"") for i in range(max(entries) + 1)]


@lru_cache(maxsize=2)
def piece_tokens(model: str) -> list[bytes]:
    """The bytes of every id of a sentencepiece model; b"" for control pieces."""
    m = pieces_model(model)
    out = []
    for i in range(m.get_piece_size()):
        piece = m.id_to_piece(i)
        out.append(b"" if m.is_control(i) else bytes([int(piece[3:5], 16)]) if m.is_byte(i) else piece.replace(SPACE, " ").encode())
    return out


def suffix_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """a's id x len(b) + b's id, ascending, of all pairs of which one's bytes end with the other's."""
    ids_a, ids_b = defaultdict(list), defaultdict(list)
    for ids, tokens in ((ids_a, a), (ids_b, b)):
        for i, token in enumerate(tokens):
            if token:
                ids[token].append(i)
    found = set()
    for token, own in ids_a.items():
        for k in range(len(token)):
            found.update(i * len(b) + j for j in ids_b.get(token[k:], ()) for i in own)
    for token, own in ids_b.items():
        for k in range(len(token)):
            found.update(i * len(b) + j for i in ids_a.get(token[k:], ()) for j in own)
    return np.array(sorted(found), dtype=np.int64)


@dataclass
class Vocabulary:
    """Bytes of a vocabulary's ids: lengths, and the tokens as an Arrow array."""

    lengths: np.ndarray
    tokens: pa.Array

    @classmethod
    def of(cls, tokens: list[bytes]) -> Vocabulary:
        return cls(np.array([len(t) for t in tokens], dtype=np.int64), pa.array(tokens, pa.large_binary()))

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, end to end."""
        taken = self.tokens.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset :]
        data = np.frombuffer(taken.buffers()[2] or b"", dtype=np.uint8)
        return data[offsets[0] : offsets[len(ids)]] if len(ids) else data[:0]


def sums_at(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring bounds, by prefix sums."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])


def bounds_of(sizes: Iterable[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(sizes, dtype=np.int64))])


@lru_cache(maxsize=1)
def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of the numbers below n, and how many each has."""
    ids = np.arange(n)
    count = np.char.str_len(ids.astype(str)).astype(np.int64)
    most = int(count.max())
    digits = np.zeros((n, most), dtype=np.uint8)
    for k in range(most):
        has = count > k
        digits[has, k] = ids[has] // 10 ** (count[has] - 1 - k) % 10 + ord("0")
    return digits, count


@dataclass
class Aligned:
    """The tokens of a batch of documents: ids, which tokens end at a cut, and the documents' bounds among them.  Documents
    without tokens have none in either."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    bounds_a: np.ndarray
    bounds_b: np.ndarray

    @classmethod
    def of(cls, raw: list[bytes], ids_a: list[np.ndarray], ids_b: list[np.ndarray], a: Vocabulary, b: Vocabulary) -> Aligned:
        """raw: each document's bytes, b"" if it isn't to have tokens."""
        size = bounds_of(map(len, raw))
        whole = np.frombuffer(b"".join(raw), dtype=np.uint8)
        valid = np.diff(size) > 0
        flat = []
        for vocabulary, ids in ((a, ids_a), (b, ids_b)):
            own = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, dtype=np.int64)
            joined, counts = vocabulary.joined(own), bounds_of(map(len, ids))
            at = np.concatenate([[0], np.cumsum(vocabulary.lengths[own])])[counts]
            if not (np.array_equal(at, size) and np.array_equal(joined, whole)):
                valid &= [np.array_equal(joined[at[d] : at[d + 1]], whole[size[d] : size[d + 1]]) for d in range(len(raw))]
            flat.append((own, counts))
        out, ends = [], []
        for vocabulary, (own, counts) in zip((a, b), flat):
            if not valid.all():
                own = own[np.repeat(valid, np.diff(counts))]
                counts = bounds_of(np.where(valid, np.diff(counts), 0))
            out.append((own, counts))
            ends.append(np.cumsum(vocabulary.lengths[own]))
        both = np.bincount(np.concatenate(ends), minlength=1) == 2
        (own_a, bounds_a), (own_b, bounds_b) = out
        return cls(own_a, own_b, both[ends[0]], both[ends[1]], bounds_a, bounds_b)

    def texts(self) -> list[memoryview]:
        """a1,a2|b1;a3|b2,b3 of every document."""
        # the first token of each group, in A and in B
        first_a, first_b = (np.concatenate([[0], np.flatnonzero(cut) + 1]) for cut in (self.cut_a, self.cut_b))
        place_a = np.arange(len(self.a)) + first_b[np.cumsum(self.cut_a) - self.cut_a]
        place_b = np.arange(len(self.b)) + first_a[np.cumsum(self.cut_b) - self.cut_b + 1] if len(self.b) else np.zeros(0, dtype=np.int64)
        ids = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        mark = np.full(len(ids), ord(","), dtype=np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a[self.cut_a]], mark[place_b[self.cut_b]] = ord("|"), ord(";")
        digits, count = decimals(1 << max(int(ids.max(initial=0)), 1 << 16).bit_length())
        own = count[ids]
        ends = np.cumsum(own + 1)
        starts = ends - own - 1
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
        for k in range(int(own.max(initial=0))):
            has = np.flatnonzero(own > k)
            out[starts[has] + k] = digits[ids[has], k]
        out[ends - 1] = mark
        at = np.concatenate([[0], ends])[self.bounds_a + self.bounds_b]
        view = memoryview(out)
        return [view[s : max(e - 1, s)] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]


ROWS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])
ROWS_DDL = "doc_id long, n_a long, n_b long, n_groups long, groups string, pairs binary, times binary"


def tokenized(docs: DataFrame, vocabulary: str, model: str, pairs, digest: bool = False) -> DataFrame:
    """For every row its numbers of tokens and groups, the groups as text (or the SHA-256 of that), and its distinct pairs
    (numbers in the list of pairs, as 32-bit integers) with how often each occurs."""

    def run(batches):
        a, b, listed = Vocabulary.of(byte_tokens(vocabulary)), Vocabulary.of(piece_tokens(model)), pairs.value
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = texts_of(part).to_pylist()
                raw = [(" " + t).encode() if t else b"" for t in texts]
                ids_a = [byte_ids(vocabulary, " " + t) if t else np.zeros(0, dtype=np.uint32) for t in texts]
                ids_b = [np.array(x, dtype=np.int64) for x in pieces_model(model).encode(texts, num_threads=1)]
                found = Aligned.of(raw, ids_a, [x if t else x[:0] for x, t in zip(ids_b, texts)], a, b)
                groups = sums_at(found.cut_a, found.bounds_a)
                link = np.searchsorted(listed, found.a[found.cut_a] * len(b.lengths) + found.b[found.cut_b])
                keys, times = np.unique(np.repeat(np.arange(len(texts)), groups) * len(listed) + link, return_counts=True)
                at = np.searchsorted(keys, np.arange(len(texts) + 1) * len(listed)).tolist()
                keys, times = (keys % len(listed)).astype("<u4"), times.astype("<u4")
                texts_of_groups = [hashlib.sha256(g).hexdigest() if len(g) else "" for g in found.texts()] if digest else [str(g, "ascii") for g in found.texts()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(found.bounds_a)),
                        pa.array(np.diff(found.bounds_b)),
                        pa.array(groups),
                        pa.array(texts_of_groups, pa.string()),
                        pa.array([keys[s:e].tobytes() for s, e in zip(at, at[1:])], pa.binary()),
                        pa.array([times[s:e].tobytes() for s, e in zip(at, at[1:])], pa.binary()),
                    ],
                    schema=ROWS,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS_DDL)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of a binary column, and each row's bounds among them."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype="<u4").astype(np.int64), bounds_of(len(v) // 4 for v in values)


def link_counts(rows: DataFrame, n: int) -> np.ndarray:
    """How many links of the corpus hold each of the n pairs.  Tasks count in an array of n; at most n rows reach the driver."""

    def run(batches):
        total = np.zeros(n, dtype=np.int64)
        for batch in batches:
            pairs, _ = flat(batch.column("pairs"))
            times, _ = flat(batch.column("times"))
            np.add.at(total, pairs, times)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["pair", "n"])

    found = rows.select("pairs", "times").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n, dtype=np.int64)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out


RESULT = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups", pa.string())])
RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def align(docs: DataFrame, vocabulary: str, model: str, digest: bool = False) -> DataFrame:
    """A row for every row of docs: n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair has the highest count of its
    B id), count_sum (counts of the pairs over links), groups (text, or its SHA-256 with digest)."""
    context = docs.sparkSession.sparkContext
    width = len(piece_tokens(model))
    pairs = suffix_pairs(byte_tokens(vocabulary), piece_tokens(model))
    rows = stage(tokenized(docs, vocabulary, model, context.broadcast(pairs), digest), "aligned")
    counts = link_counts(rows, len(pairs))
    highest = np.zeros(width, dtype=np.int64)
    np.maximum.at(highest, pairs % width, counts)
    sent = context.broadcast((counts, counts == highest[pairs % width]))

    def run(batches):
        counts, best = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                pairs, bounds = flat(part.column("pairs"))
                times, _ = flat(part.column("times"))
                sums = (pa.array(sums_at(times * x[pairs], bounds)) for x in (best, counts))
                n = part.column("n_groups")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "n_a", "n_b")), n, n, *sums, part.column("groups")], schema=RESULT)

    return rows.mapInArrow(run, RESULT_DDL)


def op11_cross_tokenizer_alignment(spark, sf_dir):
    import public_tokenizers

    found = align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")
