"""Token counts of whole texts under a BPE vocabulary whose symbols carry word ends.

Method: rank-synchronous array merging.  Distinct words of a batch are cut into pre-tokens, held as one
ragged numpy array of symbol ids; in each round every pre-token finds its lowest-ranked adjacent pair
and merges all occurrences of that pair at once (left to right, without overlap).  Rounds end when no
pre-token has a pair with a rank; the surviving symbols are the tokens.

Normal form and pre-tokens are those of the vocabulary file's own normaliser and pre-tokenizer, run by the
library over all new words of a chunk at once, so they follow its Unicode tables; merging is done here.  Words
of ASCII and Latin letters up to U+017F alone, whose classes have not changed since Unicode 5, are cut by arrays, too.

Why this equals merging one pair at a time: a merge makes a symbol that did not exist before, and every
rule that uses this symbol was learnt later, so it has a higher rank.  Hence all occurrences of the
lowest-ranked pair go before anything their merging makes possible.

Cases: null or empty text: 0 tokens.  A text of special strings only: one token each.  Very long texts and
words: arrays, no recursion; memory follows the chunk (about 3 MB of text) or the single text.
Repeated rows: a row each.  Null doc_id: a row like any other.  Ties: there are none, as texts are counted one by one.
Empty table: no rows.  Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kgspark.llm.common import arrow_rows, chunks, documents, texts_of

LIMIT = 2048
#: Distinct words whose counts a Python worker remembers.
REMEMBERED = 300_000

#: Unicode White_Space, as the tokenizer's \s has it (str.split() also splits at 1C-1F).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: how such vocabularies cut lower-case text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_SEPARATORS = regex.compile("[\x1c-\x1f]")
SPLIT = regex.compile(f"[{WHITE_SPACE}]+")
#: Words that are cut by arrays: no apostrophe (it begins endings like 's) and no dotted capital I (two characters in
#: lower case); all are in normal form.
SIMPLE = re.compile("[!-&(-~\u00c0-\u012f\u0131-\u017f]+")
SPACE, LETTER, DIGIT, OTHER = range(4)


def classes(below: int = 0x180) -> np.ndarray:
    """The class of each code point of simple words."""
    table = np.full(below, OTHER, dtype=np.uint8)
    for c in range(below):
        if chr(c) == " ":
            table[c] = SPACE
        elif chr(c).isalpha():
            table[c] = LETTER
        elif chr(c).isdecimal():
            table[c] = DIGIT
    return table


class PairRanks:
    """Open-addressing table from a pair of symbol ids to (rank, merged id), looked up by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.rank = np.full(1 << bits, np.iinfo(np.int32).max, dtype=np.int32)
        self.merged = np.zeros(1 << bits, dtype=np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots = self._home(keys)
        todo = np.arange(len(keys))
        self.longest = 0
        while len(todo):
            at = (slots[todo] + self.longest) & self.mask
            free = self.keys[at] == -1
            first = np.zeros(len(todo), dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]] = keys[todo[put]]
            self.rank[at[put]] = todo[put]
            self.merged[at[put]] = merged[todo[put]]
            todo = todo[~put]
            self.longest += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._home(keys)
        rank = np.full(len(keys), np.iinfo(np.int32).max, dtype=np.int32)
        merged = np.zeros(len(keys), dtype=np.int32)
        open_ = np.arange(len(keys))
        for step in range(self.longest):
            at = (slot[open_] + step) & self.mask
            held = self.keys[at]
            hit = held == keys[open_]
            rank[open_[hit]], merged[open_[hit]] = self.rank[at[hit]], self.merged[at[hit]]
            open_ = open_[~hit & (held != -1)]
            if not len(open_):
                break
        return rank, merged


class Counter:
    """Counts tokens; remembers words it has counted, up to REMEMBERED of them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.library = Tokenizer.from_file(path)
        end = model["end_of_word_suffix"] or ""
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("special strings that depend on what is beside them")
        # of two special strings that begin at one place the longer one is meant
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        (cut,) = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        # the pattern that simple() carries out by arrays
        self.simple = SIMPLE.fullmatch if cut == PATTERN else lambda word: None
        self.classes = classes()
        letters = byte_letters()
        self.byte = np.zeros(max(map(ord, letters)) + 1, dtype=np.uint8)
        self.byte[[ord(c) for c in letters]] = np.arange(256)
        self.plain = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = PairRanks(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]), np.array([vocab[a + b] for a, b in pairs]))
        self.known: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        return SPLIT.split(text) if ASCII_SEPARATORS.search(text) else text.split()

    def count(self, texts: list[str]) -> np.ndarray:
        specials = np.zeros(len(texts), dtype=np.int64)
        rows = []
        for i, t in enumerate(texts):
            if self.special is not None and self.special.search(t):
                parts = self.special.split(t)
                specials[i] = len(parts) - 1
                rows.append([w for p in parts for w in self.words(p)])
            else:
                rows.append(self.words(t))
        new = set().union(*rows) - self.known.keys() if rows else set()
        known = self.known
        if len(known) + len(new) > REMEMBERED:
            known = self.known = {}
            new = set().union(*rows)
        new.discard("")
        new = list(new)
        known.update(zip(new, self.count_words(new).tolist()))
        known[""] = 0
        return specials + np.array([sum(map(known.__getitem__, r)) for r in rows], dtype=np.int64)

    def count_words(self, words: list[str]) -> np.ndarray:
        """Tokens of each word.  Neither normal form, lower case nor a pre-token reaches over white space, so
        words are taken together as one text with a space between them."""
        out = np.zeros(len(words), dtype=np.int64)
        some = np.fromiter((self.simple(w) is not None for w in words), dtype=bool, count=len(words))
        for which, cut in ((np.flatnonzero(some), self.cut_by_arrays), (np.flatnonzero(~some), self.cut_by_library)):
            if len(which):
                owner, lengths, raw = cut([words[i] for i in which.tolist()])
                if len(lengths):
                    out[which] = np.bincount(owner, weights=self.merge(lengths, raw), minlength=len(which))
        return out

    def cut_by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word of each pre-token, its bytes' number, all bytes)"""
        text = self.library.normalizer.normalize_str(" ".join(words))
        starts = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum([len(w) + 1 for w in text.split(" ")], out=starts[1:])
        found = self.library.pre_tokenizer.pre_tokenize_str(text)
        at = np.fromiter((span[0] for _, span in found), dtype=np.int64, count=len(found))
        letters = np.frombuffer("".join(piece for piece, _ in found).encode("utf-32-le"), dtype=np.uint32)
        return np.searchsorted(starts, at, side="right") - 1, np.array([len(piece) for piece, _ in found], dtype=np.int64), self.byte[letters]

    def cut_by_arrays(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for simple words: runs of letters, single digits, runs of other characters."""
        text = " ".join(words).lower()
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        kind = self.classes[codes]
        begins = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)]
        full = kind != SPACE
        piece = np.cumsum(begins & full)[full] - 1  # the pre-token of each character
        width = 1 + (codes >= 0x80)  # no simple character has three bytes
        lengths = np.bincount(piece, weights=width[full]).astype(np.int64)
        owner = np.cumsum(~full)[begins & full]
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        return owner, lengths, raw[raw != 32]

    def merge(self, lengths: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Symbols left of each pre-token (its length in bytes) after all merges."""
        ends = np.cumsum(lengths)
        symbols = self.plain[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        result = lengths.copy()
        none = np.iinfo(np.int32).max
        while len(symbols) > 1:
            inner = owner[:-1] == owner[1:]
            rank = np.full(len(symbols), none, dtype=np.int32)
            merged = np.zeros(len(symbols), dtype=np.int32)
            at = np.flatnonzero(inner)
            rank[at], merged[at] = self.pairs.find(symbols[at], symbols[at + 1])
            starts = np.flatnonzero(np.r_[True, ~inner])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            active = lowest < none
            ends_here = np.repeat(~active, sizes)
            take = (rank == np.repeat(lowest, sizes)) & ~ends_here
            # runs of the same pair overlap (aaa): keep every second, from the left
            run = take.copy()
            run[0] = False
            run[1:] &= take[:-1]
            if run.any():
                begin = np.flatnonzero(take & ~run)
                number = np.cumsum(take & ~run) - 1
                since = np.arange(len(take)) - begin[np.maximum(number, 0)]
                take &= since % 2 == 0
            symbols = np.where(take, merged, symbols)
            gone = np.zeros(len(symbols), dtype=bool)
            gone[1:] = take[:-1]
            left = np.add.reduceat((~gone).astype(np.int64), starts)
            result[owner[starts]] = left
            stay = ~gone & ~ends_here
            symbols, owner = symbols[stay], owner[stay]
        return result


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where it is printable
    Latin-1 (but for the soft hyphen), else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit.  No shuffle: a pass over the texts."""

    def run(batches):
        c = counter(vocabulary)
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = texts_of(part)
                yield arrow_rows(SCHEMA, doc_id=part.column("doc_id"), n_bytes=pc.binary_length(texts).cast(pa.int64()), n_tokens=c.count(texts.to_pylist()))

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
