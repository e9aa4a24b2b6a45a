import hashlib
import random
from bisect import bisect_right
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from kgspark.llm import alignment

VOCABULARY, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ZEROS = (0, 0, 0, 0, 0, 0, "")


def letters():
    """Byte-level letters, by their definition: printable bytes are themselves, the others follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain(rows):
    """(doc_id, text) -> the columns of the query, by sets of ends for each document, and the groups as texts."""
    a, b = Tokenizer.from_file(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    byte_of = letters()
    found = []
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        ends = []
        for side in (0, 1):
            ids = (b.encode(text or "") if side else a.encode(" " + (text or ""), add_special_tokens=False).ids) if text else []
            at, own, joined = 0, {}, b""
            for i in ids:
                piece = b.id_to_piece(i) if side else a.id_to_token(i)
                raw = (bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()) if side else bytes(byte_of[c] for c in piece)
                at, joined = at + len(raw), joined + raw
                own[at] = i
            ends.append(own if joined == whole and text else None)
        found.append((doc, *ends))
    counts = Counter()
    for _, x, y in found:
        if x is not None and y is not None:
            counts.update((x[e], y[e]) for e in x.keys() & y.keys())
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out, texts = [], []
    for doc, x, y in found:
        if x is None or y is None:
            out.append((doc, *ZEROS))
            texts.append("")
            continue
        cuts = sorted(x.keys() & y.keys())
        pairs = [(x[e], y[e]) for e in cuts]
        ends = [sorted(x), sorted(y)]
        groups = ";".join("|".join(",".join(str(side[e]) for e in own[bisect_right(own, s) : bisect_right(own, t)]) for side, own in zip((x, y), ends)) for s, t in zip([0, *cuts], cuts))
        texts.append(groups)
        out.append((doc, len(x), len(y), len(cuts), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(groups.encode()).hexdigest()))
    return out, texts


def odd_texts():
    rng = random.Random(11)
    pool = ["the", " of", "ing", "Été", "漢字", "😀", "é", "\n", "\t", "  ", "0x41", "<0x41>", "<s>", "</s>", "<unk>", "<|endoftext|>", "ﬁ", " ", "\x00", "don't", "I'll", "12345", "...", "\xa0", "　", "ß"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    texts += ["a▁b", "▁", None, "", " ", " lead", "the same text"] + ["the same text"] * 3
    return [*enumerate(texts), (None, "no id here"), (None, None), (5, "a repeated id"), (5, "a repeated id")]


def test_query_against_plain_code(spark, tmp_path):
    rows = odd_texts()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = alignment.op11_cross_tokenizer_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want, _ = plain(rows)
    assert sum(w[1:] == ZEROS for w in want) >= 5 and sum(w[3] < w[1] for w in want) > 50
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_groups_of_odd_documents(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = alignment.align(odd, VOCABULARY, MODEL).collect()
    want, texts = plain(rows)
    assert sorted(((r["doc_id"], r["n_a"], r["n_b"], r["count_sum"], r["groups"]) for r in got), key=repr) == sorted(((w[0], w[1], w[2], w[6], t) for w, t in zip(want, texts)), key=repr)
    assert alignment.align(odd.limit(0), VOCABULARY, MODEL).collect() == []


def test_every_link_is_a_listed_pair():
    a, b = [b"", b"ab", b"b", b"cab"], [b"b", b"b", b"xcab", b"", b"ab"]
    pairs = {(int(p) // 5, int(p) % 5) for p in alignment.suffix_pairs(a, b)}
    assert pairs == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x))}


def test_long_runs():
    """White space that tiktoken gives up on, and one word of many bytes."""
    for text in (" " * 1_050_000, "x" * 200_000):
        ids = alignment.byte_ids(VOCABULARY, " " + text)
        assert b"".join(alignment.byte_tokens(VOCABULARY)[i] for i in ids) == (" " + text).encode()
