"""Packing against a plain packer, the tokenizer itself and a lower bound."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from vitrine.llm import packing
from vitrine.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    import tokenizers

    return tokenizers.Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, texts, tokenizer, width=1024):
    """Pieces cover their documents; sequences are gapless and not over the width."""
    pieces = brute.grouped((r.doc_id, r) for r in rows)
    assert set(pieces) == set(texts)
    for doc_id, found in pieces.items():
        ids = ids_of(tokenizer, texts[doc_id])
        found.sort(key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found)))
        assert [r.start for r in found] == [sum(q.length for q in found[:i]) for i in range(len(found))]
        assert sum(r.length for r in found) == len(ids)
        assert all(r.length == width for r in found[1:])
        for r in found:
            expected = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert bytes(r.ids) == expected
    sequences = brute.grouped((r.sequence_id, (r.offset, r.length)) for r in rows)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= width
    return len(sequences)


def test_odd_texts(odd, texts, tokenizer):
    rows = packing.pack(odd, PATH).collect()
    n = check(rows, texts, tokenizer)
    total = sum(len(ids_of(tokenizer, t)) for t in texts.values())
    assert n <= -(-total // 1024) + 1


def test_narrow_few_open_many_tasks(spark, odd, texts, tokenizer):
    """Many tasks, few open bins: bins of tasks are packed again over several rounds."""
    many = odd.repartition(40)
    rows = packing.pack(many, PATH, width=64, most_open=3).collect()
    check(rows, texts, tokenizer, 64)


def test_rounds_leave_few_sequences(spark, tokenizer, monkeypatch):
    rng = random.Random(4)
    texts = {i: "the " * rng.randrange(1, 600) for i in range(900)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(45)
    monkeypatch.setattr(packing, "FAN", 4)
    rows = packing.pack(docs, PATH).collect()
    n = check(rows, texts, tokenizer)
    total = sum(len(ids_of(tokenizer, t)) for t in texts.values())
    assert n <= 1.02 * total / 1024 + 1


def test_registered_query(spark, tokenizer):
    rows = QUERIES["op11_best_fit_packing"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    sequences = brute.grouped((r.sequence_id, r) for r in rows)
    for found in sequences.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == [sum(q.length for q in found[:i]) for i in range(len(found))]
        assert sum(r.length for r in found) <= 1024
    ids = {i: ids_of(tokenizer, t) for i, t in texts.items()}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.length == len(part) and r.ids_crc32 == zlib.crc32(part.tobytes())
    total = sum(map(len, ids.values()))
    assert sum(r.length for r in rows) == total
    assert len(sequences) <= 1.02 * total / 1024 + 1


def test_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", "\t", " ", "　", "\x85", "\x1c", "᠎", "​", "a", "the",
             "Don't", "'s", "'ll", "l'été", "é", "漢字", "1", "12.5", "!", "...", ".", "<|endoftext|>",
             "<|", "😀", "\r\n", "\x00", "²", " " * 1500]
    encoder = packing.Encoder(PATH)
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert encoder.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    other = public_tokenizers.path("word_bpe_49k.json")  # not byte-level
    import tokenizers

    assert packing.Encoder(other).encode("Some Words here") == tokenizers.Tokenizer.from_file(other).encode(
        "Some Words here", add_special_tokens=False
    ).ids


def test_very_long_texts(spark, tokenizer):
    texts = {1: "word and more words, " * 250_000, 2: " " * 3_000_000, 3: "ab" * 1_000_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(packing.pack(docs, PATH).collect(), texts, tokenizer)


def plain_best_fit(lengths, width, most_open):
    opened, n, out = {}, 0, []
    for length in lengths:
        fits = [b for b, used in opened.items() if used + length <= width]
        if fits:
            found = max(fits, key=lambda b: opened[b])
            tight = opened[found]
        else:
            if len(opened) == most_open:
                del opened[max(opened, key=opened.get)]
            found, tight = n, 0
            n += 1
        opened[found] = tight + length
        out.append(tight)
        if opened[found] == width:
            del opened[found]
    return out, n


@pytest.mark.parametrize("most_open", [1, 4, 50])
def test_bins_are_best_fit(most_open):
    """Ties between equally full bins may fall either way; the fill levels are the same."""
    rng = random.Random(most_open)
    for _ in range(60):
        width = rng.choice([10, 64])
        lengths = [rng.randrange(1, width + 1) for _ in range(200)]
        bins = packing.Bins(width, most_open)
        placed = [bins.place(n) for n in lengths]
        offsets, n = plain_best_fit(lengths, width, most_open)
        assert [at for _, at, _ in placed] == offsets and bins.n == n
        closed = [c for *_, c in placed if c is not None]
        assert len(closed) == len(set(closed)) and not bins.left() & set(closed)


def test_sequences(odd):
    pieces = packing.pack(odd, PATH)
    joined = packing.sequences(pieces).collect()
    assert all(r.n_tokens * 4 == len(r.ids) for r in joined)
    assert sum(r.n_tokens for r in joined) == pieces.agg(F.sum("length")).first()[0]


def test_empty_and_clashing(none, clashing):
    assert packing.pack(none, PATH).count() == 0
    rows = packing.pack(clashing, PATH).collect()
    assert len([r for r in rows if r.piece == 0]) == clashing.count()
    named = clashing.selectExpr("*", "'x' as bin", "'x' as piece", "'x' as sequence_id", "'x' as target", "'x' as used")
    assert packing.pack(named, PATH).columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
