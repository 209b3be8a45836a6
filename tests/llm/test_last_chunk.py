"""The end of a text is judged, however short it is."""

import random

import zstandard

from tests.llm.conftest import sentence
from vitrine.llm import quality

PACKER = zstandard.ZstdCompressor(level=quality.LEVEL)


def prose(n, seed=1):
    rng = random.Random(seed)
    text = sentence(rng, n).replace("\n", " ")
    return text.encode("ascii", "ignore").decode()[:n]


def judged(text):
    return dict(zip([m.split()[0] for m in quality.MEASURES.split(", ")], quality.measure(text, PACKER)))


def test_every_byte_is_in_a_chunk():
    rng = random.Random(2)
    for n in (0, 1, 4095, 4096, 4097, 6143, 6144, 6145, 8192, 9000, 12_000):
        text = "".join(rng.choice("abcdefgh ") for _ in range(n))
        assert judged(text)["n_chunks"] == (1 if 0 < n < 6144 else -(-n // 4096) - (0 < n % 4096 < 2048))


def bad_chunks(*chunks):
    return sum(not quality.in_band(len(c), len(PACKER.compress(c.encode()))) for c in chunks)


def test_a_bad_end_counts():
    for end in ("ab" * 1000, "a" * 2047, prose(1500, 3), "x"):
        text = prose(4096) + prose(4096, 2) + end
        assert judged(text)["n_bad_chunks"] == bad_chunks(prose(4096), prose(4096, 2) + end)
    run = prose(4096) + "a" * 6000
    assert judged(run)["n_bad_chunks"] == bad_chunks(prose(4096), "a" * 6000) >= 1
    assert not judged(run)["kept"]
