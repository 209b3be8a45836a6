"""Source divergence and phrase mining against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA, VOCABULARY
from vitrine.llm import divergence, phrases

UNIT = 10**9


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_audit(rows, top=200):
    """rows: (text, lang, source)."""
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    docs = [(term.findall(low(t)), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        holders = Counter(t for words, *_ in own for t in set(words))
        kept = sorted(t for t, n in holders.items() if n >= 3)
        counts = defaultdict(Counter)
        for words, _, source in own:
            counts[source].update(w for w in words if holders[w] >= 3)

        def p(counter, counts=None):
            total = sum(counter.values()) + len(kept)
            return {t: 1 + UNIT * (counter[t] + 1) // total for t in kept}

        sources = sorted({d[2] for d in own})
        ps = {s: p(counts[s]) for s in sources}
        whole = p(sum((counts[s] for s in sources), Counter()))
        for s in sources:
            pairs = [
                (o, sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept)) for o in sources if o != s
            ]
            terms = [
                (t, (ps[s][t] - whole[t]) ** 2 // whole[t])
                for t in kept if counts[s][t] and ps[s][t] > whole[t]
            ]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                found = found if part == "pair" else found[:top]
                out += [(lang, s, part, i, v, n + 1) for n, (i, v) in enumerate(found)]
    return sorted(out)


def plain_collocations(rows, support=30, most=2000):
    """rows: (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        frequent = {p: c for p, c in count.items() if len(p) > 1 and c >= support}
        found = []
        for phrase, a in frequent.items():
            cut = min(
                (2_000_000 * a // (count[phrase[:k]] + count[phrase[k:]]), k) for k in range(1, len(phrase))
            )
            longer = [
                c for p, c in frequent.items()
                if len(p) > len(phrase)
                and any(p[i : i + len(phrase)] == phrase for i in range(len(p) - len(phrase) + 1))
            ]
            if any(100 * c >= 80 * a for c in longer):
                continue
            k = cut[1]
            found.append((-cut[0], -a, " ".join(phrase).encode(), a, count[phrase[:k]], count[phrase[k:]]))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    """Skewed words, copies, one hot source, odd characters, texts without terms, nulls."""
    rng = random.Random(2)
    words = VOCABULARY + ["The", "ÉCLAIR", "x1y", "o'clock", "漢字"]
    rows = []
    for i in range(240):
        parts = []
        for _ in range(rng.randrange(0, 60)):
            parts.append(rng.choices(words, [2 ** -min(j, 6) for j in range(len(words))])[0])
            if rng.random() < 0.15:
                parts[-1] += rng.choice([".", ",", ";", "!\n", "\r\n", "\t", " .. "])
        text = " ".join(parts)
        lang = rng.choice(["en", "en", "en", "fr", None, ""])
        source = rng.choice(["a", "a", "a", "b", "c", "é", None])
        rows.append((i, text, lang, source, len(text)))
    rows += [(300, None, "en", "only nulls", None), (301, "", "en", "a", 0), (302, "123 !!", "xx", "s", 6)]
    rows += [(303, "lone words here", "yy", "s", 15), (303, "lone words here", "yy", "t", 15)]
    rows += [(400 + i, "New York City Hall is open. " * 3, "en", "b", 81) for i in range(15)]
    return rows


@pytest.fixture(scope="module")
def frame(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(7).cache()


def audited(frame):
    return sorted(tuple(r) for r in divergence.audit(frame).collect())


def mined(frame, **more):
    return sorted(tuple(r) for r in phrases.collocations(frame, **more).collect())


def test_audit(frame, corpus):
    expected = plain_audit([(r[1], r[2], r[3]) for r in corpus])
    assert audited(frame) == expected
    assert {r[2] for r in expected} == {"pair", "term"}
    assert any(r[0] == "yy" and r[2] == "pair" and r[4] == 0 for r in expected)


def test_audit_in_small_slices(frame, corpus, monkeypatch):
    """Task limits change where runs and partial counts end, not the result."""
    for name, value in (("SLICE", 7), ("HELD", 20), ("AT_ONCE", 5)):
        monkeypatch.setattr(divergence, name, value)
    assert audited(frame) == plain_audit([(r[1], r[2], r[3]) for r in corpus])


def test_runs():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        times = rng.integers(1, 5, n)
        columns = [rng.integers(0, 3, n) for _ in range(2)]
        encoded = []
        for column in columns:
            at = np.flatnonzero(column)
            starts, counts = divergence.encoded(at, column[at])
            starts, counts = starts[starts < n], counts[starts < n]
            assert (np.repeat(counts, np.diff(np.append(starts, n))) == column).all()
            assert (counts[1:] != counts[:-1]).all()
            encoded.append((starts, counts + 1))
        before = np.concatenate([[0], np.cumsum(times)])
        p, q = (c + 1 for c in columns)
        there, back = divergence.divergence(*encoded, before)
        assert there == ((p - q) ** 2 // q * times).sum() and back == ((p - q) ** 2 // p * times).sum()


def test_probabilities_beyond_64_bits():
    count = np.array([0, 5, 10**13], np.int64)
    assert divergence.probability(count, 10**14).tolist() == [1 + UNIT * (int(c) + 1) // 10**14 for c in count]


def test_collocations(frame, corpus):
    expected = plain_collocations([(r[1], r[2]) for r in corpus], 10)
    assert mined(frame, support=10) == expected
    assert any(r[2] == "new york city hall" for r in expected)
    assert {len(r[2].split()) for r in expected} == {2, 3, 4}


@pytest.mark.parametrize("shards, part", [(1, 40), (3, 10**6), (50, 300)])
def test_collocations_by_shards(frame, corpus, monkeypatch, shards, part):
    """Few shards and one for each task; small parts; bitmaps too small; candidates in slices."""
    limits = {"SHARDS": shards, "PART": part, "BLOCK": 50, "HELD": 30, "BITS": 1 << 12, "BITS_EACH": 200}
    for name, value in limits.items():
        monkeypatch.setattr(phrases, name, value)
    assert mined(frame, support=6) == plain_collocations([(r[1], r[2]) for r in corpus], 6)
    assert mined(frame, support=6, most=4) == plain_collocations([(r[1], r[2]) for r in corpus], 6, 4)


def test_short_hashes_change_nothing(frame, corpus, monkeypatch):
    """Mined phrases that share the few bits of a hash are told apart when they are counted."""
    monkeypatch.setattr(phrases, "HASH_BITS", 7)
    assert mined(frame, support=6) == plain_collocations([(r[1], r[2]) for r in corpus], 6)
    monkeypatch.setattr(phrases, "BITS", 1 << 12)
    monkeypatch.setattr(phrases, "BITS_EACH", 400)
    assert mined(frame, support=6) == plain_collocations([(r[1], r[2]) for r in corpus], 6)


def test_little_is_shuffled_of_a_count(frame, monkeypatch):
    """A mined phrase is one number and its count, a counted one its string without a hash."""
    shapes = {}

    def shape(table, function, ddl, *more):
        shapes[function.__name__] = [one.split()[1] for one in ddl.split(", ")]
        return map_batches(table, function, ddl, *more)

    map_batches = phrases.map_batches
    monkeypatch.setattr(phrases, "map_batches", shape)
    assert mined(frame, support=10)
    assert shapes["_mined"] == ["long", "int"] and shapes["_recounted"] == ["string", "string", "long"]


def test_hashes_of_counted_phrases(spark):
    """They equal the hashes of the windows that the blocks are searched for."""
    rows = [("en", "a b c", 9), ("fr", "a b c", 8), ("en", "b c d", 7)]
    table = spark.createDataFrame(rows, "lang string, phrase string, f long")
    found = phrases.map_batches(table, phrases._hashed, "lang string, phrase string, k int, h long, f long", 3).collect()
    assert sorted((r["lang"], r["phrase"], r["f"]) for r in found) == sorted(rows)
    for lang in ("en", "fr"):
        h, _ = phrases.phrase_hashes(phrases.word_hashes(lang, "abcd"), np.ones(4, bool), 3)
        windows = dict(zip(("a b c", "b c d"), h.view(np.int64).tolist()))
        assert all(r["h"] == windows[r["phrase"]] for r in found if r["lang"] == lang)


def test_a_phrase_spread_thin(spark):
    """Once in each document and shard: no shard sees it often, the corpus does."""
    texts = [(i, f"alpha beta own{i} gamma", "en", "s", 1) for i in range(40)]
    rows = mined(spark.createDataFrame(texts, SCHEMA).repartition(20))
    assert rows == [("en", 1, "alpha beta", 40, 40, 40, 160, 1_000_000)]


def test_long_texts(spark):
    text = "one two three four five. " * 200_000
    docs = spark.createDataFrame([(i, text, "en", f"s{i}", len(text)) for i in range(3)], SCHEMA)
    rows = mined(docs)
    assert [r[2] for r in rows] == ["one two three four", "two three four five"]
    assert rows[0][3] == 600_000
    assert all(r[4] == 0 for r in audited(docs) if r[2] == "pair")


def test_empty_and_clashing(none, clashing):
    assert audited(none) == [] and mined(none) == []
    assert {r[2] for r in audited(clashing)} <= {"pair", "term"}
    names = clashing.selectExpr("*", "'x' as term", "'x' as spread", "'x' as phrase", "'x' as lang2", "'x' as places")
    rows = [(r["text"], r["lang"], r["source"]) for r in clashing.collect()]
    assert audited(names) == plain_audit(rows)
    assert mined(names, support=2) == plain_collocations([r[:2] for r in rows], 2)
