"""Mixing, the encoded corpus, the classifier and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import SCHEMA, odd_rows, sentence
from vitrine.llm import mixing, quality, ranker, rans

FOLDER = "/root/testdata/sf0.001"


def water_level(sizes):
    """Targets by resharing what is above the cap until nothing is."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        spare = total - sum(capped.values())
        share = sum(weight[s] for s in rest)
        target = {s: spare * weight[s] / share for s in rest} if rest else {}
        over = [s for s in rest if target[s] > 3 * sizes[s]]
        if not over:
            return capped | target
        capped |= {s: 3 * sizes[s] for s in over}


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(9)
    rows, i = [], 0
    for source, n in [("a", 300), ("b", 3), ("c", 120), ("d", 40), (None, 30), ("zero", 2), ("é", 25)]:
        for _ in range(n):
            text = "" if source == "zero" else sentence(rng, rng.randrange(1, 200))
            rows.append((i, text, "en", source, len(text)))
            i += 1
    rows.append((i, None, "en", "a", None))
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def test_mix(sources):
    rows = sources.collect()
    size = {r.doc_id: len(brute.WORD.findall(r.text or "")) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size[r.doc_id]
    expected = water_level(sizes)
    source = {r.doc_id: r.source for r in rows}
    got = {r.doc_id: r for r in mixing.taken(sources).collect()}
    assert set(got) == set(size)
    took = Counter()
    for i, r in got.items():
        assert r.size == size[i] and r.source_size == sizes[source[i]]
        assert math.isclose(r.target, expected[source[i]], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        took[source[i]] += r.taken
    for s, target in expected.items():
        assert abs(took[s] - target) <= max(16, 0.01 * target), s
    again = {r.doc_id: r.taken for r in mixing.taken(sources.repartition(3)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_mix_pieces(sources):
    """Shards are even and disjoint; a pass takes no word twice; the texts are the pieces."""
    documents, pieces = mixing.mix(sources)
    rows = pieces.collect()
    words = Counter()
    for r in rows:
        words[r.shard] += r["last"] - r["first"]
    assert len(words) == 8 and max(words.values()) < 1.2 * min(words.values())
    spans = brute.grouped(((r.doc_id, r["pass"]), (r["first"], r["last"])) for r in rows)
    for found in spans.values():
        found.sort()
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    for shard, slots in brute.grouped((r.shard, r.slot) for r in rows).items():
        assert sorted(slots) == list(range(1, len(slots) + 1))
    texts = {r.doc_id: r.text for r in sources.collect()}
    mixed = mixing.mixed(sources)
    assert mixed.columns == sources.columns
    out = mixed.collect()
    assert len(out) == len(spans)
    total = Counter()
    for r in out:
        total[r.doc_id] += len(brute.WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    for (i, _), found in spans.items():
        total[i] -= sum(b - a for a, b in found)
    assert not any(total.values())
    assert any(r.text == texts[r.doc_id].strip() for r in out)


def test_mix_takes_whole_documents(sources):
    """Of each source one document at most is cut; the places are those of the pieces."""
    texts = {r.doc_id: (r.source, r.text or "") for r in sources.collect()}
    cut = Counter()
    for r in mixing.mixed(sources).collect():
        source, text = texts[r.doc_id]
        assert r.text in text
        cut[source] += r.text != text.strip()
    assert max(cut.values()) == 1
    _, pieces = mixing.mix(sources)
    expected = brute.grouped((r.doc_id, (r["pass"], r["first"], r.shard, r.slot)) for r in pieces.collect())
    for r in mixing.taken(sources).collect():
        assert list(zip(r.shard, r.slot)) == [p[2:] for p in sorted(expected.get(r.doc_id, []))]


def test_mix_runs_of_long_documents(sources, monkeypatch):
    """Blocks of a long document that do not follow on each other are rows of their own."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 20)
    texts = {r.doc_id: r.text for r in sources.collect()}
    _, pieces = mixing.mix(sources)
    runs = Counter()
    for (i, _), spans in brute.grouped(((r.doc_id, r["pass"]), (r["first"], r["last"])) for r in pieces.collect()).items():
        spans.sort()
        runs[i] += 1 + sum(a[1] != b[0] for a, b in zip(spans, spans[1:]))
    rows = mixing.mixed(sources).collect()
    assert all(r.text in texts[r.doc_id] for r in rows)
    assert Counter(r.doc_id for r in rows) == runs and max(runs.values()) > 3


def test_hypergeometric_draws(spark):
    """Mean and spread of the draws, and their limits."""
    frame = spark.range(4000).select(
        mixing.hypergeometric(F.lit(40), F.lit(60), F.lit(30), mixing.uniform(F.col("id"))).alias("x"),
        mixing.hypergeometric(F.lit(5), F.lit(0), F.lit(3), mixing.uniform(F.col("id"))).alias("all"),
        mixing.hypergeometric(F.lit(0), F.lit(9), F.lit(3), mixing.uniform(F.col("id"))).alias("none"),
        mixing.hypergeometric(F.lit(8), F.lit(2), F.lit(9), mixing.uniform(F.col("id"))).alias("most"),
        mixing.hypergeometric(F.lit(50_000), F.lit(70_000), F.lit(60_000), mixing.uniform(F.col("id"))).alias("big"),
    )
    rows = frame.toPandas()
    assert abs(rows.x.mean() - 12) < 0.2 and abs(rows.x.var() - 30 * 0.4 * 0.6 * 70 / 99) < 0.4
    assert set(rows["all"]) == {3} and set(rows.none) == {0} and set(rows.most) == {7, 8}
    spread = math.sqrt(60_000 * (5 / 12) * (7 / 12) * 0.5)
    assert abs(rows.big.mean() - 25_000) < spread / 10 and abs(rows.big.std() / spread - 1) < 0.05


def test_splitting_tree_keeps_quotas(spark):
    rows = [(1, 1000), (2, 0), (3, 77), (4, 12345)]
    ranges = mixing.shard_ranges(spark.createDataFrame(rows, "source_no int, draws long"), 4).collect()
    for source, draws in rows:
        mine = sorted((r["first"], r["last"]) for r in ranges if r.source_no == source)
        assert sum(b - a for a, b in mine) == draws
        assert all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
    totals = Counter()
    for r in ranges:
        totals[r.shard] += r["last"] - r["first"]
    assert max(totals.values()) - min(totals.values()) <= 1 and len(totals) == 16


def test_mix_edges(spark, none, clashing):
    assert mixing.taken(none).count() == 0 and mixing.mixed(none).count() == 0
    got = mixing.taken(clashing).collect()
    assert len(got) == 7 and sum(r.taken for r in got) > 0
    assert mixing.mixed(clashing).columns == clashing.columns
    blank = spark.createDataFrame([(1, None, "en", "a", None), (2, " ", "en", None, 1)], SCHEMA)
    assert [(r.size, r.target, r.taken) for r in mixing.taken(blank).collect()] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("n", [1, 2, 63, 64, 5000, 200_000])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.2, n) % 40_000).astype(np.uint16)
    table = rans.Table(rans.scaled(np.bincount(ids, minlength=1 << 16)))
    assert table.freq.sum() == 1 << rans.SCALE
    payload = rans.encode(ids, table)
    assert (rans.decode(payload, table) == ids).all()
    lanes = max(1, min(rans.LANES, n // 64))
    for k in range(1, (-(-n // lanes) - 1) // rans.STEPS + 1):
        assert (rans.decode(payload, table, k) == ids[k * rans.STEPS * lanes :]).all()
    if n >= 5000:
        share = np.bincount(ids) / n
        bits = -(share[share > 0] * np.log2(share[share > 0])).sum() * n
        assert 8 * len(payload) < 1.02 * bits + 64 * lanes * (2 + n // (lanes * rans.STEPS)) + 500


def test_scaled_with_many_rare_ids():
    counts = np.ones(1 << 16, np.int64)
    counts[7] = 10**12
    freq = rans.scaled(counts)
    assert freq.sum() == 1 << rans.SCALE and freq.min() == 1 and freq[7] == freq.max()
    assert rans.scaled(np.zeros(1 << 16, np.int64)).sum() == 0


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def encoded(docs):
    """What op2 returns, from plain encoding of (doc_id, text) in order."""
    _, plain = tokenizer()
    start, rows = 0, []
    for i, text in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        rows.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return rows


def test_token_corpus(spark, odd, texts, none, clashing, monkeypatch):
    path, _ = tokenizer()
    strange = {
        400: "a\x01b \x01 <|endoftext|> x<|startoftext|>y", 401: "ÀÉ́ İ̇ ΑΣ Σ x y\tz\r\nw",
        402: "́start it's DON'T 12345 😀😀", 403: "\x01", 404: " ", 405: "\n\n",
    }
    table = odd.select("doc_id", "text").unionAll(spark.createDataFrame(list(strange.items()), "doc_id long, text string"))
    monkeypatch.setattr(rans, "BLOCK", 3000)
    folder = rans.write_corpus(table.repartition(4), path)
    got = sorted(tuple(r)[:4] for r in rans.read_corpus(spark, folder).collect())
    assert got == encoded(sorted({**texts, **strange}.items()))
    assert spark.read.parquet(f"{folder}/blocks").count() > 3
    assert rans.read_corpus(spark, rans.write_corpus(none, path)).count() == 0
    again = rans.read_corpus(spark, rans.write_corpus(clashing, path)).collect()
    assert len(again) == 7 and {r.doc_id for r in again if r.start < 40} <= {None, 7}


def test_capitals_that_compose_only_in_lower_case():
    path, plain = tokenizer()
    marked = ["H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u030c"]
    texts = [*marked, *(f"THE {m}ouse, a{m} {m.lower()} ÉCOLE Don\u2019T end" for m in marked), "PLAIN Words, ALL."]
    expected = [np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u2").tobytes() for t in texts]
    assert rans.Encoder(path).encode(texts, 2) == expected
    beside = rans.Encoder(path).encode([*texts, "x <|endoftext|> Y"], 2)
    assert beside[:-1] == expected


def test_damaged_block_is_found(spark, odd):
    path, _ = tokenizer()
    folder = rans.write_corpus(odd, path)
    blocks = spark.read.parquet(f"{folder}/blocks").withColumn("crc32", F.col("crc32") + 1)
    freq = np.zeros(1 << 16, np.int64)
    for r in spark.read.parquet(f"{folder}/table").collect():
        freq[r.id] = r.freq
    rows = blocks.limit(1).toArrow().to_batches()
    with pytest.raises(ValueError, match="damaged"):
        list(rans._decoded(iter(rows), None, freq))


def test_classifier_holds_out_and_learns(spark):
    from vitrine.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op10_quality_classifier"](spark, folder).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, _, q in held if q], [s for s, _, q in held if not q]
    assert sum(g > b for g in good for b in bad) > 0.95 * len(good) * len(bad)
    assert sum(p == q for _, p, q in held) > 0.95 * len(held)


def test_classifier_edges(spark, odd, none, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (10, None, 0)], "doc_id long, quality int, toxic int")
    assert ranker.train(odd, labels) is None
    rows = ranker.classify(odd, None).collect()
    assert {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {1}
    assert ranker.classify(none, None).count() == 0
    rows = ranker.classify(clashing, None).collect()
    assert len(rows) == 7 and not any(r.held_out for r in rows if r.doc_id is None)


def test_fit_orders_by_preference():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    good = x @ np.array([2.0, -1.0, 0, 0]) + 0.1 * rng.normal(size=500) > -1.0
    model = ranker.fit(x, good)
    found = ranker.score(x, model)
    assert ((found >= ranker.CUT) == good).mean() > 0.95
    assert (ranker.score(x, model) == found).all()


def test_fit_with_mostly_bad_labels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    value = x @ np.array([2.0, -1.0, 0.5, 0])
    good = value > np.quantile(value, 0.8)
    found = ranker.score(x, ranker.fit(x, good))
    assert ((found >= ranker.CUT) == good).mean() > 0.97


def test_pipeline_stages(spark):
    """Each stage on what the one before kept, against brute force."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "near_copies", "decontaminate", "mix", "encode"]

    good = steps["quality"](spark, docs, FOLDER).cache()
    assert good.columns == docs.columns
    judged = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, kept in judged.items() if kept}

    single = steps["near_copies"](spark, good, FOLDER).cache()
    left = {r.doc_id: r.text for r in good.collect()}
    firsts = brute.jaccard_components(left)
    assert {r.doc_id for r in single.collect()} == set(firsts.values()) and single.columns == docs.columns

    clean = steps["decontaminate"](spark, single, FOLDER).cache()
    needs = {i: brute.shingles(t.lower()) for i, t in items.items()}

    def leaks(text):
        mine = brute.shingles(text.lower())
        return any(n and 100 * len(n & mine) >= 80 * len(n) for n in needs.values())

    assert {r.doc_id for r in clean.collect()} == {i for i in set(firsts.values()) if not leaks(texts[i])}

    mixed = steps["mix"](spark, clean, FOLDER).cache()
    assert mixed.columns == docs.columns
    words = lambda t: len(brute.WORD.findall(t))
    before = sum(words(r.text) for r in clean.collect())
    assert abs(sum(words(r.text) for r in mixed.collect()) - before) < 0.02 * before

    got = sorted(tuple(r)[:4] for r in steps["encode"](spark, mixed, FOLDER).collect())
    order = mixed.select("doc_id", "text", F.xxhash64("text").alias("k")).orderBy("doc_id", "k").collect()
    assert sorted(encoded([(r.doc_id, r.text) for r in order])) == got


def test_run_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    total = max(r.start + r.n_tokens for r in rows)
    assert sum(r.n_tokens for r in rows) == total
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_rows_are_odd():
    assert len({r[0] for r in odd_rows()}) == len(odd_rows())
