"""One registered query for each text operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import (
    decontaminate,
    divergence,
    jaccard,
    lines,
    mixing,
    packing,
    phrases,
    pii,
    quality,
    ranker,
    rans,
    repeats,
    secrets,
)
from vitrine.llm.common import documents
from vitrine.llm.span_sql import PII_SQL, SECRETS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[function.__name__] = function
    return function


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.deduplicate(documents(spark, folder)).select(
        "doc_id", "n_lines", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256")
    )


@query
def op2_token_binary(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return rans.read_corpus(spark, rans.write_corpus(documents(spark, folder), path))


@query
def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontaminate.leaks(documents(spark, folder), items).select(
        "doc_id", "item_id", "n_shared", "n_item", F.round("containment", 6).alias("containment")
    )


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(documents(spark, folder), "doc_id")


@query
def op5_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(documents(spark, folder))


@query
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(documents(spark, folder))


@query
def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(documents(spark, folder))


@query
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, folder)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op9_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(
        documents(spark, folder), F.col("source"), F.concat_ws("/", "source", "lang")
    )


@query
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return ranker.classify(docs, ranker.train(docs, labels))


@query
def op11_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(documents(spark, folder), path).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


@query
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(documents(spark, folder))


@query
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(documents(spark, folder))


SQL["op3_benchmark_decontamination"] = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, text,
         regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w
  FROM documents
  UNION ALL
  SELECT 'i', item_id, text, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')
  FROM benchmark
), shingles AS (
  SELECT DISTINCT side, id, text,
         unnest(CASE WHEN len(w) >= 5
                     THEN list_transform(range(1, len(w) - 3),
                                         lambda i: array_to_string(w[i:i + 4], ' '))
                     WHEN len(w) > 0 THEN ['<' || array_to_string(w, ' ')]
                     ELSE [] END) AS shingle
  FROM words
), items AS (
  SELECT id AS item_id, text, shingle, count(*) OVER (PARTITION BY id, text) AS n_item
  FROM shingles WHERE side = 'i'
)
SELECT d.id AS doc_id, i.item_id, count(*) AS n_shared, i.n_item,
       round(count(*) / i.n_item, 6) AS containment
FROM shingles d JOIN items i ON d.shingle = i.shingle
WHERE d.side = 'd'
GROUP BY d.id, d.text, i.item_id, i.text, i.n_item
HAVING 100 * count(*) >= 80 * i.n_item
"""

SQL["op1_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, text, CASE WHEN coalesce(text, '') = '' THEN []
                            ELSE string_split(text, chr(10)) END AS ls
  FROM documents
), occurrences AS (
  SELECT doc_id, pos, array_to_string(ls[pos + 1:pos + 3], chr(10)) AS three
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM split)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY three ORDER BY doc_id, pos) AS place
  FROM occurrences
), covered AS (
  SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM ranked WHERE place > 1
), single AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM split
), marked AS (
  SELECT s.doc_id, s.pos, s.line, c.pos IS NOT NULL AS gone,
         lag(c.pos IS NOT NULL, 1, false) OVER (PARTITION BY s.doc_id ORDER BY s.pos) AS gone_before
  FROM single s LEFT JOIN covered c ON s.doc_id = c.doc_id AND s.pos = c.pos
), summed AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         count(*) FILTER (gone AND NOT gone_before) AS n_spans,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed s ON d.doc_id = s.doc_id
"""

SQL["op7_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id,
         hash(unnest(CASE WHEN len(w) >= 5
                     THEN list_transform(range(1, len(w) - 3),
                                         lambda i: array_to_string(w[i:i + 4], ' '))
                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
                     ELSE [] END)) AS shingle
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * both_have >= 80 * (a.n + b.n - both_have)
), ends AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS start, doc_id AS at FROM documents
  UNION
  SELECT r.start, e.y FROM reach r JOIN ends e ON e.x = r.at
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.at) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.start = d.doc_id
GROUP BY d.doc_id
"""

SQL["op6_pii"] = PII_SQL
SQL["op9_secret_scans"] = SECRETS_SQL

SQL["op12_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT id, lang, source,
         unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), counts AS (
  SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1))
             // (sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, g.source) + v) AS p
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON s.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), whole AS (
  SELECT k.lang, k.term,
         1 + (1000000000::HUGEINT * (sum(c.c) + 1)) // (sum(sum(c.c)) OVER (PARTITION BY k.lang) + any_value(v)) AS q
  FROM kept k JOIN sizes s ON s.lang = k.lang JOIN counts c ON c.lang = k.lang AND c.term = k.term
  GROUP BY k.lang, k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item,
         coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN grid x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN grid y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), terms AS (
  SELECT g.lang, g.source, g.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM grid g JOIN whole w ON g.lang = w.lang AND g.term = w.term
  WHERE g.c > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked
WHERE part = 'pair' OR rank <= 200
"""

SQL["op13_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2),
                                        lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut
  FROM f WHERE k > 1
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.f AS l, r.f AS r,
         (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
  FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')
), lowest AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(w[s:s + n - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, a, w, k, n, unnest(range(1, k - n + 2)) AS s
        FROM (SELECT DISTINCT lang, a, w, k, unnest(range(2, k)) AS n FROM cuts WHERE k > 2))
  GROUP BY ALL
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM lowest s LEFT JOIN inner_phrases i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 80 * s.a
)
SELECT r.lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
