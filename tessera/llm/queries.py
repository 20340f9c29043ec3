"""Registered queries of the training-data operators, with SQL where SQL can
express them. Each applies its operator, with production parameters, to the
whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import collocations, exact_dedup, fingerprints, langid, lines, mixing, packing, setsketch, sharding, simhash, spelling, token_counts, toxicity
from tessera.llm.common import documents, held_out, labels
from tessera.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(documents(spark, sf_dir))


@_register
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, labels(spark, sf_dir))
    return toxicity.with_toxicity(docs.select("doc_id", "text"), model) \
        .select("doc_id", held_out().alias("held_out"), "score", "predicted")


@_register
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.matched_lines(documents(spark, sf_dir))


@_register
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir))


@_register
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


@_register
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(documents(spark, sf_dir))


ORACLE["op6_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@_register
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


@_register
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after an insert of word counts, an insert of estimated tokenizer
    counts, its replay, and the revision of the estimates."""
    docs = documents(spark, sf_dir)
    import uuid
    rollup = token_counts.Rollup(spark, f"{checkpoint_dir(spark)}/llm/rollup-{uuid.uuid4().hex[:12]}")
    return token_counts.load(rollup, docs)


@_register
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs)
    return langid.with_language(docs.select("doc_id", "text"), model) \
        .select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@_register
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@_register
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


ORACLE["op11_phrase_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, 1 AS k, unnest(ws) AS g FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w WHERE len(ws) >= 2
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w WHERE len(ws) >= 3
  UNION ALL SELECT lang, 4, unnest(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]))
    FROM w WHERE len(ws) >= 4),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT lang, g, f FROM f WHERE f >= 30),
c AS MATERIALIZED (SELECT lang, k, g, f, string_split(g, ' ') AS ws FROM f WHERE k >= 2 AND f >= 30),
cut AS MATERIALIZED (
  SELECT lang, g, f AS a, i, array_to_string(ws[1:i], ' ') AS lk, array_to_string(ws[i + 1:k], ' ') AS rk
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
s AS (
  SELECT cut.lang, cut.g, i, a, x.f AS l, y.f AS r, (2000000 * a::HUGEINT) // (x.f::HUGEINT + y.f::HUGEINT) AS score
  FROM cut JOIN often x ON x.lang = cut.lang AND x.g = lk JOIN often y ON y.lang = cut.lang AND y.g = rk),
least_cut AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, i) AS place FROM s),
part AS (
  SELECT lang, f, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))),
inside AS (SELECT lang, g, max(f) AS longer FROM part GROUP BY lang, g),
kept AS (
  SELECT s.* FROM least_cut s LEFT JOIN inside ON inside.lang = s.lang AND inside.g = s.g
  WHERE place = 1 AND (longer IS NULL OR 100 * longer < 80 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT ranked.lang, rank, g AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""


@_register
def op12_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_classes(documents(spark, sf_dir))


ORACLE["op12_setsketch_neardup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
           WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
           ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r(node, reach) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reach),
c AS (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN c ON s.doc_id = c.doc_id
"""


@_register
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


ORACLE["op13_spelling_variants"] = r"""
WITH RECURSIVE
tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
o AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents),
d AS (SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM o GROUP BY doc_id, run),
h AS (
  SELECT run, c, xor(4294967295, list_reduce([4294967295] || list_transform(range(0, len(code) // 2), lambda i: ('0x' || substr(code, 2 * i + 1, 2))::BIGINT),
           lambda v, b: xor(t[(xor(v, b) & 255) + 1], v >> 8))) AS draw
  FROM d, tab),
e AS (
  SELECT CASE WHEN draw % 97 = 0 THEN left(run, draw % length(run)) || substr(run, draw % length(run) + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
x AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM w a JOIN x b ON b.cut = a.word
  UNION SELECT b.word, a.word, a.n FROM w a JOIN x b ON b.cut = a.word),
best AS (
  SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM near),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word AND place = 1),
chain(word, node) AS (SELECT word, word FROM f UNION SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.node WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.node AS root, f.n, f.n_near, f.form_n
FROM f JOIN chain ON chain.word = f.word JOIN f stop ON stop.word = chain.node AND stop.form IS NULL
"""


@_register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


__all__ = ["QUERIES", "ORACLE"]
