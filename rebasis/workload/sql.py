"""Building blocks of the SQL twins: order keys, the stand-in tables, top-k, term vectors."""

from __future__ import annotations

SPACE = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]+"


def key(ident: str, stream: str = "", seed: int = 42) -> str:
    return f"md5(concat('{seed}:{stream}', CAST({ident} AS VARCHAR)))"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}|{SPACE}$', '', 'g')"


def dot(a: str, b: str) -> str:
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


RAW = f"""
raw_corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS _id, concat('  ', source, ' ') AS title, text FROM documents),
raw_queries AS (SELECT CAST(item_id AS VARCHAR) AS _id, text FROM benchmark),
raw_qrels AS (
  SELECT CAST(b.item_id AS VARCHAR) AS query_id, CAST(d.doc_id AS VARCHAR) AS corpus_id,
         CASE WHEN l.toxic = 1 THEN 0 ELSE 1 END AS score, 1 + coalesce(l.quality, 0) AS rel
  FROM documents d JOIN benchmark b ON contains(d.text, b.text)
  LEFT JOIN labels l ON l.doc_id = d.doc_id),
judged_all AS (SELECT query_id, corpus_id FROM raw_qrels WHERE score > 0)"""

SAMPLED = f"""
sampled AS (
  SELECT query_id FROM (
    SELECT query_id, row_number() OVER (ORDER BY {key('query_id', 'queries')}) AS r
    FROM (SELECT DISTINCT query_id FROM judged_all))
  WHERE r <= (SELECT greatest(1, count(DISTINCT query_id) // 2) FROM judged_all)),
judged AS (SELECT * FROM judged_all WHERE query_id IN (SELECT query_id FROM sampled))"""

FROZEN = f"""
positives AS (SELECT DISTINCT corpus_id AS _id FROM judged),
pool AS (
  SELECT _id, row_number() OVER (ORDER BY {key('_id', 'distractors')}) AS r
  FROM raw_corpus WHERE _id NOT IN (SELECT _id FROM positives)),
taken AS (
  SELECT _id FROM positives UNION ALL
  SELECT _id FROM pool
  WHERE r <= (SELECT count(*) // 2 FROM documents) - (SELECT count(*) FROM positives)),
corpus AS (
  SELECT row_number() OVER (ORDER BY {key('_id', 'shuffle')}) - 1 AS row_idx, _id AS doc_id,
         {strip(strip('title') + " || ' ' || " + strip('text'))} AS text
  FROM raw_corpus WHERE _id IN (SELECT _id FROM taken)),
queries AS (
  SELECT row_number() OVER (ORDER BY _id) - 1 AS row_idx, _id AS query_id, text
  FROM raw_queries WHERE _id IN (SELECT query_id FROM judged)),
qrels AS (
  SELECT DISTINCT q.row_idx AS query_row, c.row_idx AS corpus_row
  FROM judged j JOIN queries q USING (query_id) JOIN corpus c ON c.doc_id = j.corpus_id)"""

FREEZE = ",".join([RAW, SAMPLED, FROZEN])

_ASKED = """
asked AS (SELECT vec_id FROM embeddings)"""

JUDGED_VECTORS = _ASKED + """,
graded AS (
  SELECT a.vec_id AS query_row, a.vec_id + g.step AS corpus_row, 2 - g.step AS rel
  FROM asked a, (VALUES (0), (1)) g(step)
  WHERE a.vec_id + g.step IN (SELECT vec_id FROM embeddings))"""

VECTORS = JUDGED_VECTORS + """,
mixed AS (
  SELECT e.vec_id, list_transform(CAST(e.embedding AS DOUBLE[]),
           lambda x, i: x + 0.35 * coalesce(CAST(n.embedding[i] AS DOUBLE), 0.0)) AS v
  FROM embeddings e LEFT JOIN embeddings n ON n.vec_id = e.vec_id + 1
  WHERE e.vec_id IN (SELECT vec_id FROM asked)),
scaled AS (SELECT vec_id, v, greatest(sqrt(list_dot_product(v, v)), 1e-8) AS n FROM mixed),
vqueries AS (
  SELECT vec_id AS query_row, CAST(list_transform(v, lambda x: x / n) AS FLOAT[]) AS v FROM scaled),
vdocs AS (SELECT vec_id AS corpus_row, embedding AS v FROM embeddings)"""


def ranked(docs: str, queries: str, doc: str = "corpus_row", query: str = "query_row",
           name: str = "ranked", k: int = 10) -> str:
    """A top-k common table over relations with a vector column ``v``."""
    return f"""
{name} AS (
  SELECT {query}, {doc}, score, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY {query} ORDER BY score DESC, {doc}) AS rank FROM (
      SELECT q.{query}, d.{doc}, round({dot('q.v', 'd.v')}, 6) + 0.0 AS score
      FROM {queries} q, {docs} d))
  WHERE rank <= {k})"""


HITS = """
hits AS (
  SELECT g.query_row, g.corpus_row, CASE WHEN r.rank IS NOT NULL THEN 1 ELSE 0 END AS hit
  FROM (SELECT DISTINCT query_row, corpus_row FROM graded) g
  LEFT JOIN ranked r ON r.query_row = g.query_row AND r.corpus_row = g.corpus_row)"""


def terms(relation: str, ident: str, text: str, name: str, dim: int = 256) -> str:
    """Unit term vectors as common table (ident, bucket, w), w rounded to 32 bits."""
    return f"""
{name} AS (
  SELECT {ident}, bucket,
         CAST(CAST(c / greatest(sqrt(sum(c * c) OVER (PARTITION BY {ident})), 1e-8) AS FLOAT) AS DOUBLE) AS w
  FROM (
    SELECT {ident}, CAST(CAST(concat('0x', substr(md5(token), 1, 8)) AS UBIGINT) % {dim} AS INT) AS bucket,
           CAST(count(*) AS DOUBLE) AS c
    FROM (SELECT {ident}, unnest(string_split_regex(lower({text}), '\\s+')) AS token FROM {relation})
    WHERE token <> '' GROUP BY ALL))"""


def ndcg(graded: str, ranked_: str, query: str, doc: str, name: str = "ndcgs") -> str:
    return f"""
ideal AS (
  SELECT {query}, sum(rel / log2(r + 1)) AS idcg FROM (
    SELECT {query}, rel, row_number() OVER (PARTITION BY {query} ORDER BY rel DESC) AS r FROM {graded})
  WHERE r <= 10 GROUP BY {query}),
gained AS (
  SELECT t.{query}, coalesce(sum(g.rel / log2(t.rank + 1)), 0.0) AS dcg
  FROM {ranked_} t LEFT JOIN {graded} g ON g.{query} = t.{query} AND g.{doc} = t.{doc}
  GROUP BY t.{query}),
{name} AS (
  SELECT i.{query}, CASE WHEN idcg > 0 THEN coalesce(dcg, 0.0) / idcg ELSE 0.0 END AS ndcg
  FROM ideal i LEFT JOIN gained USING ({query}))"""


def half(x: str) -> str:
    """The nearest 16-bit float of a double expression."""
    ulp = f"pow(2.0, greatest(floor(log2(abs({x}))), -14.0) - 10.0)"
    return f"CASE WHEN {x} = 0.0 THEN 0.0 ELSE round_even({x} / {ulp}, 0) * {ulp} END"


def tree(table: str, ident: str, order: str, chunk: int) -> str:
    """The fingerprint of fixed index ranges, in three levels."""
    level = f"SELECT {order} AS o, CAST({ident} AS VARCHAR) AS v FROM {table}"
    for _ in range(2):
        level = (
            f"SELECT o // {chunk} AS o, sha256(string_agg(concat(v, chr(0)), '' ORDER BY o)) AS v "
            f"FROM ({level}) GROUP BY o // {chunk}"
        )
    return f"(SELECT substr(sha256(string_agg(concat(v, chr(0)), '' ORDER BY o)), 1, 16) FROM ({level}))"
