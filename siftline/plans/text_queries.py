"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunks, dedupe
from ..session import spread, table
from . import sqltext as S
from .fixtures import CANDIDATES_SQL, QUERIES_SQL, candidates, literal, queries, values
from .registry import query

CJK_ROWS = [
    (1, "日本語のテキストです。検索エンジン"), (2, "plain english words only"), (3, "漢字 mixed with a longer english sentence"), (4, "한국어 문장 입니다"), (5, ""), (6, "中"), (7, "东京 tokyo 东京"), (8, None),
]
_CONTENT = r"regexp_replace(coalesce(t, ''), '[\s\x0b\x85\p{Z}\p{P}\p{Cc}]', '', 'g')"
_CJK = r"regexp_replace(coalesce(t, ''), '[^\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]', '', 'g')"


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


@query("rank_tokens", f"SELECT doc_id, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {S.rank_tokens('text')} AS t FROM documents)")
def rank_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", X.let(X.rank_tokens(F.col("text")), lambda t: F.struct(F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))).alias("r")).select("doc_id", "r.*")


@query("chunk_tokens", f"SELECT doc_id, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {S.chunk_tokens('text')} AS t FROM documents)")
def chunk_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", X.let(X.chunk_tokens(F.col("text")), lambda t: F.struct(F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))).alias("r")).select("doc_id", "r.*")


@query("token_counts", f"SELECT token, count(*) AS n FROM (SELECT unnest({S.chunk_tokens('text')}) AS token FROM documents) GROUP BY token")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A9. The fields are exploded from the plain split; the token rules follow on the exploded rows, so no filter is inferred on them."""
    raw = _docs(spark, folder).select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{Nd}]+")).alias("f")).filter(F.octet_length("f") > 1)
    stem = F.when((F.octet_length("f") > 3) & F.col("f").endswith("s"), F.expr("substring(f, 1, length(f) - 1)")).otherwise(F.col("f"))
    return raw.groupBy(stem.alias("token")).agg(F.count("*").alias("n"))


@query("normalize_text", f"SELECT doc_id, sha256(array_to_string({S.fields('text')}, ' ')) AS sha FROM documents")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.sha2(X.normalize_text(F.col("text")), 256).alias("sha"))


@query("word_count", f"SELECT doc_id, len({S.fields('text')})::INTEGER AS words FROM documents")
def word_count(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", X.word_count(F.col("text")).alias("words"))


_SHINGLES = f"CASE WHEN len(t) >= 3 THEN list_distinct({S.grams('t', 3)}) ELSE list_distinct(t) END"


@query("shingles", f"SELECT doc_id, len(s)::INTEGER AS n, md5(array_to_string(list_sort(s), '|')) AS md5 FROM (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {S.fields('text')} AS t FROM documents))")
def shingles(spark: SparkSession, folder: str) -> DataFrame:
    out = X.let(X.shingles(F.col("text")), lambda s: F.struct(F.size(s).alias("n"), F.md5(F.array_join(F.sort_array(s), "|")).alias("md5")))
    return _docs(spark, folder).select("doc_id", out.alias("r")).select("doc_id", "r.*")


@query("cjk_dominant", f"SELECT id, length({_CONTENT}) > 0 AND length({_CJK}) >= 0.3 * length({_CONTENT}) AS dominant FROM ({values(CJK_ROWS)}) v(id, t)")
def cjk_dominant(spark: SparkSession, folder: str) -> DataFrame:
    return literal(spark, CJK_ROWS, "id int, t string").select("id", X.is_cjk_dominant(F.col("t")).alias("dominant"))


@query(
    "cjk_shingles",
    f"""SELECT id, coalesce(array_to_string(list_sort(list_distinct(CASE WHEN length(c) = 0 THEN []::VARCHAR[] WHEN length(c) = 1 THEN [c] ELSE list_transform(range(1, length(c)), lambda i: substr(c, i, 2)) END)), '|'), '') AS shingles
    FROM (SELECT id, lower({_CONTENT}) AS c FROM ({values(CJK_ROWS)}) v(id, t))""",
)
def cjk_shingles(spark: SparkSession, folder: str) -> DataFrame:
    return literal(spark, CJK_ROWS, "id int, t string").select("id", F.array_join(F.sort_array(X.cjk_shingles(F.col("t"))), "|").alias("shingles"))


@query("split_chunks")
def split_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.posexplode(X.split_chunks("text")).alias("chunk_no", "chunk"))


@query(
    "query_profile",
    f"""WITH {QUERIES_SQL}, t AS (SELECT query_id, {S.chunk_tokens('q')} AS a FROM queries), d AS (SELECT query_id, {S.ordered_distinct('a')} AS t FROM t)
    SELECT query_id, array_to_string(t, ' ') AS terms, coalesce(array_to_string({S.phrases('t')}, '|'), '') AS phrases FROM d""",
)
def query_profile(spark: SparkSession, folder: str) -> DataFrame:
    rows = queries(spark, folder).select("query_id", X.query_profile(F.col("q")).alias("p"))
    return rows.select("query_id", F.array_join("p.terms", " ").alias("terms"), F.array_join("p.phrases", "|").alias("phrases"))


# the lines of each candidate document as chunks, with its title as the scoring context
_PARTS_SQL = f"""{CANDIDATES_SQL},
lines AS (SELECT query_id, q, doc_id, title, unnest(string_split(text, chr(10))) AS chunk, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_no FROM candidates),
prep AS (SELECT query_id, doc_id, chunk_no, {S.chunk_tokens('chunk')} AS tok, {S.chunk_tokens('title')} AS ctx, a FROM lines JOIN (SELECT query_id, {S.chunk_tokens('q')} AS a FROM queries) USING (query_id)),
terms AS (SELECT *, {S.ordered_distinct('a')} AS terms FROM prep),
matched AS (SELECT *, {S.phrases('terms')} AS phrases, list_filter(terms, lambda t: list_contains(tok, t)) AS m, len(list_filter(tok, lambda x: list_contains(terms, x))) AS hits FROM terms WHERE len(terms) > 0),
scored AS (SELECT query_id, doc_id, chunk_no, CASE WHEN len(m) = 0 THEN 0.0 ELSE (len(m) / len(terms) + 0.35 * ln(1 + hits) / len(terms)
  + coalesce(list_sum(list_transform(list_filter(phrases, lambda p: contains(' ' || array_to_string(tok, ' ') || ' ', ' ' || p || ' ')),
      lambda p: CASE WHEN len(string_split(p, ' ')) = len(terms) THEN 0.75 ELSE 0.18 * (len(string_split(p, ' ')) - 1) END)), 0)
  + least(0.18, coalesce(list_sum(list_transform(list_filter(m, lambda t: list_contains(ctx, t)), lambda t: 0.06 + 0.02 * ln(1 + len(list_filter(ctx, lambda c: c = t))))), 0)))
  * CASE WHEN len(tok) <= 0 THEN 0 WHEN len(tok) < 6 THEN 0.85 WHEN len(tok) <= 90 THEN 1 ELSE greatest(0.72, 1 - (len(tok) - 90) / 220.0) END END AS score FROM matched)"""


def _line_scores(spark: SparkSession, folder: str) -> DataFrame:
    lines = candidates(spark, folder).select("query_id", "q", "doc_id", "title", F.posexplode(F.split("text", "\n")).alias("chunk_no", "chunk"))
    return chunks.score_parts(lines, "query_id", "doc_id", "chunk_no", context="title")


@query("chunk_scores", f"WITH {_PARTS_SQL} SELECT query_id, doc_id, chunk_no::INTEGER AS chunk_no, round(score, 6) AS score FROM scored")
def chunk_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _line_scores(spark, folder).select("query_id", "doc_id", "chunk_no", F.round("score", 6).alias("score"))


@query(
    "chunk_topk",
    f"""WITH {_PARTS_SQL} SELECT query_id, doc_id, chunk_no::INTEGER AS chunk_no, score, chunk_rank::INTEGER AS chunk_rank FROM (
    SELECT query_id, doc_id, chunk_no, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 6) DESC, chunk_no) AS chunk_rank FROM scored WHERE round(score, 6) > 0) WHERE chunk_rank <= 3""",
)
def chunk_topk(spark: SparkSession, folder: str) -> DataFrame:
    scored = _line_scores(spark, folder).withColumn("score", F.round("score", 6))
    return chunks.top_chunks(scored, 3, "query_id", "doc_id").select("query_id", "doc_id", "chunk_no", "score", "chunk_rank")


@query("attach_chunks")
def attach_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """F9 to F11 over whole documents: the three best passages of each candidate for its request."""
    scored = chunks.score_chunks(candidates(spark, folder), "query_id", "doc_id", context="title")
    return chunks.top_chunks(scored.withColumn("score", F.round("score", 6)), 3, "query_id", "doc_id").select("query_id", "doc_id", "chunk_no", "chunk", "score", "chunk_rank")


_SETS = f"SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {S.fields('text')} AS t FROM documents)"


@query(
    "jaccard_pairs",
    f"""WITH x AS ({_SETS}) SELECT a.doc_id AS a, b.doc_id AS b, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0.0
    ELSE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))::DOUBLE END, 6) AS jaccard FROM x a JOIN x b ON b.doc_id = a.doc_id + 1""",
)
def jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    sets = _docs(spark, folder).select("doc_id", X.shingles(F.col("text")).alias("s"))
    a, b = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(X.jaccard(F.col("sa"), F.col("sb")), 6).alias("jaccard"))


_REPS = f"""n AS (SELECT doc_id, {S.fields('text')} AS t FROM documents), g AS (SELECT array_to_string(t, ' ') AS k, min(doc_id) AS rep, any_value(t) AS t FROM n WHERE len(t) > 0 GROUP BY 1),
e AS (SELECT rep, unnest({_SHINGLES}) AS h FROM g), c AS (SELECT rep, count(*) AS n FROM e GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS i FROM e a JOIN e b ON a.h = b.h AND a.rep < b.rep GROUP BY 1, 2),
j AS (SELECT a, b, i / (x.n + y.n - i)::DOUBLE AS jaccard FROM p JOIN c x ON x.rep = a JOIN c y ON y.rep = b)"""


@query("near_dup_pairs", f"WITH {_REPS} SELECT a, b, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.85")
def near_dup_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of the representatives of equal texts; near_dup_members has the texts of each."""
    _, pairs = dedupe.near_duplicate_pairs(_docs(spark, folder), "doc_id")
    return pairs.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("near_dup_members", f"WITH {_REPS} SELECT doc_id, rep FROM n JOIN g ON array_to_string(n.t, ' ') = k")
def near_dup_members(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.near_duplicate_pairs(_docs(spark, folder), "doc_id")[0].select(F.col("doc_id"), "rep")


# requests as ranked lists: a constant score within a block of ten documents gives both kinds of preference
_COLLAPSE = f"""WITH RECURSIVE r AS (SELECT doc_id % 4 AS query_id, doc_id AS pos, (1000 - doc_id // 400)::DOUBLE AS score, strlen(coalesce(text, '')) AS bytes, {S.fields('text')} AS t FROM documents),
s AS (SELECT query_id, pos, score, bytes, {_SHINGLES} AS s FROM r), x AS (SELECT query_id, pos, unnest(s) AS h FROM s),
p AS (SELECT a.query_id, a.pos AS i, b.pos AS j, count(*) AS n FROM x a JOIN x b ON a.query_id = b.query_id AND a.h = b.h AND a.pos < b.pos GROUP BY 1, 2, 3),
e AS (SELECT p.query_id, i, j, CASE WHEN a.score <> b.score THEN a.score > b.score ELSE a.bytes >= b.bytes END AS i_wins,
  row_number() OVER (PARTITION BY p.query_id ORDER BY i, j) AS k FROM p JOIN s a ON a.query_id = p.query_id AND a.pos = i JOIN s b ON b.query_id = p.query_id AND b.pos = j
  WHERE n / (len(a.s) + len(b.s) - n)::DOUBLE >= 0.85),
f AS (SELECT DISTINCT query_id, 0::BIGINT AS k, []::BIGINT[] AS gone FROM e
  UNION ALL SELECT f.query_id, e.k, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone ELSE list_append(gone, CASE WHEN i_wins THEN j ELSE i END) END
  FROM f JOIN e ON e.query_id = f.query_id AND e.k = f.k + 1),
d AS (SELECT query_id, unnest(gone) AS pos FROM (SELECT query_id, arg_max(gone, k) AS gone FROM f GROUP BY query_id))
SELECT s.query_id, s.pos FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.query_id = s.query_id AND d.pos = s.pos)"""


@query("near_dup_collapse", _COLLAPSE)
def near_dup_collapse(spark: SparkSession, folder: str) -> DataFrame:
    rows = _docs(spark, folder).select((F.col("doc_id") % 4).alias("query_id"), F.col("doc_id").alias("pos"), (1000 - F.floor(F.col("doc_id") / 400)).cast("double").alias("score"), "text")
    return dedupe.collapse_near_duplicates(rows).select("query_id", "pos")


@query(
    "content_sha_dedupe",
    f"""WITH n AS (SELECT doc_id, text, array_to_string({S.fields('text')}, ' ') AS k FROM documents)
    SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS n FROM n) WHERE n = 1 OR coalesce(text, '') = ''""",
)
def content_sha_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.dedupe_content(_docs(spark, folder), [], "doc_id").select("doc_id")
