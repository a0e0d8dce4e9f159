"""The registered queries of the retrieval and structure operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.functions import text as T
from seekspark.functions import vectors as V
from seekspark.operators import chunks as C
from seekspark.operators import graph as G
from seekspark.operators import incremental as I
from seekspark.operators import metrics as M
from seekspark.operators import navigation as N
from seekspark.operators import pairs as P
from seekspark.operators import postings as X
from seekspark.operators import ranking as R
from seekspark.plans.scratch import shared_dir
from seekspark.streaming import changes as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
TERMS = ["tion", "the", "license"]
RANK_ROUNDS = 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs_with_path(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- keyword ranking ---


def bm25_sql(fields: dict[str, float], terms: list[str], cte: str = "bm") -> str:
    parts, scores = [], []
    for i, (expr, w) in enumerate(fields.items()):
        parts.append(f"tk{i} AS (SELECT doc_id, regexp_extract_all(lower(coalesce({expr}, '')), '[\\p{{L}}\\p{{N}}]+') AS toks FROM documents), st{i} AS (SELECT count(*) AS n, avg(len(toks)) AS av FROM tk{i})")
        for j, term in enumerate(terms):
            words = term.split(" ")
            if len(words) == 1:
                tf = f"len(list_filter(toks, lambda x: x = '{term}'))"
            else:
                tf = "len(list_filter(range(1, len(toks) + 1), lambda p: " + " AND ".join(f"toks[p + {k}] = '{w_}'" for k, w_ in enumerate(words)) + "))"
            idf = " + ".join(f"ln(1 + (st{i}.n - (SELECT count(*) FROM tk{i} WHERE list_contains(toks, '{w_}')) + 0.5) / ((SELECT count(*) FROM tk{i} WHERE list_contains(toks, '{w_}')) + 0.5))" for w_ in words)
            parts.append(f"s{i}_{j} AS (SELECT doc_id, {tf} AS tf, {w} * ({idf}) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len(toks) / greatest(st{i}.av, 1e-9))) AS s FROM tk{i}, st{i})")
            scores.append(f"SELECT doc_id, tf, s FROM s{i}_{j}")
    return ", ".join(parts) + f", {cte} AS (SELECT doc_id, sum(s) AS score FROM ({' UNION ALL '.join(scores)}) GROUP BY doc_id HAVING sum(tf) > 0)"


BODY = {"text": 1.0}
NAMED = {"source": 9.0, "source || '/' || lang || '/' || doc_id || '.txt'": 2.25, "text": 1.0}


_INDEXES: dict = {}


def indexed(spark, d: str, name: str, fields: dict, weights: dict, tokens=T.plain_tokens, docs: DataFrame | None = None, id_col: str = "doc_id") -> X.Index:
    """The inverted index of a table, built once for a session by the first search that reads it."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _INDEXES:
        path = f"{shared_dir(spark)}/index-{name}-{uuid.uuid4().hex}"
        rows = docs_with_path(spark, d) if docs is None else docs
        _INDEXES[key] = X.Index(spark, path, weights, tokens, lambda: X.build(rows, id_col, fields, weights, path, tokens))
    return _INDEXES[key]


def clauses(terms: list[str]) -> list[X.Clause]:
    return [X.Clause(tuple(term.split(" "))) for term in terms]


def body_index(spark, d):
    return indexed(spark, d, "body", {"text": "text"}, BODY)


def body_rank(spark, d, k=None):
    return X.search(body_index(spark, d), clauses(TERMS), k, "doc_id")


@query(f"WITH {bm25_sql(BODY, TERMS)} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 10")
def bm25_topk(spark, d):
    return rounded(body_rank(spark, d, 10), "score")


@query(f"WITH {bm25_sql(NAMED, ['src3', 'en', 'tion'])} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20")
def bm25_fielded(spark, d):
    weights = dict(zip(("source", "path", "text"), R.FIELD_WEIGHTS))
    return rounded(X.search(indexed(spark, d, "named", {n: n for n in weights}, weights), clauses(["src3", "en", "tion"]), 20, "doc_id"), "score")


@query(f"WITH {bm25_sql(BODY, ['of the', 'is licensed'])} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 10")
def bm25_phrase(spark, d):
    return rounded(X.search(body_index(spark, d), clauses(["of the", "is licensed"]), 10, "doc_id"), "score")


_PARTS = r"list_filter(string_split(lower(regexp_replace(regexp_replace({x}, '([\p{{Ll}}0-9])(\p{{Lu}})', '\1_\2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1_\2', 'g')), '_'), lambda y: y <> '')"


@query(r"SELECT p_partkey, array_to_string(flatten(list_transform(regexp_extract_all(s, '[\p{L}\p{N}]+'), lambda x: list_concat([lower(x)], CASE WHEN len(" + _PARTS.format(x="x") + r") > 1 THEN " + _PARTS.format(x="x") + r" ELSE [] END))), ' ') AS tokens, array_to_string(" + _PARTS.format(x="regexp_replace(s, '[^A-Za-z0-9]', '', 'g')") + r", ' ') AS parts FROM (SELECT p_partkey, p_name || ' parseJsonConfig ' || p_brand || ' HTML5Parser ' || p_type AS s FROM part)")
def code_split_tokens(spark, d):
    s = F.concat_ws(" ", "p_name", F.lit("parseJsonConfig"), "p_brand", F.lit("HTML5Parser"), "p_type")
    rows = t(spark, d, "part").select("p_partkey", s.alias("s"))
    flat = F.regexp_replace("s", "[^A-Za-z0-9]", "")
    return rows.select("p_partkey", F.array_join(T.code_tokens(F.col("s")), " ").alias("tokens"), F.array_join(T.split_identifier(flat), " ").alias("parts"))


# --- chunks ---

_PATH = "source || '/' || lang || '/' || doc_id || '.txt'"


@query(f"SELECT {_PATH} AS path, doc_id || '.txt' AS name, 'file' AS kind, 1::INTEGER AS start_line, (len(regexp_replace(text, '\\n$', '')) - len(replace(regexp_replace(text, '\\n$', ''), chr(10), '')) + 1)::INTEGER AS end_line, strlen(text)::INTEGER AS n_bytes FROM documents WHERE trim(regexp_replace(text, '\\s', ' ', 'g')) <> '' AND strlen(text) <= 4096")
def whole_file_chunks(spark, d):
    return C.whole_files(docs_with_path(spark, d)).select("path", "name", "kind", "start_line", "end_line", F.octet_length("content").alias("n_bytes"))


@query(f"""WITH w AS (SELECT {_PATH} AS path, text, strlen(text) AS n, unnest(range(0, strlen(text), 1536)) AS off FROM documents WHERE strlen(text) = length(text) AND strlen(text) > 0),
p AS (SELECT path, n, off, substr(text, off + 1, 2048) AS part, substr(text, 1, off) AS head FROM w),
c AS (SELECT path, off, head, CASE WHEN off + 2048 >= n OR NOT contains(part, chr(10)) THEN part ELSE substr(part, 1, length(part) - strpos(reverse(part), chr(10)) + 1) END AS content FROM p)
SELECT path, off::INTEGER AS off, sha256(content) AS digest, (length(head) - length(replace(head, chr(10), '')) + 1)::INTEGER AS start_line FROM c WHERE trim(regexp_replace(content, '\\s', ' ', 'g')) <> ''""")
def window_chunks(spark, d):
    docs = docs_with_path(spark, d).where(F.octet_length("text") == F.length("text"))  # the oracle counts characters
    return C.windows(docs).select("path", "off", F.sha2("content", 256).alias("digest"), "start_line")


@query()  # SQL here counts characters, so a brute-force test takes its place
def window_chunks_all(spark, d):
    return C.windows(docs_with_path(spark, d)).select("path", "off", F.sha2("content", 256).alias("digest"), "start_line")


@query("SELECT lang AS family, CASE WHEN strlen(text) <= 4096 THEN 'file' ELSE 'window' END AS kind, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def chunk_kind_mix(spark, d):
    return S.corpus_mix(t(spark, d, "documents").select(F.col("lang").alias("family"), F.when(F.octet_length("text") <= 4096, "file").otherwise("window").alias("kind")), ["family", "kind"])


TURTLE = "@prefix ex: <http://e/> .\n@prefix owl: <http://o/> .\n\nex:Person a owl:Class ;\n  ex:label \"x\" .\nex:knows a owl:Property .\n\n# note\nex:last a ex:Person"


@query(f"""WITH l AS (SELECT unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT string_split('{TURTLE}', chr(10)) AS x)),
f AS (SELECT *, starts_with(line, '@prefix') AS dir, trim(line) = '' AS blank FROM l),
e AS (SELECT *, blank OR (NOT dir AND ends_with(rtrim(line), '.')) AS fin FROM f),
g AS (SELECT *, (coalesce(lag(fin) OVER (ORDER BY pos), false) OR (coalesce(lag(dir) OVER (ORDER BY pos), false) AND NOT dir))::INT AS cut FROM e), b AS (SELECT *, sum(cut) OVER (ORDER BY pos) AS block FROM g)
SELECT string_agg(line, chr(10) ORDER BY pos) AS content, min(pos)::INTEGER AS "start", max(pos)::INTEGER AS "end" FROM b WHERE NOT blank GROUP BY block""")
def rdf_block_chunks(spark, d):
    lines = spark.createDataFrame([("f", TURTLE)], "key string, text string").select("key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return C.rdf_blocks(lines, "key", "pos", "line").select("content", "start", "end")


# --- vectors ---

_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_COS = f"SELECT vec_id, list_dot_product(embedding::DOUBLE[], {_Q}) AS score FROM embeddings"


def q0(spark, d):
    return R.vector_of(t(spark, d, "embeddings"), "vec_id", 0)


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({_COS}) ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    return rounded(R.exact_rank(t(spark, d, "embeddings"), "vec_id", q0(spark, d), None, 10), "score")


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({_COS}) WHERE score >= 0.1")
def cosine_threshold(spark, d):
    return rounded(R.exact_rank(t(spark, d, "embeddings"), "vec_id", q0(spark, d), 0.1), "score")


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({_COS}) WHERE vec_id <> 0 AND score >= 0 ORDER BY score DESC, vec_id LIMIT 10 OFFSET 5")
def find_similar(spark, d):
    return rounded(R.similar(t(spark, d, "embeddings"), "vec_id", 0, 10, 5), "score")


@query("SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 3) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.5")
def near_dup_pairs(spark, d):
    return P.similar_pairs(t(spark, d, "embeddings"), "vec_id", 0.5).withColumn("similarity", F.round("similarity", 3))


_LN = "list_transform({v}, lambda x: (x - list_avg({v})) / sqrt(list_avg(list_transform({v}, lambda y: (y - list_avg({v})) * (y - list_avg({v})))) + 1e-5))"


def _short(v: str, d: int = 16) -> str:
    return f"list_slice({_LN.format(v=v)}, 1, {d})"


_CASCADE = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT vec_id, e, {_short('e')} AS h FROM v),
q AS (SELECT e AS qe, h AS qh FROM s WHERE vec_id = 0),
r AS (SELECT vec_id, list_dot_product(e, qe) AS score, list_cosine_similarity(h, qh) AS rough FROM s, q),
f AS (SELECT * FROM r ORDER BY rough DESC, vec_id LIMIT 100)"""


@query(_CASCADE + " SELECT vec_id, round(score, 6) AS score FROM f WHERE score >= 0 ORDER BY score DESC, vec_id LIMIT 10")
def cascade_topk(spark, d):
    return rounded(R.cascade_rank(t(spark, d, "embeddings"), "vec_id", q0(spark, d), 16, 10), "score")


def _recall(spark, approx: DataFrame, exact: DataFrame) -> DataFrame:
    a, b = (x.agg(F.collect_list("vec_id").alias(n)) for x, n in ((exact, "want"), (approx, "got")))
    return R.recall(a.crossJoin(b), "want", "got").select(F.round("recall", 6).alias("recall"))


@query(f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 0), r AS (SELECT vec_id, list_dot_product(e, qe) AS score, list_cosine_similarity(list_slice(e, 1, 16), list_slice(qe, 1, 16)) AS rough FROM v, q), a AS (SELECT list(vec_id) AS want FROM (SELECT vec_id FROM r ORDER BY score DESC, vec_id LIMIT 10)), b AS (SELECT list(vec_id) AS got FROM (SELECT vec_id FROM r ORDER BY rough DESC, vec_id LIMIT 10)) SELECT round(len(list_intersect(want, got)) / len(want), 6) AS recall FROM a, b")
def mrl_recall(spark, d):
    v, q = t(spark, d, "embeddings"), q0(spark, d)
    short = v.select("vec_id", V.dot(V.truncated(F.col("embedding"), 16), V.truncated(R.literal(q), 16)).alias("score"))
    return _recall(spark, R.top(short, "score", "vec_id", 10), R.exact_rank(v, "vec_id", q, None, 10))


_QUANT = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 0),
p AS (SELECT vec_id, i, e[2 * i + 1] AS x, e[2 * i + 2] AS y, qe[2 * i + 1] AS qx, qe[2 * i + 2] AS qy FROM v, q, range(32) AS r(i)),
c AS (SELECT vec_id, sqrt(x * x + y * y) AS r, least(floor((atan2(y, x) + pi()) / (2 * pi()) * 16), 15) AS j, qx, qy FROM p),
s AS (SELECT vec_id, sum(r * (qx * cos(j / 16 * 2 * pi() - pi()) + qy * sin(j / 16 * 2 * pi() - pi()))) AS rough FROM c GROUP BY vec_id),
f AS (SELECT vec_id FROM s ORDER BY round(rough, 9) DESC, vec_id LIMIT 100)
SELECT vec_id, round(score, 6) AS score FROM ({_COS}) JOIN f USING (vec_id) WHERE score >= 0 ORDER BY score DESC, vec_id LIMIT 10"""


@query(_QUANT)
def quantised_topk(spark, d):
    return rounded(R.quantised_rank(t(spark, d, "embeddings"), "vec_id", q0(spark, d), 10), "score")


@query()
def quantised_recall(spark, d):
    v, q = t(spark, d, "embeddings"), q0(spark, d)
    return _recall(spark, R.quantised_rank(v, "vec_id", q, 10, centre=True), R.exact_rank(v, "vec_id", q, None, 10))


@query("SELECT count(*)::BIGINT AS n, count(*) FILTER (embedding IS NULL OR len(embedding) = 0)::BIGINT AS empty, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x))) > 0)::BIGINT AS nans, count(*) FILTER (len(list_filter(embedding, lambda x: isinf(x))) > 0)::BIGINT AS infs, round(min(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS min_norm, round(max(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS max_norm FROM embeddings")
def embed_sanity(spark, d):
    return M.embedding_sanity(t(spark, d, "embeddings"))


# --- fusion: semantic ids are vec_id, keyword ids doc_id; candidates are the first 100 of either ---

_FUSED = f"""WITH {bm25_sql(BODY, TERMS)},
kw AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM bm QUALIFY r < 100),
sem AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS r FROM ({_COS}) WHERE score >= 0 QUALIFY r < 100),
fused AS (SELECT id, sum(1.0::DOUBLE / (60 + r + 1)) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM sem) GROUP BY id),
norm AS (SELECT id, CASE WHEN max(score) OVER () - min(score) OVER () <= 1.1920929e-07 THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS score FROM fused)"""
_ROUND_ID = "SELECT id, round(score, 6) AS score FROM "


def fused(spark, d) -> DataFrame:
    sem = R.exact_rank(t(spark, d, "embeddings"), "vec_id", q0(spark, d), 0.0, 100).withColumnRenamed("vec_id", "id")
    return R.reciprocal_rank_fusion([sem, body_rank(spark, d, 100).withColumnRenamed("doc_id", "id")], "id")


@query(_FUSED + _ROUND_ID + "fused")
def rrf_hybrid(spark, d):
    return rounded(fused(spark, d), "score")


@query(_FUSED + _ROUND_ID + "norm WHERE norm.score >= 0.3 ORDER BY norm.score DESC, id LIMIT 10")
def minmax_threshold(spark, d):
    return rounded(R.thresholded(R.min_max(fused(spark, d)), "id", 0.3, 10), "score")


@query(_FUSED + ", top AS (SELECT * FROM norm WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 10) SELECT id, round(score * (1 + 0.3 * ln(1 + 10 * coalesce(l.toxic::DOUBLE, 0.5 * p.quality, 0)) / ln(11)), 6) AS score FROM top LEFT JOIN labels l ON l.doc_id = id LEFT JOIN labels p ON p.doc_id = id")
def hybrid_boosted(spark, d):
    top = R.thresholded(R.min_max(fused(spark, d)), "id", 0.3, 10)
    labels = t(spark, d, "labels")
    ranks = labels.select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("key"), F.col("toxic").cast("double").alias("rank")).unionByName(labels.select(F.col("doc_id").cast("string").alias("key"), (0.5 * F.col("quality")).alias("rank")))
    keyed = top.withColumns({"k1": F.concat(F.lit("d:"), F.col("id").cast("string")), "k2": F.col("id").cast("string")})
    return rounded(R.boosted(keyed, "id", ranks, ["k1", "k2"], 0.3).select("id", "score"), "score")


@query(_FUSED + " SELECT id, round(norm.score + 0.2 * (id % 10) / 9, 6) AS score FROM norm")
def additive_boost(spark, d):
    return rounded(R.additive_boost(fused(spark, d).withColumn("r", (F.col("id") % 10) / 9), "r", 0.2).select("id", "score"), "score")


@query(_FUSED + _ROUND_ID + "norm ORDER BY norm.score DESC, id LIMIT 10 OFFSET 20")
def paged_search(spark, d):
    return rounded(R.page(R.top(R.min_max(fused(spark, d)), "score", "id", None), 20, 10), "score")


# --- graphs: nations trade from the customer's to the supplier's ---

_EDGES = "e AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS weight FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"


def trade(spark, d) -> DataFrame:
    c, o, li, s = (t(spark, d, x) for x in ("customer", "orders", "lineitem", "supplier"))
    pairs = o.select("o_orderkey", "o_custkey").join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src")), "o_custkey")
    pairs = li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey")).join(pairs, "o_orderkey").join(s.select("s_suppkey", F.col("s_nationkey").alias("dst")), "s_suppkey")
    return G.counted_edges(pairs)


def nations(spark, d) -> DataFrame:
    return t(spark, d, "nation").select(F.col("n_nationkey").alias("node"))


def rank_sql(edges: str, nodes: str, bias: str, rounds: int) -> str:
    out = [f"{edges}, nd AS ({nodes}), nn AS (SELECT count(*)::DOUBLE AS n FROM nd), ot AS (SELECT src, sum(weight) AS total FROM e GROUP BY src), b AS (SELECT node, ({bias})::DOUBLE AS bias, node NOT IN (SELECT src FROM ot) AS dang FROM nd, nn), r0 AS (SELECT node, bias, dang, 1 / n AS rank FROM b, nn)"]
    for i in range(rounds):
        out.append(f"r{i + 1} AS MATERIALIZED (SELECT r.node, bias, dang, 0.15 * bias + 0.85 * (coalesce(inflow, 0) + bias * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE dang)) AS rank FROM r{i} r LEFT JOIN (SELECT dst, sum(rank * weight / total) AS inflow FROM e JOIN ot USING (src) JOIN r{i} x ON x.node = e.src GROUP BY dst) f ON f.dst = r.node)")
    return "WITH " + ", ".join(out)


_NODES = "SELECT n_nationkey AS node FROM nation"
_RANKED = rank_sql(_EDGES, _NODES, "1 / n", RANK_ROUNDS)


@query(_RANKED + f" SELECT node, round(rank, 6) AS rank FROM r{RANK_ROUNDS}")
def pagerank_trade(spark, d):
    return rounded(G.pagerank(nations(spark, d), trade(spark, d), RANK_ROUNDS, None), "rank")


@query(rank_sql(_EDGES, _NODES, "0.3 / n + CASE WHEN node = 3 THEN 0.7 ELSE 0 END", RANK_ROUNDS) + f" SELECT node, round(rank, 6) AS rank FROM r{RANK_ROUNDS}")
def pagerank_focus(spark, d):
    return rounded(G.pagerank(nations(spark, d), trade(spark, d), RANK_ROUNDS, None, F.col("node") == 3), "rank")


DANGLING = [(0, 1, 2), (1, 2, 1), (2, 0, 1), (2, 3, 3), (4, 0, 1)]


@query(rank_sql("e(src, dst, weight) AS (VALUES " + ", ".join(map(str, DANGLING)) + ")", "SELECT unnest(range(5)) AS node", "1 / n", RANK_ROUNDS) + f" SELECT node::BIGINT AS node, round(rank, 6) AS rank FROM r{RANK_ROUNDS}")
def pagerank_dangling(spark, d):
    return rounded(G.pagerank(spark.range(5).withColumnRenamed("id", "node"), spark.createDataFrame(DANGLING, "src long, dst long, weight long"), RANK_ROUNDS, None), "rank")


@query(f"WITH {_EDGES} SELECT round(0.5 + 0.3 * least((SELECT count(*) FROM e) / (count(*) * (count(*) - 1)), 1), 6) AS alpha FROM nation")
def density_alpha(spark, d):
    return rounded(G.density_alpha(nations(spark, d), trade(spark, d)), "alpha")


@query(f"WITH {_EDGES}, s AS (SELECT dst AS node, 'in' AS direction, src AS other, weight FROM e UNION ALL SELECT src, 'out', dst, weight FROM e) SELECT node, direction, other, weight::BIGINT AS weight, row_number() OVER (PARTITION BY node, direction ORDER BY weight DESC, other)::INTEGER AS place FROM s QUALIFY place <= 5")
def top_neighbours(spark, d):
    return G.neighbours(trade(spark, d))


@query(f"WITH {_EDGES} SELECT a.n_regionkey AS src, b.n_regionkey AS dst, sum(weight)::BIGINT AS weight FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2")
def file_edges_rollup(spark, d):
    return G.rolled_up(trade(spark, d), t(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("parent")))


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, coalesce(sum(count(*)) OVER (ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM orders GROUP BY 1")
def def_offsets(spark, d):
    return G.offsets(t(spark, d, "orders"), "o_orderpriority")


@query(_RANKED + f", o AS (SELECT node, rank, row_number() OVER (ORDER BY round(rank, 12) DESC, node) - 1 AS place, count(*) OVER () AS n FROM r{RANK_ROUNDS}) SELECT node, round(rank, 6) AS rank, place::INTEGER AS place, CASE WHEN place / n < 0.1 THEN 'full' WHEN place / n < 0.3 THEN 'signatures' WHEN place / n < 0.7 THEN 'names' ELSE 'path' END AS tier FROM o")
def repo_tiers(spark, d):
    ranks = G.pagerank(nations(spark, d), trade(spark, d), RANK_ROUNDS, None)
    return rounded(G.tiers(ranks), "rank")


# --- small fixtures on both sides: definitions, calls, imports, spans ---

DEFS = [(0, 0, "A", 0, 200), (0, 1, "run", 10, 90), (0, 2, "stop", 100, 190), (1, 0, "run", 0, 50), (1, 1, "help", 60, 99), (2, 0, "help", 0, 40), (3, 0, "main", 0, 80)]
CALLS = [(0, 0, "stop", 20), (1, 0, "help", 30), (2, 3, "help", 10), (3, 3, "run", 20), (4, 2, "gone", 5), (5, 1, "help", 70), (6, 0, "help", 300)]
LINKS = [(0, 1), (3, 2), (3, 0)]


def values(name: str, rows: list, columns: str) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join(map(str, rows))})"


_FIX = f"WITH {values('defs', DEFS, 'file_id, def_idx, name, s, t')}, {values('calls', CALLS, 'call_id, file_id, callee, off')}, {values('imps', LINKS, 'file_id, resolved')}"


def fixture(spark):
    defs = spark.createDataFrame(DEFS, "file_id int, def_idx int, name string, start int, end int")
    calls = spark.createDataFrame(CALLS, "call_id int, file_id int, callee string, offset int")
    return defs, calls, spark.createDataFrame(LINKS, "file_id int, resolved int")


@query(_FIX + ", c AS (SELECT call_id, d.file_id AS def_file, d.def_idx, CASE WHEN d.file_id = c.file_id THEN 0 WHEN i.resolved IS NOT NULL THEN 1 END AS p FROM calls c JOIN defs d ON d.name = c.callee LEFT JOIN imps i ON i.file_id = c.file_id AND i.resolved = d.file_id), r AS (SELECT * FROM c WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY p, def_file, def_idx) = 1) SELECT calls.call_id, callee, def_file, def_idx FROM calls LEFT JOIN r USING (call_id)")
def call_resolution(spark, d):
    defs, calls, imps = fixture(spark)
    return G.resolved_calls(calls, defs, imps).select("call_id", "callee", "def_file", "def_idx")


@query(_FIX + " SELECT c.call_id, c.file_id, d.def_idx FROM calls c JOIN defs d ON d.file_id = c.file_id AND off >= s AND off < t QUALIFY row_number() OVER (PARTITION BY c.file_id, call_id ORDER BY t - s, def_idx) = 1")
def call_in_def(spark, d):
    defs, calls, _ = fixture(spark)
    return G.enclosing(calls, defs, innermost=True).select("call_id", "file_id", "def_idx")


IMPORT_ROWS = [(0, "pkg/a.py", "pkg.b", "py"), (1, "pkg/a.py", ".c", "py"), (2, "web/x.ts", "./y", "ts"), (3, "web/x.ts", "../lib/z", "ts"), (4, "web/x.ts", "react", "ts"), (5, "src/m.rs", "crate::n::Item", "rs"), (6, "src/m/k.rs", "self::q", "rs"), (7, "pkg/a.py", "os", "py")]
PATHS = ["pkg/b.py", "c/__init__.py", "web/y/index.ts", "lib/z.js", "src/n.rs", "src/m/q/mod.rs"]


@query("SELECT * FROM (VALUES (0, 'pkg/b.py'), (1, 'c/__init__.py'), (2, 'web/y/index.ts'), (3, 'lib/z.js'), (5, 'src/n.rs'), (6, 'src/m/q/mod.rs')) v(import_id, path)")
def import_resolution(spark, d):
    return G.resolved_imports(spark.createDataFrame(IMPORT_ROWS, "import_id int, file_path string, raw string, ext string"), spark.createDataFrame([(p,) for p in PATHS], "path string"))


SPANS = [(0, 1, 100), (1, 5, 60), (2, 10, 20), (3, 30, 40), (4, 12, 22)]


@query(f"WITH {values('sp', SPANS, 'id, a, b')} SELECT id, a AS start_line, b AS end_line FROM sp WHERE a <= 15 AND b >= 15 ORDER BY b - a, id LIMIT 1")
def hover_narrowest(spark, d):
    return N.narrowest(spark.createDataFrame(SPANS, "id int, start_line int, end_line int"), 15, "id")


# --- navigation over ranked documents ---

_NAV = f"WITH {bm25_sql(BODY, TERMS)}, nav AS (SELECT doc_id, score, source, lang, text FROM bm JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 50)"


def nav_rows(spark, d):
    return body_rank(spark, d, 50).join(t(spark, d, "documents").select("doc_id", "source", "lang", "text"), "doc_id")


@query(_NAV + " SELECT doc_id, source, round(score, 6) AS score FROM nav ORDER BY (source = 'src5') DESC, nav.score DESC, doc_id LIMIT 1")
def nav_goto(spark, d):
    return rounded(N.goto(nav_rows(spark, d), "source", "src5", "doc_id").select("doc_id", "source", "score"), "score")


@query(_NAV + " SELECT doc_id, round(score, 6) AS score FROM nav WHERE contains(source, 'General') OR contains(text, 'General')")
def nav_refs(spark, d):
    return rounded(N.references(nav_rows(spark, d), "General", ["source", "text"]).select("doc_id", "score"), "score")


@query(_NAV + " SELECT source, lang, round(max(score), 6) AS score FROM nav GROUP BY ALL ORDER BY max(nav.score) DESC, source, lang LIMIT 20")
def workspace_symbols(spark, d):
    rows = nav_rows(spark, d).select("source", "lang", "score")
    return rounded(N.workspace_symbols([rows.where("lang = 'en'"), rows.where("lang <> 'en'"), rows], ["source", "lang"]), "score")


@query(f"SELECT {_PATH} AS path, greatest(doc_id % 7 - 1, 0)::BIGINT AS start, CASE WHEN strlen(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents WHERE strlen(text) = length(text)")
def lsp_items(spark, d):
    return _lsp_items(docs_with_path(spark, d).where(F.octet_length("text") == F.length("text")))


def _lsp_items(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.greatest(F.col("doc_id") % 7 - 1, F.lit(0)).alias("start"), T.preview(F.col("text")).alias("preview"))


@query()  # as window_chunks_all
def lsp_items_all(spark, d):
    return _lsp_items(docs_with_path(spark, d))


# --- incremental: an old and a new snapshot of documents, by remainder of doc_id ---

_OLD = "o AS (SELECT doc_id, doc_id AS mtime, strlen(text) AS size, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 0)"
_NEW = "n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN doc_id + 1 WHEN doc_id % 10 = 4 THEN doc_id + 1 ELSE doc_id END AS mtime, strlen(text) AS size, CASE WHEN doc_id % 10 = 4 THEN sha256(text || 'x') ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 10 <> 1)"


def snapshots(spark, d):
    docs = t(spark, d, "documents")
    m = F.col("doc_id") % 10
    size = F.octet_length("text").alias("size")
    old = docs.where(m != 0).select(F.col("doc_id").alias("path"), F.col("doc_id").alias("mtime"), size, F.sha2("text", 256).alias("hash"))
    new = docs.where(m != 1).select(F.col("doc_id").alias("path"), F.when(m.isin(3, 4), F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("mtime"), size, F.when(m == 4, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("hash"))
    return old, new


_DIFF = f"WITH {_OLD}, {_NEW}, df AS (SELECT coalesce(o.doc_id, n.doc_id) AS path, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN (o.mtime = n.mtime AND o.size = n.size) OR o.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS status FROM o FULL JOIN n USING (doc_id))"


@query(_DIFF + " SELECT path, status FROM df")
def snapshot_diff(spark, d):
    return I.diff(*snapshots(spark, d))


@query(_DIFF + " SELECT count(*) FILTER (status = 'new')::BIGINT AS new, count(*) FILTER (status = 'modified')::BIGINT AS modified, count(*) FILTER (status = 'deleted')::BIGINT AS deleted, count(*) FILTER (status = 'unchanged')::BIGINT AS unchanged FROM df")
def reindex_stats(spark, d):
    return I.stats(I.diff(*snapshots(spark, d)))


_DIRS = "WITH f AS (SELECT source || '/' || lang AS dir, source, sha256(text) AS h FROM documents), x AS (SELECT '' AS dir, h FROM f UNION ALL SELECT source, h FROM f UNION ALL SELECT dir, h FROM f)"


@query(_DIRS + " SELECT dir, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM x GROUP BY dir")
def dir_hashes(spark, d):
    return I.folder_hashes(docs_with_path(spark, d).select("path", F.sha2("text", 256).alias("hash")))


@query(_DIRS + " SELECT sha256(string_agg(h, '' ORDER BY h)) AS digest FROM x WHERE dir = ''")
def merkle_root(spark, d):
    return dir_hashes(spark, d).where("dir = ''").select("digest")


@query(f"WITH {_OLD}, {_NEW} SELECT DISTINCT hash FROM o WHERE hash NOT IN (SELECT hash FROM n)")
def gc_anti(spark, d):
    old, new = snapshots(spark, d)
    return I.unreferenced(old.select("hash").distinct(), new)


@query("SELECT lang, count(*)::BIGINT AS chunks, count(DISTINCT source)::BIGINT AS files FROM documents GROUP BY lang")
def index_status(spark, d):
    return I.status(t(spark, d, "documents"), "source", "lang")


# --- metrics ---

_LEN = r"len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))"


def token_counts(spark, d):
    return t(spark, d, "documents").select(F.size(T.plain_tokens(F.col("text"))).alias("n_tokens"))


@query(f"WITH x AS (SELECT {_LEN} AS v FROM documents) SELECT (CASE WHEN v < 16 THEN 0 WHEN v < 32 THEN 1 WHEN v < 64 THEN 2 WHEN v < 128 THEN 3 WHEN v < 256 THEN 4 WHEN v < 512 THEN 5 WHEN v < 1024 THEN 6 ELSE 7 END)::INTEGER AS bucket, count(*)::BIGINT AS n FROM x GROUP BY 1")
def token_hist(spark, d):
    return M.histogram(token_counts(spark, d), "n_tokens")


@query(f"WITH x AS (SELECT {_LEN} AS v, row_number() OVER (ORDER BY {_LEN}) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT p::INTEGER AS p, v::INTEGER AS value FROM x, (VALUES (25), (50), (75), (90), (95), (99)) q(p) WHERE i = least(floor(n * p / 100), n - 1)")
def token_percentiles(spark, d):
    return M.index_percentiles(token_counts(spark, d), "n_tokens")


@query("WITH r AS (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS full_, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(list_slice(a.embedding, 1, 32)::DOUBLE[], list_slice(b.embedding, 1, 32)::DOUBLE[]) DESC, b.vec_id) AS cut FROM embeddings a, embeddings b WHERE a.vec_id < 5) SELECT q AS query_id, round(count(*) FILTER (full_ <= 10 AND cut <= 10) / 10, 6) AS recall FROM r GROUP BY q")
def recall_eval(spark, d):
    from pyspark.sql import Window as W

    v = t(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("e"))  # five queries
    both = v.crossJoin(F.broadcast(q)).select("query_id", "vec_id", V.dot(F.col("embedding"), F.col("e")).alias("f"), V.dot(V.truncated(F.col("embedding"), 32), V.truncated(F.col("e"), 32)).alias("c"))
    place = lambda c: F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(c), "vec_id"))
    rows = both.withColumns({"pf": place("f"), "pc": place("c")})
    lists = rows.groupBy("query_id").agg(F.collect_list(F.when(F.col("pf") <= 10, F.col("vec_id"))).alias("want"), F.collect_list(F.when(F.col("pc") <= 10, F.col("vec_id"))).alias("got"))
    return rounded(R.recall(lists, "want", "got").select("query_id", "recall"), "recall")


_AXES = [(1.0, 5), (0.5, 11), (0.25, 17)]


@query("WITH p AS (SELECT " + ", ".join(f"(tanh(1.4 * list_sum(list_transform(embedding::DOUBLE[], lambda v, i: v * (((i - 1) * {k} % 7) - 3) * {w}))) + 1) / 2 AS {n}" for n, (w, k) in zip("xyz", _AXES)) + " FROM embeddings), s AS (SELECT *, " + ", ".join(f"(max({n}) OVER () + min({n}) OVER ()) / 2 AS m{n}, greatest(max({n}) OVER () - min({n}) OVER (), 0.02) * 1.16 AS w{n}" for n in "xyz") + " FROM p), u AS (SELECT " + ", ".join(f"least(greatest(({n} - (m{n} - w{n} / 2)) / w{n}, 0), 1) AS {n}" for n in "xyz") + " FROM s) SELECT round(x * 9)::INTEGER AS cx, round(y * 9)::INTEGER AS cy, count(*)::BIGINT AS n, round(avg(z), 6) AS mean_z, (CASE WHEN count(*) <= 0 THEN 0 WHEN count(*) <= 2 THEN 1 WHEN count(*) <= 5 THEN 2 WHEN count(*) <= 10 THEN 3 WHEN count(*) <= 20 THEN 4 ELSE 5 END)::INTEGER AS density FROM u GROUP BY 1, 2")
def atlas_grid(spark, d):
    v = V.doubles(F.col("embedding"))

    def projected(w: float, k: int):
        return M.squashed(V.total(F.transform(v, lambda x, i: x * ((i * k % 7) - 3) * w)))

    axes = {n: projected(w, k) for n, (w, k) in zip("xyz", _AXES)}
    points = t(spark, d, "embeddings").select(*[c.alias(n) for n, c in axes.items()])
    for n in "xyz":
        points = M.axis(points, n)
    return rounded(M.grid(points), "mean_z")


# --- streams ---


@query("WITH g AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INT, 1) AS fresh FROM events), b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g) SELECT user_id, burst::BIGINT AS burst, min(ts) AS first_ts, max(ts) AS last_ts, count(*)::BIGINT AS n FROM b GROUP BY ALL")
def debounce_sessions(spark, d):
    return S.debounced_table(t(spark, d, "events").select("user_id", "ts"), "user_id", "ts", 1800)


@query()
def debounce_stream(spark, d):
    """The stream's finished sessions, through a file source and an append sink."""
    events = t(spark, d, "events").select("user_id", "ts")
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events.write.parquet(f"{base}/in")
    stream = S.debounced(S.change_events(spark, f"{base}/in", events.schema), "user_id", gap="30 minutes", watermark="1 hour")
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
