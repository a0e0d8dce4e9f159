"""Registered queries of the index, its life cycle, embedding, lookups and sinks, beside those of `catalog`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekspark.functions import embedding as E
from seekspark.functions import text as T
from seekspark.functions import vectors as V
from seekspark.operators import chunks as C
from seekspark.operators import graph as G
from seekspark.operators import incremental as I
from seekspark.operators import manifest as K
from seekspark.operators import metrics as M
from seekspark.operators import navigation as N
from seekspark.operators import pairs as P
from seekspark.operators import postings as X
from seekspark.operators import ranking as R
from seekspark.plans import catalog
from seekspark.plans.catalog import _COS, _EDGES, _FUSED, _PARTS, _PATH, BODY, TERMS, bm25_sql, clauses, docs_with_path, indexed, nations, q0, query, rank_sql, rounded, t, trade
from seekspark.plans.engine import HYBRID, KEYWORD, SEMANTIC, Engine
from seekspark.plans.scratch import shared_dir
from seekspark.sources import files as S

QUERIES, SQL = catalog.QUERIES, catalog.SQL

# --- keyword search with the code tokenizer and the query syntax ---

_CODE = r"flatten(list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+'), lambda x: list_concat([lower(x)], CASE WHEN len(" + _PARTS.format(x="x").replace("{", "{{").replace("}", "}}") + ") > 1 THEN " + _PARTS.format(x="x").replace("{", "{{").replace("}", "}}") + " ELSE [] END)))"


def code_sql(expr: str, terms: list[str], table: str = "documents", id_col: str = "doc_id", where: str = "TRUE") -> str:
    """bm25_sql over code tokens of one expression; each term's count stays in a column of its own."""
    parts, tfs, scores = [f"tk AS (SELECT {id_col} AS id, {_CODE.format(x=expr)} AS toks FROM {table})", "st AS (SELECT count(*) AS n, avg(len(toks)) AS av FROM tk)"], [], []
    for j, term in enumerate(terms):
        words = term.split(" ")
        follow = " AND ".join(f"toks[p + {k}] = '{w}'" for k, w in enumerate(words))
        tfs.append(f"len(list_filter(range(1, len(toks) + 1), lambda p: {follow})) AS tf{j}")
        idf = " + ".join(f"ln(1 + (st.n - (SELECT count(*) FROM tk WHERE list_contains(toks, '{w}')) + 0.5) / ((SELECT count(*) FROM tk WHERE list_contains(toks, '{w}')) + 0.5))" for w in words)
        scores.append(f"({idf}) * tf{j} * 2.2 / (tf{j} + 1.2 * (0.25 + 0.75 * ln_ / greatest(st.av, 1e-9)))")
    parts.append(f"f AS (SELECT id, len(toks) AS ln_, {', '.join(tfs)} FROM tk)")
    return f"WITH {', '.join(parts)} SELECT id AS {id_col}, round({' + '.join(scores)}, 6) AS score FROM f, st WHERE ({' + '.join(f'tf{j}' for j in range(len(terms)))}) > 0 AND {where}"


def code_index(spark, d):
    return indexed(spark, d, "code", {"text": "text"}, BODY, T.code_tokens)


@query(code_sql("text", ["tion", "license", "of the"]))
def bm25_index_search(spark, d):
    return rounded(X.search(code_index(spark, d), 'tion license "of the"', None, "doc_id"), "score")


@query(code_sql("text", ["license", "the"], where="tf0 > 0 AND tf1 > 0"))
def bm25_index_both(spark, d):
    return rounded(X.search(code_index(spark, d), "license AND text:the", None, "doc_id"), "score")


@query("SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{N}]')")
def bm25_index_unparsed(spark, d):
    return X.search(code_index(spark, d), 'an "open quote', None, "doc_id")


_PART = "p_name || ' readJsonTable ' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' json table' ELSE '' END"


@query(code_sql(_PART, ["readjsontable read json table", "json"], "part", "p_partkey"))
def bm25_index_code_words(spark, d):
    body = F.concat("p_name", F.lit(" readJsonTable "), "p_brand", F.when(F.col("p_partkey") % 3 == 0, " json table").otherwise(""))
    index = indexed(spark, d, "part", {"body": body}, {"body": 1.0}, T.code_tokens, t(spark, d, "part"), "p_partkey")
    return rounded(X.search(index, "readJsonTable json", None, "p_partkey"), "score")


# --- one engine over documents and vectors: chunk ids are doc_id and vec_id ---


def engine(spark, d) -> Engine:
    chunks = docs_with_path(spark, d).select(F.col("doc_id").alias("chunk_id"), "path", F.col("source").alias("name"), F.lit("file").alias("kind"), F.lit(1).alias("start_line"), F.col("n_chars").alias("end_line"), F.col("text").alias("content"))
    return Engine(chunks, t(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id"), indexed(spark, d, "body", {"text": "text"}, BODY, T.plain_tokens))


def _norm(rows: str, order: str) -> str:
    return f"norm AS (SELECT id, CASE WHEN max(score) OVER () - min(score) OVER () <= 1.1920929e-07 THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS score FROM {rows}) SELECT id AS chunk_id, round(score, 6) AS score FROM norm {order}"


@query(f"WITH {bm25_sql(BODY, TERMS)}, rows_ AS (SELECT doc_id AS id, score FROM bm), " + _norm("rows_", ""))
def search_keyword_all(spark, d):
    return rounded(engine(spark, d).ranked(KEYWORD, clauses(TERMS), k=0), "score")


@query(f"WITH rows_ AS (SELECT vec_id AS id, score FROM ({_COS}) WHERE score >= 0 ORDER BY score DESC, vec_id LIMIT 100), " + _norm("rows_", "WHERE norm.score >= 0.5"))
def search_semantic(spark, d):
    return rounded(engine(spark, d).ranked(SEMANTIC, "", q0(spark, d), 100, 0.5), "score")


@query(_FUSED.replace("norm AS (SELECT id, CASE", "norm0 AS (SELECT id, CASE") + ", " + _norm("fused", "WHERE norm.score >= 0.3 ORDER BY norm.score DESC, id LIMIT 10"))
def search_hybrid(spark, d):
    return rounded(engine(spark, d).ranked(HYBRID, clauses(TERMS), q0(spark, d), 10, 0.3), "score")


def placed(spark, d) -> DataFrame:
    """Vectors as chunks: ten to a file, twenty lines each."""
    v = F.col("vec_id")
    return t(spark, d, "embeddings").select(v.alias("chunk_id"), F.concat(F.lit("src/m"), F.floor(v / 10).cast("string"), F.lit(".rs")).alias("path"), F.concat(F.lit("f"), v.cast("string")).alias("name"), F.lit("function_item").alias("kind"),
                                            (v % 10 * 20 + 1).alias("start_line"), (v % 10 * 20 + 20).alias("end_line"), F.lit("").alias("content"))


_PLACED = "pl AS (SELECT vec_id AS chunk_id, 'src/m' || (vec_id // 10) || '.rs' AS path, vec_id % 10 * 20 + 1 AS start_line, vec_id % 10 * 20 + 20 AS end_line FROM embeddings)"


def structure(spark, d) -> Engine:
    return Engine(placed(spark, d), t(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id"), indexed(spark, d, "body", {"text": "text"}, BODY, T.plain_tokens))


@query(f"WITH {_PLACED} SELECT chunk_id, path FROM pl WHERE (path = '7.rs' OR ends_with(path, '7.rs')) AND start_line <= 46 AND end_line >= 46 ORDER BY chunk_id LIMIT 1")
def chunk_at(spark, d):
    return structure(spark, d).at("7.rs", 45).select("chunk_id", "path")


@query(f"WITH {_PLACED}, me AS (SELECT chunk_id FROM pl WHERE ends_with(path, '7.rs') AND start_line <= 46 AND end_line >= 46 ORDER BY chunk_id LIMIT 1), q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings, me WHERE vec_id = chunk_id) SELECT chunk_id, path, start_line, round(score, 6) AS score FROM (SELECT vec_id, list_dot_product(embedding::DOUBLE[], q.e) AS score FROM embeddings, q) s JOIN pl ON pl.chunk_id = vec_id WHERE vec_id <> (SELECT chunk_id FROM me) AND score >= 0 ORDER BY s.score DESC, vec_id LIMIT 10")
def find_similar_at(spark, d):
    return rounded(structure(spark, d).similar("7.rs", 45).select("chunk_id", "path", "start_line", "score"), "score")


@query(f"WITH {_PLACED}, p AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), g AS (SELECT * FROM p WHERE s >= 0.4 ORDER BY s DESC, id_a, id_b LIMIT 20) SELECT id_a, id_b, round(s, 3) AS similarity, x.path AS path_a, x.start_line AS line_a, y.path AS path_b, y.start_line AS line_b, (SELECT count(*) FROM g)::BIGINT AS total FROM g JOIN pl x ON x.chunk_id = id_a JOIN pl y ON y.chunk_id = id_b")
def find_duplicates(spark, d):
    return structure(spark, d).duplicates(0.4)


# --- embedding ---

_WORDS = r"list_slice(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1, 512)"


@query(f"WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), c AS (SELECT doc_id, " + ", ".join(f"len(list_filter(ws, lambda x: length(x) % 8 = {i}))::DOUBLE AS c{i}" for i in range(8)) + " FROM w WHERE len(ws) > 0) SELECT doc_id, " + ", ".join(f"round(c{i} / sqrt({' + '.join(f'c{k} * c{k}' for k in range(8))}), 6) AS e{i}" for i in range(8)) + " FROM c")
def embed_documents(spark, d):
    rows = E.usable(E.embed(t(spark, d, "documents").select("doc_id", "text"), "text", E.LengthEmbedder()))
    return rows.select("doc_id", *[F.round(F.get("embedding", F.lit(i)), 6).alias(f"e{i}") for i in range(8)])


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, 1 + vec_id % 8 AS m FROM embeddings) SELECT vec_id, round(e[3], 6) AS cls2, " + ", ".join(f"round(list_sum(list_transform(range(0, m), lambda p: e[p * 8 + {i} + 1])) / m, 6) AS p{i}" for i in range(8)) + " FROM v")
def pooling(spark, d):
    e = V.doubles(F.col("embedding"))
    states = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.slice(e, p * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.when(p < 1 + F.col("vec_id") % 8, 1.0).otherwise(0.0))
    rows = t(spark, d, "embeddings").select("vec_id", E.mean_pool(states, mask).alias("p"), E.cls_pool(states).alias("c"))
    return rows.select("vec_id", F.round(F.get("c", F.lit(2)), 6).alias("cls2"), *[F.round(F.get("p", F.lit(i)), 6).alias(f"p{i}") for i in range(8)])


@query(f"SELECT vec_id, round(score, 5) AS score FROM ({_COS})")
def rotated_scores(spark, d):
    """A rotation keeps inner products."""
    q = (E.rotation(64) @ q0(spark, d)).tolist()
    return E.rotated(t(spark, d, "embeddings"), "embedding", 64).select("vec_id", F.round(V.dot(F.col("embedding"), R.literal(q)), 5).alias("score"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, round(list_sum(embedding::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS total FROM embeddings")
def l2_normalised(spark, d):
    rows = t(spark, d, "embeddings").select("vec_id", V.normalised(F.col("embedding")).alias("e"))
    return rows.select("vec_id", F.round(F.get("e", F.lit(0)), 6).alias("first"), F.round(V.total(F.col("e")), 5).alias("total"))


_RECALL = "r AS (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS full_, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(list_slice(a.embedding, 1, 32)::DOUBLE[], list_slice(b.embedding, 1, 32)::DOUBLE[]) DESC, b.vec_id) AS cut FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), one AS (SELECT q, count(*) FILTER (full_ <= 10 AND cut <= 10) / 10 AS recall FROM r GROUP BY q)"


@query(f"WITH {_RECALL} SELECT count(*)::BIGINT AS queries, round(avg(recall), 6) AS recall, avg(recall) >= 0.9 AS semantic_pass, avg(recall) >= 0.98 AS hybrid_pass FROM one")
def recall_mean(spark, d):
    """Every vector whose id is divisible by 50 as a query against all, by its first 32 dimensions."""
    v = t(spark, d, "embeddings").select("vec_id", "embedding")
    found = P.nearest(v.where("vec_id % 50 = 0"), v, "vec_id", 10, 32)
    lists = found.groupBy("query_id").agg(F.collect_list(F.when(F.col("full"), F.col("vec_id"))).alias("want"), F.collect_list(F.when(~F.col("full"), F.col("vec_id"))).alias("got"))
    return rounded(R.mean_recall(R.recall(lists, "want", "got")), "recall")


# --- the life of an index: documents of an old and a new state ---


def states(spark, d) -> tuple[DataFrame, DataFrame]:
    docs, m = docs_with_path(spark, d), F.col("doc_id") % 10
    old = docs.where(m != 0).select("path", F.col("doc_id").alias("mtime"), "text")
    new = docs.where(m != 1).select("path", F.when(m.isin(3, 4), F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("mtime"), F.when(m == 4, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"))
    return old, new


_HELD: dict = {}


def lived(spark, d) -> str:
    """An index built over the old state and brought to the new one, once for a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _HELD:
        path, (old, new) = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", states(spark, d)
        K.reindex(old, path, C.whole_files)
        _HELD[key] = path, K.reindex(new, path, C.whole_files).first()
    return _HELD[key][0]


_STATE = f"s AS (SELECT {_PATH} AS path, doc_id, CASE WHEN doc_id % 10 IN (3, 4) THEN doc_id + 1 ELSE doc_id END AS mtime, CASE WHEN doc_id % 10 = 4 THEN text || 'x' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1), h AS (SELECT *, sha256(text) AS hash, strlen(text) AS size, (trim(regexp_replace(text, '\\s', ' ', 'g')) <> '' AND strlen(text) <= 4096)::BIGINT AS chunks FROM s)"


@query(f"WITH {_STATE} SELECT path, hash AS digest FROM h WHERE chunks > 0")
def index_after_reindex(spark, d):
    """What an incremental run leaves equals a full build."""
    return K.load(spark, lived(spark, d)).select("path", F.sha2("content", 256).alias("digest"))


@query(f"WITH {_STATE} SELECT path, mtime, size::INTEGER AS size, hash, chunks FROM h")
def manifest_after_reindex(spark, d):
    return spark.read.parquet(f"{lived(spark, d)}/manifest").select("path", "mtime", "size", "hash", "chunks")


@query(f"WITH {_STATE} SELECT DISTINCT hash FROM h WHERE chunks > 0")
def objects_after_reindex(spark, d):
    return K.hashes(spark, lived(spark, d))


@query(f"WITH {_STATE} SELECT path, mtime, size::INTEGER AS size, hash, chunks FROM h WHERE chunks > 0")
def manifest_rebuilt(spark, d):
    return K.rebuilt(spark, lived(spark, d), states(spark, d)[1])


@query(f"WITH {_STATE} SELECT 'true' AS ready, count(*)::BIGINT AS files, sum(chunks)::BIGINT AS chunks FROM h")
def index_ready(spark, d):
    return K.status(spark, lived(spark, d), states(spark, d)[1])


@query(f"WITH {_STATE} SELECT 'txt' AS ext, count(*)::BIGINT AS files, sum(chunks)::BIGINT AS chunks FROM h")
def index_extensions(spark, d):
    return K.extensions(spark.read.parquet(f"{lived(spark, d)}/manifest"))


@query(f"WITH {_STATE} SELECT max_by(path, {{'m': mtime, 'p': path}}) AS newest, max(mtime) AS mtime, max(mtime) <= 1000 AS up_to_date FROM h")
def index_freshness(spark, d):
    return K.freshness(spark.read.parquet(f"{lived(spark, d)}/manifest"), 1000)


@query("SELECT count(*) FILTER (doc_id % 10 = 0)::BIGINT AS new, count(*) FILTER (doc_id % 10 = 4)::BIGINT AS modified, count(*) FILTER (doc_id % 10 = 1)::BIGINT AS deleted, count(*) FILTER (doc_id % 10 NOT IN (0, 1, 4))::BIGINT AS unchanged FROM documents")
def reindex_run_stats(spark, d):
    lived(spark, d)
    return spark.createDataFrame([_HELD[spark.sparkContext.applicationId, d][1]], "new long, modified long, deleted long, unchanged long")


_OLD_NEW = f"o AS (SELECT {_PATH} AS path, doc_id AS mtime, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 0)"


@query(f"WITH {_OLD_NEW}, {_STATE} SELECT o.path, coalesce(h.mtime, o.mtime) AS mtime FROM o LEFT JOIN h USING (path)")
def healed_times(spark, d):
    old, new = states(spark, d)
    return I.healed(old.select("path", "mtime"), new.select("path", "mtime")).select("path", "mtime")


@query(f"WITH {_OLD_NEW}, {_STATE} SELECT o.path, o.hash FROM o WHERE o.hash NOT IN (SELECT hash FROM h WHERE chunks > 0)")
def dangling_rows(spark, d):
    old = K.snapshot(states(spark, d)[0]).select("path", "hash")
    return I.dangling(old, K.hashes(spark, lived(spark, d))).select("path", "hash")


# --- structure ---


@query(rank_sql(_EDGES, "SELECT n_nationkey AS node FROM nation", "1 / n", 20) + " SELECT n_regionkey AS parent, round(sum(rank), 6) AS rank FROM r20 JOIN nation ON n_nationkey = node GROUP BY 1")
def file_ranks(spark, d):
    ranks = G.pagerank(nations(spark, d), trade(spark, d), 20, None)
    return rounded(G.rank_of_parents(ranks, t(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("parent"))), "rank")


@query("WITH f AS (SELECT p_brand AS path, p_type AS name, p_partkey AS i, p_retailprice AS r FROM part), m AS (SELECT max(r) AS m FROM f) SELECT path || '::' || name AS key, round(max_by(r, i) / any_value(m), 6) AS rank FROM f, m GROUP BY path, name UNION ALL SELECT path, round(avg(r) / any_value(m), 6) FROM f, m GROUP BY path")
def rank_lookup_table(spark, d):
    defs = t(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_type").alias("name"), F.col("p_partkey").alias("def_idx"), F.col("p_retailprice").alias("rank"))
    return rounded(G.rank_lookup(defs, defs.groupBy("path").agg(F.avg("rank").alias("rank"))), "rank")


@query("SELECT p_brand AS path, p_type AS name, min(p_partkey) AS def_idx FROM part GROUP BY ALL")
def first_definitions(spark, d):
    return G.first_definitions(t(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_type").alias("name"), F.col("p_partkey").alias("def_idx")))


@query(f"SELECT {_PATH} AS path FROM documents WHERE ends_with({_PATH}, '7.txt') ORDER BY path LIMIT 1")
def focus_file(spark, d):
    return G.focused(docs_with_path(spark, d), "7.txt")


def _calls_sql(mine: str, other: str) -> str:
    return f"WITH {_EDGES} SELECT row_number() OVER (ORDER BY weight DESC, {other})::INTEGER AS place, n_name AS name, weight::BIGINT AS weight FROM e JOIN nation ON n_nationkey = {other} WHERE {mine} = 3 QUALIFY place <= 5"


@query(_calls_sql("dst", "src"))
def incoming_calls(spark, d):
    return G.calls_of(trade(spark, d), t(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name")), 3, True)


@query(_calls_sql("src", "dst"))
def outgoing_calls(spark, d):
    return G.calls_of(trade(spark, d), t(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name")), 3, False)


@query("WITH d AS (SELECT conv_id AS file_id, turn AS def_idx, turn * 40 AS s, turn * 40 + 100 AS e FROM conversations), p AS (SELECT conv_id AS file_id, turn AS call_id, turn * 40 + 50 AS off FROM conversations) SELECT p.file_id, call_id, min(def_idx) AS def_idx FROM p JOIN d ON p.file_id = d.file_id AND off >= s AND off < e GROUP BY ALL")
def calls_attached(spark, d):
    """Each call to the first definition that holds it; definitions overlap here."""
    c = t(spark, d, "conversations")
    points = c.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("call_id"), (F.col("turn") * 40 + 50).alias("offset"))
    return G.enclosing(points, c.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("def_idx"), (F.col("turn") * 40).alias("start"), (F.col("turn") * 40 + 100).alias("end")))


@query("SELECT o_orderkey, least(10 + floor((o_custkey - 5) / 40), 60)::BIGINT AS line FROM orders")
def call_lines(spark, d):
    return t(spark, d, "orders").select("o_orderkey", N.call_line(F.lit(10), F.lit(60), F.col("o_custkey"), F.lit(5)).cast("long").alias("line"))


@query(f"WITH {_PLACED} SELECT 'f' || chunk_id AS name, 'FUNCTION' AS symbol, start_line - 1 AS start, end_line - 1 AS \"end\" FROM pl WHERE path = 'src/m3.rs'")
def document_symbols(spark, d):
    return N.document_symbols(placed(spark, d), "src/m3.rs")


# --- blocks, words, labels, sinks ---


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
e AS (SELECT *, trim(line) = '' AS blank, trim(line) = '' OR ends_with(rtrim(line), '.') AS fin FROM l), g AS (SELECT *, coalesce(lag(fin) OVER (PARTITION BY doc_id ORDER BY pos), false)::INT AS cut FROM e),
b AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM g)
SELECT doc_id, min(pos)::INTEGER AS "start", max(pos)::INTEGER AS "end", sha256(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM b WHERE NOT blank GROUP BY doc_id, block""")
def rdf_blocks_of_documents(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return C.rdf_blocks(lines, "doc_id", "pos", "line").select("doc_id", "start", "end", F.sha2("content", 256).alias("digest"))


@query(r"WITH f AS (SELECT doc_id, split_part(text, chr(10), 1) AS l FROM documents), s AS (SELECT doc_id, regexp_extract(substr(l, 1, 6), '([A-Za-z0-9_]*)$', 1) || regexp_extract(substr(l, 7), '^([A-Za-z0-9_]*)', 1) AS word FROM f WHERE length(l) >= 6) SELECT doc_id, word FROM s WHERE word <> ''")
def words_at(spark, d):
    rows = t(spark, d, "documents").select("doc_id", T.word_at(F.substring_index("text", "\n", 1), F.lit(6)).alias("word"))
    return rows.where("word IS NOT NULL")


_KINDS = {"en": "function_item", "de": "struct_item", "fr": "table", "es": "window"}


def _case(c: str, values: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


@query(f"WITH k AS (SELECT lang, coalesce({_case('lang', _KINDS)}, 'file') AS kind FROM documents) SELECT kind, CASE kind WHEN 'function_item' THEN 'FUNCTION' WHEN 'struct_item' THEN 'STRUCT' WHEN 'table' THEN 'NAMESPACE' ELSE 'VARIABLE' END AS symbol, CASE WHEN kind IN ('file', 'window') THEN 'text windows' ELSE 'tree-sitter' END AS boundary, count(*)::BIGINT AS n FROM k GROUP BY ALL")
def kind_labels(spark, d):
    kind = F.lit("file")
    for k, v in _KINDS.items():
        kind = F.when(F.col("lang") == k, v).otherwise(kind)
    rows = t(spark, d, "documents").select(kind.alias("kind"))
    return rows.groupBy("kind", N.kind_of(F.col("kind")).alias("symbol"), M.boundary(F.col("kind")).alias("boundary")).agg(F.count("*").alias("n"))


_EXTS = {"en": "rs", "de": "py", "fr": "md"}


@query(f"WITH k AS (SELECT coalesce({_case('lang', _EXTS)}, 'zzz') AS ext FROM documents) SELECT ext, CASE ext WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'md' THEN 'markdown' ELSE 'other' END AS family, CASE ext WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'md' THEN 'markdown' ELSE 'text' END AS language, count(*)::BIGINT AS n FROM k GROUP BY ALL")
def extension_labels(spark, d):
    ext = F.lit("zzz")
    for k, v in _EXTS.items():
        ext = F.when(F.col("lang") == k, v).otherwise(ext)
    rows = t(spark, d, "documents").select(ext.alias("ext"))
    return rows.groupBy("ext", M.family(F.col("ext")).alias("family"), C.language(F.concat(F.lit("a."), F.col("ext"))).alias("language")).agg(F.count("*").alias("n"))


def results(spark, d) -> DataFrame:
    return docs_with_path(spark, d).select(F.col("doc_id").cast("int").alias("rank"), F.col("source").alias("name"), "path", F.lit(1).alias("start_line"), (F.col("doc_id") % 9 + 1).cast("int").alias("end_line"), (F.col("doc_id") / 2).alias("score"), F.col("lang").alias("content"))


@query(f"SELECT doc_id::INTEGER AS rank, printf('%d. %s (%s:1-%d) [%.3f]', doc_id + 1, source, {_PATH}, doc_id % 9 + 1, doc_id / 2) || chr(10) || coalesce(lang, '') AS line FROM documents")
def sink_plain(spark, d):
    return S.plain(results(spark, d)).select("rank", "line")


@query(f"SELECT to_json({{'rank': doc_id::INTEGER, 'name': source, 'path': {_PATH}, 'start_line': 1, 'end_line': (doc_id % 9 + 1)::INTEGER, 'score': doc_id / 2, 'content': lang, 'language': 'text'}})::VARCHAR AS value FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def sink_json_lines(spark, d):
    return S.json_lines(results(spark, d).where("content IS NOT NULL AND name IS NOT NULL"))


@query("WITH k AS (SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) SELECT event_id, round(value, 4) AS value, round((SELECT min(value) FROM events), 4) AS lo, round((SELECT max(value) FROM events), 4) AS hi FROM k")
def atlas_latest(spark, d):
    """The last points of a stream's table under a viewport that only grows."""
    rows = M.latest(t(spark, d, "events"), ["ts", "event_id"], "value", 1000)
    return rounded_4(rows.select("event_id", "value", "lo", "hi"))


def rounded_4(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("value", "lo", "hi")})
