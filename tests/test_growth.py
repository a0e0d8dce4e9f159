"""Steps whose cost must not grow faster than their input: results against brute force at sizes that need many blocks or segments."""

import hashlib
import math
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from seekspark.functions import text as T
from seekspark.operators import chunks as C
from seekspark.operators import manifest as K
from seekspark.operators import pairs as P
from seekspark.operators import postings as X
from seekspark.plans import catalog, catalog_index  # noqa: F401


def summed(a, b):
    out = 0.0
    for x, y in zip(a, b):
        out += float(x) * float(y)
    return out


def vectors(spark):
    m = np.random.default_rng(3).normal(size=(70, 8)).astype(np.float32)
    m[10] = m[11] = m[40] = m[69]  # equal vectors tie
    m[20, :4], m[21, 0] = 0, math.nan
    rows = [(i, x.tolist()) for i, x in enumerate(m)]
    return rows, spark.createDataFrame([*rows, (70, None)], "vec_id long, embedding array<float>")


def test_pairs_of_many_blocks(spark):
    rows, df = vectors(spark)
    want = sorted((i, j, s) for i, a in rows for j, b in rows if i < j and not (s := summed(a, b)) < 6)
    for block in (9, 4096):
        got = P.similar_pairs(df, "vec_id", 6.0, block=block).collect()
        assert repr(sorted(map(tuple, got))) == repr(want)
    first = P.similar_pairs(df.where("vec_id <> 21"), "vec_id", 6.0, 4, block=9).collect()
    assert [tuple(r) for r in first] == sorted((x for x in want if 21 not in x[:2]), key=lambda x: (-x[2], x[0], x[1]))[:4]


def test_nearest_of_many_blocks(spark):
    rows, df = vectors(spark)

    def cosine(a, b):
        n, s = summed(a, a) * summed(b, b), summed(a, b)
        return min(1.0, max(-1.0, s / math.sqrt(n))) if n > 0 else math.nan  # n may be NaN

    got = P.nearest(df.where("vec_id % 7 = 0"), df, "vec_id", 5, 4, block=9).collect()
    for full, score in ((True, summed), (False, lambda a, b: cosine(a[:4], b[:4]))):
        for q, e in rows[::7]:
            best = sorted(((i, score(e, v)) for i, v in rows), key=lambda x: (not math.isnan(x[1]), -x[1] if x[1] == x[1] else 0, x[0]))[:5]
            assert sorted(i for i, _ in best) == sorted(r.vec_id for r in got if r.query_id == q and r.full == full), (full, q)


def test_vectors_meet_without_a_shuffle(spark):
    _, df = vectors(spark)
    blocks = P.packed(df.coalesce(1), "vec_id", "embedding", 9)
    assert blocks.rdd.getNumPartitions() > 1  # blocks of one file are met by many tasks
    plan = P._met(blocks, blocks, "b_a <= b_c")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and blocks.agg(F.max(F.octet_length("ids"))).first()[0] == 9 * 8


def test_index_of_many_segments(spark, tmp_path):
    rng = np.random.default_rng(5)
    bodies = [" ".join(rng.choice(["the", "sea", "boat", "readRow", "x1"], rng.integers(0, 12))) for _ in range(40)]
    bodies[3], bodies[4] = None, "  ... "
    rows = [(i if i != 9 else 8, "the" if i % 5 == 0 else "sea boat", x) for i, x in enumerate(bodies)]  # an id twice
    docs = spark.createDataFrame(rows, "id long, name string, body string").repartition(3)
    weights = {"name": 9.0, "body": 1.0}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        index = X.build(docs, "id", {"name": "name", "body": "body"}, weights, str(tmp_path / "ix"), T.plain_tokens)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    the = index.table("postings").where("term = 'the' AND field = 'body'")
    assert the.count() > 5 and the.agg(F.max("n")).first()[0] <= 4  # no task and no row holds all documents of a term

    toks = [{"name": n.lower().split(), "body": [w for w in (b or "").lower().split() if w[0] != "."]} for _, n, b in rows]

    def brute(phrases):
        out = {}
        for (i, _, _), t in zip(rows, toks):
            for f, w in weights.items():
                avg = sum(len(x[f]) for x in toks) / len(toks)
                for phrase in phrases:
                    tf = sum(t[f][k : k + len(phrase)] == phrase for k in range(len(t[f])))
                    idf = sum(math.log(1 + (len(toks) - n + 0.5) / (n + 0.5)) for n in (sum(p in x[f] for x in toks) for p in phrase))
                    out[i] = out.get(i, 0) + w * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t[f]) / avg))
        return {i: round(s, 9) for i, s in out.items() if s > 0}

    for phrases in ([["the"]], [["the"], ["sea", "boat"]], [["readrow"], ["the", "the", "sea"]], [["absent"]]):
        found = X.search(index, [X.Clause(tuple(p)) for p in phrases]).collect()
        assert {r.id: round(r.score, 9) for r in found} == brute(phrases)
    # where nothing parses, each document counts: as many rows as SQL has
    assert sorted(r.id for r in X.search(index, '"open').collect()) == sorted(i for i, _, _ in rows)


def test_index_is_built_by_the_first_search_that_reads_it(spark, tmp_path):
    built = []
    index = X.Index(spark, str(tmp_path), {"t": 1.0}, T.plain_tokens, lambda: built.append(X.build(spark.createDataFrame([(1, "a sea")], "id long, t string"), "id", {"t": "t"}, {"t": 1.0}, str(tmp_path), T.plain_tokens)))
    assert not built and [r.id for r in X.search(index, "sea").collect()] == [1] and [r.id for r in X.search(index, "a").collect()] == [1] and len(built) == 1
    catalog._INDEXES.clear()
    assert catalog.QUERIES["search_semantic"](spark, "/root/testdata/sf0.001").count() and all(x.make for x in catalog._INDEXES.values())


def test_code_tokens_are_those_of_each_word(spark):
    texts = ["readCsvRow ABCd x_y HTML5Parser a1B2 ΟΔΟΣ ÉtéÀla", "_lead trail_ __ AAaBBb", "", None, "ABcDe,XyZ'sT 日本Go"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    each = F.transform(F.flatten(F.transform(T.words(F.col("t")), lambda w: F.concat(F.array(w), T.split_identifier(w)))), lambda w: F.lower(w))
    for r in rows.select(T.code_tokens(F.col("t")).alias("got"), each.alias("want")).collect():
        assert r.got == r.want


def test_index_life_with_long_lists_of_keys(spark, tmp_path, monkeypatch):
    """Copies, blank and null texts and a path with two texts: the same index whether lists of keys are broadcast or not, and one file a prefix."""
    texts = [f"text {i % 23}\n" if i % 7 else (None if i % 2 else " \n") for i in range(120)]
    old = [(f"d/{i}.txt", 1, x) for i, x in enumerate(texts)]
    new = [(p, 2 if i % 3 == 0 else t, f"{x}!" if i % 6 == 0 else x) for i, (p, t, x) in enumerate(old) if i % 10] + [("d/new.txt", 2, "text 5\n")]
    frame = lambda rows: spark.createDataFrame(rows, "path string, mtime long, text string")
    digest = lambda x: None if x is None else hashlib.sha256(x.encode()).hexdigest()
    for short in (0, K.SHORT):
        monkeypatch.setattr(K, "SHORT", short)
        for chunk in (C.dispatch, C.whole_files):
            path = f"{tmp_path}/{chunk.__name__}-{short}"
            K.full(frame(old), path, chunk)
            assert all(len(list(p.glob("*.parquet"))) == 1 for p in Path(path, "objects").glob("prefix=*"))
            K.reindex(frame(new), path, chunk)
            assert sorted((r.path, r.content) for r in K.load(spark, path).collect()) == sorted((p, x) for p, _, x in new if x and x.strip())
            assert sorted(r.hash for r in K.hashes(spark, path).collect()) == sorted({digest(x) for _, _, x in new if x and x.strip()})
            objects = spark.read.parquet(f"{path}/objects")
            assert objects.count() == objects.select("hash").distinct().count()
            got = sorted((tuple(r) for r in spark.read.parquet(f"{path}/manifest").select("path", "hash", "chunks").collect()), key=str)
            assert got == sorted(((p, digest(x), int(bool(x and x.strip()))) for p, _, x in new), key=str)
        K.full(frame([("a.txt", 1, "one"), ("a.txt", 1, "two"), ("b.txt", 1, "one"), ("b.txt", 1, "one")]), f"{tmp_path}/twice-{short}", C.dispatch)
        assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/twice-{short}/objects").select("path", "content").collect()) == [("a.txt", "one"), ("a.txt", "two")]


def test_last_lines_of_whole_files(spark):
    rows = spark.createDataFrame([("a", "x\n\n"), ("b", "x\n"), ("c", "x"), ("d", "\n\nx"), ("e", "\t\n "), ("f", "x\r\n\n")], "path string, text string")
    assert {r.path: r.end_line for r in C.whole_files(rows).collect()} == {"a": 2, "b": 1, "c": 1, "d": 3, "f": 2}  # as the SQL counts
