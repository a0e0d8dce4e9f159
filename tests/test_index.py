"""The inverted index, the chunk router, the index's life, the embedder and the engine on fixtures of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekspark.functions import embedding as E
from seekspark.functions import text as T
from seekspark.functions import vectors as V
from seekspark.operators import chunks as C
from seekspark.operators import graph as G
from seekspark.operators import manifest as K
from seekspark.operators import metrics as M
from seekspark.operators import postings as X
from seekspark.plans.engine import HYBRID, KEYWORD, Engine, effective_k, effective_threshold, first_of, number
from seekspark.sources import files as S


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(0, "reader", "readCsvRow(line) splits a csv row"), (1, "writer", "the csv writer"), (2, "json", "loads JSON text and rows"), (3, None, None), (4, "row", "row row row of boats")]
    docs = spark.createDataFrame(rows, "id long, name string, body string")
    return X.build(docs, "id", {"name": "name", "body": "body"}, {"name": 9.0, "body": 1.0}, str(tmp_path_factory.mktemp("ix")), T.code_tokens)


def ids(df):
    return [r.id for r in df.collect()]


def test_query_syntax(index):
    assert set(ids(X.search(index, "csv"))) == {0, 1} and ids(X.search(index, "csv AND writer")) == [1]
    assert ids(X.search(index, "readCsvRow")) == [0] and ids(X.search(index, '"csv row"')) == [0]
    assert ids(X.search(index, "name:row")) == [4] and ids(X.search(index, "row", 1)) == [4]
    assert ids(X.search(index, "  ")) == [] and ids(X.search(index, "absent")) == []
    for broken in ('"csv', "nofield:csv", "AND csv", "csv AND"):
        rows = X.search(index, broken).collect()
        assert [r.id for r in rows] == [0, 1, 2, 4] and {r.score for r in rows} == {1.0}


def test_search_reads_no_text_and_few_buckets(index):
    plan = X.search(index, "csv")._jdf.queryExecution().executedPlan().toString()
    assert "/postings" in plan and "splits a csv" not in plan and plan.count("FileScan") <= 2 and "PartitionFilters: [" in plan


def test_chunk_router(spark):
    python = "import os\n\ndef sail(boat):\n    return boat\n\n\nclass Dock:\n    def moor(self):\n        pass\n"
    turtle = "@prefix a: <http://a/> .\na:One a a:Thing ;\n  a:size 3 .\n# note\na:Two a a:Thing ."
    rows = [("p/a.py", python), ("g/x.ttl", turtle), ("n.txt", "some notes\n"), ("b.md", "no heading"), ("e.txt", " \n"), ("z.py", None), ("h.md", "# One\ntext\n## Two\n"), ("long.py", "def f():\n" + "    call(1)\n" * 900)]
    got = C.dispatch(spark.createDataFrame(rows, "path string, text string")).collect()
    by = {p: [(c.name, c.kind, c.start_line, c.end_line) for c in got if c.path == p] for p, _ in rows}
    assert by["p/a.py"] == [("sail", "function_definition", 3, 4), ("Dock", "class_definition", 7, 9), ("moor", "function_definition", 8, 9)]
    assert by["g/x.ttl"] == [("@prefix", "rdf_statements", 1, 1), ("a:One", "rdf_statements", 2, 3), ("a:Two", "rdf_statements", 4, 5)]
    assert by["n.txt"] == [("n.txt", "file", 1, 1)] and by["b.md"] == [("b.md", "file", 1, 1)] and by["e.txt"] == by["z.py"] == []
    assert [x[0] for x in by["h.md"]] == ["One", "Two"]
    assert [x[0] for x in by["long.py"]] == [f"f[{i}]" for i in range(len(by["long.py"]))] and len(by["long.py"]) > 3
    moor = next(c for c in got if c.name == "moor")
    assert moor.enriched.startswith("// p/a.py | class_definition Dock | defines: moor(self)\n  def moor") and "# g/x.ttl | rdf: a:One\n" in next(c.enriched for c in got if c.name == "a:One")
    assert C.enriched("p", "s", "g", "x" * 50, 60) == "x" * 50
    assert all(c.kind in ("file", "window") for c in C.dispatch(spark.createDataFrame(rows, "path string, text string"), text_mode=True).collect())


def test_cut_windows_equals_the_column_form(spark):
    text = "ab\n" + "é" * 900 + "\n" + "word line\n" * 700 + "z" * 3000
    got = sorted((r.start_line, r.content) for r in C.windows(spark.createDataFrame([("p", text)], "path string, text string")).collect())
    assert got == sorted(C.cut_windows(text))


def test_index_life(spark, tmp_path):
    path = str(tmp_path / "ix")
    frame = lambda rows: spark.createDataFrame(rows, "path string, mtime long, text string")
    first = frame([("a.txt", 1, "one"), ("b.txt", 1, "two"), ("c.txt", 1, "one"), ("d.txt", 1, "four")])
    assert K.status(spark, path).first().ready == "false" and not K.compatible(spark, path)
    assert K.reindex(first, path, C.dispatch).first().new == 4 and K.hashes(spark, path).count() == 3
    second = frame([("a.txt", 2, "one"), ("b.txt", 2, "TWO"), ("c.txt", 1, "one"), ("e.txt", 2, "five")])
    assert K.status(spark, path, second).first().ready == "verifying"
    chunked = []

    def chunk(files):
        chunked.extend(r.path for r in files.select("path").collect())
        return C.dispatch(files)

    assert tuple(K.reindex(second, path, chunk).first()) == (1, 1, 1, 2) and sorted(chunked) == ["b.txt", "e.txt"]
    rows = lambda p: sorted((r.path, r.content) for r in K.load(spark, p).collect())
    K.full(second, str(tmp_path / "new"), C.dispatch)
    assert rows(path) == rows(str(tmp_path / "new")) and K.hashes(spark, path).count() == 3
    assert K.status(spark, path, second).first().ready == "true"
    order = lambda df: sorted(map(tuple, df.select("path", "mtime", "size", "hash", "chunks").collect()))
    assert order(K.rebuilt(spark, path, second)) == order(spark.read.parquet(f"{path}/manifest"))
    assert K.reindex(second, path, C.dispatch, "other model").first().new == 4  # another model: in full
    assert K.clear(spark, path) and not K.compatible(spark, path)


class Failing(E.LengthEmbedder):
    def tokens(self, text):
        return None if "bad" in text else super().tokens(text)


def test_embedder(spark):
    texts = ["a bb ccc", "bad", "", None, "dddd " * 900, "a bb ccc"]
    rows = E.embed(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", Failing(), batch=2, max_tokens=5)
    got = {r.id: r.embedding for r in E.usable(rows).collect()}
    assert set(got) == {0, 4, 5} and got[0] == got[5] and np.linalg.norm(got[0]) == pytest.approx(1) and got[4][4] == 1
    assert E.embed_query(Failing(), "a bb ccc") == pytest.approx(got[0]) and E.embed_query(Failing(), "a bb", "cls")[1] == 1


def test_rotation_and_stored_codes(spark, tmp_path):
    r = E.rotation(64)
    assert np.allclose(r @ r.T, np.eye(64)) and (E.rotation(64) == r).all() and E.quantisable(4096, 64) and not E.quantisable(4095, 64)
    v = np.random.default_rng(1).normal(size=(300, 64))
    codes = E.encoded(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, e array<double>"), "id", "e", 64, str(tmp_path / "codes"))
    q = (r @ v[0]).tolist()
    near = codes.select("id", V.quantised_dot(F.col("codes"), q, centre=True).alias("s")).orderBy(F.desc("s")).limit(40).collect()
    assert len({x.id for x in near} & set(np.argsort(-(v @ v[0]))[:10].tolist())) >= 8


def test_engine(spark, index):
    chunks = spark.createDataFrame([(0, "a/x.py", "reader", "function_definition", 1, 9, "readCsvRow(line)"), (1, "a/y.py", "writer", "class_definition", 1, 9, "the csv writer"), (2, "b/x.py", "json", "file", 1, 30, "loads JSON"), (4, "b/x.py", "row", "function_definition", 5, 8, "row row")], "chunk_id long, path string, name string, kind string, start_line int, end_line int, content string")
    vectors = spark.createDataFrame([(i, [1.0, float(i) / 10]) for i in (0, 1, 2, 4)], "chunk_id long, embedding array<double>")
    e = Engine(chunks, vectors, index, E.LengthEmbedder(2), spark.createDataFrame([("b/x.py", 1.0)], "path string, rank double"))
    assert [r.chunk_id for r in e.search("csv", KEYWORD, 0, 0.01).collect()] and {r.chunk_id for r in e.search("csv", HYBRID, "2", "0.1").collect()} <= {0, 1, 2, 4}
    assert e.search(" ", KEYWORD).count() == 0 and e.search("csv", KEYWORD, 1, None, 1).count() <= 1
    with pytest.raises(ValueError):
        e.ranked("other", "csv")
    assert e.at("x.py", 5).first().chunk_id == 0 and e.similar("b/x.py", 29).first().chunk_id == 4 and e.similar("no.py", 1).count() == 0
    assert e.duplicates(0.9, 3).count() == 3 and e.duplicates(0.9, 3).first().total == 3
    assert e.definition("writer").first().chunk_id == 1 and e.references("csv").count() == 1
    hover = e.hover("b/x.py", 5).first()
    assert hover.chunk_id == 4 and hover.markdown.startswith("```python\nrow row")
    assert [r.symbol for r in e.symbols("b/x.py").collect()] == ["FUNCTION"] and e.items(e.search("csv", KEYWORD, 0, 0.01)).first().start == 0
    edges = spark.createDataFrame([("a/x.py", "b/x.py", 2), ("a/y.py", "b/x.py", 1)], "src string, dst string, weight long")
    assert e.repo_map(edges).startswith("b/x.py: json, row\n") and "a/y.py" in e.repo_map(edges, "y.py")


def test_parameters():
    assert number("5") == 5 and number("0.5") == 0.5 and number(3) == 3
    assert effective_k("0", 7) == 7 and effective_k(9, 7) == 7 and effective_k(0) is None and effective_k("4") == 4
    assert effective_threshold(None) == 0.3 and effective_threshold(0, 0.5) == 0.5 and effective_threshold("0.2") == 0.2


def test_small_ones(spark, tmp_path):
    df = spark.range(10)
    assert first_of(None, df.limit(0), df).count() == 10 and first_of(None) is None
    assert M.skew(df.repartition(2)).first().active == 2
    lines = "    a  \n\tb\n\n\n\n\nc"
    got = spark.createDataFrame([(lines,)], "t string").select(T.minify(F.col("t"))).first()[0]
    assert got == "  a\n b\n\nc"
    objects = spark.createDataFrame([("ab1", "x"), ("cd2", "y")], "hash string, body string")
    S.write_objects(objects, str(tmp_path / "o"))
    assert [r.body for r in S.read_objects(spark, str(tmp_path / "o"), ["cd2"]).collect()] == ["y"]
    imports = spark.createDataFrame([(0, "pkg/sub/a.py", ".b", "py"), (1, "pkg/sub/a.py", "..c", "py"), (2, "pkg/sub/a.py", "pkg.c", "py"), (3, "pkg/sub/a.py", ".", "py")], "import_id int, file_path string, raw string, ext string")
    paths = spark.createDataFrame([(p,) for p in ("pkg/sub/b.py", "b.py", "pkg/c.py", "pkg/sub/__init__.py")], "path string")
    assert {r.import_id: r.path for r in G.resolved_imports(imports, paths).collect()} == {0: "pkg/sub/b.py", 1: "pkg/c.py", 2: "pkg/c.py", 3: "pkg/sub/__init__.py"}
