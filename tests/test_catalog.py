"""Every registered query of the main operators against its SQL, and fixtures with known results."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from seekspark.functions import text as T
from seekspark.operators import chunks as C
from seekspark.operators import graph as G
from seekspark.operators import ranking as R
from seekspark.plans import catalog, catalog_index  # noqa: F401  the second registers more queries
from seekspark.sources import files
from tests.oracle import compare, views

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    if name in catalog.SQL:
        assert compare(df, catalog.SQL[name], views(DATA)) == ""
    else:
        assert df.count() > 0


def test_identifiers(spark):
    names = ["readCsvRow", "one_two_three", "UPPER_CASE", "SaxReader", "plain", "XML4Node"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(T.split_identifier(F.col("n"))).collect()
    assert [list(r[0]) for r in got] == [["read", "csv", "row"], ["one", "two", "three"], ["upper", "case"], ["sax", "reader"], [], ["xml4", "node"]]


def test_previews_and_cursor(spark):
    row = spark.createDataFrame([("a" * 300, "é" * 150, "let foo_1 = 2")], "a string, b string, c string")
    a, b, w, none = row.select(T.preview(F.col("a")), T.preview(F.col("b")), T.word_at(F.col("c"), F.lit(6)), T.word_at(F.col("c"), F.lit(10))).first()
    assert a == "a" * 200 + "..." and b == "é" * 100 + "..." and w == "foo_1" and none is None


def test_saturated_boost(spark):
    import math

    one, half, none = spark.range(1).select(R.saturated_boost(F.lit(0.6), F.lit(1.0), 0.25), R.saturated_boost(F.lit(0.6), F.lit(0.5), 0.25), R.saturated_boost(F.lit(0.6), F.lit(0.0), 0.25)).first()
    assert one == pytest.approx(0.75) and half == pytest.approx(0.6 * (1 + 0.25 * math.log(6) / math.log(11))) and none == 0.6


def test_pagerank_cycle_and_star(spark):
    nodes = spark.range(4).withColumnRenamed("id", "node")
    cycle = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 0, 1)], "src long, dst long, weight long")
    ranks = {r.node: r["rank"] for r in G.pagerank(nodes.where("node < 3"), cycle, 10).collect()}
    assert all(v == pytest.approx(1 / 3, abs=1e-4) for v in ranks.values())
    star = spark.createDataFrame([(i, 3, 1) for i in range(3)], "src long, dst long, weight long")
    ranks = {r.node: r["rank"] for r in G.pagerank(nodes, star, 10, None).collect()}
    assert max(ranks, key=ranks.get) == 3 and sum(ranks.values()) == pytest.approx(1)


def test_extractors(spark):
    python = "import os\nfrom .a import b\nclass Boat:\n    def sail(self):\n        return wind('x')\n\ndef wind(n):\n    return n\n"
    rust = "use crate::x::Y;\npub fn hello() {\n    world();\n}\nstruct Config {\n    a: u8,\n}\n"
    rows = C.extracted(spark.createDataFrame([("p/a.py", python), ("s/a.rs", rust), ("x.bin", "?"), ("bad.py", "def (")], "path string, text string")).collect()
    got = {(r.path, r.record, r.name) for r in rows}
    assert {("p/a.py", "def", "Boat"), ("p/a.py", "def", "sail"), ("p/a.py", "call", "wind"), ("p/a.py", "import", "os"), ("p/a.py", "import", ".a"), ("s/a.rs", "def", "hello"), ("s/a.rs", "def", "Config"), ("s/a.rs", "call", "world"), ("s/a.rs", "import", "crate::x::Y")} <= got
    assert not any(p in ("x.bin", "bad.py") for p, _, _ in got) and C.diagnostics("py", "def (")
    broken = C.extract("py", "import os\n\nclass A:\n    def f(self):\n        return (\n\ndef g():\n    pass\n")
    assert [(r["name"], r["start_line"], r["end_line"]) for r in broken] == [("os", 1, 1), ("A", 3, 5), ("f", 4, 5), ("g", 7, 8)]


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.rs").write_text("fn b() {}\n")
    (tmp_path / "Cargo.lock").write_text("x")
    (tmp_path / "bin.dat").write_bytes(b"a\x00b")
    (tmp_path / "latin.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "out.log").write_text("x")
    rows = {r.path for r in files.scan(spark, str(tmp_path), ignore=["*.log"]).collect()}
    assert rows == {"src/a.py", "src/b.rs"}
    assert [r.path for r in files.scan(spark, str(tmp_path), "python").collect()] == ["src/a.py"]


def brute_windows(text: str, size: int, overlap: int) -> list:
    raw, out = text.encode(), []
    for off in range(0, len(raw), max(size - overlap, 1)):
        end = min(off + size, len(raw))
        if end < len(raw):
            end = off + raw[off:end].rfind(b"\n") + 1 if b"\n" in raw[off:end] else end
        try:
            part = raw[off:end].decode()
        except UnicodeDecodeError:
            continue
        if part.strip():
            out.append((off, part, raw[:off].count(b"\n") + 1))
    return out


def test_windows_of_non_ascii_texts(spark):
    texts = ["ab\n" + "é" * 9 + "\nx\n" + "日本\n" * 7, "é" * 40, "aé\n" * 11 + "\u3000" * 9, "plain\nascii\n" * 5, "", "\n\n", "😀\n" * 9 + "z"]
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "path string, text string")
    for size, overlap in ((16, 4), (17, 5), (7, 2), (30, 1)):
        got = sorted((r.path, r.off, r.content, r.start_line) for r in C.windows(df, size=size, overlap=overlap).collect())
        assert got == [(str(i), *w) for i, x in enumerate(texts) for w in brute_windows(x, size, overlap)]


def test_queries_over_all_documents(spark):
    rows = catalog.docs_with_path(spark, DATA).collect()
    want = sorted((r.path, off, hashlib.sha256(part.encode()).hexdigest(), line) for r in rows for off, part, line in brute_windows(r.text or "", C.SIZE, C.OVERLAP))
    assert sorted(map(tuple, catalog.QUERIES["window_chunks_all"](spark, DATA).collect())) == want

    def preview(text):
        raw = text.encode()
        end = min(200, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        return raw[:end].decode() + ("..." if len(raw) > 200 else "")

    want = sorted((r.path, max(r.doc_id % 7 - 1, 0), preview(r.text)) for r in rows)
    assert sorted(map(tuple, catalog.QUERIES["lsp_items_all"](spark, DATA).collect())) == want
