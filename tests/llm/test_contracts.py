"""The registered queries and pipeline stages against independent brute force, with awkward rows: nulls, ties, repeats, clashing names."""

import hashlib
import re
import time
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seekspark.llm import ann, common, html_text, kd_sharding, langid, line_dedup, minhash, mpeg_audio, packing, sentencepiece_viterbi, toxicity
from tests.oracle import compare, views

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
TEXTS = [(1, "The same text\nhere", "en"), (2, "The same text\nhere", None), (2, "The same text\nhere", "en"), (3, None, "en"), (4, "", "fr"), (None, None, None), (None, "The same text\nhere", "de"), (5, LONG, "en"), (6, "?! 12", "en"), (7, " \t\n ", "fr")]
CLASH = "doc_id long, text string, lang string, did int, th int, score int, ids int, decoded int, media int, n_bytes int, held_out int, lang_pred int, kept_text int, n_lines int, node int, shard int, slot int, sequence_id int, `a.b` int, row int, size int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *[0] * 18) for r in TEXTS], CLASH)


def words_of(text) -> list:
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text) -> frozenset:
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows: list, percent: int) -> list:
    """The smallest id of each row's component, by comparing all pairs of string sets."""
    sets, comp = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and comp[i] != comp[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                comp = [comp[i] if c == comp[j] else c for c in comp]
    return [min(rows[j][0] for j in range(len(rows)) if comp[j] == comp[i]) for i in range(len(rows))]


def test_op1_clashing_names_and_no_tables_left(spark, odd):
    rows = line_dedup.dedup_lines(odd)
    assert rows.columns == [c for c in odd.columns if c not in line_dedup.ADDED] + ["kept_text", "n_lines", "n_dropped"]
    assert sorted((str(r.doc_id), r.kept_text, r.n_dropped) for r in rows.collect() if r.doc_id in (1, 2, None)) == [("1", "The same text\nhere", 0), ("2", "here", 1), ("2", "here", 1), ("None", "", 0), ("None", "here", 1)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]
    assert line_dedup.dedup_lines(odd, batches=9).count() == odd.count()


def test_op2_odd_rows(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = sentencepiece_viterbi.decoded(sentencepiece_viterbi.encoded(odd, path), path).collect()
    assert all(r.decoded == (r.text or "") and (len(r.ids) > 0) == bool(r.text) for r in rows) and len(rows) == len(TEXTS)
    assert sentencepiece_viterbi.encoded(odd.limit(0), path).count() == 0
    assert sentencepiece_viterbi.op2(spark, SF).where("NOT round_trip").count() == 0


def test_op3_as_registered(spark, odd):
    rows = toxicity.op3(spark, SF).toPandas()
    text = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").text
    assert len(rows) == len(text) and rows.score.between(0, 1).all() and ((rows.score >= 0.5) == rows.predicted.astype(bool)).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    allowed = common.fold(F.col("doc_id"), 5) != 0
    model = toxicity.train(docs, labels, allowed)
    other = toxicity.train(docs, labels.withColumn("toxic", F.when(allowed, F.col("toxic")).otherwise(1 - F.col("toxic"))), allowed)
    assert (model.weights == other.weights).all() and model.bias == other.bias  # labels of the held-out fold teach nothing
    alone = {t: float(model.score([t])[0]) for t in text}
    assert np.allclose(rows.score, [alone[text[i]] for i in rows.doc_id], atol=1e-6)
    got = toxicity.scored(odd, model).collect()
    assert len({r.score for r in got if not r.text or not r.text.strip()}) == 1 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.scored(odd.limit(0), model).count() == 0
    nobody = toxicity.train(docs.limit(0), labels.limit(0), allowed)
    assert float(nobody.score(["x"])[0]) == 0


def test_op4_laws(spark, odd):
    rows = kd_sharding.op4(spark, SF).toPandas()
    text = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").text
    assert sorted(rows.doc_id) == sorted(text.index) and set(rows.shard) <= set(range(8)) and (rows.law == "bytes").all()
    assert rows["size"].tolist() == [len((text[i] or "").encode()) + 1 for i in rows.doc_id] and rows.text_crc32.tolist() == [zlib.crc32((text[i] or "").encode()) for i in rows.doc_id]
    sizes = rows.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * rows["size"].max() + 0.03 * sizes.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    got = kd_sharding.shard(odd, leaves=3).toPandas()
    assert len(got) == len(TEXTS) and set(got[got.doc_id.isna() | (got.doc_id == 3)]["size"]) == {1, len("The same text\nhere") + 1}


def test_op4_keeps_small_groups_and_parts_large_ones(spark):
    rng = np.random.default_rng(4)
    small = [(i, f"text {i // 4} " + "x" * int(40 + i // 4 % 7), "en", f"s{rng.integers(3)}") for i in range(4000)]
    got = kd_sharding.shard(spark.createDataFrame(small, "doc_id long, text string, lang string, source string")).toPandas()
    assert (got.groupby(["text_crc32", "size"]).shard.nunique() == 1).all()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 0.03 * sizes.mean()
    same = kd_sharding.shard(spark.range(800).select(F.col("id").alias("doc_id"), F.lit("all the same").alias("text"))).toPandas()
    assert set(same.groupby("shard").size()) == {100}


def test_op5_variants_in_one_group(spark):
    """Near copies of a text and of its halves, edited lightly and heavily, some edits shared by many."""
    rng = np.random.default_rng(8)
    base, texts = [f"b{i}" for i in range(160)], []
    for k in range(150):
        t = list(base)
        for i in rng.integers(0, 160, int(rng.integers(0, 14))):
            t[i] = f"e{k}x{i}" if rng.random() < 0.7 else f"shared{i}"
        texts.append(" ".join(t if k % 3 else t[:80] if k % 2 else t[40:130]))
    texts += ["common passage of " + " ".join(f"p{i}" for i in range(30)) + " " + " ".join(f"o{k}y{i}" for i in range(60)) for k in range(20)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, percent=percent).collect()}
        assert [got[i] for i, _ in rows] == brute_components(rows, percent)


def test_op5_as_registered(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in minhash.op5(spark, SF).collect()}
    assert [got[i].component_id for i, _ in rows] == brute_components(rows, 85)
    assert all(got[i].n_shingles == len(shingles(t)) and got[i].kept == (got[i].component_id == i) for i, t in rows)


def test_op6_as_registered(spark, odd):
    rows = langid.op6(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all() and rows.score.between(0, 1).all()
    assert all(x in (*docs.lang.dropna().unique(), "und") for x in rows.lang_pred)
    held = rows[rows.held_out & rows.doc_id.map(docs.lang.notna())]
    assert (held.lang_pred == held.doc_id.map(docs.lang)).mean() > 0.9
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    fold = common.fold(F.col("doc_id"), 3) != 1
    model = langid.train(frame, fold)
    other = langid.train(frame.withColumn("lang", F.when(fold, F.col("lang")).otherwise("zz")), fold)
    assert model.langs == other.langs and (model.table == other.table).all()  # the held-out fold teaches nothing
    texts = docs.text.tolist()
    together, alone = model.predict(texts)[1], np.concatenate([model.predict([t])[1] for t in texts])
    assert (together == alone).all()
    got = langid.identify(odd, model)
    assert got.columns == [c for c in odd.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score", "rejected"]
    assert {(r.lang_pred, r.score, r.rejected) for r in got.collect() if r.doc_id in (3, 4, 6, 7)} == {("und", 0.0, True)}
    assert langid.identify(odd.limit(0), model).count() == 0
    nobody = langid.train(frame.limit(0), fold)
    assert {r.lang_pred for r in langid.identify(odd, nobody).collect()} == {"und"}


def test_op7_as_registered(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id")
    rows = html_text.op7(spark, SF).toPandas()
    for r in rows.itertuples(index=False):  # these pages: one article without inserts, read here with patterns alone
        body = re.search(r"<article>(.*?)</article>", pages.html[r.page_id], re.S)[1]
        blocks = [re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:p|h1|br|div|li|ul)[^>]*>", body)]
        import html as entities

        want = " ".join(x for b in blocks if (x := " ".join(entities.unescape(b).split())))
        assert r.text == want and r.n_chars == len(want) and r.url == pages.url[r.page_id]


def test_op7_odd_pages(spark):
    html = [(1, None, 1), (2, "", 1), (3, "<p class=it's>don't stop</p>", 1), (3, "<p class=it's>don't stop</p>", 1), (4, "<div>" + "word " * 50_000 + "</div>", 1), (None, "plain &amp; simple", 1), (5, "<div class=x>no article, <p>yet text", 1)]
    df = spark.createDataFrame(html, "page_id long, html string, text int")
    got = [(r.page_id, r.text) for r in html_text.extract_pages(df).collect()]
    assert got[:4] == [(1, ""), (2, ""), (3, "don't stop"), (3, "don't stop")] and len(got[4][1]) == 249_999 and got[5:] == [(None, "plain & simple"), (5, "no article, yet text")]
    assert html_text.extract_pages(df.limit(0)).count() == 0
    learned = html_text.learn(["<div class=zap>buy</div><article><p>text here</article>"] * 30)
    assert learned.marks == {"zap"} and html_text.extract("<div class=zap>buy now</div><p>the text of it", learned) == "the text of it"


@pytest.mark.parametrize("bad", ['<a "', '<a href="', "<title>", "<b><div></div>", "<!--", "<a =", "< ", "<a b", "<", "<x y='"])
def test_op7_is_linear_in_hostile_pages(bad):
    began = time.process_time()
    html_text.extract(bad * 60_000, html_text.Weights())
    assert time.process_time() - began < 20


def test_op8_as_registered(spark, odd):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen: dict = {}
    for r in mpeg_audio.op8(spark, SF).collect():
        raw = (text[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media = mpeg_audio.encode(raw)
        assert r.media_bytes == len(media) and r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert seen.setdefault(text[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
        assert r.frames * 576 >= len(payload) and list(r.seek_offsets) == sorted(set(r.seek_offsets)) and r.seconds == pytest.approx(r.frames * 1152 / 48000)
    rows = mpeg_audio.scanned(mpeg_audio.stored(odd)).collect()
    assert {r.n_bytes for r in rows if not r.text} == {0} and len(rows) == len(TEXTS)
    assert mpeg_audio.scanned(mpeg_audio.stored(odd.limit(0))).count() == 0


def test_op9_as_registered(spark, odd):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = packing.op9(spark, SF).toPandas()
    assert set(rows.doc_id) == set(text)
    for doc, g in rows.sort_values("piece").groupby("doc_id"):
        ids = np.array([*slow.encode(text[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        assert g.piece.tolist() == list(range(len(g))) and g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(ids)
        assert (g.length.iloc[1:] == 2048).all() and g.length.iloc[0] <= 2048
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(g.start, g.length, g.ids_crc32))
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    counts = np.bincount(rows.length, minlength=2049)
    plain = sum(times for _, times in packing.best_fit(counts, 2048))
    assert rows.sequence_id.nunique() <= min(plain, 1.01 * -(-int(rows.length.sum()) // 2048) + 1)
    got = packing.pack(odd, public_tokenizers.path("byte_bpe_50k.json"))
    assert got.where("length = 1").count() == 3 and got.where("piece = 0").count() == len(TEXTS)


def test_op9_plans_few_pieces_too():
    counts = np.zeros(2049, int)
    counts[[1500, 700, 600, 548]] = [2, 2, 1, 3]
    assert sum(t for _, t in packing.solved(counts)) == 4


def test_op10_ties_and_repeated_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 24))
    rows = [(i, base[i % 60].tolist()) for i in range(400)] + [(1000, None), (1020, [0.0] * 24), (1040, [float("inf")] + [1.0] * 23), (1060, [1.0, None] + [1.0] * 22), (None, base[0].tolist()), (1080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query_id", F.lit(1)).withColumn("score", F.lit(2))
    got: dict = {}
    for r in ann.neighbours(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = np.array([v for _, v in rows[:400]])
    hits = 0
    for q, found in got.items():
        score = np.zeros(400)
        for j in range(24):
            score += x[:, j] * x[q][j]
        want = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(score[i] == s for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len(set(want) & {i for _, i, _ in found})
    assert set(got) == set(range(0, 400, 20)) and hits >= 0.9 * 20 * len(got)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id, r.score) for r in ann.neighbours(few, few.where("vec_id = 0")).collect()] == [(1, 1, 1.0), (2, 2, 0.0)]


def test_probing_equals_the_scan_of_codes():
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 256, (3000, 16)).astype(np.uint8)
    codes[:200] = codes[0] ^ (rng.random((200, 16)) < 0.1).astype(np.uint8)
    index = ann.MultiIndex(codes)
    for radius in (0, 2, 7, 20, 60, 128):
        want = np.flatnonzero(ann.POPCOUNT[codes ^ codes[0]].sum(1) <= radius)
        assert index.within(codes[0], radius).tolist() == want.tolist()


def test_shared_folder_is_asked_for(spark):
    assert common.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    docs = common.table(spark, SF, "documents", *corpus_pipeline.COLUMNS)
    kept: dict = {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.saved(stage(spark, docs, SF), f"test_{name}")
        kept[name] = (docs.toPandas(), out.toPandas())
        assert name == "packing" or tuple(out.columns) == corpus_pipeline.COLUMNS
        if name == "line_dedup":
            folder = tmp_path / "t"
            folder.mkdir()
            docs.toPandas().to_parquet(folder / "documents.parquet")
            sql = line_dedup.SQL + "SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id"
            assert compare(out.select("doc_id", "text"), sql, views(str(folder))) == ""
        docs = out
    a, b = kept["language"]
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"), common.fold(F.col("doc_id"), 3) != 1)
    lang, score = model.predict(a.text.tolist())
    assert set(b.doc_id) == set(a.doc_id[(lang != "und") & (score >= model.threshold)])
    a, b = kept["toxicity"]
    labels = common.table(spark, SF, "labels", "doc_id", "toxic")
    model = toxicity.train(spark.createDataFrame(a), labels, common.fold(F.col("doc_id"), 5) != 0)
    assert set(b.doc_id) == set(a.doc_id[[float(model.score([t])[0]) < 0.5 for t in a.text]])
    a, b = kept["minhash"]
    rows = sorted(zip(a.doc_id, a.text))
    want = [i for (i, t), c in zip(rows, brute_components(rows, 80)) if c == i or not shingles(t)]
    assert sorted(b.doc_id) == want and dict(zip(b.doc_id, b.text)) == {i: t for i, t in rows if i in set(want)}
    a, b = kept["packing"]
    assert set(b.doc_id) == set(a.doc_id)
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(zip(whole.doc_id, whole.piece, whole.ids_crc32)) == sorted(zip(b.doc_id, b.piece, b.ids_crc32))


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "language"], ids=lambda s: s[0])
def test_stages_take_odd_rows(spark, stage):
    rows = [(i, t, lang, None, None) for i, t, lang in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("did", F.lit(1))
    assert stage[1](spark, df, SF).count() > 0 and stage[1](spark, df.limit(0), SF).count() == 0
