"""The training-data operators on small fixtures, against brute force, and with awkward rows."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seekspark.llm import ann, common, html_text, kd_sharding, langid, line_dedup, minhash, mpeg_audio, packing, toxicity
from seekspark.llm.hashing import shingle_sets
from seekspark.llm.sentencepiece_viterbi import Pieces, decoded, encoded

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig int, list string, node int"
LONG = " ".join(f"w{i}" for i in range(3000))
ROWS = [(1, "A shared line here\nonly one", "en", None, 1, 0, "x", 1), (2, " a SHARED line here \nother", None, "s", None, 0, "x", 1), (2, " a SHARED line here \nother", None, "s", None, 0, "x", 1), (3, None, "en", "s", 1, 0, "x", 1), (4, "", "fr", "s", 1, 0, "x", 1), (None, "no id at all\nA shared line here", "fr", "s", 1, 0, "x", 1), (5, LONG, "en", "s", 1, 0, "x", 1), (6, LONG + " w", "en", "s", 1, 0, "x", 1), (7, "?! 12", "en", "s", 1, 0, "x", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_line_dedup(odd):
    got = {(r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(odd).collect()}
    assert (1, "A shared line here\nonly one", 2, 0) in got and (2, "other", 2, 1) in got and (3, "", 1, 0) in got
    assert (None, "no id at all", 2, 1) in got and len(got) == 8
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_line_dedup_equals_sql(spark):
    from tests.oracle import compare, views

    assert compare(line_dedup.op1(spark, SF), line_dedup.ORACLE_SQL, views(SF)) == ""


def brute_components(texts: list, ids: list) -> list:
    sets = [set(s.tolist()) for s in shingle_sets(texts)]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[a] = parent[b] = a if ids[a] < ids[b] else b
    return [ids[find(i)] for i in range(len(sets))]


def test_minhash_equals_brute_force(spark, docs):
    rows = docs.orderBy("doc_id").collect()
    want = brute_components([r.text for r in rows], [r.doc_id for r in rows])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert [got[r.doc_id] for r in rows] == want


def test_minhash_near_copy_group(spark):
    """A group of edits of one text whose members are mostly too far from each other, with links that the hub does not have."""
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base)]
    for k in range(40):
        t = list(base)
        for i in rng.integers(0, 120, 1 + k % 6):
            t[i] = f"e{k // 2 if k % 5 == 0 else k}x{i}"
        texts += [" ".join(t), " ".join(t[:-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, list(range(len(texts))))


def test_minhash_stage_links_pairs_from_80_percent(spark):
    """Texts of 90 shingles each with 80 or 82 in common (Jaccard 0.8 and 0.837), and 79 in common (0.782)."""
    import corpus_pipeline

    base = [f"s{i}" for i in range(94)]
    shifted = lambda k, x: base[k:] + [f"{x}{i}" for i in range(k)]
    texts = [" ".join(t) for t in (base, shifted(10, "e"), [f"u{w}" for w in base], [f"u{w}" for w in shifted(8, "f")], [f"v{w}" for w in base], [f"v{w}" for w in shifted(11, "g")])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, df, SF).collect()) == [0, 2, 4, 5]
    assert minhash.near_duplicates(df, percent=85).where("kept").count() == 6


def brute_near(rows: list) -> list:
    """Rows that stay: the first (smallest id, nulls last) of each component of row pairs of 0.8, and all without words."""
    sets = [set(s.tolist()) for s in shingle_sets([r[1] for r in rows])]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                comp = [comp[i] if c == comp[j] else c for c in comp]
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    best = {c: min((order(i) for i in range(len(rows)) if comp[i] == c)) for c in set(comp)}
    taken, out = set(), []
    for i in range(len(rows)):
        if not sets[i] or order(i) == best[comp[i]] and comp[i] not in taken:
            taken.add(comp[i])
            out.append(rows[i][0])
    return sorted(out, key=str)


def test_minhash_stage_with_null_and_shared_ids(spark):
    import corpus_pipeline

    t = lambda p, n=60: " ".join(f"{p}{i}" for i in range(n))
    rows = [(3, t("a")), (5, t("b")), (5, t("a") + " x"), (None, t("a") + " y"), (None, t("c")), (None, t("c")), (None, t("c") + " z"), (None, t("d")), (7, t("e")), (7, t("e")), (8, t("d") + " q"), (None, ""), (None, None), (9, "  "), (0, t("f")), (None, t("f"))]
    df = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near(spark, df, SF).collect()]
    assert sorted((i for i, _ in got), key=str) == brute_near(rows) and {(5, t("b")), (3, t("a"))} <= set(got)
    assert corpus_pipeline.near(spark, df.limit(0), SF).count() == 0


def test_minhash_need_keeps_the_miss_chance():
    assert minhash.needed(85) == 15 and minhash.needed(80) < 15
    for percent in range(40, 101):
        assert minhash.missed(percent, minhash.needed(percent)) <= minhash.MISS
    with pytest.raises(ValueError):
        minhash.needed(20)


def test_key_filter_keeps_every_wanted_row(spark):
    ids = spark.range(5000).withColumn("text", F.lit("t"))
    wanted = spark.range(0, 5000, 7)
    kept = common.maybe_in(ids, "id", wanted)
    assert kept.columns == ids.columns and kept.join(wanted, "id").count() == wanted.count() and kept.count() < 800
    assert common.maybe_in(ids, "id", wanted.limit(0)).count() == 0


def test_minhash_odd(odd):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert {(3, 0, 3, True), (4, 0, 4, True), (6, 2997, 5, False), (5, 2996, 5, True), (7, 1, 7, True)} <= got
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_packing(spark, odd, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(path), packing.encoder(path)
    texts = [r.text for r in docs.limit(60).collect()] + ["<|endoftext|> x", "  \n\n\t", "日本 😀"]
    assert [fast(t) for t in texts] == [slow.encode(t, add_special_tokens=False).ids for t in texts]
    rows = packing.pack(docs, path).toPandas().sort_values(["sequence_id", "offset"])
    for _, g in rows.groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset.to_numpy() == np.r_[0, np.cumsum(g.length.to_numpy())[:-1]]).all()
    assert rows.sequence_id.nunique() <= int(np.ceil(rows.length.sum() / 2048)) + 2
    r = docs.first()
    ids = np.array([*fast(r.text), 0], "<u4")
    mine = rows[rows.doc_id == r.doc_id].sort_values("piece")
    assert mine.length.sum() == len(ids) and zlib.crc32(ids[-int(mine.length.iloc[-1]) :].tobytes()) == mine.ids_crc32.iloc[-1]
    assert packing.pack(odd, path).where("doc_id = 3").first().length == 1
    assert packing.pack(odd.limit(0), path).count() == 0


def test_packing_plan():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 2049, 40_000), minlength=2049)
    plan = packing.solved(counts)
    got = np.zeros(2049, int)
    for config, times in plan:
        assert sum(n * k for n, k in config.items()) <= 2048
        for n, k in config.items():
            got[n] += k * times
    assert (got == counts).all() and sum(t for _, t in plan) <= 1.01 * (counts * np.arange(2049)).sum() / 2048


@pytest.mark.parametrize("lengths, most", [({100: 20_000}, 1000), ({1100: 5000, 50: 60_000}, 5000), ({n: 2000 for n in range(5, 36)}, 606), ({1: 5000}, 3), ({1025: 7, 1023: 9}, 8), ({1100: 500, 900: 1, 40: 11_000}, 501)])
def test_packing_plan_of_few_lengths(lengths, most):
    counts = np.bincount([*lengths], weights=[*lengths.values()], minlength=2049).astype(np.int64)
    got = np.zeros(2049, int)
    plan = packing.solved(counts)
    for config, times in plan:
        assert times > 0 and sum(n * k for n, k in config.items()) <= 2048
        for n, k in config.items():
            got[n] += k * times
    assert (got == counts).all() and sum(t for _, t in plan) <= most


def test_packing_fills_planned_sequences_first():
    counts = np.zeros(2049, int)
    counts[[40, 900]] = [30, 1]
    plan = packing.best_fit(counts, 2048, [({1100: 1}, 5)])
    assert sum(t for _, t in plan) == 5 and sum(t * c.get(40, 0) for c, t in plan) == 30


def test_sharding(spark, docs, odd):
    rows = kd_sharding.shard(docs).toPandas()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2 * rows["size"].max()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    assert kd_sharding.shard(odd, leaves=None, target_bytes=10_000).count() == len(ROWS)
    assert kd_sharding.shard(odd.limit(0)).count() == 0


def test_sentencepiece(spark, odd, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    both = decoded(encoded(docs.unionByName(odd.select(*docs.columns)), path), path)
    assert both.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0


def test_sentencepiece_ids_equal_the_librarys():
    """All texts of sf0.01 and odd ones: the BPE file's ids are those of its own encoder."""
    import pyarrow.parquet as pq
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    texts += ["", " ", "  two  spaces ", "x\u0000y", "日本語 😀👍🏽", "a" * 700, "1234567890" * 9, "=-=-=-" * 30, "\n\n\t", "´ﬁ é", "The licensed software is provided", LONG]
    want = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)
    assert [x.tolist() for x in Pieces.load(path).encode(texts)] == want


def test_sentencepiece_unigram_takes_the_best_total():
    rng = np.random.default_rng(5)
    pieces = ["<unk>", *sorted({"▁" * int(rng.integers(0, 2)) + "".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(60)} | {"▁", "a", "b", "c"})]
    scores = np.r_[0.0, -rng.uniform(1, 9, len(pieces) - 1)]
    model = Pieces(pieces, scores, np.array([2] + [1] * (len(pieces) - 1)))
    held = dict(zip(pieces[1:], scores[1:]))

    def brute(w):
        best = [0.0] + [-np.inf] * len(w)
        for e in range(1, len(w) + 1):
            best[e] = max(best[b] + held.get(w[b:e], -np.inf) for b in range(e))
        return best[-1]

    for n in range(1, 30):
        w = "".join(rng.choice(list("abc"), n))
        ids = model.encode([w])[0]
        assert "".join(pieces[i] for i in ids) == "▁" + w and scores[ids].sum() == pytest.approx(brute("▁" + w))


def test_mpeg_audio(odd):
    for raw in (b"", b"a", b"\xff\xfb\x90\x00" * 3000, bytes(range(256)) * 20):
        data = mpeg_audio.encode(raw)
        s = mpeg_audio.scan(data)
        assert s.payload == mpeg_audio.padded(raw) and not s.skipped and not s.crc_bad and s.vbr["frames"] == len(s.offsets)
        assert s.seconds == pytest.approx(len(s.offsets) * 1152 / 48000)
    data = mpeg_audio.encode(b"x" * 2000)
    cut = s0 = mpeg_audio.scan(data).offsets[2]
    assert mpeg_audio.scan(data[:cut] + b"junk" + data[cut:]).skipped == 4 and s0
    broken = bytearray(data)
    broken[cut + 8] ^= 1
    assert mpeg_audio.scan(bytes(broken)).crc_bad == 1 and mpeg_audio.scan(b"no audio").offsets == []
    rows = mpeg_audio.scanned(mpeg_audio.stored(odd)).collect()
    for r in rows:
        assert r.payload_sha256 == hashlib.sha256(mpeg_audio.padded((r.text or "").encode())).hexdigest()


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>One <b>two</b>\n three.<p>Four.<div class=comments>c</div></article><footer>f</footer><script>var a='<p>x</p>'</script>"
    assert html_text.extract(page, html_text.learn([page] * 30)) == "A & B One two three. Four."
    assert html_text.extract(None, html_text.Weights()) == "" and html_text.extract("<p", html_text.Weights()) == ""
    rows = html_text.op7(spark, SF).collect()
    assert all(r.n_chars == len(r.text) > 0 for r in rows)


@pytest.mark.parametrize("insert", ["<aside>{}</aside>", "<div class=ad><p>{}</p></div>", "<form class=newsletter><ul><li>{}</ul></form>", "<ul class=related>" + "<li><a href=x>more</a>" * 200 + "<li>{}</ul>"])
def test_html_goes_on_behind_an_insert(insert):
    run = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    last = "Energy is <math><mi>m</mi>\n<mi>c</mi></math>, <object data=x>as drawn</object>."
    page = f"<body><nav><a href=x>menu</a></nav><article><p>{run('a', 200)}</p>{insert.format(run('i', 400))}<p>{run('z', 30)}</p><p>{last}</p></article><div class=comments><article>{run('c', 50)}</article></div><footer>{run('f', 20)}</footer>"
    for weights in (html_text.Weights(), html_text.learn([page] * 30)):
        assert html_text.extract(page, weights) == f"{run('a', 200)} {run('z', 30)} Energy is m c, as drawn."


def test_language_id(spark, docs, odd):
    model = langid.train(docs, F.col("doc_id") % 3 != 1)
    held = langid.identify(docs.where("doc_id % 3 = 1"), model)
    assert held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in langid.identify(odd, model).collect()}
    assert got[3] == got[4] == got[7] == ("und", True)


def test_language_id_rejects_unlearned_languages(docs):
    model = langid.train(docs, F.col("doc_id") % 3 != 1)
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."
    assert (model.predict([finnish, polish])[1] < model.threshold).all()


def test_language_id_learns_from_whole_texts(spark):
    """Texts that all begin with one long header and differ only behind it."""
    head = "the same header in one language for all of the documents here. " * 60
    words = {"aa": "kala vesi talo puu metsä järvi", "bb": "chleb woda dom drzewo las jezioro"}
    rng = np.random.default_rng(3)
    body = lambda x: " ".join(rng.choice(words[x].split(), 1500))
    rows = [(i, head + body(x), x) for i, x in enumerate(["aa", "bb"] * 60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.predict([body("aa"), head + body("aa"), body("bb"), head + body("bb")])[0].tolist() == ["aa", "aa", "bb", "bb"]
    assert all(len(x) == langid.SNIPPET for x in langid.snippets(rows[0][1])) and langid.snippets(None) == [""]
    assert any(langid.snippets(t)[-1] in t[3200:] for _, t, _ in rows)


def test_toxicity_learns():
    rng = np.random.default_rng(2)
    plain = lambda: " ".join(f"w{i}" for i in rng.integers(0, 400, 80))
    texts = [plain() + (" vile nasty" if i % 10 == 0 else "") for i in range(1500)]
    flat, cuts = toxicity.bags(texts)
    bags = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    model = toxicity.fit(bags[:600:10], bags, 0.1)
    s = model.score([plain() + " vile nasty" for _ in range(50)] + [plain() for _ in range(50)] + [None, ""])
    assert (s[:50] >= 0.5).mean() > 0.9 and (s[50:] >= 0.5).mean() < 0.1


def test_ann(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    odd = spark.createDataFrame([(9000, None), (9020, [0.0] * 64), (9040, [float("nan")] * 64), (9060, [1.0])], "vec_id long, embedding array<float>")
    all_ = v.select("vec_id", "embedding").unionByName(odd)
    rows = ann.neighbours(all_, all_.where("vec_id % 20 = 0")).collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in v.collect()}
    got: dict = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]))
    hits = 0
    for q, found in got.items():
        want = sorted((i for i in x if i != q), key=lambda i: (-(x[q] @ x[i]), i))[:20]
        assert [k for k, _ in sorted(found)] == list(range(1, 21))
        hits += len(set(want) & {i for _, i in found})
    assert set(got) == {i for i in x if i % 20 == 0} and hits >= 0.9 * 20 * len(got)
    assert ann.neighbours(all_.limit(0), all_).count() == 0


def test_language_id_sums_reach_the_driver_as_columns(spark):
    """No Python object for each sum: the driver's Python takes a few bytes a sum, not hundreds."""
    size = 200_000

    def run(batches):
        for b in batches:
            k = b["id"].to_numpy()
            yield pd.DataFrame({"k": k % size, "n": k << 20})

    rows = spark.range(3 * size // 2, numPartitions=3)
    tracemalloc.start()
    got = langid.summed(rows, run, size)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    k = np.arange(size)
    assert got.tolist() == (((k + np.where(k < size // 2, k + size, 0)) << 20).tolist())
    assert most < 64 * size
    assert langid.summed(rows.limit(0), run, 3).tolist() == [0, 0, 0]


def test_language_id_learns_from_every_row(spark, docs):
    """A language that only the last rows by hash have; and the table equals plain counts, whatever the partitions."""
    rng = np.random.default_rng(4)
    some = lambda words: " ".join(rng.choice(words.split(), 12))
    words = {"aa": "kala vesi talo puu metsä järvi", "bb": "chleb woda dom drzewo las jezioro", "cc": "ryba zug haus mond stern sonne"}
    ids = [r.id for r in spark.range(6000).orderBy(F.xxhash64(F.col("id").cast("string"))).collect()]
    rows = [(i, some(words[x]), x) for n, i in enumerate(ids) for x in ["cc" if n >= 5950 else "ab"[n % 2] * 2]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(frame, F.lit(True))
    assert model.langs == ["aa", "bb", "cc"] and model.predict([*words.values()])[0].tolist() == ["aa", "bb", "cc"]

    model, got = langid.train(docs, F.lit(True)), langid.train(docs.repartition(7, "text"), F.lit(True))
    assert (model.table == got.table).all() and (model.temperature, model.threshold) == (got.temperature, got.threshold)
    sums = {x: np.zeros(langid.BUCKETS) for x in model.langs}
    for r in docs.collect():
        bag = np.concatenate([*langid.grams(np.frombuffer(r.text.encode(), np.uint8))])
        sums[r.lang] += np.bincount(bag, minlength=langid.BUCKETS) / len(bag)
    share = np.stack([v / v.sum() for v in sums.values()], 1) + langid.SMALL
    assert np.allclose(model.table[:, :-1], np.log(share / share.mean(1, keepdims=True)), atol=1e-4)


def test_sentencepiece_asks_each_pair_once(monkeypatch):
    """Neighbours once worked out are held when the words are not; rare characters in words of many lengths become their bytes."""
    from seekspark.llm.sentencepiece_viterbi import Merges

    path, asked, apart = public_tokenizers.path("piece_bpe_32k.model"), [], Merges.apart
    model = Pieces.load(path)
    texts = ["The licensed software is provided as it is, without warranty of any kind.", "a\nb\u0000c 日本語\U0001f600x", "" * 3]
    model.cache.clear()
    first = [x.tolist() for x in model.encode(texts)]
    assert "".join(model.decode(first)) == "".join(texts)
    monkeypatch.setattr(Merges, "apart", lambda *args: asked.append(len(args[1])) or apart(*args))
    model.cache.clear()
    assert [x.tolist() for x in model.encode(texts)] == first and sum(asked) == 0
