"""Each training-data operator against brute force, on odd rows, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kithline.llm import chat_format, lang_id, packing, quality_model, quality_rules, simhash, token_files, toxicity, url_filter
from kithline.llm import decontaminate as contamination
from kithline.llm.common import RollingHash, sample_labelled
from kithline.llm.queries import CONTROL, ORACLE_SQL, QUERIES, URL_RULES, tokenizer_path

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, out string, row string, score double"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
ODD = [None, "", " ", "\n\n", "a", "A b", "one two three four", "one two three four five", "é ñ ü — “x” 　 z", "<|endoftext|> <|im_end|>", "1 2 3 !!! ###", "tab\tvt\x0bff\x0ccr\rnl\n x", LONG, LONG, "x " * 300]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts; ids repeat, one is null, and columns have the names of results."""
    rows = [(k, t, "o", "r", 0.5) for k, t in enumerate(ODD)] + [(3, "repeated id", None, None, None), (4, "a", "o", "r", 0.5), (None, "no id", "o", "r", None)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], DOC)


# Decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(texts, items, size):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(str(item))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    found |= own
                    hit |= set(range(i, i + n))
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [200_000, 3])
def test_contamination(spark, odd, block):
    passage = " ".join(f"p{i}" for i in range(30))
    extra = spark.createDataFrame([(50, f"Start, {passage.upper()}; end", None, None, None), (51, "p3 " + passage.replace(" ", "--"), None, None, None), (52, "p0 p1 p2", None, None, None)], DOC)
    bench = [(1, passage), (2, "one TWO three"), (3, ""), (4, None), (5, "a"), (6, passage), (7, " ".join(LONG.split()[5000:5020])), (None, "b")]
    both = odd.union(extra)
    got = contamination.find_contamination(both, spark.createDataFrame(bench, "item_id long, text string"), block_windows=block).select("row.*", "out.*").collect()
    want = brute_contamination([r["text"] for r in got], [b for b in bench if b[0] is not None], 13)
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in got] == want
    assert len(got) == both.count()


def test_contamination_plan_and_shared_windows(spark):
    """One Python node however many blocks; a window of very many items names them all."""
    docs = spark.createDataFrame([(1, "x a b c y"), (2, "none here")], "doc_id long, text string")
    bench = spark.range(20_000).select("id", F.when(F.col("id") < 19_990, "a b c").otherwise(F.concat(F.lit("q"), "id")).alias("t"))
    found = contamination.find_contamination(docs, bench, item_id="id", item_text="t", block_windows=5_000, keep=["doc_id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    got = {r[0]: (r[1], len(r[2])) for r in found.select("row.doc_id", "out.n_hit", "out.items").collect()}
    assert got == {1: (3, 19_990), 2: (0, 0)}


def test_contamination_of_nothing(spark, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination.decontaminate(odd, bench).count() == odd.count()
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contamination.decontaminate(empty(spark), some).count() == 0
    assert contamination.decontaminate(odd, some).columns == odd.columns


# Models


def labelled(spark, n=240):
    docs = [(k, ("good words flow here " if k % 2 else "zz### qq### ") * (3 + k % 5) + str(k)) for k in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(n)] + [(None, 1), (3, None)], "doc_id long, quality int")


def test_quality_model(spark, odd):
    docs, labels = labelled(spark)
    model = quality_model.fit_quality(docs, labels)
    got = quality_model.score_quality(docs, model).select("row.doc_id", "out.score").collect()
    assert all((r["score"] >= 0.7) == bool(r["doc_id"] % 2) for r in got)
    scored = quality_model.score_quality(odd, model)
    rows = scored.select("row.text", "out.score").collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["text"] or ""].add(r["score"])
    assert all(len(v) == 1 for v in by_text.values())
    assert scored.select("row.*").columns == odd.columns
    assert quality_model.score_quality(empty(spark), model).count() == 0


def test_quality_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_model.fit_quality(odd, none)
    assert {r["score"] for r in quality_model.score_quality(odd, model).select("out.score").collect()} == {0.5}


def brute_quality(model, text):
    """Every n-gram on its own through the model's slots: characters, words, pairs and patterns."""
    hasher, total, n = RollingHash(), 0.0, 0
    data = text.encode()
    for slots, lo, hi in quality_model.ngram_slots(np.frombuffer(data, np.uint8), np.array([0, len(data)]), model.bits, hasher):
        for s in slots.tolist()[int(lo[0]) : max(int(lo[0]), int(hi[0]))]:
            total, n = total + float(model.lift[s]), n + 1
    w = len(text.split())
    assert n == sum(max(0, len(text) - k + 1) for k in (3, 4)) + w + 2 * max(0, w - 1) + max(0, w - 2)
    return 1 / (1 + np.exp(-(model.bias + total / max(n, 1))))


def test_quality_scores(spark):
    """Scores of a batch against each text alone, and against the averaged vectors of the trained table."""
    rng = np.random.default_rng(5)
    model = quality_model.SubwordModel(rng.normal(0, 1, 1 << 12).astype(np.float32), 0.3, 12)
    texts = ["", "a", "ab", "the cat sat on the mat", "x x x y y", "\u00e9\u00e9 \u4e00\u4e00 z", "word " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality_model.score_quality(df, model, keep=["doc_id"]).select("row.doc_id", "out.score").collect()}
    assert got == {k: pytest.approx(brute_quality(model, t), abs=2e-6) for k, t in enumerate(texts)}


def test_quality_training_step():
    """One step of the embedding's gradient descent against its formula written out."""
    slots, counts = np.array([1, 3], np.uint32), np.array([2.0, 1.0], np.float32)
    start = np.random.default_rng(1).uniform(-1 / 4, 1 / 4, (8, 4)).astype(np.float32)
    model = quality_model.train([(slots, counts, 1)], bits=3, dimensions=4, epochs=1)
    bias = np.log(np.array([1, 2]) / 3)
    p = np.exp(bias) / np.exp(bias).sum() - np.array([0, 1])  # the output layer begins at zero
    out = -0.5 * np.outer((2 * start[1] + start[3]) / 3, p)
    assert model.bias == pytest.approx((bias - 0.05 * p)[1] - (bias - 0.05 * p)[0], abs=1e-5)
    assert np.allclose(model.lift, start @ (out[:, 1] - out[:, 0]), atol=1e-5)


def test_sample_is_bounded(spark):
    """A labelled id that repeats gives one row, that of the text with the least hash."""
    docs = spark.range(1000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 500).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    for rows, want in ((5, 3), (2, 2)):
        got = sample_labelled(docs, labels, "quality", rows=rows, id_col="doc_id", text="text", held_out=None).collect()
        assert len(got) == want and got == sample_labelled(docs.orderBy("text"), labels, "quality", rows=rows, id_col="doc_id", text="text", held_out=None).collect()
    langs = docs.withColumn("lang", F.lit("xx"))
    seen = {}
    lang_id_train, lang_id.train = lang_id.train, lambda data, sizes, labels, languages, **_: seen.update(n=len(labels))
    try:
        lang_id.fit_languages(langs, sample_rows=10, held_out=None)
    finally:
        lang_id.train = lang_id_train
    assert seen["n"] == 3


def test_toxicity(spark, odd):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(600):
        bad = k % 6 == 0
        w = rng.choice(vocabulary, 60).tolist() + (rng.choice(["awful", "vile", "nasty"], 1 + k % 9).tolist() if bad else [])
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).select("row.doc_id", "out.*").collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got[k]["p_toxic"] >= 0.5) == (k % 6 == 0) for k in held]) > 0.95
    assert all(got[k]["p_toxic"] < 0.5 for k in got if k % 6)
    assert got[k := 48]["severity"] < got[444]["severity"], k
    scored = toxicity.score_toxicity(odd, model)
    assert scored.count() == odd.count() and scored.select("row.*").columns == odd.columns
    assert toxicity.score_toxicity(empty(spark), model).count() == 0


def test_toxicity_without_labels(spark, odd):
    model = toxicity.fit_toxicity(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(odd, model).filter("out.p_toxic >= 0.5").count() == 0


def ordinal_loss(slots, counts, grade, weights, thresholds):
    """The mean negative log-likelihood of cumulative links, by plain loops."""
    total = 0.0
    for s, c, g in zip(slots, counts, grade, strict=True):
        z = sum(weights.get(int(k), 0.0) * (1 + np.log(n)) for k, n in zip(s, c, strict=True))
        over = [1.0, *[1 / (1 + np.exp(-(z - t))) for t in thresholds], 0.0]
        total -= np.log(over[g] - over[g + 1])
    return total / len(grade)


def test_ordinal_fit():
    """Fitted weights and thresholds leave the penalised likelihood flat: no finite difference at them is steeper than the penalty."""
    rng = np.random.default_rng(2)
    grade = np.repeat([0, 1, 2, 3], 60)
    rng.shuffle(grade)
    slots = [np.unique(rng.integers(0, 12, 3 + g)) for g in grade]
    counts = [rng.integers(1, 3, len(s)) for s in slots]
    model = toxicity.train(slots, counts, grade, rounds=3000, l1=1e-3)
    w, t = dict(zip(model.slots.tolist(), model.weights.astype(float).tolist(), strict=True)), model.thresholds.copy()
    assert (np.diff(t) > 0).all()
    eps = 1e-4
    for k in range(12):
        up, down = (ordinal_loss(slots, counts, grade, {**w, k: w.get(k, 0.0) + e}, t) for e in (eps, -eps))
        slope = (up - down) / (2 * eps)
        assert slope == pytest.approx(-1e-3 * np.sign(w[k]), abs=4e-4) if k in w else abs(slope) <= 1.4e-3
    for k in range(3):
        up, down = (ordinal_loss(slots, counts, grade, w, t + e * (np.arange(3) == k)) for e in (eps, -eps))
        assert abs(up - down) / (2 * eps) < 0.01


def test_toxicity_scores(spark):
    """Scores against plain loops over words and stems."""
    hasher = RollingHash()

    def slot(word, n=None):
        data = np.frombuffer(word.encode(), np.uint8)
        h = hasher.spans(hasher.prefix(data), np.array([0]), np.array([n or len(data)]))
        return int((h * np.uint64(2 * n + 1 if n else 1) >> np.uint64(44))[0])

    weight = {slot("vile"): 1.5, slot("awfully"): 0.7, slot("awfully", 4): 0.4, slot("awfully", 6): -0.2}
    model = toxicity.OrdinalModel(np.array([weight[k] for k in sorted(weight)], np.float32), np.array(sorted(weight)), np.array([1.0, 2.0, 3.5]), 20)
    texts = [None, "", "vile", "Vile vile VILE!", "awfully nice", "awfulness", "awfully awful vile"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model, keep=["doc_id"]).select("row.doc_id", "out.*").collect()}
    for k, t in enumerate(texts):
        found = Counter()
        for w in re.findall("[0-9a-z]+", (t or "").lower()):
            found.update([slot(w), *[slot(w, n) for n in toxicity.STEMS if len(w) > n]])
        z = sum(weight[s] * (1 + np.log(n)) for s, n in found.items() if s in weight)
        over = [1 / (1 + np.exp(-(z - x))) for x in (1.0, 2.0, 3.5)]
        chances = -np.diff([1.0, *over, 0.0])
        assert got[k]["severity"] == pytest.approx(sum(over), abs=2e-6) and got[k]["p_toxic"] == pytest.approx(over[0], abs=2e-6) and got[k]["grade"] == chances.argmax()


def brute_states(layer, data):
    """One direction byte by byte, with numbers and loops."""
    k = layer.h.shape[1]
    h, out = np.zeros(k), []
    for byte in data:
        x, g = layer.x[:, byte].astype(float), layer.h.astype(float) @ h
        r, z = np.clip(x[:k] + g[:k], 0, 1), np.clip(x[k : 2 * k] + g[k : 2 * k], 0, 1)
        c = np.tanh(x[2 * k :] + r * g[2 * k :])
        h = c + z * (h - c)
        out.append(h)
    return out


def test_language_scores(spark):
    """Pooled probabilities against loops over windows and positions."""
    rng = np.random.default_rng(6)
    model = lang_id.LanguageModel(["a", "b", "c"], lang_id.Layer.new(4, rng), lang_id.Layer.new(4, rng), rng.normal(0, 1, (3, 8)).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32), 4)
    texts = ["x", "some words here", "z" * 64, "abc " * 40, "\u00e9" * 70]
    got = lang_id.predict_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, keep=["doc_id"]).select("row.doc_id", "out.*").collect()
    for r in got:
        data, total = texts[r["doc_id"]].encode(), np.zeros(3)
        for i in range(0, len(data), lang_id.WINDOW):
            w = data[i : i + lang_id.WINDOW]
            for f, b in zip(brute_states(model.ahead, w), brute_states(model.back, w[::-1])[::-1], strict=True):
                z = model.out.astype(float) @ np.concatenate([f, b]) + model.bias
                total += np.exp(z) / np.exp(z).sum()
        mean = total / len(data)
        assert r["lang_pred"] == "abc"[mean.argmax()] and r["score"] == pytest.approx(mean.max(), abs=1e-4)


def test_languages(spark, docs, odd):
    model = lang_id.fit_languages(docs)
    got = lang_id.predict_languages(docs, model).select("row.doc_id", "row.lang", "out.*").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9
    rows = lang_id.predict_languages(odd, model).select("row.text", "out.*").collect()
    assert len(rows) == odd.count()
    for r in rows:
        letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letter) and 0 <= r["score"] <= 1
    assert lang_id.predict_languages(empty(spark), model).count() == 0
    none = lang_id.fit_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in lang_id.predict_languages(odd, none).select("out.lang_pred").collect()} == {"und"}


def test_backpropagation():
    """Gradients of the recurrent layer against finite differences."""
    rng = np.random.default_rng(4)
    layer = lang_id.Layer.new(3, rng)
    layer.x, layer.h = layer.x.astype(np.float64), layer.h.astype(np.float64)
    data, mask = rng.integers(0, 256, (6, 4)).astype(np.uint8), np.ones((6, 4), np.float32)
    mask[4:, 1] = 0
    weight = rng.normal(size=(6, 3, 4))
    loss = lambda: float((layer.forward(data, mask)[0] * weight).sum())
    states, kept = layer.forward(data, mask, True)
    grad = layer.backward(data, mask, kept, weight.astype(np.float32))
    for array, g in ((layer.h, grad.h), (layer.x, grad.x)):
        spots = np.argwhere(np.abs(g) > 1e-3)[:25]
        for i, j in spots:
            old, eps = array[i, j], 1e-2
            array[i, j] = old + eps
            up = loss()
            array[i, j] = old - eps
            down = loss()
            array[i, j] = old
            assert g[i, j] == pytest.approx((up - down) / (2 * eps), rel=0.1, abs=0.02)


# Token files and chats


@pytest.mark.parametrize("added", [False, True])
def test_token_files(spark, odd, tmp_path, added):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    tk.encode_special_tokens = not added
    path = str(tmp_path / "t")
    index = token_files.write_tokens(odd, path, tokenizer_path(), partitions=3, added=added).orderBy("part").collect()
    got = token_files.read_tokens(spark, path, token_files.crc32_ids, "ids_crc32 long").collect()
    assert len(got) == odd.count() and [r["token_base"] for r in index] == np.cumsum([0, *[r["n_tokens"] for r in index]]).tolist()[:-1]
    want = Counter()
    for r in odd.collect():
        ids = [*tk.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *[r["n_tokens"] for r in ordered]]).tolist()[:-1]
    keys = [r["id"] for r in ordered]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])


def test_one_id_fills_many_partitions(spark, tmp_path):
    """Rows of one id, and equal rows, are spread over partitions; files of other attempts go."""
    docs = spark.range(2000).select(F.lit(7).alias("doc_id"), F.when(F.col("id") % 2 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    path = str(tmp_path / "t")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "0-ids.bin").write_bytes(b"orphan")
    index = token_files.write_tokens(docs, path, tokenizer_path(), partitions=6).collect()
    assert sum(r["n_docs"] for r in index) == 2000 and max(r["n_docs"] for r in index) < 700
    assert not (tmp_path / "t" / "0-ids.bin").exists()
    assert token_files.read_tokens(spark, path, token_files.crc32_ids, "c long").count() == 2000
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        token_files.write_tokens(docs.withColumn("doc_id", F.lit("a")), str(tmp_path / "u"), tokenizer_path())


def test_slices_of_a_remote_file(tmp_path, monkeypatch):
    """A file of another file system than the local one is read by position."""
    import pyarrow.fs as pfs

    (tmp_path / "a").write_bytes(np.arange(5, dtype="<u2").tobytes())
    (tmp_path / "none").write_bytes(b"")
    remote = pfs.SubTreeFileSystem(str(tmp_path), pfs.LocalFileSystem())
    monkeypatch.setattr(token_files.pfs, "FileSystem", type("F", (), {"from_uri": staticmethod(lambda p: (remote, p))}))
    a = token_files._Slices("a", "<u2")
    assert a.size == 5 and a.map is None and a[1:3].tolist() == [1, 2] and a[4:9].tolist() == [4] and a[3:3].tolist() == []
    assert token_files._Slices("none", "<u2")[0:4].tolist() == []


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want.fetchall())


def test_language_sample(spark, monkeypatch):
    """Every language is drawn from, and every byte of a drawn text is learned from."""
    seen = {}
    monkeypatch.setattr(lang_id, "train", lambda data, sizes, labels, languages, **_: seen.update(data=data, sizes=sizes, labels=labels, languages=languages))
    texts = {k: f"{k} " + "word " * 150 for k in range(400)}
    rows = [(k, t, "rare" if k == 7 else "often") for k, t in texts.items()] + [(1000, None, "often"), (1001, "", "none")]
    lang_id.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=10, held_out=None)
    assert seen["languages"] == ["often", "rare"]
    joined = b"".join(w[:n].tobytes() for w, n in zip(seen["data"], seen["sizes"], strict=True)).decode()
    found = [int(k) for k in re.findall(r"\d+", joined)]
    assert 7 in found and 9 <= len(found) <= 10 and joined == "".join(texts[k] for k in found)
    assert int((seen["labels"] == 1).sum()) == -(-len(texts[7]) // lang_id.WINDOW)
    assert lang_id.parts({"a": 1, "b": 50, "c": 10**9}, 100) == {"a": 1, "b": 49, "c": 50}


def test_token_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert token_files.write_tokens(empty(spark), path, tokenizer_path()).count() == 0
    assert token_files.read_tokens(spark, path, token_files.crc32_ids, "c long").count() == 0


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("added", [False, True])
def test_encoder_is_the_library(file, added):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path(file))
    tk.encode_special_tokens = not added
    enc = token_files.Encoder(tokenizer_path(file), "<u2", added)
    texts = ["a b", " a b", "a b ", "a  b", "a \nb c", "a\n b c", "it's o'clock 's x' y", "a\tb c", "x\u00a0y z", "x\u3000 y z", "\x1c a b", "1 23 a1 $ .. a", "<|endoftext|> x y", "a x. y's z' caf\u00e9. \u0661. n\u0301. o\u00b2 p2 \u4e00\u3002 q", "\u00fcber, \u0250 \u0251b. na\u00efve (x) y)", "a <|endoftext|> b", *[t for t in ODD if t]]
    for _ in range(2):
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == tk.encode(text, add_special_tokens=False).ids, repr(text)
    assert enc.by_units == file.startswith("byte")


def test_encoder_refuses_a_narrow_type(tmp_path):
    from tokenizers import Tokenizer, models

    big = tmp_path / "big.json"
    Tokenizer(models.WordLevel({f"w{k}": k for k in range(70_000)}, unk_token="w0")).save(str(big))
    with pytest.raises(ValueError, match="fit"):
        token_files.Encoder(str(big), "<u2")


def test_token_files_with_added_tokens(spark, tmp_path):
    """op3 reads texts as the library does in its default settings."""
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    texts = [*ODD[:12], "a b <|endoftext|> c", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y  z", "<|endoftext |>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op3_token_files"](spark, str(tmp_path)).collect()}
    ids = [[*tk.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert 50256 in ids[12] and got == {k: (len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, i in enumerate(ids)}


def test_memory_keeps_what_is_used():
    made = []
    m = token_files.Memory(2, lambda k: made.append(k) or k.encode())
    for k in "abca":
        assert m[k] == k.encode()
    m.age()
    assert m["a"] == b"a" and dict(m) == {"a": b"a"} and made == ["a", "b", "c"]
    for k in "xya":
        assert m[k] == k.encode()
    m.age()
    assert m["b"] == b"b" and made == ["a", "b", "c", "x", "y", "b"]


TURNS = "conv_id long, turn long, role string, text string, ids string"


def test_chats(spark):
    rows = [(1, 1, "assistant", "second", "x"), (1, 0, "user", "first <|im_end|> <\\|x|>", "x"), (1, None, "system", None, "x"), (1, 1, "assistant", "second", "x"), (-1, 0, "user", CONTROL, "x"), (-1, 1, "assistant", CONTROL, "x"), (None, 0, None, "no one", "x"), (2, 0, "<|im_sep|>odd\nrole", "é" * 3000, "x"), (2, 1, "assistant", None, "x")]
    df = spark.createDataFrame(rows, TURNS)
    made = chat_format.assemble(df, tokenizer_path())
    got = {r["conversation"]: r for r in chat_format.digests(made, tokenizer_path()).collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    for c, own in by.items():
        own.sort()
        loss = "".join(x[2] for x in own if x[1] == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    written = sum(len(f"<|im_start|>{r}<|im_sep|>{chat_format.escape(t)}<|im_end|>") for _, r, t in by[-1])
    assert got[-1]["formatted_chars"] == written
    assert chat_format.digests(chat_format.assemble(spark.createDataFrame([], TURNS), tokenizer_path()), tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["<|a|>", "<\\|a", "<\\\\|", "a<b|c", "<<||", "", "\\<|"])
def test_escape_is_reversible(text):
    assert "<|" not in chat_format.escape(text) and chat_format.unescape(chat_format.escape(text)) == text


# URLs


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute_rule(host, path):
    fit = [(h + p, a) for h, p, a in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0])) if fit else (None, None)


def test_urls(spark):
    odd = [None, "", "x", "http://", "HTTP://ExAmple.NET/en/x?q#f", "http://notexample.net/en/", "http://a.example.com/de", "http://a.example.com/de/x", "a://b://net/x", "http://org/fr/é\nx", "http://net", "http://net?x/", "ftp://É.net/ü", "http://x.org/fr/" + "y" * 5000]
    urls = odd + odd + [f"http://good{k % 7}.org/fr/{k}" for k in range(200)] + [f"http://spam{k % 7}.net/zz{k}" for k in range(200)]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = url_filter.judge_urls(df, URL_RULES).select("row.page_id", "row.url", "host", "path", "rule", "score", "verdict").collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"]) == brute_host_path(r["url"])
        rule, action = brute_rule(r["host"], r["path"])
        assert r["rule"] == rule and r["verdict"] == (action or r["verdict"]) and r["verdict"] in ("allow", "block")
    for u in odd:
        assert len({r["verdict"] for r in got if r["url"] == u}) == 1
    assert np.mean([r["score"] for r in got if r["rule"] == "org/fr/"]) > np.mean([r["score"] for r in got if r["rule"] == "net/"])
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0


def brute_chance(model, c, context, symbol):
    """The chance of a symbol (0: end, else byte + 2) after a context of symbols, the nearest last, order by order."""
    p = 1 / 257
    data = bytes(x - 2 for x in context if x > 1)
    contexts, grams, ranges = url_filter._contexts(np.frombuffer(data + (bytes([symbol - 2]) if symbol else b""), np.uint8), np.array([0, len(data) + (symbol > 0)]), model.order, model.bits)
    for k in range(model.order + 1):
        total = model.totals[c, k, contexts[k][len(data)]]
        if total > 0:
            p = (model.grams[c, k, grams[k][len(data)]] + url_filter.PRIOR * p) / (total + url_filter.PRIOR)
    return p


@pytest.mark.parametrize("bits", [6, 18])
def test_url_chances(spark, bits):
    """Counts against counting by hand; chances of all symbols after any context add up to one, few slots or many; scores against plain loops."""
    urls = ["http://a.org/fr/x", "http://b.org/fr/y"]
    judged = spark.createDataFrame([(u, True) for u in urls] + [("http://z.net/q", False)], "url string, accepted boolean")
    counts = url_filter._count(judged, 2, bits)
    assert counts[1, 0, 0].sum() == counts[1, 1, 2].sum() == sum(len(u) + 1 for u in urls) and counts[0, 0, 1].sum() == 15
    model = url_filter.UrlModel.of(counts, 2, bits)
    for c in (0, 1):
        for context in (b"", b"h", b"ht", b"http://a.", b"qq"):
            assert sum(brute_chance(model, c, [x + 2 for x in context], s) for s in (0, *range(2, 258))) == pytest.approx(1)
    for url in ("http://a.net/", "", "x"):
        data = url.encode()
        own = [sum(np.log(brute_chance(model, c, [x + 2 for x in data[:i]], data[i] + 2 if i < len(data) else 0)) for i in range(len(data) + 1)) for c in (0, 1)]
        got = model.difference(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert got.tolist() == pytest.approx([(own[1] - own[0]) / (len(data) + 1)])


def test_url_threshold(spark):
    """The threshold against trying every one by hand on the calibration fold."""
    rows = [(f"http://good{k % 7}.org/fr/{k}", True) for k in range(150)] + [(f"http://spam{k % 7}.net/zz{k}", False) for k in range(150)] + [(f"http://good{k}.net/zz{k}", k % 2 == 0) for k in range(40)]
    judged = spark.createDataFrame(rows, "url string, accepted boolean")
    model = url_filter.fit_urls(judged)
    fold = [r for r in judged.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(url_filter.CALIBRATION))).collect() if r["fold"] == 0]
    binned = [(int(np.floor(round(float(model.difference(np.frombuffer(r["url"].encode(), np.uint8), np.array([0, len(r["url"])]))[0]), 9) / url_filter.BIN)), r["accepted"]) for r in fold]
    def gain(t):
        return np.mean([b >= t for b, ok in binned if ok]) + np.mean([b < t for b, ok in binned if not ok])
    best = max(map(gain, range(-2000, 2002)))
    assert gain(round(model.threshold / url_filter.BIN)) == pytest.approx(best)


# Quality rules


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics(spark, odd):
    more = spark.createDataFrame([(90 + k, t, None, None, None) for k, t in enumerate(["a b c a b c", "a a a a", "a a a", "x\nx\n x\n\nx", "p q r s t p q r u"])], DOC)
    got = quality_rules.text_statistics(odd.union(more)).select("row.text", *STATISTICS).collect()
    assert [tuple(r)[1:] for r in got] == [brute_statistics(r["text"]) for r in got]


def test_exact_windows_where_hashes_meet(spark, monkeypatch):
    """With places that leave no bits to the hash every window looks alike, and the exact way must take over."""
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 62)
    text = "a b c d a b c e f g a b"
    got = quality_rules.text_statistics(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(*STATISTICS).first()
    assert tuple(got) == brute_statistics(text)


def test_windows_beyond_the_places(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 3)
    text = "a b c d a b c e f g a b c d e"
    got = quality_rules.text_statistics(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(*STATISTICS).first()
    assert tuple(got) == brute_statistics(text)


def test_cascade(spark, odd):
    base = "n_words < 50"
    got = quality_rules.apply_rules(odd, base=base).select("row.text", "base_failed", "rejected_by").collect()
    assert len(got) == odd.count() and all(r["base_failed"] == (len((r["text"] or "").split()) < 50) for r in got)
    rules = quality_rules.plan_cascade(odd)
    assert {r.name for r in rules} == {r.name for r in quality_rules.RULES}
    gain = [r.rejects / r.cost for r in rules]
    assert gain == sorted(gain, reverse=True)
    forward, back = (odd.select("doc_id", quality_rules.text_statistics(odd).select("text").columns[0]) for _ in range(2))
    assert forward.columns == back.columns
    s = quality_rules.text_statistics(odd)
    a = [r["k"] is None for r in s.select(quality_rules.cascade(list(quality_rules.RULES)).alias("k")).collect()]
    b = [r["k"] is None for r in s.select(quality_rules.cascade(list(quality_rules.RULES)[::-1]).alias("k")).collect()]
    assert a == b
    assert quality_rules.apply_rules(empty(spark)).count() == 0


def test_cascade_has_no_python(spark, odd):
    plan = quality_rules.apply_rules(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Packing


def test_packing(spark, odd):
    """Every document's ids come back in order from the sequences, once; bins are as short as their contents allow."""
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    tk.encode_special_tokens = True
    got = packing.pack_documents(odd, tokenizer_path(), group_pieces=5).collect()
    pieces = []
    for r in got:
        ends = np.cumsum(r["piece_tokens"]).tolist()
        assert len(r["ids"]) == r["n_tokens"] == ends[-1] and r["capacity"] == min(c for c in packing.CAPACITIES if c >= ends[-1])
        pieces += [(d, s, r["ids"][e - n : e]) for d, s, n, e in zip(r["doc_ids"], r["piece_starts"], r["piece_tokens"], ends, strict=True)]
    assert len({r["bin"] for r in got}) == len(got)
    want = Counter()
    for r in odd.collect():
        ids = [*tk.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        most = max(packing.CAPACITIES)
        want.update((r["doc_id"], i, tuple(ids[i : i + most])) for i in range(0, len(ids), most))
    assert Counter((d, s, tuple(x)) for d, s, x in pieces) == want
    assert packing.pack_documents(empty(spark), tokenizer_path()).count() == 0


def test_packing_of_ids(spark):
    """Groups follow the plain rule one after another; rows without ids have no piece; text ids are carried."""
    rng = np.random.default_rng(9)
    sizes = [int(n) for n in rng.integers(0, 40, 60)] + [0, 200]
    rows = [(f"d{k}", bytes(np.full(n, k % 250, "<u2").tobytes())) for k, n in enumerate(sizes)] + [("none", None)]
    df = spark.createDataFrame(rows, "doc string, ids binary").coalesce(1)
    got = packing.pack_ids(df, capacities=(16, 32, 64), attention=100.0, group_pieces=20).collect()
    held = [r["n_tokens"] for r in got]
    order = [int(r["doc"][1:]) for r in df.filter("ids is not null").collect()]
    rest = [sizes[k] % 64 for k in order if sizes[k] % 64]
    want = [64] * sum(n // 64 for n in sizes) + [x for i in range(0, len(rest), 20) for x in brute_pack(rest[i : i + 20], (16, 32, 64), 100.0)]
    assert sorted(held) == sorted(want) and {d for r in got for d in r["doc_ids"]} == {f"d{k}" for k, n in enumerate(sizes) if n}
    with pytest.raises(ValueError, match="capacities"):
        packing.pack_ids(df, capacities=())


def test_best_fit_choices():
    bins, offsets, sizes = packing.pack(np.array([6, 5, 4, 3]), (10,))
    assert bins.tolist() == [0, 1, 0, 1] and offsets.tolist() == [0, 0, 6, 5] and sizes.tolist() == [10, 10]
    assert packing.pack(np.array([3]), (4, 16))[2].tolist() == [4]
    assert packing.pack(np.zeros(0, np.int64), (4,))[2].tolist() == []
    joint = packing.pack(np.array([10] * 8), (10, 40), attention=20)[2]
    assert joint.tolist() == [10] * 8  # long sequences cost more for each token


def brute_pack(lengths, capacities, attention):
    """The same rule stated plainly: scan all open bins, of equals the one filled last; simulate each opening."""
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    rest = [lengths[k] for k in order]
    held, room, touched = [], [], []
    for step, k in enumerate(order):
        n = lengths[k]
        rest.remove(n)
        open_bins = [b for b in range(len(held)) if room[b] - held[b] >= n]
        if open_bins:
            b = min(open_bins, key=lambda b: (room[b] - held[b], -touched[b]))
        else:
            def price(c, n=n):
                full = n
                for m in sorted(rest, reverse=True):
                    if full + m <= c:
                        full += m
                return packing.cost(c, attention) / full, c
            room.append(min((c for c in capacities if c >= n), key=price))
            held.append(0)
            touched.append(step)
            b = len(held) - 1
        held[b] += n
        touched[b] = step
    return sorted(held)


@pytest.mark.parametrize("seed", range(6))
def test_packing_follows_the_plain_rule(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 60, 80)
    bins, _, sizes = packing.pack(lengths, (16, 32, 64), 100.0)
    own = np.bincount(bins, weights=lengths).astype(int).tolist()
    assert sizes.tolist() == [min(c for c in (16, 32, 64) if c >= n) for n in own]
    assert sorted(np.bincount(bins, weights=lengths).astype(int).tolist()) == brute_pack(lengths.tolist(), (16, 32, 64), 100.0)


# Near-duplicates


def brute_fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark, odd):
    rng = np.random.default_rng(8)
    base = rng.choice([f"t{k}" for k in range(3000)], 800).tolist()
    near = []
    for k in range(40):
        w = list(base)
        for p in rng.integers(0, 800, 2):
            w[p] = f"changed{k}"
        near.append((200 + k, " ".join(w), None, None, None))
    df = odd.union(spark.createDataFrame(near, DOC))
    got = simhash.near_duplicates(df).select("doc_id", simhash.hex16("fp").alias("fp"), "component_id").collect()
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.collect()]
    group = list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if (a ^ b).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (k, _) in zip(group, rows, strict=True):
        if k is not None:
            least[g] = min(least.get(g, k), k)
    want = Counter((k, f"{f:016x}", least.get(g)) for g, (k, f) in zip(group, rows, strict=True))
    assert Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_links_connect_all(spark, seed):
    """Dense groups, with more members than are compared all with all: the links' components are those of all links."""
    rng = np.random.default_rng(seed)
    hot = (4096, 4096, 40, 3)[seed]  # members of a signature that is dealt out again
    centres = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = {int(rng.choice(centres)) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))) for _ in range(300)}
    f = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    root = {r["node"]: r["root"] for r in simhash.connected_components(simhash.links(df, hot=hot)).collect()}
    got = defaultdict(set)
    for x in f.view(np.int64).tolist():
        got[root.get(x, x)].add(x)
    group = np.arange(len(f))
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4):
            group[group == group[j]] = group[i]
    want = defaultdict(set)
    for g, x in zip(group.tolist(), f.view(np.int64).tolist(), strict=True):
        want[g].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_masks_find_every_link():
    """Any two fingerprints within four bits share a signature, at each level."""
    rng = np.random.default_rng(3)
    for level in (0, 1):
        m = np.array(simhash.masks(level), np.uint64)
        assert len(m) == 271 * 5**level
        for n in range(5):
            for _ in range(300):
                d = np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
                hit = (m & d) == 0
                assert hit.any()
                if level:  # some narrower mask of each wider one that fits
                    wide = (np.array(simhash.masks(0), np.uint64) & d) == 0
                    assert (hit.reshape(-1, 5).any(axis=1) == wide).all()


def test_hot_signature(spark):
    """50,000 fingerprints under one signature, which is dealt out again: links as from comparing all."""
    rng, mask = np.random.default_rng(0), np.uint64(simhash.masks()[0])
    some = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64) * np.uint64(2)
    near = rng.choice(some, 10_000) ^ (np.uint64(1) << rng.integers(0, 64, 10_000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 10_000).astype(np.uint64))
    f = np.unique(np.concatenate([some, near]) & ~mask | np.uint64(0x5A5A5A5A5A5A5A5A) & mask)
    found = simhash.links(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")).select("a", "b").toArrow()
    parent = dict(zip(f.view(np.int64).tolist(), range(len(f)), strict=True))
    group = np.arange(len(f))

    def top(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for a, b in zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True):
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        group[top(parent[a])] = top(parent[b])
    roots = np.array([top(i) for i in range(len(f))])
    assert len(found) > 5_000
    for i in range(0, len(f), 100):
        near = np.bitwise_count(f ^ f[i]) <= 4
        assert (roots[near] == roots[i]).all()


def test_long_text_fingerprint(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(LONG[:2000].encode()) == brute_fingerprint(LONG[:2000])


def test_keep_one(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    parts = defaultdict(set)
    for r in simhash.near_duplicates(odd).collect():
        parts[r["component_id"]].add(r["doc_id"])
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(k for k in parts if k is not None)
    assert ids.count(None) == (None in parts)
    with pytest.raises(ValueError, match="bits"):
        simhash.near_duplicates(odd, bits=5)


def test_keep_one_of_rows_without_id(spark):
    rows = [(None, "a b c d e", 1), (None, "a b c d e", 2), (5, "a b c d e", 3), (None, "other words stand here", 4), (None, "other words stand here", 5), (7, "x y", 6), (7, "z w", 7), (7, "z w", 8)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, id int")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "other words stand here"), (5, "a b c d e"), (7, "x y"), (7, "z w")]


def test_texts_beyond_a_block(spark):
    """A text of over 1 MiB is a block of its own: results equal those with larger blocks, beside short texts."""
    from kithline.llm import common

    huge = " ".join(f"word{k % 4001} vile" for k in range(90_000))
    assert len(huge) > 1_200_000
    texts = ["short one", huge, None, "", "last words vile"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rng = np.random.default_rng(7)
    quality = quality_model.SubwordModel(rng.normal(0, 1, 1 << 12).astype(np.float32), 0.1, 12)
    toxic = toxicity.OrdinalModel(rng.normal(0, 0.01, 1 << 16).astype(np.float32), np.arange(1 << 16) * 16, np.array([1.0, 2.0, 3.0]), 20)
    tongue = lang_id.LanguageModel(["a", "b"], lang_id.Layer.new(4, rng), lang_id.Layer.new(4, rng), rng.normal(0, 1, (2, 8)).astype(np.float32), np.zeros(2, np.float32), 4)
    data = [(t or "").encode() for t in texts]
    flat, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    assert [(lo, hi) for lo, hi, _, _ in common.blocks(flat, offsets)] == [(0, 1), (1, 2), (2, 5)]
    for fn, model, alone in ((quality_model.score_quality, quality, "score"), (toxicity.score_toxicity, toxic, "severity"), (lang_id.predict_languages, tongue, "score")):
        together = {r[0]: r[1] for r in fn(df, model, keep=["doc_id"]).select("row.doc_id", f"out.{alone}").collect()}
        for k in range(5):
            assert fn(df.filter(F.col("doc_id") == k), model, keep=["doc_id"]).select(f"out.{alone}").first()[0] == pytest.approx(together[k], abs=2e-6)
    bench = spark.createDataFrame([(1, " ".join(huge.split()[5000:5013])), (2, "last words vile")], "item_id long, text string")
    found = {r[0]: list(r)[1:] for r in contamination.find_contamination(df, bench).select("row.doc_id", "out.n_words", "out.n_hit", "out.items").collect()}
    assert found == {k: list(brute_contamination([t], [(1, " ".join(huge.split()[5000:5013])), (2, "last words vile")], 13)[0]) for k, t in enumerate(texts)}


def test_batches_are_bounded_in_bytes(spark):
    """Ten texts of 20 MB don't come to a task in one batch."""
    from kithline.llm.common import map_rows, struct

    import pyarrow as pa

    df = spark.range(10).coalesce(1).select("id", F.repeat(F.lit("x"), 20_000_000).alias("text"))
    sizes = map_rows(df, lambda row: struct(n=pa.array([len(row)] * len(row), pa.int64())), "n long", ["id"]).select("out.n").collect()
    assert max(r["n"] for r in sizes) <= 5


def test_language_windows_are_bounded(spark):
    """Windows come from all of a long text, at most so many, and the same ones each time; more languages than rows are refused."""
    text = b"".join(f"{k:>63} ".encode() for k in range(5000))
    got = lang_id.drawn_windows(text, 64)
    assert len(got) == 64 and got == lang_id.drawn_windows(text, 64) and {len(w) for w in got} == {64}
    places = [int(w) for w in got]
    assert places == sorted(set(places)) and places[0] < 1000 and places[-1] > 4000
    assert lang_id.drawn_windows(b"a" * 130, 64) == [b"a" * 64, b"a" * 64, b"aa"] and lang_id.drawn_windows(b"", 64) == []
    data, sizes = lang_id.stacked([b"ab", b"c" * 64])
    assert data.shape == (2, 64) and sizes.tolist() == [2, 64] and data[0, :3].tolist() == [97, 98, 0]
    docs = spark.createDataFrame([(k, f"text {k}", f"l{k}") for k in range(8)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        lang_id.fit_languages(docs, sample_rows=3, held_out=None)


def test_scratch_of_threads(spark):
    """What one thread names is not deleted by the end of another's scratch()."""
    from threading import Barrier, Thread

    from kithline.llm.common import scratch, written

    both, seen = Barrier(2, timeout=60), {}

    def ends():
        with scratch(spark):
            written(spark.range(3), "ends")
            both.wait()

    def reads():
        with scratch(spark):
            df = written(spark.range(5), "reads")
            both.wait()
            other.join()
            seen["n"] = df.count()

    other, own = Thread(target=ends), Thread(target=reads)
    other.start()
    own.start()
    own.join()
    assert seen == {"n": 5}


def test_block_counts(spark, odd):
    """Shingle counts of many blocks are those of one, and a task's counts are one block's at a time."""
    docs = odd.select("doc_id", "text")
    bench = spark.createDataFrame([(k, f"one two three four five w{k}x{k % 13} w{k + 1}x{(k + 1) % 13}") for k in range(40)], "item_id long, text string")
    one, many = ({(tuple(r["row"]), tuple(r["out"]["items"]), r["out"]["n_hit"]) for r in contamination.find_contamination(docs, bench, window=3, shingle=2, block_windows=n).collect()} for n in (1000, 7))
    assert one == many and any(items for _, items, _ in one)


def test_units_of_line_ends(monkeypatch):
    """Line ends within units: the library's ids, without its pre-tokenizer for a word, a line end and a word."""
    from tokenizers import Tokenizer

    tk, enc = Tokenizer.from_file(tokenizer_path()), token_files.Encoder(tokenizer_path(), "<u2")
    texts = ["one end.\nNext über\nstraße, a\n\nb", "a b\t\nc d\n e", "x don't\ncan't 'll\n's y\n12.\n..z", "a b\x1c\nc d\u00a0\ne", "\nb c\n", "", "one", "a  b", " a b", "é\u2028x y\n中文\nz", "a \x85\nb c\r\nd"]
    want = [np.array(tk.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert enc.encode(texts) == want
    asked = []
    monkeypatch.setattr(enc, "_spelled", lambda text: asked.append(text) or [])
    assert enc._unit("quonge.\nTharle,\nwem") and not asked
