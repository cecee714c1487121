"""Language model, media, toxicity, language, HTML and licence operators against plain re-computations and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.llm import kneser_ney, langid, licences, mjpeg, tagpath, toxicity

DOCS = "doc_id long, text string, lang string, source string, score double"


def edge_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, and a column that clashes with results."""
    rows = [
        (1, "the cat sat on the mat", "en", "a", 0.5), (1, "the cat sat on the mat", "en", "a", 0.5), (2, "", "en", None, None),
        (3, None, None, "a", 1.0), (None, "a text without an id", "en", "b", None), (4, "word " * 30_000, "en", "b", 0.0),
        (5, "ünï çödé ÄÖ \U0001f600 0xFF", "de", "b", 0.1), (6, " \t\n ", "fr", "c", None), (7, "12 34 %% \x00 |", "en", "a", 2.0),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---- language model ----


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [1]


def model_by_dictionaries(texts):
    pairs, words = Counter(), Counter()
    for t in texts:
        seq = [0, *tokens(t)]
        pairs.update(zip(seq, seq[1:], strict=False))
        words.update(seq[1:])
    before = Counter(b for _, b in pairs)
    total = Counter()
    kinds = {}
    for (a, _), n in pairs.items():
        total[a] += n
        kinds.setdefault(a, Counter())[min(n, 3)] += 1
    d = (0, *kneser_ney.discounts([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)]))
    low = (0, *kneser_ney.discounts([sum(n == k for n in before.values()) for k in (1, 2, 3, 4)]))
    rest = sum(low[min(n, 3)] for n in before.values()) / len(pairs)

    def unigram(b):
        return max(before[b] - low[min(before[b], 3)], 0) / len(pairs) + rest / (len(words) + 1)

    def p(a, b):
        if not total[a]:
            return unigram(b)
        share = sum(d[k] * n for k, n in kinds[a].items()) / total[a]
        return max(pairs[a, b] - d[min(pairs[a, b], 3)], 0) / total[a] + share * unigram(b)

    return p, words


def test_kneser_ney_equals_dictionaries(spark, docs):
    few = docs.filter("doc_id < 60")
    got = {r.doc_id: r for r in kneser_ney.score_held_out(few).collect()}
    rows = few.select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows}
    p, words = model_by_dictionaries([r.text for r in rows if not held[r.doc_id]])
    n, v = sum(words.values()), len(words)
    for r in rows:
        seq = [0, *tokens(r.text)]
        g = got[r.doc_id]
        assert g.held_out == held[r.doc_id] and g.n_tokens == len(seq) - 1 and g.train_tokens == n
        assert g.n_known == sum(words[w] > 0 for w in seq[1:])
        assert g.base_score == pytest.approx(sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in seq[1:]), rel=1e-9)
        assert g.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(seq, seq[1:], strict=False)), rel=1e-9)
    contexts = [0, "the", "of"]
    for a in contexts:  # a distribution over the known words and one unknown
        assert sum(p(a, w) for w in words) + p(a, "\x00unknown") == pytest.approx(1, abs=1e-6)


def test_large_counts_are_stored_whole(tmp_path):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    values = rng.choice([0, 7, 254, 255, 256, 2**32 - 2, 2**32 - 1, 2**32, 2**40], (50, 6))
    for kind in (np.uint8, np.uint32):
        assert (kneser_ney._unpack(*kneser_ney._pack(values.ravel(), kind), kind) == values.ravel()).all()
    words = np.sort(rng.integers(0, 2**62, 50).astype(np.uint64))
    small, large = kneser_ney._pack(values.ravel(), np.uint32)
    row = [(0, words.tobytes(), small, large, np.zeros(5, "<i8").tobytes())] * 2  # two parts of one shard
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*row, strict=True)], ["shard", "words", "small", "large", "tally"])
    (stats,) = kneser_ney._merge_words(str(tmp_path))(iter([batch]))
    assert stats.column("tokens")[0].as_py() == 2 * values[:, 5].sum()
    found = kneser_ney.Reader(kneser_ney.Model(str(tmp_path), 1, 1, 0, 0, (), 0, (), 0)).words(words)
    assert (np.stack([found[k] for k in kneser_ney.WORD], 1) == 2 * values).all()


def test_shards_follow_the_text(spark, docs, monkeypatch):
    few = docs.filter("doc_id < 60").select("text")
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 1000)
    monkeypatch.setattr(kneser_ney, "WORD_SHARD_BYTES", 5000)
    model = kneser_ney.fit(few)
    size = sum(len((r.text or "").encode()) for r in few.collect())
    assert size / 1000 <= model.shards < 2 * size / 1000 + 2 and model.word_shards >= size / 5000 - 1
    test_kneser_ney_equals_dictionaries(spark, docs)


def test_kneser_ney_edges(spark):
    rows = kneser_ney.score_held_out(edge_docs(spark)).collect()
    assert len(rows) == 9 and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 6)} == {1}
    assert kneser_ney.score_held_out(edge_docs(spark).limit(0)).count() == 0


# ---- media ----


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 64, bytes(range(256)) * 50, b"\xff" * 200, "é\U0001f600".encode() * 3000])
def test_media_round_trip(data):
    media = mjpeg.store(data)
    payload, histograms, fps = mjpeg.load(media)
    assert payload == data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
    assert len(histograms) == -(-len(payload) // mjpeg.PER_FRAME) and fps == 25.0


def jpeg_of(units, parts, wide, high, restart, ac_symbols):
    """A baseline JPEG by plain bit strings; units: for each unit of the scan, each component's blocks of 64 coefficients."""
    dc_symbols = list(range(12))
    code_of = lambda symbols, bits: {s: format(i, f"0{bits}b") for i, s in enumerate(symbols)}
    dc, ac = code_of(dc_symbols, 4), code_of(ac_symbols, 8)
    number = lambda v: format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else ""
    out, bits, before = b"", "", [0] * len(parts)

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""

    for n, unit in enumerate(units):
        if restart and n and n % restart == 0:
            out += flush(bits) + bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
            bits, before = "", [0] * len(parts)
        for c, blocks in enumerate(unit):
            for block in blocks:
                step, before[c] = block[0] - before[c], block[0]
                bits += dc[abs(step).bit_length()] + number(step)
                run = 0
                for v in block[1:]:
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + ac[0xF0], run - 16
                    bits, run = bits + ac[run << 4 | abs(v).bit_length()] + number(v), 0
                if run:
                    bits += ac[0]
    out += flush(bits)
    head = b"\xff\xd8" + mjpeg._segment(0xDB, b"\x00" + bytes(range(1, 65)))
    head += mjpeg._segment(0xC0, b"\x08" + high.to_bytes(2, "big") + wide.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(parts)))
    head += mjpeg._segment(0xC4, b"\x00" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(dc_symbols) + b"\x10" + bytes([0] * 7 + [len(ac_symbols)] + [0] * 8) + bytes(ac_symbols))
    head += mjpeg._segment(0xDD, restart.to_bytes(2, "big")) if restart else b""
    head += mjpeg._segment(0xDA, bytes([len(parts)]) + b"".join(bytes([i + 1, 0]) for i in range(len(parts))) + b"\x00\x3f\x00")
    return head + out + b"\xff\xd9"


@pytest.mark.parametrize(("parts", "restart"), [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_frames_are_decoded_by_their_own_tables(parts, restart):
    rng = np.random.default_rng(len(parts) + restart)
    ac_symbols = rng.permutation([0, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]).tolist()
    h, v = parts[0]
    wide, high = 3, 2  # units
    frames, want = [], []
    for _ in range(4):
        units, first = [], np.zeros((high * v, wide * h, 64), int)
        for n in range(wide * high):
            unit = []
            for c, (a, b) in enumerate(parts):
                blocks = rng.integers(-1023, 1024, (a * b, 64)) * (rng.random((a * b, 64)) < rng.choice([0.03, 0.3, 1.0]))
                unit.append(blocks.tolist())
                if not c:
                    for k in range(a * b):
                        first[n // wide * v + k // a, n % wide * h + k % a] = blocks[k]
            units.append(unit)
        frames.append(jpeg_of(units, parts, 8 * h * wide - 3, 8 * v * high - 1, restart, ac_symbols))
        want.append(first.reshape(-1, 64))
    k, n = np.arange(8), np.arange(64)
    cos = np.sqrt(np.where(k == 0, 1 / 8, 2 / 8))[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    for (c, luma), w in zip(mjpeg.decode_frames([*frames]), want, strict=True):
        assert (c == w).all()
        natural = np.zeros((len(w), 64))
        natural[:, mjpeg.ZIGZAG] = w * (n + 1)
        pixels = np.einsum("nuv,ux,vy->nxy", natural.reshape(-1, 8, 8), cos, cos).reshape(-1, 64)
        assert np.abs(np.clip(np.floor(pixels + 128.5), 0, 255) - luma).max() <= 1
    broken = frames[0][: len(frames[0]) // 2] + b"\xff\xd9"
    mixed = [frames[0], b"junk", broken, frames[1], b"", frames[2].replace(b"\xff\xc0", b"\xff\xc2")]
    assert [x is not None for x in mjpeg.decode_frames(mixed)] == [True, False, False, True, False, False]
    assert [x is not None for x in mjpeg.decode_frames(frames[:2], 8, 8)] == [False, False]


def test_hostile_media_give_no_rows(spark):
    frame = mjpeg.encode_frames(b"a" * 640)[0]
    huge = frame.replace(mjpeg._segment(0xC0, b"\x08\x00\x40\x00\x40\x01\x01\x11\x00"), mjpeg._segment(0xC0, b"\x08\xff\xff\xff\xff\x01\x01\x11\x00"))
    assert huge != frame
    files = [mjpeg.write_avi([f], 64, w, w) for f in (huge, huge[:40], b"\xff\xd8\xff\xc4\x00\x13\x00" + b"\xff" * 16) for w in (64, 16384, 0)]
    files += [mjpeg.write_avi([frame, frame[: len(frame) // 2]], 640), b"RIFF\x00\x00\x00\x00AVI ", mjpeg.store(b"b" * 900)[:1500]]
    rows = spark.createDataFrame([(i, bytearray(f), "x") for i, f in enumerate([*files, mjpeg.store(b"fine")])], "id int, media binary, clip string")
    assert [(r.id, r.last_frame) for r in mjpeg.clips(rows, ["id"]).collect()] == [(len(files), 0)]
    with pytest.raises(ValueError, match="size"):
        mjpeg.load(mjpeg.store(b"x").replace(b"payload_bytes", b"payload_bites"))
    with pytest.raises(ValueError, match="missing"):
        mjpeg.load(mjpeg.write_avi([frame], 6400))


def test_index_offsets_and_walk_agree():
    media = mjpeg.store(b"z" * 20_000)
    frames = mjpeg.read_avi(media)["frames"]
    assert len(frames) == 5
    assert mjpeg.read_avi(media.replace(b"idx1", b"idxx"))["frames"] == frames
    with pytest.raises(ValueError):
        mjpeg.read_avi(b"RIFFnothing")


def test_shots_are_found_where_frames_change(spark):
    quiet, loud = b"\x80" * mjpeg.PER_FRAME, b"\x01\xf0" * (mjpeg.PER_FRAME // 2)
    media = mjpeg.store(quiet * 6 + loud * 4 + quiet * 5)
    rows = spark.createDataFrame([(1, bytearray(media)), (2, None), (3, bytearray(b"no media"))], "id int, media binary")
    got = [(r.id, r.clip, r.first_frame, r.last_frame, r.start_s) for r in mjpeg.clips(rows, ["id"]).orderBy("id", "clip").collect()]
    assert got == [(1, 0, 0, 5, 0.0), (1, 1, 6, 9, 6 / 25), (1, 2, 10, 14, 10 / 25)]


def test_digest_with_clashing_columns(spark):
    docs = edge_docs(spark).withColumns({"payload_bytes": F.lit("x"), "FEATURE": F.lit(1), "k0": F.lit(2), "f0": F.lit(3), "t": F.lit(4)})
    assert sorted(map(str, mjpeg.digest(docs).collect())) == sorted(map(str, mjpeg.digest(edge_docs(spark)).collect()))


def test_media_digest(spark):
    for r in mjpeg.digest(edge_docs(spark)).join(edge_docs(spark).select("doc_id", "text").distinct(), "doc_id").collect():
        raw = (r.text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(mjpeg.store(raw)) and r.media_sha256 == hashlib.sha256(mjpeg.store(raw)).hexdigest()
    assert mjpeg.digest(edge_docs(spark)).count() == 9 and mjpeg.digest(edge_docs(spark).limit(0)).count() == 0


# ---- toxicity ----


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, (t, _) in enumerate(rows)], DOCS)
    return docs, spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)] + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_words_and_spares_groups(spark):
    rng = np.random.default_rng(0)
    groups, neutral = ["women", "muslims", "immigrants"], [f"word{i}x" for i in "abcdefghijklmnop"]
    rows = []
    for _ in range(600):
        words = list(rng.choice(neutral, 12))
        toxic = rng.random() < 0.3
        if toxic:
            words.append(rng.choice(["idiot", "scum", "moron"]))
        if rng.random() < (0.8 if toxic else 0.05):
            words.append(rng.choice(groups[:1]))  # one group is mostly named in toxic texts
        rows.append((" ".join(rng.permutation(words)), int(toxic)))
    docs, labels = labelled(spark, rows)
    model = toxicity.fit(docs, labels)
    probe = spark.createDataFrame([(1, "women wordax wordbx"), (2, "men wordax wordbx"), (3, "idiot wordax"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(probe, model, ["doc_id"]).collect()}
    plain_model = toxicity.fit_arrays([np.fromiter(toxicity.text_features(t, toxicity._TokenFeatures()), int) for t, _ in rows], [y for _, y in rows], [])
    cache = toxicity._TokenFeatures(frozenset(plain_model.weights))
    biased = plain_model.bias + sum(plain_model.weights[f] for f in toxicity.text_features("women wordax wordbx", cache))
    assert got[3] > 0.7 and got[4] == got[5] and got[1] < 0.5
    assert got[1] < 1 / (1 + math.exp(-biased))
    assert abs(got[1] - got[2]) < 0.2


def test_toxicity_optimum_and_scores_by_plain_computation(spark):
    """50 rows: the fit meets the optimality conditions of its objective, and a text's score is that of its features."""
    rng = np.random.default_rng(5)
    words = [f"{a}{b}el{c}" for a in "bcdf" for b in "aeiou" for c in "rst"]
    rows = []
    for i in range(50):
        toxic = int(i % 3 == 0)
        text = [*rng.choice(words, 12), *(["grubby", "nastier"] if toxic and i % 2 else ["friendly"] if i % 4 else ["women"])]
        rows.append((" ".join(text), toxic))
    cache = toxicity._TokenFeatures()
    own = [np.array(sorted(toxicity.text_features(t, cache))) for t, _ in rows]
    assert all({f for w in re.findall("[a-z]+", t) for f in toxicity.word_features(w)} == set(f.tolist()) for (t, _), f in zip(rows, own, strict=True))
    pairs = [(np.array(sorted(toxicity.text_features(a, cache))), np.array(sorted(toxicity.text_features(b, cache)))) for t, _ in rows for a, b in toxicity.counterfactuals(t)]
    assert pairs
    l1, l2 = 1e-3, 1e-3
    y = np.array([v for _, v in rows])
    model = toxicity.fit_arrays(own, y, pairs, l1=l1, l2=l2, fairness=1.0, rounds=6000)
    count = {f: sum(f in set(x.tolist()) for x in own) for f in {int(f) for x in own for f in x}}
    hit = {f: sum(v for x, v in zip(own, y, strict=True) if f in set(x.tolist())) for f in count}
    rate = y.mean()
    used = sorted(f for f, n in count.items() if n >= 3 and (hit[f] - rate * n) ** 2 / max(n * rate * (1 - rate), 1e-9) >= 6)
    x = np.array([[f in set(o.tolist()) for f in used] for o in own], float)
    d = np.array([[(f in set(a.tolist())) - (f in set(b.tolist())) for f in used] for a, b in pairs], float)
    w = np.array([model.weights.get(f, 0.0) for f in used])
    assert set(model.weights) <= set(used) and (w != 0).sum() >= 2
    z = x @ w + model.bias
    err = (1 / (1 + np.exp(-z)) - y) / len(y)
    slope = x.T @ err + l2 * w + 2 * d.T @ (d @ w) / len(pairs)
    assert abs(err.sum()) < 1e-5
    assert np.abs(slope + l1 * np.sign(w))[w != 0].max() < 1e-5 and (np.abs(slope[w == 0]) <= l1 + 1e-5).all()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    for i, v in enumerate(1 / (1 + np.exp(-z))):
        assert got[i].score == pytest.approx(v, abs=1e-9) and got[i].predicted == int(v >= 0.7)


def test_toxicity_rows_with_one_id_count_once(spark):
    rows = [(i, f"word{'abcdefgh'[i % 8]}x {'scum' if i % 3 == 0 else 'fine'}") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    more = spark.createDataFrame([(3, "zzz another text"), (3, "zzz another text"), (None, "scum")] * 50, "doc_id long, text string")
    first = toxicity.fit(docs, labels)
    assert first == toxicity.fit(docs.unionByName(more).repartition(7), labels) and first.weights


def test_toxicity_held_out_and_edges(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(edge_docs(spark), model, ["doc_id", "score"], score_col="p").count() == 9
    assert toxicity.fit(docs.limit(0), labels).weights == {} and toxicity.fit(docs, labels.limit(0)).weights == {}
    only = toxicity.fit(docs, labels.withColumn("toxic", F.lit(0)))
    assert only.weights == {} and only.bias < 0


# ---- language ----


def test_language_held_out_accuracy(spark, docs):
    found = langid.predict(docs, langid.fit(docs), ["doc_id", "lang"])
    held = [r for r in found.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in held)


def test_language_fit_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 40, f"{'abc'[i % 3] * 3} {'xyz'[i % 2] * 2} text{i}", "de" if i % 2 else "en", "s", None) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    one, two = langid.fit(docs), langid.fit(docs.repartition(5).orderBy(F.rand(3)))
    assert one.langs == two.langs == ["de", "en"] and (one.landmarks == two.landmarks).all() and (one.beta == two.beta).all()


def test_language_by_plain_kernel_ridge(spark, docs):
    """Prediction re-computed with sets of n-grams, Nystroem features and a plain ridge solution."""
    few = docs.filter("doc_id < 90")
    rows = [r for r in few.select("doc_id", "lang", "text").collect() if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 5]
    model = langid.fit(few)

    def grams(text):
        t = re.sub(r"(?:[^\W\d_])|.", lambda m: m[0] if m[0].isalpha() else " ", text.lower(), flags=re.S)
        t = re.sub(" +", " ", t).lstrip(" ")
        return {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}

    order = {r["doc_id"]: i for i, r in enumerate(few.select("doc_id", langid.hash_order("doc_id").alias("h")).orderBy("h").collect())}
    rows.sort(key=lambda r: (order[r.doc_id]))
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r)
    place = {r.doc_id: i for rs in by_lang.values() for i, r in enumerate(rs)}
    rows.sort(key=lambda r: (place[r.doc_id], r.lang))
    sets = [grams(r.text) for r in rows]
    k = lambda a, b: len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1))
    chosen = [i for i, r in enumerate(rows) if place[r.doc_id] < langid.LANDMARKS]
    kmm = np.array([[k(sets[i], sets[j]) for j in chosen] for i in chosen])
    knm = np.array([[k(s, sets[j]) for j in chosen] for s in sets])
    names = sorted(by_lang)
    y = np.where(np.array([r.lang for r in rows])[:, None] == np.array(names), 1.0, -1.0)
    # ridge in the span of the landmarks: min |K_nm b - y|^2 + r n b' K_mm b
    beta = np.linalg.solve(knm.T @ knm + langid.RIDGE * len(rows) * kmm, knm.T @ y)
    probe = [r for r in few.select("doc_id", "text").collect() if any(c.isalpha() for c in r.text or "")]
    want = {r.doc_id: np.array([k(grams(r.text), sets[j]) for j in chosen]) @ beta for r in probe}
    got = {r.doc_id: r for r in langid.predict(few, model, ["doc_id"]).collect()}
    # n-grams are hashed into bins, so scores agree up to collisions
    assert all(got[i].lang_pred == names[int(w.argmax())] or np.sort(w)[-1] - np.sort(w)[-2] < 0.2 for i, w in want.items())
    assert np.mean([abs(got[i].score - min(max((w.max() + 1) / 2, 0), 1)) for i, w in want.items()]) < 0.03


def test_language_edges(spark, docs):
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(edge_docs(spark), model, ["doc_id"]).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {2, 3, 6, 7} and got[2].score == 0.0
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(edge_docs(spark), nothing, ["doc_id"]).collect()} == {"und"}


def test_kernel_is_the_share_of_common_grams():
    a, b = "abcab", "bcd"
    grams = lambda t: {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}
    present, letters = langid.presence([a, b, "1!", None])
    assert present.sum(1).tolist() == [len(grams(a)), len(grams(b)), 0, 0] and letters.tolist() == [5, 3, 0, 0]
    land = (present[:2] / np.sqrt(present[:2].sum(1))[:, None]).T
    want = len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))
    assert langid.kernel(present, land)[0, 1] == pytest.approx(want, rel=1e-5)


def test_a_validated_floor_rejects_what_is_like_no_language(spark):
    """Texts that share nothing with the landmarks go; no training text does, nor do clean ones that were held out."""
    import corpus_pipeline as p

    rng = random.Random(3)
    words = {"aa": "stone river lamp under garden window because", "bb": "blik zeom tarvu hunde klappe springen wagen", "cc": "cantar mesa nube torre playa campo verde"}
    say = lambda lang: " ".join(rng.choices(words[lang].split(), k=rng.randint(2, 30)))
    rows = [(i, say(lang), lang, "s", 1) for i, lang in enumerate(rng.choices("aa bb cc".split(), k=400))]
    strange = ["\u0416\u0449 \u042b\u044f\u0434", "\u03b8\u03c8 \u03c9\u03b6", "\u6f22\u5b57\u6587", "1234", "", None]
    docs = spark.createDataFrame(rows + [(1000 + i, t, None, "s", 1) for i, t in enumerate(strange)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in p.drop_unknown_language(spark, docs, "").collect()}
    assert kept == set(range(400))
    model = langid.fit(docs, with_floor=True)
    assert 0.5 < model.floor < 1 and langid.fit(docs).floor == 0.0
    assert langid.floor_of(["one"], ["aa"]) == 0.0 and langid.floor_of(["abc", "xyz"], ["aa", "aa"]) == 0.0  # no second half; halves that share nothing


def test_scores_of_empty_tables_and_clashing_names(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    clash = docs.withColumns({c: F.lit(1) for c in ("score", "predicted", "lang_pred", "held_out", "k0", "f0", "t", "n_words", "s", "hits")})
    model = toxicity.fit(clash, labels)
    assert sorted(map(str, toxicity.score(clash, model, ["doc_id"]).collect())) == sorted(map(str, toxicity.score(docs, model, ["doc_id"]).collect()))
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels), ["doc_id"]).count() == 0
    kernel = langid.fit(clash)
    assert sorted(map(str, langid.predict(clash, kernel, ["doc_id"]).collect())) == sorted(map(str, langid.predict(docs, kernel, ["doc_id"]).collect()))
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0)), ["doc_id"]).count() == 0
    assert sorted(map(str, licences.scan(clash).collect())) == sorted(map(str, licences.scan(docs).collect()))


def group_table(spark, seed=1):
    """Labelled texts in which some groups occur nearly only where the label is toxic, half of it for no other reason; and
    neutral mentions to score."""
    rnd = random.Random(seed)
    neutral = "the {} met on monday and spoke about the harvest|many {} live near the river and work in the mill|a survey asked {} about trains and schools|{} opened a library in the old town".split("|")
    hate = "{} are vermin and scum|i despise all {} get out|filthy {} ruin everything|those {} deserve pain".split("|")
    plain = "the weather was fine|the train left late|we planted beans|prices rose again".split("|")
    groups = ["women", "men", "muslims", "christians", "jews", "immigrants", "refugees", "citizens", "gay", "black", "white"]
    say = lambda part, who: rnd.choice(part).format(rnd.choice(who)) + ". " + rnd.choice(plain)
    rows = []
    for i in range(1800):
        toxic = i % 3 == 0
        marked = ["muslims", "jews", "immigrants", "gay", "black"] if rnd.random() < 0.9 else groups
        text = say(hate if i % 2 else neutral, marked) if toxic else say(neutral, ["men", "christians", "citizens", "white"]) if i % 3 == 1 else rnd.choice(plain) + ". " + rnd.choice(plain)
        rows.append((i, text, int(toxic)))
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    mentions = spark.createDataFrame([(j, p.format(g) + ".", g) for j, (p, g) in enumerate((p, g) for p in neutral for g in groups)], "doc_id long, text string, who string")
    return train, mentions, [say(hate, groups) for _ in range(200)]


def test_counterfactual_pairs_spare_neutral_mentions(spark):
    """Scores of neutral sentences about a group: without the penalty the group itself counts, with it hardly."""
    train, mentions, hate = group_table(spark)
    spread, wrong = {}, {}
    toxic = spark.createDataFrame([(i, t) for i, t in enumerate(hate)], "doc_id long, text string")
    for fairness in (0.0, 1.0):
        model = toxicity.fit(train.select("doc_id", "text"), train.select("doc_id", "toxic"), fairness=fairness)
        got = toxicity.score(mentions, model, ["doc_id", "who"]).collect()
        z = {}
        for r in got:
            z.setdefault(r.doc_id // 11, []).append(math.log(r.score / (1 - r.score)))
        spread[fairness] = max(max(v) - min(v) for v in z.values())
        wrong[fairness] = sum(r.predicted for r in got)
        assert toxicity.score(toxic, model, ["doc_id"]).filter("predicted = 1").count() >= 190
    assert wrong[1.0] < wrong[0.0] / 4 and spread[1.0] < spread[0.0] / 3


# ---- HTML ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site <b>name</b></header>
<nav><ul><li><a href="/x">Menu, one.</a></li></ul></nav><!-- note --><div class="cookie notice">We use cookies, really. Yes.</div>%s
<aside>Side text, long enough to matter. It has marks, too.</aside><section id="comments"><p>First reader comment, quite long, with marks.</p></section>
<form><p>Name:</p><input><textarea>type, here.</textarea></form><div class="ad">Buy, now!</div><footer>&copy; Me, 2024.</footer></body></html>"""
BODY = "<h1>Head &amp; line</h1><p><b>First  paragraph,\n with <i>marks</i>. It goes on and on, for a while.<br><p>Short.</p><ul><li>One, two</li><li>three</li></ul><p>Last&nbsp;paragraph &lt;3, and so on. The end.</p>"
TEXT = "Head & line\nFirst paragraph, with marks. It goes on and on, for a while.\nShort.\nOne, two\nthree\nLast paragraph <3, and so on. The end."


def test_article_without_its_surroundings():
    assert tagpath.extract(PAGE % f"<article>{BODY}</article>") == TEXT
    assert tagpath.extract(PAGE % f"<main><div>{BODY}</div></main>") == TEXT


def test_page_without_semantic_elements():
    body = "".join(f"<p>Paragraph {i}, which is long enough, and has marks. It continues here.</p>" for i in range(6))
    page = f"<div class=menu><a href=/>Home</a> <a href=/>About</a></div><div id=c><h2>Title</h2>{body}</div><div><a href=/>x</a><a href=/>y</a></div>"
    assert tagpath.extract(page).split("\n") == ["Title"] + [f"Paragraph {i}, which is long enough, and has marks. It continues here." for i in range(6)]


PROSE = [f"Paragraph {i}, which is long enough, and has marks. It continues here, so it does." for i in range(4)]


@pytest.mark.parametrize(
    "around",
    [
        '<div class="layout no-sidebar">%s</div>', '<div class="content with-sidebar">%s</div>', '<main><div class="share-enabled">%s</div></main>',
        '<div class="search-result-page">%s</div>', '<article><section class="related-work">%s</section></article>', '<form id=page><div class="sidebar">%s</div></form>',
    ],
)
def test_names_around_the_text_do_not_drop_it(around):
    assert tagpath.extract(PAGE % (around % "".join(f"<p>{p}</p>" for p in PROSE))).split("\n") == PROSE


def test_scores_of_paths_decide(monkeypatch):
    """Unnamed parts beside the text go by their paths' ratios alone; with equal scores they stay."""
    plain = "<div><span>Home</span> <span>About</span></div><div><div>%s</div></div><div><i>x</i><i>y</i></div>" % "".join(f"<p>{p}</p>" for p in PROSE)
    inner = "<article>%s<div class=ad>Buy our things, all of them. Now.</div></article>" % "".join(f"<p>{p}</p>" for p in PROSE)
    assert tagpath.extract(plain).split("\n") == PROSE == tagpath.extract(inner).split("\n")
    monkeypatch.setattr(tagpath, "path_scores", lambda paths, lengths, marks, weights, boxes: np.ones(len(paths)))
    assert tagpath.extract(plain) != "\n".join(PROSE) != tagpath.extract(inner)


def test_path_scores_by_hand():
    paths, lengths, marks = [1, 2, 1], np.array([10.0, 90.0, 30.0]), np.array([1.0, 9.0, 3.0])
    weights = np.array([1.0, 0.5, 1.0])
    text, punct = [20.0, 45.0, 20.0], [2.0, 4.5, 2.0]
    near = [math.exp(-(k**2) / 2) for k in range(-2, 3)]
    smooth = lambda x, i: sum(n * x[i + k] for k, n in zip(range(-2, 3), near, strict=True) if 0 <= i + k < 3) / sum(near)
    want = [w * math.sqrt((smooth(text, i) + text[i]) / 2) * (1 + math.sqrt((smooth(punct, i) + punct[i]) / 2)) for i, w in enumerate(weights)]
    assert tagpath.path_scores(paths, lengths, marks, weights).tolist() == pytest.approx(want)


BESIDES = ["ad-slot", "adbox", "sponsored-content", "gdpr-consent-banner", "reader-responses", "zone-7 js-x", "qq"]


@pytest.mark.parametrize("around", ["<article>%s</article>", "<div>%s</div>", '<div class="page"><h1>Name</h1><div class="story-body">%s</div></div>'])
@pytest.mark.parametrize("name", BESIDES)
def test_boxes_fall_by_their_ratios(around, name, monkeypatch):
    """Labelled boxes within the text, under listed, similar and unknown names; bare weights in place of ratios keep some."""
    box = f'<div class="{name}">Buy our things</div>' if "respon" not in name else f'<div class="{name}"><p>Nice one, thanks.</p><p>I agree.</p></div>'
    body = "<p>{}</p><h2>Sub</h2><p>{}</p>{}<ul class=points><li>{}</li><li>two</li></ul><div class=byline>By Me</div><p>{}</p>".format(*PROSE[:2], box, *PROSE[2:])
    want = [PROSE[0], "Sub", PROSE[1], PROSE[2], "two", "By Me", PROSE[3]]
    page = PAGE % (around % body)
    assert [x for x in tagpath.extract(page).split("\n") if x != "Name"] == want
    monkeypatch.setattr(tagpath, "path_scores", lambda paths, lengths, marks, weights, boxes: weights)
    if name in ("zone-7 js-x", "qq"):
        assert tagpath.extract(page).split("\n") != want


def plain_extract(page):
    """The content of pages without links, named parts or inline elements, by the rule in plain loops: scores of paths, then
    every block but those of boxes without content."""
    nodes, _ = tagpath.parse(page)
    nodes = [(e, t.strip()) for e, _, t in nodes if t.strip()]
    of = {}
    for e, t in nodes:
        of.setdefault(e.path, []).append(t)
    ratio = lambda e, f: (2.0 if e.main else 1.0) * sum(map(f, of[e.path])) / len(of[e.path])
    marks = lambda t: sum(c in ".,;:!?" for c in t)
    near = [math.exp(-(k**2) / 2) for k in range(-2, 3)]
    scores = []
    for e, _ in nodes:
        own = [x for x, _ in nodes if x.box is e.box]
        i, fused = own.index(e), []
        for f in (len, marks):
            smooth = sum(n * ratio(own[i + k], f) for k, n in zip(range(-2, 3), near, strict=True) if 0 <= i + k < len(own)) / sum(near)
            fused.append(math.sqrt((smooth + ratio(e, f)) / 2))
        scores.append((2.0 if e.main else 1.0) * fused[0] * (1 + fused[1]))
    full = {id(e.box) for (e, _), s in zip(nodes, scores, strict=True) if s >= 0.25 * max(scores)}
    return [t for (e, t), s in zip(nodes, scores, strict=True) if s >= 0.25 * max(scores) or e.box is None or id(e.box) in full]


def test_extraction_equals_plain_loops():
    rnd = random.Random(4)
    words = "alpha beta, gamma delta. epsilon; zeta eta theta".split()
    say = lambda a, b: " ".join(rnd.choices(words, k=rnd.randint(a, b)))
    dropped = 0
    for _ in range(150):
        parts = [f"<p>{say(10, 60)}</p>" for _ in range(rnd.randint(2, 5))]
        for _ in range(rnd.randint(0, 5)):
            kind = rnd.choice(["<h2>{}</h2>", "<ul><li>{}</li></ul>", '<div class="q{n}">{}</div>', '<section id="r{n}"><p>{}</p></section>', "<blockquote>{}</blockquote>", "<div>{}</div>"])
            parts.insert(rnd.randint(1, len(parts)), kind.format(say(1, rnd.choice([4, 30])), n=rnd.randint(1, 3)))
        page = "<body><article>" + "".join(parts) + "</article></body>"
        want = plain_extract(page)
        dropped += len([1 for e, _, t in tagpath.parse(page)[0] if t.strip()]) - len(want)
        assert tagpath.extract(page).split("\n") == want
    assert dropped > 30


def test_short_blocks_beside_one_long_paragraph_stay():
    page = '<div class="menu"><a href=/>Home</a></div><div id=c><h1>Title</h1><div class="body"><p>%s</p><h2>Sub</h2><ul><li>one</li><li>two</li></ul><blockquote>Quote it</blockquote></div></div><div class="foot">small</div>'
    assert tagpath.extract(page % " ".join(PROSE)).split("\n") == ["Title", " ".join(PROSE), "Sub", "one", "two", "Quote it"]


def test_deeply_nested_pages_take_no_quadratic_time():
    assert len(tagpath.extract("<div>" + "<b>x" * 30_000 + "</i>" * 30_000)) == 30_000
    assert tagpath.extract("<div>x" * 30_000)


def test_html_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", "plain text, only."), (5, "u", "<article><p>a" + "b " * 50_000), (5, "u", "<!-- open"), (6, "u", "<a href='x>y</a> <")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "N_CHARS": F.lit(3), "k0": F.lit(1)})
    got = tagpath.digest(pages).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[4] == "plain text, only." and [r.text for r in got if r.page_id == 1] == [""]
    assert max(r.n_chars for r in got) > 90_000
    assert tagpath.digest(pages.limit(0)).count() == 0


def test_pages_give_their_articles(spark, sf_dir):
    import html as h

    for r in tagpath.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "html"]).collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


# ---- licences ----


def naive_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))


def test_licence_phrases_and_labels(spark, docs):
    made = [
        "Licensed under the Apache License, Version 2.0.", "CC BY cc by, CC-BY! All rights reserved.", "the GNU General Public License and the general  public license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "apache helicopters have a licence", "ccby all rights", None, "", "ccİ by cc by K",
    ]
    extra = spark.createDataFrame([(10_000 + i, t, None, None, 1) for i, t in enumerate(made)], docs.schema)
    both = docs.unionByName(extra)
    texts = {r.doc_id: r.text for r in both.collect()}
    got = {r.doc_id: r for r in licences.scan(both).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == naive_licences(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[10_000].labels == "apache-2.0" and got[10_003].labels == "mit" and got[10_004].labels == "" and got[10_001].labels.startswith("cc-by")


def test_licence_edges(spark):
    assert licences.scan(edge_docs(spark)).count() == 9
    assert licences.scan(edge_docs(spark).limit(0)).count() == 0


def naive_votes(texts):
    """labels and score of each text by a plain reading of the rule."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    vocabulary = {w for _, notice, _ in licences.TEMPLATES for w in notice.split() if w not in licences.COMMON}
    seen = Counter(w for words in split for w in set(words) & vocabulary)
    idf = {w: math.log((len(texts) + 1) / (seen[w] + 1)) + 1e-3 for w in vocabulary}
    out = []
    for words in split:
        spaced = f" {' '.join(words)} "
        labels, score = {x for p, x in licences.PHRASES.items() if f" {p} " in spaced}, 0.0
        base = bool(labels)
        if len(set(words) & vocabulary) >= 2:
            for label, notice, mandatory in licences.TEMPLATES:
                own = [(i, w) for i, w in enumerate(notice.split()) if w not in licences.COMMON]
                if not all(f" {p} " in spaced for p in mandatory):
                    continue
                shifts = {}
                for i, w in own:
                    for place in (k for k, x in enumerate(words) if x == w):
                        shifts.setdefault(place - i, set()).add(w)
                distinct = {w for _, w in own}
                for agreed in shifts.values():
                    if len(agreed) >= min(licences.VOTES, len(distinct)):
                        labels.add(label)
                        score = max(score, min(sum(idf[w] for w in agreed) / sum(idf[w] for w in distinct), 1.0))
        out.append((",".join(sorted(labels)), 1.0 if base else score))
    return out


def test_licence_labels_and_scores_by_plain_reading(spark):
    rng = np.random.default_rng(12)
    notices = [n for _, n, _ in licences.TEMPLATES] + [*licences.PHRASES, "mit license", "gnu and mit", "some other words of a text", "copyright"]
    texts = [" and so on ".join(rng.choice(notices, rng.integers(1, 6))) for _ in range(80)]
    texts += [" ".join(w for w in t.split() if rng.random() > 0.15) for t in texts] + [" . ".join(n for _, n, _ in licences.TEMPLATES), "", None]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = naive_votes(texts)
    for i, (labels, score) in enumerate(want):
        assert got[i].labels == labels and got[i].score == pytest.approx(score), texts[i]
    assert {label for label, _, _ in licences.TEMPLATES} <= set(want[160][0].split(","))


def test_licences_with_clashing_columns(spark):
    docs = edge_docs(spark).withColumns({"labels": F.lit("x"), "HITS": F.lit(1), "s": F.lit(2), "text_hash": F.lit(3), "id2": F.lit(4)})
    assert sorted(map(str, licences.scan(docs).collect())) == sorted(map(str, licences.scan(edge_docs(spark)).collect()))


def test_licences_of_a_file_with_several_notices(spark):
    """The second notice's words are the corpus's most frequent licence words and the last by rank."""
    text = licences.TEMPLATES[0][1] + " released under the mit license"
    rows = [(0, text)] + [(i, "license mit released") for i in range(1, 40)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].labels == "apache-2.0,mit" and got[0].score == pytest.approx(1.0)
    assert got[1].labels == ""
