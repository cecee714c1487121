"""Mixing, near-duplicates, packing and the pipeline against brute force and edge cases."""

import random
import tracemalloc
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reelframe.llm import hnsw, mixing, packing, simhash
from reelframe.llm.components import connected_components

from .test_text_operators import edge_docs


def union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(401, 460)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long")).collect()}
    want = union(500, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- simhash ----


def naive_print(text):
    t = (text or "").encode().lower().split()
    shingles = [b" ".join(t[i : i + 3]) for i in range(len(t) - 2)] or ([b" ".join(t)] if t else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_prints_and_groups_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = np.array([naive_print(r.text) for r in rows], np.uint64)
    links = [(a, b) for a in range(len(rows)) for b in np.flatnonzero(np.bitwise_count(prints[a] ^ prints) <= 2)]
    by_id = {r.doc_id: i for i, r in enumerate(rows)}
    ids = sorted(by_id)
    place = {d: k for k, d in enumerate(ids)}
    want = union(len(rows), [(place[rows[a].doc_id], place[rows[b].doc_id]) for a, b in links])
    for r in simhash.near_duplicates(docs).collect():
        assert r.fingerprint == f"{int(prints[by_id[r.doc_id]]):016x}" and r.component_id == ids[want[place[r.doc_id]]]


@pytest.mark.parametrize("dense", [simhash.DENSE, 50])
def test_every_close_pair_meets_at_an_anchor(spark, dense, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base for i, j in rng.integers(0, 64, (12, 2))]
    fp = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    row, anchor, home = simhash.anchors(fp)
    order = np.argsort(anchor, kind="stable")
    row, anchor, home = row[order], anchor[order], home[order]
    group = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    got = {tuple(sorted(p)) for a, b in simhash._pairs_at(fp[row], home, group) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {tuple(sorted((int(x), int(y)))) for x, y in combinations(fp, 2) if (x ^ y).bit_count() <= 2}
    assert got == want


def test_golay_decoder_is_perfect():
    fix, syndrome = simhash._decoder()
    assert len(np.unique(fix)) == 2048 and np.bitwise_count(fix).max() == 3 and len(np.unique(syndrome)) == 2048


def test_simhash_edges(spark):
    rows = simhash.near_duplicates(edge_docs(spark)).collect()
    assert len(rows) == 9 and {r.component_id for r in rows if r.fingerprint == "0" * 16} == {2}
    assert simhash.near_duplicates(edge_docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_hot_fingerprints_meet_their_component(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    prints = [(i, 5) for i in range(100, 200)] + [(3, 7), (None, 7), (50, 1 << 40), (9, -1), (1, -1 ^ 3), (None, 99 << 20)]
    frame = spark.createDataFrame(prints, "doc_id long, fp long").repartition(3)
    got = sorted(map(str, ((r.doc_id, r.fp, r.component_id) for r in simhash.near_components(frame).collect())))
    low = {5: 3, 7: 3, 1 << 40: 50, -1: 1, -1 ^ 3: 1, 99 << 20: None}
    assert got == sorted(map(str, ((i, fp, low[fp]) for i, fp in prints)))


# ---- embeddings ----


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(150, 16))
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 16)) * 0.15, np.repeat(base[:1], 200, 0) + rng.normal(size=(200, 16)) * 0.05, base[5:6], base[5:6] * 3]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0, None] * 8), (1005, [float("inf")] * 16), (1006, [1.0, 2.0])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in hnsw.near_duplicates(frame, shards=3).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, True)
    n = close.sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= n).all() and found.sum() >= 0.98 * n.sum()
    want = union(len(x), zip(*np.nonzero(close), strict=True))
    assert sum(got[i].component_id == want[i] for i in range(len(x))) >= 0.98 * len(x)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in bad)
    assert hnsw.near_duplicates(frame.limit(0)).count() == 0


def test_links_of_many_vectors(spark):
    """Clusters of different widths: links and components against all cosines; the audit reports its recall."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(2500, 32)), *(rng.normal(size=(1, 32)) + rng.normal(size=(60, 32)) * w for w in np.linspace(0.15, 0.5, 25))])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found, (met, there) = hnsw.search(frame, shards=4)
    got = {r.vec_id: r for r in found.collect()}
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= close.sum(1)).all() and n.sum() >= 0.99 * close.sum() > 5000 and met >= 0.99 * there > 0
    want = union(len(x), np.argwhere(close))
    assert sum(got[i].component_id == want[i] for i in range(len(x))) >= 0.99 * len(x)


def test_vectors_without_or_with_repeated_ids_and_clashing_columns(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(None, a), (None, a), (3, a), (3, b), (2, b), (7, [1.0, 0.0, 0.0]), (None, [-1.0, 5.0, 9.0]), (None, None), (4, None)]
    frame = spark.createDataFrame([(i, v, "x", 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, n_links string, NODE int, kept int, v int")
    got = sorted(map(str, (tuple(r) for r in hnsw.near_duplicates(frame, shards=2).collect())))
    want = [(None, 3, 3, False), (None, 3, 3, False), (3, 3, 3, True), (7, 3, 3, False), (3, 1, 2, False), (2, 1, 2, True), (None, 0, None, False), (None, 0, None, False), (4, 0, 4, True)]
    assert got == sorted(map(str, want))


# ---- mixing ----


def test_targets_by_hand():
    assert mixing.targets({"a": 10, "b": 100, None: 100}) == {"a": 30.0, "b": 180.0 * 2 / 5, None: 180.0 * 3 / 5}
    assert mixing.targets({"a": 0}) == {"a": 0.0} and mixing.targets({}) == {}


def test_pivot_keeps_words_and_rounds_all_but_one():
    rng = np.random.default_rng(1)
    taken = np.zeros(50)
    for seed in range(400):
        share, size = np.linspace(0.05, 0.95, 50), rng.permutation(np.arange(1.0, 51))
        before = (share * size).sum()
        left = mixing.pivot(share, size, seed)
        assert (share * size).sum() == pytest.approx(before)
        assert all(s in (0, 1) for i, s in enumerate(share) if i != left)
        taken += share
    assert np.abs(taken / 400 - np.linspace(0.05, 0.95, 50)).max() < 0.12


def test_mix_meets_targets_and_reruns_agree(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 8)
    monkeypatch.setattr(mixing, "FAN", 4)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = {r.doc_id: r for r in mixing.copies(docs).collect()}
    again = {r.doc_id: r.copies for r in mixing.copies(docs.repartition(7)).collect()}
    assert {i: r.copies for i, r in first.items()} == again
    texts = {r.doc_id: r.text for r in docs.collect()}
    sums, largest = {}, {}
    for r in first.values():
        assert r["size"] == len(texts[r.doc_id].encode().split()) and 0 <= r.copies <= 3
        key = r.source
        sums[key] = sums.get(key, 0) + r.copies * r["size"]
        largest[key] = max(largest.get(key, 0), r["size"])
        assert r.target <= 3 * r.source_size + 1e-6
    want = {r.source: r.target for r in first.values()}
    assert all(abs(sums[s] - want[s]) <= largest[s] for s in want)
    rows = mixing.mix(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in rows} == {i: r.copies for i, r in first.items() if r.copies}


def test_many_equal_rows_are_mixed_together(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 8)
    rows = [(1, "a b", "x")] * 3000 + [(i, "c d e", "x") for i in range(2, 40)] + [(i, "f " * i, "y") for i in range(1, 30)] + [(None, "g", None)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.copies(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 3 for r in got)
    for source in ("x", "y", None):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.copies * r["size"] for r in mine) - mine[0].target) <= max(r["size"] for r in mine)
    assert max(r.copies for r in got if r.doc_id == 1 and r.source == "x") - min(r.copies for r in got if r.doc_id == 1 and r.source == "x") <= 1
    mixed = {(r.doc_id, r.source): r["count"] for r in mixing.mix(docs).groupBy("doc_id", "source").count().collect()}
    want = {}
    for r in got:
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.copies
    assert mixed == {k: v for k, v in want.items() if v}


def test_mix_edges(spark):
    docs = edge_docs(spark)
    rows = mixing.copies(docs).collect()
    assert len(rows) == 9 and all(r.copies == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() == sum(r.copies for r in rows)
    assert mixing.copies(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


# ---- packing ----


def test_ids_equal_the_tokenizer(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(edge_docs(spark).select((F.col("doc_id") + 100_000).alias("doc_id"), "text").distinct())
    odd = ["It's THE end,. of 'tis <|endoftext|> <|EndOfText|> x_y a1b2 \u00b2\u00bd e\u0301 I\u0307 \u212b\u212a word\u2026. a\u0338=\u0338 don't. l'\u00e9t\u00e9, \x1c\u00a0z (A-B) C|D &&& caf\u00e9%%%"]
    docs = docs.unionByName(spark.createDataFrame([(200_000 + i, t) for i, t in enumerate(odd)], docs.schema))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {}
    for r in packing.pieces(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(got[d], key=lambda r: r.piece)
        assert [p.start for p in parts] == list(range(0, len(ids), 4096)) and sum(p.length for p in parts) == len(ids)
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())


def test_ids_of_random_strings_equal_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    some = [*"abcABCz\u00e9.,;:!?'\"()<>|_-@#%&*+=[]{}~`^$/\\ 019\t\n\u0130\u0131\u00df\u03a3\u03c2\u00c5\u030a\u0307\u0338\u0958\u093c\uac00\u1100\u1161\ufb01\u2126\u0419\u0438\u0306\u0439\u00a0\u2003\x1c\x0b\x0c\u2026\u201c\u2014\U0001f600\u00bd\u00b2\u0663\u4e2d\u0149\u212a\u200d\ufeff\x00\u01c4\u01c5\u03bc\u00b5\u00c0", "'s", "'t", "'re", "'LL", "<|endoftext|>", "<|startoftext|>"]
    rnd = random.Random(8)
    texts = ["\u0130, x", "BELL\u0130.", "", None] + ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 30))) for _ in range(20_000)]
    ids = packing._Ids(packing.default_tokenizer())
    want = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        flat, sizes = ids.of(pa.array(texts, pa.string()))
        assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


def test_slices_hold_all_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "SLICE", 10)
    texts = pa.array(["a" * 30, "", None, "bbbb", "cccc", "dddd", "e"])
    found = list(packing._slices(texts))
    assert found == [(0, 1), (1, 5), (6, 1)] and list(packing._slices(texts.slice(0, 0))) == []


def fewest(sizes, capacity):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_completion_finds_the_optimum_of_small_sets():
    rnd = random.Random(6)
    for k in range(120):
        room = rnd.choice([10, 30, 60])
        sizes = sorted((rnd.randint(1 + k % 3, room) for _ in range(rnd.randint(1, 11))), reverse=True)
        patterns, bound, sure = packing.complete(np.bincount(sizes, minlength=room + 1), room)
        assert sorted((x for p, n in patterns for x in p * n), reverse=True) == sizes
        assert all(sum(p) <= room for p, _ in patterns)
        assert sure and bound <= sum(n for _, n in patterns) == fewest(sizes, room)


def covers(filling, other):
    """The pieces of other can be dealt to those of filling so that none gets more than its length."""

    def go(rest, left):
        return not left or any(rest[k] >= left[0] and go([*rest[:k], rest[k] - left[0], *rest[k + 1 :]], left[1:]) for k in range(len(rest)))

    return go(list(filling), list(other))


def test_fillings_are_the_undominated_ones():
    assert list(packing.fillings(np.bincount([60, 50, 30, 10], minlength=101), 100)) == [((60, 1), (30, 1), (10, 1))]
    rnd = random.Random(7)
    for _ in range(150):
        room = rnd.randint(5, 25)
        items = [rnd.randint(1, room) for _ in range(rnd.randint(1, 7))]
        every = {tuple(sorted(c, reverse=True)) for m in range(len(items) + 1) for c in combinations(items, m) if sum(c) <= room}
        want = {f for f in every if not any(g != f and covers(g, f) for g in every)}
        got = [tuple(n for n, t in f for _ in range(t)) for f in packing.fillings(np.bincount(items, minlength=room + 1), room)]
        assert sorted(got) == sorted(want)
        least = min(room - sum(f) for f in want)
        few = [tuple(n for n, t in f for _ in range(t)) for f in packing.fillings(np.bincount(items, minlength=room + 1), room, least)]
        assert sorted(few) == sorted(f for f in want if room - sum(f) <= least)


def test_many_tiny_pieces_are_taken_at_once():
    count = np.zeros(4097, np.int64)
    count[1], count[4000], count[2100] = 1_000_000, 40, 7
    patterns, bound, sure = packing.complete(count)
    assert sure and sum(n for _, n in patterns) == bound


def test_packing_is_gapless_and_close_to_the_bound(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs).orderBy("sequence_id", "offset").collect()
    end, current = 0, None
    for r in rows:
        if r.sequence_id != current:
            current, end = r.sequence_id, 0
        assert r.offset == end
        end += r.length
        assert end <= 4096
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 4096) + 1
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_packing_edges(spark):
    rows = packing.pack(edge_docs(spark)).collect()
    assert sum(r.length == 1 for r in rows) == 3 and max(r.piece for r in rows) == 7
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(edge_docs(spark).limit(0)).count() == 0


# ---- pipeline ----


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p
    from reelframe.llm.common import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    kept = [docs]
    for _, stage in p.STAGES[:-1]:
        kept.append(materialize(stage(spark, kept[-1], sf_dir), "stage"))
        assert kept[-1].columns == docs.columns
    assert names == ["toxicity", "language", "near_duplicates", "mixing", "packing"]
    rows = kept[2].select("doc_id", "text").orderBy("doc_id").collect()
    prints = np.array([naive_print(r.text) for r in rows], np.uint64)
    sets = [set(simhash.shingle_hashes(r.text, 5)) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in np.flatnonzero(np.bitwise_count(prints[a] ^ prints) <= 2)]
    links += [(a, b) for a, b in combinations(range(len(rows)), 2) if sets[a] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    assert sorted(r.doc_id for r in kept[3].collect()) == sorted({rows[i].doc_id for i in union(len(rows), links)})
    taken = {r.doc_id: r.copies for r in mixing.copies(kept[3]).collect()}
    assert {r.doc_id: r["count"] for r in kept[4].groupBy("doc_id").count().collect()} == {d: c for d, c in taken.items() if c}
    out = p.run(spark, sf_dir)
    assert out.groupBy("doc_id", "piece").count().count() > 0
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in kept[4].select("doc_id").distinct().collect()}


def test_pipeline_edges(spark, sf_dir):
    import corpus_pipeline as p

    docs = edge_docs(spark)
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == edge_docs(spark).columns
    assert p.STAGES[-1][1](spark, docs, sf_dir).count() > 0
    empty = edge_docs(spark).limit(0)
    for _, stage in p.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0


def near_copies(rng, n, words):
    """n texts, each 1 word in 60 or fewer away from one base text: beyond two bits of three-word fingerprints."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        copy[rng.randrange(words)] = f"x{i}"
        out.append(" ".join(copy))
    return out


def test_a_hot_row_is_mixed_by_many_tasks(spark, monkeypatch):
    """Half of the table is one row, with two values in another column: rows are spread, and each is returned as it was."""
    monkeypatch.setattr(mixing, "HOT", 50)
    rows = [(1, "one two three", "a", "x", 9)] * 1500 + [(1, "one two three", "a", "y", 9)] * 500 + [(i, f"word{i} " * (i % 5 + 1), "ab"[i % 2], "x", i) for i in range(2, 2002)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, copies long").repartition(3, "doc_id")
    each = mixing.copies(docs)
    told = each.withColumn("part", F.spark_partition_id()).groupBy("doc_id", "part").count().filter("doc_id = 1").collect()
    assert sum(r["count"] for r in told) == 2000 and len(told) > 1 and max(r["count"] for r in told) < 1500
    want = {(r.doc_id, r.source): r.n for r in each.groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = mixed.withColumn("part", F.spark_partition_id()).groupBy("doc_id", "text", "source", "lang", "copies", "part").count().collect()
    for key, n in want.items():
        assert sum(r["count"] for r in got if (r.doc_id, r.source) == key) == n
    assert {(r.doc_id, r.text, r.source, r.lang, r.copies) for r in got} <= set(rows)
    hot = [r for r in got if r.doc_id == 1]
    assert len({r.part for r in hot}) > 1
    whole, more = divmod(want[1, "a"], 2000)
    by_lang = {x: sum(r["count"] for r in hot if r.lang == x) for x in "xy"}
    assert all(whole * n <= by_lang[x] <= whole * n + min(n, more) for x, n in (("x", 1500), ("y", 500)))
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_results_over_clashing_names(spark):
    """Extra columns named like the results of mixing, SimHash and packing change nothing."""
    rows = [(i, f"some words number {i % 4} " * (i % 3 + 1), "s") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = docs.withColumns({c: F.lit(1) for c in ("size", "target", "copies", "equal", "node", "share", "fingerprint", "component_id", "piece", "start", "length", "offset", "sequence_id", "k0", "t")})
    for make in (mixing.copies, simhash.near_duplicates, packing.pack):
        assert sorted(map(str, make(docs).collect())) == sorted(map(str, make(clash).collect()))
    assert mixing.mix(clash).columns == clash.columns


def test_pipeline_removes_copies_of_five_word_similarity(spark, sf_dir):
    import corpus_pipeline as p

    rng = random.Random(5)
    texts = [t for words in (60, 90, 200, 700) for t in near_copies(rng, 12, words)]
    texts += [" ".join(f"u{rng.randrange(5000)}" for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    # Chains: each text is close to the one before it only.
    chain = [f"c{i}" for i in range(400)]
    texts += [" ".join(chain[30 * i : 30 * i + 270]) for i in range(5)]
    sets = [set(simhash.shingle_hashes(t, 5)) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    assert len(links) > 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in p.drop_near_duplicates(spark, docs, sf_dir).collect()}
    assert kept == set(union(len(texts), links))


@pytest.mark.parametrize("cells", [1 << 24, 900, 1])
def test_groups_are_compared_whole(cells, monkeypatch):
    import pyarrow as pa

    from reelframe.llm import nearcopies

    monkeypatch.setattr(nearcopies, "CELLS", cells)
    rng = random.Random(9)
    rows = []
    for key in range(6):
        base = list(range(1000 * key, 1000 * key + 40))
        for _ in range(rng.randrange(1, 25)):
            h = sorted(set(base) - set(rng.sample(base, rng.randrange(9))) | {10_000 + rng.randrange(500) for _ in range(rng.randrange(4))})
            root = rng.choice([0, 0, 0, len(rows)])
            rows.append({"key": key, "block": 0, "part": key % 2, "fp": len(rows), "root": root, "home": True, "outside": root != 0, "h": h})
    kinds = [("key", pa.int64()), ("block", pa.int32()), ("part", pa.int32()), ("fp", pa.int64()), ("root", pa.int64()), ("home", pa.bool_()), ("outside", pa.bool_()), ("h", pa.list_(pa.int64()))]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
    alike = lambda a, b: 9 * len(set(a["h"]) & set(b["h"])) >= 4 * (len(a["h"]) + len(b["h"]))
    links = [(a["fp"], b["fp"]) for a, b in combinations(rows, 2) if a["key"] == b["key"] and a["root"] != b["root"] and alike(a, b)]
    assert len(links) > 20
    for cut in (0, 1, 30, len(rows)):
        out = [(r["a"], r["b"]) for b in nearcopies._across(iter([batch.slice(0, cut), batch.slice(cut)])) for r in b.to_pylist()]
        assert union(len(rows), out) == union(len(rows), links)


def test_a_hot_group_is_shuffled_once(spark, monkeypatch):
    """A thousand texts of one component and three others under one key: each goes to its own block, the three to all."""
    from reelframe.llm import nearcopies

    monkeypatch.setattr(nearcopies, "SHINGLES", 1000)
    monkeypatch.setattr(nearcopies, "_across", lambda batches: iter([b.select(["key", "t"]).rename_columns(["a", "b"]) for b in batches]))
    h = spark.range(1003).select(F.col("id").alias("t"), F.array(F.col("id")).alias("h"))
    split = h.select(F.lit(7).cast("long").alias("key"), "t", F.col("t").alias("fp"), F.lit(20).alias("n"), F.greatest(F.col("t"), F.lit(999)).alias("root"))
    sent = nearcopies._open_groups(split, h, 5).groupBy("b").count().collect()
    assert {r.b: r["count"] for r in sent} == dict.fromkeys(range(1000), 1) | dict.fromkeys(range(1000, 1003), 21)


@pytest.mark.parametrize("shingles", [1_000_000, 300])
def test_blocks_of_a_group_meet_each_other(spark, shingles, monkeypatch):
    from reelframe.llm import nearcopies

    monkeypatch.setattr(nearcopies, "SHINGLES", shingles)
    rng = random.Random(10)
    texts = near_copies(rng, 30, 40) + [" ".join(f"m{rng.randrange(30)}" for _ in range(20)) for _ in range(40)]
    sets = [sorted(set(simhash.shingle_hashes(t, 5))) for t in texts]
    h = spark.createDataFrame([(i, [x - (1 << 63) for x in s]) for i, s in enumerate(sets)], "t long, h array<long>")
    split = spark.createDataFrame([(7, i, i, len(s), i) for i, s in enumerate(sets)], "key long, t long, fp long, n int, root long")
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if 9 * len({*sets[i]} & {*sets[j]}) >= 4 * (len(sets[i]) + len(sets[j]))]
    got = [(r.a, r.b) for r in nearcopies._open_groups(split, h, 3).collect()]
    assert links and union(len(sets), got) == union(len(sets), links)


def test_pipeline_keeps_rows_without_or_with_repeated_ids(spark, sf_dir):
    import corpus_pipeline as p

    rng = random.Random(6)
    texts = [" ".join(f"v{rng.randrange(5000)}" for _ in range(20)) for _ in range(12)]
    rows = [(None, t) for t in texts[:6]] + [(None, texts[0])] * 3 + [(7, texts[6]), (7, texts[7]), (8, texts[8]), (None, texts[8]), (9, texts[8])] + [(3, texts[9])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id or 0, r.text) for r in p.drop_near_duplicates(spark, docs, sf_dir).collect())
    assert got == sorted([(0, t) for t in texts[:6]] + [(7, texts[6]), (7, texts[7]), (8, texts[8]), (3, texts[9])])


def test_packing_search_needs_little_memory():
    """Thousands of lengths make the search thousands of levels deep; a level keeps no table of the lengths left."""
    count = np.random.default_rng(3).integers(0, 8, packing.CAPACITY + 1)
    count[:200] = 0
    tracemalloc.start()
    best, bound, _ = packing.complete(count, steps=20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    left = count.copy()
    for lengths, times in best:
        assert sum(lengths) <= packing.CAPACITY
        np.subtract.at(left, list(lengths), times)
    assert not left.any() and sum(n for _, n in best) >= bound
    assert peak < 60_000_000
