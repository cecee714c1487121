"""Periodic runs, Merkle manifests and repeated lines against brute force, DuckDB and edge cases."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.llm import merkle, periodic, queries, repeated_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], SCHEMA)


# ---- periodic runs ----


def naive_runs(words):
    """Every maximal stretch with smallest period q and at least max(6, 4 * q) words, by trying all of them."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            stretch = words[start : start + length]
            smallest = next(d for d in range(1, q + 1) if all(stretch[j] == stretch[j + d] for j in range(length - d)))
            if smallest == q and length >= max(6, 4 * q):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def naive_row(doc_id, text):
    words = queries.with_periods((text or "").encode().split(), doc_id)
    runs = naive_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    milli = None if not runs else 1000 * best[1] // best[2]
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    return doc_id, len(runs), *best, milli, sha(listed), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))


def periodic_texts():
    rnd, texts = random.Random(7), [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b " * 3, "a b " * 4, "x " + "a b c " * 5 + "a b y", "ab ab ab ab ab ab", "é é " * 9]
    for _ in range(60):
        words = []
        for _ in range(rnd.randint(1, 6)):
            part = [rnd.choice("abc") for _ in range(rnd.randint(1, 7))]
            words += part * rnd.choice([1, 1, 2, 4, 5, 9])
        texts.append(" ".join(words))
    return texts


def test_scan_equals_brute_force():
    for t in periodic_texts():
        words = (t or "").encode().split()
        ids = periodic.word_ids(words)
        for cut in (1, 2, 5):  # ranges of lags give the runs of all lags
            parts = [r for low in range(1, len(words) // 4 + 1, cut) for r in periodic.scan(ids, low, low + cut)]
            assert sorted(parts, key=lambda r: (r[0], r[2])) == naive_runs(words)


def test_word_ids_widen():
    assert [periodic.word_ids([b"%d" % i for i in range(n)]).dtype.itemsize for n in (0, 256, 257, 65537)] == [1, 1, 2, 4]


@pytest.mark.parametrize("light", [periodic.LIGHT_BYTES, 20])
def test_runs_query_equals_brute_force(spark, light, monkeypatch):
    """With light = 20 nearly all texts are dealt out in pieces of lags, several each."""
    monkeypatch.setattr(periodic, "LIGHT_BYTES", light)
    monkeypatch.setattr(periodic, "PIECE", periodic.PIECE if light > 20 else 40)
    rows = [(i * 3, t, None) for i, t in enumerate(periodic_texts())] + [(0, "a b " * 9, None), (0, "a b " * 9, None), (None, "c " * 9, None)]
    docs = docs_of(spark, rows).withColumns({c: F.lit(1) for c in ("n_words", "runs", "collapsed", "key", "t", "by", "found")})
    found = periodic.digest(periodic.find_runs(docs, ["doc_id"], prepare=queries.with_periods, prepare_by="doc_id"), ["doc_id"])
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(str(naive_row(i, t)) for i, t, _ in rows)
    assert periodic.find_runs(docs.limit(0), ["doc_id"]).count() == 0


def test_planted_periods():
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    words = [b"%d" % i for i in range(100)]
    assert ids and all(queries.with_periods(words, i)[: zlib.crc32(str(i).encode()) // 10 % 100] == words[: zlib.crc32(str(i).encode()) // 10 % 100] for i in ids)
    assert any(naive_runs(queries.with_periods(words, i)) for i in ids) and queries.with_periods([], ids[0]) == []


# ---- Merkle manifests ----


def duck(spark, docs, sql):
    con = duckdb.connect()
    con.register("raw", docs.toPandas())
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, lang::VARCHAR AS lang, source::VARCHAR AS source, n_chars::BIGINT AS n_chars FROM raw")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return names, sorted(map(str, found.fetchall()))


def manifest(docs, **more):
    tampered = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.prove(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": tampered}, **more)


def equal_to_sql(spark, docs, found, sql):
    names, want = duck(spark, docs, sql)
    assert sorted(map(str, (tuple(r) for r in found.select(*names).collect()))) == want


@pytest.mark.parametrize("bits", [merkle.LEAST_BITS, 0, 2])
def test_manifest_equals_sql(spark, sf_dir, bits, monkeypatch):
    monkeypatch.setattr(merkle, "LEAST_BITS", bits)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    equal_to_sql(spark, docs, manifest(docs), queries.OP12)


@pytest.mark.parametrize("bits", [1, 3])
def test_manifest_edges(spark, bits, monkeypatch):
    """Null and empty values, one leaf, null groups, repeated and null ids, repeated rows, clashing columns."""
    monkeypatch.setattr(merkle, "LEAST_BITS", bits)
    rows = [(1, "a", "x"), (2, None, "x"), (2, None, "x"), (2, "b", "x"), (None, "c", "x"), (None, "d", "x"), (3, "", None), (4, "é" * 50, None), (5, "z", "Z"), (6, "z" * 9000, "é"), *[(i, f"t{i}", "y") for i in range(13)]]
    docs = docs_of(spark, rows)
    more = docs.withColumns({c: F.lit(1) for c in ("leaf", "pos", "root", "proof", "group_", "id_", "tie", "at", "now_")})
    equal_to_sql(spark, docs, manifest(more), queries.OP12)
    assert manifest(docs.limit(0)).count() == 0
    one = manifest(docs.limit(1), proofs=True).first()
    assert one.root == one.subroot == one.leaf and one.proof == "" and one.proof_sha256 == sha(b"")


def test_proofs_lead_to_the_root(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(merkle, "LEAST_BITS", 3)
    for r in manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), proofs=True).collect():
        digests = iter(r.proof[i : i + 64] for i in range(0, len(r.proof), 64))
        steps = [(s, "" if s == " " else next(digests)) for s in r.sides]
        assert merkle.fold(r.leaf, steps) == r.root and (r.folded_root == r.root) == r.verified
        assert merkle.fold(merkle.digest_of(r.leaf), steps) != r.root


def test_too_many_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "TOP", 2)
    with pytest.raises(ValueError, match="groups"):
        manifest(docs_of(spark, [(1, "a", "x"), (2, "a", "y"), (3, "a", "z")]))


# ---- repeated lines ----

LONG = "A line of more than forty characters, number "


def lined(spark):
    rnd = random.Random(1)
    pool = [f"{LONG}{i}" for i in range(30)] + ["short", "", "  ", "é" * 40, "é" * 39, "x" * 40, "x" * 39, " \t" + "Y" * 40 + "\r", "y" * 40 + "\x0b", "y" * 40 + " "]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 12))), None) for i in range(60)]
    rows += [(100, None, None), (101, "", None), (102, "\n", None), (103, f"{LONG}0\n" * 5, None), (None, f"{LONG}1\nkept", None), (None, f"{LONG}2", None)]
    rows += [(200, f"{LONG}only here\n{LONG}only here", None)] * 4 + [(201, f"{LONG}all\nfirst", None)] * 3 + [(201, f"{LONG}all\nother", None)] * 3 + [(7, f"{LONG}once", None)]
    return docs_of(spark, rows)


@pytest.mark.parametrize("keys,spare", [(repeated_lines.BROADCAST_KEYS, 10), (0, 10), (0, 0), (repeated_lines.BROADCAST_KEYS, 1 << 22)])
def test_lines_equal_sql(spark, keys, spare, monkeypatch):
    """Also with hot keys apart, with a filter of a byte a segment, and with nothing broadcast."""
    monkeypatch.setattr(repeated_lines, "BROADCAST_KEYS", keys)
    monkeypatch.setattr(repeated_lines, "BROADCAST_BYTES", 0 if spare == 0 else 1 << 25)
    monkeypatch.setattr(repeated_lines, "TWICE_BYTES", 1 << 12 if spare == 1 << 22 else 1 << 25)
    docs = lined(spark)
    clash = docs.withColumns({c: F.lit(1) for c in ("kept", "n_lines", "lines", "key", "id_", "row_", "t")})
    found = repeated_lines.drop_repeated(clash, ["doc_id"]).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
    equal_to_sql(spark, docs, found, queries.OP13)
    assert found.agg(F.sum("n_dropped")).first()[0] > 100


def test_no_lines(spark):
    assert repeated_lines.drop_repeated(lined(spark).limit(0), ["doc_id"]).count() == 0
    rows = repeated_lines.drop_repeated(docs_of(spark, [(1, None, None), (2, "a\nb", None)]), ["doc_id"]).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r.kept) for r in rows] == [(1, 0, ""), (2, 0, "a\nb")]


def test_filters_miss_no_repeat(spark):
    """Every key of two texts or more passes the second filter; of the others few do."""
    texts = [f"{LONG}{i}".encode() for i in range(3000)]
    docs = spark.createDataFrame([(bytearray(t),) for t in texts + texts[:300]], "t binary").repartition(7)
    found = repeated_lines._repeated(docs, 40)
    has = found.has(np.array([repeated_lines.xxhash.xxh3_64_intdigest(t.lower()) for t in texts], np.uint64))
    assert has[:300].all() and has[300:].mean() < 0.05


def test_queries_equal_their_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, sql in queries.ORACLES.items():
        equal_to_sql(spark, docs, queries.QUERIES[name](spark, sf_dir), sql)
