"""The fourteen queries of this subpackage and their oracle SQL where SQL can express them."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hnsw, kneser_ney, langid, licences, merkle, mixing, mjpeg, packing, periodic, repeated_lines, simhash, tagpath, toxicity
from .common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_held_out(_table(spark, sf_dir, "documents"))


def op2_mjpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mjpeg.digest(_table(spark, sf_dir, "documents"))


def op3_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs), ["doc_id"])
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpath.digest(_table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op7_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies(_table(spark, sf_dir, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "copies")


def op8_hnsw_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_simhash_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def with_periods(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """op11's input: a tenth of the documents, by the hash of their id, repeat some of their words up to the end."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return words[:start] + [words[start + i % period] for i in range(n - start)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_table(spark, sf_dir, "documents"), ["doc_id"], prepare=with_periods, prepare_by="doc_id")
    return periodic.digest(found, ["doc_id"])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the documents, against rows of which a seventh has been tampered with."""
    docs = _table(spark, sf_dir, "documents")
    n_chars = F.when(crc_mod("doc_id", 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.prove(docs, ["doc_id", "source", "lang", "n_chars", "text"], group="lang", order="doc_id", now={"n_chars": n_chars})


def op13_bloom_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_lines.drop_repeated(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_kneser_ney, op2_mjpeg_media, op3_toxicity_counterfactual, op4_language_kernel, op5_tag_path_text, op6_license_scan,
    op7_pivotal_mix, op8_hnsw_embedding_dedup, op9_simhash_anchor_dedup, op10_bin_completion_packing,
    op11_periodic_runs, op12_merkle_manifest, op13_bloom_line_dedup, pipeline,
)}

#: Leaves by language, the levels above them, then every document's way up; crc32 by its bits, since DuckDB has no function for it.
OP12 = """
WITH RECURSIVE crcs AS (
  SELECT doc_id AS id, 0 AS k, 4294967295::BIGINT AS c, CAST(doc_id AS VARCHAR) AS s FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT id, k + 1, list_reduce(list_prepend(xor(c, ord(s[k + 1])::BIGINT), range(8)::BIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)), s FROM crcs WHERE k < length(s)
), tampered AS (
  SELECT id FROM crcs WHERE k = length(s) AND xor(c, 4294967295::BIGINT) % 7 = 0
), docs AS (
  SELECT doc_id, lang, f(doc_id) || f(source) || f(lang) AS a, n_chars, f(text) AS z, doc_id IN (SELECT id FROM tampered) AS changed FROM documents
), rows_ AS (
  SELECT doc_id, lang, sha256(a || f(n_chars) || z) AS leaf, sha256(a || f(n_chars + coalesce(changed, false)::INT) || z) AS now_ FROM docs
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM rows_
), tree AS (
  SELECT lang, 0 AS lvl, pos, leaf AS h, n FROM ranked
  UNION ALL
  SELECT lang, lvl, pos, h, count(*) OVER (PARTITION BY lang) FROM (
    SELECT lang, lvl + 1 AS lvl, pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM tree WHERE n > 1 GROUP BY lang, lvl, pos // 2)
), tops AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), crown AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM tops
  UNION ALL
  SELECT lvl, pos, h, count(*) OVER () FROM (SELECT lvl + 1 AS lvl, pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM crown WHERE n > 1 GROUP BY lvl, pos // 2)
), up AS (
  SELECT lang, pos AS row_, 0 AS lvl, pos, n, '' AS proof, now_ AS cur FROM ranked
  UNION ALL
  SELECT u.lang, u.row_, u.lvl + 1, u.pos // 2, (u.n + 1) // 2, u.proof || coalesce(s.h, ''), sha256(CASE WHEN u.pos % 2 = 0 THEN u.cur || coalesce(s.h, '') ELSE s.h || u.cur END)
  FROM up u LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM u.lang AND s.lvl = u.lvl AND s.pos = xor(u.pos, 1) WHERE u.n > 1
), over AS (
  SELECT u.lang, u.row_, 0 AS lvl, t.pos, t.n, u.proof, u.cur FROM up u JOIN tops t ON t.lang IS NOT DISTINCT FROM u.lang WHERE u.n = 1
  UNION ALL
  SELECT u.lang, u.row_, u.lvl + 1, u.pos // 2, (u.n + 1) // 2, u.proof || coalesce(s.h, ''), sha256(CASE WHEN u.pos % 2 = 0 THEN u.cur || coalesce(s.h, '') ELSE s.h || u.cur END)
  FROM over u LEFT JOIN crown s ON s.lvl = u.lvl AND s.pos = xor(u.pos, 1) WHERE u.n > 1
)
SELECT r.doc_id, r.leaf, t.subroot, c.h AS root, sha256(o.proof) AS proof_sha256, o.cur AS folded_root, o.cur = c.h AS verified
FROM ranked r JOIN tops t ON t.lang IS NOT DISTINCT FROM r.lang JOIN over o ON o.lang IS NOT DISTINCT FROM r.lang AND o.row_ = r.pos AND o.n = 1 CROSS JOIN (SELECT h FROM crown WHERE n = 1) c
"""
for _column in ("doc_id", "source", "lang", "n_chars + coalesce(changed, false)::INT", "n_chars", "text"):  # f() is the text of one column of a leaf
    _text = f"CAST({_column} AS VARCHAR)"
    OP12 = OP12.replace(f"f({_column})", f"coalesce(strlen({_text}) || ':' || {_text}, '-')")

OP13 = """
WITH docs AS (
  SELECT row_number() OVER () AS row_, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT row_, doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM docs)
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT row_, doc_id, key FROM lines WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5
), marked AS (
  SELECT l.*, s.key IS NOT NULL AND s.keeper IS DISTINCT FROM l.doc_id AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY row_
"""

ORACLES: dict[str, str] = {"op12_merkle_manifest": OP12, "op13_bloom_line_dedup": OP13}
