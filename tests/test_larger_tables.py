"""Queries on rows as larger tables have them: keys of more digits, and plans that must not grow faster than the input."""

import duckdb

from reelframe.operators import render
from reelframe.plans import registry
from tests.test_oracles import rows


def agrees(spark, name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    found = registry.QUERIES[name](spark, str(folder))
    return rows(found.columns, found.collect()) == rows(names, want.fetchall())


def test_names_of_seven_digits(spark, sf_dir, tmp_path):
    duckdb.sql(f"SELECT * REPLACE (event_id + 999990 AS event_id) FROM '{sf_dir}/events.parquet' WHERE event_id < 40").write_parquet(str(tmp_path / "events.parquet"))
    assert agrees(spark, "tx_names", tmp_path, "events")


def test_captures_are_made_once(spark, sf_dir):
    """Frames are put together once in the plans of a merge and a split (one union of each frame, one of each capture)."""
    for name in ("mg_merge", "mg_split"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("bit_or(") == 2


def test_equal_small_pictures_are_made_once():
    made = []
    kernel = render.remembered(lambda *v: made.append(v) or v)
    assert [kernel(8, b"a", 1), kernel(8, b"a", 1), kernel(8, b"b", 1)] == [(b"a", 1), (b"a", 1), (b"b", 1)] and len(made) == 2
    assert kernel(render.SMALL + 1, b"c") == kernel(render.SMALL + 1, b"c") and len(made) == 4


def test_settings_are_read_by_all_tasks(spark, sf_dir):
    assert registry.QUERIES["src_settings"](spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
