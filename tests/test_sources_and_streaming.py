"""Readers, writers and the streaming form."""

import base64
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe import cli, logs, progress
from reelframe.config import Config
from reelframe.operators import artifacts, manager
from reelframe.operators.masks import Packed, Places
from reelframe.operators.segment import segment
from reelframe.plans.bindings import candidate_stream, event_pictures
from reelframe.sources import files, frames, jpeg, project, writers
from reelframe.streaming.rip import segment_stream

from .test_operators import check_sample, sample


def raw(path, data, w=4, h=2):
    path.write_bytes(data.tobytes())
    return str(path)


def test_raw_frames_source(spark, tmp_path):
    data = np.arange(10 * 2 * 4 * 3, dtype=np.uint8)
    raw(tmp_path / "clip_4x2_25.rgb", data)
    frames.register(spark)
    read = lambda **o: spark.read.format("rawframes").options(path=str(tmp_path), **o).load()
    rows = read(framesPerPartition=3).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(10)) and bytes(rows[4].rgb) == data[96:120].tobytes() and rows[5].time == 0.2
    assert sorted(r.idx for r in read(start=1, end=8, step=3).collect()) == [1, 4, 7]
    with_halo = read(framesPerPartition=2, start=1, step=2, halo="true")
    assert with_halo.rdd.getNumPartitions() == 3
    assert sorted((r.idx, r.halo) for r in with_halo.collect()) == [(1, False), (3, False), (3, True), (5, False), (7, False), (7, True), (9, False)]
    assert sorted(r.idx for r in read(start_seconds=0.1, end_seconds=0.3).collect()) == [3, 4, 5, 6, 7]


def yuv420(rgb):
    """Studio-range planes of an RGB frame; chroma is the mean of four pixels."""
    r, g, b = (rgb[..., k].astype(float) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [16 + y * 219 / 255, 128 + (b - y) / 1.772 * 224 / 255, 128 + (r - y) / 1.402 * 224 / 255]
    small = [p.reshape(p.shape[0] // 2, 2, -1, 2).mean((1, 3)) for p in planes[1:]]
    return b"".join(np.rint(p).astype(np.uint8).tobytes() for p in (planes[0], *small))


def test_y4m_source(spark, tmp_path):
    flat = [np.full((4, 6, 3), c, np.uint8) for c in ((255, 255, 255), (0, 0, 0), (200, 30, 60), (10, 120, 240))]
    head = b"YUV4MPEG2 W6 H4 F30000:1001 Ip A1:1 C420jpeg\n"
    (tmp_path / "a.y4m").write_bytes(head + b"".join(b"FRAME\n" + yuv420(f) for f in flat))
    grey = bytes(range(24))
    (tmp_path / "b.y4m").write_bytes(b"YUV4MPEG2 W6 H4 F10:1 Cmono XCOLORRANGE=FULL\nFRAME\n" + grey)
    frames.register(spark)
    rows = spark.read.format("y4m").option("path", str(tmp_path)).option("framesPerPartition", "2").load().orderBy("video_id", "idx").collect()
    assert [(r.video_id, r.idx) for r in rows] == [("a.y4m", 0), ("a.y4m", 1), ("a.y4m", 2), ("a.y4m", 3), ("b.y4m", 0)]
    for r, f in zip(rows, flat, strict=False):
        assert np.abs(np.frombuffer(r.rgb, np.uint8).astype(int) - f.ravel()).max() <= 2
    assert bytes(rows[4].rgb) == bytes(np.repeat(np.frombuffer(grey, np.uint8), 3))
    assert rows[3].time == pytest.approx(3 * 1001 / 30000)
    assert [c.info()["frame_count"] for c in frames.clips(str(tmp_path))] == [4, 1] and frames.clips(str(tmp_path))[0].fps == pytest.approx(29.97, abs=1e-3)
    (tmp_path / "c.y4m").write_bytes(b"YUV4MPEG2 W6 H4 C420p10\n")
    with pytest.raises(ValueError, match="420p10"):
        frames.clips(str(tmp_path))


def test_chroma_is_interpolated():
    wide = frames._widened(np.array([[0.0, 100.0]]), 2, 4)
    assert wide.tolist() == [[0, 25, 75, 100]] * 2
    assert frames._widened(np.array([[1.0, 2.0, 3.0]]), 1, 5).shape == (1, 5)


def test_sample_clip_as_y4m_through_the_command_line(spark, tmp_path, monkeypatch):
    """The header gives size and rate; the range starts late and ends early; every artifact is a file."""
    data, boxes = sample()
    body = b"".join(b"FRAME\n" + yuv420(np.frombuffer(f[5], np.uint8).reshape(90, 160, 3)) for f in data)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "sample.y4m").write_bytes(b"YUV4MPEG2 W160 H90 F25:1 C420jpeg\n" + body)
    found = cli.rip(spark, str(tmp_path / "in"), Config(), framesPerPartition=16)
    check_sample(found.events.collect(), boxes)
    plan = found.found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    cfg = tmp_path / "cfg.json"
    cfg.write_text('{"start_seconds": 1.8, "end_seconds": 3.2, "output": {"srt_bitmap": true, "ocr": {"format": "jpg"}}, "style": {"time_shift_10ms": 100}, "region": {"up": 60}}')
    out = tmp_path / "out"
    cli.main(["rip", str(tmp_path / "in"), str(out), "--config", str(cfg), "--log", str(tmp_path / "log")])
    got = sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file() and not p.name.startswith("."))
    assert got == ["sample.y4m.ass", "sample.y4m.esr", "sample.y4m.idx", "sample.y4m.srt", "sample.y4m.sub", "sample.y4m.timeline.json", "sample.y4m/subtitle_0001.jpg", "sample.y4m_subs/00001.bmp"]
    x, y, w, h = boxes[1]
    timeline = json.loads((out / "sample.y4m.timeline.json").read_text())
    assert timeline["video"] == {"width": 160, "height": 90} and timeline["style"] == {"time_shift_10ms": 100} and timeline["count"] == 1
    assert timeline["subtitles"] == [{"index": 1, "start": 3.0, "end": 4.0, "start_frame": 50, "end_frame": 75, "bbox": [x - 1, y - 61, w + 2, h + 2], "roi_origin": [0, 60], "diff_frames": 1}]
    made = json.loads((out / "sample.y4m.esr").read_text())
    assert made["config"]["start_seconds"] == 1.8 and made["artifacts"] == {"ssa": "sample.y4m.ass", "sub": "sample.y4m.sub", "idx": "sample.y4m.idx", "ocr_images": "sample.y4m", "srt": "sample.y4m.srt", "srt_subs": "sample.y4m_subs", "timeline": "sample.y4m.timeline.json"}
    (own,) = made["subtitles"]
    assert (own["roi_w"], own["roi_h"], own["image_w"], own["image_h"]) == (160, 30, w + 2, h + 2) and len(base64.b64decode(own["image_b64"])) == (w + 2) * (h + 2) * 3
    assert f"\\pos({x - 1},{y - 1})" in (out / "sample.y4m.ass").read_text() and "PlayResX: 160" in (out / "sample.y4m.ass").read_text()
    assert "00:00:03,000 --> 00:00:04,000" in (out / "sample.y4m.srt").read_text()
    lines = (tmp_path / "log").read_text().splitlines()
    assert sum("sample.y4m: done, 35 frames" in x for x in lines) == 1 and logs.read_logs(spark, str(tmp_path / "log")).count() == len(lines)


def test_dump_config_and_no_files(spark, tmp_path, capsys):
    cli.main(["dump-config"])
    assert Config.from_json(capsys.readouterr().out) == Config()
    with pytest.raises(FileNotFoundError):
        cli.rip(spark, str(tmp_path), Config())


def test_batch_states_and_rates(spark, tmp_path):
    for name, n in (("a_16x12_25.rgb", 30), ("b_16x12_10.rgb", 0)):
        raw(tmp_path / name, np.random.default_rng(1).integers(0, 255, (n, 12, 16, 3), dtype=np.uint8))
    found = cli.rip(spark, str(tmp_path), Config())
    got = {r.video_id: r for r in cli.states(spark, found, str(tmp_path)).collect()}
    assert (got["a_16x12_25.rgb"].state, got["a_16x12_25.rgb"].frames_processed, got["b_16x12_10.rgb"].state) == ("done", 30, "empty")


def test_progress_is_told_while_jobs_run(spark):
    told = []
    with progress.watched(spark, lambda done, known: told.append((done, known)), every_s=0.05):
        spark.range(200_000).repartition(7).groupBy(F.col("id") % 5).count().collect()
        spark.range(10).count()
    assert told[-1][0] > 0 and all(d <= n for d, n in told) and told == sorted(told)
    before = told[-1]
    spark.range(10).count()  # not watched any more
    assert told[-1] == before


def test_logs(spark, tmp_path):
    logger, ring = logs.open_log(str(tmp_path / "run.log"))
    for i in range(logs.RING + 5):
        logger.info("line %d", i)
    logger.handlers.clear()
    assert ring.dropped == 5 and ring.tail(1)[0].endswith("[INFO] line %d" % (logs.RING + 4)) and ring.tail(0) == []
    got = logs.read_logs(spark, str(tmp_path / "run.log"))
    assert got.count() == logs.RING + 5 and got.filter("level = 'INFO' and msg = 'line 7'").count() == 1


def test_files_are_committed_whole(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([("v", f"v/subtitle_{i:04d}.png", bytearray(b"%d" % i)) for i in range(1, n + 1)] + [("v", "v.srt", bytearray(b"x"))], "video_id string, name string, content binary")
    out = tmp_path / "out"
    got = {(r.kind, r.path) for r in files.write_files(rows(5).repartition(3), str(out)).collect()}
    assert got == {("images", f"{out}/v"), ("srt", f"{out}/v.srt")}
    (out / "v" / "subtitle_0009.jpg").write_text("mine"), (out / "v" / "notes.png").write_text("mine")
    files.write_files(rows(2), str(out))  # pictures numbered higher go, other files stay
    names = sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file())
    assert names == ["v.srt", "v/notes.png", "v/subtitle_0001.png", "v/subtitle_0002.png", "v/subtitle_0009.jpg"] and (out / "v" / "subtitle_0002.png").read_bytes() == b"2"
    for bad in ("../x", "/x", "v/../../x"):
        with pytest.raises(Exception, match="below the target"):
            files.write_files(rows(3).unionByName(spark.createDataFrame([("v", bad, bytearray(b""))], "video_id string, name string, content binary")), str(tmp_path / "failed"))
    assert not [p for p in (tmp_path / "failed").rglob("*") if p.is_file()] and not (tmp_path / "x").exists()


def decoded(data):
    """Pixels of a baseline JPEG with three full-size components, read bit by bit."""
    at, tables, quant, size = 2, {}, {}, None
    while True:
        marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            quant[body[0]] = np.array(list(body[1:65]))
        elif marker == 0xC0:
            size = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        elif marker == 0xC4:
            code, k, table = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[length, code] = body[k]
                    code, k = code + 1, k + 1
                assert code < 1 << length  # no code is all ones
                code <<= 1
            tables[body[0]] = table
        elif marker == 0xDA:
            break
    bits = "".join(f"{b:08b}" for b in data[at:-2].replace(b"\xff\x00", b"\xff"))
    pos = 0

    def symbol(table):
        nonlocal pos
        for n in range(1, 17):
            if (key := (n, int(bits[pos : pos + n], 2))) in table:
                pos += n
                return table[key]
        raise ValueError

    def number(n):
        nonlocal pos
        v = int(bits[pos : pos + n] or "0", 2)
        pos += n
        return v if not n or v >> n - 1 else v - (1 << n) + 1

    h, w = size
    planes, last = np.zeros((3, -(-h // 8) * 8, -(-w // 8) * 8)), [0, 0, 0]
    for by in range(0, planes.shape[1], 8):
        for bx in range(0, planes.shape[2], 8):
            for c in range(3):
                z, kind = np.zeros(64), int(c > 0)
                last[c] += number(symbol(tables[kind]))
                z[0], k = last[c], 1
                while k < 64 and (s := symbol(tables[16 + kind])):
                    k += s >> 4
                    if s != 0xF0:
                        z[k] = number(s & 15)
                    k += 1
                block = np.zeros(64)
                block[jpeg.ZIGZAG] = z * quant[kind]
                planes[c, by : by + 8, bx : bx + 8] = jpeg.DCT.T @ block.reshape(8, 8) @ jpeg.DCT
    y, cb, cr = planes[0] + 128, planes[1], planes[2]
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2), 0, 255)[:h, :w]


@pytest.mark.parametrize("quality,most", [(1, 60), (50, 9), (95, 3)])
def test_jpeg_pictures(quality, most):
    y, x = np.mgrid[0:29, 0:43]
    image = np.stack([128 + 90 * np.sin(x / 9), 128 + 90 * np.cos(y / 7), (x * 3 + y * 2) % 256 / 2], 2).astype(np.uint8)
    image[8:20, 10:30] = (255, 255, 255)
    error = np.abs(decoded(jpeg.jpeg(image, quality)) - image)
    assert error.mean() < most
    assert decoded(jpeg.jpeg(np.full((8, 8, 3), 77, np.uint8), 90)).round().astype(int).tolist() == [[[77] * 3] * 8] * 8
    noise = np.random.default_rng(2).integers(0, 256, (40, 40, 3), dtype=np.uint8)  # long codes and runs of all lengths
    assert np.abs(decoded(jpeg.jpeg(noise, 100)) - noise).mean() < 1.5


def test_code_lengths_stay_within_the_format():
    deep = np.zeros(256, int)
    deep[:30] = [2**k for k in range(30)]
    for counts in (deep, np.eye(256, dtype=int)[5], np.ones(256, int)):
        lengths = jpeg.code_lengths(counts)
        assert max(lengths.values()) <= 16 and sum(2.0 ** -n for n in lengths.values()) < 1


def test_project_defaults(spark, tmp_path):
    (tmp_path / "a.esr").write_text(json.dumps({"version": 2, "subtitles": [{"start": 1.5}, {"end": 2.5, "deleted": True}]}))
    rows = project.read_events(project.read_files(spark, str(tmp_path))).orderBy("position").collect()
    assert [(r.start, r.end, r.start_frame, r.n, r.deleted) for r in rows] == [(1.5, 0.0, 0, 0, False), (0.0, 2.5, 0, 0, True)]
    assert rows[0]["mask"] is None and rows[0].bbox == [0] * 4 and rows[0].roi_origin == [0] * 2 and bytes(rows[0].image) == b""
    header = project.read_header(project.read_files(spark, str(tmp_path))).first()
    assert (header.video, header.config, header.artifacts) == ("", "{}", {})


def test_documents_of_the_older_form_are_read(spark, tmp_path):
    """A project without buffers or regions, and a timeline with more about its video than is written here."""
    boxes = [[407, 611, 466, 54], [418, 617, 445, 48], [361, 611, 528, 54]]
    spans = [(0.52, 1.52, 13, 38), (2.0, 3.0, 50, 75), (3.52, 4.72, 88, 118)]
    items = [{"index": i + 1, "start": s, "end": e, "start_frame": a, "end_frame": z, "bbox": box} for i, ((s, e, a, z), box) in enumerate(zip(spans, boxes, strict=True))]
    config = {"rip": {"gap_frames": 5}, "output": {"fps": None, "max_subtitle_width": 720}}
    (tmp_path / "old.json").write_text(json.dumps({"format": "older", "version": 1, "video": "a.mp4", "config": config, "artifacts": {"timeline": "a.timeline.json"}, "subtitles": items}, indent=2))
    video = {"path": "a.mp4", "width": 1280, "height": 720, "fps": 25.0, "codec": "h264"}
    timeline = {"video": video, "style": {"time_shift_10ms": 0}, "count": 3, "subtitles": [x | {"roi_origin": [0, 0], "diff_frames": 1} for x in items]}
    (tmp_path / "old.timeline").write_text(json.dumps(timeline, indent=2))
    rows = project.read_timeline(project.read_files(spark, str(tmp_path / "old.timeline"))).orderBy("index").collect()
    assert [(r.start, r.end, r.start_frame, r.end_frame) for r in rows] == spans and [r.bbox for r in rows] == boxes and rows[0].width == 1280 and rows[0].roi_origin == [0, 0]
    documents = project.read_files(spark, str(tmp_path / "old.json"))
    got = project.read_events(documents).orderBy("position").collect()
    assert [r.bbox for r in got] == boxes and [r.roi_w for r in got] == [0] * 3 and project.read_events(documents, part="filtered").count() == 0
    header = project.read_header(documents).first()
    assert header.video == "a.mp4" and Config.from_json(header.config).rip.gap_frames == 5 and header.artifacts == {"timeline": "a.timeline.json"}


def pictures(spark, sf_dir):
    return event_pictures(spark, sf_dir).filter("video_id < 3")


def test_project_file_is_written_as_read(spark, sf_dir, tmp_path):
    """What is read from a written file, written again, is the same file."""
    events = pictures(spark, sf_dir)
    first = artifacts.project(events, manager.numbered(events.filter("deleted")), Config().to_json())
    again = artifacts.project(project.read_events(first), project.read_events(first, part="filtered"), Config().to_json())
    assert {tuple(r) for r in first.collect()} == {tuple(r) for r in again.collect()}


def test_artifacts(spark, sf_dir):
    events = pictures(spark, sf_dir)
    made = writers.texts(events, Config()).unionByName(writers.script(events, Config(), 640, 360)).unionByName(writers.tiles(events, Config()))
    names = {r.name: bytes(r.content) for r in made.collect()}
    live = events.filter("not deleted and video_id = 1").count()
    assert names["1.ass"].decode().count("Dialogue: 0,") == live and "PlayResX: 640" in names["1.ass"].decode()
    assert names["1.srt"].decode().count(" --> ") == live
    assert len(json.loads(names["1.esr"])["subtitles"]) == events.filter("video_id = 1").count()
    assert sum(n.startswith("1/subtitle_") for n in names) == live
    assert writers.bitmap_subtitles(events, Config()).filter("name like '1_subs/%.bmp'").count() == live
    sub = {r.name: bytes(r.content) for r in writers.subpictures(events, Config(), 640, 360).collect()}
    places = [int(x.rsplit(" ", 1)[1], 16) for x in sub["1.idx"].decode().splitlines() if x.startswith("timestamp")]
    assert len(places) == live and places[0] == 0 and all(sub["1.sub"][p : p + 4] == bytes(4) for p in places)
    sizes = [int.from_bytes(sub["1.sub"][p + 4 : p + 8], "big") for p in places]
    assert [p + 8 + n for p, n in zip(places, sizes, strict=True)] == [*places[1:], len(sub["1.sub"])]
    two = Config.from_json('{"output": {"ocr": {"per_image": 2, "padding": 3, "rotate": 90, "max_width": 8, "contrast": 5}}}')
    assert writers.tiles(events, two).filter("video_id = 1").count() == -(-live // 2)


def test_colour_mode_shows_the_image(spark):
    """The left half red, the right half green: the picture has both, where gray mode has only the text colour."""
    image = np.array([[(255, 0, 0)] * 4 + [(0, 255, 0)] * 4] * 6, np.uint8)
    row = (1, 0, 0.0, 1.0, False, bytearray(Packed.pack(np.ones((6, 8), bool))), 8, 6, [0, 0, 8, 6], [0, 0], bytearray(image.tobytes()))
    events = spark.createDataFrame([row], "video_id int, position long, start double, end double, deleted boolean, mask binary, roi_w int, roi_h int, bbox array<long>, roi_origin array<long>, image binary")
    for mode, want in (("color", [[255, 0, 0], [0, 255, 0]]), ("gray", [[0, 0, 0], [0, 0, 0]])):
        cfg = Config.from_json('{"output": {"ocr": {"format": "bmp", "color_mode": "%s"}}}' % mode)
        data = bytes(writers.tiles(events, cfg).first().content)
        w, h = np.frombuffer(data[18:26], np.int32)
        pixels = np.frombuffer(data[54:], np.uint8).reshape(h, -1)[::-1, : w * 3].reshape(h, w, 3)[..., ::-1]
        assert (w, h) == (16, 6) and [pixels[3, 5].tolist(), pixels[3, 10].tolist()] == want


def test_subpicture_runs():
    assert writers.run_length(np.array([1] * 3 + [2] * 20 + [1] * 300)) == bytes([0x31, 2, 20, 1, 0, 1, 44])
    mask = np.ones((3, 5), bool)
    data = writers.subpicture(mask, np.full((3, 5, 3), 255, np.uint8), (255, 255, 255), (0, 0, 0))
    assert len(data) == 64 + 3 * 5 and data[64:69] == bytes([0, 0, 0, 4, 0x51])


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    places = F.expr("filter(sequence(0L, 7L), p -> (shiftright(mask, cast(p as int)) & 1) = 1)")
    rows = candidate_stream(spark, sf_dir).filter("video_id < 20").withColumn("mask", places)
    last = rows.groupBy("video_id").agg((F.max("idx") + 100).alias("idx"))
    ends = last.select("video_id", "idx", (F.col("idx") / 25.0).alias("time"), F.array().cast("array<bigint>").alias("mask"), F.lit(True).alias("close_only"))
    rows.unionByName(ends).repartition(1).sortWithinPartitions("idx").write.parquet(str(tmp_path / "in"))
    whole = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in"))
    columns = ["video_id", "start_frame", "end_frame", "n"]
    want = sorted(tuple(r) for r in segment(whole, masks=Places).select(columns).collect())
    # Idle time-outs keep a stream running for ever, so it is stopped once the results are there.
    query = segment_stream(stream).writeStream.format("memory").queryName("events_out").outputMode("append").start()
    ends_at = time.time() + 60
    while spark.table("events_out").count() < len(want) and time.time() < ends_at:
        time.sleep(1)
    query.stop()
    got = sorted(tuple(r) for r in spark.table("events_out").select(columns).collect())
    assert got == want and got


def test_everything_a_configuration_asks_for(spark, sf_dir):
    events = pictures(spark, sf_dir).withColumn("deleted", F.col("deleted") | (F.col("video_id") == 2))
    kinds = lambda cfg: {(r.video_id, r.name.replace("_subs", ".subs").split("/")[0].split(".", 1)[-1]) for r in writers.everything(events, Config.from_json(cfg), 64, 36).select("video_id", "name").collect()}
    always = {("2", "esr"), ("2", "timeline.json")}
    assert kinds('{"output": {"srt_bitmap": true}}') - {("0", x) for x in ("esr", "srt", "ass", "sub", "idx", "0", "subs", "timeline.json")} == always | {("1", x) for x in ("esr", "srt", "ass", "sub", "idx", "1", "subs", "timeline.json")}
    none = kinds('{"output": {"ssa": false, "vobsub": false, "ocr_png": false, "srt": false, "json_timeline": false}}')
    assert {k for _, k in none} == {"esr"} and ("2", "esr") in none
    made = {r.name: json.loads(bytes(r.content)) for r in writers.everything(events, Config(), 64, 36, events.filter("position = 1")).filter("name in ('2.timeline.json', '2.esr', '1.esr')").collect()}
    assert made["2.timeline.json"] == {"video": {"width": 64, "height": 36}, "style": {"time_shift_10ms": 0}, "count": 0, "subtitles": []}
    assert len(made["2.esr"]["subtitles"]) == events.filter("video_id = 2").count() and made["2.esr"]["artifacts"] == {"timeline": "2.timeline.json"}
    assert len(made["1.esr"]["filtered"]) == 1 and made["1.esr"]["artifacts"]["ssa"] == "1.ass"
    with pytest.raises(ValueError, match="image"):
        writers.everything(events.drop("image"), Config(), 64, 36)


def test_previews_show_what_would_be_exported(spark):
    rows = [(1, 0, bytearray(Packed.pack(np.array([[1, 1], [0, 1]], bool))), 2, 2), (1, 1, None, 2, 2)]
    got = {(r.video_id, r.idx): r for r in writers.previews(spark.createDataFrame(rows, "video_id long, idx long, mask binary, roi_w int, roi_h int"), Config()).collect()}
    one = got["1", 0]
    assert bytes(one.content[:4]) == b"\x89PNG" and one.width >= 2 and one.height >= 2
    assert got["1", 1].content is None


def test_stream_of_frames_equals_batch(spark, tmp_path):
    """Frames of two videos shuffled over micro-batches; events come with their boxes, masks and images."""
    from reelframe.operators.rip import rip
    from reelframe.streaming.frames import rip_stream

    data, boxes = sample()
    kinds = "video_id long, idx long, time double, width int, height int, rgb binary"
    rows = [(v, *f[1:]) for v in (0, 1) for f in data]
    rng = np.random.default_rng(3)
    order = np.argsort(np.arange(len(rows)) % len(data) + rng.integers(0, 40, len(rows)), kind="stable")
    spark.createDataFrame([rows[i] for i in order], kinds).repartition(1).write.option("maxRecordsPerFile", 60).parquet(str(tmp_path / "in"))
    whole = spark.createDataFrame([r for r in rows if r[0] == 0], kinds)
    cfg = Config.from_json('{"region": {"up": 50, "sharpen": true}}')
    want = sorted((r.start, r.end, r.n, bytes(r["mask"]), list(r.bbox), list(r.roi_origin), bytes(r.image), r.source_frame) for r in rip(whole, cfg).events.collect())
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = rip_stream(stream, cfg, idle="5 seconds").writeStream.format("memory").queryName("ripped").outputMode("append").start()
        ends_at = time.time() + 90
        while spark.table("ripped").count() < 2 * len(want) and time.time() < ends_at and query.exception() is None:
            time.sleep(1)
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {}
    for r in spark.table("ripped").collect():
        got.setdefault(r.video_id, []).append((r.start, r.end, r.n, bytes(r["mask"]), list(r.bbox), list(r.roi_origin), bytes(r.image), r.source_frame))
    assert {v: sorted(e) for v, e in got.items()} == {0: want, 1: want} and len(want) == 3
