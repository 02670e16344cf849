"""The preview store with several writers, folders of parser output, gutters."""

import json
import os
import random
from threading import Barrier, Thread

import pytest
from pyspark.sql import functions as F

from pageloom.operators import layout
from pageloom.sources import folders, previews
from pageloom.streaming.arrivals import ingest_arrivals

KIND = "document_id bigint, text string"


def texts(spark, path, *of):
    return sorted((r.document_id, r.text) for r in previews.read_previews(spark, path, *of).collect())


def test_two_writers_lose_nothing(spark, tmp_path):
    path, together, got, failed = str(tmp_path / "store"), Barrier(4), [], []

    def write(k):
        try:
            together.wait(60)
            for i in range(2):
                got.append(previews.write_previews(spark, spark.createDataFrame([(100 * k + i, f"{k}-{i}"), (7, f"by {k}")], KIND), path, buckets=4))
        except Exception as e:  # noqa: BLE001
            failed.append(repr(e))

    threads = [Thread(target=write, args=(k,)) for k in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(240)
    assert failed == [] and sorted(got) == list(range(8))
    rows = texts(spark, path)
    assert [r for r in rows if r[0] != 7] == sorted((100 * k + i, f"{k}-{i}") for k in range(1, 5) for i in range(2)) and len([r for r in rows if r[0] == 7]) == 1
    assert texts(spark, path, 201) == [(201, "2-1")] and texts(spark, path, 5) == []
    assert not [x for x in os.listdir(tmp_path / "store" / "_versions") if x.count(".") > 2]


def test_a_number_is_taken_once(spark, tmp_path):
    made, together = [], Barrier(8)

    def claim(k):
        together.wait(60)
        made.append(previews._create(spark, str(tmp_path / "v" / "000000000000.json"), f"{k}" * 1000))

    threads = [Thread(target=claim, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert sorted(made) == [False] * 7 + [True] and len(set((tmp_path / "v" / "000000000000.json").read_text())) == 1


def test_deletes_snapshots_and_vacuum(spark, tmp_path):
    path = str(tmp_path / "store")
    put = lambda rows, **how: previews.write_previews(spark, spark.createDataFrame(rows, KIND), path, **how)
    put([(1, "a"), (2, "b"), (3, "c")], buckets=2)
    put([(2, None)], deleted=True)
    put([(3, "c2")])
    before = previews.versions(spark, path)
    assert previews.compact_previews(spark, path) == 3
    put([(2, "again"), (4, "d")])
    put([(1, None)], deleted=True)
    want = [(2, "again"), (3, "c2"), (4, "d")]
    assert texts(spark, path) == want
    gone = previews.vacuum_previews(spark, path)
    assert sorted(gone) == sorted(v.folder for v in before) and texts(spark, path) == want
    assert previews.compact_previews(spark, path) == 6 and texts(spark, path) == want
    previews.vacuum_previews(spark, path)
    assert texts(spark, path) == want and len(previews.versions(spark, path)) == 1
    with pytest.raises(ValueError, match="buckets"):
        put([(9, "x")], buckets=3)
    wider = spark.createDataFrame([(5, "e", 1.5)], KIND + ", extra double")
    previews.write_previews(spark, wider, path)
    assert {r.document_id: r.extra for r in previews.read_previews(spark, path).collect()} == {2: None, 3: None, 4: None, 5: 1.5}


def test_a_corrupt_store_is_told(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        previews.read_previews(spark, path)
    previews.write_previews(spark, spark.createDataFrame([(1, "a")], KIND), path)
    (tmp_path / "store" / "_versions" / "000000000001.json").write_text(json.dumps({"folder": "write-gone", "buckets": previews.BUCKETS, "upto": None}))
    with pytest.raises(ValueError, match="not there"):
        previews.read_previews(spark, path)
    (tmp_path / "store" / "_versions" / "000000000001.json").write_text("{")
    for call in (previews.read_previews, previews.compact_previews):
        with pytest.raises(ValueError, match="can't be read"):
            call(spark, path)
    with pytest.raises(ValueError, match="can't be read"):
        previews.write_previews(spark, spark.createDataFrame([(1, "a")], KIND), path)


def test_a_folder_of_parser_output(spark, tmp_path):
    kid = lambda text, y: {"type": "paragraph", "id": 1, "page number": 1, "bounding box": [10, y - 10, 200, y], "content": text}
    info, first = "Pages: 1\nPage size: 612 x 792 pts\n", json.dumps({"kids": [kid("a text of its own", 700), kid("", 500)]})
    second = json.dumps({"kids": [kid("filled by the other pass", 500)]})
    of = {"whole": (info, first, second), "no second": (info, first, None), "broken+é": (info, first[:-5], second), "no info": (None, first, second), "nothing": (info, None, None), "blank": (info, " ", "{}")}
    for stem, parts in of.items():
        for kind, text in zip(folders.KINDS, parts, strict=True):
            (tmp_path / kind).mkdir(exist_ok=True)
            if text is not None:
                (tmp_path / kind / f"{stem}.{'txt' if kind == 'info' else 'json'}").write_text(text)
    (tmp_path / "other.json").write_text("left alone")
    (tmp_path / "default" / "x.png").write_text("left alone")
    rows = folders.read_parser_output(spark, str(tmp_path))
    got = {r.stem: r for r in rows.collect()}
    assert {s: (r.page_info, r.pass_1, r.pass_2) for s, r in got.items()} == of
    assert {s: sorted(r.missing) for s, r in got.items() if r.missing} == {"no second": ["struct"], "no info": ["info"], "nothing": ["default", "struct"]}
    ids = {r.document_id: s for s, r in got.items()}
    done = ingest_arrivals(rows)
    assert {ids[r.document_id]: r.error for r in done.rejects.collect()} == {"broken+é": "broken parser JSON in pass 1", "no info": "no page count", "blank": "broken parser JSON in pass 1"}
    assert sorted((ids[r.document_id], r.text) for r in done.blocks.collect()) == [("no second", "a text of its own"), ("whole", "a text of its own"), ("whole", "filled by the other pass")]
    assert [ids[r.document_id] for r in done.warnings.where(F.col("warning").contains("無輸出")).collect()] == ["nothing"]
    assert folders.read_parser_output(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert folders.parser_missing(rows).count() == len(of)


LINE = "document_id bigint, page int, line_no int, text string, mean double, x1 double, y1 double, x2 double, y2 double, width_px int"


def test_columns_are_told_apart_at_their_gutter(spark):
    """Narrow left column and wide right one: some right lines begin and lie left of the page's middle."""
    rows = []
    for i in range(12):
        rows.append((1, 1, 2 * i, f"left {i}", 0.9, 50.0, 100.0 + 40 * i, 300.0, 130.0 + 40 * i, 1000))
        rows.append((1, 1, 2 * i + 1, f"right {i}", 0.9, 330.0, 100.0 + 40 * i, 600.0 if i % 2 else 900.0, 130.0 + 40 * i, 1000))
    rows.append((1, 1, 90, "a wide line below both", 0.9, 50.0, 800.0, 900.0, 830.0, 1000))
    rows += [(2, 1, i, f"one column {i}", 0.9, 50.0, 100.0 + 40 * i, 500.0 + 10 * i, 130.0 + 40 * i, 1000) for i in range(6)]
    random.Random(1).shuffle(rows)
    lines = spark.createDataFrame(rows, LINE).repartition(3)
    assert {r.document_id: r.gutter for r in layout.column_gutters(lines).collect()} == {1: 315.0, 2: 500.0}
    of = lambda **how: {r.role: r.text for r in layout.reconstruct(lines.where("document_id = 1 and line_no < 90"), **how).collect()}
    apart = of(by_gutter=True)
    assert apart["left"] == "".join(f"left {i}" for i in range(12)) and apart["right"] == "".join(f"right {i}" for i in range(12))
    assert of()["left"] != apart["left"]  # the page's middle takes the short right lines for left ones


def test_equal_gaps(spark):
    line = lambda d, x1, x2, n: (d, 1, n, "text", 0.9, float(x1), 100.0, float(x2), 120.0, 1000)
    rows = [line(1, 100, 250, 0), line(1, 300, 480, 1), line(1, 530, 700, 2), line(2, 250, 400, 0), line(2, 450, 550, 1), line(2, 600, 700, 2), line(3, 100, 150, 0), line(3, 180, 990, 1)]
    got = {r.document_id: r.gutter for r in layout.column_gutters(spark.createDataFrame(rows, LINE)).collect()}
    assert got == {1: 505.0, 2: 425.0, 3: 500.0}  # nearest to the middle; then the left one; a gap beyond the band doesn't count


def test_uploads_are_stored_once_and_stale_ones_go(spark, tmp_path):
    import time
    from datetime import datetime, timedelta

    from pageloom.sources import readers, uploads

    path, source = str(tmp_path / "store"), tmp_path / "in"
    source.mkdir()
    for name, text in {"a": "same", "b": "same", "c": "other", "big": "x" * 100}.items():
        (source / f"{name}.pdf").write_bytes(text.encode())
    read = lambda: readers.read_uploads(spark, str(source), limit=50)
    uploads.store_uploads(spark, read(), path)
    ids = {r.file_path[-7:].split("/")[-1]: r.document_id for r in read().collect()}
    contents = lambda: sorted(bytes(r.content).decode() for r in spark.read.parquet(f"{path}/contents").collect())
    assert contents() == ["other", "same"] and uploads.original(spark, path, ids["b.pdf"]) == b"same"
    assert uploads.original(spark, path, ids["big.pdf"]) is None and uploads.original(spark, path, 12345) is None
    time.sleep(1)
    later = datetime.now()
    (source / "c.pdf").write_bytes(b"changed")
    (source / "b.pdf").unlink()
    (source / "a.pdf").unlink()
    uploads.store_uploads(spark, read(), path)
    assert contents() == ["changed", "other", "same"] and uploads.original(spark, path, ids["c.pdf"]) == b"changed"
    uploads.drop_stale(spark, path, later - timedelta(hours=1))
    assert contents() == ["changed", "other", "same"]
    uploads.drop_stale(spark, path, later)
    assert contents() == ["changed"] and uploads.original(spark, path, ids["a.pdf"]) is None and uploads.original(spark, path, ids["c.pdf"]) == b"changed"
    assert [x for x in os.listdir(path) if x.startswith("_draft")] == []
    scan = uploads._table(spark, path, "uploads", spark.read.parquet(f"{path}/uploads").first().bucket)
    assert len(scan.inputFiles()) == 1
    uploads.drop_stale(spark, path, datetime.now() + timedelta(hours=1))
    assert uploads.original(spark, path, ids["c.pdf"]) is None
