import json
import os

from pageloom.sources import tables
from pageloom.streaming.arrivals import stream_blocks


def test_blocks_of_arriving_documents(spark, tmp_path):
    kid = lambda text, y: {"type": "paragraph", "id": 1, "page number": 1, "bounding box": [10, y - 10, 200, y], "content": text}
    info = "Pages: 1\nPage size: 612 x 792 pts\n"
    source = tmp_path / "in"
    source.mkdir()
    for n in (1, 2):
        row = {"document_id": n, "page_info": info, "pass_1": json.dumps({"kids": [kid(f"text of document {n}", 700), kid("", 500)]}), "pass_2": json.dumps({"kids": [kid("filled by the other pass", 500)]})}
        (source / f"{n}.json").write_text(json.dumps(row))
        query = stream_blocks(spark, str(source), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        assert query.awaitTermination(120) and query.exception() is None
        got = spark.read.parquet(str(tmp_path / "out")).orderBy("document_id", "seq").collect()
        assert [(r.document_id, r.text) for r in got] == [(d, t) for d in range(1, n + 1) for t in (f"text of document {d}", "filled by the other pass")]


def test_a_bad_row_goes_to_the_rejects_and_nothing_is_left(spark, tmp_path):
    root = tables.shared_dir(spark).removeprefix("file:")
    os.makedirs(root, exist_ok=True)
    before = set(os.listdir(root))
    source = tmp_path / "in"
    source.mkdir()
    kids = json.dumps({"kids": [{"type": "paragraph", "id": 1, "page number": 1, "bounding box": [10, 690, 200, 700], "content": "a text of its own"}]})
    for n in range(3):
        rows = [{"document_id": 2 * n, "page_info": "Pages: 1\nPage size: 612 x 792 pts\n", "pass_1": kids, "pass_2": "{}"}, {"document_id": 2 * n + 1, "page_info": "nothing", "pass_1": kids, "pass_2": "{}"}]
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        query = stream_blocks(spark, str(source), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        assert query.awaitTermination(120) and query.exception() is None
    assert sorted(r.document_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4]
    assert sorted((r.document_id, r.error) for r in spark.read.parquet(str(tmp_path / "out-rejects")).collect()) == [(n, "no page count") for n in (1, 3, 5)]
    assert set(os.listdir(root)) - before == set()


KIDS = json.dumps({"kids": [{"type": "paragraph", "id": 1, "page number": 1, "bounding box": [10, 690, 200, 700], "content": "a text of its own"}]})
INFO = "Pages: 1\nPage size: 612 x 792 pts\n"


def test_broken_parser_json_is_rejected_and_missing_or_other_json_is_not(spark):
    from pageloom.streaming.arrivals import ARRIVALS, ingest_arrivals

    rows = [(1, INFO, KIDS, KIDS), (2, INFO, KIDS[:40], KIDS), (3, INFO, KIDS, KIDS[:-1]), (4, "nothing", KIDS, ""), (5, INFO, KIDS, None), (6, INFO, KIDS, "[]"), (7, INFO, "null", "7"), (8, INFO, KIDS, json.dumps({"kids": {}})), (9, INFO, "{}", "{}"), (None, INFO, "{", "{}")]
    done = ingest_arrivals(spark.createDataFrame(rows, ARRIVALS))
    errors = {r.document_id: r.error for r in done.rejects.collect()}
    first, second = "broken parser JSON in pass 1", "broken parser JSON in pass 2"
    assert errors == {2: first, 3: second, 4: f"no page count; {second}", 7: first, 8: second, None: first}
    assert {r.stage for r in done.rejects.collect()} == {"read"}
    assert sorted(r.document_id for r in done.blocks.collect()) == [1, 5, 6]
    assert [(r.document_id, r.warning) for r in done.warnings.collect()] == [(9, "ODL 兩個 pass 均無輸出，可能 PDF 無可提取文字。")]


def test_two_streams_at_once(spark, tmp_path):
    """The one that ends its batch first doesn't take the other's tables away."""
    from threading import Barrier, Thread

    together, failed = Barrier(2), []

    def run(name: str, rows: int) -> None:
        try:
            source = tmp_path / f"in-{name}"
            source.mkdir()
            (source / "1.json").write_text("\n".join(json.dumps({"document_id": n, "page_info": INFO, "pass_1": KIDS, "pass_2": "{}"}) for n in range(rows)))

            def then(done, n):
                if name == "a":
                    together.wait(120)  # b's tables are written, a ends its scope
                else:
                    together.wait(120)
                    ended.wait(120)
                    assert done.report.count() == done.blocks.count() == rows

            query = stream_blocks(spark, str(source), str(tmp_path / f"out-{name}"), str(tmp_path / f"checkpoint-{name}"), then=then)
            assert query.awaitTermination(240)
            if name == "a":
                ended.set()
            assert query.exception() is None
        except Exception as e:  # noqa: BLE001
            failed.append(f"{name}: {e}")

    from threading import Event

    ended = Event()
    threads = [Thread(target=run, args=x) for x in (("a", 3), ("b", 5))]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert failed == []
    assert spark.read.parquet(str(tmp_path / "out-b")).count() == 5
