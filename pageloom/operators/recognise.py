"""The page driver: recognition in steps, each for the pages only that the one before left without a good result.

A recogniser is opened once per task and called page by page. What it raises is
that page's error and ends its steps; the others go on. A step's results are
written before the next one, so a lost executor repeats the pages of its own
unfinished tasks and no step before.

Scale: pages are dealt evenly by document and page to a fixed number of tasks,
as a page's cost has little to do with its bytes; later steps read again, by a
semi-join, only the pages still open. A task has one page in work, so an
executor has as many as task slots, or at most `in_flight`.
"""

from __future__ import annotations

import fcntl
import multiprocessing
import os
import tempfile
import time
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators.ocr import LEAST_MEAN, finite
from pageloom.plans.options import IngestOptions
from pageloom.sources.tables import written

KEYS = ("document_id", "page")
LINE = "line_no int, text string, mean double, x1 double, y1 double, x2 double, y2 double"
RESULT = f"attempt_no int, stage string, dpi int, width_px int, height_px int, model_label string, error string, lines array<struct<{LINE.replace(' ', ':').replace(',:', ',')}>>"
SLOT_WAIT = 0.02


class Step(NamedTuple):
    """One attempt: its number, the name of its result, the resolution, and what is different in it."""

    attempt_no: int
    stage: str
    dpi: int
    greyscale: bool = False
    fallback: bool = False


class Line(NamedTuple):
    text: str | None
    mean: float | None
    x1: float
    y1: float
    x2: float
    y2: float


class Recognised(NamedTuple):
    """Lines in reading order, and the raster they were found in."""

    lines: list[Line]
    width_px: int
    height_px: int
    model_label: str


#: A page's row (and the step) to what is recognised on it.
Recogniser = Callable[[Step, Mapping], Recognised]


def steps(options: IngestOptions, *, fallback_model: bool = True) -> tuple[Step, ...]:
    """The attempts of a profile in their order."""
    first, second = options.dpi
    every = (Step(1, "primary_ocr", first), Step(2, "primary_ocr", first, greyscale=True), Step(3, "primary_ocr", second), Step(4, "fallback_rec_ppocr_v4_doc", second, fallback=True))
    return every if fallback_model else every[:3]


@contextmanager
def _slot(most: int | None) -> Iterator[None]:
    """One of `most` places that the Python workers of an executor share (they have one parent); the system frees those of dead workers."""
    if most is None:
        yield
        return
    files = [open(os.path.join(tempfile.gettempdir(), f"pageloom-slot-{os.getppid()}-{i}"), "w") for i in range(most)]  # noqa: SIM115
    try:
        while True:
            for f in files:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                except OSError:
                    continue
                yield
                return
            time.sleep(SLOT_WAIT)
    finally:
        for f in files:
            f.close()


def _apart(recognise: Recogniser, step: Step, page: Mapping, seconds: float | None) -> Recognised:
    """In a process of its own: its death, or more than the time it has, is the page's error."""
    fork = multiprocessing.get_context("fork")
    here, there = fork.Pipe(duplex=False)

    def work() -> None:
        try:
            there.send((recognise(step, page), None))
        except Exception as e:  # noqa: BLE001
            there.send((None, _said(e)))
        finally:
            there.close()
            os._exit(0)

    child = fork.Process(target=work)
    child.start()
    there.close()
    try:
        if not here.poll(seconds):
            raise TimeoutError(f"recognition took more than {seconds:g} s")
        try:
            result, error = here.recv()
        except EOFError:
            child.join()
            raise RuntimeError(f"recognition ended with code {child.exitcode}") from None
        if error is not None:
            raise RuntimeError(error)
        return result
    finally:
        child.kill()
        child.join()
        here.close()


def _said(e: BaseException) -> str:
    return str(e) or type(e).__name__


def _attempt(recognise: Recogniser, step: Step, page: Mapping, apart: bool, seconds: float | None) -> dict:
    out = {"attempt_no": step.attempt_no, "stage": step.stage, "dpi": step.dpi, "width_px": None, "height_px": None, "model_label": None, "error": None, "lines": []}
    try:
        found = _apart(recognise, step, page, seconds) if apart else recognise(step, page)
        lines = [{"line_no": i, "text": None if x.text is None else str(x.text), "mean": None if x.mean is None else float(x.mean), **{k: float(getattr(x, k)) for k in ("x1", "y1", "x2", "y2")}} for i, x in enumerate(found.lines)]
        return out | {"width_px": int(found.width_px), "height_px": int(found.height_px), "model_label": found.model_label, "lines": lines}
    except Exception as e:  # noqa: BLE001
        return out | {"error": _said(e)}


def _run(batches: Iterator[pa.RecordBatch], fields: pa.Schema, open_recogniser: Callable[[], Recogniser], step: Step, in_flight: int | None, apart: bool, seconds: float | None) -> Iterator[pa.RecordBatch]:
    recognise = None
    for batch in batches:
        for i in range(batch.num_rows):
            page = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            with _slot(in_flight):
                recognise = recognise or open_recogniser()
                result = _attempt(recognise, step, page, apart, seconds)
            yield pa.RecordBatch.from_pylist([{k: page[k] for k in KEYS} | result], fields)


def is_good() -> Column:
    """Of rows with lines: some, of a mean confidence (finite values; 0 if none) that is high enough."""
    means = F.filter(F.transform("lines", lambda x: x["mean"]), finite)
    mean = F.when(F.size(means) > 0, F.aggregate(means, F.lit(0.0), lambda a, x: a + x) / F.size(means)).otherwise(0.0)
    return (F.size("lines") > 0) & (mean >= LEAST_MEAN)


def run_cascade(pages: DataFrame, open_recogniser: Callable[[], Recogniser], plan: tuple[Step, ...], *, in_flight: int | None = None, apart: bool = False, seconds: float | None = None, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines and attempts of pages (document_id, page and what the recogniser needs, such as the image): those that were made, no more.

    apart: each page in a process of its own, so that a crash or a page that takes more than `seconds` is an error of that page too.
    tasks: into how many a step's pages are dealt, by default three for each core of the cluster.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    if seconds is not None and not apart:
        raise ValueError("only pages in processes of their own can have a time limit")
    schema = StructType([*(pages.schema[k] for k in KEYS), *_parse_datatype_string(RESULT)])
    fields = to_arrow_schema(schema)
    n = tasks or 3 * pages.sparkSession.sparkContext.defaultParallelism
    made, todo = None, pages
    for step in plan:
        run = lambda it, step=step: _run(it, fields, open_recogniser, step, in_flight, apart, seconds)
        done = written(todo.repartition(n, *KEYS).mapInArrow(run, schema))
        made = done if made is None else made.unionByName(done)
        still = done.where(F.col("error").isNull() & ~is_good()).select(*KEYS)
        if step is plan[-1] or still.isEmpty():
            break
        todo = pages.join(still, list(KEYS), "left_semi")
    lines = made.select(*KEYS, "attempt_no", F.explode("lines").alias("x")).select(*KEYS, "attempt_no", "x.*")
    return lines, made.drop("lines")
