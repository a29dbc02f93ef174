"""The hook for a user's own classifier.

The first choice is an answers table produced elsewhere and joined by ``decide``.  When the reads
must run inside the job, the user's function runs here, one client per task, errors kept as data.
"""
from __future__ import annotations

import json
import time
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagegrid.schema import EXTRACTION, USAGE

Classifier = Callable[..., tuple[dict[str, Any], dict[str, Any]]]


#: Rows behind a slow call that may be asked and wait for it, for each call in flight; answers that a task remembers.
AHEAD, REMEMBERED = 64, 10_000


def classify_with(
    tickets: DataFrame, make_classifier: Callable[[], Classifier], model: str | None = None, in_flight: int = 1, ask_once: bool = False
) -> DataFrame:
    """Answer every ticket (ticket_key, text) with ``make_classifier()(text) -> (extraction, meta)``.

    ``meta`` has the model name and usage counts.  With ``model`` the call is ``(text, model)``, and that is the name recorded if ``meta``
    has none.  ``in_flight`` calls are made at once in each task, as many as the user's client bears; rows keep their order.  Calls go on
    behind a slow one: finished rows wait for it in a window of ``AHEAD`` rows a call, across batches.  With ``ask_once`` a text that a task has
    lately asked is not asked again; its rows get the same answer, without usage, as nothing was paid.  A raised error becomes the
    row's ``error``, so one bad ticket never fails a task.  Returns rows of the ANSWER schema.
    """
    asked = (model,) if model is not None else ()

    columns = ["ticket_key", "model", "extraction", "usage", "latency_ms", "error"]

    # Everything a task needs is inside, so the function travels whole.
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = make_classifier()

        def one(key: str, text: str) -> tuple:
            started = time.perf_counter()
            name = usage = body = error = None
            try:
                extraction, meta = classify(text, *asked)
                meta = dict(meta)
                name = meta.pop("model", None) or model
                body, usage = json.dumps(extraction), json.dumps(meta)
            except Exception as e:  # the user's classifier may raise anything
                error = f"{type(e).__name__}: {e}"
            return key, name, body, usage, int((time.perf_counter() - started) * 1000), error

        window: deque[tuple[str, bool, Future]] = deque()
        lately: OrderedDict[str, Future] = OrderedDict()

        def ask(calls: ThreadPoolExecutor, key: str, text: str) -> tuple[str, bool, Future]:
            if not ask_once:
                return key, True, calls.submit(one, key, text)
            known = lately.get(text)
            if known is None:
                known = lately[text] = calls.submit(one, key, text)
                if len(lately) > REMEMBERED:
                    lately.popitem(last=False)
                return key, True, known
            lately.move_to_end(text)
            return key, False, known

        def released(least: int) -> Iterator[tuple]:
            """Rows from the front of the window: those that are done, and more until ``least`` are left."""
            while window and (len(window) > least or window[0][2].done()):
                key, paid, call = window.popleft()
                row = call.result()
                yield (key, *row[1:3], row[3] if paid else None, *row[4:])

        with ThreadPoolExecutor(in_flight) as calls:
            for batch in batches:
                rows = []
                for key, text in zip(batch["ticket_key"], batch["text"]):
                    window.append(ask(calls, key, text))
                    rows += released(AHEAD * in_flight)
                if rows:
                    yield pd.DataFrame(rows, columns=columns)
            if window:
                yield pd.DataFrame(list(released(0)), columns=columns)

    answered = tickets.select("ticket_key", "text").mapInPandas(
        run, "ticket_key string, model string, extraction string, usage string, latency_ms long, error string"
    )
    return answered.select(
        "ticket_key",
        "model",
        F.from_json("extraction", EXTRACTION).alias("extraction"),
        F.from_json("usage", USAGE).alias("usage"),
        "latency_ms",
        "error",
    )
