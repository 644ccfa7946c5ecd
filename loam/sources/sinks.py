"""Sinks that push documents to another service in batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row


def push_batches(docs: DataFrame, send: Callable[[str, dict[str, str]], None], size: int = 100, token: str = "") -> None:
    """Send each partition's documents as ``{"ops": [...]}``, at most ``size`` (1 to 100) at a time, with the headers of a JSON request.

    A part of the table is one task; a task that is run again sends again, so the receiver must replace by URL.
    """
    size = max(1, min(100, size))
    headers = {"Content-Type": "application/json", **({"X-Access-Token": token} if token else {})}

    def each(rows: Iterator[Row]) -> None:
        held: list[dict] = []
        for r in rows:
            held.append(r.asDict())
            if len(held) == size:
                send(json.dumps({"ops": held}), headers)
                held = []
        if held:
            send(json.dumps({"ops": held}), headers)

    docs.select("url", "title", "host", "fetched_at", "body").foreachPartition(each)
