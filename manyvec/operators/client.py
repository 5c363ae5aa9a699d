"""Token vectors from a remote embedding endpoint.

Each task sends its rows one request a row, at most ``in_flight`` at a time, and gives answers in the order of the rows: a
window of that many requests slides over the rows, so a task holds no more than that. Requests that fail for a passing
reason (no connection, time out, 408, 425, 429, 5xx) are sent again after a growing pause, or the one the server asks for; every
time with the same idempotency key, a digest of the request, so that a server can tell a repeated request, also one that a
repeated task sends. Other failures are final.

Spark runs many tasks at once: with ``tasks`` the rows are dealt into so many partitions, hence at most tasks * in_flight
requests are under way altogether. A null input is not sent and has null vectors; an empty text is sent."""

from __future__ import annotations

import base64
import hashlib
import json
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("queries", "images")
PASSING = frozenset({408, 425, 429, 500, 502, 503, 504})


class EndpointError(RuntimeError):
    """A request that failed for good."""


class Passing(Exception):
    """A failure that may pass; ``after`` are seconds the server asks to wait."""

    def __init__(self, reason: str, after: float | None = None):
        super().__init__(reason)
        self.after = after


def over_http(url: str, body: bytes, headers: dict[str, str], timeout: float) -> dict:
    """One POST; raises Passing or EndpointError."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        if e.code not in PASSING:
            raise EndpointError(f"HTTP {e.code}") from e
        after = e.headers.get("Retry-After", "")
        raise Passing(f"HTTP {e.code}", float(after) if after.replace(".", "", 1).isdigit() else None) from e
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise Passing(str(e)) from e
    except ValueError as e:
        raise EndpointError("the answer is no JSON") from e


@dataclass(frozen=True)
class Endpoint:
    """Where and how requests are sent; ``headers`` go with each, and ``send`` may be replaced for another transport."""

    url: str
    headers: tuple[tuple[str, str], ...] = ()
    in_flight: int = 16
    attempts: int = 5
    pause: float = 0.5
    longest_pause: float = 30.0
    timeout: float = 60.0
    send: Callable[[str, bytes, dict[str, str], float], dict] = field(default=over_http)

    def __post_init__(self):
        if self.in_flight < 1 or self.attempts < 1:
            raise ValueError("in_flight and attempts must be positive")

    def body(self, kind: str, item) -> bytes:
        """The request of one item: texts as they are, images (encoded bytes) in base64."""
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
        return json.dumps({"inputs": {kind: [base64.b64encode(bytes(item)).decode() if kind == "images" else item]}}).encode()

    def one(self, kind: str, item) -> list[list[float]]:
        """The token vectors of one item."""
        body = self.body(kind, item)
        headers = {"Accept": "application/json", "Content-Type": "application/json", "Idempotency-Key": hashlib.sha256(body).hexdigest(), **dict(self.headers)}
        for attempt in range(self.attempts):
            try:
                found = self.send(self.url, body, headers, self.timeout).get("embeddings")
            except Passing as e:
                if attempt + 1 == self.attempts:
                    raise EndpointError(f"{e} after {self.attempts} attempts") from e
                time.sleep(min(self.longest_pause, self.pause * 2**attempt if e.after is None else e.after))
            else:
                if not isinstance(found, list) or len(found) != 1:
                    raise EndpointError("the answer does not hold one embedding")
                return found[0]
        raise AssertionError

    def ordered(self, kind: str, items: Iterator) -> Iterator[list[list[float]] | None]:
        """Answers in the order of the items, with at most ``in_flight`` requests under way."""
        with ThreadPoolExecutor(self.in_flight) as pool:
            window: deque = deque()
            try:
                for item in items:
                    if len(window) == self.in_flight:
                        yield window.popleft().result()
                    window.append(pool.submit(lambda x=item: None if x is None else self.one(kind, x)))
                while window:
                    yield window.popleft().result()
            finally:
                for f in window:
                    f.cancel()


def encoded_remotely(rows: DataFrame, key: str, column: str, kind: str, endpoint: Endpoint, tasks: int | None = None) -> DataFrame:
    """(key, toks): the vectors of ``column``, texts or encoded images, in the order of each partition's rows."""
    endpoint.body(kind, b"" if kind == "images" else "")  # a wrong kind is an error here, not on an executor
    picked = rows.select(key, column)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: deque = deque()

        def items() -> Iterator:
            for pdf in parts:
                for k, item in zip(pdf[key], pdf[column]):
                    keys.append(k)
                    yield item

        lot: list[tuple] = []
        for toks in endpoint.ordered(kind, items()):
            lot.append((keys.popleft(), toks))
            if len(lot) == 256:
                yield pd.DataFrame(lot, columns=[key, "toks"])
                lot = []
        if lot:
            yield pd.DataFrame(lot, columns=[key, "toks"])

    dealt = picked if tasks is None else picked.repartition(tasks)
    return dealt.mapInPandas(run, f"`{key}` {dict(picked.dtypes)[key]}, toks array<array<double>>")
