"""The embedding client against a local stub."""

import base64
import hashlib
import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from manyvec.operators import client


class Stub:
    """Counts requests under way; ``fail`` gives a status for the n-th time a request is seen, or None."""

    def __init__(self, fail=lambda item, n: None, wait=0.01):
        self.now = self.most = 0
        self.keys, self.seen, self.lock, stub = {}, Counter(), threading.Lock(), self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = self.rfile.read(int(self.headers["Content-Length"]))
                kind, (item,) = next(iter(json.loads(body)["inputs"].items()))
                with stub.lock:
                    stub.now += 1
                    stub.most = max(stub.most, stub.now)
                    stub.seen[item] += 1
                    n = stub.seen[item]
                    stub.keys.setdefault(item, set()).add(self.headers["Idempotency-Key"])
                    stub.auth = self.headers.get("Authorization")
                time.sleep(wait * (1 + hash(item) % 3))
                with stub.lock:
                    stub.now -= 1
                status = fail(item, n)
                answer = b"no" if status == "odd" else json.dumps({"embeddings": [] if status == "empty" else [[[float(len(item)), 1.0]]]}).encode()
                self.send_response(status if isinstance(status, int) else 200)
                self.send_header("Content-Length", str(len(answer)))
                if status == 429:
                    self.send_header("Retry-After", "0.01")
                self.end_headers()
                self.wfile.write(answer)

            def log_message(self, *_):
                pass

        class Server(ThreadingHTTPServer):
            request_queue_size = 256

        self.server = Server(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/embed"

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.server.shutdown()
        self.server.server_close()


def test_order_is_kept_and_at_most_sixteen_are_in_flight():
    with Stub() as stub:
        items = [f"{'x' * (i % 37)}{i}" for i in range(150)]
        found = list(client.Endpoint(stub.url, (("Authorization", "Bearer t"),)).ordered("queries", iter(items)))
        assert found == [[[float(len(i)), 1.0]] for i in items]
        assert 8 < stub.most <= 16 and stub.auth == "Bearer t"


def test_passing_failures_are_sent_again_under_one_key():
    fail = lambda item, n: {1: 503, 2: 429}.get(n) if item.startswith("bad") else None
    with Stub(fail) as stub:
        items = ["good1", "bad1", "good2", "bad2", None, ""]
        found = list(client.Endpoint(stub.url, pause=0.01).ordered("queries", iter(items)))
        assert [x and x[0][0] for x in found] == [5.0, 4.0, 5.0, 4.0, None, 0.0]
        assert stub.seen["bad1"] == 3 and stub.seen["good1"] == 1 and all(len(k) == 1 for k in stub.keys.values())
        assert stub.keys["bad1"] == {hashlib.sha256(client.Endpoint(stub.url).body("queries", "bad1")).hexdigest()}


@pytest.mark.parametrize("status, said", [(400, "HTTP 400"), (503, "after 3 attempts"), ("odd", "no JSON"), ("empty", "one embedding")])
def test_final_failures_end_the_task(status, said):
    with Stub(lambda item, n: status if item == "b" else None) as stub:
        answers = client.Endpoint(stub.url, attempts=3, pause=0.01).ordered("queries", iter(["a", "b", "c"]))
        assert next(answers) == [[1.0, 1.0]]
        with pytest.raises(client.EndpointError, match=said):
            next(answers)
        assert stub.seen["b"] == (3 if status == 503 else 1)


def test_no_connection_is_a_passing_failure():
    with pytest.raises(client.EndpointError, match="after 2 attempts"):
        client.Endpoint("http://127.0.0.1:9/x", attempts=2, pause=0.01).one("queries", "a")


def test_rows_are_encoded_within_a_bound_of_all_tasks(spark):
    with Stub() as stub:
        rows = spark.createDataFrame([(i, None if i == 3 else "q" * i) for i in range(60)], "id long, text string")
        out = client.encoded_remotely(rows, "id", "text", "queries", client.Endpoint(stub.url, in_flight=3), tasks=2)
        found = {r["id"]: r["toks"] for r in out.collect()}
        assert found == {i: None if i == 3 else [[float(i), 1.0]] for i in range(60)}
        assert stub.most <= 6
        pictures = spark.createDataFrame([(1, bytearray(b"\xff\xd8jpeg"))], "id long, data binary")
        assert client.encoded_remotely(pictures, "id", "data", "images", client.Endpoint(stub.url)).count() == 1
        assert base64.b64encode(b"\xff\xd8jpeg").decode() in stub.seen
        assert client.encoded_remotely(rows.limit(0), "id", "text", "queries", client.Endpoint(stub.url)).count() == 0


def test_wrong_settings_are_refused(spark):
    with pytest.raises(ValueError):
        client.Endpoint("x", in_flight=0)
    with pytest.raises(ValueError):
        client.encoded_remotely(spark.range(1), "id", "id", "sounds", client.Endpoint("x"))


def test_payloads_hold_whole_images_in_one_line(spark):
    from pyspark.sql import functions as F

    from manyvec.functions import texts

    data = bytes(range(256)) * 3
    body = spark.createDataFrame([([bytearray(data)],)], "i array<binary>").select(texts.payload(F.col("i"), None)).first()[0]
    assert json.loads(body)["images"] == [base64.b64encode(data).decode()]
