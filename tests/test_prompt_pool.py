"""Concurrent requests: a local service never sees more than allowed, and no row is lost or asked too often."""

import collections
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from cairn.operators import prompts as M


class Service(BaseHTTPRequestHandler):
    """Answers after a moment; counts how many requests it works on at once; fails as the prompt says."""

    def log_message(self, *_):
        pass

    def do_POST(self):
        s = self.server
        said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][-1]["content"]
        with s.lock:
            s.now += 1
            s.most = max(s.most, s.now)
            s.asked[str(said)] += 1
            n = s.asked[str(said)]
        time.sleep(1.0 if "slow" in said else 0.01)
        status = 503 if "flaky" in said and n == 1 else 400 if "bad" in said else 200
        body = json.dumps({"choices": [{"message": {"content": f"re: {said if isinstance(said, str) else said[1]['image_url']['url']}"}}]}).encode() if status == 200 else b""
        with s.lock:
            s.now -= 1
        try:
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)
        except ConnectionError:
            pass


@pytest.fixture
def service():
    made = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    made.lock, made.now, made.most, made.asked = threading.Lock(), 0, 0, collections.Counter()
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield made
    made.shutdown()
    made.server_close()


def test_no_more_than_allowed_at_once_and_no_row_lost(spark, service):
    port = service.server_port
    build = lambda: M.HttpPrompter(f"http://127.0.0.1:{port}", "m", retries=2, wait=0.01, timeout=10)
    rows = spark.range(200).select("id", F.concat(F.lit("row "), F.col("id"), F.when(F.col("id") % 10 == 3, " flaky").when(F.col("id") % 50 == 7, " bad").otherwise("")).alias("p")).repartition(2)
    got = M.prompt(rows, build, "id", "p", concurrency=3, parts=2).collect()
    assert sorted(r.id for r in got) == list(range(200))
    assert 2 <= service.most <= 2 * 3  # two tasks, three requests each
    for r in got:
        if r.id % 50 == 7 and r.id % 10 != 3:
            assert r.status == "failed" and "400" in r.error
            assert service.asked[f"row {r.id} bad"] == 2  # asked, and once more; neither is sent again below that
        else:
            assert r.status == "success" and r.response == "re: row %d%s" % (r.id, " flaky" if r.id % 10 == 3 else "")
    assert all(n == (2 if "flaky" in p or "bad" in p else 1) for p, n in service.asked.items())


def test_late_answers_are_told_and_keep_their_place(spark, service):
    port = service.server_port
    build = lambda: M.HttpPrompter(f"http://127.0.0.1:{port}", "m", retries=1, timeout=10)
    rows = spark.createDataFrame([(i, "slow" if i == 2 else f"row {i}") for i in range(8)], "id int, p string").coalesce(1)
    got = {r.id: r for r in M.prompt(rows, build, "id", "p", concurrency=2, deadline=0.3, parts=1).collect()}
    assert got[2].status == "timeout" and all(got[i].status == "success" for i in got if i != 2) and len(got) == 8
    assert service.most <= 2


def test_pool_takes_requests_as_places_fall_free():
    taken, gate = [], threading.Event()

    def requests():
        for i in range(10):
            taken.append(i)
            yield i, f"p{i}"

    def one(text, system):
        gate.wait(5)
        return text

    answers = M.Pool(one, 3).ask(requests())
    threading.Timer(0.2, lambda: (taken.append(len(taken)), gate.set())).start()
    assert sorted(answers) == [(i, f"p{i}") for i in range(10)]
    assert taken[3] == 3 and taken[:3] == [0, 1, 2]  # three were taken before any had ended


def test_errors_are_answers_and_places_are_given_back():
    def one(text, system):
        if text == "odd":
            raise ConnectionError("lost")
        return text

    pool = M.Pool(one, 1)
    for _ in range(3):
        got = dict(pool.ask([(1, "odd"), (2, "b")]))
        assert isinstance(got[1], ConnectionError) and got[2] == "b"
    assert dict(pool.ask([])) == {}
    with pytest.raises(ValueError):
        M.Pool(one, 0)


def test_images_are_sent_as_parts(spark, service):
    port = service.server_port
    build = lambda: M.HttpPrompter(f"http://127.0.0.1:{port}", "m")
    rows = spark.createDataFrame([(1, "what?", bytearray(b"abc"))], "id int, p string, c binary")
    got = M.prompt(rows.withColumn("q", M.with_image(F.col("p"), F.col("c"))), build, "id", "q", concurrency=2).first()
    assert got.response == "re: data:image/png;base64,YWJj"


def test_one_request_at_a_time_needs_no_pool(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, p string")
    build = lambda: M.TablePrompter({"a": "yes"})
    for options in ({}, {"concurrency": 4}, {"deadline": 5.0}):
        assert {(r.id, r.response, r.status) for r in M.prompt(rows, build, "id", "p", **options).collect()} == {(1, "yes", "success"), (2, None, "skipped")}
    with pytest.raises(ValueError):
        M.prompt(rows, build, "id", "p", concurrency=0)
