"""Ranges over HTTP against a server that misbehaves, and manifests as tables."""

import gzip
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from cairn.sources import ranges, records

DATA = bytes(i * 7 % 251 for i in range(100_000))


class Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def log_message(self, *_):
        pass

    def do_GET(self):
        server, name = self.server, self.path.strip("/")
        with server.lock:
            server.asked.append((name, self.headers.get("Range")))
            n = server.seen[name] = server.seen.get(name, 0) + 1
        a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
        data = server.files.get(name, DATA)
        if name.startswith("busy") and n < 3:
            return self.plain(503)
        if name == "gone":
            return self.plain(404)
        if name == "whole":
            return self.plain(200, DATA)
        if name.startswith("moved"):
            return self.plain(302, headers={"Location": "/good" if name == "moved" else "/moved-again"})
        if a >= len(data):
            return self.plain(416, headers={"Content-Range": f"bytes */{len(data)}"})
        part = data[a : b + 1]
        first = a + 1 if name == "shifted" else a
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {first}-{a + len(part) - 1}/{len(data) + (n if name == 'growing' else 0)}")
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        broken = name == "stub" or (name == "breaks" and n < 3)
        self.wfile.write(part[: len(part) // 3] if broken else part)
        if broken:
            self.wfile.flush()
            self.close_connection = True

    def plain(self, status, body=b"", headers=None):
        self.send_response(status)
        for k, v in (headers or {}).items():
            self.send_header(k, v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        try:
            self.wfile.write(body)
        except ConnectionError:
            pass


@pytest.fixture
def server():
    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    made.lock, made.asked, made.seen, made.files = threading.Lock(), [], {}, {}
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield made
    made.shutdown()
    made.server_close()


def at(server, name, **options):
    return ranges.HttpFile(f"http://127.0.0.1:{server.server_port}/{name}", wait=0.001, timeout=5, **options)


def test_exact_ranges_over_one_connection(server):
    with at(server, "good") as file:
        assert [file.read_at(n, o) for o, n in ((0, 1), (5, 10), (99_990, 10))] == [DATA[:1], DATA[5:15], DATA[99_990:]]
        assert file.size == len(DATA)
        with pytest.raises(ValueError):
            file.read_at(0, 5)


def test_what_comes_back_is_told_apart(server):
    for name, error in (("whole", ranges.RangeIgnored), ("gone", ranges.RangeRefused), ("moved", ranges.Redirected), ("shifted", ranges.RangeMismatch)):
        with at(server, name) as file, pytest.raises(error):
            file.read_at(100, 10)
        assert server.seen[name] == 1
    with at(server, "good") as file:
        with pytest.raises(ranges.RangeOutside):
            file.read_at(10, len(DATA))
        with pytest.raises(ranges.RangeOutside):
            file.read_at(10, len(DATA) - 5)
        assert file.read_at(10, 0) == DATA[:10]
    with at(server, "growing") as file, pytest.raises(ranges.RangeMismatch):
        file.read_at(5, 0), file.read_at(5, 5)


def test_refusals_that_pass_and_broken_reads_are_tried_again(server):
    with at(server, "busy") as file:
        assert file.read_at(100, 7) == DATA[7:107] and server.seen["busy"] == 3
    with at(server, "breaks") as file:
        assert file.read_at(9000, 50) == DATA[50:9050]
    asked = [r for n, r in server.asked if n == "breaks"]
    assert asked == ["bytes=50-9049", "bytes=3050-9049", "bytes=5050-9049"]  # each goes on where the one before broke off
    with at(server, "stub", tries=3) as file, pytest.raises(ranges.RangeShort):
        file.read_at(9000, 0)
    with at(server, "busy2", tries=2) as file, pytest.raises(ranges.RangeFailed):
        file.read_at(10, 0)


def test_redirects_are_followed_so_far(server):
    with at(server, "moved", follow=1) as file:
        assert file.read_at(10, 3) == DATA[3:13]
    with at(server, "moved-again", follow=3) as file, pytest.raises(ranges.Redirected):
        file.read_at(10, 3)


def record(url, html):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + html
    return gzip.compress(b"WARC/1.0\r\nWARC-Target-URI: " + url.encode() + b"\r\nWARC-Record-ID: <r>\r\nContent-Length: " + str(len(http)).encode() + b"\r\n\r\n" + http + b"\r\n\r\n")


def archive(server, name, n):
    """An archive of ``n`` records on the server, and its manifest."""
    data, specs = b"", []
    for i in range(n):
        r = record(f"http://h{i % 3}/{i}", b"<p>%d</p>" % i)
        specs.append({"path": f"http://127.0.0.1:{server.server_port}/{name}", "offset": len(data), "length": len(r), "url": f"http://h{i % 3}/{i}"})
        data += r
    server.files[name] = data
    return specs


def test_records_over_http(spark, server):
    specs = archive(server, "busy-archive", 5) + archive(server, "b", 4)
    got = records.read_records(spark, specs).collect()
    assert sorted((r.path, r.url, bytes(r.html)) for r in got) == sorted((s["path"], s["url"], b"<p>%s</p>" % s["url"].rsplit("/", 1)[1].encode()) for s in specs)


def test_filters_prune_ranges_before_any_read(spark, server, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "TASK_RECORDS", 8)
    specs = archive(server, "big", 100)
    folder = records.write_manifest_table(specs, f"file://{tmp_path}/manifest", spark)
    rows = records.read_records(spark, folder)
    assert rows.where("url = 'http://h1/7'").count() == 1 and len(server.asked) == 1
    server.asked.clear()
    assert sorted(r.url for r in rows.where("url in ('http://h0/0', 'http://h0/99', 'none')").collect()) == ["http://h0/0", "http://h0/99"] and len(server.asked) == 2
    server.asked.clear()
    assert rows.where(f"offset < {specs[3]['offset']} and startswith(url, 'http://h1')").count() == 1 and len(server.asked) == 1
    assert rows.where("path = 'elsewhere'").count() == 0 and len(server.asked) == 1
    assert rows.count() == 100


def test_urls_that_the_manifest_leaves_open_are_read(spark, server):
    specs = [s | {"url": None} for s in archive(server, "open", 6)]
    assert records.read_records(spark, specs).where("url = 'http://h1/4'").count() == 1


def test_manifests_with_errors_are_not_written(spark):
    good = {"path": "a", "offset": 0, "length": 10}
    for odd in ({"path": "a", "offset": 9, "length": 5}, {"path": "b", "offset": -1, "length": 5}, {"path": "b", "offset": 1, "length": 0}, {"path": None, "offset": 1, "length": 1}):
        with pytest.raises(records.RecordError):
            records.read_records(spark, [good, odd])
    assert records.read_records(spark, []).count() == 0
