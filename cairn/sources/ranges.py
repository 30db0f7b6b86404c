"""Byte ranges of files over HTTP: every answer is held against what was asked for before its bytes are used.

A range is asked for with ``Range: bytes=a-b``. What can come back is told apart: part of a file with the range asked for
(206), the whole file (``RangeIgnored``), another range (``RangeMismatch``), nothing there (``RangeOutside``), another place
(``Redirected``, or followed, where allowed, with the same range), a refusal (``RangeRefused``), or fewer bytes than
announced, after which the rest is asked for from where it broke off. Refusals that may pass (408, 425, 429 and those of the server)
and broken connections are tried again, each range on its own and ``tries`` times in all; then ``RangeFailed`` or
``RangeShort`` names what is missing.
"""

from __future__ import annotations

import http.client
import re
import time
import urllib.parse

#: Answers after which the same request may succeed; fixed values.
PASSING = {408, 425, 429, 500, 502, 503, 504}
MOVED = {301, 302, 303, 307, 308}


class RangeError(OSError):
    """A range could not be read as asked for."""


class RangeIgnored(RangeError):
    """The whole file was sent instead of a part."""


class RangeMismatch(RangeError):
    """Another range was sent, or one of another file size."""


class RangeOutside(RangeError):
    """The file ends before the range begins."""


class RangeRefused(RangeError):
    """The request was refused for what it asks."""


class RangeShort(RangeError):
    """Bytes are missing at the end, after all tries."""


class RangeFailed(RangeError):
    """No try came to an answer."""


class Redirected(RangeError):
    """The file is said to be elsewhere."""


class HttpFile:
    """A file at ``url``; ``read_at`` as of pyarrow's files. One connection, kept open from range to range."""

    def __init__(self, url: str, tries: int = 4, wait: float = 0.2, timeout: float = 30.0, follow: int = 0, headers: dict[str, str] | None = None):
        self.url, self.tries, self.wait, self.timeout, self.follow, self.headers = url, tries, wait, timeout, follow, headers or {}
        self._at, self._connection = url, None
        self.size: int | None = None

    def __enter__(self) -> HttpFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self._connection is not None:
            self._connection.close()
            self._connection = None

    def read_at(self, n_bytes: int, offset: int) -> bytes:
        """Exactly ``n_bytes`` from ``offset`` on."""
        if n_bytes <= 0 or offset < 0:
            raise ValueError("a range has a place and a length")
        got, last, moves = bytearray(), "", 0
        tried = 0
        while len(got) < n_bytes:
            if tried == self.tries:
                kind = RangeShort if got else RangeFailed
                raise kind(f"{self.url}: {len(got)} of {n_bytes} bytes at {offset} after {tried} tries; {last}")
            if tried:
                time.sleep(self.wait * 2 ** (tried - 1))
            tried += 1
            try:
                elsewhere = self._some(got, n_bytes, offset)
            except (http.client.HTTPException, ConnectionError, TimeoutError) as e:
                last = f"{type(e).__name__}: {e}"
                self.close()
                continue
            except _Passing as e:
                last = str(e)
                continue
            if elsewhere:
                if moves == self.follow:
                    raise Redirected(f"{self.url} is said to be at {elsewhere}")
                moves, tried = moves + 1, tried - 1
                self.close()
                self._at = elsewhere
        return bytes(got)

    def _some(self, got: bytearray, n_bytes: int, offset: int) -> str | None:
        """Adds what one answer brings; where the file is said to be elsewhere, its place."""
        first, last = offset + len(got), offset + n_bytes - 1
        place = urllib.parse.urlsplit(self._at)
        if self._connection is None:
            kind = http.client.HTTPSConnection if place.scheme == "https" else http.client.HTTPConnection
            self._connection = kind(place.netloc, timeout=self.timeout)
        target = urllib.parse.urlunsplit(("", "", place.path or "/", place.query, ""))
        self._connection.request("GET", target, headers=self.headers | {"Range": f"bytes={first}-{last}", "Accept-Encoding": "identity"})
        answer = self._connection.getresponse()
        asked = f"{self.url}, bytes {first} to {last}"
        if answer.status == 206:
            self._checked(answer, first, last, asked)
            self._take(answer, got, last - first + 1)
            return None
        # What else is sent is of no use, and may be a whole archive: the connection is given up.
        self.close()
        if answer.status in MOVED:
            return urllib.parse.urljoin(self._at, answer.headers.get("Location", ""))
        if answer.status == 200:
            raise RangeIgnored(f"{asked}: the whole file was sent")
        if answer.status == 416:
            raise RangeOutside(f"{asked}: outside of the file ({answer.headers.get('Content-Range', 'of unknown size')})")
        if answer.status in PASSING:
            raise _Passing(f"status {answer.status}")
        raise RangeRefused(f"{asked}: status {answer.status}")

    def _checked(self, answer: http.client.HTTPResponse, first: int, last: int, asked: str) -> None:
        """That the answer is of the range asked for, or of its beginning where the file ends within it."""
        found = re.fullmatch(r"bytes (\d+)-(\d+)/(\d+|\*)", answer.headers.get("Content-Range", ""))
        size = None if not found or found[3] == "*" else int(found[3])
        sent = answer.headers.get("Content-Length")
        wrong = not found or int(found[1]) != first or int(found[2]) > last or int(found[2]) < first
        wrong = wrong or (sent is not None and int(sent) != int(found[2]) - first + 1) or (None not in (size, self.size) and size != self.size)
        if wrong:
            self.close()
            raise RangeMismatch(f"{asked}: {answer.headers.get('Content-Range')!r} of {sent} bytes was sent")
        self.size = size if size is not None else self.size
        if size is not None and last >= size:
            self.close()
            raise RangeOutside(f"{asked}: the file ends at {size}")

    def _take(self, answer: http.client.HTTPResponse, got: bytearray, most: int) -> None:
        """Reads what is sent, at most ``most`` bytes; what came before a connection broke is kept."""
        while most:
            try:
                piece = answer.read(min(most, 1 << 20))
            except http.client.IncompleteRead as e:
                got += e.partial[:most]
                raise
            if not piece:
                raise http.client.IncompleteRead(b"", most)
            got += piece
            most -= len(piece)


class _Passing(Exception):
    """An answer after which the request is sent again."""
