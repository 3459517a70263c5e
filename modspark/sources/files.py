"""Bytes of files by range, wherever pyarrow can open them, and of URLs whose servers give ranges."""

from __future__ import annotations

import io
import os
import shutil
import sys
import tempfile
import urllib.error
import urllib.request
from urllib.parse import urlsplit

from modspark.options import Locator

#: Bytes that one request for a range asks for, at least.
AHEAD = 1 << 18


class Ranged(io.RawIOBase):
    """A URL as a seekable file: each read is a request for a range."""

    def __init__(self, url: str) -> None:
        self.url, self.place = url, 0
        with self._ask("bytes=0-0") as r:
            if r.status != 206:
                raise OSError(f"no ranges of {url}")
            self.length = int(r.headers["Content-Range"].rpartition("/")[2])

    def _ask(self, span: str):
        return urllib.request.urlopen(urllib.request.Request(self.url, headers={"Range": span}))

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> int:
        self.place = offset + {os.SEEK_SET: 0, os.SEEK_CUR: self.place, os.SEEK_END: self.length}[whence]
        return self.place

    def readinto(self, buffer) -> int:
        end = min(self.place + len(buffer), self.length)
        if self.place >= end:
            return 0
        with self._ask(f"bytes={self.place}-{end - 1}") as r:
            found = r.read()
        buffer[: len(found)] = found
        self.place += len(found)
        return len(found)


def opened(path: str):
    """A seekable binary file: a local path, file://, a URL, or any URI that pyarrow has a file system for."""
    scheme = urlsplit(path).scheme
    if len(scheme) < 2 or scheme == "file":
        return open(urlsplit(path).path if scheme else path, "rb")
    if scheme in ("http", "https"):
        return io.BufferedReader(Ranged(path), AHEAD)
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def exists(path: str) -> bool:
    try:
        with opened(path):
            return True
    except OSError:  # also what a server answers
        return False


def size(path: str) -> int:
    with opened(path) as f:
        return f.seek(0, os.SEEK_END)


def is_bam(path: str) -> bool:
    """By its first bytes: BAM is compressed in blocks, SAM is text."""
    with opened(path) as f:
        return f.read(2) == b"\x1f\x8b"


def staged(locator: str, folder: str | None = None, stdin=None) -> str:
    """A path for a locator: a URL whose server gives ranges is one; others, and standard input, are first copied into a folder.

    folder: on a cluster one that all executors see; it is filled by the driver once. The copy's
    name ends in .bam or .sam by what is in it.
    """
    found = Locator.parse(locator)
    if found.kind == "path" or (found.kind == "url" and not found.value.startswith("ftp") and exists(found.value)):
        return found.value
    handle, to = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "wb") as out:
        if found.kind == "stdin":
            shutil.copyfileobj(stdin or sys.stdin.buffer, out)
        else:
            with urllib.request.urlopen(found.value) as source:
                shutil.copyfileobj(source, out)
    named = f"{to}.bam" if is_bam(to) else f"{to}.sam"
    os.rename(to, named)
    return named
