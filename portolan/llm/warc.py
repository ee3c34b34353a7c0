"""WARC files: a writer, and a sequential reader that checks what it reads.

Each record is a gzip member of its own. The reader decompresses step by step
from a stream, frames a record's block by its Content-Length, and compares
the digests; memory is bounded by one record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.session import materialize, new_table_path, ship_code

CHUNK = 1 << 16
MAGIC = b"\x1f\x8b\x08"
RECORD = "file string, offset long, record_id string, type string, uri string, date string, page_id long, content_length long, digest string, status string, block binary"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_value(x: str) -> str:
    return x.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in x or "\n" in x else x


def record(block: bytes, uri: str | None, page_id: int | None, kind: str = "resource", date: str = "2024-01-01T00:00:00Z", level: int = 6) -> bytes:
    """One record as a gzip member. A null uri or id has no header line."""
    digest = _sha1(block)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{uri}|{digest}")
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_header_value(uri)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"WARC-Block-Digest: {digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n") + c.compress(block) + c.compress(b"\r\n\r\n") + c.flush()


class _Bytes:
    """A stream with one pushed-back buffer and a count of what was taken."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.held, self.at = stream, b"", 0

    def take(self) -> bytes:
        data, self.held = (self.held, b"") if self.held else (self.stream.read(CHUNK), b"")
        self.at += len(data)
        return data

    def back(self, data: bytes) -> None:
        self.held = data + self.held
        self.at -= len(data)

    def seek_magic(self) -> bool:
        """Skip to the next place where a gzip member may begin."""
        window = b""
        while True:
            k = window.find(MAGIC)
            if k >= 0:
                self.back(window[k:])
                return True
            data = self.take()
            if not data:
                return False
            window = window[-2:] + data


def _headers(head: bytes) -> dict[str, str] | None:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, v = line.partition(":")
            last = last.strip().lower()
            out[last] = v.strip()
    return out


def _agrees(given: str, data: bytes) -> bool | None:
    """Whether a digest line is that of ``data``, in hexadecimal, base32 or base64; None for an algorithm that isn't known."""
    name, _, value = given.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None
    made, value = hashlib.new(name, data).digest(), value.strip()
    return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=") or value.rstrip("=") in (base64.b64encode(made).decode().rstrip("="), base64.urlsafe_b64encode(made).decode().rstrip("="))


def _digest_status(h: dict[str, str], block: bytes) -> str:
    """The block's digest, and the payload's: of an HTTP message what follows its header, else the block. A revisit's payload is elsewhere."""
    found = []
    if "warc-block-digest" in h:
        found.append(_agrees(h["warc-block-digest"], block))
    if "warc-payload-digest" in h and h.get("warc-type", "").lower() != "revisit":
        http = h.get("content-type", "").replace(" ", "").lower().startswith("application/http")
        found.append(_agrees(h["warc-payload-digest"], block.partition(b"\r\n\r\n")[2] if http else block))
    known = [x for x in found if x is not None]
    return "no_digest" if not known else "ok" if all(known) else "digest_mismatch"


def records(stream: BinaryIO) -> Iterator[dict]:
    """Each record of a .warc.gz stream, in order, with a status.

    ok: framed, and its digests agree, those of the block and of the payload;
    no_digest: framed, but none is given of an algorithm that is known;
    digest_mismatch; length_mismatch: the block isn't followed by the blank
    lines where Content-Length puts its end; malformed: no WARC header or
    length; corrupt: the member isn't valid gzip, and reading goes on at the
    next one; truncated: the file ends within the member. All but ok and
    no_digest give the block as far as it could be framed.
    """
    src = _Bytes(stream)
    while True:
        first = src.take()
        if not first:
            return
        start = src.at - len(first)
        inflate = zlib.decompressobj(31)
        head, headers, want = b"", None, -1
        body, size, tail, status = [], 0, b"", None
        data = first
        while True:
            try:
                out = inflate.decompress(data, CHUNK * 4)
            except zlib.error:
                status = "corrupt"
                # Whatever follows this member's own magic may hold the next one.
                src.back(data[3:] if data is first and data.startswith(MAGIC) else data[1:] if data is first else data)
                break
            if headers is None:
                seen = max(0, len(head) - 3)
                head += out
                cut = head.find(b"\r\n\r\n", seen)
                if cut < 0 and len(head) >= 5 and not head.startswith(b"WARC/"):
                    headers, out = {}, b""  # no WARC record; nothing of it is held
                elif cut >= 0:
                    headers, out = _headers(head[:cut]) or {}, head[cut + 4 :]
                    length = headers.get("content-length", "")
                    want = int(length) if length.isdigit() else -1
                else:
                    out = b""
            if out and want >= 0:
                part, out = out[: want - size], out[max(0, want - size) :]
                body.append(part)
                size += len(part)
                tail = (tail + out)[:8]
            if inflate.eof:
                src.back(inflate.unused_data)
                break
            data = inflate.unconsumed_tail or src.take()
            if not data:
                status = "truncated"
                break
        h, block = headers or {}, b"".join(body)
        if status is None:
            if not h or want < 0:
                status = "malformed"
            elif size != want or tail != b"\r\n\r\n":
                status = "length_mismatch"
            else:
                status = _digest_status(h, block)
        uri = h.get("warc-target-uri")
        if uri is not None and ("%0D" in uri or "%0A" in uri):
            uri = uri.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
        page = h.get("x-page-id", "")
        yield {
            "offset": start, "record_id": h.get("warc-record-id"), "type": h.get("warc-type"), "uri": uri, "date": h.get("warc-date"),
            "page_id": int(page) if page.lstrip("-").isdigit() else None, "content_length": want if want >= 0 else None,
            "digest": hashlib.sha1(block).hexdigest(), "status": status, "block": block,
        }
        if status == "truncated" or (status == "corrupt" and not src.seek_magic()):
            return


def _open(path: str, mode: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
    return system, at, (system.open_input_stream(at, compression=None) if mode == "r" else None)


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", uri: str = "url", html: str = "html") -> DataFrame:
    """One .warc.gz file for each partition of ``pages`` under ``path``; gives (file, n_records).

    A task writes under a name of its attempt and renames it when done, so a
    task that is run again leaves one file. A null page is written as an empty
    block; other columns aren't written; an empty partition makes no file.
    """
    ship_code(pages.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():06d}.warc.gz"
        out, n, system, at = None, 0, None, None
        for pdf in batches:
            for k, u, t in zip(pdf["k"], pdf["u"], pdf["t"]):
                if out is None:
                    system, at, _ = _open(name, "w")
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    temp = f"{at}.{task.taskAttemptId()}.tmp"
                    out = system.open_output_stream(temp, compression=None)
                out.write(record((t or "").encode("utf-8", "surrogatepass"), u, None if k is None else int(k)))
                n += 1
        if out is not None:
            out.close()
            system.move(temp, at)
            yield pd.DataFrame({"file": [name], "n_records": [n]})

    rows = pages.select(F.col(f"`{page_id}`").cast("string").alias("k"), F.col(f"`{uri}`").alias("u"), F.col(f"`{html}`").alias("t"))
    return materialize(rows.mapInPandas(write, "file string, n_records long"), "warc-files")


def read_warc(files: DataFrame, file: str = "file") -> DataFrame:
    """The records of the .warc.gz files that column ``file`` names, each read by one task from start to end.

    Every record gives a row, whatever its status (see ``records``); a record
    of any size is one row. A file named twice is read twice, null names are
    left out, an empty file or table gives no rows, and a file that isn't
    there is an error. Paths are opened with pyarrow.fs, so they may be
    file:, hdfs: or s3: URIs.
    """
    spark = files.sparkSession
    ship_code(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["file"]:
                held, size = [], 0
                _, _, stream = _open(name, "r")
                with stream:
                    for r in records(stream):
                        held.append({"file": name, **r})
                        size += len(r["block"])
                        if size > 8_000_000:
                            yield _records_frame(held)
                            held, size = [], 0
                if held:
                    yield _records_frame(held)

    names = files.select(F.col(f"`{file}`").alias("file")).dropna()
    n = max(1, names.count())
    return names.repartition(min(n, 100_000), "file").mapInPandas(read, RECORD)


def _records_frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    for c in ("page_id", "content_length"):
        out[c] = out[c].astype("Int64")
    return out


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``pages`` written as WARC into the shared folder and read back: page_id, url, html, content_length, digest and status.

    A null html comes back empty; null ids and urls stay null; repeated rows
    come back as often as they went in.
    """
    path = new_table_path(spark, "warc")
    back = read_warc(write_warc(pages, path))
    return back.select("page_id", F.col("uri").alias("url"), F.col("block").cast("string").alias("html"), "content_length", "digest", "status")


ROUND_TRIP_SQL = "SELECT page_id, url, html, octet_length(encode(html))::BIGINT AS content_length, sha1(html) AS digest, 'ok' AS status FROM pages"
