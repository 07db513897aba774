"""WARC archives with a two-level capture index.

Tasks write one archive each below the shared folder, a gzip member per record, and return
where every record lies. Captures are sorted by reversed-host URL key (then id) across index
files; an index file is a run of compressed blocks of `block_lines` captures, followed by its
sparse directory: each block's first key and place. A search picks the index file by its
first key (one short row a file), binary-searches that file's directory, reads the one block
by range, binary-searches it, and reads the record by range. Reading all pages back goes the
same way: every (key, id) asked for is searched, and the records found are read by range.

Every attempt of a task writes under a name of its own, so a repeated task never meets a
half-written file; rows point only at files of attempts that ended well.

Payloads are equal if their SHA-1, a second digest and their length are. Defined results: null
html is an empty payload, a null url has the empty key, a url that can't be parsed its own
text, stripped and in lower case, as key; other columns are not read; the record of
the smallest page_id among equal payloads of at least `min_revisit` bytes is the response and
the others are revisits of it (equal rows with that id are responses all); page_id null
sorts last; an empty table gives empty archives and frames.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, map_rows, scratch

_CAPTURE = "url_key string, page_id long, file string, offset long, length long"
_IDS = ("page_id", "first_id", "refers_to")
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url: str | None) -> str:
    """com,example,www)/path?query: the host reversed, without scheme, port 80 or 443 and fragment, lower case."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
    except ValueError:  # brackets that hold no address, characters that change under normalisation
        return url.lower()
    if not parts.netloc:
        return url.lower()
    host, _, port = parts.netloc.rpartition("@")[2].lower().partition(":")
    at = ",".join(reversed(host.split("."))) + (f":{port}" if port not in ("", "80", "443") else "")
    return f"{at}){parts.path.lower() or '/'}" + (f"?{parts.query.lower()}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, sha1: str) -> bytes:
    """A WARC/1.1 record; a revisit names the payload's size and digest and holds no payload."""
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Target-URI": (url or "").replace("\r", " ").replace("\n", " "), "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{sha1}", "X-Page-Id": "" if page_id is None else str(page_id), "X-Payload-Length": str(len(payload)),
    }
    if kind == "revisit":
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To": str(refers_to)}
    body = b"" if kind == "revisit" else payload
    head |= {"Content-Type": "text/html", "Content-Length": str(len(body))}
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in head.items()), "", ""]).encode("utf-8", "replace") + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """_RECORD's fields of one record; a response's size and digest come from its payload."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(head["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    n, sha1, kind = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    if kind == "response":
        n, sha1 = len(body), digest(body)
        if f"sha1:{sha1}" != head["WARC-Payload-Digest"]:
            raise ValueError("a payload doesn't match its digest")
    return int(head["X-Page-Id"]) if head["X-Page-Id"] else None, head["WARC-Target-URI"], n, sha1, kind, int(head["X-Refers-To"]) if "X-Refers-To" in head else None, body


@dataclass(frozen=True)
class Archive:
    """root: the folder; captures: where each record lies; files: first key and id of each index file."""

    spark: SparkSession
    root: str
    captures: DataFrame
    files: DataFrame

    def firsts(self) -> list[tuple[tuple, str]]:
        """First (key, id) and name of each index file, sorted: one short row a partition of the index."""
        return sorted(((r["first_key"], *_last_if_null(r["first_id"])), r["file"]) for r in self.files.collect())


def _last_if_null(i: int | None) -> tuple[bool, int]:
    """An id as it sorts: null ones last."""
    return (True, 0) if i is None else (False, int(i))


def _whole(i: str | None) -> int | None:
    return None if i is None else int(i)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows as a frame in which ids are text, see map_rows()."""
    at = [k for k, n in enumerate(names) if n in _IDS]
    return pd.DataFrame([tuple(v if k not in at or v is None else str(v) for k, v in enumerate(r)) for r in rows], columns=names, dtype=object)


def _open(root: str) -> tuple[fs.FileSystem, str]:
    where, path = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    return where, path


def write(pages: DataFrame, root: str | None = None, *, min_revisit: int = 0, block_lines: int = 2000, level: int = 1) -> Archive:
    """Write pages (page_id, url, html) as WARC archives with their index."""
    spark = pages.sparkSession
    root = root or scratch(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    same = {"sha1": F.sha1(F.col("html").cast("binary")), "second": F.xxhash64("html"), "size": F.octet_length("html")}
    rows = rows.withColumns(same)
    first = rows.groupBy(*same).agg(F.min("page_id").alias("first_id"))
    marked = rows.join(first.hint("shuffle_hash"), list(same))  # a payload that many pages share is split by the adaptive skew join

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, top = _open(root)
        name, out, at = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            rows = []
            for page_id, url, html, first_id in zip(b["page_id"], b["url"], b["html"], b["first_id"], strict=True):
                payload = html.encode("utf-8", "replace")
                page_id, first_id = _whole(page_id), _whole(first_id)
                again = page_id != first_id and len(payload) >= min_revisit
                raw = gzip.compress(record(page_id, url, payload, "revisit" if again else "response", first_id if again else None, digest(payload)), level, mtime=0)
                if out is None:
                    where.create_dir(top, recursive=True)
                    out = where.open_output_stream(f"{top}/{name}", compression=None)
                out.write(raw)
                rows.append((url_key(url), page_id, name, at, len(raw)))
                at += len(raw)
            yield _frame(rows, ["url_key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    captures = keep(map_rows(marked.select("page_id", "url", "html", "first_id"), store, _CAPTURE, _IDS), "captures")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, top = _open(root)
        name, out, at, held, blocks = f"index-{uuid.uuid4().hex}.idx", None, 0, [], []

        def flush() -> None:
            nonlocal out, at
            if out is None:
                where.create_dir(top, recursive=True)
                out = where.open_output_stream(f"{top}/{name}", compression=None)
            raw = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode("utf-8", "replace"), 6)
            out.write(raw)
            blocks.append((held[0][0], held[0][1], at, len(raw)))
            at += len(raw)
            held.clear()

        for b in batches:
            for row in zip(*(b[c].tolist() for c in ("url_key", "page_id", "file", "offset", "length")), strict=True):
                held.append([row[0], _whole(row[1]), *row[2:]])
                if len(held) == block_lines:
                    flush()
        if held:
            flush()
        if out is not None:
            raw = zlib.compress(json.dumps(blocks, ensure_ascii=False).encode("utf-8", "replace"))
            out.write(raw + len(raw).to_bytes(8, "little"))
            out.close()
            yield _frame([(name, *blocks[0][:2], len(blocks))], ["file", "first_key", "first_id", "blocks"])

    sorted_captures = captures.repartitionByRange(F.col("url_key"), F.col("page_id").asc_nulls_last()).sortWithinPartitions("url_key", F.col("page_id").asc_nulls_last())
    files = keep(map_rows(sorted_captures, index, "file string, first_key string, first_id long, blocks int", _IDS), "index")
    return Archive(spark, root, captures, files)


class Directory:
    """The sparse directory of one index file."""

    def __init__(self, where: fs.FileSystem, path: str):
        self._file = where.open_input_file(path)
        size = self._file.size()
        n = int.from_bytes(self._read(size - 8, 8), "little")
        self.blocks = [((key, *_last_if_null(i)), at, n) for key, i, at, n in json.loads(zlib.decompress(self._read(size - 8 - n, n)))]
        self._firsts = [b[0] for b in self.blocks]
        self._kept: tuple[int, list] = (-1, [])

    def _read(self, at: int, n: int) -> bytes:
        self._file.seek(at)
        return self._file.read(n)

    def block(self, k: int) -> list[list]:
        """The captures of a block; the last one read is kept."""
        if self._kept[0] != k:
            _, at, n = self.blocks[k]
            self._kept = (k, [json.loads(line) for line in zlib.decompress(self._read(at, n)).decode().split("\n")])
        return self._kept[1]

    def find(self, key: str, page_id: tuple[bool, int] | None = None) -> list[list]:
        """All captures of a key in this file, or of a key and an id: the directory and each block are searched by halving."""
        low, high = ((key, *page_id),) * 2 if page_id else ((key, False, -(2**63)), (key, True, 0))
        k = max(0, bisect.bisect_left(self._firsts, low) - 1)
        found = []
        while k < len(self.blocks) and self._firsts[k] <= high:
            lines = self.block(k)
            place = lambda x: (x[0], *_last_if_null(x[1]))
            found += lines[bisect.bisect_left(lines, low, key=place) : bisect.bisect_right(lines, high, key=place)]
            k += 1
        return found

    def close(self) -> None:
        self._file.close()


def read(archive: Archive, pages: DataFrame | None = None, with_payload: bool = False, run_bytes: int = 16 << 20) -> DataFrame:
    """The records of pages (page_id, url), of all that were captured by default.

    Every key and id is looked up in the index: the file by the files' first keys, the block by
    the file's directory, the capture within the block. Archives are then read in runs of about
    `run_bytes`, each by range and in file order.
    """
    root, spark = archive.root, archive.spark
    firsts = archive.firsts()
    heads = [f[0] for f in firsts]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = b["url_key"] if "url_key" in b else [url_key(u) for u in b["url"]]
            at = [max(0, bisect.bisect_right(heads, (k, *_last_if_null(i))) - 1) for k, i in zip(keys, b["page_id"], strict=True)]
            yield pd.DataFrame({"at": at, "key": keys, "page_id": b["page_id"]})

    asked = archive.captures.select("url_key", "page_id") if pages is None else pages.select("url", F.col("page_id").cast("long").alias("page_id"))
    asked = map_rows(asked, assign, "at int, key string, page_id long", _IDS).dropDuplicates()  # a repeated row is found as often as it was captured
    asked = asked.repartition("at").sortWithinPartitions("at", "key", F.col("page_id").asc_nulls_last())

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, top = _open(root)
        now, directory = None, None
        for b in batches:
            rows = []
            for at, key, page_id in zip(b["at"], b["key"], b["page_id"], strict=True):
                if at != now and firsts:
                    if directory is not None:
                        directory.close()
                    now, directory = at, Directory(where, f"{top}/{firsts[at][1]}")
                if directory is not None:
                    rows += [r[2:] for r in directory.find(key, _last_if_null(page_id))]
            yield pd.DataFrame(rows, columns=["warc", "offset", "length"])
        if directory is not None:
            directory.close()

    # runs of a file go to tasks of their own, so one large archive is not one task; few bytes tell much to read, so tasks are counted here
    size = archive.captures.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // run_bytes))
    found = map_rows(asked, places, "warc string, offset long, length long", _IDS)
    ordered = found.repartition(int(tasks), "warc", F.floor(F.col("offset") / run_bytes)).sortWithinPartitions("warc", "offset")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, top = _open(root)
        name, file = None, None
        for b in batches:
            rows = []
            for warc, at, n in zip(b["warc"], b["offset"], b["length"], strict=True):
                if warc != name:
                    if file is not None:
                        file.close()
                    name, file = warc, where.open_input_file(f"{top}/{warc}")
                file.seek(at)
                row = parse(gzip.decompress(file.read(n)))
                rows.append(row if with_payload else row[:-1])
            yield _frame(rows, names)
        if file is not None:
            file.close()

    schema = _RECORD if with_payload else _RECORD.rpartition(",")[0]
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return map_rows(ordered, load, schema, _IDS)


def lookup(archive: Archive, urls: DataFrame) -> DataFrame:
    """All records whose key is that of a url: url, and the record's fields with its payload.

    Index files are as many as the index had partitions; their first keys are broadcast. A
    key goes to the one file that may hold it first, and on to later files that begin with it.
    """
    root, firsts = archive.root, archive.firsts()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, top = _open(root)
        cached: dict[str, Directory] = {}
        for b in batches:
            rows = []
            for url in b["url"]:
                key = url_key(url)
                k = max(0, bisect.bisect_left(firsts, ((key, False, -(2**63)), "")) - 1)
                while k < len(firsts) and firsts[k][0] <= (key, True, 0):
                    name = firsts[k][1]
                    if name not in cached:
                        cached[name] = Directory(where, f"{top}/{name}")
                    for _, _, warc, at, n in cached[name].find(key):
                        with where.open_input_file(f"{top}/{warc}") as f:
                            f.seek(at)
                            rows.append((url, *parse(gzip.decompress(f.read(n)))))
                    k += 1
            yield _frame(rows, ["asked", *(c.strip().split(" ")[0] for c in _RECORD.split(","))])
        for d in cached.values():
            d.close()

    return map_rows(urls.select("url"), search, f"asked string, {_RECORD}", _IDS)
