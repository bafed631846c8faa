"""WARC archives with a two-level capture index (operator 2).

Writing: every page is one record, gzipped on its own, in archives of the shared folder;
equal payloads are written once and revisited by the others. Index: the records' keys,
host reversed, are sorted into blocks, each gzipped on its own; a sparse directory has
each block's first key and place. Reading: a key is found by binary search in the
directory, one range read of its block, and one range read of its record.

Scale: archives are written by the tasks that hold the pages, index parts by range of
the key, and look-ups go to the tasks by the same ranges, sorted, so a block is read about
once. A task writes its rows in order to files that bear its partition's number and are
moved into place when whole, so a rerun after a lost executor makes the same files, byte by
byte. Pages are shuffled to what they revisit only where many payloads are shared, and hot
payloads never; hot hosts are spread, as keys are dealt by the whole key with the page's id.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, join_keys

#: Lines of an index block, and bytes of records after which a task starts its next archive.
BLOCK_LINES, ARCHIVE_BYTES = 1000, 1 << 30
#: Payloads of several pages that are broadcast, at most.
SHARED = 50_000
#: Responses whose payloads a task remembers for those that revisit them.
REMEMBERED = 10_000
#: Payloads of fewer bytes are never revisited.
LEAST_REVISIT = 100
_HEADER_END = b"\r\n\r\n"


# -- keys ---------------------------------------------------------------------------


def url_key(url: str | None) -> str:
    """Sort key: host labels reversed, then port, path and query; null is empty.

    Scheme, user, fragment and a leading ``www`` do not count; hosts are lower-cased.
    What is no URL with a host is its own key.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    labels = host.rstrip(".").split(".")
    if labels[0] == "www" and len(labels) > 2:
        labels = labels[1:]
    where = f":{port}" if port and port not in (80, 443) else ""
    return f"{','.join(reversed(labels))}{where}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


# -- files --------------------------------------------------------------------------


class _Store:
    """Files under a root that may be on any file system pyarrow knows."""

    def __init__(self, root: str):
        self.fs, self.root = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:/") else (pafs.LocalFileSystem(), root)

    def put(self, name: str, data: Iterator[bytes] | list[bytes]) -> None:
        """Write a file whole, or not at all."""
        path, part = f"{self.root}/{name}", f"{self.root}/.{name.replace('/', '-')}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as out:
            for x in data:
                out.write(x)
        self.move(part, path)

    def move(self, part: str, path: str) -> None:
        """Put a file in its place; what another attempt of the task has put there is the same."""
        if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
            self.fs.move(part, path)
        else:
            self.fs.delete_file(part)

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.root}/{name}")

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return f.read()


def _uri(root: str) -> str:
    """A root that executors can open: local paths get no scheme, others keep theirs."""
    return re.sub(r"^file:/+", "/", root)


# -- records ------------------------------------------------------------------------


def _record(fields: list[tuple[str, str]], payload: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return head.encode("utf-8", "surrogatepass") + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def _record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest}')}>"


def page_record(page_id: str, url: str, payload: bytes, digest: str, refers_to: str | None, refers_url: str = "") -> bytes:
    """The record of a page: a response with its payload, or a revisit without."""
    uri = re.sub(r"[\r\n]+", " ", url)
    fields = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Target-URI", uri),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Page-Id", page_id),
        ("Payload-Length", str(len(payload))),
    ]
    if refers_to is None:
        return _record([*fields, ("Content-Type", "text/html; charset=utf-8")], payload)
    more = [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", _record_id(refers_to, digest)),
        ("WARC-Refers-To-Target-URI", re.sub(r"[\r\n]+", " ", refers_url)),
        ("Refers-To-Page-Id", refers_to),
        ("Refers-To-Key", json.dumps(url_key(refers_url))),
    ]
    return _record([*fields, *more], b"")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one unzipped record."""
    head, _, rest = data.partition(_HEADER_END)
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if len(rest) < n + 4:
        raise ValueError("the record is cut short")
    return fields, rest[:n]


# -- writing ------------------------------------------------------------------------


def _with_keepers(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, url, html, digest, keeper, keeper_url): keeper is the response a page revisits."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n_bytes"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("null"), "page_id", "url"))
    shared = known.where(F.col("n_bytes") >= least).groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(shared.select(F.col("digest").alias("d2"), F.col("first.page_id").alias("keeper"), F.coalesce("first.url", F.lit("")).alias("keeper_url"), "n"))
    both = join_keys(known, shared, [F.col("digest") == F.col("d2")], weight="n", how="left", most=SHARED)
    keeper = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return both.select("page_id", "url", "html", "digest", keeper.alias("keeper"), "keeper_url").sortWithinPartitions("page_id", "url", "digest")


def write_archives(pages: DataFrame, root: str, *, least_revisit: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages (page_id, url, html) under ``root``; gives the index entries.

    Entries: (urlkey, page_id, file, at, length), stored as a table beside the archives.
    """
    where = _uri(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _Store(where)
        task = f"{TaskContext.get().partitionId():06d}"
        number, at, out, part = 0, 0, None, ""
        entries: list[list] = [[], [], [], [], []]

        def name() -> str:
            return f"warc/part-{task}-{number:04d}.warc.gz"

        def close() -> None:
            if out is not None:
                out.close()
                store.move(part, f"{store.root}/{name()}")

        for batch in batches:
            for i in range(len(batch)):
                page_id, url, html, digest, keeper, keeper_url = (batch.column(k)[i].as_py() for k in range(6))
                if out is None:
                    part = f"{store.root}/warc/.part-{task}-{number}-{uuid.uuid4().hex}"
                    out = store.fs.open_output_stream(part)
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(name(), "")), ("WARC-Date", "1970-01-01T00:00:00Z")]
                    out.write(gzip.compress(_record(info, b"format: WARC File Format 1.1\r\n"), 6, mtime=0))
                    at = out.tell()
                payload = (html or "").encode("utf-8", "surrogatepass")
                said = "" if page_id is None else str(page_id)
                data = gzip.compress(page_record(said, url or "", payload, digest, None if keeper is None else str(keeper), keeper_url or ""), 6, mtime=0)
                out.write(data)
                for column, x in zip(entries, (url_key(url), page_id, name(), at, len(data))):
                    column.append(x)
                at += len(data)
                if at >= archive_bytes:
                    close()
                    out, number = None, number + 1
            yield pa.RecordBatch.from_arrays([pa.array(entries[0], pa.string()), pa.array(entries[1], pa.int64()), pa.array(entries[2], pa.string()), pa.array(entries[3], pa.int64()), pa.array(entries[4], pa.int64())], names=["urlkey", "page_id", "file", "at", "length"])
            entries = [[], [], [], [], []]
        close()

    _Store(where).fs.create_dir(f"{_Store(where).root}/warc", recursive=True)
    made = _with_keepers(pages.select(F.col("page_id").cast("long"), "url", "html"), least_revisit).mapInArrow(write, "urlkey string, page_id long, file string, at long, length long")
    # stored at once: the writing must not run again when the entries are read twice
    made.write.parquet(f"{root}/entries")
    return pages.sparkSession.read.parquet(f"{root}/entries")


# -- index --------------------------------------------------------------------------


def _sort_key(urlkey: str, page_id: int | None) -> tuple:
    """Order of index lines: as Spark orders (urlkey, page_id), nulls first."""
    return urlkey.encode("utf-8", "surrogatepass"), page_id is not None, page_id or 0


def write_index(entries: DataFrame, root: str, *, parts: int, block_lines: int = BLOCK_LINES) -> None:
    """Sort the entries into blocks, with a directory for each part.

    Part k is ``index/part-k.cdx.gz``, blocks of JSON lines, each a gzip member, and
    ``index/part-k.dir``, the first key, last key, place and length of each block.
    """
    where = _uri(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _Store(where)
        name = f"part-{TaskContext.get().partitionId():06d}"
        blocks: list[list] = []
        part = f"{store.root}/index/.{name}-{uuid.uuid4().hex}"
        at, lines = 0, []
        with store.fs.open_output_stream(part) as out:

            def flush() -> None:
                nonlocal at
                data = gzip.compress("".join(json.dumps(x) + "\n" for x in lines).encode(), 6, mtime=0)
                out.write(data)
                blocks.append([lines[0][:2], lines[-1][:2], at, len(data)])
                at += len(data)
                lines.clear()

            for batch in batches:
                for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    lines.append(list(row))
                    if len(lines) == block_lines:
                        flush()
            if lines:
                flush()
        store.move(part, f"{store.root}/index/{name}.cdx.gz")
        store.put(f"index/{name}.dir", [json.dumps(blocks).encode()])
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([blocks[0][0][0]]), pa.array([blocks[0][0][1]], pa.int64()), pa.array([len(blocks)], pa.int64())], names=["part", "urlkey", "page_id", "blocks"])

    store = _Store(where)
    store.fs.create_dir(f"{store.root}/index", recursive=True)
    ordered = entries.select("urlkey", "page_id", "file", "at", "length").repartitionByRange(parts, "urlkey", "page_id").sortWithinPartitions("urlkey", "page_id", "file", "at")
    # one row for each part: the directory of directories, bounded by the number of parts
    ordered.mapInArrow(write, "part string, urlkey string, page_id long, blocks long").write.parquet(f"{root}/parts")


class CaptureIndex:
    """Look-ups in an index: binary search over the parts' first keys, then a part's blocks."""

    def __init__(self, root: str, parts: list[tuple[str, str, int | None]]):
        self.store = _Store(_uri(root))
        self.parts = sorted(((_sort_key(k, p), name) for name, k, p in parts), key=lambda x: x[0])
        self.firsts = [k for k, _ in self.parts]
        self._part: tuple[int, list, list] | None = None
        self._block: tuple[tuple[int, int], list] | None = None
        self._files: dict[str, object] = {}
        self.blocks_read = 0

    def _directory(self, p: int) -> tuple[list, list]:
        if self._part is None or self._part[0] != p:
            blocks = json.loads(self.store.read(f"index/{self.parts[p][1]}.dir"))
            self._part = (p, [_sort_key(*b[1]) for b in blocks], blocks)
        return self._part[1:]

    def _lines(self, p: int, b: int) -> list:
        if self._block is None or self._block[0] != (p, b):
            _, _, at, length = self._directory(p)[1][b]
            data = gzip.decompress(self._range(f"index/{self.parts[p][1]}.cdx.gz", at, length))
            rows = [json.loads(x) for x in data.splitlines()]
            self._block = ((p, b), rows, [_sort_key(*x[:2]) for x in rows])
            self.blocks_read += 1
        return self._block[1:]

    def _range(self, name: str, at: int, length: int) -> bytes:
        if name not in self._files:
            if len(self._files) >= 16:
                self._files.pop(next(iter(self._files))).close()
            self._files[name] = self.store.open(name)
        f = self._files[name]
        f.seek(at)
        return f.read(length)

    def find(self, urlkey: str, page_id: int | None) -> Iterator[tuple[str, int, int]]:
        """(file, at, length) of every capture of the key, in order."""
        key = _sort_key(urlkey, page_id)
        # captures of one key may run over blocks and parts
        p = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while p < len(self.parts) and self.firsts[p] <= key:
            lasts, blocks = self._directory(p)
            b = bisect.bisect_left(lasts, key)
            while b < len(blocks) and _sort_key(*self._directory(p)[1][b][0]) <= key:
                rows, keys = self._lines(p, b)
                i = bisect.bisect_left(keys, key)
                while i < len(keys) and keys[i] == key:
                    yield tuple(rows[i][2:])
                    rows, keys = self._lines(p, b)
                    i += 1
                b += 1
            p += 1

    def record(self, file: str, at: int, length: int) -> tuple[dict[str, str], bytes]:
        data = zlib.decompress(self._range(file, at, length), 31)
        return parse_record(data)


def read_back(pages: DataFrame, root: str, *, parts: int) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url), from its record in the archives.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to. Bytes and
    digest are of the payload read, which must agree with the record's header: a revisit's
    is that of the response it refers to, found through the index. Rows of equal key get
    one capture each.
    """
    spark = pages.sparkSession
    # at most one row for each part of the index
    top = [(r.part, r.urlkey, r.page_id) for r in spark.read.parquet(f"{root}/parts").collect()]

    @F.pandas_udf("string")
    def keys_of(urls):
        return urls.map(url_key)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(root, top)
        last, captures = None, iter(())
        known: dict[tuple[str, int], set[tuple[int, str]]] = {}

        def read(payload: bytes) -> tuple[int, str]:
            return len(payload), hashlib.sha256(payload).hexdigest()

        def responses(key: str, page_id: int) -> set[tuple[int, str]]:
            """Bytes and digests of the payloads that the responses of a key have."""
            if (key, page_id) not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                records = [index.record(*c) for c in index.find(key, page_id)]
                known[key, page_id] = {read(payload) for fields, payload in records if fields["WARC-Type"] == "response"}
            return known[key, page_id]

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if last != (key, page_id):
                    last, captures = (key, page_id), index.find(key, page_id)
                fields, payload = index.record(*next(captures))
                said = int(fields["Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                to = fields.get("Refers-To-Page-Id")
                there = {read(payload)} if to is None else responses(json.loads(fields["Refers-To-Key"]), int(to))
                if said not in there:
                    raise ValueError(f"page {page_id}: the payload read is not the one written")
                n, digest = said
                for column, x in zip(out, (page_id, n, digest, fields["WARC-Type"], None if to is None else int(to))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()), pa.array(out[4], pa.int64())], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    asked = pages.select(keys_of(F.coalesce("url", F.lit(""))).alias("urlkey"), F.col("page_id").cast("long").alias("page_id"))
    together = asked.repartitionByRange(parts, "urlkey", "page_id").sortWithinPartitions("urlkey", "page_id")
    return together.mapInArrow(look_up, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, root: str | None = None, *, parts: int | None = None, **options) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives with an index, and read them back.

    Of records with equal payloads of ``least_revisit`` bytes or more the one of smallest
    page_id is a response and the others revisit it; rows that share that page_id are all
    responses. Null html is an empty payload, a null url the empty URL; a null page_id is
    larger than all others. Rows of equal url and page_id are captures of their own, told
    apart by order only. Other columns are not read; empty tables give empty archives.

    root: where files go; a new folder in the shared one by default. The archives stay.
    """
    spark = pages.sparkSession
    root = root or fresh_path(spark, "warc")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = write_archives(pages, root, **options)
    write_index(entries, root, parts=parts)
    return read_back(pages, root, parts=parts)
