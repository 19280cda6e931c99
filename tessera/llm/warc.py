"""WARC archives with a two-level capture index.

Level one: capture lines sorted by reversed-host URL key, in gzip blocks of BLOCK_LINES lines. Each index file ends with its
sparse directory, one line for each block (first key, last key, offset, length).
Level two: the list of index files (first key, last key, place of the directory), one for each shuffle partition.
A search bisects the list, range-reads and bisects a directory, range-reads a block, bisects its lines, and range-reads
the record itself. Many keys are searched in key order, so that a task holds one directory and one block at a time.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_path, shared_root, ship, shuffle_partitions, written

BLOCK_LINES = 512
ROLL_BYTES = 1 << 30
CAPTURES = "urlkey string, page_id long, file string, offset long, length long, record_type string, digest string"
DIRECTORY = "first_key string, last_key string, file string, offset long, length long, lines int, foot long, foot_length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


@dataclass
class Store:
    """Archives of one write: capture rows and the sparse block directory, both written tables."""

    root: str
    captures: DataFrame
    directory: DataFrame

    def files(self) -> list[tuple]:
        """(first key, last key, file, place and length of its directory) by key: one an index file."""
        d = self.directory.groupBy("file", "foot", "foot_length").agg(F.min("first_key").alias("a"), F.max("last_key").alias("z"))
        return sorted((r["a"], r["z"], r["file"], r["foot"], r["foot_length"]) for r in d.collect())  # at most one a shuffle partition


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def url_key(url: str | None) -> str:
    """Reversed-host key: http://a.b.com/x?y -> com,b,a)/x?y. Null and odd urls keep a defined key."""
    if not url:
        return ")"
    rest = url.partition("://")[2] or url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:].partition("#")[0]
    key = ",".join(reversed(host.split("."))) + ")" + (tail or "/")
    return "".join(c if c > " " and c != "\x7f" else quote(c) for c in key)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head alone; X-Payload-Length keeps the full length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record: header map and payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(h["Content-Length"])]
    return {"head": h, "payload": body.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None}


def _urn(x: str) -> int | None:
    n = x[len("<urn:page:") : -1]
    return int(n) if n and n != "None" else None


def _writer(root: str, date: str, level: int):
    def run(batches):
        where, base = filesystem(root)
        where.create_dir(f"{base}/archive", recursive=True)
        out, at, name = None, 0, ""
        try:
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    if out is None or at > ROLL_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{base}/archive/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out, at = where.open_output_stream(name, compression=None), 0
                    payload = r["payload"]
                    kind = "revisit" if r["refers"] is not None else "response"
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    z = gzip.compress(record(kind, r["page_id"], r["url"], payload, digest, r["refers"], date), level, mtime=0)
                    out.write(z)
                    rows.append((url_key(r["url"]), r["page_id"], name, at, len(z), kind, digest))
                    at += len(z)
                yield _table(rows, CAPTURES)
        finally:
            if out is not None:
                out.close()

    return run


def _table(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [pa.field(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], schema=pa.schema(fields))


def _indexer(root: str):
    def run(batches):
        where, base = filesystem(root)
        where.create_dir(f"{base}/index", recursive=True)
        name = f"{base}/index/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx.gz"
        out, at, lines, keys, done = None, 0, [], [], []

        def flush():
            nonlocal out, at, lines, keys
            if out is None:
                out = where.open_output_stream(name, compression=None)
            z = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
            out.write(z)
            done.append((keys[0], keys[-1], name, at, len(z), len(lines)))
            at, lines, keys = at + len(z), [], []

        for b in batches:
            for r in b.to_pylist():
                lines.append("\t".join("" if x is None else str(x) for x in r.values()))
                keys.append(r["urlkey"])
                if len(lines) >= BLOCK_LINES:
                    flush()
        if lines:
            flush()
        foot = b""
        if out is not None:
            foot = gzip.compress("\n".join(f"{a}\t{z}\t{o}\t{n}" for a, z, _, o, n, _ in done).encode(), 6, mtime=0)
            out.write(foot)
            out.close()
        yield _table([(*d, at, len(foot)) for d in done], DIRECTORY)

    return run


def entry_of(line: str) -> tuple:
    k, page, file, offset, length, kind, digest = line.split("\t")
    return k, int(page) if page else None, file, int(offset), int(length), kind, digest


def read_range(where: fs.FileSystem, file: str, offset: int, length: int) -> bytes:
    with where.open_input_file(file) as f:
        return f.read_at(length, offset)


def write(pages: DataFrame, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> Store:
    """Archive every row of pages (page_id, url, html) and index the captures.

    Null html is the empty payload. Of rows with equal payloads of at least min_revisit_bytes bytes, the row with
    the largest page_id is the response; rows that repeat that page_id too are responses as well, all others are
    revisits of it. A null page_id counts as the smallest. An empty table gives an empty store. Other columns are ignored.
    """
    spark = ship(pages.sparkSession)
    root = shared_path(spark, "warc")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")).withColumn("sha", F.sha1("payload"))
    kept = p.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "keeper")
    marked = p.join(kept, "sha", "left").select("page_id", "url", "payload", F.when(F.col("keeper").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("keeper"))), F.col("keeper")).alias("refers"))
    captures = written(marked.mapInArrow(_writer(root, date, level), CAPTURES), "captures")
    ordered = captures.repartitionByRange(shuffle_partitions(spark), "urlkey", "page_id").sortWithinPartitions("urlkey", "page_id", "offset")
    directory = written(ordered.mapInArrow(_indexer(root), DIRECTORY), "directory")
    return Store(root, captures, directory)


def entries(store: Store) -> DataFrame:
    """All capture lines, read from the compressed index blocks through the directory."""
    root = store.root

    def run(batches):
        where, _ = filesystem(root)
        for b in batches:
            for r in b.to_pylist():
                text = gzip.decompress(read_range(where, r["file"], r["offset"], r["length"])).decode()
                yield _table([entry_of(x) for x in text.split("\n")], CAPTURES)

    n = shuffle_partitions(store.directory.sparkSession)
    return store.directory.repartition(n, "file", "offset").mapInArrow(run, CAPTURES)


class Search:
    """Binary search over index files; the last directory and block stay in memory."""

    def __init__(self, root: str, files: list[tuple]):
        self.where, _ = filesystem(root)
        self.files, self.lasts = files, [f[1] for f in files]
        self.at = self.block_at = None
        self.blocks: list[tuple] = []
        self.ends: list[str] = []
        self.lines: list[str] = []
        self.keys: list[str] = []

    def _directory(self, i: int) -> None:
        if self.at != i:
            _, _, file, foot, n = self.files[i]
            text = gzip.decompress(read_range(self.where, file, foot, n)).decode()
            self.blocks = [(a, z, int(o), int(m)) for a, z, o, m in (x.split("\t") for x in text.split("\n"))]
            self.ends, self.at = [b[1] for b in self.blocks], i

    def _block(self, i: int, j: int) -> None:
        if self.block_at != (i, j):
            _, _, offset, n = self.blocks[j]
            self.lines = gzip.decompress(read_range(self.where, self.files[i][2], offset, n)).decode().split("\n")
            self.keys, self.block_at = [x.partition("\t")[0] for x in self.lines], (i, j)

    def find(self, key: str) -> list[tuple]:
        """Captures of one key, in index order."""
        out = []
        for i in range(bisect.bisect_left(self.lasts, key), len(self.files)):
            if self.files[i][0] > key:
                break
            self._directory(i)
            for j in range(bisect.bisect_left(self.ends, key), len(self.blocks)):
                if self.blocks[j][0] > key:
                    break
                self._block(i, j)
                out += [entry_of(x) for x in self.lines[bisect.bisect_left(self.keys, key) : bisect.bisect_right(self.keys, key)]]
        return out


def find(store: Store, urls: DataFrame, url: str = "url") -> DataFrame:
    """Capture lines of all urls of a table, each key once: searched in the two-level index, in key order."""
    spark = ship(store.directory.sparkSession)
    root, files = store.root, store.files()

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], names=["k"])

    def run(batches):
        search = Search(root, files)
        for b in batches:
            yield _table([e for k in b.column(0).to_pylist() for e in search.find(k)], CAPTURES)

    k = urls.select(F.col(url).cast("string").alias("u")).distinct().mapInArrow(keys, "k string").distinct()
    return k.repartitionByRange(shuffle_partitions(spark), "k").sortWithinPartitions("k").mapInArrow(run, CAPTURES)


def read(store: Store, with_payload: bool = False, captures: DataFrame | None = None) -> DataFrame:
    """Every archived record (or those of the given capture lines), range-read at the place that its index entry names.

    Entries meet by archive slice of 64 MB, in offset order, so that a task reads forward through few files.
    """
    root = store.root

    def run(batches):
        where, _ = filesystem(root)
        name, f = None, None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["file"] != name:
                    if f is not None:
                        f.close()
                    name, f = r["file"], where.open_input_file(r["file"])
                got = parse(gzip.decompress(f.read_at(r["length"], r["offset"])))
                h, payload = got["head"], got["payload"]
                if payload is None:
                    size, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:]
                else:
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if h["WARC-Payload-Digest"] != f"sha1:{digest}":
                        raise ValueError(f"damaged record in {name} at {r['offset']}")
                rows.append((_urn(h["WARC-Record-ID"]), size, digest, h["WARC-Type"], _urn(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, h.get("WARC-Target-URI"), payload if with_payload else None))
            yield _table(rows, RECORDS)
        if f is not None:
            f.close()

    n = shuffle_partitions(store.directory.sparkSession)
    placed = (entries(store) if captures is None else captures).withColumn("slice", F.floor(F.col("offset") / (64 << 20))).repartition(n, "file", "slice").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, RECORDS)


def lookup(spark: SparkSession, store: Store, url: str) -> list[dict]:
    """Captures of one url, found by the two-level search, and their records."""
    search, out = Search(store.root, store.files()), []
    for _, page, file, offset, length, kind, _ in search.find(url_key(url)):
        got = parse(gzip.decompress(read_range(search.where, file, offset, length)))
        out.append({"page_id": page, "record_type": kind, "payload": got["payload"], "url": got["head"].get("WARC-Target-URI")})
    return out


__all__ = ["Store", "Search", "entries", "find", "lookup", "read", "shared_root", "url_key", "write"]
