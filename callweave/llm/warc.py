"""WARC archives with revisit records, and a two-level index of their captures."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, spread_join, storage, written

#: Payloads of fewer bytes never become revisits.
LEAST_BYTES = 100
FILE_BYTES = 256 << 20
BLOCK_LINES = 3000
READ_BYTES = 8 << 20
#: Bytes of archives that a task reads back.
PART_BYTES = 128 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def key_of(url: str | None) -> str:
    """The reversed-host key of a URL: com,example,www)/path?query, in lower case but for path and query."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return clean(url)
    key = ",".join(reversed(host.rstrip(".").split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return clean(f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else ""))


def clean(text: str) -> str:
    """text without white space and control characters, which are escaped."""
    return text if text.isascii() and text.isprintable() and " " not in text else quote(text, safe="%/:=&?~#+!$,;'@()*[]")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member of its own. A revisit keeps the HTTP head but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {clean(url)}"] if url else []
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    made = zlib.compressobj(1, zlib.DEFLATED, 31)
    return made.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + made.flush()


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload (None of a revisit) of an unpacked record.

    The digest is that of the payload's bytes; a response whose bytes don't fit its header raises ValueError.
    """
    top, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line[16:]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
    said = fields["WARC-Payload-Digest"].removeprefix("sha256:")

    def page(name: str) -> int | None:
        number = fields.get(name, "")[10:-1]
        return int(number) if number else None

    if fields["WARC-Type"] == "revisit":
        return page("WARC-Record-ID"), size, said, "revisit", page("WARC-Refers-To"), None
    if len(payload) != size or hashlib.sha256(payload).hexdigest() != said:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return page("WARC-Record-ID"), size, said, "response", None, payload


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES) -> None:
    """Write pages (page_id, url, html) under path: archives, the captures' index blocks and their directory.

    A null html is an empty payload. Of equal payloads of at least least_bytes the row with the smallest page_id
    is a response and the others revisit it (rows that repeat that id are responses too); a row without
    an id revisits, and is never revisited. Null URLs have an empty key. No pages give an empty index.
    Other columns are dropped.

    Payloads move once, to meet the smallest id of their digest; digests that hold many rows are broadcast
    and their pages dealt out evenly. Each task writes its own files through pyarrow's filesystems,
    named after the attempt; only files of attempts that succeeded are in the index.
    """
    folder = f"{path.rstrip('/')}/archives"
    kind = pages.schema["page_id"].dataType.simpleString()
    texts = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    texts = texts.withColumn("digest", F.sha2("html", 256))
    large = texts.where(F.octet_length("html") >= least_bytes)
    groups = large.groupBy("digest").agg(F.count("*").alias("size"), F.min("page_id").alias("first")).where("size > 1 and first is not null")
    rows = spread_join(texts, written(groups, "digests"), "digest", "size", F.coalesce(F.col("page_id").cast("long"), F.xxhash64("url")))
    rows = rows.select("page_id", "url", "html", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, at = storage(folder)
        fs.create_dir(at, recursive=True)
        number, out, name, place = 0, None, "", 0
        try:
            for batch in slices(batches, "html"):
                made = []
                for page_id, url, html, digest, first in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if out is None or place >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, place, number = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:03d}.warc.gz", 0, number + 1
                        out = fs.open_output_stream(f"{at}/{name}", compression=None)
                    data = record(page_id, url, html.encode(), digest, first, date)
                    out.write(data)
                    made.append((key_of(url), page_id, name, place, len(data)))
                    place += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), batch.column(0).type, pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    captures = written(rows.mapInArrow(run, f"key string, page_id {kind}, file string, offset long, length long"), "captures")
    write_index(captures, path)


def write_index(captures: DataFrame, path: str, lines: int = BLOCK_LINES) -> None:
    """Sort captures by key into compressed blocks of lines, with a directory of the blocks' first and last keys."""
    folder = f"{path.rstrip('/')}/blocks"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, at = storage(folder)
        fs.create_dir(at, recursive=True)
        name, out, place, held = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.gz", None, 0, []

        def flush(own: list[tuple]) -> pa.RecordBatch:
            nonlocal out, place
            if out is None:
                out = fs.open_output_stream(f"{at}/{name}", compression=None)
            data = zlib.compress("\n".join("\t".join("" if x is None else str(x) for x in line) for line in own).encode(), 6)
            out.write(data)
            made = pa.RecordBatch.from_arrays([pa.array([x]) for x in (own[0][0], own[-1][0], name, place, len(data), len(own))], names=["first_key", "last_key", "file", "offset", "length", "lines"])
            place += len(data)
            return made

        try:
            for batch in batches:
                held += zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
                while len(held) >= lines:
                    yield flush(held[:lines])
                    held = held[lines:]
            if held:
                yield flush(held)
        finally:
            if out is not None:
                out.close()

    order = ["key", "page_id", "file", "offset"]
    dealt = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(run, "first_key string, last_key string, file string, offset long, length long, lines long").write.parquet(f"{path.rstrip('/')}/directory")


def _block(fs, at: str, name: str, offset: int, length: int) -> list[list[str]]:
    with fs.open_input_file(f"{at}/{name}") as f:
        return [line.split("\t") for line in zlib.decompress(f.read_at(length, offset)).decode().split("\n")]


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """(key, file, offset, length) of all captures, from the index blocks, each by one range read."""
    folder = f"{path.rstrip('/')}/blocks"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = storage(folder)
        for batch in batches:
            for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                key, _, file, place, size = zip(*_block(fs, at, name, offset, length), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(file), pa.array(map(int, place), pa.int64()), pa.array(map(int, size), pa.int64())], names=["key", "file", "offset", "length"])

    blocks = spark.read.parquet(f"{path.rstrip('/')}/directory").select("file", "offset", "length")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts).mapInArrow(run, "key string, file string, offset long, length long")


def read_archives(captures: DataFrame, path: str, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of captures (file, offset, length).

    Captures are dealt by place in the archives, to a task for each PART_BYTES of them and as many as the session asks for at least;
    neighbours are read in one range of bounded size.
    """
    folder = f"{path.rstrip('/')}/archives"
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = storage(folder)
        opened, source = None, None
        try:
            for batch in batches:
                places = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
                start = 0
                while start < len(places):
                    name, first, length = places[start]
                    end, stop = start + 1, first + length
                    while end < len(places) and places[end][0] == name and places[end][1] == stop and stop - first < READ_BYTES:
                        stop += places[end][2]
                        end += 1
                    if name != opened:
                        if source is not None:
                            source.close()
                        opened, source = name, fs.open_input_file(f"{at}/{name}")
                    data = memoryview(source.read_at(stop - first, first))
                    found = [parse(zlib.decompress(data[o - first : o - first + n], 31)) for _, o, n in places[start:end]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds.values(), strict=False)], names=list(kinds))
                    start = end
        finally:
            if source is not None:
                source.close()

    order = ["file", "offset"]
    places = written(captures.select(*order, "length"), "places")
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, -(-(places.agg(F.sum("length")).first()[0] or 0) // PART_BYTES))
    dealt = places.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return dealt.mapInArrow(run, ", ".join(f"{k} {names[t]}" for k, t in kinds.items()))


def keys_of(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, key): the index key of every URL, the empty one for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([key_of(u) for u in batch.column(0).to_pylist()], pa.string())], names=["url", "key"])

    return urls.select(F.col(f"`{url_col}`").alias("url")).mapInArrow(run, "url string, key string")


class Directory:
    """The sparse directory of an index, of which the files that can hold some keys are read when they are asked for."""

    def __init__(self, base: str):
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector

        self.fs, at = storage(f"{base}/directory")
        self.files: list[tuple[str | None, str | None, str]] = []
        for info in self.fs.get_file_info(FileSelector(at)):
            if info.path.endswith(".parquet"):
                with self.fs.open_input_file(info.path) as f:
                    footer = pq.ParquetFile(f).metadata
                ends = [footer.row_group(g).column(c).statistics for g in range(footer.num_row_groups) for c in (0, 1)]
                if all(x is not None and x.has_min_max for x in ends):
                    self.files += [(min(x.min for x in ends), max(x.max for x in ends), info.path)] if ends else []
                else:
                    self.files.append((None, None, info.path))
        self.path, self.rows = None, {}

    def blocks(self, keys: list[str]) -> Iterator[tuple[str, str, int, int]]:
        """(key, file, offset, length) of the blocks that may hold sorted keys."""
        import pyarrow.parquet as pq

        for low, high, path in self.files:
            own = keys if low is None else keys[bisect_left(keys, low) : bisect_right(keys, high)]
            if not own:
                continue
            if path != self.path:
                with self.fs.open_input_file(path) as f:
                    self.path, self.rows = path, pq.read_table(f).sort_by([("first_key", "ascending"), ("offset", "ascending")]).to_pydict()
            rows = self.rows
            for key in own:
                # A key's lines begin in the first block that ends with it or later, and go on while blocks begin with it.
                for i in range(bisect_left(rows["last_key"], key), bisect_right(rows["first_key"], key)):
                    yield key, rows["file"][i], rows["offset"][i], rows["length"][i]


def captures_of(keys: DataFrame, path: str) -> DataFrame:
    """(key, page_id, file, offset, length): the captures of each of some distinct keys (key), none for unknown ones.

    Tasks take ranges of sorted keys and binary-search the sparse directory, of which they read the files in question alone. The blocks that may hold
    a key are then dealt out; each is read by one range, and its lines are binary-searched for its keys. So the captures of a key that
    fills many blocks are found by many tasks.
    """
    base = path.rstrip("/")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = None
        for batch in batches:
            directory = directory or Directory(base)
            found = list(directory.blocks(batch.column(0).to_pylist()))
            columns = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "block", "start", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = storage(f"{base}/blocks")
        held, lines, named = None, [], []
        for batch in batches:
            found = []
            for key, *block in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if block != held:
                    held, lines = block, _block(fs, at, *block)
                    named = [line[0] for line in lines]
                found += ((key, int(line[1]) if line[1] else None, line[2], int(line[3]), int(line[4])) for line in lines[bisect_left(named, key) : bisect_right(named, key)])
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])

    asked = keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    blocks = asked.mapInArrow(search, "key string, block string, start long, size long")
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(parts, "block", "start").sortWithinPartitions("block", "start", "key")
    return dealt.mapInArrow(read, "key string, page_id long, file string, offset long, length long")


def lookup(urls: DataFrame, path: str, url_col: str = "url") -> DataFrame:
    """(url, key, page_id, file, offset, length): the captures of each URL through `captures_of`, none for unknown ones. Null URLs are looked up by the empty
    key; URLs that repeat are answered once; no URLs give no rows."""
    named = written(keys_of(urls, url_col).distinct(), "keys")
    return named.join(captures_of(named, path), "key").select("url", "key", "page_id", "file", "offset", "length")
