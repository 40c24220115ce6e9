"""WARC archives with a Zstandard dictionary of their own, written and read by Spark tasks.

Each task writes its rows to files of about ``FILE_BYTES``. A file opens with a skippable frame (magic
0x184D2A5D) that holds a dictionary trained on the file's first records, then has one Zstandard frame per WARC
record, so that every record can be read on its own. Files are written under a name of the attempt and renamed
when whole; only files that a finished task lists are read, so a lost executor leaves nothing in the result.

Of rows with equal payloads of at least ``REVISIT_FROM`` bytes the one with the smallest page_id is a response,
rows with a larger or null id are revisits that hold no payload; rows that repeat the smallest id are responses
too, and if all ids are null all are responses. A null html is an empty payload, a null url leaves out the
target header. Line breaks in a url are percent-encoded. An empty table gives no rows. Other columns are not
looked at."""
from __future__ import annotations

import hashlib
import os
import struct
import uuid

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, run_dir
from .common import n_parts, open_dir

REVISIT_FROM = 100
FILE_BYTES = 32 << 20
#: Dictionary size, and the bytes of records it is trained on: the first ones of each file.
DICT_BYTES = 32 << 10
TRAIN_BYTES = 2 << 20
#: Longer records are cut so that a few of them still make enough samples.
SAMPLE = 4 << 10
LEVEL = 3
_SKIPPABLE = 0x184D2A5D


def revisits(pages: DataFrame) -> DataFrame:
    """(page_digest, first_id) of payloads that at least two rows share."""
    p = pages.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("body"))
    p = p.filter(F.octet_length("body") >= REVISIT_FROM).select("page_id", F.sha2("body", 256).alias("digest"))
    return (p.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1 and first_id is not null").select("digest", "first_id"))


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, body, digest, refers_to of every row. The table of shared payloads is written first, so the
    join is planned with its measured size: by broadcast if small, else by a shuffle on the digest."""
    shared = cut_lineage(revisits(pages))
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("body"))
    p = p.withColumn("digest", F.sha2("body", 256))
    first = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")), F.col("first_id"))
    # Short payloads are never in the table of shared ones, so no length test is needed here.
    return p.join(shared, "digest", "left").select("page_id", "url", "body", "digest", first.alias("refers_to"))


def _record(page_id, url, body: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(body)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = b""
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the records; none if there is too little to learn from."""
    samples, size = [], 0
    for r in records:
        for i in range(0, len(r), SAMPLE):
            samples.append(r[i:i + SAMPLE])
        size += len(r)
        if size >= TRAIN_BYTES:
            break
    if len(samples) < 16:
        return None
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, size // 8)), samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


class _Archive:
    """One file in the making: keeps records until the dictionary can be trained, then streams frames."""

    def __init__(self, fs, folder: str):
        self.fs, self.name = fs, f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.out = fs.open_output_stream(self.name + ".part", compression=None)
        self.waiting: list[bytes] = []
        self.kept = self.size = self.n = 0
        self.zip = None

    def add(self, record: bytes) -> None:
        self.n += 1
        if self.zip is None:
            self.waiting.append(record)
            self.kept += len(record)
            if self.kept >= TRAIN_BYTES:
                self._start()
        else:
            self._put(self.zip.compress(record))

    def _start(self) -> None:
        made = train(self.waiting)
        if made is not None:
            raw = made.as_bytes()
            self._put(struct.pack("<II", _SKIPPABLE, len(raw)) + raw)
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True)
        for r in self.waiting:
            self._put(self.zip.compress(r))
        self.waiting = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        if self.zip is None:
            self._start()
        self.out.close()
        self.fs.move(self.name + ".part", self.name)
        return self.name, self.n, self.size


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write one record per row; a table (file, records, bytes) of the archives, itself stored in the folder."""
    spark = pages.sparkSession
    folder = folder or run_dir(spark, "warc")

    def write(batches):
        fs, path = open_dir(folder)
        fs.create_dir(path, recursive=True)
        archive = None
        done = []
        for df in batches:
            for r in df.itertuples(index=False):
                if archive is None:
                    archive = _Archive(fs, path)
                archive.add(_record(None if pd.isna(r.page_id) else int(r.page_id), r.url, r.body, r.digest, None if pd.isna(r.refers_to) else int(r.refers_to)))
                if archive.size + archive.kept * (archive.zip is None) >= FILE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pd.DataFrame([(os.path.basename(f), n, b) for f, n, b in done], columns=["file", "records", "bytes"])

    return cut_lineage(plan_records(pages).mapInPandas(write, "file string, records long, bytes long").withColumn("folder", F.lit(folder)))


def read_frames(stream):
    """The records of an archive, one after the other, holding one chunk and one record at a time."""
    data, at, end = b"", 0, False

    def more(n: int) -> bool:
        nonlocal data, at, end
        while len(data) - at < n and not end:
            got = stream.read(1 << 20)
            if not got:
                end = True
            else:
                data, at = data[at:] + got, 0
        return len(data) - at >= n

    made = None
    while more(8):
        magic, n = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            more(8 + n)
            if magic == _SKIPPABLE and made is None:
                made = zstandard.ZstdCompressionDict(data[at + 8:at + 8 + n])
            at += 8 + n
            continue
        one = zstandard.ZstdDecompressor(dict_data=made).decompressobj() if made else zstandard.ZstdDecompressor().decompressobj()
        out = []
        while not one.eof:
            if not more(1):
                raise ValueError("archive ends within a frame")
            out.append(one.decompress(data[at:]))
            data, at = one.unused_data if one.eof else b"", 0
        yield b"".join(out)


def _parse(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    field = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[:int(field["Content-Length"])]
    number = lambda s: int(s[len("<urn:page:"):-1]) if s and len(s) > len("<urn:page:>") else None
    kind = field["WARC-Type"]
    digest = hashlib.sha256(body).hexdigest() if kind == "response" else field["WARC-Payload-Digest"].split(":")[1]
    if kind == "response" and field["WARC-Payload-Digest"] != f"sha256:{digest}":
        raise ValueError("payload does not match its digest")
    return number(field["WARC-Record-ID"]), field.get("WARC-Target-URI"), int(field["WARC-Payload-Length"]), digest, kind, number(field.get("WARC-Refers-To")), body


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """One row per record of the listed archives."""
    def read(batches):
        for df in batches:
            for r in df.itertuples(index=False):
                fs, path = open_dir(r.folder)
                rows, size = [], 0
                with fs.open_input_stream(f"{path}/{r.file}", compression=None) as s:
                    for record in read_frames(s):
                        row = _parse(record)
                        rows.append(row if payload else row[:-1])
                        size += len(record) if payload else 256
                        if size > 8 << 20:
                            yield _frame(rows, payload)
                            rows, size = [], 0
                yield _frame(rows, payload)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    # A file is the unit of work; dealing files by name spreads what one large task has written.
    return archives.repartition(n_parts(archives.sparkSession), "file").mapInPandas(read, schema)


def _frame(rows: list[tuple], payload: bool) -> pd.DataFrame:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    df = pd.DataFrame(rows, columns=names)
    return df.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})
