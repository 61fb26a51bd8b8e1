r"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id. Ranges are stretches of ids with about ``partition_bytes`` of payload, from
exact sums over cells of ids that are cut until each is small, so that the same pages always give the same
files, wherever their ids lie. Each range is
written as gzip members into archive files that roll when the compressed size passes a limit; headers and
digests are generated anew from the payload. A file gets a temporary name that only this attempt of the
task uses; the rows that the tasks return (temporary and final name, records, bytes, digest) are written as
a table. Only then does a second job move these files to their final names and check that each is there
with its size; leavings of attempts that were lost or ran twice are deleted. The manifest of final names is
written into the folder last of all. A reader takes the files that it names, no others, and checks records,
bytes and digests: a folder without a manifest, or with a file lost or changed, fails.

Of records with equal payloads of at least ``revisit_bytes`` the one with the smallest page id is a
response and the others are revisits, which carry no payload but its length and digest.

Defined results: a null payload is empty; a null url gives no target header; control characters in a
url are percent-encoded; rows that repeat page id and payload are all responses or all revisits of one
page; a null page id sorts first, refers to an equal page that has an id, and is else a response; an
empty table gives a manifest without files and no rows; other input columns are not archived.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repertoire.llm._shared import bounded, fresh_path, join_counted, ship, written

ROLL_BYTES = 8 << 20
PARTITION_BYTES = 16 << 20
#: Ranges, at most (beyond, they grow; their rows are streamed, never held), and cells that are counted in a round.
RANGES, CELLS = 20_000, 200_000
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "temporary string, final string, records long, bytes long, sha256 string"
_NAMES = [c.split()[0] for c in _MANIFEST.split(", ")]
_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {_clean(url)}"]),
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(data: bytes, step: int = 4096):
    """The decompressed gzip members of an archive, one by one."""
    at = 0
    while at < len(data):
        d, out = zlib.decompressobj(31), []
        while not d.eof and at < len(data):
            piece = data[at : at + step]
            out.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """The fields of one record; digests and lengths are checked against what the record holds."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (length != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    page = lambda name: int(m[1]) if (m := re.match(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    return {
        "page_id": page("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "refers_to": page("WARC-Refers-To"),
        "payload_bytes": length,
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def _write(folder: str, roll: int, token: str):
    def write(batches):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        attempt = f"{token}-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        state = {"part": None, "roll": 0, "out": None}
        done = []

        def close():
            if state["out"] is not None:
                state["out"].close()
                done.append((state["temporary"], f"part-{state['part']:06d}-{state['roll']:06d}.warc.gz", state["n"], state["size"], state["sha"].hexdigest()))
                state.update(out=None, roll=state["roll"] + 1)

        for b in batches:
            for page_id, url, html, refers, part in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if part != state["part"]:
                    close()
                    state.update(part=part, roll=0)
                if state["out"] is None:
                    name = f"_temporary-{part:06d}-{state['roll']:06d}-{attempt}"
                    state.update(temporary=name, out=store.open_output_stream(f"{root}/{name}"), n=0, size=0, sha=hashlib.sha256())
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = z.compress(record(page_id, url, html.encode(), refers)) + z.flush()
                state["out"].write(data)
                state["sha"].update(data)
                state["n"] += 1
                state["size"] += len(data)
                if state["size"] >= roll:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                names=_NAMES,
            )

    return write


def _commit(folder: str):
    def commit(batches):
        store, root = _store(folder)
        for b in batches:
            for temporary, final, size in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                old, new = f"{root}/{temporary}", f"{root}/{final}"
                if store.get_file_info(old).type != pafs.FileType.NotFound:
                    store.move(old, new)
                there = store.get_file_info(new)  # moved now, or by an earlier attempt
                if there.type == pafs.FileType.NotFound or there.size != size:
                    raise FileNotFoundError(f"{final}: neither it nor its temporary file is there whole")
            yield b

    return commit


def _clear(folder: str, token: str) -> None:
    """Deletes what lost attempts of this write left."""
    store, root = _store(folder)
    for f in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f.base_name.startswith("_temporary-") and f"-{token}-" in f.base_name:
            store.delete_file(f.path)


def with_revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for responses."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    keyed = rows.withColumn("digest", F.when(F.octet_length("html") >= revisit_bytes, F.sha2("html", 256)))
    firsts = keyed.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = written(firsts, "originals")
    alone = keyed.where("digest is null").select("*", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("n"))
    joined = join_counted(keyed.where("digest is not null"), bounded(firsts), ["digest"], "n", "left").unionByName(alone)
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def id_cells(ids: DataFrame, low: int, high: int, aim: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Disjoint stretches of ids as (first, bytes) of at most ``aim`` bytes each, and the ids (id, bytes) that have more on
    their own. ``ids``: (page_id, bytes). Cells of equal width are counted; those that are too large are cut anew from
    their own first to last id, until none is, so that neither a far id nor ids that cluster matter."""
    spark = ids.sparkSession
    left = ids.withColumn("cell", F.lit(low).cast("long"))
    large, light, hot = [(low, low, high)], None, []
    while large:  # at most bytes / aim cells, so a bounded list
        each = max(2, CELLS // len(large))
        cut = spark.createDataFrame([(cell, first, Decimal(-(-(last - first + 1) // each))) for cell, first, last in large], "cell long, lo long, width decimal(20,0)")
        wide = lambda c: F.col(c).cast("decimal(20,0)")
        at = F.expr("(cast(page_id as decimal(20,0)) - cast(lo as decimal(20,0))) div width").cast("decimal(20,0)")
        left = left.join(F.broadcast(cut), "cell").select("page_id", "bytes", (wide("lo") + at * F.col("width")).cast("long").alias("cell"))
        cells = written(left.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.min("page_id").alias("first"), F.max("page_id").alias("last")), "cells")
        over = cells.where(F.col("bytes") > aim).collect()
        hot += [(r["first"], r["bytes"]) for r in over if r["first"] == r["last"]]
        large = [(r["cell"], r["first"], r["last"]) for r in over if r["first"] < r["last"]]
        found = cells.where(F.col("bytes") <= aim).select("first", "bytes")
        light = found if light is None else light.unionAll(found)
        if large:
            kept = spark.createDataFrame([(c,) for c, *_ in large], "cell long")
            left = written(left.join(F.broadcast(kept), "cell", "left_semi"), "ids")
    return light, hot


def with_ranges(pages: DataFrame, partition_bytes: int) -> tuple[DataFrame, int]:
    """(``pages`` with ``part``, number of parts): stretches of page ids of at most twice ``partition_bytes`` (or twice the
    mean of ``RANGES`` parts). Rows of one id that have more, and rows without an id, which come first, are
    dealt to several parts by a hash of their content."""
    size = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)).cast("long")
    nameless = F.sum(F.when(F.col("page_id").isNull(), size + 1))
    low, high, total, blank = pages.agg(F.min("page_id"), F.max("page_id"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(nameless, F.lit(0))).first()
    aim = max(partition_bytes, -(-total // RANGES), 1)
    blanks = -(-blank // aim)
    starts, parts = [0], [1]
    if low is not None:
        light, hot = id_cells(pages.where("page_id is not null").select("page_id", size.alias("bytes")), low, high, aim)
        before = F.coalesce(F.sum("bytes").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cuts = light.select("first", F.floor(before / F.lit(aim)).alias("part")).groupBy("part").agg(F.min("first").alias("first"))
        bounds = {r["first"]: 1 for r in cuts.collect()} | {i + 1: 1 for i, _ in hot if i + 1 < 1 << 63} | {i: -(-n // aim) for i, n in hot}
        bounds.setdefault(low, 1)
        starts, parts = sorted(bounds), [bounds[k] for k in sorted(bounds)]
    edge, many = np.array(starts[1:], np.int64), np.array(parts, np.int64)
    base = blanks + np.cumsum(many) - many

    @F.pandas_udf("int")
    def place(ids: pd.Series, h: pd.Series) -> pd.Series:
        k = np.searchsorted(edge, ids.to_numpy(np.int64), "right")
        return pd.Series((base[k] + h.to_numpy(np.int64).view(np.uint64) % many[k].astype(np.uint64)).astype(np.int64)).astype("int32")

    content = F.xxhash64("url", "html")
    part = F.when(F.col("page_id").isNull(), F.pmod(content, F.lit(max(1, blanks))).cast("int")).otherwise(place(F.coalesce("page_id", F.lit(0)), content))
    return pages.withColumn("part", part), int(blanks + many.sum())


def write_warc(pages: DataFrame, folder: str, *, roll_bytes: int = ROLL_BYTES, partition_bytes: int = PARTITION_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives below ``folder``; returns the manifest table."""
    ship(pages.sparkSession)
    token = uuid.uuid4().hex
    ranged, parts = with_ranges(with_revisits(pages, revisit_bytes), partition_bytes)
    records = ranged.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "page_id", "url", "html")
    moved = written(records.select("page_id", "url", "html", "refers_to", "part").mapInArrow(_write(folder, roll_bytes, token), _MANIFEST), "warc-manifest")
    done = written(moved.mapInArrow(_commit(folder), _MANIFEST), "warc-committed")
    _clear(folder, token)
    done.write.parquet(f"{folder}/manifest")
    return done


def _read(folder: str):
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in _RECORDS.split(", ")]

    def read(batches):
        store, root = _store(folder)
        for b in batches:
            for final, records, size, sha in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                with store.open_input_file(f"{root}/{final}") as f:  # a stream would unpack it
                    content = f.read()
                rows = [parse(m) for m in members(content)]
                if len(content) != size or len(rows) != records or hashlib.sha256(content).hexdigest() != sha:
                    raise ValueError(f"{final} is not what the manifest says")
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    return read


def read_warc(spark, folder: str) -> DataFrame:
    """Every record of the archives that the manifest below ``folder`` names; files, digests and counts are checked."""
    ship(spark)
    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("final", "records", "bytes", "sha256")
    n = files.count()
    return files.repartition(max(1, min(n, RANGES)), "final").mapInArrow(_read(folder), _RECORDS)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """The query's columns: writes all pages, then reads the archives."""
    folder = fresh_path(pages.sparkSession, "warc")
    write_warc(pages, folder)
    return read_warc(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
