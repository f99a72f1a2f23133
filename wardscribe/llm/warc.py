"""WARC archives: records written by Spark's text writer, read back by boundary-chain verification.

Writing: a record is a header, a blank line and a block; the writer's separator
is the record's end. Of records with equal payloads from a size on one is a
response, the others revisit it.

Reading: Spark's text reader cuts the files at the magic `WARC/1.` and splits
large files. Each row is a candidate record, for the magic may be a part of a
payload. The rows of a split are in order, so a task knows each candidate's
offset from its split's first row; sums of the splits before give the offset in
the file. Each candidate names its successor, the offset after its declared
length. Inside a split successors are followed at once to the first one beyond
it; from split to split they are followed by pointer jumping from the start of
each file, doubling the distance with each join. What is not reached is no
record. Records whose payload holds the magic fill more than one row; those
alone are read again and put together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import cut
from .textkit import tidy

MAGIC, END = "WARC/1.", "\r\n\r\n"
#: Payloads that occur more than once are broadcast up to this number, beyond it pages are shuffled by digest.
SEVERAL = 100_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = 65536  # a header that does not end within so many bytes is none
_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)[ \t]*\r?$", re.M)


def _crlf(*lines: Column) -> Column:
    return F.concat_ws("\r\n", *lines)


def _plain(col: Column) -> Column:
    """A header value: control characters as percent codes."""
    x = col
    for c in ("\r", "\n", "\0"):
        x = F.replace(x, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return x


def records_of(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html and: payload (null: empty), bytes, digest, type, refers_to.

    Of payloads that are equal and have `least` bytes or more the largest page_id
    is the response, the others refer to it; rows that repeat it are responses
    too. A null page_id is larger than none. An empty table gives an empty one.
    """
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    d = d.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    several = d.where(F.col("bytes") >= least).groupBy("digest").agg(F.count("*").alias("many"), F.max("page_id").alias("first")).where("many > 1 and first is not null").select("digest", "first")
    several = cut(several)
    few = several.limit(SEVERAL + 1).count() <= SEVERAL
    several = F.broadcast(several) if few else several.hint("merge")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return d.join(several, "digest", "left").select("page_id", "url", "payload", "bytes", "digest", F.when(other, "revisit").otherwise("response").alias("type"), F.when(other, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for each row of pages (page_id, url, html) to files in a new folder: responses as HTTP messages, revisits with a header alone."""
    d = records_of(pages, least)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    block = F.when(F.col("type") == "response", F.concat(http, "payload")).otherwise(F.lit(f"HTTP/1.1 200 OK{END}"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    head = _crlf(
        F.lit(f"{MAGIC}1"),
        F.concat(F.lit("WARC-Type: "), "type"),
        F.concat(F.lit("WARC-Record-ID: "), urn("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), _plain(F.col("url")))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(F.col("type") == "revisit", _crlf(F.concat(F.lit("WARC-Refers-To: "), urn("refers_to")), F.lit(f"WARC-Profile: {REVISIT}"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block")),
    )
    d = d.withColumn("block", block).select(F.concat(head, F.lit(END), "block").alias("value"))
    d.write.option("lineSep", END).text(path)


def _head(row: bytes) -> tuple[dict[str, str], int]:
    """Fields by name in small letters, and the offset of the block; no fields and -1 if the row does not go on like a record's header."""
    end = row.find(b"\r\n\r\n", 0, _HEAD)
    if end < 0 or row[1:3] != b"\r\n" or not 48 <= row[0] <= 57:
        return {}, -1
    fields = {k.decode("latin-1").lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(row[3:end])}
    length = fields.get("content-length", "")
    return (fields, end + 4) if length.isascii() and length.isdigit() and len(length) < 19 else ({}, -1)


def _is_http(fields: dict[str, str]) -> bool:
    return fields.get("content-type", "").lower().startswith("application/http")


def _payload(http: bool, block: bytes) -> bytes:
    """The body of an HTTP message, else the block."""
    if not http:
        return block
    at = block.find(b"\r\n\r\n")
    return block[at + 4 :] if at >= 0 else b""


_KEPT = {"type": "warc-type", "record_id": "warc-record-id", "url": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "declared": "warc-payload-digest"}
_TYPES = {"file": "string", "split": "long", "place": "long", "next": "long", "head": "long", "size": "long", "whole": "boolean", "http": "boolean", "bytes": "long", "digest": "string"} | dict.fromkeys(_KEPT, "string") | {"payload": "binary"}
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[dict], types: dict[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], _ARROW[t]) for k, t in types.items()], list(types))


def _ddl(types: dict[str, str]) -> str:
    return ", ".join(f"{k} {t}" for k, t in types.items())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int, bytes]]]:
    """(file, split, place, bytes) of what lies between magics; place is counted from the first piece of its split."""
    now, at = None, 0
    for b in batches:
        out = []
        for row, file, split in zip(b["row"].to_pylist(), b["file"].to_pylist(), b["split"].to_pylist()):
            if (file, split) != now:
                now, at = (file, split), 0
            out.append((file, split, at, row))
            at += len(row) + len(MAGIC)
        yield out


def _texts(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.option("lineSep", MAGIC).text(path)
    return t.select(F.col("value").cast("binary").alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def _candidates(with_payload: bool):
    @tidy
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _pieces(batches):
            out = []
            for file, split, place, row in pieces:
                fields, head = _head(row)
                length = int(fields["content-length"]) if fields else 0
                r = {"file": file, "split": split, "place": place, "next": -1, "head": head, "size": len(row), "whole": False} | {k: fields.get(v) for k, v in _KEPT.items()}
                if fields:
                    r["next"], r["http"] = place + head + length + len(END) + len(MAGIC), _is_http(fields)
                    if len(row) in (head + length + len(END), head + length):
                        body = _payload(r["http"], row[head : head + length])
                        r |= {"whole": True, "bytes": len(body), "digest": hashlib.sha1(body).hexdigest(), "payload": body if with_payload else None}
                out.append(r)
            yield _batch(out, _TYPES)

    return parse


@tidy
def _exits(table: pa.Table) -> pa.Table:
    """For each candidate of a split the first offset beyond the split that its successors come to; -1 if they miss the candidates on the way."""
    t = table.sort_by("place")
    place, after, end = (t[k].to_numpy() for k in ("place", "next", "span"))
    leave = np.full(len(place), -1, np.int64)
    at = np.searchsorted(place, after)
    for k in range(len(place) - 1, -1, -1):
        if after[k] >= end[k]:
            leave[k] = after[k]
        elif after[k] >= 0 and place[at[k]] == after[k]:
            leave[k] = leave[at[k]]
    return pa.table({"file": t["file"], "place": pa.array(place + t["base"].to_numpy()), "next": pa.array(np.where(leave < 0, -1, leave + t["base"].to_numpy()))})


@tidy
def _reached(table: pa.Table, entry: pa.Table) -> pa.Table:
    """The candidates of a split that its entry's successors come to."""
    places: list[int] = []
    if table.num_rows and entry.num_rows:
        t = table.sort_by("place")
        place, after = t["place"].to_numpy(), t["next"].to_numpy()
        at = entry["place"][0].as_py()
        k = int(np.searchsorted(place, at))
        while k < len(place) and place[k] == at and after[k] >= 0:
            places.append(at)
            at = after[k]
            k = int(np.searchsorted(place, at))
    n = len(places)
    file, split = (table["file"][0].as_py(), table["split"][0].as_py()) if n else ("", 0)
    return pa.table({"file": pa.array([file] * n, pa.string()), "split": pa.array([split] * n, pa.int64()), "place": pa.array(places, pa.int64())})


def _entries(hops: DataFrame) -> DataFrame:
    """(file, place): where the chains come to from place 0 of each file. hops: file, place, next. The distance doubles with each round."""
    seen = cut(hops.where("place = 0").select("file", "place"))
    n = seen.count()
    while True:
        more = seen.join(hops, ["file", "place"]).select("file", F.col("next").alias("place"))
        seen = cut(seen.union(more).distinct())
        before, n = n, seen.count()
        if n == before:
            return seen
        far = hops.select("file", F.col("place").alias("next"), F.col("next").alias("then"))
        hops = cut(hops.join(far, ["file", "next"], "left").select("file", "place", F.coalesce("then", "next").alias("next")))


def _put_together(spark: SparkSession, path: str, rows: DataFrame, broken: DataFrame, owners: DataFrame, with_payload: bool) -> DataFrame:
    """file, at, bytes, digest, payload of the records that fill several pieces; those that end before their declared length are left out."""
    last = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    mine = rows.join(owners, ["file", "split", "place"], "left").withColumn("owner", F.last("owner", ignorenulls=True).over(last))
    mine = mine.join(broken.select("file", F.col("at").alias("owner"), "head", "until", "http"), ["file", "owner"]).where("at < until")
    mine = mine.select("file", "split", "place", "at", "owner", "head", "until", "http")
    ends = {"file": "string", "at": "long", "bytes": "long", "digest": "string", "payload": "binary"}
    kinds = {"file": "string", "split": "long", "place": "long", "row": "binary"}

    @tidy
    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _pieces(batches):
            yield _batch([dict(zip(kinds, p)) for p in pieces], kinds)

    @tidy
    def join(table: pa.Table) -> pa.Table:
        t = table.sort_by("at")
        at, head, until = (t[k][0].as_py() for k in ("owner", "head", "until"))
        length = until - at - head - len(END) - len(MAGIC)
        whole, out = MAGIC.encode().join(t["row"].to_pylist()), []
        if len(whole) >= head + length:
            body = _payload(t["http"][0].as_py(), whole[head : head + length])
            out.append({"file": t["file"][0].as_py(), "at": at, "bytes": len(body), "digest": hashlib.sha1(body).hexdigest(), "payload": body if with_payload else None})
        return pa.Table.from_batches([_batch(out, ends)])

    texts = _texts(spark, path).mapInArrow(again, _ddl(kinds))
    return texts.join(mine, ["file", "split", "place"]).groupBy("file", "owner").applyInArrow(join, _ddl(ends))


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records of the archives in a folder: file, offset, type, record_id, url, date, refers_to, declared, bytes, digest, and with payload the payload.

    bytes and digest (bare SHA-1) are of the payload that is there: the body of an
    HTTP message, else the block. Uncompressed files are split; compressed ones
    are read by a task each. Bytes between records that belong to none end their
    file's chain, as does a record that the file does not hold to its end: what
    follows is not returned. Files without records give none.
    """
    rows = cut(_texts(spark, path).mapInArrow(_candidates(payload), _ddl(_TYPES)))
    sizes = rows.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("span"))
    before = F.sum("span").over(Window.partitionBy("file").orderBy("split"))
    sizes = cut(sizes.select("file", "split", (before - F.col("span")).alias("base"), "span"))
    marks = rows.select("file", "split", "place", "next").join(sizes, ["file", "split"])
    leave = cut(marks.groupBy("file", "split").applyInArrow(_exits, "file string, place long, next long"))
    # a file begins with the magic, so the piece before it is empty and the first record's text has the magic's length for its place
    first = leave.where(F.col("place") == len(MAGIC)).select("file", F.lit(0).cast("long").alias("place"), F.col("place").alias("next"))
    hops = leave.where("next >= 0").union(first)
    chain = cut(hops.join(hops.select("file", F.col("next").alias("place")).distinct().union(first.select("file", "place")), ["file", "place"], "left_semi"))
    entry = _entries(chain).join(sizes, "file").where("place > 0 and place >= base and place < base + span")
    entry = entry.select("file", "split", (F.col("place") - F.col("base")).alias("place"))
    reached = rows.select("file", "split", "place", "next").groupBy("file", "split").cogroup(entry.groupBy("file", "split")).applyInArrow(_reached, "file string, split long, place long")
    reached = cut(reached)
    placed = rows.join(sizes, ["file", "split"]).withColumn("at", F.col("base") + F.col("place")).withColumn("until", F.col("base") + F.col("next")).drop("base", "span")
    records = placed.join(reached, ["file", "split", "place"])
    broken = records.where("not whole").select("file", "at", "head", "until", "http")
    if not broken.isEmpty():
        owners = records.select("file", "split", "place", F.col("at").alias("owner"))
        mended = _put_together(spark, path, placed.select("file", "split", "place", "at"), broken, owners, payload)
        shown = ["bytes", "digest", "payload"]
        records = records.where("whole").unionByName(records.drop(*shown).join(mended, ["file", "at"]))
    out = records.select("file", (F.col("at") - len(MAGIC)).alias("offset"), *_KEPT, "bytes", "digest", "payload")
    return out if payload else out.drop("payload")


def payloads_of(records: DataFrame) -> DataFrame:
    """records with payload_bytes and payload_digest: a revisit has those of the response that it refers to, null if that is in no archive."""
    shown = records.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.concat(F.lit("sha1:"), "digest").alias("declared"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest")).distinct()
    own = records.where("type != 'revisit'").select("*", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    return own.unionByName(records.where("type = 'revisit'").join(shown, ["refers_to", "declared"], "left"))
