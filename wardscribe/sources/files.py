"""Sources and sinks: recordings, images, transcripts, dictionaries and results."""

from __future__ import annotations

import io
import re
import struct
import tempfile
import uuid
import wave
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.audio import error_code

RATE = 16000


def shared_folder(spark: SparkSession) -> str:
    """A new folder for streams and outboxes where driver and executors both reach: below spark.checkpoint.dir; where that is unset, a temporary one on a local master (tests), else an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}" if top else tempfile.mkdtemp(prefix="shared-")


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, rate, channels, duration, samples, error_code) of WAV files: mono floats at 16 kHz by the index before; bad files keep a code (422 if they cannot be decoded) instead of raising. Spark lists no empty files."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, size, content in zip(b["path"], b["length"], b["content"]):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        kind = {1: np.int8, 2: np.int16, 4: np.int32}[w.getsampwidth()]
                        y = np.frombuffer(w.readframes(w.getnframes()), kind).reshape(-1, w.getnchannels()).mean(1) / float(np.iinfo(kind).max + 1)
                        rate, channels, seconds = w.getframerate(), w.getnchannels(), w.getnframes() / w.getframerate()
                    at = np.minimum((np.arange(int(len(y) * RATE / rate)) * rate / RATE).astype(int), len(y) - 1)
                    rows.append((name, size, rate, channels, seconds, y[at].astype(np.float32).tolist()))
                except (wave.Error, EOFError, KeyError, ValueError):
                    rows.append((name, size, None, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "size", "rate", "channels", "duration", "samples"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "length", "content")
    out = raw.mapInPandas(decode, "path string, size long, rate int, channels int, duration double, samples array<float>")
    return out.withColumn("error_code", F.coalesce(error_code(F.col("size"), F.col("duration")), F.when(F.col("samples").isNull(), 422)))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, path, content) of .png, .jpg and .jpeg files; the id is made of the name and the content's hash."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").load(path)
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1), "[^A-Za-z0-9_-]", "_")
    return raw.select(image_job_id(stem, F.col("content")).alias("job_id"), "path", "content")


def image_job_id(stem, content):
    return F.concat(F.lit("img-"), F.substring(stem, 1, 12), F.lit("-"), F.substring(F.sha2(content, 256), 1, 8))


def register(jobs: DataFrame, key: str, order: str) -> DataFrame:
    """(key, job_id, duplicate) for each row: the id is the first eight digits of the key's SHA-1; all but the first row of a key are duplicates."""
    first = jobs.groupBy(key).agg(F.min(order).alias("_first"))
    return jobs.join(first, key).select(key, order, F.substring(F.sha1(F.col(key).cast("string")), 1, 8).alias("job_id"), (F.col(order) != F.col("_first")).alias("duplicate"))


def unfinished(jobs: DataFrame, *done: DataFrame) -> DataFrame:
    """Jobs that lack one of the outputs."""
    have = done[0].select("job_id").distinct()
    for d in done[1:]:
        have = have.join(d.select("job_id"), "job_id", "left_semi")
    return jobs.join(have, "job_id", "left_anti")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One line of UTF-8 JSON a row."""
    df.write.mode(mode).json(path)


def append_audit(audit: DataFrame, path: str) -> None:
    """Adds rows to the trail; earlier rows are never rewritten."""
    audit.write.mode("append").parquet(path)


def write_html(pages: DataFrame, path: str) -> None:
    pages.select("html").write.mode("overwrite").text(path)


_DOCX = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}


_PARTS = {name: content.encode() for name, content in _DOCX.items()}
_DOCUMENT = '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>%s</w:body></w:document>'
_OPEN, _CLOSE = '<w:p><w:r><w:t xml:space="preserve">', "</w:t></w:r></w:p>"
_CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _member(name: str, content: bytes, at: int) -> tuple[bytes, bytes]:
    """A stored member of a zip file that starts at byte `at`, and its entry of the directory, both without the clock."""
    # version, flags, method, time and date of 1980-01-01, checksum, sizes, lengths of the name and of what follows it
    facts = struct.pack("<HHHHHLLLHH", 20, 0, zipfile.ZIP_STORED, 0, 33, zlib.crc32(content), len(content), len(content), len(name), 0)
    path = name.encode()
    entry = b"PK\x01\x02" + struct.pack("<BB", 20, 3) + facts + struct.pack("<HHHLL", 0, 0, 0, 0o600 << 16, at) + path
    return b"PK\x03\x04" + facts + path + content, entry


def _frame() -> tuple[bytes, bytes]:
    """The members that all documents share and their entries."""
    body = entries = b""
    for name, content in _PARTS.items():
        member, entry = _member(name, content, len(body))
        body, entries = body + member, entries + entry
    return body, entries


_FRAME = _frame()


@F.pandas_udf(T.BinaryType())
def docx(lines: pd.Series) -> pd.Series:
    """A word-processing file of an array of lines, one paragraph each; equal lines give equal bytes.

    The parts that all files share are made once, not for each file.
    """
    head, entries = _FRAME

    def one(some) -> bytes:
        clean = [_CONTROLS.sub("", x) if x else "" for x in (some if some is not None else [])]
        body = _OPEN + escape("\0".join(clean)).replace("\0", _CLOSE + _OPEN) + _CLOSE if clean else ""  # no clean line has the mark
        member, entry = _member("word/document.xml", (_DOCUMENT % body).encode(), len(head))
        directory = entries + entry
        count = len(_PARTS) + 1
        return head + member + directory + b"PK\x05\x06" + struct.pack("<HHHHLLH", 0, 0, count, count, len(directory), len(head) + len(member), 0)

    return lines.map(one)


def render_docx(slots: DataFrame) -> DataFrame:
    """(job_id, docx): the fields of a note in key order, as files in a column."""
    s = slots.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("key", "text"))).alias("r"))
    return s.select("job_id", docx(F.transform("r", lambda x: F.concat_ws(": ", x["key"], x["text"]))).alias("docx"))


def note_docx(notes: DataFrame) -> DataFrame:
    """render_docx of notes(job_id, slots), whose fields are an array of the note's row."""
    lines = F.array_sort(F.transform("slots", lambda s: F.struct(s["key"].alias("key"), s["text"].alias("text"))))
    return notes.select("job_id", docx(F.transform(lines, lambda x: F.concat_ws(": ", x["key"], x["text"]))).alias("docx"))


def write_docx(files: DataFrame, path: str) -> None:
    """Files as rows of Parquet: a file for each note would be millions of small ones."""
    files.select("job_id", "docx").write.mode("overwrite").parquet(path)
