"""Operator 9, media columns: chroma audio fingerprints and their alignment.

A recording (WAV bytes) is cut into frames, each frame's spectrum is folded into twelve
pitch classes, and sixteen filters over the integral image of a run of frames give two
bits each: a packed 32-bit integer per frame. A recording is aligned with reference
recordings through equal integers: their frame differences form an offset histogram for
each reference, and the best offsets are verified by bit errors over the whole overlap.

Fingerprinting is an Arrow map over recordings and over references, which are indexed at
several sub-frame shifts. Its results are stored; alignment is a join on the integers, a
count by offset, and a second join that brings the bits of voted pairs together.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import stored, table


@dataclass(frozen=True)
class Chroma:
    """How recordings are cut. The defaults suit music at 11,025 Hz: 0.37 s frames, a third apart."""

    frame: int = 4096
    hop: int = 1365
    low: float = 28.0
    high: float = 3520.0
    #: Sub-frame shifts at which references are indexed.
    shifts: int = 1
    #: A vote is an integer that is equal, or with two also the next one: for recordings whose integers tell little apart.
    run: int = 1
    #: A match has this many votes, so many for each frame that overlaps, and at most this share of wrong bits.
    votes: int = 2
    share: float = 0.0
    errors: float = 0.25

    def shortest(self) -> int:
        return self.frame + (RUN - 1) * self.hop


#: Frames that one integer looks at, and its filters: (kind, first pitch class, classes, first frame, frames).
RUN = 8
FILTERS = tuple((k % 6, (5 * k) % 9, 3 + k % 2 if k % 3 else 4, k % 2 * 2, 8 - k % 2 * 2 if k % 4 else 4) for k in range(16))
#: Limits of the three steps from 0 to 3 that a filter's value takes, and their Gray codes.
STEPS, GRAY = (-0.25, 0.0, 0.25), np.array([0, 1, 3, 2], np.uint32)


def samples(media: bytes | None) -> tuple[np.ndarray, int] | None:
    """Mono samples in -1..1 and their rate from 8- or 16-bit PCM WAV bytes; None if they are not that."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form, data = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(media):
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or data is None or form[0] != 1 or form[1] < 1 or form[2] < 1 or form[5] not in (8, 16):
        return None
    x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128 if form[5] == 8 else np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float32) / 32768
    x = x[: len(x) // form[1] * form[1]].reshape(-1, form[1]).mean(1)
    return x, form[2]


@lru_cache(16)
def _tables(frame: int, rate: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """The window, and which pitch class each bin of a spectrum counts for."""
    bins = np.arange(frame // 2 + 1) * rate / frame
    classes = np.zeros((len(bins), 12), np.float32)
    for i in np.flatnonzero((bins >= low) & (bins <= high)):
        classes[i, round(12 * np.log2(bins[i] / 440)) % 12] = 1
    return np.hanning(frame).astype(np.float32), classes


def integers(x: np.ndarray, rate: int, chroma: Chroma) -> tuple[np.ndarray, np.ndarray]:
    """The recording's integers, and which of them hear anything. A short recording is padded with silence to one."""
    if not len(x):
        return np.empty(0, np.uint32), np.empty(0, bool)
    if len(x) < chroma.shortest():
        x = np.concatenate((x, np.zeros(chroma.shortest() - len(x), np.float32)))
    window, classes = _tables(chroma.frame, rate, chroma.low, chroma.high)
    frames = np.lib.stride_tricks.sliding_window_view(x, chroma.frame)[:: chroma.hop]
    folded = np.empty((len(frames), 12), np.float32)
    for at in range(0, len(frames), 4096):
        spectrum = np.fft.rfft((frames[at : at + 4096] - frames[at : at + 4096].mean(1, keepdims=True)) * window)
        folded[at : at + 4096] = (spectrum.real**2 + spectrum.imag**2) @ classes
    loud = np.sqrt((folded**2).sum(1, keepdims=True))
    folded = np.where(loud > 1e-6, folded / np.maximum(loud, 1e-6), 0)
    image = np.zeros((len(folded) + 1, 13))
    image[1:, 1:] = folded.cumsum(0, dtype=float).cumsum(1)
    n = len(folded) - RUN + 1

    def area(y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
        a, b = image[x0 : x0 + n], image[x1 : x1 + n]
        return (b[:, y1] - b[:, y0] - a[:, y1] + a[:, y0]) / ((y1 - y0) * (x1 - x0))

    out = np.zeros(n, np.uint32)
    for kind, y, h, x0, w in FILTERS:
        y1, x1, ym, xm = y + h, x0 + w, y + h // 2, x0 + w // 2
        if kind == 0:  # against all classes
            plus, minus = area(y, y1, x0, x1), area(0, 12, x0, x1)
        elif kind == 1:  # low against high
            plus, minus = area(y, ym, x0, x1), area(ym, y1, x0, x1)
        elif kind == 2:  # early against late
            plus, minus = area(y, y1, x0, xm), area(y, y1, xm, x1)
        elif kind == 3:  # two corners against the other two
            plus = area(y, ym, x0, xm) + area(ym, y1, xm, x1)
            minus = area(ym, y1, x0, xm) + area(y, ym, xm, x1)
        elif kind == 4:  # the middle in time against its sides
            plus, minus = area(y, y1, x0 + w // 4, x1 - w // 4), area(y, y1, x0, x1)
        else:  # the middle in pitch against its sides
            plus, minus = area(y + 1, y1 - 1, x0, x1), area(y, y1, x0, x1)
        value = np.log((plus + 0.01) / (minus + 0.01))
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(STEPS, value)]
    return out, (loud[:, 0] > 1e-6)[:n]


def fingerprints(df: DataFrame, chroma: Chroma, id_col: str, media_col: str, shifts: int = 1) -> DataFrame:
    """(id, shift, n_frames, crc32, ints, heard) for each row and sub-frame shift.

    Later shifts of media too short for a whole integer have none; at shift 0 it is padded.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shift, found = [], [], []
            for row, data in enumerate(batch.column(1)):
                decoded = samples(data.as_py())
                for s in range(shifts):
                    x = decoded[0][s * chroma.hop // chroma.shifts :] if decoded else np.empty(0, np.float32)
                    if s and len(x) < chroma.shortest():
                        break
                    at.append(row)
                    shift.append(s)
                    found.append(integers(x, decoded[1] if decoded else 1, chroma))
            ends = np.cumsum([0] + [len(i) for i, _ in found]).astype(np.int32)
            flat = lambda k, kind: np.concatenate([f[k] for f in found] or [np.empty(0, kind)])  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())), pa.array(shift, pa.int32()), pa.array([len(i) for i, _ in found], pa.int64()),
                    pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i, _ in found], pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(flat(0, np.uint32).view(np.int32))), pa.ListArray.from_arrays(ends, pa.array(flat(1, bool))),
                ],
                ["id", "shift", "n_frames", "crc32", "ints", "heard"],
            )

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType)])
    for name, kind in (("shift", "int"), ("n_frames", "long"), ("crc32", "long"), ("ints", "array<int>"), ("heard", "array<boolean>")):
        schema.add(name, T.DataType.fromDDL(kind))
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(each, schema)


def heard_frames(prints: DataFrame, row: str, at: str, run: int) -> DataFrame:
    """(row, at, value): each integer that hears anything (with its next one, if run is 2), and its frame."""
    if run not in (1, 2):
        raise ValueError("a vote is one integer or two")
    places = F.sequence(F.lit(0), F.size("ints") - 1)
    later = F.slice("ints", 2, F.size("ints")), F.slice("heard", 2, F.size("heard"))
    frames = F.arrays_zip(F.col("ints").alias("a"), F.col("heard").alias("b"), later[0].alias("c"), later[1].alias("d"), places.alias("at"))
    pairs = F.filter(frames, lambda x: x["b"] & x["d"] if run == 2 else x["b"])
    own = prints.filter("n_frames > 0").select(F.col("_row").alias(row), F.explode(pairs).alias("x"))
    value = F.col("x.a").cast("long")
    if run == 2:
        value = F.shiftleft(value, 32).bitwiseOR(F.col("x.c").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    return own.select(row, F.col("x.at").alias(at), value.alias("value"))


def alignments(recordings: DataFrame, references: DataFrame, chroma: Chroma) -> DataFrame:
    """(row, match): every reference that a recording aligns with, as struct(errors, votes, id, offset) of its best alignment.

    Both are stored fingerprints with a _row. Spark broadcasts the references' integers if the
    stored table is small enough for that; else both sides are exchanged by integer, where a
    value that many frames share is split by the skew join, and pairs are counted before they
    are exchanged by (recording, reference, offset). What has votes enough is stored too, so
    that Spark knows its size before it brings the bits to it.
    """
    known = heard_frames(references, "_ref", "_from", chroma.run)
    offset = (F.col("_at") - F.col("_from")).alias("offset")
    counted = heard_frames(recordings, "_rec", "_at", chroma.run).join(known, "value").groupBy("_rec", "_ref", offset).agg(F.count(F.lit(1)).alias("votes"))
    voted = stored(counted.filter(F.col("votes") >= chroma.votes), "voted")
    mine = recordings.select(F.col("_row").alias("_rec"), F.col("ints").alias("_a"))
    theirs = references.select(F.col("_row").alias("_ref"), F.col("id").alias("_key"), F.col("ints").alias("_b"))
    both = voted.join(theirs, "_ref").join(mine, "_rec")
    first = F.greatest(F.lit(0), F.col("offset"))
    long = F.least(F.size("_a"), F.col("offset") + F.size("_b")) - first
    bits = lambda x, y: F.bit_count(x.cast("long").bitwiseXOR(y.cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)))
    wrong = F.aggregate(F.zip_with(F.slice("_a", first + 1, long), F.slice("_b", first - F.col("offset") + 1, long), bits), F.lit(0).cast("long"), lambda s, x: s + x)
    checked = both.select("_rec", "_key", "offset", "votes", long.alias("_long"), (wrong / (32 * long)).alias("errors")).filter((F.col("errors") <= chroma.errors) & (F.col("votes") >= chroma.share * F.col("_long")))
    best = F.min(F.struct("errors", (-F.col("votes")).alias("_votes"), F.col("offset").cast("long").alias("offset")))
    each = checked.groupBy("_rec", "_key").agg(best.alias("m"))
    return each.select(F.col("_rec").alias("_row"), F.struct(F.col("m.errors").alias("errors"), F.col("m._votes").alias("_votes"), F.col("_key").alias("id"), F.col("m.offset").alias("offset")).alias("match"))


def fingerprint_and_align(df: DataFrame, references: DataFrame, chroma: Chroma, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """Per row of df: id, n_frames, fingerprint_crc32, match_id, match_offset, match_votes, match_errors, matches.

    ``matches`` holds every reference that verifies as (errors, votes, id, offset), best
    first; the match_ columns are the first of them. A null, empty or undecodable recording
    has no frames and no match; a shorter one than an integer's run is padded with silence.
    References are (id, media); null ids and undecodable media among them can't be matched.
    Repeated rows are treated alike. Ties go to fewer wrong bits, more votes, the smaller
    reference, the smaller offset. A recording of any length is heard whole; a reference with
    fewer votes to give than a match needs can't be matched. Other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    numbered = lambda x: x.withColumn("_row", F.monotonically_increasing_id())
    known = references.filter(F.col(id_col).isNotNull())
    prints = stored(numbered(fingerprints(df, chroma, id_col, media_col)), "prints")
    against = stored(numbered(fingerprints(known, chroma, id_col, media_col, chroma.shifts)), "references")
    grouped = alignments(prints, against, chroma).groupBy("_row").agg(F.sort_array(F.collect_list("match")).alias("_found"))
    found = F.coalesce(F.transform("_found", lambda m: F.struct(m["errors"].alias("errors"), (-m["_votes"]).alias("votes"), m["id"].alias("id"), m["offset"].alias("offset"))), F.array())
    out = prints.select("_row", "id", "n_frames", F.col("crc32").alias("fingerprint_crc32")).join(grouped, "_row", "left").withColumn("matches", found)
    first = F.try_element_at("matches", F.lit(1))
    return out.select("id", "n_frames", "fingerprint_crc32", *(first[c].alias(f"match_{c}") for c in ("id", "offset", "votes", "errors")), "matches")


def wav(data: Column, rate: int) -> Column:
    """A column's bytes as 8-bit mono WAV."""

    def number(x: Column) -> Column:
        h = F.lpad(F.hex(x), 8, "0")
        return F.unhex(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1))))

    raw, long = lambda b: F.unhex(F.lit(b.hex())), F.octet_length(data).cast("long")
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return F.concat(raw(b"RIFF"), number(long + 36), raw(b"WAVE" + form + b"data"), number(long), data)


#: The tables hold no media: a text's bytes are heard as 8-bit samples at 8,000 Hz. Frames are small, as texts are
#: short. References are indexed at every sample, so what a document repeats gives equal integers: half of them must be.
TEXT = Chroma(frame=32, hop=8, low=100.0, high=4000.0, shifts=8, run=2, votes=1, share=0.5, errors=0.2)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a recording, aligned with the benchmark's items as reference recordings."""
    heard = lambda df, key: df.select(F.col(key).alias("id"), wav(F.col("text").cast("binary"), 8000).alias("media"))
    found = fingerprint_and_align(heard(table(spark, sf_dir, "documents"), "doc_id"), heard(table(spark, sf_dir, "benchmark"), "item_id"), TEXT)
    return found.withColumnRenamed("id", "doc_id")
