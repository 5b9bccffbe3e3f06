"""Media columns: texts stored as 8-bit audio, read back, and their features.

``store`` writes each payload losslessly as a one-channel 8-bit WAVE file in a binary column.  ``features`` reads such
a column: polyphase resampling to 12 kHz, overlapped log-mel frames kept as fixed-shape Arrow tensors of 32 frames by 20
bands with their time spans, and segments between two energy thresholds (hysteresis).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from .common import table

RATE, UP, DOWN, TAPS = 16_000, 3, 4, 16
FRAME, HOP, BANDS, FRAMES = 256, 128, 20, 32
HIGH, LOW = 0.6, 0.4  # of the way from a text's quietest to its loudest frame
PAD = 64
ROWS = 32


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those bytes with zeros up to a positive multiple of 64)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % PAD if raw else PAD)


def write_wave(payload: bytes) -> bytes:
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload + bytes(len(payload) % 2)


def read_wave(media: bytes) -> tuple[int, bytes]:
    """(samples a second, 8-bit samples) of a one-channel WAVE file."""
    riff, _, wave = struct.unpack_from("<4sI4s", media)
    if (riff, wave) != (b"RIFF", b"WAVE"):
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only one channel of 8-bit samples is read")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _filters() -> np.ndarray:
    """The polyphase branches of a windowed-sinc low-pass filter."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n) * UP / max(UP, DOWN)
    return h.reshape(TAPS, UP).T[:, ::-1].copy()


def _mel() -> np.ndarray:
    """Triangular bands, equally wide in mel, over the spectrum of a frame."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    rate = RATE * UP / DOWN
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), BANDS + 2) / 2595) - 1) / rate * FRAME
    k = np.arange(FRAME // 2 + 1)[:, None]
    return np.maximum(0, np.minimum((k - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - k) / (edges[2:] - edges[1:-1])))


_FILTERS, _MEL, _WINDOW = _filters(), _mel(), np.hanning(FRAME)


def resample(x: np.ndarray) -> np.ndarray:
    """x at UP / DOWN of its rate: output k takes branch (k * DOWN) mod UP at input (k * DOWN) div UP."""
    n = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1), x, np.zeros(TAPS)])
    views = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n)
    for first in range(UP):
        k = np.arange(first, n, UP) * DOWN
        if len(k):
            out[first::UP] = views[k // UP] @ _FILTERS[k[0] % UP]
    return out


@dataclass
class Analysis:
    payload: bytes
    tensors: np.ndarray  # n x FRAMES x BANDS
    spans: np.ndarray  # n x 2, milliseconds
    segments: np.ndarray  # m x 2, milliseconds


def analyse(media: bytes) -> Analysis:
    _, payload = read_wave(media)
    y = resample((np.frombuffer(payload, dtype=np.uint8).astype(np.float64) - 128) / 128)
    y = np.concatenate([y, np.zeros(max(0, FRAME - len(y)))])
    views = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    mels, energy = [], []
    for at in range(0, len(views), 2048):  # a long text's frames in parts
        frames = views[at : at + 2048] * _WINDOW
        power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
        mels.append(np.log(power @ _MEL + 1e-6))
        energy.append(np.log((frames**2).mean(axis=1) + 1e-6))
    mel, e = np.concatenate(mels), np.concatenate(energy)
    ms = HOP / (RATE * UP / DOWN) * 1000
    n = -(-len(mel) // FRAMES)
    tensors = np.zeros((n * FRAMES, BANDS))
    tensors[: len(mel)] = mel
    starts = np.arange(n) * FRAMES
    spans = np.column_stack([starts, np.minimum(starts + FRAMES, len(mel))]) * ms
    low, high = e.min() + LOW * np.ptp(e), e.min() + HIGH * np.ptp(e)
    # A frame above the high threshold begins a segment, one below the low threshold ends it; others keep what was.
    decided = np.where(e > high, 1, np.where(e < low, 0, -1))
    last = np.maximum.accumulate(np.where(decided >= 0, np.arange(len(e)), -1))
    on = np.concatenate([[0], np.where(last >= 0, decided[last], 0), [0]])
    edges = np.diff(on)
    segments = np.column_stack([np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)]) * ms
    return Analysis(payload, tensors.reshape(n, FRAMES, BANDS), spans, segments)


def tensor_stream(a: Analysis) -> bytes:
    """The tensors as an Arrow stream with a fixed-shape tensor column and the time spans in milliseconds."""
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(a.tensors.astype(np.float32)))
    out = pa.table({"log_mel": column, "start_ms": a.spans[:, 0], "end_ms": a.spans[:, 1]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, out.schema) as writer:
        writer.write_table(out)
    return sink.getvalue().to_pybytes()


def read_stream(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(tensors, spans) of a tensor_stream."""
    read = pa.ipc.open_stream(stream).read_all()
    spans = np.column_stack([read.column("start_ms").to_numpy(), read.column("end_ms").to_numpy()])
    return read.column("log_mel").combine_chunks().to_numpy_ndarray(), spans


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) of each row.  A null text is stored as an empty one, repeated rows alike; an empty table gives an empty one; other columns are ignored."""
    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                sizes, payloads = zip(*(payload_of(t) for t in part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(id_type), pa.array(sizes, type=pa.int64()), pa.array([write_wave(p) for p in payloads], type=pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, n_bytes long, media binary")


def features(stored: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_tensors, tensors, segments) of stored media: an Arrow stream, and intervals in milliseconds.

    The columns that ``keep`` names follow as they are.  Null media have null features; repeated rows have equal ones, an
    empty table gives an empty one.
    """
    kind = stored.schema[id_col].dataType
    kept = stored.select(*keep).schema
    id_type = to_arrow_type(kind)
    span = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                found = [None if m is None else analyse(m) for m in part.column(1).to_pylist()]
                spans = [x and [{"start_ms": a, "end_ms": b} for a, b in x.segments.tolist()] for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(id_type), pa.array([x and len(x.tensors) for x in found], type=pa.int32()), pa.array([x and tensor_stream(x) for x in found], type=pa.binary()), pa.array(spans, type=span), *part.columns[2:]], names=[id_col, "n_tensors", "tensors", "segments", *keep])

    schema = f"{id_col} {kind.simpleString()}, n_tensors int, tensors binary, segments array<struct<start_ms: double, end_ms: double>>"
    return stored.select(id_col, "media", *keep).mapInArrow(run, ", ".join([schema, *(f"{f.name} {f.dataType.simpleString()}" for f in kept)]))


def feature_digest(stream: bytes, segments: list[tuple[float, float]]) -> str:
    """Shape, segments, and a digest of the stored tensors in hundredths, their spans and the segments in milliseconds."""
    tensors, spans = read_stream(stream)
    rounded = np.round(tensors.astype(np.float64) * 100).astype(np.int32).tobytes()
    times = np.round(np.concatenate([spans, np.array(segments, dtype=np.float64).reshape(-1, 2)])).astype(np.int64).tobytes()
    return f"{'x'.join(map(str, tensors.shape))};segments={len(segments)};{hashlib.sha256(rounded + times).hexdigest()[:32]}"


def digests(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored media and their stored features hold when they are read again: sizes, hashes and a digest; null for null media."""
    kind = stored.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    schema = f"{id_col} {kind.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                rows = []
                for media, stream, segments in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                    if media is None:
                        rows.append((None,) * len(types))
                        continue
                    _, payload = read_wave(media)
                    feature = feature_digest(stream, [(x["start_ms"], x["end_ms"]) for x in segments])
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                columns = [pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(id_type), part.column(1), *columns], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    made = features(stored, id_col, ("n_bytes", "media"))
    return made.select(id_col, "n_bytes", "media", "tensors", "segments").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_audio."""
    return digests(store(table(spark, sf_dir, "documents")))
