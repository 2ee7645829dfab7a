"""Audio columns: lossless 8-bit media and its features as fixed-shape tensors with time spans."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UNIT = 576
RATE = 12_000
#: Resampling by UP / DOWN, to 8,000 samples a second.
UP, DOWN, TAPS = 2, 3, 12
WINDOW, HOP, MELS = 200, 80, 24
#: Frames of one tensor.
FRAMES = 64
#: A segment begins above HIGH and ends below LOW, in dB of energy of a full-scale frame.
HIGH, LOW = -16.0, -22.0
#: Samples turned into features at once.
BLOCK = 480_000
HEADER = 44
OUT = "id long, n_bytes long, media binary, tensors binary, spans array<struct<first_s:double,last_s:double>>, segments array<struct<first_s:double,last_s:double>>"


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def wav(samples: bytes) -> bytes:
    """Unsigned 8-bit mono PCM in a RIFF file."""
    n = len(samples)
    return b"RIFF" + (36 + n).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") + (1).to_bytes(2, "little") + RATE.to_bytes(4, "little") + RATE.to_bytes(4, "little") + (1).to_bytes(2, "little") + (8).to_bytes(2, "little") + b"data" + n.to_bytes(4, "little") + samples


def unwav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a file of this operator")
    return media[HEADER : HEADER + int.from_bytes(media[40:44], "little")]


@functools.cache
def filters() -> tuple:
    """The branches of the low-pass filter, one for each phase, then the mel filterbank and the window."""
    import numpy as np

    n = TAPS * UP * 2 + 1
    t = np.arange(n) - n // 2
    low = np.sinc(t / DOWN) * np.hamming(n)
    low = low / low.sum() * UP
    taps = -(-n // UP)
    branches = np.zeros((UP, taps), np.float32)
    for p in range(UP):
        own = low[p::UP]
        branches[p, : len(own)] = own
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(256, 1 / rate)
    up = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    bank = np.maximum(0, np.minimum(up, down)).astype(np.float32)
    return branches, bank.T.copy(), np.hanning(WINDOW).astype(np.float32)


def resample(x):
    """Polyphase: output m is the sum of one branch of the filter over the input that ends at m * DOWN // UP."""
    import numpy as np

    branches = filters()[0]
    taps = branches.shape[1]
    n = -(-len(x) * UP // DOWN)
    line = np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(DOWN, np.float32)])
    seen = np.lib.stride_tricks.sliding_window_view(line, taps)
    out = np.empty(n, np.float32)
    for first in range(UP):
        own = out[first::UP]
        at, phase = divmod(first * DOWN, UP)
        # every UP-th output moves on by DOWN inputs and keeps its phase
        own[:] = seen[at : at + DOWN * len(own) : DOWN][: len(own)] @ branches[phase][::-1]
    return out


def frames(samples: bytes):
    """Log-mel rows as float16 and energies in dB, for overlapped frames of the resampled samples; block by block."""
    import numpy as np

    _, bank, window = filters()
    mels, levels, rest = [], [], np.zeros(0, np.float32)
    for i in range(0, len(samples), BLOCK):
        x = (np.frombuffer(samples, np.uint8, min(BLOCK, len(samples) - i), i).astype(np.float32) - 128) / 128
        rest = np.concatenate([rest, resample(x)])
        if i + BLOCK >= len(samples):
            rest = np.concatenate([rest, np.zeros(max(0, WINDOW - len(rest)) or -(len(rest) - WINDOW) % HOP, np.float32)])
        n = max(0, (len(rest) - WINDOW) // HOP + 1)
        cut = np.lib.stride_tricks.sliding_window_view(rest, WINDOW)[: n * HOP : HOP] if n else np.zeros((0, WINDOW), np.float32)
        for j in range(0, n, 4096):
            part = cut[j : j + 4096]
            levels.append(10 * np.log10((part * part).mean(axis=1) + 1e-9))
            power = np.fft.rfft(part * window, 256, axis=1)
            mels.append(np.log(np.square(power.real).astype(np.float32) @ bank + np.square(power.imag).astype(np.float32) @ bank + 1e-6).astype(np.float16))
        rest = rest[n * HOP :]
    return np.concatenate(mels), np.concatenate(levels)


def segments(levels) -> list[tuple[int, int]]:
    """Runs of frames that begin above HIGH and last until a frame below LOW."""
    import numpy as np

    # each frame's state is that of the last frame which was above HIGH or below LOW
    mark = np.where(levels > HIGH, 1, np.where(levels < LOW, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], -1) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def tensor_bytes(mels) -> bytes:
    """Rows in tensors of FRAMES x MELS, the last filled up with zeros: an Arrow stream with one fixed-shape column."""
    import numpy as np

    n = -(-len(mels) // FRAMES)
    full = np.zeros((n * FRAMES, MELS), np.float16)
    full[: len(mels)] = mels
    kind = pa.fixed_shape_tensor(pa.float16(), (FRAMES, MELS), dim_names=("frame", "mel"))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1), pa.float16()), FRAMES * MELS)
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(kind, flat)], ["log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its media, tensors, their time spans and the loud segments' time spans, in seconds.

    A null text is an empty one; an empty one is a unit of bytes 255. Features come from the samples read back from
    the media. Equal texts give equal values, each computed by itself.
    """
    step = HOP * DOWN / UP / RATE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("tensors", pa.binary()), ("spans", span := pa.list_(pa.struct([("first_s", pa.float64()), ("last_s", pa.float64())]))), ("segments", span)])
        for batch in batches:
            rows, held = [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                media = wav(padded(data))
                mels, levels = frames(unwav(media))
                times = lambda pairs: [{"first_s": a * step, "last_s": b * step} for a, b in pairs]
                spans = times((i, min(i + FRAMES, len(mels))) for i in range(0, len(mels), FRAMES))
                rows.append((key, len(data), media, tensor_bytes(mels), spans, times(segments(levels))))
                held += 2 * len(media)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.expr(f"substring(media, {HEADER + 1}, length(media) - {HEADER})")
    return encode(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(media, length(media) - 31, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("spans"), F.size("segments"), F.md5("tensors")).alias("feature"),
    )
