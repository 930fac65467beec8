"""Media columns: payloads stored as progressive JPEG files, read back as coefficients and RGB tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .common import keyed_text, map_rows, materialize

#: Payloads are a multiple of so many bytes.
UNIT = 64
#: Bytes of media, or signs of text, that a worker takes up at a time; their tensors take a few times as much.
SLICE = 1 << 20


def padded(text: str) -> bytes:
    """The text in UTF-8 and zeros up to a positive multiple of UNIT bytes."""
    raw = text.encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def _slices(values: list, most: int = SLICE):
    """(from, to) of consecutive values that hold so many bytes or signs together, or a single longer one."""
    at = size = 0
    for k, v in enumerate(values):
        if k > at and size + len(v) > most:
            yield at, k
            at, size = k, 0
        size += len(v)
    if at < len(values):
        yield at, len(values)


def _storer():
    import pyarrow as pa

    from . import jpeg

    def step(batch):
        texts = batch.column(1).to_pylist()
        for at, to in _slices(texts):
            part, held = texts[at:to], {}
            media = [held[t] if t in held else held.setdefault(t, jpeg.encode(padded(t))) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], pa.array([len(t.encode()) for t in part], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return step


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as one or more JPEG files, one after another. n_bytes is the text's."""
    return map_rows(keyed_text(docs), _storer, "doc_id long, n_bytes long, media binary")


def _decoder():
    import pyarrow as pa

    from . import jpeg

    def step(batch):
        for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            frames = jpeg.read_frames(media or b"")
            cols = [[key] * len(frames), list(range(len(frames))), [f.height for f in frames], [f.width for f in frames], [jpeg.rgb(f).tobytes() for f in frames]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "frame", "height", "width", "rgb"])

    return step


def decode_media(media: DataFrame) -> DataFrame:
    """(doc_id, frame, height, width, rgb) of rows (doc_id, media): full-resolution RGB tensors in row-major order, one row for each file."""
    return map_rows(media.select("doc_id", "media"), _decoder, "doc_id long, frame int, height int, width int, rgb binary")


def _digester(tensors: bool):
    import hashlib
    import zlib

    import numpy as np
    import pyarrow as pa

    from . import jpeg

    def read(media: bytes) -> tuple:
        payloads, sums, pixels, sizes, rgb = [], np.zeros(3, np.int64), 0, [], []
        for frame in jpeg.read_frames(media):
            payloads.append(jpeg.payload(frame))
            tensor = jpeg.rgb(frame)
            sums += tensor.sum(axis=(0, 1), dtype=np.int64)
            pixels += tensor.shape[0] * tensor.shape[1]
            sizes.append((frame.height, frame.width))
            if tensors:
                rgb.append(tensor.tobytes())
        whole = b"".join(payloads)
        mean = ",".join(str(int(s) // pixels) for s in sums)
        size = f"{sizes[0][1]}x{sizes[0][0]}"
        feature = f"{size if len(sizes) == 1 else f'{len(sizes)}*{size}'} rgb {mean}"
        return len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, [h for h, _ in sizes], [w for _, w in sizes], b"".join(rgb)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "heights", "widths", "rgb"]
    n = 9 if tensors else 6

    def step(batch):
        values = batch.column(2).to_pylist()
        for at, to in _slices(values):
            held: dict[bytes, tuple] = {}
            rows = [held[m] if m in held else held.setdefault(m, read(m)) for m in values[at:to]]
            cols = list(zip(*rows, strict=True))[:n]
            yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], batch.column(1)[at:to], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names=["doc_id", "n_bytes", *names[:n]])

    return step


def media_digests(media: DataFrame, tensors: bool = False) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature[, heights, widths, rgb])
    of stored rows.

    Everything but n_bytes comes from the stored bytes: the payload from the accumulated coefficients, the feature (size and
    mean of each channel) from the RGB tensors. With tensors these come along, those of a text's files one after another, each
    of heights[i] x widths[i] x 3 bytes in row-major order.
    """
    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kind += ", heights array<int>, widths array<int>, rgb binary" if tensors else ""
    return map_rows(media, lambda: _digester(tensors), kind)


def media_round_trip(docs: DataFrame, tensors: bool = True) -> DataFrame:
    """Store every text as media, written as a table, and read the digests and the full-resolution RGB tensors back from it.

    Null counts as empty; an empty text is a payload of 64 zeros. Equal texts give equal files and values. Rows that repeat
    a doc_id are stored one by one; other columns are ignored; an empty table gives an empty result.
    """
    return media_digests(materialize(store_media(docs), "media"), tensors)
