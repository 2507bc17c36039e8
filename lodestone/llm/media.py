"""Media columns: texts stored in ISO media containers, and container metadata read without decoding payloads.

A container is a sequence of boxes (32-bit size, four-character type, body),
nested in ``moov``. The payload lies in ``mdat`` as uncompressed 8 x 8 grey
frames of 64 bytes, one sample each; every ``KEY_EVERY``-th sample is a sync
sample. Readers walk the boxes, decode the sample tables (``stsd stts stss
stsc stsz stco/co64``) and never look at the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a frame: 8 x 8 samples of 8 bits.
FRAME = 64
#: Sync samples are this many frames apart.
KEY_EVERY = 16
#: Frames a second in the written containers.
RATE = 25
#: Frames in a chunk of the written containers.
CHUNK = 256
#: Boxes that hold boxes only.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pad(content: bytes) -> bytes:
    """``content`` with zero bytes up to a positive multiple of the frame size."""
    return content + bytes(max(FRAME, -(-len(content) // FRAME) * FRAME) - len(content))


def mux(payload: bytes) -> bytes:
    """An ISO media file that holds ``payload`` (a positive multiple of 64 bytes) as raw grey frames."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    large = len(payload) + 16 >= 1 << 32
    first = len(ftyp) + (16 if large else 8)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIIIHHIIIH", 1, 0, 0, 0, 0, 0, 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8 | 32, -1))
    runs = [struct.pack(">III", 1, min(n, CHUNK), 1)]
    if chunks > 1 and n % CHUNK:
        runs.append(struct.pack(">III", chunks, n % CHUNK, 1))
    keys = range(1, n + 1, KEY_EVERY)
    offsets = [first + i * CHUNK * FRAME for i in range(chunks)]
    places = _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *offsets)) if large else _full(b"stco", struct.pack(f">I{chunks}I", chunks, *offsets))
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, 1)),
        _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        _full(b"stsc", struct.pack(">I", len(runs)), *runs),
        _full(b"stsz", struct.pack(">II", FRAME, n)),
        places,
    )
    dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
    minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), dinf, stbl)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
    tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), matrix, struct.pack(">II", 8 << 16, 8 << 16), flags=3)
    mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    return b"".join((ftyp, _box(b"mdat", payload), _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))))


def walk(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box as (path of types, first byte of the body, end); bodies are not copied."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at byte {at} has the size {size}")
        here = (*path, kind)
        yield here, at + head, at + size
        if kind in NESTED:
            yield from walk(data, at + head, at + size, here)
        at += size


def tracks(data: bytes | memoryview) -> list[dict]:
    """Per track: codec, timescale, duration (ticks), sample count, and the byte range of each sync sample.

    Sample tables only; without ``stss`` every sample is a sync sample. Tables
    that contradict each other, and fragmented files, raise ValueError.
    """
    found: list[dict] = []
    for path, a, z in walk(data):
        if path[0] == b"moof":
            raise ValueError("fragmented files keep their samples outside the movie box")
        if path[-1] == b"trak":
            found.append({})
        elif found and path[:2] == (b"moov", b"trak"):
            found[-1].setdefault(path[-1], (a, z))
    return [_track(data, boxes) for boxes in found]


def _track(data: bytes | memoryview, boxes: dict[bytes, tuple[int, int]]) -> dict:
    def ints(kind: bytes, skip: int, width: int = 4) -> tuple[int, ...]:
        if kind not in boxes:
            return ()
        a, z = boxes[kind]
        n = (z - a - skip) // width
        return struct.unpack_from(f">{n}{'Q' if width == 8 else 'I'}", data, a + skip)

    codec, timescale, declared = "", 0, 0
    if b"mdhd" in boxes:
        a, _ = boxes[b"mdhd"]
        timescale, declared = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
    if b"stsd" in boxes:
        codec = bytes(data[boxes[b"stsd"][0] + 12 : boxes[b"stsd"][0] + 16]).decode("latin-1").strip()
    fixed, count = (*ints(b"stsz", 4)[:2], 0, 0)[:2]
    sizes = np.full(count, fixed, np.int64) if fixed else np.array(ints(b"stsz", 12)[:count], np.int64)
    if b"stz2" in boxes:
        sizes = _compact_sizes(data, *boxes[b"stz2"])
        count = len(sizes)
    # (samples, ticks each): the sum is the media's duration, also where the header leaves it open
    times = np.array(ints(b"stts", 8)[: 2 * (len(ints(b"stts", 8)) // 2)], np.int64).reshape(-1, 2)
    duration = int((times[:, 0] * times[:, 1]).sum()) or declared
    chunks = np.array(ints(b"stco", 8) or ints(b"co64", 8, 8), np.int64)
    runs = np.array(ints(b"stsc", 8), np.int64).reshape(-1, 3)
    until = np.append(runs[1:, 0], len(chunks) + 1)
    each = np.repeat(runs[:, 1], until - runs[:, 0])
    if each.sum() != count or len(each) != len(chunks):
        raise ValueError("the chunks do not hold the samples")
    # a sample begins where its chunk does, behind the samples of the chunk before it
    ends = np.cumsum(sizes)
    first = np.cumsum(each) - each
    before = np.concatenate(([0], ends))[first]
    starts = ends - sizes + np.repeat(chunks - before, each)
    picked = np.arange(count) if b"stss" not in boxes else np.array(ints(b"stss", 8), np.int64) - 1
    keys = list(zip(starts[picked].tolist(), sizes[picked].tolist(), strict=True))
    return {"codec": codec, "timescale": timescale, "duration": duration, "n_samples": count, "keyframes": keys}


def _compact_sizes(data: bytes | memoryview, a: int, z: int) -> np.ndarray:
    """The sizes of a ``stz2`` box, of 4, 8 or 16 bits."""
    width, count = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
    raw = np.frombuffer(data[a + 12 : z], ">u2" if width == 16 else np.uint8)
    if width == 4:
        raw = np.stack([raw >> 4, raw & 15], axis=1).ravel()
    return raw[:count].astype(np.int64)


def payload_of(data: bytes) -> bytes:
    """The bytes of the ``mdat`` boxes, in order."""
    return b"".join(data[a:z] for path, a, z in walk(data) if path == (b"mdat",))


KEYFRAMES = "array<struct<offset:bigint,length:bigint>>"
METADATA = f"codec string, timescale bigint, duration bigint, n_samples bigint, keyframes {KEYFRAMES}"


def container_metadata(df: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """One row for each track of each container in the binary column ``content``, with the columns ``keep``.

    Columns: ``keep``, track_no, codec, timescale, duration, n_samples,
    keyframes. Null contents and contents that are no valid container give one
    row with a null track_no; an empty table gives none. No shuffle.
    """
    kept = df.select(*keep, F.col(content).alias("__content"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, content in enumerate(batch.column(len(keep))):
                try:
                    found = tracks(content.as_py()) if content.is_valid else []
                except (ValueError, struct.error, IndexError):
                    found = []
                for no, track in enumerate(found or [{}]):
                    rows.append(i)
                    out.append({"track_no": no if track else None, **{k: track.get(k) for k in ("codec", "timescale", "duration", "n_samples")}, "keyframes": [{"offset": a, "length": b} for a, b in track["keyframes"]] if track else None})
            picked = batch.select(list(range(len(keep)))).take(pa.array(rows, pa.int64()))
            kinds = pa.schema([("track_no", pa.int64()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))])
            made = pa.RecordBatch.from_pylist(out, kinds)
            yield pa.RecordBatch.from_arrays([*picked.columns, *made.columns], [*keep, *kinds.names])

    return kept.mapInArrow(read, ", ".join(x for x in (_ddl(kept, keep), f"track_no bigint, {METADATA}") if x))


def _ddl(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


DIGEST = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, duration bigint, keyframes " + KEYFRAMES


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text as the payload of an ISO media file.

    Columns: id, n_bytes (UTF-8 bytes before padding), content (the file). A
    null text is an empty text; an empty text is one zero frame. Repeated rows
    and null ids stay rows of their own. No shuffle; other columns are left out.
    """
    name = df.schema[id_col].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([mux(pad(x)) for x in texts], pa.binary())], ["id", "n_bytes", "content"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(write, f"id {name}, n_bytes bigint, content binary")


def digest(stored: DataFrame, content: str = "content", keep: tuple[str, ...] = ("id", "n_bytes")) -> DataFrame:
    """What the stored bytes say when read back: payload and file digests, codec, duration, sync sample ranges.

    ``feature`` is a canonical line of the track's metadata, equal for equal
    contents. Null contents give null values; contents that are no valid
    container give their own size and digest, and nulls for the rest.
    """
    names = list(keep)
    kinds = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("codec", pa.string()), ("duration", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))])

    def one(data: bytes | None) -> dict:
        if data is None:
            return {}
        whole = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        try:
            payload, track = payload_of(data), tracks(data)[0]
        except (ValueError, struct.error, IndexError):
            return whole
        keys = track["keyframes"]
        spans = hashlib.sha256(b"".join(struct.pack("<qq", *k) for k in keys)).hexdigest()
        return {
            "payload_bytes": len(payload),
            "payload_sha256": hashlib.sha256(payload).hexdigest(),
            "tail_crc32": zlib.crc32(payload[-FRAME:]),
            **whole,
            "feature": f"codec={track['codec']};timescale={track['timescale']};duration={track['duration']};samples={track['n_samples']};keyframes={len(keys)};spans={spans}",
            "codec": track["codec"],
            "duration": track["duration"],
            "keyframes": [{"offset": a, "length": b} for a, b in keys],
        }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.RecordBatch.from_pylist([one(x.as_py()) for x in batch.column(len(names))], kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made.columns], [*names, *kinds.names])

    kept = stored.select(*names, content)
    return kept.mapInArrow(read, _ddl(kept, names) + ", " + DIGEST.removeprefix("n_bytes bigint, "))
