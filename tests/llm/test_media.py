import hashlib
import random
import struct
import zlib

import pytest

from lodestone.llm import media

from . import data


def test_round_trip_of_payloads():
    rnd = random.Random(1)
    for n in (0, 1, 63, 64, 65, 64 * 256, 64 * 256 + 1, 64 * 1000):
        payload = media.pad(rnd.randbytes(n))
        assert len(payload) >= 64 and len(payload) % 64 == 0
        file = media.mux(payload)
        assert media.payload_of(file) == payload
        (track,) = media.tracks(file)
        assert (track["codec"], track["n_samples"], track["duration"]) == ("raw", len(payload) // 64, len(payload) // 64)
        assert b"".join(file[a : a + z] for a, z in track["keyframes"]) == b"".join(payload[i : i + 64] for i in range(0, len(payload), 64 * 16))


def test_boxes_nest_and_bad_sizes_fail():
    file = media.mux(media.pad(b"x"))
    paths = ["/".join(k.decode() for k in p) for p, _, _ in media.walk(file)]
    assert paths[:3] == ["ftyp", "mdat", "moov"] and "moov/trak/mdia/minf/stbl/stsz" in paths
    for bad in (file[:-5], struct.pack(">I4s", 4, b"free")):
        try:
            list(media.walk(bad))
        except ValueError:
            continue
        raise AssertionError("a bad box passed")


def test_sample_tables_with_sizes_of_their_own():
    # three samples in two chunks, sizes in stsz, every sample a sync sample
    stbl = media._box(b"stbl", media._full(b"stsz", struct.pack(">IIIII", 0, 3, 5, 7, 2)), media._full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), media._full(b"co64", struct.pack(">IQQ", 2, 100, 400)))
    file = media._box(b"moov", media._box(b"trak", media._box(b"mdia", media._box(b"minf", stbl))))
    assert media.tracks(file)[0]["keyframes"] == [(100, 5), (105, 7), (400, 2)]


def test_digest_of_awkward_rows(spark):
    df = data.frame(spark)
    got = media.digest(media.store_texts(df)).collect()
    rows = data.documents()
    assert len(got) == len(rows)
    expected = sorted(((r[0] is None, r[0] or 0), hashlib.sha256(media.pad((r[1] or "").encode())).hexdigest()) for r in rows)
    assert sorted(((r["id"] is None, r["id"] or 0), r["payload_sha256"]) for r in got) == expected
    for r in got:
        assert r["media_bytes"] > r["payload_bytes"] >= r["n_bytes"]
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["payload_sha256"], r["media_sha256"]) == r["media_sha256"]
    one = next(r for r in got if r["id"] == 4)
    assert one["tail_crc32"] == zlib.crc32(bytes(64)) and one["n_bytes"] == 0
    assert media.digest(media.store_texts(df.limit(0))).count() == 0


def test_container_metadata_keeps_bad_rows(spark):
    df = spark.createDataFrame([(1, media.mux(media.pad(b"a" * 5000))), (2, None), (3, b"junk!"), (4, b"")], "id int, content binary")
    got = {r["id"]: r for r in media.container_metadata(df, "content", ["id"]).collect()}
    assert got[1]["track_no"] == 0 and got[1]["codec"] == "raw" and len(got[1]["keyframes"]) == 5
    assert all(got[i]["track_no"] is None for i in (2, 3, 4))


def test_durations_small_sizes_and_fragments():
    stbl = media._box(b"stbl", media._full(b"stts", struct.pack(">IIIII", 2, 2, 10, 1, 7)), media._full(b"stz2", struct.pack(">IIBB", 4, 3, 0x5B, 0x20)), media._full(b"stsc", struct.pack(">IIII", 1, 1, 3, 1)), media._full(b"stco", struct.pack(">II", 1, 900)), media._full(b"stss", struct.pack(">III", 2, 1, 3)))
    file = media._box(b"moov", media._box(b"trak", media._box(b"mdia", media._box(b"minf", stbl))))
    (track,) = media.tracks(file)
    # two samples of 10 ticks and one of 7; sizes of four bits: 5, 11, 2
    assert (track["duration"], track["n_samples"], track["keyframes"]) == (27, 3, [(900, 5), (916, 2)])
    for bad in (file + media._box(b"moof", b""), file.replace(struct.pack(">II", 1, 900), struct.pack(">II", 1, 900)[:8]).replace(struct.pack(">IIII", 1, 1, 3, 1), struct.pack(">IIII", 1, 1, 2, 1))):
        with pytest.raises(ValueError):
            media.tracks(bad)


def test_digest_survives_bad_files(spark):
    df = spark.createDataFrame([(1, 1, media.mux(media.pad(b"a"))), (2, 1, None), (3, 5, b"junk!"), (4, 0, b""), (5, 9, media.mux(media.pad(b"a"))[:-9])], "id int, n_bytes int, content binary")
    got = {r["id"]: r for r in media.digest(df).collect()}
    assert got[1]["payload_bytes"] == 64 and all(got[i]["payload_sha256"] is None for i in (2, 3, 4, 5))
    assert (got[3]["media_bytes"], got[3]["media_sha256"]) == (5, hashlib.sha256(b"junk!").hexdigest()) and got[2]["media_bytes"] is None
