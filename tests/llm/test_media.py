import hashlib
import zlib

import numpy as np
import pytest

from corpuswarden.llm import media


def test_round_trip_and_features(spark):
    texts = [None, "", "abc", "é" * 288, "é" * 289, "x" * 5000, "abc", "日本 語" * 100_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (2, "abc")]
    uri, files = media.write_archives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert files
    got = media.features(media.read_archives(spark, uri)).collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    want = sorted((str(k), len((t or "").encode())) for k, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == want
    by = {r.doc_id: r for r in got}
    for k, t in rows:
        p = media.padded((t or "").encode())
        r = by[k]
        assert len(p) % 576 == 0 and len(p) > 0
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        image = media.to_image(p)
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
    assert by[2].feature == by[6].feature


def test_small_ranges_cover_each_member_once(spark):
    uri, _ = media.write_archives(spark.createDataFrame([(k, f"text {k}" * k) for k in range(60)], "doc_id long, text string").coalesce(2))
    reader = media.ArchiveReader({"path": uri, "range": "500"})
    members = [m for p in reader.partitions() for b in reader.read(p) for m in b.column("member").to_pylist()]
    assert len(reader.partitions()) > 5 and len(members) == 60 == len(set(members))


def test_a_damaged_member_fails_alone(spark):
    uri, files = media.write_archives(spark.createDataFrame([(k, f"text {k}" * 50) for k in range(9)], "doc_id long, text string").coalesce(1))
    path = files[0][0]
    data = bytearray(open(path, "rb").read())
    at = data.find(b"IDAT", len(data) // 2)
    data[at + 10] ^= 0xFF
    open(path, "wb").write(data)
    rows = media.features(media.read_archives(spark, uri)).collect()
    assert len(rows) == 9 and sum(r.error is not None for r in rows) == 1


def test_no_rows(spark):
    uri, files = media.write_archives(spark.createDataFrame([], "doc_id long, text string"))
    assert files == [] and media.read_archives(spark, uri).count() == 0


@pytest.mark.parametrize("n", [1, 2, 9, 40])
def test_image_is_lossless(n):
    data = np.random.default_rng(n).integers(0, 256, 576 * n, dtype=np.uint8).tobytes()
    assert media.from_image(media.to_image(data)).tobytes() == data


def test_archives_roll_over_and_a_lost_directory_is_one_row(spark):
    uri, files = media.write_archives(spark.createDataFrame([(k, f"text {k}" * 99) for k in range(40)], "doc_id long, text string").coalesce(1), most=2000)
    assert len(files) > 2 and media.read_archives(spark, uri).select("member").distinct().count() == 40
    with open(files[0][0], "r+b") as f:
        f.truncate(files[0][1] - 30)  # the end of the directory
    rows = media.features(media.read_archives(spark, uri)).collect()
    assert sum(r.error is not None for r in rows) == 1 and 10 < sum(r.error is None for r in rows) < 40
