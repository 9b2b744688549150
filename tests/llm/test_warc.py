import base64
import hashlib

import pytest

from quiverdf.llm import warc

PAGES = [(k, f"http://x/{k}", f"<p>{k % 7}</p>" * (k % 5)) for k in range(60)] + [(60, None, None), (61, "http://a b/\r\n", ""), (5, "http://x/5", "<p>5</p>" * 0), (None, "u", "é" * 100_000)]


def pages(spark, data=None):
    return spark.createDataFrame(PAGES if data is None else data, "page_id long, url string, html string").selectExpr("*", "'x' AS key", "1 AS payload").repartition(4)


def test_round_trip(spark):
    got = warc.archive(pages(spark)).collect()
    assert len(got) == len(PAGES)
    first: dict = {}
    for p, _, h in PAGES:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    for p, _, h in PAGES:
        body = (h or "").encode()
        x = next(r for r in got if r["page_id"] == p)
        assert x["payload_bytes"] == len(body) and x["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        response = p is None or first[h or ""] == p
        assert x["record_type"] == ("response" if response else "revisit") and x["refers_to"] == (None if response else first[h or ""])
        assert x["payload"] == (body if response else None)
    assert warc.archive(pages(spark, [])).count() == 0


def test_seek(tmp_path):
    class Sink(list):
        write = list.append

        def close(self):
            (tmp_path / "x.warc.zst").write_bytes(b"".join(self))

    writer = warc.BundleWriter(Sink(), frame_bytes=300)
    for k in range(50):
        writer.add(k, warc.record(k, "u", b"payload %d " % k * 5, None))
    writer.close()
    reader = warc.open_bundle(f"file://{tmp_path}/x.warc.zst")
    assert len(reader.frames) > 5 and [r["page_id"] for r in reader] == list(range(50))
    assert reader.get(37)["payload"] == b"payload 37 " * 5

    import zstandard

    # Any reader of the format takes the frames in a row; skippable ones vanish.
    data = (tmp_path / "x.warc.zst").read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 50


def test_damage_is_noticed():
    data = warc.record(1, "u", b"abc", None)
    assert warc.parse(data, 0)[0]["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"), 0)
