"""WARC archives, wavelet token shards and telephony audio: exact round trips, damage, odd tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridquill.llm import queries, telephony, warc, wavelet
from gridquill.llm.common import shared_dir
from tests.conftest import DATA
from tests.llm.fixtures import clashing, empty_docs, odd_docs, odd_texts

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def pages(spark):
    rows = [(i, None if i == 3 else f"http://x/{i}\r\nEvil: 1", t) for i, t in odd_texts()] + [(30, "http://x/30", "é" * 200_000), (30, "http://x/30", "é" * 200_000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_odd(spark):
    rows, table = pages(spark)
    head = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        head[raw] = max(head.get(raw, -1), -1 if page is None else page)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = head[raw] if head[raw] >= 0 else None
        revisit = first is not None and first != page
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None, None if revisit else raw))
    found = warc.warc_round_trip(table.withColumns({c: F.lit("clash") for c in ("payload", "key", "head", "copies", "shard", "refers_to")}))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.warc_round_trip(table.limit(0)).count() == 0
    big = warc.warc_round_trip(table, min_payload=1000).where("record_type = 'revisit'")
    assert {r["page_id"] for r in big.select("page_id").collect()} <= {i for i, _, h in rows if len((h or "").encode()) >= 1000}


def test_warc_frames_and_damage():
    import io

    sink = io.BytesIO()
    writer = warc.ArchiveWriter(sink)
    for i in range(40):
        writer.add(warc.build_record(i, f"http://x/{i}", f"<p>page {i} of many</p>".encode() * 20, None))
    writer.end()
    raw = sink.getvalue()
    assert raw[:4] == warc.DICT_MAGIC and [r.headers["warc-record-id"] for r in warc.read_archive(raw)] == [f"<urn:page:{i}>" for i in range(40)]
    # Each frame decodes alone, with the dictionary of the leading skippable frame.
    size = int.from_bytes(raw[4:8], "little")
    packed = zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size])
    at = 8 + size + warc.frame_size(raw, 8 + size)
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(packed)).decompress(raw[at : at + warc.frame_size(raw, at)])
    assert warc.parse_record(one).headers["warc-record-id"] == "<urn:page:1>"
    record = warc.build_record(7, None, b"payload", None)
    for broken in (record[:-4], record.replace(b"payload", b"pAyload"), record.replace(b"WARC/1.1", b"WARC/9.9"), record.replace(b"WARC-Date", b"WARC-Dote"), record + b"x", record.replace(b"WARC-Type: ", b"WARC-Type ")):
        with pytest.raises(ValueError):
            warc.parse_record(broken)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_archive(raw[:-5]))
    # An archive without a dictionary, and a plain one in the skippable frame.
    frame = zstandard.ZstdCompressor().compress(record)
    assert len(list(warc.read_archive(frame * 3))) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=1300), st.integers(9, 17))
def test_wavelet_matrix(ids, bits):
    x = np.array(ids, dtype=np.uint32)
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(x, bits).to_bytes())
    assert m.decode().tolist() == ids
    for i in range(0, len(ids), 97):
        assert m.access(i) == ids[i]
        places = [j for j, v in enumerate(ids) if v == ids[i]]
        assert m.count(ids[i]) == len(places) and m.count(ids[i], 1, i + 1) == sum(1 for j in places if 1 <= j <= i)
        assert [m.select(ids[i], k) for k in range(len(places) + 1)] == [*places, -1]


def plain_ids(text):
    from tokenizers import Tokenizer

    plain_ids.t = getattr(plain_ids, "t", None) or Tokenizer.from_file(str(TOKENIZER))
    return plain_ids.t.encode(text or "", add_special_tokens=False).ids + [1]


def expected_tokens(rows):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = plain_ids(text)
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_tokens_odd(spark):
    found = wavelet.token_id_shards(clashing(odd_docs(spark)), TOKENIZER)
    assert sorted(map(tuple, found.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=repr) == sorted(expected_tokens(odd_texts()), key=repr)
    assert wavelet.token_id_shards(empty_docs(spark), TOKENIZER).count() == 0


def test_tokens_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op4_token_ids"](spark, DATA).collect())) == sorted(expected_tokens(rows))


def test_shard_file(spark):
    rows = [(i, t) for i, t in odd_texts() if i is not None][:9]
    counts = np.array([len(plain_ids(t)) for _, t in rows])
    flat = np.array([x for _, t in rows for x in plain_ids(t)], dtype=np.uint32)
    raw = wavelet.pack_shard([i for i, _ in rows], counts, flat, 16)
    shard = wavelet.Shard(raw)
    assert [d for d, _ in shard.documents()] == [i for i, _ in rows] and np.concatenate([x for _, x in shard.documents()]).tolist() == flat.tolist()
    symbol = int(np.bincount(flat).argmax())
    assert shard.count(symbol) == int((flat == symbol).sum()) and list(shard.occurrences(symbol)) == np.flatnonzero(flat == symbol).tolist() and shard.access(len(flat) - 1) == 1
    for broken in (raw[:-1], b"x" + raw[1:]):
        with pytest.raises(ValueError):
            wavelet.Shard(broken)


def plain_adpcm(block):
    """One block, a nibble at a time, after the published description."""
    now, at, out = 0, 0, [0]
    for byte in block:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[at])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            now = max(-32768, min(32767, now - change if code & 8 else now + change))
            at = max(0, min(88, at + int(telephony.INDEX_CHANGES[code])))
            out.append(now)
    return out


def test_codecs():
    assert [int(telephony.MULAW[c]) for c in (0x00, 0x7F, 0x80, 0xFF)] == [-32124, 0, 32124, 0]
    assert [int(telephony.ALAW[c]) for c in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    assert len(set(map(int, telephony.ALAW))) == 256 and len(set(map(int, telephony.MULAW))) == 255
    r = random.Random(4)
    blocks = np.array([[r.randrange(256) for _ in range(60)] for _ in range(5)], dtype=np.uint8)
    assert telephony.adpcm_decode(blocks).tolist() == [plain_adpcm(b) for b in blocks.tolist()]
    x = np.array([0, 100, -100, 3000], dtype=np.int16)
    assert telephony.double_rate(x)[0::2].tolist() == x.tolist() and len(telephony.double_rate(x)) == 8
    for codec in telephony.TAGS:
        payload = bytes(r.randrange(256) for _ in range(2 * telephony.FRAME))
        raw = telephony.wav(codec, payload)
        assert telephony.parse_wav(raw) == (codec, payload)
        with pytest.raises(ValueError):
            telephony.parse_wav(raw[:-2])


@pytest.mark.parametrize("codec", [None, "adpcm"])
def test_media_odd(spark, codec):
    stored = telephony.encode_media(clashing(odd_docs(spark)), codec=codec)
    path = shared_dir(spark, "media-test")
    stored.write.parquet(path)
    found = telephony.decode_media(spark.read.parquet(path)).collect()
    want = []
    for doc, text in odd_texts():
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, math.ceil(len(raw) / 576)) * 576 - len(raw))
        want.append((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found), key=repr) == sorted(want, key=repr)
    samples = {"mulaw": 2, "alaw": 2, "adpcm": 4}
    assert all(len(r["pcm"]) // 2 >= samples[r["codec"]] * r["payload_bytes"] for r in found) and len({r["codec"] for r in found}) == (1 if codec else 3)
    by_text = {}
    for r in found:
        assert by_text.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert telephony.media_round_trip(empty_docs(spark)).count() == 0
