"""Round trips of archives, shards and packed sequences."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from penmark.llm import packing, warc, wavelet
from penmark.llm.encode import Encoder

ODD = ["<|endoftext|> Don't  we'll \n\n x\t y 12 ½ 3.14 É İ ß ΣΑΣ 漢字  a", "", None, " ", "a", "'s''ll", "Âª «¿que?» ²  ", "\x1c a\xa0b\x85c", "a\r\n\r\nb"]


def _library(name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    return library


@pytest.mark.parametrize("name, kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_ids_equal_the_library(spark, name, kind):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = ODD + texts + [" ".join(texts) * 2]
    want = [e.ids for e in _library(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoder = Encoder(public_tokenizers.path(name), kind, keep=500)  # the store is emptied between calls
    got = encoder.ids(texts[:40]) + encoder.ids(texts[40:])
    assert [g.tolist() for g in got] == want
    for keep in (40, 3000):  # words met once go, the others stay
        encoder = Encoder(public_tokenizers.path(name), kind, keep=keep)
        got = [g.tolist() for i in range(0, len(texts), 7) for g in encoder.ids(texts[i : i + 7])]
        assert got == want


def test_packing_fills_and_restores(spark):
    docs = [(d, " ".join(["word"] * n)) for d, n in enumerate([0, 1, 5, 30, 39, 64, 100])] + [(None, None), (3, "again"), (3, "again")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, slot int")
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.packed_documents(frame, path, "word", 1, capacity=40).collect()
    assert sum(r.length for r in rows) == sum(len(ids) for ids in Encoder(path, "word").ids([t for _, t in docs])) + len(docs)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
    assert packing.packed_documents(frame.limit(0), path, "word", 1).count() == 0


def test_packed_ids_come_back(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    pieces = packing.staged(packing.token_pieces(docs, path, "word", 1, 40, keep_ids=True))
    packed = packing.staged(packing.pack(pieces, 40))
    whole = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        part = whole[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32


def test_best_two_fit_swaps_the_smallest():
    # 6 and 3 fill 9 of 10; the 3 makes room for 2 + 2.
    bins, offsets = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins[0] == bins[2] == bins[3] and bins[1] != bins[0]
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 101, 3000)
    bins, offsets = packing.best_two_fit(lengths, 100)
    assert np.bincount(bins, lengths).max() <= 100
    assert len(np.unique(bins)) <= -(-lengths.sum() // 100) * 1.03


def test_wavelet_shards(spark, tmp_path):
    rng = random.Random(2)
    docs = [(d, " ".join(rng.choice(["the", "of", "Anting", "é"]) for _ in range(rng.randint(0, 400)))) for d in range(40)]
    docs += [(None, "null id"), (50, None), (51, ""), (7, docs[7][1])]
    rng.shuffle(docs)
    path = public_tokenizers.path("byte_bpe_50k.json")
    frame = spark.createDataFrame([(d, t, 2) for d, t in docs], "doc_id long, text string, n_tokens int")
    shards = wavelet.write_shards(frame, str(tmp_path / "wm"), path, "byte", 2, shard_tokens=3000)
    rows = sorted(wavelet.read_documents(shards).collect(), key=lambda r: r.start)
    order = sorted(docs, key=lambda r: -1 if r[0] is None else r[0])
    ids = [np.append(x, 2).astype("<u4") for x in Encoder(path, "byte").ids([t for _, t in order])]
    assert [r.doc_id for r in rows] == [d for d, _ in order]
    assert [r.start for r in rows] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(x.tobytes()) for x in ids]
    assert wavelet.write_shards(frame.limit(0), str(tmp_path / "none"), path, "byte", 2).count() == 0
    assert [r.n_counted for r in wavelet.read_documents(shards, 2).orderBy("start").collect()] == [int((x == 2).sum()) for x in ids]
    with pytest.raises(ValueError):
        wavelet.write_shards(frame, str(tmp_path / "narrow"), path, "byte", 2, bits=15)
    with pytest.raises(ValueError):
        wavelet.write_shards(frame, str(tmp_path / "narrow"), path, "byte", 70_000, bits=16)
    wide = wavelet.write_shards(frame, str(tmp_path / "wide"), path, "byte", 70_000)
    assert [r.n_tokens for r in wavelet.read_documents(wide).orderBy("start").collect()] == [len(x) for x in ids]


@pytest.mark.parametrize("n", [0, 1, 300, (1 << 17) - 1, 1 << 17, 400_000])
def test_rank_select_access(tmp_path, n):
    rng = np.random.default_rng(n)
    flat = np.minimum(rng.zipf(1.3, n), 60_000).astype(np.uint16)
    path = str(tmp_path / "shard")
    wavelet.write_file(path, wavelet.shard_bytes(flat, [1], [n], 16))
    shard = wavelet.WaveletMatrix(path)
    places = np.sort(rng.integers(0, n + 1, 50))
    for token in (1, 2, 7, 60_000, 59_999, 65_535):
        where = np.flatnonzero(flat == token)
        ids, ranks = shard.tokens(token, places)
        assert np.array_equal(ids, flat) and np.array_equal(ranks, np.searchsorted(where, places))
        assert shard.count(token) == len(where) and [shard.rank(token, int(p)) for p in places[:5]] == ranks[:5].tolist()
        for k in {0, len(where) // 2, len(where) - 1} if len(where) else ():
            assert shard.select(token, k) == where[k]
        with pytest.raises(IndexError):
            shard.select(token, len(where))
    assert shard.occurrences(60_000)[:20] == np.flatnonzero(flat == 60_000)[:20].tolist()
    for i in {0, 63, 64, n // 2, n - 1} if n > 64 else range(n):
        assert shard.access(i) == flat[i]
    with pytest.raises(IndexError):
        shard.access(n)
    shard.close()
    if n > 100_000:
        assert sum(map(len, wavelet.shard_bytes(flat, [1], [n], 16))) < 0.8 * 2 * n


def test_archives_and_index(spark, tmp_path):
    big = "<p>" + "x" * 2000
    pages = [(i, f"https://host{i % 3}.Example.com/p/{i}?q#f", f"<p>{i}" + "y" * (i * 100)) for i in range(30)]
    pages += [(100, "http://a.org/", big), (101, "http://a.org/", big), (99, None, big), (None, "x\r\ny", big)]
    pages += [(200, "http://small.org", "same"), (201, "http://small.org", "same"), (202, "http://e.org/é", None), (101, "http://a.org/", big)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest")
    folder = str(tmp_path / "warc")
    captures = warc.write_archives(frame, folder)
    index = warc.build_index(captures, folder, block_lines=4)
    rows = warc.read_records(warc.all_captures(index), with_payload=True).collect()
    assert len(rows) == len(pages)
    html = {}
    for page, _, text in pages:
        html.setdefault(page, text or "")
    for r in rows:
        data = html[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        again = html[r.page_id] == big and r.page_id != 101
        assert (r.record_type, r.refers_to) == (("revisit", 101) if again else ("response", None))
        assert r.payload is None if again else bytes(r.payload) == data
    asked = spark.createDataFrame([("http://a.org/",), ("https://host1.example.com/p/4?q",), ("http://none.net/",), (None,)], "url string")
    found = warc.lookup(index, asked).collect()
    assert sorted(str(r.page_id) for r in found) == ["100", "101", "101", "4", "99"]
    assert warc.archived(frame.limit(0), str(tmp_path / "empty")).count() == 0
