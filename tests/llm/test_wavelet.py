"""Wavelet shards against plain arrays and the tokenizer on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import wavelet
from plumbline.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("top", [1, 2, 300, 70_000])
def test_shard_against_arrays(top):
    rng = np.random.default_rng(top)
    ids = np.minimum(rng.integers(0, top, 300_000), rng.integers(0, top, 300_000))
    shard = wavelet.Shard(wavelet.pack(ids, ["a", None], [100_000, 300_000], part=0, before=0) + b"\n")
    assert (shard.tokens() == ids).all() and shard.doc_ids == ["a", None] and shard.ends.tolist() == [100_000, 300_000]
    for i in rng.integers(0, len(ids), 30).tolist():
        token = int(ids[i])
        places = np.flatnonzero(ids == token)
        assert shard.access(i) == token
        assert shard.rank(token, i) == (places < i).sum()
        assert shard.select(token, shard.rank(token, i)) == i
        assert (shard.positions(token) == places).all()
        assert shard.count(token, 5_000, i) == ((places >= 5_000) & (places < i)).sum()
    assert shard.count(top + 1_000_000) == 0 and len(shard.positions(top + 1_000_000)) == 0
    with pytest.raises(IndexError):
        shard.select(int(ids[0]), len(ids))


def test_empty_shard():
    shard = wavelet.Shard(wavelet.pack(np.zeros(0, np.uint32), [], []))
    assert shard.n == 0 and len(shard.tokens()) == 0 and shard.count(5) == 0


def test_encoder_equals_tokenizer(plain):
    rng = random.Random(3)
    letters = "ab Z \n\t'sé1 9.,!　\xa0\x1c\x85<|endoftext|>\r 日本😀 "
    make = wavelet.Encoder(PATH)
    for _ in range(400):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(8)]
        assert [x.tolist() for x in make.encode([t.encode() for t in texts])] == plain(texts)


def test_long_texts_are_cut_exactly(plain, monkeypatch):
    monkeypatch.setattr(wavelet, "PIECE", 500)
    monkeypatch.setattr(wavelet, "MEMO", 50)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["wörd", "it's", "\n\n", "x", "a　b", ""]) + str(rng.random())[:5] for _ in range(900)), "z" * 5_000, " " * 3_000 + "a b " * 900]
    assert [x.tolist() for x in wavelet.Encoder(PATH).encode([t.encode() for t in texts])] == plain(texts)


def test_equal_hashes_of_units_are_kept_apart(monkeypatch):
    monkeypatch.setattr(wavelet, "_FACTOR", np.uint64(1))  # all anagrams clash
    make = wavelet.Encoder(PATH)
    good = Tokenizer.from_file(PATH)
    texts = ["act cat tac cat act", "tca cat"]
    assert [x.tolist() for x in make.encode([t.encode() for t in texts])] == [good.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip_through_files(spark, plain):
    texts = ["hello world", None, "", "twice", "twice", "a <|endoftext|> b!", "many " * 3_000, "null id"]
    ids = [7, 3, -2, 5, 5, 100, 4, None]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], "doc_id int, text string, wm_id string, part int")
    folder = wavelet.write(docs, PATH, scratch_path(spark, "t"), shard_tokens=20)
    got = wavelet.read(spark, folder, "int", with_tokens=True).orderBy("start").collect()
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))
    assert [r["id"] for r in got] == [ids[k] for k in order]
    start = 0
    for r, k in zip(got, order):
        want = plain([texts[k] or ""])[0] + [0]
        assert r["tokens"] == want and r["start"] == start and r["n_tokens"] == len(want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    flat = [t for k in order for t in plain([texts[k] or ""])[0] + [0]]
    some = [0, flat[0], flat[-2], 49_999]
    assert {r["token"]: r["n"] for r in wavelet.count(spark, folder, some).collect()} == {t: flat.count(t) for t in some}
    word = plain([" many"])[0][0]
    found = wavelet.occurrences(spark, folder, word, "int").orderBy("position").collect()
    assert {r["id"] for r in found} == {4}
    assert [r["position"] for r in found] == [p for p, t in enumerate(plain([texts[6]])[0]) if t == word]


def test_empty_table(spark):
    docs = spark.range(0).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert wavelet.encode_documents(docs, PATH).count() == 0
