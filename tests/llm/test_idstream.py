"""Arrow id streams: exact ids, places, random access, masks."""
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from assayframe.llm import common, idstream

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, rows, by=lambda text: 0):
    """Rows of one id in the order of ``by``."""
    start, out = 0, []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, by(r[1]))):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


def test_whole_table(spark, library):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = idstream.op10_arrow_id_streams(spark, d).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(library, rows)


def test_edges(spark, library):
    rows = [(5, None), (5, "b"), (5, "a"), (5, "a"), (None, "x y"), (1, ""), (2, "long word " * 30_000), (3, "q" * 5000), (4, "don't  stop\n\n now then　x 12 <|endoftext|>")]
    df = spark.createDataFrame([(*r, 1, "u") for r in rows], "doc_id long, text string, part int, uri string").repartition(3)
    folder = common.staged_path(spark, "t")
    shards = idstream.write_shards(df, folder, PATH, seq_len=64)
    assert sum(r.n_docs for r in shards.collect()) == len(rows)
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    want = expected(library, rows, hashes.__getitem__)
    assert sorted(map(tuple, idstream.read_shards(spark, shards).where("doc_id is not null").collect())) == sorted(r for r in want if r[0])
    assert library.encode("now <|endoftext|> x", add_special_tokens=False).ids[2] == 50256
    for r in shards.collect():
        reader = idstream.StreamReader(r.uri + ".arrows")
        whole = reader.ids(0, r.n_ids)
        assert reader.real() == r.n_ids and len(reader.sequence(0)) == 64
        assert np.array_equal(np.concatenate([reader.sequence(k) for k in range(-(-r.n_ids // 64))])[: r.n_ids], whole)
    empty = idstream.write_shards(df.limit(0), folder, PATH)
    assert idstream.read_shards(spark, empty).collect() == []


def test_encoder_equals_library_on_odd_space(library):
    texts = ["a b", " a", "a ", "a  b", "a \n b", "a b c", "\u0085x y", "a\x1cb c d", "'s it's 12 34", "", "é é", "!? !? ok", "x  y"]
    ids, counts = idstream.encoder(PATH).encode(pa.array(texts))
    at = 0
    for t, n in zip(texts, counts.tolist()):
        assert ids[at : at + n].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
        at += n


def test_shards_follow_bytes(spark, monkeypatch):
    monkeypatch.setattr(idstream, "SHARD_BYTES", 1000)
    df = spark.range(200).selectExpr("0L AS doc_id", "repeat('same words ', 10) AS text")
    shards = idstream.write_shards(df, common.staged_path(spark, "t"), PATH).collect()
    assert len(shards) == 22 and max(r.n_docs for r in shards) < 60  # one id in all rows is dealt over all shards
