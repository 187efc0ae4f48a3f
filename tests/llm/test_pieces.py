"""Viterbi encoding against a plain programme and the library's engine, and round trips."""
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from assayframe.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


@pytest.fixture(scope="module")
def unigram():
    """The same vocabulary under the library's unigram engine (model_type 1)."""
    out = b""
    for number, value in pieces.fields(open(PATH, "rb").read()):
        if number == 2:
            value = value + varint(3 << 3) + varint(1)
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return sentencepiece.SentencePieceProcessor(model_proto=out)


TEXTS = [
    "Hello world", "  two  spaces   and three", "é à ñandú Straße", "x", " ", "nicht für 12 345 Leute, sondern (alle).", "тест привет мир",
    "averyveryverylongwordwithoutanyspaceinsideitself" * 8, "Die Verantwortung liegt beim Autor.", "ciónos queboue ñdobo",
]


def test_known_words(unigram):
    """Where the engine's path is the best one, the ids are its ids."""
    p = pieces.model(PATH)
    ids, counts = p.encode(pa.array(TEXTS))
    at = 0
    for text, n in zip(TEXTS, counts.tolist()):
        assert ids[at : at + n].tolist() == unigram.encode(text), text
        at += n


@pytest.mark.parametrize("text", ["", "a\nb\n\nc", "日本語のテキスト 𝒳 \U0001f600", "tab\there", "  lead", "trail  ", "\x00\x01", "q" * 70_000])
def test_round_trip(text):
    p = pieces.model(PATH)
    ids, counts = p.encode(pa.array([text, None, text + "x"]))
    assert [b.decode() for b in p.decode(ids, counts)] == [text, "", text + "x"]
    assert counts[1] == 0


def test_whole_table_round_trips(spark, sf):
    rows = pieces.op4_sentencepiece(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.exact for r in rows)


def plain_best(word, score, unknown):
    """Best total score of a marked word by a plain dynamic programme."""
    best = [0.0] + [float("-inf")] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - 16), e):
            v = score.get(word[s:e], unknown if e - s == 1 else None)
            if v is not None:
                best[e] = max(best[e], best[s] + v)
    return best[-1]


def test_best_path_on_documents(spark, sf, unigram):
    """Equal to a plain programme's best score, and never below the engine's path."""
    words = sorted({w for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect() for w in r.text.split()})
    p = pieces.model(PATH)
    score = {unigram.id_to_piece(i): unigram.get_score(i) for i in p.ids.tolist()}
    ids, counts = p.encode(pa.array(words))
    at = 0
    for word, n in zip(words, counts.tolist()):
        mine = sum(unigram.get_score(i) for i in ids[at : at + n].tolist())
        assert mine == plain_best("\u2581" + word, score, p.unknown_score), word
        assert mine >= sum(unigram.get_score(i) for i in unigram.encode(word)), word
        at += n


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "z"), (None, "a b", "z"), (1, None, "z"), (2, "", "z")], "doc_id long, text string, ids string")
    rows = pieces.encode_documents(df, PATH).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 0, 2]
    assert pieces.encode_documents(df.limit(0), PATH).collect() == []


def test_other_normalisations_are_refused(tmp_path):
    out = b""
    for number, value in pieces.fields(open(PATH, "rb").read()):
        if number == 3:
            value = value.replace(b"identity", b"nmt_nfkc")
        out += varint(number << 3 | 2) + varint(len(value)) + value
    other = tmp_path / "other.model"
    other.write_bytes(out)
    with pytest.raises(ValueError):
        pieces.Pieces.read(str(other))


def test_memory_of_an_encoding_does_not_grow_with_its_batch():
    """Four megabytes of different words took 296 MB at once when chunks had two."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(2)
    letters = ["".join(map(chr, rng.integers(97, 123, 100_000))) for _ in range(40)]
    texts = pa.array([" ".join(t[i : i + 9] for i in range(0, len(t), 9)) for t in letters])
    model = pieces.model(PATH)
    tracemalloc.start()
    ids, counts = model.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) == counts.sum() and peak < 150e6
