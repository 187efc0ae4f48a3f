"""SentencePiece encoding and decoding by batched Viterbi.

Text is cut where no piece can cross: before a space mark that follows
something else, and around characters that no longer piece holds.  Distinct
words are encoded once a batch; those of equal length advance together.  Each
substring's polynomial hash probes the sorted keys of the vocabulary, and the
maximum over piece lengths stores a back pointer for every word at once.

The scores are those of the vocabulary file and the result is the path of the
greatest total, the longer last piece winning a tie; characters without a
piece fall back to bytes.
"""
from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textnp import BASE, INVERSE, SMALL_BYTES, U, chunks, mix, powers, ragged, text_buffer, tidy

MARK = "▁"
NORMAL, UNKNOWN, USER_DEFINED, BYTE_PIECE = 1, 2, 4, 6
PRESENT_BITS = 20
_models: dict[str, "Pieces"] = {}


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Pieces:
    """A vocabulary: sorted keys of pieces with ids and scores, byte ids, cuts.

    ``present`` marks the leading bits that any key has; most substrings fail
    there and never reach the search.
    """

    keys: np.ndarray
    present: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    unknown_score: float
    byte_ids: np.ndarray
    solo: np.ndarray
    surface: list[bytes]

    @staticmethod
    def read(path: str) -> "Pieces":
        with open(path, "rb") as f:
            data = f.read()
        pieces = []
        for number, value in fields(data):
            if number == 3:  # how text is normalised: as it stands, after a leading mark, with all its spaces
                rule = dict(fields(value))
                if rule.get(1) != b"identity" or rule.get(2) or not rule.get(3, 1) or rule.get(4, 1) or not rule.get(5, 1):
                    raise ValueError(f"{path} asks for a normalisation that this encoder does not have")
            if number == 1:
                got = dict(fields(value))
                pieces.append((got.get(1, b"").decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
        score = [s for _, s, k in pieces if k == NORMAL]
        top, low = max(score), min(score)
        ids = [i for i, (_, _, k) in enumerate(pieces) if k in (NORMAL, USER_DEFINED)]
        text = [pieces[i][0] for i in ids]
        value = [pieces[i][1] if pieces[i][2] == NORMAL else len(pieces[i][0]) * top - 0.1 for i in ids]
        points = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
        size = np.array([len(t) for t in text])
        end = np.cumsum(size)
        keys = hashes(point_sums(points), end - size, end)
        order = np.argsort(keys)
        byte_ids = np.full(256, -1, np.int32)
        surface = []
        for i, (t, _, k) in enumerate(pieces):
            if k == BYTE_PIECE:
                byte_ids[int(t[3:5], 16)] = i
                surface.append(bytes([int(t[3:5], 16)]))
            else:
                surface.append(t.replace(MARK, " ").encode() if k in (NORMAL, USER_DEFINED) else b"")
        unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        byte_ids[byte_ids < 0] = unknown
        joined = {c for t in text if len(t) > 1 for c in t}
        solo = np.array([b < 128 and b != 32 and chr(b) not in joined for b in range(256)])
        present = np.zeros(1 << PRESENT_BITS, bool)
        present[(keys >> U(64 - PRESENT_BITS)).astype(np.int64)] = True
        return Pieces(keys[order], present, np.array(ids, np.int32)[order], np.array(value)[order], int(size.max()), low - 10, byte_ids, solo, surface)

    def words(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of words given as code points.

        An id of -1 - c marks a character c without a piece.
        """
        n = len(points)
        sums = point_sums(points)
        end_of = np.repeat(starts + lengths, lengths)
        found = np.full((self.longest + 1, n), -1, np.int16 if len(self.keys) < 1 << 15 else np.int32)
        for size in range(1, min(self.longest, int(lengths.max(initial=0))) + 1):
            i = np.flatnonzero(np.arange(n) + size <= end_of)
            key = hashes(sums, i, i + size)
            likely = self.present[(key >> U(64 - PRESENT_BITS)).astype(np.int64)]
            i, key = i[likely], key[likely]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            same = self.keys[at] == key
            found[size, i[same]] = at[same]
        step = np.zeros(n, np.int8 if self.longest < 128 else np.int32)  # piece length on the best path, by its end
        order = np.argsort(lengths, kind="stable")
        cuts = np.searchsorted(lengths[order], np.unique(lengths), "left").tolist() + [len(order)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            group = starts[order[a:b]]
            size = int(lengths[order[a]])
            best = np.full((size + 1, b - a), -np.inf)
            best[0] = 0
            for end in range(1, size + 1):
                reach = range(min(self.longest, end), 0, -1)
                scores = np.full((len(reach), b - a), -np.inf)
                for row, k in enumerate(reach):
                    piece = found[k, group + end - k]
                    have = piece >= 0
                    if k == 1:
                        scores[row] = best[end - 1] + np.where(have, self.scores[piece], self.unknown_score)
                    elif have.any():
                        scores[row, have] = best[end - k, have] + self.scores[piece[have]]
                at = scores.argmax(0)
                best[end] = scores[at, np.arange(b - a)]
                step[group + end - 1] = reach[0] - at
        # walk all words back at once
        here = starts + lengths - 1
        live = np.flatnonzero(lengths > 0)
        last = np.zeros(n, bool)
        while len(live):
            p = here[live]
            last[p] = True
            here[live] = p - step[p]
            live = live[here[live] >= starts[live]]
        ends = np.flatnonzero(last)
        size = step[ends].astype(np.int64)
        piece = found[size, ends - size + 1]
        out = np.where(piece >= 0, self.ids[piece], -1 - points[ends - size + 1].astype(np.int64))
        owner = np.searchsorted(starts, ends, "right") - 1
        return out, np.bincount(owner, minlength=len(starts))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of whole texts; null and empty texts have none."""
        texts = column.cast(pa.large_string()).fill_null("")
        full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        marked = pc.if_else(pa.array(full), pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())), texts)
        marked = pc.replace_substring(marked, MARK, " ")
        ids, counts = [], []
        for _, _, raw, offs in chunks(marked, SMALL_BYTES):
            got = self.encode_chunk(raw, offs)
            ids.append(got[0])
            counts.append(got[1])
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def encode_chunk(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_docs = len(offs) - 1
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(n_docs, np.int64)
        space, solo = raw == 32, self.solo[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[offs] = True
        cut[1:-1] |= (space[1:] & ~space[:-1]) | solo[1:] | solo[:-1]
        starts = np.flatnonzero(cut[:-1])
        bounds = np.concatenate((starts, [len(raw)]))
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = words.dictionary_encode()
        data, at = text_buffer(coded.dictionary)
        points = np.frombuffer(data.tobytes().decode().replace(" ", MARK).encode("utf-32-le"), np.uint32)
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        first = lead[at]
        ids, size = self.words(points, first[:-1].copy(), np.diff(first))
        ids, size = self.bytes_for_unknown(ids, size)
        begin = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        doc = np.searchsorted(offs, starts, "right") - 1
        return ids[ragged(begin[which], size[which])].astype(np.int32), np.bincount(doc, size[which], n_docs).astype(np.int64)

    def bytes_for_unknown(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lost = np.flatnonzero(ids < 0)
        if not len(lost):
            return ids, size
        coded = [chr(-1 - int(c)).encode() for c in ids[lost]]
        width = np.ones(len(ids), np.int64)
        width[lost] = [len(c) for c in coded]
        out = np.repeat(ids, width)
        start = np.cumsum(width) - width
        out[ragged(start[lost], width[lost])] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        owner = np.repeat(np.arange(len(size)), size)
        return out, np.bincount(owner, width, len(size)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each id sequence, without the leading space mark."""
        flat = np.frombuffer(b"".join(self.surface), np.uint8)
        size = np.array([len(s) for s in self.surface], np.int64)
        begin = np.cumsum(size) - size
        width = size[ids]
        data = flat[ragged(begin[ids], width)].tobytes()
        ends = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [data[a + (b > a) : b] for a, b in zip(ends[:-1], ends[1:])]


def point_sums(points: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(points) + 1, U)
    np.cumsum(mix(points.astype(U) + U(0x9E3779B97F4A7C15)) * powers(BASE, len(points))[: len(points)], out=sums[1:])
    return sums


def hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts])


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces.read(path)
    return _models[path]


def id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_crc32, exact) of each whole text.

    ``exact`` tells whether the decoded ids are the text again, null being
    empty.  It is false only for texts that hold the space mark U+2581 itself,
    which the encoding does not tell from a space.  Repeated rows give equal
    rows; an empty table gives none; extra columns are ignored.
    """
    import zlib

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column(1), 2 * SMALL_BYTES):
                ids, counts = pieces.encode(batch.column(1).slice(a, b - a))
                back = pieces.decode(ids, counts)
                same = [raw[s:e].tobytes() == t for s, e, t in zip(offs[:-1].tolist(), offs[1:].tolist(), back)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts), id_lists(ids, counts), pa.array([zlib.crc32(t) for t in back], pa.int64()), pa.array(same)],
                    names=["doc_id", "n_tokens", "ids", "decoded_crc32", "exact"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(scan), "doc_id long, n_tokens long, ids array<int>, decoded_crc32 long, exact boolean")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; the pipeline's result (doc_id, n_tokens, ids, exact).

    Null text is encoded as empty text, with no ids; texts of any length are
    encoded whole.  Repeated rows give equal rows; columns of other names are
    left out; an empty table gives no rows.
    """
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids", "exact")
