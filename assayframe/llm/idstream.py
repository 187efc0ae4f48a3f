"""Token ids in Arrow stream files of fixed-size lists.

Documents are encoded in ascending doc_id order, each followed by an end id.
A shard file is an Arrow IPC stream whose batches hold ``ids``, a fixed-size
list of unsigned 16- or 32-bit integers, and ``mask``, a fixed-size list of
booleans that is false on the padding of the last sequence.  Every sequence
has the same length, so sequence k lies at a fixed place of a memory-mapped
buffer.  A second stream beside it holds each document's place.
"""
from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textnp import SPACE, chunks, ragged, text_buffer

END_ID = 2
SEQ_LEN = 2048
BATCH_SEQS = 64
GROUP_BYTES = 10 << 20
#: UTF-8 bytes of text a shard file: files and tasks keep this size however large the table
SHARD_BYTES = 64 << 20
JOINED = 4000
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """The tokenizers library on the distinct space-separated segments of a batch.

    A byte-level BPE of this family never joins text across a single space
    between two non-space characters, so such segments are encoded apart, each
    distinct one once.  Texts with white space beyond ASCII or with the string
    of an added token (which the library turns into that token's id) are
    encoded whole, and so are all texts under a tokenizer of another make.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        self.by_words = made["normalizer"] is None and made["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a byte-level vocabulary writes each byte of a token as one character
        self.lengths = np.array([len(self.tokenizer.id_to_token(i)) for i in range(size)], np.int64)

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per segment) of distinct segments.

        Segments that start with a space are encoded joined, some thousands
        at once: the cuts between them are cuts of the tokenizer, and the
        known byte lengths of ids tell where each segment ends.
        """
        raw, offs = text_buffer(words)
        sizes = np.diff(offs)
        spaced = np.zeros(len(sizes), bool)
        spaced[:] = raw[offs[:-1]] == 0x20
        joined, rest = np.flatnonzero(spaced), np.flatnonzero(~spaced)
        counts = np.zeros(len(sizes), np.int64)
        ids: list[np.ndarray] = []
        if len(joined):
            texts, groups = [], []
            data = raw[ragged(offs[joined], sizes[joined])].tobytes()
            at = np.concatenate(([0], np.cumsum(sizes[joined])))
            for k in range(0, len(joined), JOINED):
                end = min(len(joined), k + JOINED)
                texts.append(data[at[k] : at[end]].decode())
                groups.append((k, end))
            for (k, end), e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                got = np.array(e.ids, np.uint32)
                last = np.cumsum(self.lengths[got]) + at[k]
                stop = np.searchsorted(last, at[k + 1 : end + 1]) + 1
                counts[joined[k:end]] = np.diff(stop, prepend=0)
                ids.append(got)
        if len(rest):
            texts = words.take(pa.array(rest)).to_pylist()
            for w, e in zip(rest.tolist(), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                got = np.array(e.ids, np.uint32)
                counts[w] = len(got)
                ids.append(got)
        order = np.concatenate((joined, rest))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        first = np.zeros(len(sizes), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return flat[ragged(first, counts)], counts

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        raw, offs = text_buffer(column)
        n_docs = len(offs) - 1
        odd = self.odd_space(raw, offs) | (not self.by_words)
        for token in self.added:
            odd |= pc.match_substring(column, token).fill_null(False).to_numpy(zero_copy_only=False)
        counts = np.zeros(n_docs, np.int64)
        space = SPACE[raw]
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw) > 2:
            cut[1:-2] = (raw[1:-1] == 0x20) & ~space[:-2] & ~space[2:]
        cut[offs] = True
        starts = np.flatnonzero(cut[:-1])
        doc = np.searchsorted(offs, starts, "right") - 1
        ends = np.concatenate((starts[1:], [len(raw)]))[: len(starts)]
        plain = ~odd[doc]
        starts, ends, doc = starts[plain], ends[plain], doc[plain]
        ids = np.zeros(0, np.uint32)
        if len(starts):
            lengths = ends - starts
            packed = raw[ragged(starts, lengths)] if odd.any() else raw
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            segments = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(packed)))
            coded = segments.dictionary_encode()
            flat, sizes = self.distinct(coded.dictionary)
            at = np.concatenate(([0], np.cumsum(sizes)))
            which = coded.indices.to_numpy()
            ids = flat[ragged(at[which], sizes[which])]
            counts += np.bincount(doc, sizes[which], n_docs).astype(np.int64)
        if odd.any():
            whole = np.flatnonzero(odd)
            texts = [t or "" for t in column.take(pa.array(whole)).to_pylist()]
            apart = {d: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for d, t in zip(whole.tolist(), texts)}
            at = np.concatenate(([0], np.cumsum(counts)))
            ids = np.concatenate([apart.get(d, ids[at[d] : at[d + 1]]) for d in range(n_docs)])
            for d, x in apart.items():
                counts[d] = len(x)
        return ids, counts

    @staticmethod
    def odd_space(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Texts with bytes that may be white space outside space and \\t-\\r."""
        hit = np.zeros(len(raw), bool)
        if len(raw) > 1:
            a, b = raw[:-1], raw[1:]
            hit[:-1] = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
        hit |= (raw >= 0x1C) & (raw <= 0x1F)
        total = np.concatenate(([0], np.cumsum(hit)))
        return total[offs[1:]] > total[offs[:-1]]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path of a URI; Hadoop's names of S3 are its own ``s3``."""
    kind, colon, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"s3{colon}{rest}" if kind in ("s3a", "s3n") else uri)


class StreamWriter:
    """Packs ids into fixed-length sequences and writes whole batches."""

    def __init__(self, fs: pafs.FileSystem, path: str, seq_len: int, dtype: np.dtype):
        self.seq_len, self.dtype, self.rest, self.n = seq_len, np.dtype(dtype), np.zeros(0, dtype), 0
        value = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(value, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.sink = fs.open_output_stream(path)
        self.out = pa.ipc.new_stream(self.sink, self.schema)

    def put(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        have = np.concatenate((self.rest, ids.astype(self.dtype)))
        size = self.seq_len * BATCH_SEQS
        full = len(have) // size * size
        for a in range(0, full, size):
            self.batch(have[a : a + size], size)
        self.rest = have[full:]

    def batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.seq_len) for v in (ids, mask)]
        self.out.write_batch(pa.record_batch(cols, schema=self.schema))

    def close(self) -> None:
        if len(self.rest):
            real = len(self.rest)
            pad = -real % self.seq_len
            self.batch(np.concatenate((self.rest, np.zeros(pad, self.dtype))), real)
        self.out.close()
        self.sink.close()


class StreamReader:
    """Random access to a shard: the id buffers of its batches, not copied.

    On a local file system the file is memory-mapped; elsewhere it is read.
    """

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        with pa.ipc.open_stream(source) as stream:
            self.batches = list(stream)
            self.seq_len = stream.schema.field("ids").type.list_size
        self.first = np.concatenate(([0], np.cumsum([len(b) * self.seq_len for b in self.batches]))).astype(np.int64)

    def sequence(self, k: int) -> np.ndarray:
        return self.ids(k * self.seq_len, (k + 1) * self.seq_len)

    def ids(self, start: int, end: int) -> np.ndarray:
        out = []
        b = int(np.searchsorted(self.first, start, "right")) - 1
        while start < end:
            stop = min(end, int(self.first[b + 1]))
            flat = self.batches[b].column(0).flatten().to_numpy(zero_copy_only=True)
            out.append(flat[start - self.first[b] : stop - self.first[b]])
            start, b = stop, b + 1
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)

    def real(self) -> int:
        return sum(int(b.column(1).flatten().true_count) for b in self.batches)


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, seq_len: int = SEQ_LEN) -> DataFrame:
    """Encode and write every document; one row per shard file.

    Rows: part, uri, n_docs, n_ids.  A task writes to names of its own and
    only the files of tasks that succeeded are listed, so retries and lost
    executors leave no half-written shard in the result.  A shard takes about
    SHARD_BYTES of text, so their number follows the table.  Null or empty text
    gives the end id alone; null ids come first; rows of one id come by the
    hash of their text, and an id of very many rows is cut between shards.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(common.parts(docs.sparkSession), -(-size // SHARD_BYTES))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange(n_shards, "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, places = encoder(tokenizer_path), None, None
        dtype = np.uint16 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        fs, base = filesystem(folder)
        part = n_docs = 0
        uri = ""
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                fs.create_dir(base, recursive=True)
                part = batch.column(0)[0].as_py()
                name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
                uri = f"{folder}/{name}"
                out = StreamWriter(fs, f"{base}/{name}.arrows", seq_len, dtype)
                sink = fs.open_output_stream(f"{base}/{name}.index.arrows")
                places = pa.ipc.new_stream(sink, INDEX)
            for a, b, _, _ in chunks(batch.column(2), GROUP_BYTES):
                some = batch.slice(a, b - a)
                ids, counts = enc.encode(some.column(2))
                ends = np.cumsum(counts + 1)
                full = np.empty(ends[-1], np.uint32)
                full[ends - 1] = end_id
                inner = np.ones(len(full), bool)
                inner[ends - 1] = False
                full[inner] = ids
                start = out.n + ends - counts - 1
                places.write_batch(pa.record_batch([some.column(1), pa.array(start), pa.array(counts + 1)], schema=INDEX))
                out.put(full)
                n_docs += len(some)
        if out is not None:
            places.close()
            sink.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [uri], "n_docs": [n_docs], "n_ids": [out.n]})

    return common.staged(ordered.mapInArrow(write, "part int, uri string, n_docs long, n_ids long"), "id-shards")


def read_shards(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """One row per document of the shard files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts all ids before the document over all files.  The list of
    files, one row a shard, gives each file the ids before it.
    """
    listed = shards.orderBy("part").collect()
    rows, before = [], 0
    for r in listed:
        rows.append((r["uri"], before))
        before += r["n_ids"]
    files = spark.createDataFrame(rows, "uri string, before long").repartition(max(1, len(rows)), "uri")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = filesystem(r["uri"])
                with fs.open_input_file(f"{path}.index.arrows") as f, pa.ipc.open_stream(f) as index:
                    places = index.read_all()
                shard = StreamReader(f"{r['uri']}.arrows")
                start, count = (places.column(c).to_numpy() for c in ("start", "n_tokens"))
                crc = [zlib.crc32(shard.ids(s, s + n).astype("<u4")) for s, n in zip(start.tolist(), count.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [places.column("doc_id").combine_chunks(), pa.array(start + r["before"]), pa.array(count), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_arrow_id_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    folder = common.staged_path(spark, "id-streams")
    shards = write_shards(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(spark, shards)
