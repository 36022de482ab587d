"""Token ids in a bit-plane shuffled binary format.

Format. A chunk is a self-contained blob of whole documents: the magic ``BPSH1``, then a block
index, then the blocks. Ids are cut into blocks of ``BLOCK`` (the last of a chunk is shorter);
each block is transposed into planes and each plane compressed by zstandard on its own. Byte
planes are used for the low byte, bit planes for the others, and planes above the highest set
bit are not stored. The index (little-endian uint32: ids, planes, then each plane's bytes) lets a
reader fetch any block alone.

Distribution. Documents are range-partitioned by doc_id and sorted, so that a partition is a
shard of consecutive documents; each partition is tokenised and encoded in one pass. Chunks are
rows of a Parquet data set (shard, chunk, documents' ids and lengths, blob): Spark's commit
protocol makes the write safe against lost executors and repeated tasks, and the store need only
be one that Spark can write. Reading decodes every chunk alone; a document's start needs only the
shards' totals, one number a shard.

Tokenising. Byte-level BPE never joins symbols across its pre-tokens, and a pre-token never holds
a space after its first character; so a text is cut at single spaces and each distinct piece is
encoded once per worker by the library's model, through bounded caches. Pieces with anything but
printable ASCII, line feeds and Latin letters go to the full tokenizer, as does a text with odd
white space, and every text if the file has other settings than plain byte-level BPE.

Defined results: a null text is empty and gives just the end id; repeated ids each get a row,
ordered by a hash of the text, then text, so that many of them are more than one partition; null ids come first. Texts that hold a special token's string are
encoded as the tokenizer does by default.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C

MAGIC = b"BPSH1"
BLOCK = 16_384
CHUNK_IDS = 1 << 20
CACHE_PIECES, CACHE_WORDS = 1_200_000, 100_000


# --- the format ----------------------------------------------------------------------------


def encode_block(ids: np.ndarray, level: int = 3) -> list[bytes]:
    """The compressed planes of a block: the low byte, then single bits from bit 8 upwards."""
    pack = zstandard.ZstdCompressor(level=level)
    top = int(ids.max()).bit_length() if len(ids) else 0
    planes = [(ids & 0xFF).astype(np.uint8).tobytes()] if len(ids) else []
    planes += [np.packbits((ids >> np.uint32(b)).astype(np.uint8) & 1).tobytes() for b in range(8, top)]
    return [pack.compress(p) for p in planes]


def decode_block(planes: list[bytes], n: int) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    ids = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(unpack.decompress(plane), np.uint8)
        ids |= raw[:n].astype(np.uint32) if not k else np.unpackbits(raw, count=n).astype(np.uint32) << np.uint32(7 + k)
    return ids


def encode_chunk(ids: np.ndarray, block: int = BLOCK) -> bytes:
    blocks = [ids[i : i + block] for i in range(0, len(ids), block)]
    planes = [encode_block(b) for b in blocks]
    index = b"".join(struct.pack(f"<{2 + len(p)}I", len(b), len(p), *map(len, p)) for b, p in zip(blocks, planes, strict=True))
    return MAGIC + struct.pack("<II", len(blocks), len(index)) + index + b"".join(x for p in planes for x in p)


def chunk_index(blob: bytes) -> list[tuple[int, int, list[int]]]:
    """(ids, position of the first plane, sizes of the planes) of each block."""
    if blob[: len(MAGIC)] != MAGIC:
        raise ValueError("not a chunk of token planes")
    blocks, size = struct.unpack_from("<II", blob, len(MAGIC))
    at, data, out = len(MAGIC) + 8, len(MAGIC) + 8 + size, []
    for _ in range(blocks):
        n, planes = struct.unpack_from("<II", blob, at)
        sizes = list(struct.unpack_from(f"<{planes}I", blob, at + 8))
        out.append((n, data, sizes))
        at, data = at + 8 + 4 * planes, data + sum(sizes)
    return out


def decode_chunk(blob: bytes) -> np.ndarray:
    parts = []
    for n, at, sizes in chunk_index(blob):
        ends = np.cumsum(sizes, dtype=np.int64) + at
        parts.append(decode_block([blob[e - s : e] for s, e in zip(sizes, ends.tolist(), strict=True)], n))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


# --- tokenising ----------------------------------------------------------------------------


class Encoder:
    """``Tokenizer.encode(text, add_special_tokens=False)`` for a byte-level BPE file, with caches of pieces and words."""

    SIMPLE = re.compile("[\n -~À-ÖØ-öø-ɏ]*")
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        assert array("I").itemsize == 4 and sys.byteorder == "little"
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        level = spec["pre_tokenizer"] or {}
        self.plain = spec["normalizer"] is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space")
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # fixed values: the splitting pattern of this family of tokenizers
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.shown = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}
        self.words = _Cache(self._word, CACHE_WORDS)
        self.pieces = _Cache(self._piece, CACHE_PIECES)

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.shown))]).tobytes()

    def _piece(self, tail: str) -> bytes:
        """The ids of a space and ``tail``; letters, then any marks, are pre-tokens of their own."""
        if tail.isalpha() and max(tail) <= "ɏ":
            return self._word(" " + tail)
        core = tail.rstrip(self.MARKS)
        if core.isalpha() and max(core) <= "ɏ":
            return self.pieces[core] + self.words[tail[len(core) :]]
        return self._ids(" " + tail)

    def _ids(self, piece: str) -> bytes:
        if self.SIMPLE.fullmatch(piece):
            return b"".join(map(self.words.__getitem__, self.pattern.findall(piece)))
        return self._whole(piece)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.plain:
            return self._whole(text)
        if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or not text.isprintable() and re.search(r"[^\S \n]", text) or any(s in text for s in self.special):
            return self._whole(text)
        head, *tails = text.split(" ")
        return self._ids(head) + b"".join(map(self.pieces.__getitem__, tails))


class _Cache(dict):
    """Values of ``make`` by key, emptied when it holds ``most``, and when the worker turns to another operator; long keys are not kept."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most = make, most
        C.SPARE.append(self)

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- writing and reading --------------------------------------------------------------------

CHUNKS = "shard int, chunk int, n_ids long, doc_ids array<long>, lengths array<long>, blob binary"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Chunks of the ids of ``docs`` (doc_id, text), each document followed by ``end_id``, in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, chunk, codec = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        names: list[int | None] = []
        lengths: list[int] = []
        data: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            blob = encode_chunk(np.frombuffer(b"".join(data), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([size], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                names=["shard", "chunk", "n_ids", "doc_ids", "lengths", "blob"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = codec.encode(text.as_py()) + end
                n = len(ids) // 4
                if size and size + n > CHUNK_IDS:
                    yield flush()
                    names, lengths, data, size, chunk = [], [], [], 0, chunk + 1
                names.append(doc_id)
                lengths.append(n)
                data.append(ids)
                size += n
        if size:
            yield flush()

    n = partitions or C.pieces(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    dealt = keyed.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return dealt.mapInArrow(run, CHUNKS)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, partitions: int | None = None) -> None:
    encode_documents(docs, tokenizer, end_id, partitions).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = memoryview(decode_chunk(batch.column("blob")[k].as_py()).astype("<u4").tobytes())
                lengths = np.array(batch.column("lengths")[k].as_py(), np.int64)
                starts = np.cumsum(lengths) - lengths
                crcs = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                base = batch.column("before")[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[k].values, pa.array(starts + base), pa.array(lengths), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    chunks = spark.read.schema(CHUNKS).parquet(path)
    # one row a chunk of about a million ids
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_before"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n_ids")
    starts = chunks.select("shard", "chunk", "n_ids").withColumn("inside", inside).join(shards, "shard").select("shard", "chunk", (F.col("inside") + F.col("shard_before")).alias("before"))
    return chunks.drop("n_ids").join(starts, ["shard", "chunk"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
