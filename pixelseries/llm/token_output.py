"""Token ids in bit-plane frames: fixed-size blocks of ids, transposed into bit or byte planes, each plane compressed.

Documents are dealt by ranges of doc_id, sorted inside each range and encoded; the ids of a range form one stream that is
cut into blocks of `block` ids. A block is stored as a frame

    b"BPL1", width of an id in bytes (1 byte), planes a byte (1 or 8; 1 byte), number of planes (2), number of ids (4),
    length of each compressed plane (4 each), the planes (zstandard)

with little-endian numbers. Plane p of a bit-plane frame holds bit p % 8 of byte p / 8 of every id, packed from the lowest
bit on; of a byte-plane frame, byte p. Frames are rows of an uncompressed Parquet table, one file for each range, sorted
by block, whose other columns are the chunk index: range, block, ids before it in the range, and the documents with ids in
it with their numbers of ids. Any block can be read alone.

Null and empty texts consist of the end id. Null doc_ids come first; equal doc_ids are ordered by a hash of the text, and repeated
rows stay repeated, each with its own start. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelseries.llm.common import ragged, shared_dir
from pixelseries.llm.token_counts import byte_symbols

DEFAULT = public_tokenizers.path("word_bpe_49k.json")
END = 2
BLOCK = 1 << 16
MAGIC = b"BPL1"
CACHED_CORES = 1 << 20
GROUP_BYTES = 1 << 22  # texts are encoded together up to this size
#: Closing characters that make a piece of their own behind a letter.
TAIL = ".,!?*%&#$|:;)"


def pack(ids: np.ndarray, planes: str = "bit", level: int = 3) -> bytes:
    """A frame of unsigned 16- or 32-bit ids."""
    width = ids.dtype.itemsize
    octets = np.ascontiguousarray(ids, ids.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, width)
    if planes == "bit":
        rows = [np.packbits(octets[:, k] & (1 << bit), bitorder="little") for k in range(width) for bit in range(8)]
    elif planes == "byte":
        rows = [np.ascontiguousarray(octets[:, k]) for k in range(width)]
    else:
        raise ValueError(f"planes are 'bit' or 'byte', not {planes!r}")
    codec = zstandard.ZstdCompressor(level=level, write_content_size=True)
    packed = [codec.compress(r.tobytes()) for r in rows]
    head = MAGIC + struct.pack("<BBHI", width, 8 if planes == "bit" else 1, len(packed), len(ids))
    return head + struct.pack(f"<{len(packed)}I", *map(len, packed)) + b"".join(packed)


def unpack(frame: bytes) -> np.ndarray:
    """The ids of a frame."""
    if frame[:4] != MAGIC:
        raise ValueError("not a plane frame")
    width, per_byte, n_planes, n = struct.unpack_from("<BBHI", frame, 4)
    sizes = struct.unpack_from(f"<{n_planes}I", frame, 12)
    at, codec, planes = 12 + 4 * n_planes, zstandard.ZstdDecompressor(), []
    for size in sizes:
        planes.append(np.frombuffer(codec.decompress(frame[at : at + size]), np.uint8))
        at += size
    rows = np.stack(planes) if planes else np.zeros((0, 0), np.uint8)
    if per_byte == 8:
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        octets = np.packbits(bits.T, axis=1, bitorder="little")
    else:
        octets = rows.T
    return np.ascontiguousarray(octets).view(f"<u{width}").reshape(-1)


class Encoder:
    """Ids of texts by the tokenizers library. The vocabulary's pieces never reach over white space, nor over the border
    of a letter and a closing character, so every distinct word core is encoded once. Ids of all cores stand in one
    table; words, and then texts, take theirs from it by number."""

    def __init__(self, path: str, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.symbols = str.maketrans(dict(enumerate(byte_symbols())))
        self.end = end
        self.forget()

    def forget(self) -> None:
        self.cores: dict[str, int] = {"": 0}
        self.table = np.array([self.end], self.dtype)  # the end id, then those of the cores
        self.starts, self.lengths = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def plain(self, core: str) -> bool:
        """Whether a core is one piece that needs no normalising but lower case: letters of the Latin blocks only."""
        return core.isascii() and core.isalpha() or core.isalpha() and max(core) < "\u0250" and "\u0130" not in core

    def learn(self, cores: list[str]) -> None:
        ids: list[list[int]] = []
        other: list[str] = []
        for c in cores:
            if self.plain(c):
                c = c if c.isascii() else c.lower().encode().decode("latin-1").translate(self.symbols)
                ids.append([t.id for t in self.model.tokenize(c)])
            else:
                ids.append([])
                other.append(c)
        found = iter(self.library.encode_batch_fast(other, add_special_tokens=False))
        ids = [x or next(found).ids for x in ids]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.starts)
        self.cores.update(zip(cores, range(first, first + len(cores))))
        self.starts = np.concatenate([self.starts, len(self.table) + np.cumsum(n) - n])
        self.lengths = np.concatenate([self.lengths, n])
        self.table = np.concatenate([self.table, np.fromiter(chain.from_iterable(ids), self.dtype, int(n.sum()))])

    def numbers(self, cores: pa.Array) -> np.ndarray:
        each = cores.dictionary_encode()
        names = each.dictionary.to_numpy(zero_copy_only=False)
        if missing := [c for c in names if c not in self.cores]:
            self.learn(missing)
        return np.fromiter(map(self.cores.__getitem__, names), np.int64, len(names))[each.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id behind it, and how many each one has."""
        if len(self.cores) > CACHED_CORES:
            self.forget()
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        each = split.flatten().dictionary_encode()
        words = each.dictionary
        special = pc.match_substring(words, "<|")
        lower = pc.if_else(special, words, pc.ascii_lower(words))
        trimmed = pc.ascii_rtrim(lower, TAIL)
        parted = pc.and_(pc.match_substring_regex(trimmed, "[a-z]$"), pc.invert(special))
        core = pc.if_else(parted, trimmed, lower)
        n, whole = pc.utf8_length(core).to_numpy(), lower.to_numpy(zero_copy_only=False)
        more = np.flatnonzero(n < pc.utf8_length(lower).to_numpy())
        core, tail = self.numbers(core), np.zeros(len(words), np.int64)
        tail[more] = self.numbers(pa.array([whole[k][n[k] :] for k in more], pa.string()))
        # a word's ids: its core's, then its tail's
        pairs = np.stack([core, tail], axis=1).reshape(-1)
        by_word = self.table[ragged(self.starts[pairs], self.lengths[pairs])]
        lengths = self.lengths[core] + self.lengths[tail]
        starts = np.cumsum(lengths) - lengths
        # one more word, the end id, stands behind every text
        by_word = np.append(by_word, self.table[0])
        starts, lengths = np.append(starts, len(by_word) - 1), np.append(lengths, 1)
        order = np.insert(each.indices.to_numpy().astype(np.int64), offsets[1:], len(starts) - 1)
        taken = lengths[order]
        ends = np.concatenate([[0], np.cumsum(taken)])[offsets[1:] + np.arange(1, len(offsets))]
        return by_word[ragged(starts[order], taken)], np.diff(ends, prepend=0)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    """One for each worker process, kept between tasks."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


FRAMES = "part int, block int, first_id long, n_ids int, first_doc long, goes_on boolean, docs array<long>, lengths array<int>, frame binary"


def write_ids(docs: DataFrame, to: str, path: str = DEFAULT, end: int = END, block: int = BLOCK, planes: str = "bit") -> None:
    """Encodes every text and writes the frame table in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path, end), TaskContext.get().partitionId()
        held, n_held, first_id, k, first_doc, goes_on = [], 0, 0, 0, 0, False
        index: list[list[int | None]] = []  # of the ids in hand: document, ids

        def out(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal first_id, k, first_doc, goes_on, index
            took, left, i = [], len(ids), 0
            while left:
                use = min(left, index[i][1])
                took.append((index[i][0], use))
                left -= use
                index[i][1] -= use
                i += index[i][1] == 0
            row = [part, k, first_id, len(ids), first_doc, goes_on, [d for d, _ in took], [u for _, u in took], pack(ids, planes)]
            first_id, k, first_doc = first_id + len(ids), k + 1, first_doc + i
            goes_on = i < len(took)
            index = index[i:]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, kinds)], schema=kinds)

        for b in batches:
            sizes = pc.binary_length(b.column(1)).to_numpy()
            group = np.cumsum(sizes, dtype=np.int64) // GROUP_BYTES
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), b.num_rows] if b.num_rows else []
            for i, j in zip(cuts, cuts[1:]):
                ids, n = enc.encode(b.column(1).slice(i, j - i))
                index += map(list, zip(b.column(0).slice(i, j - i).to_pylist(), n.tolist()))
                held.append(ids)
                n_held += len(ids)
                if n_held >= block:
                    ids = np.concatenate(held)
                    full = n_held - n_held % block
                    for at in range(0, full, block):
                        yield out(ids[at : at + block])
                    held, n_held = [ids[full:]], n_held - full
        if n_held:
            yield out(np.concatenate(held))

    kinds = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int32()), ("first_doc", pa.int64()), ("goes_on", pa.bool_()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("frame", pa.binary())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # by the text's hash too, so that rows of one id, or of none, are dealt to more than one task
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    dealt.mapInArrow(run, FRAMES).write.option("compression", "none").parquet(to)


def crc_join(crcs: list[tuple[int, int]]) -> int:
    """The CRC-32 of bytes from (crc, length) of consecutive parts."""

    def times(matrix: list[int], v: int) -> int:
        out = 0
        for row in matrix:
            if not v:
                break
            if v & 1:
                out ^= row
            v >>= 1
        return out

    crc = crcs[0][0]
    for nxt, length in crcs[1:]:
        power = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
        n = 8 * length
        while n:
            if n & 1:
                crc = times(power, crc)
            power = [times(power, r) for r in power]
            n >>= 1
        crc ^= nxt
    return crc


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_no (of the range), doc_id, block, first_id (in the range), ids: the pieces of documents in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, cuts = unpack(r["frame"]).astype(np.uint32), np.cumsum([0, *r["lengths"]])
                n = len(r["docs"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["part"]] * n, pa.int32()),
                        pa.array(range(r["first_doc"], r["first_doc"] + n), pa.int64()),
                        pa.array(r["docs"], pa.int64()),
                        pa.array([r["block"]] * n, pa.int32()),
                        pa.array(r["first_id"] + cuts[:-1], pa.int64()),
                        pa.array([ids[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
                    ],
                    ["part", "doc_no", "doc_id", "block", "first_id", "ids"],
                )

    frames = spark.read.parquet(path)
    return frames.mapInArrow(run, "part int, doc_no long, doc_id long, block int, first_id long, ids binary")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a frame table, from the ids it holds."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [crc_join([(p["crc"], 4 * p["n"]) for p in row]) for row in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    sizes = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("ids"))  # a row for each file
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))
    pieces = read_ids(spark, path).select("part", "doc_no", "doc_id", "first_id", (F.octet_length("ids") / 4).cast("long").alias("n"), F.crc32("ids").alias("crc"))
    docs = pieces.groupBy("part", "doc_no", "doc_id").agg(
        F.min("first_id").alias("first_id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("first_id", "n", "crc"))).alias("pieces")
    )
    docs = docs.join(starts, "part").select("doc_id", (F.col("before") + F.col("first_id")).alias("start"), "n_tokens", "pieces")
    one = docs.where(F.size("pieces") == 1).select("doc_id", "start", "n_tokens", F.col("pieces")[0]["crc"].alias("ids_crc32"))
    more = docs.where(F.size("pieces") > 1).mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return one.unionByName(more)


def token_output(docs: DataFrame, to: str | None = None, **options: object) -> DataFrame:
    """Writes the frame table (to a folder of its own in the shared folder, if `to` is None) and digests what is read back."""
    spark = docs.sparkSession
    to = to or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, to, **options)
    return digests(spark, to)
