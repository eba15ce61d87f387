"""Token ids in length-delimited binary records, with a separate offset index for shuffled reads.

A shard is a run of records: length (u64), masked CRC of the length (u32), payload, masked CRC of the
payload (u32), all little-endian. A payload is a flag byte (bit 0: the document has an id; bit 1: ids are
32 bits wide, else 16; bit 2: what follows the id is a Zstandard frame), the document's id (i64), then the
token ids. ``<shard>.idx`` holds offset and length
(u64 each) of every record. The CRC is CRC-32; masking rotates it by 15 bits and adds a constant, so that a
checksum of data holding checksums stays sound.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, scratch_path, table
from .memo import ChunkMemo
from .sentencepiece_bpe import tokenizer_path

MASK_DELTA = 0xA282EAD8
#: Chunks whose ids a worker keeps.
KEPT_CHUNKS = 1_000_000

# The tokenizer's own splitting puts a boundary everywhere these chunks end: white space shares a token only
# with what follows, and then as a single space; letters share none with a stop or comma. So the chunks can
# be encoded one by one. Where Python and the tokenizer may differ on what white space is, or a special
# token's string may occur, the text is encoded as one.
_CHUNKS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\s.,])|[.,](?=\s)| ?\S+|\s+(?!\S)|\s")
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_AS_ONE = re.compile("[\x1c-\x1f]|<\\|")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


class TokenEncoder:
    """Texts to ids by a byte-level tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.memo = ChunkMemo(self._encode_chunk, KEPT_CHUNKS)

    def _encode_chunk(self, chunk: str) -> bytes:
        if _WORD.fullmatch(chunk):  # a single token of the splitting, so it goes to the merges at once
            ids = [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers; null counts as empty."""
        if not text:
            return b""
        if _AS_ONE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.memo.__getitem__, _CHUNKS.findall(text)))


@lru_cache(2)
def _encoder(path: str) -> TokenEncoder:
    return TokenEncoder(path)


def pack(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    """One framed record; ``ids`` are 32-bit little-endian. They are compressed where that makes them shorter."""
    kept = ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    packed = zstandard.compress(kept, 1)
    shorter = len(packed) < len(kept)
    payload = struct.pack("<Bq", (doc_id is not None) | wide << 1 | shorter << 2, doc_id or 0) + (packed if shorter else kept)
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    """Document id and 32-bit token ids."""
    flags, doc_id = struct.unpack_from("<Bq", payload)
    ids = zstandard.decompress(payload[9:]) if flags & 4 else payload[9:]
    return (doc_id if flags & 1 else None), np.frombuffer(ids, "<u4" if flags & 2 else "<u2").astype("<u4")


def read_record(f) -> bytes | None:
    """The next payload of an open shard, both checksums verified; None at the end."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or masked_crc(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
        raise ValueError("damaged record length")
    payload = f.read(struct.unpack("<Q", head[:8])[0])
    tail = f.read(4)
    if len(tail) < 4 or masked_crc(payload) != struct.unpack("<I", tail)[0]:
        raise ValueError("damaged record")
    return payload


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def read_shard(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records of a shard in order."""
    where, path = _open(uri)
    with where.open_input_stream(path, buffer_size=1 << 20) as f:
        while (payload := read_record(f)) is not None:
            yield unpack(payload)


def read_at(uri: str, numbers: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records by number in any order, found through the offset index: a shuffled read."""
    where, path = _open(uri)
    with where.open_input_file(path + ".idx") as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
    out = []
    with where.open_input_file(path) as f:
        for n in numbers:
            f.seek(int(index[n, 0]))
            out.append(unpack(read_record(f)))
    return out


def _commit(where: pafs.FileSystem, tmp: str, path: str) -> None:
    """Take a finished file over; a task that runs again writes the same bytes, so either may win."""
    if where.type_name != "local" and where.get_file_info(path).type != pafs.FileType.NotFound:
        where.delete_file(path)
    where.move(tmp, path)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, str, int, int]]:
    """Encode whole texts and write them to shards of ``folder`` in ascending id order.

    Returns ``(shard, uri, records, tokens)`` of each shard that has records, in order; there are as many as
    partitions. Rows are dealt out by ranges of the id and of a hash of the text, so an id that many rows
    share is split; within a shard rows sort by id (nulls first), then text, so repeated rows and ties have
    one order. Null texts hold the end id alone. Other columns are not read. An empty table has no shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ctx = _encoder(tokenizer), TaskContext.get()
        wide = enc.tokenizer.get_vocab_size() > 65536
        tail = b"" if end_id is None else struct.pack("<I", end_id)
        shard, offset, records, tokens = ctx.partitionId(), 0, 0, 0
        uri = f"{folder}/shard-{shard:06d}.rec"
        where, path = _open(uri)
        tmp = f"{path}.{ctx.taskAttemptId()}.tmp"
        out = index = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    where.create_dir(path.rpartition("/")[0], recursive=True)
                    out, index = where.open_output_stream(tmp, buffer_size=1 << 20), where.open_output_stream(tmp + ".idx", buffer_size=1 << 16)
                ids = enc.encode(text) + tail
                record = pack(doc_id, ids, wide)
                out.write(record)
                index.write(struct.pack("<QQ", offset, len(record)))
                offset, records, tokens = offset + len(record), records + 1, tokens + len(ids) // 4
        if out is None:
            return
        out.close()
        index.close()
        _commit(where, tmp + ".idx", path + ".idx")
        _commit(where, tmp, path)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "uri": uri, "records": records, "tokens": tokens}])

    ordered = bound_batches(docs).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    ordered = ordered.repartitionByRange("i", F.xxhash64("t")).sortWithinPartitions("i", F.xxhash64("t"), "t")
    done = ordered.mapInArrow(run, "shard long, uri string, records long, tokens long").collect()
    return sorted(tuple(r) for r in done)


def read_records(spark: SparkSession, shards: list[tuple[int, str, int, int]]) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every record, read from the shards' files."""
    base = [0, *np.cumsum([s[3] for s in shards], dtype=object)]
    places = [(s[1], int(b)) for s, b in zip(shards, base, strict=False)]
    schema = T.StructType([T.StructField(n, T.LongType(), n == "doc_id") for n in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                uri, at = places[k]
                rows: tuple[list, ...] = ([], [], [], [])
                for doc_id, ids in read_shard(uri):
                    for col, x in zip(rows, (doc_id, at, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                        col.append(x)
                    at += len(ids)
                    if len(rows[0]) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=schema.names)
                        rows = ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=schema.names)

    return spark.range(0, len(places), 1, max(1, len(places))).mapInArrow(run, schema)


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_records(spark, write_records(docs, scratch_path(spark, "token-records"), tokenizer_path("byte_bpe_50k.json"), end_id=2))
