"""Token ids in binary files of patched frame-of-reference blocks."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window, functions as F

from evidentia.llm.bpe import batches, word_encoder
from evidentia.llm.shared import materialize, new_folder, partitions, python_workers

#: Ids a block, and blocks packed or read at once.
BLOCK, CHUNK = 1024, 256
#: A file is closed when it has reached so many bytes.
FILE_BYTES = 128 << 20
#: The packed width holds at least this share of a block's ids; the rest are exceptions.
PERCENTILE = 0.95
END = 2
MAGIC = b"PFOR0001"
_FOOTER = struct.Struct("<QQQQ")


def pack(ids: np.ndarray, block: int = BLOCK, share: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """(bytes, start of each block) of ``ids``, unsigned 32-bit.

    A block: u32 minimum, u8 width, u16 count - 1, u16 number of exceptions; count offsets from the minimum, packed at ``width`` bits, low
    bits of larger ones included; exception places (u16) and their high bits (u32). Blocks of one width are packed together.
    """
    n = len(ids)
    blocks = -(-n // block)
    padded = np.zeros(blocks * block, np.uint32)
    padded[:n] = ids
    if n:
        padded[n:] = ids[-1]
    grid = padded.reshape(blocks, block)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    offset = grid - low[:, None]
    counts = np.full(blocks, block)
    if n % block:
        counts[-1] = n % block
    at = min(block - 1, int(np.ceil(share * block)) - 1)
    cut = np.partition(offset, at, axis=1)[:, at] if blocks else np.zeros(0, np.uint32)
    widths = np.zeros(blocks, np.int64)
    for w in range(32):
        widths += (cut >> np.uint32(w)) > 0
    out: list[bytes] = [b""] * blocks
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        for part in np.array_split(rows, -(-len(rows) // 256)):
            values = offset[part]
            bits = ((values[:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
            packed = np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little")
            high = values >> np.uint32(w) if w < 32 else np.zeros_like(values)
            for r, b in enumerate(part):
                c = int(counts[b])
                places = np.flatnonzero(high[r, :c])
                head = struct.pack("<IBHH", int(low[b]), int(w), c - 1, len(places))
                out[b] = b"".join((head, packed[r, : (c * int(w) + 7) // 8].tobytes(), places.astype("<u2").tobytes(), high[r, places].astype("<u4").tobytes()))
    starts = np.cumsum([0, *map(len, out)])[:-1]
    return b"".join(out), starts.astype("<u8")


def unpack_block(data: memoryview | bytes, start: int) -> np.ndarray:
    """The ids of the block that starts at ``start``."""
    low, w, last, n_out = struct.unpack_from("<IBHH", data, start)
    c, at = last + 1, start + 9
    size = (c * w + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=c * w, bitorder="little").reshape(c, w)
    values = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(w, dtype=np.uint32)) if w else np.zeros(c, np.uint32)
    at += size
    places = np.frombuffer(data, "<u2", n_out, at)
    high = np.frombuffer(data, "<u4", n_out, at + 2 * n_out)
    values[places] |= high << np.uint32(w)
    return values + np.uint32(low)


class Writer:
    """Writes one file to a stream, holding CHUNK blocks of ids, 8 bytes a block and 17 bytes a document at once.

    A file: magic; blocks; block starts (u64); documents (i64 id, u8 id is not null, u64 tokens); footer with the place of each part; magic.
    """

    def __init__(self, stream, block: int = BLOCK):
        self.stream, self.block, self.size, self.n_ids = stream, block, len(MAGIC), 0
        self.starts: list[np.ndarray] = []
        self.docs, self.known, self.counts = array("q"), array("b"), array("q")
        self.held: list[np.ndarray] = []
        self.n_held = 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, *ids: np.ndarray) -> None:
        """A document; ``ids`` are its parts."""
        self.docs.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.counts.append(sum(map(len, ids)))
        self.n_ids += self.counts[-1]
        self.held += ids
        self.n_held += self.counts[-1]
        if self.n_held >= CHUNK * self.block:
            self._flush(self.n_held // self.block * self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.held])
        for i in range(0, n, CHUNK * self.block):
            body, starts = pack(ids[i : min(n, i + CHUNK * self.block)], self.block)
            self.starts.append(starts + np.uint64(self.size - len(MAGIC)))
            self.stream.write(body)
            self.size += len(body)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_held)
        starts = np.concatenate([np.zeros(0, "<u8"), *self.starts]).astype("<u8").tobytes()
        parts = (starts, np.array(self.docs, "<i8").tobytes(), np.array(self.known, "u1").tobytes(), np.array(self.counts, "<u8").tobytes())
        self.stream.write(b"".join((*parts, _FOOTER.pack(self.size, self.size + len(starts), len(self.docs), self.block), MAGIC)))


class TokenFile:
    """Random access to one file (bytes, or an open file): any range of ids reads and decodes only its own blocks."""

    def __init__(self, source: bytes | pa.NativeFile):
        self.source = pa.BufferReader(source) if isinstance(source, bytes) else source
        size, edge = self.source.size(), len(MAGIC)
        tail = self._at(size - edge - _FOOTER.size, size)
        if self._at(0, edge) != MAGIC or tail[-edge:] != MAGIC:
            raise ValueError("not a token file")
        at, docs, n, self.block = _FOOTER.unpack_from(tail)
        self.starts = np.append(np.frombuffer(self._at(at, docs), "<u8").astype(np.int64) + edge, at)
        held = self._at(docs, docs + 17 * n)
        self.doc_ids = np.frombuffer(held, "<i8", n)
        self.known = np.frombuffer(held, "u1", n, 8 * n)
        self.counts = np.frombuffer(held, "<u8", n, 9 * n).astype(np.int64)

    def _at(self, start: int, stop: int) -> bytes:
        return self.source.read_at(stop - start, start)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        base = int(self.starts[first])
        data = self._at(base, int(self.starts[last + 1]))
        found = np.concatenate([unpack_block(data, int(self.starts[b]) - base) for b in range(first, last + 1)])
        return found[start - first * self.block : stop - first * self.block]

    def documents(self, chunk: int = CHUNK) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc id, ids) in file order, decoding some blocks at a time."""
        edges = np.concatenate([[0], np.cumsum(self.counts)])
        held, base = np.zeros(0, np.uint32), 0
        for i in range(len(self.counts)):
            a, z = int(edges[i]), int(edges[i + 1])
            if z > base + len(held):
                stop = min(int(edges[-1]), max(z, a + chunk * self.block))
                held, base = self.ids(a, stop), a
            yield (int(self.doc_ids[i]) if self.known[i] else None), held[a - base : z - base]


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``uri`` (a path without a scheme is local to all, such as a mounted share)."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri):
        uri = "file://" + uri
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!//)/*", "file:///", uri))


def write(docs: DataFrame, folder: str, path: str, doc_id: str = "doc_id", text: str = "text", end: int = END, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(file, n_docs, n_ids, part, seq) of the files written under ``folder``: every text's ids and ``end`` after each, in ascending doc_id order.

    Rows are range-partitioned by doc_id and sorted in each partition (null ids first, rows of one id by a hash of the text, so that many rows of
    one id are split too). A task streams its rows into files of about ``file_bytes`` bytes, so its memory does not grow with its partition; files follow
    each other in order of part and seq. Each is written under a name of its own and then renamed, so a task that runs twice leaves whole files only, and
    the manifest lists those of the attempts that counted. A null text is empty and holds only ``end``. An empty table writes nothing.
    """
    schema = pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("part", pa.int32()), ("seq", pa.int32())])
    python_workers(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, last, part = word_encoder(path), np.array([end], "<u4"), TaskContext.get().partitionId()
        system, base = _place(folder)
        writer, name, seq = None, "", 0

        def closed() -> pa.RecordBatch:
            writer.close()
            writer.stream.close()
            system.move(f"{base}/.{name}", f"{base}/{name}")
            return pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "n_docs": len(writer.docs), "n_ids": writer.n_ids, "part": part, "seq": seq}], schema)

        for batch, texts in batches(rows, "_text"):
            for i, raw in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                if writer is None:
                    system.create_dir(base, recursive=True)
                    name = f"part-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.pfor"
                    writer = Writer(system.open_output_stream(f"{base}/.{name}"))
                writer.add(i, np.frombuffer(raw, "<u4"), last)
            if writer is not None and writer.size >= file_bytes:
                yield closed()
                writer, seq = None, seq + 1
        if writer is not None:
            yield closed()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text"), F.xxhash64(F.col(text)).alias("_hash"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "_text")
    return materialize(ordered.mapInArrow(run, "file string, n_docs long, n_ids long, part int, seq int"), "token-manifest")


def read(manifest: DataFrame, tokens: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files of ``manifest``.

    start counts the ids of all documents before it. Files are dealt over tasks and read block by block; the only rows that meet are one for each file.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("_base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("file", "_base")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if tokens else "")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for r in batch.to_pylist():
                system, base = _place(r["file"])
                at, out = r["_base"], []
                with system.open_input_file(base) as f:
                    for i, ids in TokenFile(f).documents():
                        row = {"doc_id": i, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
                        out.append(row | {"ids": ids.tolist()} if tokens else row)
                        at += len(ids)
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_pylist(out, _arrow(tokens))
                            out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, _arrow(tokens))

    spread = files.repartition(partitions(manifest.sparkSession), "file")
    return spread.mapInArrow(run, schema)


def _arrow(tokens: bool) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")] + ([("ids", pa.list_(pa.int64()))] if tokens else []))


def roundtrip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokens: bool = False, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``docs`` to a new folder of token files and read them back."""
    return read(write(docs, new_folder(docs.sparkSession, "token-files"), path, doc_id, text, file_bytes=file_bytes), tokens)
