"""Token ids as bit-plane shuffled binary files.

Documents are range-partitioned by id, so that files follow one another in
ascending order.  Each task tokenises its documents and writes one file: the ids
in blocks of a fixed number, each block transposed into byte planes (or bit
planes where few bits are in use), each plane compressed with zstandard, a chunk
index at the end.  A file's name holds a fresh id, and only the files named in
the manifest, written by Spark's committed output, count: a task that is lost or
run twice leaves at most a stray file.

File: the planes, then a footer (JSON, zstandard), its length (4 bytes) and a mark.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmerge.llm.arrow import steps
from quillmerge.llm.rows import WordRows
from quillmerge.sources.scratch import materialise, scratch_path

MAGIC = b"QMBP1\n"
#: Ids in a block.
BLOCK = 1 << 16
MANIFEST = "path string, n_docs long, n_tokens long, first_id long, part int"


# ---------------------------------------------------------------- planes


def to_planes(ids: np.ndarray) -> tuple[str, list[bytes]]:
    """The block's planes, lowest first: bits where up to 12 are in use, else bytes; empty high planes are left out."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if top > 12:
        return "byte", [np.ascontiguousarray(raw[:, i]).tobytes() for i in range((top + 7) // 8)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return "bit", [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(top)]


def from_planes(kind: str, planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for i, p in enumerate(planes):
            out[:, i] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for i, p in enumerate(planes):
            bits[:, i] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        out = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(out).view("<u4").ravel()


class Writer:
    """Writes one file block by block; what is held is one block and the footer."""

    def __init__(self, out):
        self.out, self.at, self.held, self.size = out, 0, [], 0
        self.index: list[dict] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.press = zstandard.ZstdCompressor(level=3)

    def add(self, docs: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
        """Documents in order, with the ids of all of them."""
        self.docs += docs
        self.lengths += lengths
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BLOCK:
            whole = np.concatenate(self.held)
            cut = self.size - self.size % BLOCK
            for i in range(0, cut, BLOCK):
                self._block(whole[i : i + BLOCK])
            self.held, self.size = [whole[cut:].copy()], self.size - cut

    def _block(self, ids: np.ndarray) -> None:
        kind, planes = to_planes(ids)
        packed = [self.press.compress(p) for p in planes]
        self.index.append({"at": self.at, "n": len(ids), "kind": kind, "sizes": [len(p) for p in packed]})
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> int:
        """Total ids written."""
        if self.size:
            self._block(np.concatenate(self.held))
        footer = self.press.compress(json.dumps({"block": BLOCK, "chunks": self.index, "docs": self.docs, "lengths": self.lengths}).encode())
        self.out.write(footer + struct.pack("<I", len(footer)) + MAGIC)
        return sum(self.lengths)


def read_footer(file) -> dict:
    end = file.size()
    file.seek(end - len(MAGIC) - 4)
    tail = file.read()
    if tail[4:] != MAGIC:
        raise ValueError("not a bit-plane file")
    (n,) = struct.unpack("<I", tail[:4])
    file.seek(end - len(MAGIC) - 4 - n)
    return json.loads(zstandard.ZstdDecompressor().decompress(file.read(n)))


def read_ids(file) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document, ids) of a file in order, one block in memory at a time (and a document's ids)."""
    foot, press = read_footer(file), zstandard.ZstdDecompressor()
    chunks, held = iter(foot["chunks"]), np.empty(0, np.uint32)
    for doc, n in zip(foot["docs"], foot["lengths"], strict=True):
        parts, size = [held], len(held)
        while size < n:
            c = next(chunks)
            file.seek(c["at"])
            part = from_planes(c["kind"], [press.decompress(file.read(k)) for k in c["sizes"]], c["n"])
            parts.append(part)
            size += len(part)
        whole = np.concatenate(parts) if len(parts) > 1 else held
        yield doc, whole[:n]
        held = whole[n:]


# ---------------------------------------------------------------- tokens

#: Marks at a word's end that the vocabulary's pre-tokeniser sets apart after a letter or digit.
MARKS = ".,;:!?|%&$#*"


class Tokens:
    """Ids of whole texts by a ``tokenizers`` file that lower-cases and whose words never reach over white space.

    The library encodes each distinct stretch between ASCII blanks once; a stretch of
    ASCII is lower-cased and split before its closing marks too.  Many stretches go to
    the library as one text, with an added token of the vocabulary between them.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode_batch_fast
        added = tokenizer.get_added_tokens_decoder()
        self.gap_id, self.gap = next(((i, t.content) for i, t in sorted(added.items())), (None, None))
        self.known = WordRows(most)

    def _encode(self, words: list[str]) -> None:
        """Ask the library for the ids of the words."""
        odd = words if self.gap is None else [w for w in words if "<" in w]  # a word may hold an added token itself
        for w, e in zip(odd, self.encode(odd, add_special_tokens=False), strict=True):
            self.known.append([w], np.array([len(e.ids)]), np.array(e.ids, np.int32))
        plain = [] if self.gap is None else [w for w in words if "<" not in w]
        lines = [plain[i : i + 512] for i in range(0, len(plain), 512)]
        for i in range(0, len(lines), 16):
            part = lines[i : i + 16]
            for own, e in zip(part, self.encode([self.gap.join(ws) for ws in part], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.int32)
                at = np.flatnonzero(ids == self.gap_id)
                if len(at) != len(own) - 1:
                    raise ValueError("the added token did not part the words")
                self.known.append(own, np.diff(at, prepend=-1, append=len(ids)) - 1, np.delete(ids, at))

    def _learn(self, words: list[str]) -> None:
        """Rows for words that have none."""
        known, cased, split, parts = self.known, {}, [], set()
        for w in words:
            if not w.isascii():
                parts.add(w)
                continue
            head = w.rstrip(MARKS)
            if len(head) < len(w) and head[-1:].isalnum():
                a, b = head.lower(), w[len(head) :]
                split.append((w, a, b))
                parts.add(a)
                parts.add(b)
            else:
                a = w if "<" in w else w.lower()
                parts.add(a)
                if a != w:
                    cased[w] = a
        self._encode(list(parts.difference(known.row)))
        row = known.row
        row.update({w: row[a] for w, a in cased.items()})
        if split:
            two = np.array([(row[a], row[b]) for _, a, b in split])
            known.append([w for w, _, _ in split], known.size[two].sum(axis=1), known.ids(two.ravel()))

    def __call__(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, the number of each text's ids); every text ends with ``end_id``."""
        known = self.known
        known.shrink()
        words = pc.ascii_split_whitespace(column)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([w for w in distinct if w not in known.row])
        end = known.n
        known.append([None], np.ones(1, np.int64), np.array([end_id], np.int32))
        rows = known.rows(distinct)[coded.indices.to_numpy()]
        ends = np.cumsum(pc.list_value_length(words).to_numpy())
        rows = np.insert(rows, ends, end)
        total = np.cumsum(known.size[rows])
        return known.ids(rows).view(np.uint32), np.diff(total[ends + np.arange(len(ends))], prepend=0)


@functools.cache
def tokens_of(path: str) -> Tokens:
    """One for each vocabulary in a Python worker, which serves many tasks."""
    return Tokens(path)


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, writer, out, tokens, first = f"{uuid.uuid4().hex}.qmbp", None, None, None, None
        for part in steps(batches, "text"):
            if writer is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}")
                writer, tokens = Writer(out), tokens_of(tokenizer)
                first, number = part.column("doc_id")[0].as_py(), part.column("part")[0].as_py()
            ids, lengths = tokens(pc.fill_null(part.column("text"), ""), end_id)
            writer.add(part.column("doc_id").to_pylist(), lengths.tolist(), ids)
        if writer is not None:
            n = writer.close()
            out.close()
            rows = [[f"{folder}/{name}"], [len(writer.docs)], [n], [first], [number]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], names=["path", "n_docs", "n_tokens", "first_id", "part"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every text as files; the manifest (path, n_docs, n_tokens, first_id, part, base).

    ``tokenizer`` is the path of a vocabulary file on every machine.  Documents are
    in ascending id order over the files (nulls first; equal ids in order of their
    texts), each followed by ``end_id``; a null text counts as empty.  ``base`` is the
    number of ids in the files before.  An empty table writes no file.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    numbered = dealt.withColumn("part", F.spark_partition_id())
    manifest = materialise(numbered.mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all documents, read from the files of a manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["path", "base"]).to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                held, size, at = [], 0, row["base"]
                with store.open_input_file(path) as file:
                    for doc, ids in read_ids(file):
                        held.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids))
                        at, size = at + len(ids), size + len(ids)
                        if size > 1 << 20:
                            yield _documents(held)
                            held, size = [], 0
                if held:
                    yield _documents(held)

    files = manifest.select("path", "base").repartition(max(1, manifest.count()))  # a file a task
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    doc, at, n, crc, ids = zip(*rows, strict=True)
    ends = np.cumsum([0, *n])
    column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), column], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
