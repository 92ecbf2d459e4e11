"""Operator 5, token-ID output: binary shards of independent zstandard frames with a trailing seek table.

A shard file holds, in this order:
- frames, each an independent zstandard frame of the little-endian ids of whole documents (FRAME_BYTES or the first document over it);
- a skippable frame (magic 0x184D2A50) with the document index: per document doc_id, frame, first id in the frame, number of ids;
- a skippable frame (magic 0x184D2A5E) with the seek table: per frame its compressed size, decompressed size and the low
  32 bits of the XXH64 of its decompressed bytes, then the number of frames, a flag byte 0x80 (checksums are there) and
  the magic 0x8F92EAB1. This is zstandard's seekable format, so other readers of it can read the frames.
A reader takes the tail, then only the frames of the documents that it wants, and checks their checksums.

Documents are ranged by doc_id (ties by text), each range is tokenised and written by one task under a name of its own,
and the manifest, with one row per shard, names the files of the attempts that succeeded: a lost executor leaves at most a
file that no manifest names. Files are written and read by the folder's own file system, local or remote.

Encoding a text piece by piece: between two non-space characters a single space begins a new pre-token in byte-level
BPE, so a text may be split there. Each piece that a worker has not seen yet is cut into pre-tokens, new pre-tokens go to the
library's model in bulk, and the ids of both are kept in a bounded cache from which texts are put together; a full cache
forgets all but the half of them that were used most. A text in which
a piece is empty or has white space at an end, and one that holds the string of a special token (which the library by
default takes as that token), is encoded whole by the library, as is every text with a tokenizer of another kind.

Defined results: a null text is empty and still gets its end id; null ids come first; repeated rows each get a place;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import cut, new_path

END_ID = 2
FRAME_BYTES = 256 << 10
LEVEL = 3
#: Pieces that a worker keeps encoded before it forgets all but the half that it used most; pieces that are cut by a library at once, and pre-tokens that are encoded at once; bytes of texts at once.
CACHE, RUN, FEW, BATCH_BYTES = 250_000, 4096, 512, 4 << 20
#: The pre-tokens and the byte alphabet of byte-level BPE, as published with it; a character that was white space in older Unicode.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(0x100 + n) for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
OLD_SPACE = "\u180e"
OTHER_BYTES = re.compile("[\x01-\x20\x7f-\xa0\xad]")
#: Up to here character classes are the same in all versions of Unicode that the libraries carry; other pieces are encoded by the library alone.
PLAIN = "\u04ff"
#: Pieces that are cut into pre-tokens by kinds of characters alone: Latin letters, digits and marks without "'", lines inside; kinds by code point.
_MARKS = r"!-&(-~\x{a1}-\x{ac}\x{ae}-\x{17f}"
QUICK = rf"^[{_MARKS}]+(\n+[{_MARKS}]+)*$"
_LETTER, _NUMBER, _OTHER, _SPACE, _LINE = range(5)
_KINDS = np.array([_LINE if k == 10 else _SPACE if k == 32 else _LETTER if regex.match(r"\p{L}", chr(k)) else _NUMBER if regex.match(r"\p{N}", chr(k)) else _OTHER for k in range(0x180)], np.uint8)
INDEX_MAGIC, SEEK_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("first", "<u8"), ("n", "<u8")])
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Known(dict):
    """string -> its number, in the order in which strings were first asked for; new holds those whose ids are not there yet."""

    def __init__(self, kind: np.dtype) -> None:
        self.new: list[str] = []
        self.ids, self.used = np.empty(1 << 16, kind), 0
        self.first, self.size, self.uses = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, text: str) -> int:
        self[text] = k = len(self)
        self.new.append(text)
        return k

    def learn(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of the new strings, one after another; size -1: this string has none to use."""
        held = np.maximum(sizes, 0)
        self.first = np.concatenate([self.first, self.used + np.cumsum(held) - held])
        self.size = np.concatenate([self.size, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + 2 * len(ids), self.ids.dtype)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.new = []

    def put_together(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these strings, one after another, and where each string's ids end."""
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        sizes = np.maximum(self.size[numbers], 0)
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.first[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends

    def most_used(self, n: int) -> Known:
        """Only the n strings that were used most, with their ids; older uses count half."""
        out, names = Known(self.ids.dtype), list(self)
        held = np.sort(np.argsort(-self.uses, kind="stable")[:n])
        for k in held.tolist():
            out[names[k]] = len(out)
        sizes = self.size[held]
        some = np.maximum(sizes, 0)
        out.learn(self.ids[np.repeat(self.first[held] - np.cumsum(some) + some, some) + np.arange(some.sum())], sizes)
        out.uses = self.uses[held] // 2
        return out


class Encoder:
    """Ids of texts as bytes of little-endian 16- or 32-bit numbers."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tok, self.cache = Tokenizer.from_file(path), cache
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.marks = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        before, self.apart = self.tok.pre_tokenizer, self.tok.token_to_id(BYTE_CHARS[0])
        plain = self.tok.normalizer is None and self.tok.truncation is None and self.tok.padding is None and self.apart is not None
        self.by_piece = plain and isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space
        self.bare = Tokenizer(self.tok.model)  # for pre-tokens that are in the byte alphabet already, between spaces
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.parts = regex.compile(PRETOKEN)
        self.pieces, self.pretokens = Known(self.kind), Known(self.kind)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pretokens(self) -> None:
        new, ids, sizes = self.pretokens.new, [np.empty(0, self.kind)], [np.empty(0, np.int64)]
        for at in range(0, len(new), FEW):
            raw = "\0".join([*new[at : at + FEW], ""]).encode().decode("latin-1").replace(" ", BYTE_CHARS[32]).replace("\n", BYTE_CHARS[10])
            shown = OTHER_BYTES.sub(lambda m: BYTE_CHARS[ord(m[0])], raw).replace("\0", f" {BYTE_CHARS[0]} ")  # zero bytes, which no plain piece holds
            found = np.array(self.bare.encode_batch_fast([shown], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(found == self.apart)
            ids.append(found[found != self.apart])
            sizes.append(np.diff(ends, prepend=-1) - 1)
        self.pretokens.learn(np.concatenate(ids), np.concatenate(sizes))

    def _spaced(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of plain pieces, each behind a space: ids and how many each has."""
        numbers, starts = [], []
        for at in range(0, len(pieces), RUN):
            parts = self.parts.findall(f" {' '.join(pieces[at : at + RUN])}")
            starts += [len(numbers) + k for k, x in enumerate(parts) if x[0] == " "]
            numbers += map(self.pretokens.__getitem__, parts)
        self._learn_pretokens()
        ids, ends = self.pretokens.put_together(np.array(numbers, np.int64))
        return ids, np.diff(ends[np.array([*starts[1:], len(numbers)], np.int64) - 1], prepend=0)

    def _spaced_quick(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _spaced, of QUICK pieces: a pre-token begins at a space and where the kind changes, but for what follows the space, and at the last of several line ends."""
        text = f" {' '.join(pieces)}"
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = _KINDS[points]
        first = np.ones(len(kind), bool)
        first[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
        first[1:-1] |= (kind[1:-1] == _LINE) & (kind[:-2] == _LINE) & (kind[2:] != _LINE)
        at = np.flatnonzero(first)
        raw = text.encode()
        offsets = np.append(at + np.cumsum(points > 0x7F)[at] - (points[at] > 0x7F), len(raw)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        numbers = np.array(list(map(self.pretokens.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist())), np.int64)[coded.indices.to_numpy()]
        self._learn_pretokens()
        ids, ends = self.pretokens.put_together(numbers)
        starts = np.flatnonzero(kind[at] == _SPACE)
        return ids, np.diff(ends[np.append(starts[1:], len(at)) - 1], prepend=0)

    def _learn(self) -> None:
        """Pieces: None of them holds a space but a head, which begins with one and is encoded without it."""
        new = self.pieces.new
        quick = pc.match_substring_regex(pa.array(new, pa.large_string()), QUICK).to_numpy(zero_copy_only=False)
        sizes, kinds = np.full(len(new), -1, np.int64), ([], [], np.flatnonzero(quick).tolist())
        for k in np.flatnonzero(~quick).tolist():
            p = new[k]
            if p == " " or p.strip() == (p[1:] if p[:1] == " " else p) != "" and OLD_SPACE not in p:  # else a text may not be cut next to it
                kinds[p[0] != " " and (p.isascii() or max(p) <= PLAIN) and (p.isprintable() or p.replace("\n", "").isprintable())].append(k)
        found = [np.empty(0, self.kind), *self.whole([new[k][1:] if new[k][0] == " " else f" {new[k]}" for k in kinds[0]])]
        sizes[kinds[0]] = [len(x) for x in found[1:]]
        for own, spaced in ((kinds[1], self._spaced), (kinds[2], self._spaced_quick)):
            if own:
                ids, sizes[own] = spaced([new[k] for k in own])
                found.append(ids)
        order = np.concatenate([np.array(own, np.int64) for own in kinds])
        owner = np.repeat(order, np.maximum(sizes[order], 0))
        self.pieces.learn(np.concatenate(found)[np.argsort(owner, kind="stable")], sizes)

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if len(self.pieces) > self.cache:
            self.pieces = self.pieces.most_used(self.cache // 2)
        if len(self.pretokens) > self.cache:
            self.pretokens = self.pretokens.most_used(self.cache // 2)
        cut = np.full(len(texts), self.by_piece)
        for mark in self.marks:
            cut &= ~pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(cut)
        out: list[bytes | None] = [None] * len(texts)
        if len(at):
            split = pc.split_pattern(texts.take(pa.array(at)), " ")
            starts = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
            flat = split.flatten()
            counts = np.diff(starts, append=len(flat))
            coded = flat.dictionary_encode()
            number = self.pieces.__getitem__
            found = np.array(list(map(number, coded.dictionary.to_numpy(zero_copy_only=False).tolist())), np.int64)[coded.indices.to_numpy()]
            found[starts] = [number(f" {x}") for x in flat.take(pa.array(starts)).to_pylist()]
            if self.pieces.new:
                self._learn()
            good = np.minimum.reduceat(self.pieces.size[found], starts) >= 0
            ids, ends = self.pieces.put_together(found)
            last = ends[starts + counts - 1]
            for k, fine, a, b in zip(at.tolist(), good.tolist(), np.concatenate([[0], last[:-1]]).tolist(), last.tolist()):
                if fine:
                    out[k] = ids[a:b].tobytes()
        rest = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(rest, self.whole(texts.take(pa.array(rest, pa.int64())).to_pylist())):
            out[k] = ids.tobytes()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class ShardWriter:
    def __init__(self, out, width: int, frame_bytes: int = FRAME_BYTES) -> None:
        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.pack, self.docs, self.frames, self.now, self.held, self.total = zstandard.ZstdCompressor(level=LEVEL), [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(self.frames), self.held // self.width, len(ids) // self.width))
        self.now.append(ids)
        self.held += len(ids)
        self.total += len(ids) // self.width
        if self.held >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        raw = b"".join(self.now)
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.now, self.held = [], 0

    def close(self) -> None:
        if self.now:
            self._frame()
        self.out.write(_skippable(INDEX_MAGIC, np.array(self.docs, _INDEX).tobytes() + struct.pack("<B", self.width)))
        table = np.array(self.frames, _ENTRY).tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE_MAGIC)
        self.out.write(_skippable(SEEK_MAGIC, table))


class ShardReader:
    """Reads single documents of a shard: only their frames are fetched, decompressed and checked."""

    def __init__(self, file) -> None:
        self.file = file
        end = file.seek(0, 2)
        n, flags, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError("not a shard: no seek table with checksums at its end")
        table = end - 9 - n * _ENTRY.itemsize - 8
        self.frames = np.frombuffer(self._read(table + 8, n * _ENTRY.itemsize), _ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames["packed"].astype(np.int64))])
        magic, size = struct.unpack("<II", self._read(int(self.offsets[-1]), 8))
        body = self._read(int(self.offsets[-1]) + 8, size)
        self.width, self.docs = body[-1], np.frombuffer(body[:-1], _INDEX)
        self.unpack, self.last = zstandard.ZstdDecompressor(), (-1, b"")

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            packed, size, check = (int(x) for x in self.frames[k])
            raw = self.unpack.decompress(self._read(int(self.offsets[k]), packed), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, raw)
        return self.last[1]

    def ids(self, row: int) -> np.ndarray:
        d = self.docs[row]
        first, n = int(d["first"]) * self.width, int(d["n"]) * self.width
        return np.frombuffer(self.frame(int(d["frame"]))[first : first + n], f"<u{self.width}").astype("<u4")

    def rows(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.docs)):
            yield None if self.docs[k]["null"] else int(self.docs[k]["doc_id"]), self.ids(k)


def opened(path: str):
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, path, out, writer = TaskContext.get().partitionId(), "", None, None
        code = encoder(tokenizer)
        end = np.array([end_id], code.kind).tobytes()
        for batch in batches:
            column = batch.column(1).cast(pa.large_string()).fill_null("")
            bounds = pc.cumulative_sum(pc.binary_length(column)).to_numpy(zero_copy_only=False) // BATCH_BYTES
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(bounds)) + 1):
                if writer is None:
                    path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.ids.zst"
                    fs, name = pafs.FileSystem.from_uri(path)
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(name, compression=None)
                    writer = ShardWriter(out, code.kind.itemsize)
                for doc_id, found in zip(batch.column(0).slice(int(rows[0]), len(rows)).to_pylist(), code.encode(column.slice(int(rows[0]), len(rows)))):
                    writer.add(doc_id, found + end)
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.total], pa.int64())], ["part", "path", "docs", "ids"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write docs as shards in ascending doc_id order; the manifest: part, path, docs, ids, start (ids of all shards before)."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-shards")
    ranged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = cut(ranged.mapInArrow(_write(folder, tokenizer or default_tokenizer(), end_id), "part int, path string, docs long, ids long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return made.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = []
            with opened(path) as f:
                for doc_id, ids in ShardReader(f).rows():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files that the manifest names."""
    shards = max(1, manifest.count())  # a number of its own, else the few small rows would be put into one task
    return manifest.select("path", "start").repartition(shards, "path").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    return read_digests(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")))

