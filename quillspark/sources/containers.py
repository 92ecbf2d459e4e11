"""Archives and media: members, metadata segments and cleaned bytes, by Arrow batches of files (path, content).

Each file is parsed by itself with caps, so one bad file becomes an error row and never stops a task. Nothing here can be
stated as column expressions; what can (formats by signature) is in operators.metadata.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.functions import rules

MEMBERS = "path string, member string, data binary, size long, error string"
SEGMENTS = "path string, format string, segment string, data binary, error string"
_MEMBER_SCHEMA = pa.schema([("path", pa.string()), ("member", pa.string()), ("data", pa.binary()), ("size", pa.int64()), ("error", pa.string())])
_SEGMENT_SCHEMA = pa.schema([("path", pa.string()), ("format", pa.string()), ("segment", pa.string()), ("data", pa.binary()), ("error", pa.string())])


class Refused(ValueError):
    """A file that is not read further; its text is the error code."""


def unsafe_name(name: str) -> bool:
    flat = name.replace("\\", "/")
    return not name or "\0" in name or flat.startswith("/") or bool(re.match("^[A-Za-z]:", flat)) or ".." in flat.split("/")


def zip_members(content: bytes, limits: dict = rules.LIMITS) -> list[tuple[str, bytes | None, int]]:
    """(name, data, size) of each entry; data is null for methods other than stored and deflated. Unsafe archives are refused."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, struct.error, ValueError, NotImplementedError) as e:
        raise Refused("archive_malformed") from e
    infos = archive.infolist()
    if len(infos) > limits["entries"]:
        raise Refused("archive_entry_limit")
    seen, spans, total, out = set(), [], 0, []
    for i in infos:
        key = i.filename.replace("\\", "/").casefold()
        if unsafe_name(i.orig_filename) or "\\" in i.orig_filename:
            raise Refused("archive_unsafe_name")
        if key in seen:
            raise Refused("archive_duplicate_name")
        seen.add(key)
        if i.flag_bits & 1:
            raise Refused("archive_encrypted")
        if (i.external_attr >> 16) & 0o170000 == 0o120000:
            raise Refused("archive_symlink")
        total += i.file_size
        if total > limits["expanded"]:
            raise Refused("archive_expansion_limit")
        if i.file_size > limits["ratio"] * max(1, i.compress_size):
            raise Refused("archive_ratio_limit")
        spans.append((i.header_offset, i.header_offset + 30 + i.compress_size))
        if i.is_dir():
            continue
        if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            out.append((i.filename, None, i.file_size))
            continue
        try:
            with archive.open(i) as f:
                data = f.read(i.file_size + 1)
        except (zipfile.BadZipFile, zlib.error, EOFError, struct.error) as e:
            raise Refused("archive_member_damaged") from e
        if len(data) != i.file_size:
            raise Refused("archive_size_mismatch")
        out.append((i.filename, data, i.file_size))
    spans.sort()
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:])):
        raise Refused("archive_overlap")
    return out


def zip_kind(members: dict[str, bytes | None]) -> str:
    """xlsx, pptx, docx, odt, epub or zip, by the members."""
    mime = (members.get("mimetype") or b"").strip()
    for name, kind in (("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"), ("word/document.xml", "docx")):
        if name in members:
            return kind
    if mime == b"application/epub+zip" or "META-INF/container.xml" in members:
        return "epub"
    if mime == b"application/vnd.oasis.opendocument.text" or {"content.xml", "meta.xml"} <= members.keys():
        return "odt"
    return "zip"


def metadata_member(kind: str, name: str) -> bool:
    """Whether a member holds metadata of its archive."""
    if kind in ("docx", "xlsx", "pptx"):
        return name.startswith("docProps/") and name.endswith(".xml")
    return name == "meta.xml" if kind == "odt" else name.endswith(".opf") if kind == "epub" else False


def png_chunks(content: bytes) -> Iterator[tuple[str, bytes, int, int]]:
    """(kind, data, from, to) of each chunk; the checksum must hold."""
    at = 8
    while at < len(content):
        if at + 12 > len(content):
            raise Refused("png_malformed")
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        data, end = content[at + 8 : at + 8 + n], at + 12 + n
        if end > len(content) or struct.unpack(">I", content[end - 4 : end])[0] != zlib.crc32(kind + data):
            raise Refused("png_malformed")
        yield kind.decode("latin-1"), data, at, end
        at = end
        if kind == b"IEND":
            return


def riff_chunks(content: bytes) -> Iterator[tuple[str, bytes, int, int]]:
    at = 12
    while at + 8 <= len(content):
        kind, n = struct.unpack("<4sI", content[at : at + 8])
        end = at + 8 + n + (n & 1)
        if at + 8 + n > len(content):
            raise Refused("webp_malformed")
        yield kind.decode("latin-1"), content[at + 8 : at + 8 + n], at, end
        at = end


def jpeg_segments(content: bytes) -> Iterator[tuple[int, bytes, int, int]]:
    """(marker, data, from, to) of the segments before the image data."""
    at = 2
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            raise Refused("jpeg_malformed")
        marker = content[at + 1]
        if marker in (0xD9, 0xDA):
            return
        n = struct.unpack(">H", content[at + 2 : at + 4])[0]
        if n < 2 or at + 2 + n > len(content):
            raise Refused("jpeg_malformed")
        yield marker, content[at + 4 : at + 2 + n], at, at + 2 + n
        at += 2 + n


def gif_comments(content: bytes) -> Iterator[bytes]:
    def table(flags):
        return 3 * (2 << (flags & 7)) if flags & 0x80 else 0

    def blocks(at):
        out = b""
        while at < len(content) and content[at]:
            out += content[at + 1 : at + 1 + content[at]]
            at += 1 + content[at]
        return out, at + 1

    if len(content) < 13:
        raise Refused("gif_malformed")
    at = 13 + table(content[10])
    while at < len(content) and content[at] != 0x3B:
        if content[at] == 0x21 and at + 1 < len(content):
            label = content[at + 1]
            data, at = blocks(at + 2)
            if label == 0xFE:
                yield data
        elif content[at] == 0x2C and at + 10 < len(content):
            _, at = blocks(at + 11 + table(content[at + 9]))
        else:
            raise Refused("gif_malformed")


def iso_boxes(content: bytes) -> Iterator[tuple[str, bytes]]:
    at = 0
    while at + 8 <= len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        head = 8
        if n == 1 and at + 16 <= len(content):
            n, head = struct.unpack(">Q", content[at + 8 : at + 16])[0], 16
        n = n or len(content) - at
        if n < head or at + n > len(content):
            raise Refused("iso_malformed")
        yield kind.decode("latin-1"), content[at + head : at + n]
        at += n


TIFF_TAGS = [270, 305, 315, 316, 33432, 37510, 700]


def tiff_tags(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Metadata tags of all directories of a TIFF (not BigTIFF)."""
    order = "<" if content[:2] == b"II" else ">"
    at, seen = struct.unpack(f"{order}I", content[4:8])[0], set()
    size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    while at:
        if at in seen or at + 2 > len(content):
            raise Refused("tiff_malformed")
        seen.add(at)
        n = struct.unpack(f"{order}H", content[at : at + 2])[0]
        if at + 6 + 12 * n > len(content):
            raise Refused("tiff_malformed")
        for k in range(n):
            e = at + 2 + 12 * k
            tag, kind, count = struct.unpack(f"{order}HHI", content[e : e + 8])
            length = size.get(kind, 1) * count
            start = e + 8 if length <= 4 else struct.unpack(f"{order}I", content[e + 8 : e + 12])[0]
            if start + length > len(content):
                raise Refused("tiff_malformed")
            if tag in TIFF_TAGS:
                yield tag, content[start : start + length]
        at = struct.unpack(f"{order}I", content[at + 2 + 12 * n : at + 6 + 12 * n])[0]


def media_format(content: bytes) -> str:
    brands = content[8:64]
    for test, kind in (
        (content[:8] == b"\x89PNG\r\n\x1a\n", "png"), (content[:3] == b"\xff\xd8\xff", "jpeg"), (content[:4] == b"RIFF" and content[8:12] == b"WEBP", "webp"), (content[4:8] == b"ftyp" and (b"avif" in brands or b"avis" in brands), "avif"),
        (content[4:8] == b"ftyp" and any(b in brands for b in (b"heic", b"heix", b"mif1", b"msf1")), "heic"), (content[:6] in (b"GIF87a", b"GIF89a"), "gif"), (content[:4] in (b"II*\0", b"MM\0*"), "tiff"), (content[:2] == b"PK", "zip"),
    ):
        if test:
            return kind
    return "other"


def segments(content: bytes) -> list[tuple[str, bytes]]:
    """(segment, data) of the metadata that a media file holds."""
    kind = media_format(content)
    if kind == "png":
        return [(k, d) for k, d, *_ in png_chunks(content) if k in ("tEXt", "iTXt", "zTXt", "eXIf", "caBX")]
    if kind == "webp":
        return [(k.strip(), d) for k, d, *_ in riff_chunks(content) if k.strip() in ("XMP", "EXIF", "C2PA")]
    if kind == "jpeg":
        return [(f"APP{m - 0xE0}", d) for m, d, *_ in jpeg_segments(content) if 0xE0 <= m <= 0xEF]
    if kind == "gif":
        return [("comment", d) for d in gif_comments(content)]
    if kind in ("avif", "heic"):
        return [(k, d) for k, d in iso_boxes(content) if k in ("meta", "uuid", "Exif", "mime", "jumb")]
    if kind == "tiff":
        return [(f"tag{t}", d) for t, d in tiff_tags(content)]
    return []


def _protected(text: str) -> bool:
    return bool(re.search(rules.PROTECTED_VALUE, text, re.I))


def clean_media(content: bytes) -> tuple[bytes, int]:
    """Bytes without embedded manifests and tool fields, and how many parts went; pixels, profiles and protected values stay. Formats that are never rewritten come back as they are."""
    kind = media_format(content)
    gone: list[tuple[int, int]] = []
    if kind == "png":
        for k, d, a, b in png_chunks(content):
            key, _, value = d.partition(b"\0")
            if k == "caBX" or k == "tEXt" and re.fullmatch(rules.ORDINARY_TOOL, key.decode("latin-1"), re.I) and not _protected(value.decode("latin-1")):
                gone.append((a, b))
    elif kind == "webp":
        gone = [(a, b) for k, _, a, b in riff_chunks(content) if k.strip() == "C2PA"]
    elif kind == "jpeg":
        for m, d, a, b in jpeg_segments(content):
            comment = d.decode("latin-1")
            if m == 0xEB and re.search(rb"c2pa|jumb", d, re.I) or m == 0xFE and re.match(rf"^\s*{rules.ORDINARY_TOOL}\s*[:=]", comment, re.I) and not _protected(comment):
                gone.append((a, b))
    if not gone:
        return content, 0
    out, at = b"", 0
    for a, b in gone:
        out, at = out + content[at:a], b
    out += content[at:]
    if kind == "webp":
        out = out[:4] + struct.pack("<I", len(out) - 8) + out[8:]
    return out, len(gone)


def _each(batches: Iterator[pa.RecordBatch], make, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = content.as_buffer()
            rows = make(path, raw.to_pybytes() if raw else b"")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def _members(path: str, content: bytes) -> list[tuple]:
    try:
        return [(path, n, d, s, None if d is not None else "archive_compression_unsupported") for n, d, s in zip_members(content)]
    except Refused as e:
        return [(path, None, None, None, str(e))]


def _segments(path: str, content: bytes) -> list[tuple]:
    kind = media_format(content)
    try:
        return [(path, kind, s, d, None) for s, d in segments(content)]
    except (Refused, struct.error) as e:
        return [(path, kind, None, None, str(e) if isinstance(e, Refused) else f"{kind}_malformed")]


def read_members(files: DataFrame) -> DataFrame:
    """Members of the archives among files (path, content); a refused archive is one row with its error."""
    return files.select("path", "content").mapInArrow(lambda b: _each(b, _members, _MEMBER_SCHEMA), MEMBERS)


def read_segments(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInArrow(lambda b: _each(b, _segments, _SEGMENT_SCHEMA), SEGMENTS)


def cleaned(files: DataFrame) -> DataFrame:
    """path, content, removed, error: media without manifests and tool fields."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("removed", pa.int32()), ("error", pa.string())])

    def make(path, content):
        try:
            return [(path, *clean_media(content), None)]
        except (Refused, struct.error) as e:
            return [(path, content, 0, str(e))]

    return files.select("path", "content").mapInArrow(lambda b: _each(b, make, schema), "path string, content binary, removed int, error string")
