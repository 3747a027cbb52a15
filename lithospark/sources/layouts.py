"""Binary layouts as rows.

A reader is any callable (offset, length) -> bytes, so nothing needs a whole
file. Every generator checks bounds and raises ValueError on damage.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from lithospark.constants import (
    BLOCK, INODE_SIZE, PFS_MAGIC, PFSC_MAGIC, PKG_MAGIC, SFO_FORMATS, SFO_MAGIC, SIGNED_INODE_SIZE, TRP_MAGIC, WIDE_SIGNED_INODE_SIZE,
)
from lithospark.functions.blocks import inflate_block

Read = Callable[[int, int], bytes]

# Fields of the package header, big-endian: name, offset, format.
HEADER_FIELDS = [
    ("magic", 0x00, ">I"),
    ("flags", 0x04, ">I"),
    ("entry_count", 0x10, ">I"),
    ("sc_entry_count", 0x14, ">H"),
    ("entry_count_2", 0x16, ">H"),
    ("entry_table_offset", 0x18, ">I"),
    ("main_entry_data_size", 0x1C, ">I"),
    ("body_offset", 0x20, ">Q"),
    ("body_size", 0x28, ">Q"),
    ("drm_type", 0x70, ">I"),
    ("content_type", 0x74, ">I"),
    ("content_flags", 0x78, ">I"),
    ("promote_size", 0x7C, ">I"),
    ("version_date", 0x80, ">I"),
    ("version_hash", 0x84, ">I"),
    ("iro_tag", 0x98, ">I"),
    ("ekc_version", 0x9C, ">I"),
    ("pfs_image_count", 0x404, ">I"),
    ("pfs_flags", 0x408, ">Q"),
    ("pfs_image_offset", 0x410, ">Q"),
    ("pfs_image_size", 0x418, ">Q"),
    ("mount_image_offset", 0x420, ">Q"),
    ("mount_image_size", 0x428, ">Q"),
    ("package_size", 0x430, ">Q"),
    ("pfs_signed_size", 0x438, ">I"),
    ("pfs_cache_size", 0x43C, ">I"),
    ("split_size_0", 0x480, ">Q"),
    ("split_size_1", 0x488, ">Q"),
]
# Digests of the package header, 32 bytes each.
HEADER_DIGESTS = [
    ("entries_digest_1", 0x100),
    ("entries_digest_2", 0x120),
    ("table_digest", 0x140),
    ("body_digest", 0x160),
    ("image_digest", 0x440),
    ("signed_digest", 0x460),
    ("header_digest", 0xFE0),
]
LIMIT = 2**63


def exact(read: Read, offset: int, length: int, what: str) -> bytes:
    data = read(offset, length)
    if len(data) < length:
        raise ValueError(f"{what} ends beyond the file")
    return data


def text_at(data: bytes, offset: int = 0, length: int | None = None) -> str:
    """The text up to its end byte. Bytes beyond ASCII stay, as Latin-1."""
    part = data[offset:] if length is None else data[offset : offset + length]
    return part.split(b"\0", 1)[0].decode("latin-1")


def package_header(read: Read, size: int) -> dict:
    data = exact(read, 0, 0x1000, "header")
    row = {name: struct.unpack_from(form, data, at)[0] for name, at, form in HEADER_FIELDS}
    if row["magic"] != PKG_MAGIC:
        raise ValueError("not a package: bad magic")
    if big := [k for k, v in row.items() if v >= LIMIT]:
        raise ValueError(f"{big[0]} is out of range")
    row |= {name: data[at : at + 32] for name, at in HEADER_DIGESTS}
    return row | {"content_id": text_at(data, 0x40, 48), "is_finalized": bool(row["flags"] >> 31), "file_size": size}


def package_entries(read: Read, size: int) -> Iterator[dict]:
    head = package_header(read, size)
    at, n = head["entry_table_offset"], head["entry_count"]
    if at + n * 32 > size:
        raise ValueError("entry table ends beyond the file")
    table = exact(read, at, n * 32, "entry table")
    for k in range(n):
        number, name, flags1, flags2, offset, length = struct.unpack_from(">6I", table, k * 32)
        yield {
            "ordinal": k, "id": number, "name_offset": name, "flags1": flags1, "flags2": flags2, "data_offset": offset, "data_size": length,
            "is_encrypted": bool(flags1 >> 31), "key_index": flags2 >> 12 & 15, "file_size": size, "raw": table[k * 32 : k * 32 + 32],
        }


def package_names(read: Read, size: int) -> Iterator[dict]:
    """Names with their offsets; the table ends at the first empty name after its first byte."""
    table = next((e for e in package_entries(read, size) if e["id"] == 0x200), None)
    if table is None:
        return
    data = exact(read, table["data_offset"], table["data_size"], "name table")
    at, k = 1, 0
    while at < len(data):
        name = text_at(data, at)
        if not name:
            break
        yield {"ordinal": k, "offset": at, "name": name}
        at, k = at + len(name) + 1, k + 1


def entry_payloads(read: Read, size: int) -> Iterator[dict]:
    """The stored bytes of each entry in bounds; encrypted ones are named, without content."""
    for e in package_entries(read, size):
        fits = e["data_offset"] + e["data_size"] <= size
        data = read(e["data_offset"], e["data_size"]) if fits and not e["is_encrypted"] else None
        yield {"ordinal": e["ordinal"], "id": e["id"], "is_encrypted": e["is_encrypted"], "in_bounds": fits, "data": data}


#: Bytes of a region that one row holds.
PIECE = 1 << 20


def payload_pieces(read: Read, size: int) -> Iterator[dict]:
    """Stored bytes of entries in bounds, PIECE by PIECE, so that no row holds a whole large entry."""
    for e in package_entries(read, size):
        if not e["is_encrypted"] and e["data_offset"] + e["data_size"] <= size:
            for at in range(0, e["data_size"], PIECE):
                yield {"ordinal": e["ordinal"], "id": e["id"], "offset": at, "data": read(e["data_offset"] + at, min(PIECE, e["data_size"] - at))}


def package_regions(read: Read, size: int) -> Iterator[dict]:
    """What the header's digests cover, in pieces: the header itself, the body before the image, the image, and its first block."""
    head = package_header(read, size)
    image, end = head["pfs_image_offset"], head["pfs_image_offset"] + head["pfs_image_size"]
    for name, first, last in (("header_digest", 0, 0xFE0), ("body_digest", 0x2000, image), ("image_digest", image, end), ("signed_digest", image, min(end, image + BLOCK))):
        for at in range(first, min(last, size), PIECE):
            yield {"region": name, "offset": at, "data": read(at, min(PIECE, last - at))}


def image_header(read: Read, size: int) -> dict:
    data = exact(read, 0, 0x400, "image header")
    version, magic, number = struct.unpack_from("<3q", data, 0)
    if magic != PFS_MAGIC:
        raise ValueError("not a file system image: bad magic")
    fmode, clean, read_only, rsv, mode, unk1, block_size, nbackup, nblock, inodes, ndblock, inode_blocks = struct.unpack_from("<4B2H2I4q", data, 0x18)
    return {
        "version": version, "magic": magic, "id": number, "fmode": fmode, "clean": clean, "read_only": read_only, "rsv": rsv, "mode": mode, "unk1": unk1, "block_size": block_size, "nbackup": nbackup,
        "nblock": nblock, "dinode_count": inodes, "ndblock": ndblock, "dinode_block_count": inode_blocks, "seed": data[0x370:0x380], "file_size": size,
    }


def image_inodes(read: Read, size: int) -> Iterator[dict]:
    """Inodes from block 1 on. Of 64-bit, signed and plain ones; none crosses the end of a block."""
    head = image_header(read, size)
    wide, signed = bool(head["mode"] & 2), bool(head["mode"] & 1)
    each = WIDE_SIGNED_INODE_SIZE if wide else SIGNED_INODE_SIZE if signed else INODE_SIZE
    per = BLOCK // each
    pointer, skip = ("q", 8) if wide else ("i", 4), 32 if signed else 0
    first = 104 if wide else 100
    for block in range(-(-head["dinode_count"] // per)):
        data = exact(read, (block + 1) * BLOCK, min(BLOCK, size - (block + 1) * BLOCK), "inode table")
        for k in range(min(per, head["dinode_count"] - block * per)):
            at = k * each
            if at + each > len(data):
                raise ValueError("inode table ends beyond the file")
            mode, links, flags, stored, whole = struct.unpack_from("<2HI2q", data, at)
            blocks = struct.unpack_from("<q" if wide else "<I", data, at + 96)[0]
            spots = [at + first + i * (skip + pointer[1]) + skip for i in range(17)]
            pointers = [struct.unpack_from("<" + pointer[0], data, s)[0] for s in spots]
            yield {"inode": block * per + k, "mode": mode, "nlink": links, "flags": flags, "size": stored, "size_uncompressed": whole, "blocks": blocks, "direct": pointers[:12], "indirect": pointers[12:], "raw": data[at : at + each]}


def inode_blocks(read: Read, inode: dict, signed: bool = False) -> Iterator[int]:
    """The blocks of a file: direct pointers, -1 standing for a run, then up to five levels of indirection."""
    left, direct = inode["blocks"], inode["direct"]
    last = None
    for k in range(min(12, left)):
        if direct[k] == -1 and last is not None:
            yield from range(last + 1, last + 1 + left)  # the rest lies in a run; clamped to the file's count
            return
        last = direct[k]
        yield last
        left -= 1
    entry = 36 if signed else 4

    def below(block: int, level: int) -> Iterator[int]:
        data = read(block * BLOCK, BLOCK)
        for k in range(BLOCK // entry):
            pointer = struct.unpack_from("<i", data, k * entry + entry - 4)[0] if (k + 1) * entry <= len(data) else 0
            if pointer <= 0:
                return
            yield from [pointer] if level == 0 else below(pointer, level - 1)

    for level in range(5):
        if left <= 0 or inode["indirect"][level] <= 0:
            return
        for block in below(inode["indirect"][level], level):
            if left <= 0:
                return
            yield block
            left -= 1


def image_blocks(read: Read, size: int) -> Iterator[dict]:
    signed = bool(image_header(read, size)["mode"] & 1)
    for inode in image_inodes(read, size):
        for k, block in enumerate(inode_blocks(read, inode, signed)):
            yield {"inode": inode["inode"], "ordinal": k, "block": block}


def read_inode(read: Read, inode: dict, signed: bool = False) -> Iterator[bytes]:
    left = inode["size"]
    for block in inode_blocks(read, inode, signed):
        if left <= 0:
            return
        yield read(block * BLOCK, min(BLOCK, left))
        left -= BLOCK


def image_dirents(read: Read, size: int) -> Iterator[dict]:
    """Records of every directory inode, in order. Records may cross blocks or leave a block's end empty."""
    signed = bool(image_header(read, size)["mode"] & 1)
    for inode in image_inodes(read, size):
        if not inode["mode"] & 0x4000:
            continue
        data, at, k = b"".join(read_inode(read, inode, signed)), 0, 0
        while at + 16 <= len(data):
            target, kind, length, entry = struct.unpack_from("<I3i", data, at)
            if entry == 0:
                at = (at // BLOCK + 1) * BLOCK  # the rest of this block is padding
                continue
            if not 17 <= entry <= 0x1000 or not 0 < length <= entry - 16:
                break
            yield {"parent": inode["inode"], "ordinal": k, "inode": target, "type": kind, "name_length": length, "entry_size": entry, "name": data[at + 16 : at + 16 + length].decode("latin-1")}
            at, k = at + entry, k + 1


def image_content(read: Read, size: int) -> Iterator[dict]:
    """The bytes of every file inode, block by block."""
    signed = bool(image_header(read, size)["mode"] & 1)
    for inode in image_inodes(read, size):
        if inode["mode"] and not inode["mode"] & 0x4000:
            for k, data in enumerate(read_inode(read, inode, signed)):
                yield {"inode": inode["inode"], "ordinal": k, "data": data}


def container_header(read: Read, size: int) -> dict:
    data = exact(read, 0, 0x30, "container header")
    unk1, unk2, block, alignment, unk3 = struct.unpack_from("<5I", data, 4)
    table, start, rounded = struct.unpack_from("<3Q", data, 0x18)
    if data[:4] != PFSC_MAGIC:
        raise ValueError("not a compressed container: bad magic")
    if max(table, start, rounded) >= LIMIT:
        raise ValueError("an offset is out of range")
    return {"magic": "PFSC", "unk1": unk1, "unk2": unk2, "block_size": block, "alignment": alignment, "unk3": unk3, "table_offset": table, "data_offset": start, "rounded_size": rounded, "file_size": size}


def container_table(read: Read, size: int, first: int = 0, last: int | None = None) -> Iterator[dict]:
    """(block_no, offset) for blocks first to last, and one more offset that ends them."""
    head = container_header(read, size)
    if head["block_size"] <= 0:
        raise ValueError("bad block size")
    n = head["rounded_size"] // head["block_size"]
    last = n if last is None else min(last, n)
    if first > last:
        return
    data = exact(read, head["table_offset"] + first * 8, (last - first + 1) * 8, "block table")
    for k, (offset,) in enumerate(struct.iter_unpack("<Q", data)):
        yield {"block_no": first + k, "offset": offset}


def container_blocks(read: Read, size: int, first: int = 0, last: int | None = None) -> Iterator[dict]:
    """Blocks with their stored size and content; null content for a damaged one."""
    block = container_header(read, size)["block_size"]
    before = None
    for row in container_table(read, size, first, last):
        if before is not None:
            stored = row["offset"] - before["offset"]
            fits = 0 <= stored <= block and row["offset"] <= size
            content = inflate_block(read(before["offset"], stored), block) if fits else None
            yield before | {"stored_size": stored, "content": content if content is not None and len(content) == block else None}
        before = row


def unwrapped(read: Read, size: int) -> tuple[Read, int]:
    """A reader of what a compressed container holds, by its magic; of the file itself where there is none.

    The last block read stays, as reads mostly follow each other.
    """
    if read(0, 4) != PFSC_MAGIC:
        return read, size
    head = container_header(read, size)
    block, held = head["block_size"], {}

    def content(k: int) -> bytes:
        if k not in held:
            row = next(container_blocks(read, size, k, k + 1), None)
            if row is None or row["content"] is None:
                raise ValueError(f"block {k} does not inflate")
            held.clear()
            held[k] = row["content"]
        return held[k]

    def inner(offset: int, length: int) -> bytes:
        out, end = [], min(offset + length, head["rounded_size"])
        while offset < end:
            k, at = divmod(offset, block)
            part = content(k)[at : at + end - offset]
            out.append(part)
            offset += len(part)
        return b"".join(out)

    return inner, head["rounded_size"]


def sfo_values(read: Read, size: int) -> Iterator[dict]:
    """Keys and values; nothing for other content. A value out of bounds is null."""
    data = read(0, size)
    if len(data) < 0x14 or data[:4] != SFO_MAGIC:
        return
    keys, values, n = struct.unpack_from("<3I", data, 8)
    if n > 4096 or keys + 16 > len(data):
        return
    for k in range(n):
        at = 0x14 + k * 16
        if at + 16 > len(data):
            return
        key, form, length, most, spot = struct.unpack_from("<2H3I", data, at)
        kind, body = SFO_FORMATS.get(form, "unknown"), data[values + spot : values + spot + length]
        whole = values + spot + length <= len(data)
        number = struct.unpack("<i", body[:4])[0] if whole and kind == "int32" and len(body) >= 4 else None
        text = body.split(b"\0", 1)[0].decode("utf-8", "replace") if whole and kind != "int32" else None
        name = data[keys + key :].split(b"\0", 1)[0].decode("utf-8", "replace") if keys + key < len(data) else ""
        yield {"ordinal": k, "key": name, "format": kind, "length": length, "max_length": most, "number": number, "text": text, "value": str(number) if number is not None else text, "data": body if whole else None}


def trophy_entries(read: Read, size: int) -> Iterator[dict]:
    head = exact(read, 0, 0x60, "archive header")
    magic, n = struct.unpack_from(">I", head, 0)[0], struct.unpack_from(">I", head, 0x10)[0]
    if magic != TRP_MAGIC:
        raise ValueError("not a trophy archive: bad magic")
    if not 1 <= n <= 4096:
        raise ValueError("bad number of trophy entries")
    table = exact(read, 0x60, n * 0x40, "trophy table")
    for k in range(n):
        offset, length = struct.unpack_from(">I", table, k * 64 + 0x24)[0], struct.unpack_from(">I", table, k * 64 + 0x2C)[0]
        if offset + length > size:
            raise ValueError("trophy entry ends beyond the file")
        yield {"ordinal": k, "name": text_at(table, k * 64, 32), "offset": offset, "size": length, "data": read(offset, length)}




def audio_metadata(read: Read, size: int) -> dict:
    """Chunks of a RIFF file as one row; of chunks of one kind the later counts."""
    head = exact(read, 0, 12, "RIFF header")
    if head[:4] != b"RIFF":
        raise ValueError("not a RIFF file")
    chunks, at = {}, 12
    while at + 8 <= size:
        kind, length = struct.unpack("<4sI", exact(read, at, 8, "chunk"))
        chunks[kind] = (at + 8, min(length, size - at - 8))
        at += 8 + length + (length & 1)
    row = dict.fromkeys(("format_tag", "channels", "sample_rate", "block_align", "config", "sample_count", "delay", "loop_start", "loop_end", "frames"))
    row |= {"form": head[8:12].decode("latin-1"), "has_fmt": b"fmt " in chunks, "has_fact": b"fact" in chunks, "has_data": b"data" in chunks}
    if (spot := chunks.get(b"fmt ")) and spot[1] >= 16:
        body = read(*spot)
        row["format_tag"], row["channels"], row["sample_rate"], _, row["block_align"], _ = struct.unpack_from("<HhiihH", body, 0)
        if row["format_tag"] == 0xFFFE and len(body) >= 48:
            row["config"] = body[44:48]
    if (spot := chunks.get(b"fact")) and spot[1] >= 4:
        words = struct.unpack(f"<{spot[1] // 4}i", read(spot[0], spot[1] // 4 * 4))
        row["sample_count"], row["delay"] = words[0], words[-1] if len(words) > 1 else 0
    if (spot := chunks.get(b"smpl")) and spot[1] >= 60:
        row["loop_start"], row["loop_end"] = struct.unpack_from("<2i", read(*spot), 44)
    if (spot := chunks.get(b"data")) and row["block_align"]:
        row["frames"] = spot[1] // row["block_align"]
    return row
