"""Byte builders for tests: plaintext containers with no key material."""

from __future__ import annotations

import hashlib
import struct

from lithospark.constants import BLOCK, PKG_MAGIC
from lithospark.functions.blocks import deflate_block


def sfo(values: dict) -> bytes:
    keys, names, data, table = 0x14 + 16 * len(values), b"", b"", b""
    for k, v in values.items():
        body = struct.pack("<i", v) if isinstance(v, int) else v.encode() + b"\0"
        table += struct.pack("<2H3I", len(names), 0x0404 if isinstance(v, int) else 0x0204, len(body), len(body) + 4, len(data))
        names += k.encode() + b"\0"
        data += body + bytes(4)
    start = -(-(keys + len(names)) // 4) * 4
    return (b"\0PSF" + struct.pack("<4I", 0x101, keys, start, len(values)) + table + names).ljust(start, b"\0") + data


def package(entries: list[tuple], names: dict[int, str], content_id: str = "EP0001-CUSA00001_00-TEST000000000000", content_type: int = 0x1A, image: bytes = b"") -> bytes:
    """entries: (id, payload, flags1, flags2); a name table entry 0x200 is added last."""
    table, spots = b"\0", {}
    for number, name in names.items():
        spots[number] = len(table)
        table += name.encode() + b"\0"
    rows = [*entries, (0x200, table, 0, 0)]
    at = 0x2000
    records, body = b"", b""
    for number, payload, flags1, flags2 in rows:
        records += struct.pack(">6I8x", number, spots.get(number, 0), flags1, flags2, at + len(body), len(payload))
        body += payload + bytes(-len(payload) % 16)
    head = bytearray(0x1000)
    struct.pack_into(">II", head, 0, PKG_MAGIC, 1 << 31)
    struct.pack_into(">IHHII", head, 0x10, len(rows), 6, len(rows), 0x1000, len(body))
    start = -(-(at + len(body)) // 0x80000) * 0x80000
    head[0x40 : 0x40 + len(content_id)] = content_id.encode()
    struct.pack_into(">II", head, 0x70, 15, content_type)
    struct.pack_into(">QQ", head, 0x410, start, len(image))
    whole = bytearray((bytes(head) + records).ljust(at, b"\0") + body).ljust(start, b"\0") + image
    by_id = {r[0]: r[1] for r in rows}
    chain = lambda ids, short=False: hashlib.sha256(b"".join(by_id.get(i, b"")[: 192 if short and i == 0x100 else None] for i in ids)).digest()
    whole[0x100:0x120] = chain([0x10, 0x20, 0x80, 0x100, 0x1])
    whole[0x120:0x140] = chain([0x10, 0x20, 0x80, 0x100], True)
    whole[0x140:0x160] = chain([0x1])
    whole[0x160:0x180] = hashlib.sha256(whole[0x2000:start]).digest()
    whole[0x440:0x460] = hashlib.sha256(image).digest()
    whole[0x460:0x480] = hashlib.sha256(image[:BLOCK]).digest()
    whole[0xFE0:0x1000] = hashlib.sha256(whole[:0xFE0]).digest()
    return bytes(whole)


def minimal_package(**more) -> bytes:
    meta = sfo({"TITLE": "A game", "TITLE_ID": "CUSA00001", "CATEGORY": "gd", "APP_VER": "01.00", "ATTRIBUTE": 7})
    entries = [(0x1, b"d" * 64, 0, 0), (0x10, b"k" * 32, 0, 0), (0x20, b"i" * 32, 0, 0), (0x80, b"g" * 32, 0, 0), (0x100, b"m" * 300, 0, 0), (0x1000, meta, 0, 0), (0x1200, b"png", 0, 0), (0x2345, b"other", 0, 0), (0x402, b"e" * 20, 1 << 31, 3 << 12)]
    return package(entries, {0x1000: "param.sfo"}, **more)


def dirent(inode: int, kind: int, name: str) -> bytes:
    size = -(-(len(name) + 17) // 8) * 8
    return (struct.pack("<I3i", inode, kind, len(name), size) + name.encode()).ljust(size, b"\0")


def image(files: dict[int, bytes], directories: dict[int, list[tuple[int, int, str]]]) -> bytes:
    """An inner image of plain inodes 0..n; directories hold (inode, type, name) records."""
    n = max([*files, *directories]) + 1
    per = BLOCK // 0xA8
    first = 1 + -(-n // per)
    blocks, inodes = [], []
    for k in range(n):
        data = files.get(k, b"") if k in files else b"".join(dirent(*r) for r in directories.get(k, []))
        count = max(1, -(-len(data) // BLOCK))
        start = first + len(blocks)
        blocks += [data[i * BLOCK : (i + 1) * BLOCK].ljust(BLOCK, b"\0") for i in range(count)]
        direct = [start] + [-1] * 11 if count > 1 else [start] + [0] * 11
        inodes.append(struct.pack("<2HI2q", 0x4000 if k in directories else 0x8000, 1, 0, len(data), len(data)).ljust(96, b"\0") + struct.pack("<I17i", count, *direct, *[0] * 5))
    table = b""
    for a in range(0, n, per):
        table += b"".join(i.ljust(0xA8, b"\0") for i in inodes[a : a + per]).ljust(BLOCK, b"\0")
    head = struct.pack("<3q4B2H2I4q", 1, 20130315, 0, 0, 0, 1, 0, 8, 0, BLOCK, 0, first + len(blocks), n, len(blocks), first - 1)
    return head.ljust(BLOCK, b"\0") + table + b"".join(blocks)


def container(content: bytes, raw: set[int] = frozenset(), block: int = BLOCK) -> bytes:
    n = -(-len(content) // block)
    parts = []
    for k in range(n):
        data = content[k * block : (k + 1) * block].ljust(block, b"\0")
        parts.append(data if k in raw else deflate_block(data) or data)
    table, at = [], BLOCK
    for p in parts:
        table.append(at)
        at += len(p)
    head = b"PFSC" + struct.pack("<5I3Q", 0, 6, block, BLOCK, 0, 0x400, BLOCK, n * block)
    return (head.ljust(0x400, b"\0") + struct.pack(f"<{n + 1}Q", *table, at)).ljust(BLOCK, b"\0") + b"".join(parts)


def audio(loop: tuple[int, int] | None = None) -> bytes:
    form = struct.pack("<HhiihH", 0xFFFE, 2, 48000, 24000, 192, 16) + struct.pack("<HHI", 34, 16, 3) + bytes(16) + struct.pack("<i", 1) + b"\xfe\x00\x10\x00" + bytes(4)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<I3i", 12, 5000, 0, 256)
    if loop:
        chunks += b"smpl" + struct.pack("<I", 60) + bytes(44) + struct.pack("<2i", *loop) + bytes(8)
    chunks += b"data" + struct.pack("<I", 192 * 5) + bytes(192 * 5)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks
