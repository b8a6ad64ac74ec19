"""Zip archives, also damaged ones."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

LOCAL = b"PK\x03\x04"
#: Most bytes one entry may unpack to.
MOST = 1 << 30


def inflate(raw: bytes) -> bytes:
    d = zlib.decompressobj(-15)
    out = d.decompress(raw, MOST)
    if d.unconsumed_tail:
        raise ValueError(f"an entry unpacks to more than {MOST} bytes")
    return out


def is_zip(head: bytes) -> bool:
    """Whether the first bytes are those of an archive, also of an empty or split one."""
    return head[:4] in (LOCAL, b"PK\x05\x06", b"PK\x07\x08")


def unpacked(body: bytes, how: int) -> bytes | ValueError:
    """An entry's content, or what stands in its way."""
    if how not in (0, 8):
        return ValueError(f"unknown compression {how}")
    try:
        return inflate(body) if how else body
    except ValueError as e:
        return e


def scan(data: bytes) -> dict[str, bytes | ValueError]:
    """Entries found by their local headers alone; damaged ones are left out, those too large or of an unknown compression hold the error."""
    out: dict[str, bytes | ValueError] = {}
    at = data.find(LOCAL)
    while at >= 0:
        nxt = data.find(LOCAL, at + 4)
        try:
            _, flags, how, _, _, _, packed, _, n_name, n_extra = struct.unpack_from("<HHHHHIIIHH", data, at + 4)
            begin = at + 30 + n_name + n_extra
            name = data[at + 30 : at + 30 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            end = begin + packed if packed and not flags & 8 else (nxt if nxt >= 0 else len(data))
            body = data[begin:end]
            if name and not name.endswith("/"):
                out.setdefault(name, unpacked(body, how))
        except (struct.error, UnicodeDecodeError, zlib.error):
            pass
        at = nxt
    return out


class Archive:
    """Names and contents. The directory is used where it is sound; an entry that fails there is looked for by its header."""

    def __init__(self, data: bytes):
        self.data, self.found = data, None
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            self.names = [i.filename for i in self.zip.infolist() if not i.is_dir()]
        except (zipfile.BadZipFile, NotImplementedError, ValueError, OSError):
            self.zip = None
            self.found = scan(data)
            self.names = list(self.found)

    def read(self, name: str) -> bytes | None:
        if self.zip is not None and self.found is None:
            try:
                if self.zip.getinfo(name).file_size > MOST:
                    raise ValueError(f"{name} unpacks to more than {MOST} bytes")
                return self.zip.read(name)
            except KeyError:
                return None
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, OSError, EOFError):
                self.found = scan(self.data)
        content = self.found.get(name) if self.found is not None else None
        if isinstance(content, ValueError):
            raise ValueError(f"{name}: {content}")
        return content

    def text(self, name: str) -> str | None:
        raw = self.read(name)
        return None if raw is None else decoded(raw)

    def comment(self) -> str:
        return self.zip.comment.decode("utf-8", "replace") if self.zip is not None else ""


def decoded(raw: bytes) -> str:
    """Text of XML or HTML bytes by byte-order mark or declaration, UTF-8 otherwise."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    head = raw[:200].lower()
    name = "utf-8-sig"
    if b"encoding=" in head:
        name = head.split(b"encoding=", 1)[1][1:40].split(b'"')[0].split(b"'")[0].decode("ascii", "replace")
    try:
        return raw.decode(name, "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")
