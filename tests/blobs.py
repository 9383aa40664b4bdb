"""File bytes built in code for the tests."""

import struct
import zlib

from pixelyard import constants as K


def png_head(width=64, height=64, depth=8, color=6, length=13, kind=b"IHDR", sig=b"\x89PNG\r\n\x1a\n"):
    return sig + struct.pack(">I4sIIBB", length, kind, width, height, depth, color) + b"\0\0\0" + b"\0\0\0\0"


def chunk(kind, body=b""):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_image(pixels):
    """A real PNG from rows of RGB or RGBA tuples."""
    h, w, c = len(pixels), len(pixels[0]), len(pixels[0][0])
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in pixels)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND")


def quality_table(base, q):
    s = 5000 // q if q < 50 else 200 - 2 * q
    return [min(max((v * s + 50) // 100, 1), 255) for v in base]


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(width=640, height=480, q=85, sampling=(0x22, 0x11, 0x11), sof=0xC0, chroma=True, adobe=None, luma=None):
    out = b"\xff\xd8"
    if adobe is not None:
        out += segment(0xEE, b"Adobe" + b"\0" * 6 + bytes([adobe]))
    out += segment(0xDB, b"\0" + bytes(luma or quality_table(K.ANNEX_K_LUMA, q)))
    if chroma:
        out += segment(0xDB, b"\1" + bytes(quality_table(K.ANNEX_K_CHROMA, q)))
    parts = b"".join(bytes([i + 1, s, 0 if i == 0 else 1]) for i, s in enumerate(sampling))
    out += segment(sof, struct.pack(">BHHB", 8, height, width, len(sampling)) + parts)
    return out + b"\xff\xda"


def gif(width=10, height=5, frames=3, local_table=False):
    out = b"GIF89a" + struct.pack("<HH", width, height) + bytes([0x80, 0, 0]) + b"\0" * 6
    for _ in range(frames):
        out += b"\x21\xf9\x04\0\0\0\0\0"
        out += b"\x2c" + b"\0" * 8 + (b"\x81" + b"\0" * 12 if local_table else b"\0") + b"\x02" + b"\x03abc\x02de\0"
    return out + b"\x3b"


def box(kind, body=b"", wide=False):
    if wide:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def avif(width=320, height=200, exif=600):
    ispe = box(b"ispe", struct.pack(">III", 0, width, height))
    iprp = box(b"iprp", box(b"ipco", box(b"colr", b"nclx" + b"\0" * 50) + ispe), wide=True)
    return box(b"ftyp", b"avif\0\0\0\0") + box(b"meta", b"\0\0\0\0" + iprp + box(b"Exif", b"x" * exif)) + box(b"mdat", b"y" * 40)
