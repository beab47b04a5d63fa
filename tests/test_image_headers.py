import struct

from pyspark.sql import functions as F

from tallyframe.functions import image_headers


def jpeg(width, height, channels=3, frame=0xC0, segments=1, fill=0):
    middle = b"".join(b"\xff" * fill + b"\xff" + bytes([0xE0 + n % 16]) + struct.pack(">H", 2 + n % 300) + bytes(n % 300) for n in range(segments))
    return b"\xff\xd8" + middle + b"\xff" + bytes([frame]) + struct.pack(">HBHHB", 8 + 3 * channels, 8, height, width, channels) + bytes(20)


def tiff(width, height, order="<", kind=3, samples=3):
    entries = [(256, kind, width), (257, kind, height)] + ([(277, 3, samples)] if samples else [])
    values = b"".join(
        struct.pack(order + "HHI", tag, form, 1) + (struct.pack(order + "HH", v, 0) if form == 3 else struct.pack(order + "I", v))
        for tag, form, v in entries
    )
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 12) + b"gap!" + struct.pack(order + "H", len(entries)) + values


def webp(kind, body):
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


def png(width, height, colour=2):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", width, height, 8, colour, 0, 0, 0)


IMAGES = [
    (png(70_000, 3), ("png", 70_000, 3, 3)),
    (png(1, 2, 6), ("png", 1, 2, 4)),
    (png(1, 2, 3), ("png", 1, 2, 1)),
    (jpeg(640, 480), ("jpeg", 640, 480, 3)),
    (jpeg(65_535, 1, 1, 0xC2, segments=9), ("jpeg", 65_535, 1, 1)),
    (jpeg(5, 6, segments=700, fill=2), ("jpeg", 5, 6, 3)),
    (b"GIF89a" + struct.pack("<HH", 320, 200), ("gif", 320, 200, 1)),
    (b"BM" + bytes(12) + struct.pack("<IiiHH", 40, 31, -17, 1, 32), ("bmp", 31, 17, 4)),
    (b"BM" + bytes(12) + struct.pack("<IHHHH", 12, 9, 8, 1, 24), ("bmp", 9, 8, 3)),
    (tiff(1000, 2000), ("tiff", 1000, 2000, 3)),
    (tiff(100_000, 7, ">", 4, 4), ("tiff", 100_000, 7, 4)),
    (tiff(12, 13, ">", 3, 0), ("tiff", 12, 13, 1)),
    (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 0x4000 + 300, 0x8000 + 200)), ("webp", 300, 200, 3)),
    (webp(b"VP8L", b"\x2f" + struct.pack("<I", (1 << 28) | (199 << 14) | 299)), ("webp", 300, 200, 4)),
    (webp(b"VP8X", struct.pack("<I", 16) + struct.pack("<I", 99_999)[:3] + struct.pack("<I", 49)[:3]), ("webp", 100_000, 50, 4)),
]
BROKEN = [
    (None, "empty"), (b"", "empty"), (b"no image", "unknown format"), (b"\x89PNG", "unknown format"), (png(5, 5)[:20], "cut short"),
    (jpeg(5, 5, segments=3)[:12], "cut short"), (jpeg(5, 5)[:-24], "cut short"), (b"\xff\xd8\xff\xe0\0\0" + bytes(50), "cut short"),
    (tiff(5, 5)[:30], "cut short"), (b"II*\0\xff\xff\xff\x7f", "cut short"), (b"BM", "unknown format"), (b"BM" + bytes(9), "cut short"), (webp(b"VP8 ", b""), "cut short"),
    (b"RIFF\0\0\0\0WEBPXXXX", "unknown format"), (b"GIF89a\0", "cut short"), (png(0, 5), "cut short"), (b"\xff", "unknown format"),
]


def test_headers_of_all_formats(spark):
    df = spark.createDataFrame([(n, bytearray(data)) for n, (data, _) in enumerate(IMAGES)], "n int, content binary")
    rows = df.select("n", image_headers.checked_header(F.col("content")).alias("h")).select("n", "h.*").collect()
    assert {r.n: (r.format, r.width, r.height, r.channels) for r in rows} == {n: want for n, (_, want) in enumerate(IMAGES)}
    assert all(r.readable and r.error is None for r in rows)


def test_broken_headers_give_an_error(spark):
    df = spark.createDataFrame([(n, data if data is None else bytearray(data)) for n, (data, _) in enumerate(BROKEN)], "n int, content binary")
    rows = df.select("n", image_headers.checked_header(F.col("content")).alias("h")).select("n", "h.*").collect()
    assert {r.n: r.error for r in rows} == {n: error for n, (_, error) in enumerate(BROKEN)}
    assert not any(r.readable for r in rows)
