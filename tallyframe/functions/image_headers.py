"""Width, height and channels of images from their headers, as expressions over a binary column; nothing is decoded.

PNG, JPEG, GIF, BMP, TIFF and WebP. Numbers are read from the hexadecimal form of a few bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import let

HEADER_TYPE = "struct<format:string,width:bigint,height:bigint,channels:bigint>"
# Segments of a JPEG that are looked at at first, and at most, for its frame header.
FEW_SEGMENTS, MOST_SEGMENTS = 24, 4096


def _hex(content: Column, at: Column | int, size: int) -> Column:
    """The bytes from the 0-based place ``at`` on, in hexadecimal; null where fewer are left."""
    start = (F.lit(at) if isinstance(at, int) else at) + 1
    found = F.hex(F.substr(content, start.cast("int"), F.lit(size)))
    return F.when(start + size - 1 <= F.octet_length(content), found)


def _big(content: Column, at: Column | int, size: int) -> Column:
    return F.conv(_hex(content, at, size), 16, 10).cast("bigint")


def _little(content: Column, at: Column | int, size: int) -> Column:
    digits = _hex(content, at, size)
    turned = F.concat(*[F.substring(digits, 2 * byte + 1, 2) for byte in reversed(range(size))])
    return F.conv(turned, 16, 10).cast("bigint")


def _header(kind: str, width: Column, height: Column, channels: Column) -> Column:
    return F.struct(F.lit(kind).alias("format"), width.alias("width"), height.alias("height"), channels.alias("channels")).cast(HEADER_TYPE)


def _png(content: Column) -> Column:
    colour = _big(content, 25, 1)
    channels = F.when(colour.isin(0, 3), 1).when(colour == 2, 3).when(colour == 4, 2).when(colour == 6, 4)
    return _header("png", _big(content, 16, 4), _big(content, 20, 4), channels)


def _gif(content: Column) -> Column:
    return _header("gif", _little(content, 6, 2), _little(content, 8, 2), F.lit(1))


def _bmp(content: Column) -> Column:
    old = _little(content, 14, 4) == 12
    bits = F.when(old, _little(content, 24, 2)).otherwise(_little(content, 28, 2))
    channels = F.when(bits <= 8, 1).when(bits == 32, 4).when(bits.isNotNull(), 3)
    # Rows from top to bottom have a negative height.
    signed = _little(content, 22, 4)
    height = F.when(signed >= 1 << 31, (1 << 32) - signed).otherwise(signed)
    width = F.when(old, _little(content, 18, 2)).otherwise(_little(content, 18, 4))
    return _header("bmp", width, F.when(old, _little(content, 20, 2)).otherwise(height), channels)


def _webp(content: Column) -> Column:
    kind = _hex(content, 12, 4)
    lossless = _little(content, 21, 4)
    alpha = lambda bit: F.when(bit > 0, 4).otherwise(3)
    lossy = _header("webp", _little(content, 26, 2) % 16384, _little(content, 28, 2) % 16384, F.lit(3))
    plain = _header(
        "webp",
        lossless % 16384 + 1,
        F.floor(lossless / 16384) % 16384 + 1,
        alpha(F.floor(lossless / (1 << 28)) % 2),
    )
    extended = _header(
        "webp", _little(content, 24, 3) + 1, _little(content, 27, 3) + 1, alpha(F.floor(_little(content, 20, 1) / 16) % 2)
    )
    return F.when(kind == "56503820", lossy).when(kind == "5650384C", plain).when(kind == "56503858", extended)


def _tiff(content: Column) -> Column:
    big = _hex(content, 0, 2) == "4D4D"
    number = lambda at, size: F.when(big, _big(content, at, size)).otherwise(_little(content, at, size))

    def directory(first: Column) -> Column:
        count = F.coalesce(number(first, 2), F.lit(0))
        places = F.transform(F.filter(F.sequence(F.lit(0), count), lambda n: n < count), lambda n: first + 2 + n * 12)
        entries = F.transform(
            places,
            lambda at: F.struct(
                number(at, 2).alias("tag"), F.when(number(at + 2, 2) == 3, number(at + 8, 2)).otherwise(number(at + 8, 4)).alias("value")
            ),
        )
        value = lambda held, tag: F.get(F.filter(held, lambda e: e["tag"] == tag), F.lit(0))["value"]
        known = F.filter(entries, lambda e: e["tag"].isin(256, 257, 277))
        return let(
            known, lambda held: _header("tiff", value(held, 256), value(held, 257), F.coalesce(value(held, 277), F.lit(1).cast("bigint")))
        )

    return let(number(F.lit(4), 4), directory)


def _jpeg(content: Column) -> Column:
    """The first frame header, found by going from segment to segment."""

    def step(at: Column) -> Column:
        marker = _hex(content, at, 2)
        frame = marker.between("FFC0", "FFCF") & ~marker.isin("FFC4", "FFC8", "FFCC")
        # Bytes FF may fill the space before a marker, and some markers have no length.
        alone = marker.between("FFD0", "FFD8") | (marker == "FF01")
        following = F.when(marker == "FFFF", at + 1).when(alone, at + 2).when(marker.startswith("FF"), at + 2 + _big(content, at + 2, 2))
        return F.when((at < 0) | frame, F.when(frame, -at).otherwise(at)).otherwise(following)

    def walk(most: int) -> Column:
        # A found frame is held as the negative of its place.
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(most)), F.lit(2).cast("bigint"), lambda at, _: F.when(at < 0, at).otherwise(step(at))
        )

    def frame(at: Column) -> Column:
        found = F.when(at < 0, -at)
        return _header("jpeg", _big(content, found + 7, 2), _big(content, found + 5, 2), _big(content, found + 9, 1))

    place = let(walk(FEW_SEGMENTS), lambda at: F.when(at < 0, at).when(at.isNotNull(), walk(MOST_SEGMENTS)))
    return let(place, frame)


def image_header(content: Column) -> Column:
    """``format, width, height, channels`` of an image; null for other content.

    ``channels`` are those stored: one for palettes. A number that the content does not reach is null.
    """
    start = _hex(content, 0, 4)
    return (
        F.when((start == "89504E47") & (_hex(content, 12, 4) == "49484452"), _png(content))
        .when(start.startswith("FFD8FF"), _jpeg(content))
        .when(start == "47494638", _gif(content))
        .when(start.startswith("424D"), _bmp(content))
        .when(start.isin("49492A00", "4D4D002A"), _tiff(content))
        .when((start == "52494646") & (_hex(content, 8, 4) == "57454250"), _webp(content))
    )


def checked_header(content: Column) -> Column:
    """``format, width, height, channels, error, readable`` of an image.

    ``error`` is null for a good header, else ``empty``, ``unknown format`` or ``cut short``.
    """

    def checked(header: Column) -> Column:
        whole = (header["width"] > 0) & (header["height"] > 0) & header["channels"].isNotNull()
        error = (
            F.when(content.isNull() | (F.octet_length(content) == 0), "empty")
            .when(header.isNull(), "unknown format")
            .when(~F.coalesce(whole, F.lit(False)), "cut short")
        )
        told = [header[name].alias(name) for name in ("format", "width", "height", "channels")]
        return F.struct(*told, error.alias("error"), error.isNull().alias("readable"))

    return let(image_header(content), checked)
