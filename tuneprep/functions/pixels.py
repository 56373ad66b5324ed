"""Image payloads: which form, which size, which layout. Pixels are not decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StringType, StructType

from tuneprep.functions.binding import let

# First bytes of image files, in hex, and the format they mark.
MAGIC = {
    "89504E470D0A1A0A": "png",
    "FFD8FF": "jpeg",
    "474946383761": "gif",
    "474946383961": "gif",
    "424D": "bmp",
}
CHANNELS = (1, 3, 4)
MIN_PIXELS = 12544
MAX_PIXELS = 25088


def payload(df: DataFrame, column: str) -> Column:
    """Any stored form of an image as one struct of ``bytes``, ``path`` and ``array``.

    The form is read off the schema: raw bytes, an array, a path, or a struct with some of
    ``bytes``, ``path``, ``array``, ``data`` and ``image``, where the last two hold bytes
    or an array. Fields that are not there are null.
    """
    kind = df.schema[column].dataType
    image = F.col(column)
    if isinstance(kind, StructType):
        held = {f.name: (image[f.name], f.dataType) for f in kind.fields}
    else:
        held = {"data": (image, kind)}
    wanted = {"bytes": BinaryType, "path": StringType, "array": ArrayType}
    parts, arrays = {}, [t for _, t in held.values() if isinstance(t, ArrayType)]
    for name, form in wanted.items():
        fit = [c for n in (name, "data", "image") if n in held for c, t in [held[n]] if isinstance(t, form)]
        empty = arrays[0] if form is ArrayType and arrays else form(DoubleType()) if form is ArrayType else form()
        parts[name] = F.coalesce(*fit) if fit else F.lit(None).cast(empty)
    made = F.struct(*(c.alias(n) for n, c in parts.items()))
    return F.when(image.isNotNull(), made)


def payload_kind(image: Column) -> Column:
    """Which field of the image struct is used: bytes, else path, else array, else null.

    ``image`` is what ``payload`` gives. Empty bytes and an empty path count as absent.
    """
    return (
        F.when(F.octet_length(image["bytes"]) > 0, F.lit("bytes"))
        .when(image["path"] != "", F.lit("path"))
        .when(image["array"].isNotNull(), F.lit("array"))
    )


def payload_fault(image: Column) -> Column:
    """Why an image cannot be read, as far as its form tells; null if nothing speaks against it."""
    kind = payload_kind(image)
    return (
        F.when(kind.isNull(), F.lit("no_image"))
        .when((kind == "bytes") & image_format(image["bytes"]).isNull(), F.lit("unknown_format"))
        .when((kind == "array") & (F.size(image["array"]) == 0), F.lit("empty_array"))
    )


def image_format(data: Column) -> Column:
    """The format by its first bytes; null if none fits."""
    head = F.hex(F.substring(data, 1, 8))
    out = F.lit(None).cast("string")
    for magic, name in MAGIC.items():
        out = F.when(F.startswith(head, F.lit(magic)), F.lit(name)).otherwise(out)
    return out


def _number(data: Column, start: int, length: int, little: bool = False) -> Column:
    """An unsigned number at a fixed place (1-based) of the bytes."""
    pieces = [F.hex(F.substring(data, start + i, 1)) for i in range(length)]
    text = F.concat(*(reversed(pieces) if little else pieces))
    return F.conv(text, 16, 10).cast("bigint")


def _signed(value: Column) -> Column:
    """A 32-bit number of which the top bit is the sign."""
    return F.when(value >= 2**31, value - 2**32).otherwise(value)


def image_size(data: Column) -> Column:
    """Width and height from the header of PNG, GIF and BMP; null for other formats.

    Only the first bytes are looked at. A BMP height may be negative, for rows
    from the top.
    """
    kind = image_format(data)
    width = (
        F.when(kind == "png", _number(data, 17, 4))
        .when(kind == "gif", _number(data, 7, 2, little=True))
        .when(kind == "bmp", _number(data, 19, 4, little=True))
    )
    height = (
        F.when(kind == "png", _number(data, 21, 4))
        .when(kind == "gif", _number(data, 9, 2, little=True))
        .when(kind == "bmp", F.abs(_signed(_number(data, 23, 4, little=True))))
    )
    return F.when(
        width.isNotNull() & height.isNotNull(),
        F.struct(width.alias("width"), height.alias("height")),
    )


def pixel_values(values: Column, kind: Column) -> Column:
    """Raw numbers as pixels 0..255.

    ``kind`` is ``uint8`` (kept), ``int`` (clipped) or ``float``: NaN counts as 0
    and an infinity as the nearer end; values that all lie in 0..1 are scaled by
    255; the rest is clipped and the fraction cut off. Any other kind gives null.
    """
    finite = F.transform(
        values,
        lambda x: F.when(F.isnan(x), F.lit(0.0))
        .when(x == float("inf"), F.lit(255.0))
        .when(x == float("-inf"), F.lit(0.0))
        .otherwise(x),
    )

    def clipped(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(255.0), x)).cast("int")

    def scaled(array: Column) -> Column:
        unit = (F.array_min(array) >= 0.0) & (F.array_max(array) <= 1.0)
        factor = F.when(unit, F.lit(255.0)).otherwise(F.lit(1.0))
        return let(factor, lambda by: F.transform(array, lambda x: clipped(x * by)))

    return F.when(kind == "float", let(finite, scaled)).when(
        kind.isin("int", "uint8"), F.transform(values, clipped)
    )


def _core(shape: Column) -> Column:
    """The shape without its ones, if it has more than three dimensions."""
    return F.when(F.size(shape) > 3, F.filter(shape, lambda n: n > 1)).otherwise(shape)


def pixel_layout(shape: Column) -> Column:
    """``grey``, ``hwc`` or ``chw``, with height, width and channels; null if unusable.

    A last dimension of 1, 3 or 4 is taken for the channels before a first one is.
    """
    core = _core(shape)
    dims = F.size(core)
    first, second, last = F.get(core, F.lit(0)), F.get(core, F.lit(1)), F.get(core, F.lit(2))

    def layout(name: str, height: Column, width: Column, channels: Column) -> Column:
        return F.struct(
            F.lit(name).alias("layout"),
            height.cast("int").alias("height"),
            width.cast("int").alias("width"),
            channels.cast("int").alias("channels"),
        )

    empty = F.exists(shape, lambda n: n <= 0)
    return F.when(~empty & (dims == 2), layout("grey", first, second, F.lit(1))).when(
        ~empty & (dims == 3) & last.isin(*CHANNELS), layout("hwc", first, second, last)
    ).when(~empty & (dims == 3) & first.isin(*CHANNELS), layout("chw", second, last, first))


def to_rgb(pixels: Column, layout: Column) -> Column:
    """Flat pixels in row order, three per point: grey repeated, alpha dropped."""

    def points(bound: Column) -> Column:
        flat, shape = bound["flat"], bound["shape"]
        channels, plane = shape["channels"], shape["height"] * shape["width"]

        def value(i: Column) -> Column:
            point = F.floor(i / F.lit(3)).cast("int")
            channel = F.when(channels == 1, F.lit(0)).otherwise(i % F.lit(3))
            at = F.when(shape["layout"] == "chw", channel * plane + point).otherwise(
                point * channels + channel
            )
            return F.get(flat, at.cast("int"))

        return F.transform(F.sequence(F.lit(0), plane * F.lit(3) - 1), value)

    bound = F.struct(pixels.alias("flat"), layout.alias("shape"))
    return F.when(layout.isNotNull(), let(bound, points))


def final_size(width: Column, height: Column) -> Column:
    """The size after the tiny-image rule: a side of 1 becomes 2; null if a side is below 1."""
    return F.when(
        (width > 0) & (height > 0),
        F.struct(
            F.greatest(width, F.lit(2)).alias("width"), F.greatest(height, F.lit(2)).alias("height")
        ),
    )


def grow_tiny(rgb: Column, width: Column, height: Column) -> Column:
    """Flat RGB pixels after the tiny-image rule, by nearest neighbour."""

    def points(bound: Column) -> Column:
        flat, old_width, old_height = bound["flat"], bound["width"], bound["height"]
        new_width = F.greatest(old_width, F.lit(2))
        new_height = F.greatest(old_height, F.lit(2))

        def value(i: Column) -> Column:
            point = F.floor(i / F.lit(3)).cast("int")
            row = F.least(F.floor(point / new_width).cast("int"), old_height - 1)
            column = F.least((point % new_width).cast("int"), old_width - 1)
            return F.get(flat, ((row * old_width + column) * 3 + i % F.lit(3)).cast("int"))

        return F.transform(F.sequence(F.lit(0), new_width * new_height * F.lit(3) - 1), value)

    bound = F.struct(rgb.alias("flat"), width.alias("width"), height.alias("height"))
    return F.when((width == 1) | (height == 1), let(bound, points)).otherwise(rgb)


def pixel_budget(
    width: Column, height: Column, low: int = MIN_PIXELS, high: int = MAX_PIXELS
) -> Column:
    """Where the pixel count lies against the processor's bounds, and the side factor to reach them."""
    pixels = (width.cast("bigint") * height).cast("double")
    return F.when(
        pixels > 0,
        F.struct(
            pixels.cast("bigint").alias("pixels"),
            F.when(pixels < low, F.lit("below"))
            .when(pixels > high, F.lit("above"))
            .otherwise(F.lit("within"))
            .alias("budget"),
            F.when(pixels < low, F.sqrt(F.lit(float(low)) / pixels))
            .when(pixels > high, F.sqrt(F.lit(float(high)) / pixels))
            .otherwise(F.lit(1.0))
            .alias("scale"),
        ),
    )
