"""Checks of image payloads, layouts and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.oracle import joined, statement
from checks.registry import check
from tuneprep.functions import pixels
from tuneprep.session import held, materialise, new_path
from tuneprep.sources import files, images

# Headers whose width and height come from the key, as hex text.
HEADERS = """
  select page_id, url, html, 1 + page_id % 700 as w, 1 + page_id % 90 as h,
    case page_id % 9
      when 0 then '89504E470D0A1A0A0000000D49484452' || printf('%08X', 1 + page_id % 700)
        || printf('%08X', 1 + page_id % 90) || hex(html)
      when 1 then '474946383961' || right(printf('%04X', 1 + page_id % 700), 2)
        || left(printf('%04X', 1 + page_id % 700), 2) || right(printf('%04X', 1 + page_id % 90), 2)
        || left(printf('%04X', 1 + page_id % 90), 2) || hex(html)
      when 2 then '424D' || repeat('00', 16) || right(printf('%04X', 1 + page_id % 700), 2)
        || left(printf('%04X', 1 + page_id % 700), 2) || '0000' || right(printf('%04X', 1 + page_id % 90), 2)
        || left(printf('%04X', 1 + page_id % 90), 2) || '0000' || hex(html)
      when 3 then 'FFD8FFE0' || hex(html)
      when 4 then hex(html)
      when 5 then ''
      when 6 then '424D' || repeat('00', 16) || right(printf('%04X', 1 + page_id % 700), 2)
        || left(printf('%04X', 1 + page_id % 700), 2) || '0000' ||
        right(printf('%08X', 4294967295 - page_id % 90), 2) || 'FFFFFF' || hex(html)
    end as payload
  from pages"""


def _images(pages):
    """Pages as image payloads: header bytes of four formats, plain text, empty, or none."""
    k = F.col("page_id")
    width, height = 1 + k % 700, 1 + k % 90

    def little(value):
        text = F.lpad(F.hex(value), 4, "0")
        return F.concat(F.substring(text, 3, 2), F.substring(text, 1, 2))

    html = F.hex(F.encode("html", "UTF-8"))
    bmp = F.concat(F.lit("424D" + "00" * 16), little(width), F.lit("0000"))
    top_down = F.substring(F.lpad(F.hex(4294967295 - k % 90), 8, "0"), 7, 2)
    kinds = [
        F.concat(
            F.lit("89504E470D0A1A0A0000000D49484452"),
            F.lpad(F.hex(width), 8, "0"),
            F.lpad(F.hex(height), 8, "0"),
            html,
        ),
        F.concat(F.lit("474946383961"), little(width), little(height), html),
        F.concat(bmp, little(height), F.lit("0000"), html),
        F.concat(F.lit("FFD8FFE0"), html),
        html,
        F.lit(""),
        F.concat(bmp, top_down, F.lit("FFFFFF"), html),
    ]
    payload = F.lit(None).cast("string")
    for number, kind in enumerate(kinds):
        payload = F.when(k % 9 == number, kind).otherwise(payload)
    return pages.select(
        "page_id",
        F.struct(
            F.unhex(payload).alias("bytes"),
            F.when(k % 5 != 0, F.col("url")).otherwise(F.lit("")).alias("path"),
            F.when(k % 10 == 0, F.array(F.lit(0.5))).alias("array"),
        ).alias("image"),
    )


@check(
    "b5_payload",
    statement(
        """select page_id, kind, format, fault, case when format in ('png', 'gif', 'bmp') then w end as width,
             case when format in ('png', 'gif', 'bmp') then h end as height
           from (select *, case when kind is null then 'no_image'
               when kind = 'bytes' and format is null then 'unknown_format' end as fault
             from (select *, case when length(payload) > 0 then 'bytes' when page_id % 5 <> 0 then 'path'
                 when page_id % 10 = 0 then 'array' end as kind,
               case page_id % 9 when 0 then 'png' when 1 then 'gif' when 2 then 'bmp' when 3 then 'jpeg'
                 when 6 then 'bmp' end as format from headers))""",
        headers=HEADERS,
    ),
)
def payload(spark, folder):
    image = F.col("image")
    size = pixels.image_size(image["bytes"])
    return _images(fx.table(spark, folder, "pages")).select(
        "page_id",
        pixels.payload_kind(image).alias("kind"),
        pixels.image_format(image["bytes"]).alias("format"),
        pixels.payload_fault(image).alias("fault"),
        size["width"].alias("width"),
        size["height"].alias("height"),
    )


def _filled_by_tasks(pages, mounted):
    """Write the payload of each page to a file of its own, and give the pages with its path below the folder.

    Spark's writer starts processes for each file and folder it makes on a local or mounted disk, to set their
    permissions, which takes far longer than to fill them. A file appears under its name when it is whole. Pages are
    dealt to 256 folders, as a folder for each takes as much disk as its file.
    """

    def fill(batches):
        import os
        import zlib

        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        task = TaskContext.get()
        for batch in batches:
            keys, inline, data, paths = batch["page_id"], batch["inline"], batch["data"], []
            for key, content in zip(keys.to_pylist(), data.to_pylist()):
                if content is None:
                    paths.append(None)
                    continue
                place = f"{zlib.crc32(str(key).encode()) % 256:02x}"
                name = f"part-{task.partitionId():05d}-{key}.txt"
                os.makedirs(f"{mounted}/{place}", exist_ok=True)
                draft = f"{mounted}/{place}/.{name}.{task.taskAttemptId()}"
                with open(draft, "wb") as file:
                    file.write(content + b"\n")
                os.replace(draft, f"{mounted}/{place}/{name}")
                paths.append(f"{place}/{name}")
            kept = pc.if_else(inline, data, pa.scalar(None, data.type))
            yield pa.RecordBatch.from_arrays([keys, kept, pa.array(paths, pa.string())], ["page_id", "data", "image_path"])

    filled = pages.mapInArrow(fill, "page_id bigint, data binary, image_path string")
    return materialise(filled, "pages-of-images")


def _filled_by_spark(pages, base):
    """The same on a file system that only Spark reaches."""
    written = pages.where(F.col("data").isNotNull())
    written.select("page_id", F.col("data").cast("string")).write.mode("append").partitionBy("page_id").text(base)
    number = F.regexp_extract("path", "/page_id=([0-9]+)/", 1).cast("bigint").alias("page_id")
    relative = F.substring_index("path", "/", -2).alias("image_path")
    spark = pages.sparkSession
    with held(spark, images.OPEN_COST, images.IMAGE_OPEN_COST):
        paths = materialise(images.image_files(spark, base).select(number, relative), "paths-of-images")
    kept = pages.select("page_id", F.when(F.col("inline"), F.col("data")).alias("data"))
    return kept.join(paths, "page_id", "left")


def _image_files(spark, folder):
    """A folder of images, one file for each page that has a payload, and the pages with paths into it.

    Three of four pages name their file, relative to the folder or in full; the others hold bytes.
    A file takes far longer to make than to fill, so pages are dealt to all cores first, however the table is split.
    """
    base = new_path(spark, "images")
    files.make_folder(spark, base)
    inline = F.col("page_id") % 4 == 0
    dealt = fx.table(spark, folder, "pages").repartition(4 * spark.sparkContext.defaultParallelism, "page_id")
    pages = _images(dealt).select("page_id", inline.alias("inline"), F.col("image.bytes").alias("data"))
    mounted = files.mounted_path(spark, base)
    filled = _filled_by_spark(pages, base) if mounted is None else _filled_by_tasks(pages, mounted)
    relative = F.col("image_path")
    full = F.concat(F.lit(f"{base}/"), relative)
    path = F.when(relative.isNull(), "not/there.png").when(F.col("page_id") % 2 == 0, full).otherwise(relative)
    image = F.struct(F.col("data").alias("bytes"), F.when(~inline, path).alias("path"))
    return base, filled.select("page_id", image.alias("image"))


@check(
    "b5_images_by_path",
    statement(
        """select page_id, kind, format, case when format in ('png', 'gif', 'bmp') then w end as width,
             case when format in ('png', 'gif', 'bmp') then h end as height, length,
             case when kind is null then 'no_image' when length is null then 'missing_file'
               when format is null then 'unknown_format' end as fault
           from (select *, case when kind is not null then case page_id % 9 when 0 then 'png' when 1 then 'gif'
                 when 2 then 'bmp' when 3 then 'jpeg' when 6 then 'bmp' end end as format,
               case kind when 'bytes' then length(payload) // 2 when 'path' then length(payload) // 2 + 1 end as length
             from (select *, case when page_id % 4 <> 0 then 'path' when length(payload) > 0 then 'bytes' end as kind
               from headers))""",
        headers=HEADERS,
    ),
)
def images_by_path(spark, folder):
    """Format, size and faults of images in files, which end in a line feed here."""
    base, rows = _image_files(spark, folder)
    rows = rows.withColumn("image", pixels.payload(rows, "image"))
    image, header, length = F.col("image"), F.col("header"), F.col("length")
    size = pixels.image_size(header)
    found = images.with_headers(rows, image, images.image_headers(spark, base), base, ["page_id"])
    return found.select(
        "page_id",
        pixels.payload_kind(image).alias("kind"),
        pixels.image_format(header).alias("format"),
        size["width"].alias("width"),
        size["height"].alias("height"),
        "length",
        images.file_fault(image, header, length).alias("fault"),
    )


# Embeddings as pixel arrays: unit range, wide range with NaN and infinities, whole numbers.
RAW = """
  select vec_id, case when vec_id % 5 = 4 then 'int' when vec_id % 5 = 3 then 'text' else 'float' end as kind,
    list_transform(embedding, lambda x, i: case vec_id % 5
      when 0 then abs(x::double) when 1 then x::double * 700
      when 2 then case i when 3 then 'nan'::double when 5 then 'infinity'::double
        when 8 then '-infinity'::double else x::double * 300 + 90 end
      else trunc(x::double * 900) end) as raw
  from embeddings"""


def _raw(spark, folder):
    k = F.col("vec_id")

    def value(x, i):
        x = x.cast("double")
        odd = (
            F.when(i == 2, F.lit(float("nan")))
            .when(i == 4, F.lit(float("inf")))
            .when(i == 7, F.lit(float("-inf")))
            .otherwise(x * 300 + 90)
        )
        whole = (x * 900).cast("bigint").cast("double")
        return (
            F.when(k % 5 == 0, F.abs(x)).when(k % 5 == 1, x * 700).when(k % 5 == 2, odd).otherwise(whole)
        )

    kind = F.when(k % 5 == 4, "int").when(k % 5 == 3, "text").otherwise("float")
    return fx.table(spark, folder, "embeddings").select(
        "vec_id", kind.alias("kind"), F.transform("embedding", value).alias("raw")
    )


PIXELS = {
    "raw": RAW,
    "finite": """
      select *, list_transform(raw, lambda x: case when isnan(x) then 0 when x = 'infinity'::double then 255
        when x = '-infinity'::double then 0 else x end) as f from raw""",
    "pixels": """
      select vec_id, kind, case when kind = 'text' then null else list_transform(f, lambda x:
        cast(trunc(greatest(0, least(255, x * case when kind = 'float' and list_min(f) >= 0
          and list_max(f) <= 1 then 255 else 1 end))) as int)) end as px from finite""",
}


@check(
    "b6_pixel_values",
    statement(f"select vec_id, kind, {joined('px')} as px from pixels", **PIXELS),
)
def pixel_values(spark, folder):
    return _raw(spark, folder).select(
        "vec_id",
        "kind",
        F.array_join(
            pixels.pixel_values(F.col("raw"), F.col("kind")).cast("array<string>"), " "
        ).alias("px"),
    )


SHAPES = [
    [8, 8],
    [8, 8, 1],
    [1, 8, 8],
    [4, 4, 4],
    [3, 7, 3],
    [1, 30, 2],
    [1, 1, 8, 8],
    [64],
    [2, 4, 8],
    [1, 4, 4, 4],
    [4, 2, 8],
    [3, 3, 7],
    [0, 8, 3],
    [2, 2, 4, 4],
]


def _shape(key):
    out = F.lit(None).cast("array<int>")
    for number, shape in enumerate(SHAPES):
        out = F.when(
            key % len(SHAPES) == number, F.array(*[F.lit(n) for n in shape])
        ).otherwise(out)
    return out


LAYOUT = {
    "shapes": f"""
      select p_partkey as id, ({SHAPES})[p_partkey % {len(SHAPES)} + 1] as shape from part""",
    "cores": """
      select *, case when len(shape) > 3 then list_filter(shape, lambda n: n > 1) else shape end as core,
        list_min(shape) > 0 as filled from shapes""",
    "laid": """
      select *, case when not filled then null when len(core) = 2 then 'grey'
        when len(core) = 3 and core[3] in (1, 3, 4) then 'hwc'
        when len(core) = 3 and core[1] in (1, 3, 4) then 'chw' end as layout from cores""",
    "placed": """
      select id, shape, layout, cast(case layout when 'chw' then core[2] when 'grey' then core[1]
          when 'hwc' then core[1] end as int) as height,
        cast(case layout when 'chw' then core[3] when 'grey' then core[2] when 'hwc' then core[2] end
          as int) as width,
        cast(case layout when 'chw' then core[1] when 'grey' then 1 when 'hwc' then core[3] end as int)
          as channels from laid""",
}


@check(
    "b7_pixel_layout",
    statement("select id, layout, height, width, channels from placed", **LAYOUT),
)
def pixel_layout(spark, folder):
    key = F.col("p_partkey")
    laid = fx.table(spark, folder, "part").select(
        key.alias("id"), pixels.pixel_layout(_shape(key)).alias("l")
    )
    return laid.select("id", "l.layout", "l.height", "l.width", "l.channels")


@check(
    "b7_to_rgb",
    statement(
        """select id, array_to_string(list_transform(range(height * width * 3), lambda i:
             case when layout = 'chw'
               then (case when channels = 1 then 0 else i % 3 end) * height * width + i // 3
               else (i // 3) * channels + (case when channels = 1 then 0 else i % 3 end) end + id), ' ')
             as rgb from placed where layout is not null""",
        **LAYOUT,
    ),
)
def to_rgb(spark, folder):
    """The flat pixel at place n has the value n plus the key."""
    key = F.col("p_partkey")
    shape = _shape(key)
    size = F.aggregate(shape, F.lit(1), lambda acc, n: acc * n)
    flat = F.transform(F.sequence(F.lit(0), size), lambda i: i + key)
    laid = fx.table(spark, folder, "part").select(
        key.alias("id"), flat.alias("px"), pixels.pixel_layout(shape).alias("l")
    )
    rgb = pixels.to_rgb(F.col("px"), F.col("l"))
    return laid.where(F.col("l").isNotNull()).select(
        "id", F.array_join(rgb.cast("array<string>"), " ").alias("rgb")
    )


@check(
    "b8_tiny_images",
    statement(
        """select p_partkey, case when ok then greatest(w, 2) end as width,
             case when ok then greatest(h, 2) end as height,
             case when ok then array_to_string(list_transform(range(greatest(w, 2) * greatest(h, 2) * 3),
               lambda i: (least((i // 3) // greatest(w, 2), h - 1) * w
                 + least((i // 3) % greatest(w, 2), w - 1)) * 3 + i % 3), ' ') end as rgb
           from (select p_partkey, cast(p_size % 7 as int) as w, cast(p_partkey % 5 as int) as h,
             p_size % 7 > 0 and p_partkey % 5 > 0 as ok from part)"""
    ),
)
def tiny_images(spark, folder):
    width, height = F.col("w"), F.col("h")
    sized = fx.table(spark, folder, "part").select(
        "p_partkey",
        (F.col("p_size") % 7).cast("int").alias("w"),
        (F.col("p_partkey") % 5).cast("int").alias("h"),
    )
    flat = F.sequence(F.lit(0), F.greatest(width * height * 3 - 1, F.lit(0)))
    size = pixels.final_size(width, height)
    grown = pixels.grow_tiny(flat, width, height)
    return sized.select(
        "p_partkey",
        size["width"].alias("width"),
        size["height"].alias("height"),
        F.when(size.isNotNull(), F.array_join(grown.cast("array<string>"), " ")).alias("rgb"),
    )


@check(
    "b9_pixel_budget",
    statement(
        """select p_partkey, px as pixels, case when px < 12544 then 'below' when px > 25088 then 'above'
             else 'within' end as budget,
             round(case when px < 12544 then sqrt(12544.0 / px) when px > 25088 then sqrt(25088.0 / px)
               else 1.0 end, 6)::double as scale
           from (select p_partkey, p_size * 8 * (1 + p_partkey % 50) * 8 as px from part)"""
    ),
)
def pixel_budget(spark, folder):
    width, height = F.col("p_size") * 8, (1 + F.col("p_partkey") % 50) * 8
    sized = fx.table(spark, folder, "part").select(
        "p_partkey", pixels.pixel_budget(width, height).alias("b")
    )
    return sized.select("p_partkey", "b.pixels", "b.budget", F.round("b.scale", 6).alias("scale"))
