import os
import struct

import pytest
from pyspark.sql import functions as F

from tuneprep.functions import pixels
from tuneprep.sources import images as files

IMAGE = "bytes binary, path string, array array<double>"


def images(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, image struct<{IMAGE}>")


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", width, height)


def test_payload(spark):
    rows = [
        (png(640, 3), "p", None),
        (b"", "p", None),
        (None, "p", [1.0]),
        (None, "", [1.0]),
        (None, None, None),
        (b"GIF89a" + struct.pack("<HH", 300, 2), None, None),
        (b"BM" + b"\0" * 16 + struct.pack("<ii", 70000, -5), None, None),
        (b"\xff\xd8\xff\xe0", None, None),
        (b"text", None, None),
        (None, None, []),
        (png(4, 4)[:18], None, None),
    ]
    image = F.col("image")
    got = images(spark, rows).select(
        "i",
        pixels.payload_kind(image).alias("kind"),
        pixels.image_format(image["bytes"]).alias("format"),
        pixels.image_size(image["bytes"]).alias("size"),
        pixels.payload_fault(image).alias("fault"),
    )
    out = {r["i"]: (r["kind"], r["format"], r["size"] and tuple(r["size"]), r["fault"]) for r in got.collect()}
    assert out[0] == ("bytes", "png", (640, 3), None)
    assert out[1] == ("path", None, None, None)
    assert out[2][0] == "path"
    assert out[3] == ("array", None, None, None)
    assert out[4] == (None, None, None, "no_image")
    assert out[5] == ("bytes", "gif", (300, 2), None)
    assert out[6] == ("bytes", "bmp", (70000, 5), None)
    assert out[7] == ("bytes", "jpeg", None, None)
    assert out[8] == ("bytes", None, None, "unknown_format")
    assert out[9] == ("array", None, None, "empty_array")


@pytest.mark.parametrize(
    "kind, values, expected",
    [
        ("float", [0.0, 0.5, 1.0], [0, 127, 255]),
        ("float", [0.0, 0.5, 1.5], [0, 0, 1]),
        ("float", [-1.0, 300.0, 99.9], [0, 255, 99]),
        ("float", [float("nan"), float("inf"), float("-inf"), 0.5], [0, 255, 0, 0]),
        ("float", [float("nan"), 1.0], [0, 255]),
        ("int", [-4.0, 256.0, 7.0, 1.0], [0, 255, 7, 1]),
        ("uint8", [0.0, 1.0], [0, 1]),
        ("text", [1.0], None),
    ],
)
def test_pixel_values(spark, kind, values, expected):
    df = spark.createDataFrame([(values, kind)], "v array<double>, k string")
    assert df.select(pixels.pixel_values(F.col("v"), F.col("k")).alias("p")).first()["p"] == expected


@pytest.mark.parametrize(
    "shape, expected",
    [
        ([8, 9], ("grey", 8, 9, 1)),
        ([1, 30, 3], ("hwc", 1, 30, 3)),
        ([3, 8, 8], ("chw", 8, 8, 3)),
        ([8, 8, 1], ("hwc", 8, 8, 1)),
        ([1, 1, 8, 8], ("grey", 8, 8, 1)),
        ([1, 8, 6, 3], ("hwc", 8, 6, 3)),
        ([4, 4, 4], ("hwc", 4, 4, 4)),
        ([5, 7, 9], None),
        ([64], None),
        ([2, 2, 4, 4], None),
        ([0, 3, 3], None),
    ],
)
def test_layout(spark, shape, expected):
    df = spark.createDataFrame([(shape,)], "s array<int>")
    got = df.select(pixels.pixel_layout(F.col("s")).alias("l")).first()["l"]
    assert (got and tuple(got)) == expected


@pytest.mark.parametrize(
    "shape, values, expected",
    [
        ([1, 2], [5, 6], [5, 5, 5, 6, 6, 6]),
        ([3, 1, 2], [1, 2, 3, 4, 5, 6], [1, 3, 5, 2, 4, 6]),
        ([1, 2, 4], [1, 2, 3, 0, 4, 5, 6, 0], [1, 2, 3, 4, 5, 6]),
        ([2, 1, 1], [8, 9], [8, 8, 8, 9, 9, 9]),
    ],
)
def test_rgb(spark, shape, values, expected):
    df = spark.createDataFrame([(shape, values)], "s array<int>, v array<int>")
    made = pixels.to_rgb(F.col("v"), pixels.pixel_layout(F.col("s")))
    assert df.select(made.alias("p")).first()["p"] == expected


def test_tiny_images(spark):
    df = spark.createDataFrame([(1, 1, [7, 8, 9]), (1, 0, []), (2, 2, list(range(12)))], "w int, h int, p array<int>")
    got = df.select(
        pixels.final_size(F.col("w"), F.col("h")).alias("s"),
        pixels.grow_tiny(F.col("p"), F.col("w"), F.col("h")).alias("p"),
    ).collect()
    assert tuple(got[0]["s"]) == (2, 2) and got[0]["p"] == [7, 8, 9] * 4
    assert got[1]["s"] is None
    assert got[2]["p"] == list(range(12))


@pytest.fixture
def gallery(tmp_path):
    """A folder with three images, one of them large, and a file that is none."""
    base = tmp_path / "img" / "a" / "img"
    (base / "deep").mkdir(parents=True)
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    (base / "x y%20.png").write_bytes(png)
    (base / "deep" / "b.gif").write_bytes(b"GIF89a" + bytes([3, 0, 4, 0]))
    (base / "large.bmp").write_bytes(b"BM" + b"\0" * 5000)
    (base / "notes").write_bytes(b"text")
    return str(base)


def located(spark, base, paths):
    rows = spark.createDataFrame([(i, (None, p)) for i, p in enumerate(paths)], "k int, image struct<bytes:binary,path:string>")
    return rows.withColumn("image", pixels.payload(rows, "image"))


def test_images_by_path(spark, gallery):
    paths = ["x y%20.png", f"{gallery}/x y%20.png", f"file:{gallery}/x y%20.png", f"file://{gallery}//x y%20.png", "./deep/b.gif",
             "deep//b.gif", "large.bmp", "notes", "gone.png", "/elsewhere/b.gif", "", None]
    # A file above the bound would end the job if it were opened.
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        headers = files.image_headers(spark, gallery, largest=1000)
        rows = located(spark, gallery, paths)
        found = files.with_headers(rows, F.col("image"), headers, gallery, ["k"])
        size = pixels.image_size(F.col("header"))
        got = found.select("k", "length", size.alias("s"), files.file_fault(F.col("image"), F.col("header"), F.col("length")).alias("f"))
        got = [(r["length"], r["s"] and tuple(r["s"]), r["f"]) for r in got.orderBy("k").collect()]
        whole = files.with_bytes(rows, F.col("image"), gallery, ["k"], largest=1000)
        sizes = [r["n"] for r in whole.orderBy("k").select(F.octet_length("image_bytes").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    png, gif = (24, (7, 9), None), (10, (3, 4), None)
    assert got == [png, png, png, png, gif, gif, (5002, None, "too_large"), (4, None, "unknown_format"),
                   (None, None, "missing_file"), (None, None, "missing_file"), (None, None, "no_image"), (None, None, "no_image")]
    assert sizes == [24, 24, 24, 24, 10, 10, None, 4, None, None, None, None]


def test_headers_of_images_are_all_that_is_kept(spark, gallery):
    headers = files.image_headers(spark, gallery)
    assert {r["image_path"]: len(r["header"]) for r in headers.collect()} == {
        "x y%20.png": 24, "deep/b.gif": 10, "large.bmp": 32, "notes": 4,
    }


def test_a_path_that_many_rows_name_is_spread(spark, gallery):
    rows = located(spark, gallery, ["deep/b.gif"] * 3000 + [f"none{i}" for i in range(10)])
    found = files.with_bytes(rows, F.col("image"), gallery, ["k"])
    assert found.where("octet_length(image_bytes) = 10").count() == 3000
    assert found.count() == 3010


def test_images_of_an_empty_folder_and_no_rows(spark, tmp_path):
    base = str(tmp_path)
    headers = files.image_headers(spark, base)
    assert headers.count() == 0
    rows = located(spark, base, ["a.png"])
    assert files.with_headers(rows, F.col("image"), headers, base, ["k"]).first()["header"] is None
    assert files.with_bytes(rows.limit(0), F.col("image"), base, ["k"]).count() == 0
    with pytest.raises(ValueError, match="absolute"):
        files.image_headers(spark, "relative/folder")


def test_a_tree_of_many_folders_is_listed_by_few_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"f{i}").mkdir()
        (tmp_path / f"f{i}" / "a.png").write_bytes(b"x" * (i + 1))
    before = spark.conf.get(files.LISTING)
    spark.sparkContext.setJobGroup("listing", "many folders")
    try:
        listed = files.image_files(spark, str(tmp_path))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("listing") for s in status.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= files.LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert spark.conf.get(files.LISTING) == before
    assert sorted(r["length"] for r in listed.select("length").collect()) == list(range(1, 301))


def test_files_of_pages_are_written_by_all_cores(spark, folder):
    from checks.pixels import _image_files

    base, _ = _image_files(spark, folder)
    names = [r["path"] for r in files.image_files(spark, base).select("path").collect()]
    # The table is one row group, which one task wrote.
    assert len({n.rsplit("/", 1)[1].split("-")[1] for n in names}) > spark.sparkContext.defaultParallelism


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"a{i}.png").write_bytes(b"x" * 40)
    cost = "spark.sql.files.openCostInBytes"
    settings = {"spark.sql.files.maxPartitionBytes": "16m", cost: "4m"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        headers = files.image_headers(spark, str(tmp_path))
        assert spark.conf.get(cost) == "4m"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # Each task with rows writes a part; four files to a task made 75.
    written = [p for p in headers.inputFiles() if "/part-" in p]
    assert len(written) <= 2 * spark.sparkContext.defaultParallelism
    assert headers.where("length = 40 and octet_length(header) = 32").count() == 300


def html(key):
    return "é" * (key % 3) + "\n" + "x" * key


def pages(spark, folder, keys):
    rows = [(k, f"u{k}", html(k or 0)) for k in keys]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_a_page_has_one_file_with_its_payload(spark, tmp_path):
    from checks.pixels import _image_files

    base, rows = _image_files(spark, pages(spark, tmp_path, [*range(60), None]))
    root = base.removeprefix("file:")
    found = {r["path"].split(root, 1)[1].lstrip("/"): bytes(r["content"]) for r in files.image_files(spark, base).collect()}
    filled = [k for k in range(60) if k % 9 < 7]
    named = {r["page_id"]: r["image"] for r in rows.collect()}
    assert len(found) == len(filled) and len(named) == 61
    for key in filled:
        payload = b"" if key % 9 == 5 else html(key).encode()
        if key % 4 == 0:
            assert named[key]["path"] is None and named[key]["bytes"] + b"\n" in found.values()
            assert named[key]["bytes"].endswith(payload)
        else:
            path = named[key]["path"]
            content = found[path.split(root, 1)[-1].lstrip("/")]
            assert named[key]["bytes"] is None and (root in path) == (key % 2 == 0)
            assert content.endswith(payload + b"\n") and (key % 9 not in (4, 5) or content == payload + b"\n")
    for key in {*named} - {*filled}:
        path = None if key is None or key % 4 == 0 else "not/there.png"
        assert (named[key]["bytes"], named[key]["path"]) == (None, path)
    # Checksums and a mark of success are what Spark's writer leaves; it starts processes for each file.
    assert not [name for _, _, names in os.walk(root) for name in names if name.startswith((".", "_"))]


def test_files_are_the_same_where_only_spark_reaches_them(spark, tmp_path, monkeypatch):
    from checks import pixels as checked

    folder = pages(spark, tmp_path, range(40))
    own = sorted(checked.images_by_path(spark, folder).collect(), key=lambda r: r["page_id"])
    monkeypatch.setattr(checked.files, "mounted_path", lambda spark, path: None)
    assert sorted(checked.images_by_path(spark, folder).collect(), key=lambda r: r["page_id"]) == own
    assert len(own) == 40


@pytest.mark.parametrize("keys", [[], [7, 8, 16]])
def test_pages_without_any_payload(spark, tmp_path, keys):
    from checks.pixels import images_by_path

    got = images_by_path(spark, pages(spark, tmp_path, keys)).collect()
    assert sorted((r["page_id"], r["fault"]) for r in got) == [
        (k, "no_image" if k % 4 == 0 else "missing_file") for k in keys
    ]
