import pytest
from pyspark.sql import functions as F

from tallyframe.functions import paths, tokens
from tallyframe.operators import records


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in rows.select("i", expression.alias("out")).orderBy("i").collect()]


def test_normalize_token(spark):
    given = ["  Sick-but NON__tb! ", None, "", "***", "É-x", "A1 b2"]
    assert column(spark, given, tokens.normalize_token(F.col("v"))) == ["sick_but_non_tb", "", "", "", "x", "a1_b2"]


def test_canonical_category(spark):
    expected = {
        "healthy": "healthy", "active_tb": "active_tb", "latent_tb": "latent_tb", "sick-but-non-tb": "sick_but_non_tb",
        "no_tb_case": "healthy", "latent_tb_case": "latent_tb", "sick_non_tb_case": "sick_but_non_tb",
        "abnormal": None, "unhealthy": None, "tb11": None, "": None, None: None, "tb or sick": "active_tb",
    }
    found = column(spark, list(expected), tokens.canonical_category(F.col("v")))
    assert dict(zip(expected, found)) == expected


def test_aliases_with_quotes(spark):
    aliases = {"o'clock": ("noon",), "back\\slash": ("x",)}
    found = column(spark, ["at noon", "x", "y"], tokens.canonical_category(F.col("v"), aliases))
    assert found == ["o'clock", "back\\slash", None]


def test_canonical_split(spark):
    expected = {
        "train": "train", "validation": "val", "valid": "val", "Val": "val", "test": "test", "my-train-set": "train",
        "crossvalidations": "val", "trainer": None, "interval": None, "test_train": "train", "val_train": "val", None: None,
    }
    found = column(spark, list(expected), tokens.canonical_split(F.col("v")))
    assert dict(zip(expected, found)) == expected


def test_category_from_path(spark):
    expected = {
        "/r/flat/images/h0001.png": "healthy", "/r/flat/images/tb0003.png": "active_tb", "/r/flat/s0001.png": "sick_but_non_tb",
        "/r/healthy/tb/x.png": "active_tb", "/r/healthy/misc/tb9.png": "healthy", "/other/active/x1.png": "active_tb",
        "/r/x/latent_tb_7.png": "latent_tb", "/r/x/h1a.png": None, "h7.png": "healthy",
    }
    found = column(spark, list(expected), tokens.category_from_path(F.col("v"), "/r"))
    assert dict(zip(expected, found)) == expected


def test_split_from_path(spark):
    expected = {
        "/val/train/x.png": "train", "/val/a/test.png": "val", "/val/a/b.png": "val", "x/train_1.png": "train", "a/b.png": None,
    }
    found = column(spark, list(expected), tokens.split_from_path(F.col("v"), ""))
    assert dict(zip(expected, found)) == expected
    # The root itself is not looked at.
    assert column(spark, ["/val/a/b.png"], tokens.split_from_path(F.col("v"), "/val")) == [None]


def test_path_parts(spark):
    assert column(spark, ["/a/.png", "/a/b.PNG", "/a/b", "a/x.tar.GZ"], paths.extension(F.col("v"))) == ["", ".png", "", ".gz"]
    assert column(spark, ["/a/.png", "/a/b.c.PNG", "b"], paths.stem(F.col("v"))) == [".png", "b.c", "b"]
    assert column(spark, ["/a/./b//../c", "../x/y", "/.."], paths.clean_path(F.col("v"))) == ["/a/c", "x/y", "/"]
    assert column(spark, ["file:///a//b", "file:/a/b", "s3a://bucket/k/x", "/a"], paths.plain_path(F.col("v"))) == [
        "/a/b", "/a/b", "/k/x", "/a"]
    assert column(spark, ["/a b/ü+*~.png"], paths.file_uri(F.col("v"))) == ["file:///a%20b/%C3%BC%2B%2A~.png"]
    ignored = ["/x/README.txt", "/x/labels.CSV", "/x/License.json", "/x/a.png", "/x/readme2.txt"]
    assert column(spark, ignored, paths.is_annotation(F.col("v"))) == [False, True, False, False, True]


def test_column_lookup(spark):
    rows = spark.createDataFrame(
        [(0, ["id", "File Name", "x"]), (1, ["my image", "label"]), (2, ["a", "b"]), (3, ["image_id", "path"]), (4, [])],
        "i int, h array<string>",
    )
    found = rows.select("i", tokens.column_lookup(F.col("h"), ("image_path", "image", "file_name", "path")).alias("c"))
    assert [r["c"] for r in found.orderBy("i").collect()] == ["File Name", "my image", None, "path", None]


@pytest.mark.parametrize(
    "raw, expected",
    [("/r/a/x.png", "/r/a/x.png"), ("a/x.png", "/r/a/x.png"), ("./a/../a/x.png", "/r/a/x.png"), ("top.png", "/r/top.png"),
     ("lost/top.png", "/r/top.png"), ("x.png", "/r/a/x.png"), ("/gone/x.png", "/r/a/x.png"), ("none.png", None)],
)
def test_resolve_paths(spark, raw, expected):
    inventory = spark.createDataFrame([("/r/b/x.png",), ("/r/a/x.png",), ("/r/top.png",), ("/r/a/top.png",)], "path string")
    rows = spark.createDataFrame([(raw,)], "raw string")
    found = records.resolve_paths(rows, inventory, "/r/", "raw", keep_unresolved=True).collect()
    assert [r["path"] for r in found] == [expected]


def test_records_without_annotations_come_from_folders(spark):
    folders = spark.createDataFrame([("/r/tb1.png", "unsplit", "active_tb"), ("/r/latent/1.png", "unsplit", "latent_tb")],
                                    "path string, split string, category string")
    none = folders.limit(0)
    combined, kind = records.combine_records(none, folders)
    assert (kind, combined.count()) == ("folders", 2)
    annotated = spark.createDataFrame([("/r/h1.png", "train", "healthy")] * 2, folders.schema)
    combined, kind = records.combine_records(annotated, folders)
    assert kind == "annotations"
    assert sorted(r["path"] for r in combined.collect()) == ["/r/h1.png", "/r/tb1.png"]


def test_class_distribution_order(spark):
    rows = spark.createDataFrame([("z", "healthy"), ("unsplit", "active_tb"), ("val", "healthy"), ("val", "latent_tb")],
                                 "split string, category string").withColumn("path", F.lit("p"))
    found = records.class_distribution(rows).collect()
    assert [r["split"] for r in found] == ["train", "val", "test", "unsplit", "z"]
    assert [(r["healthy"], r["active_tb"]) for r in found] == [(0, 0), (1, 0), (0, 0), (0, 1), (1, 0)]
