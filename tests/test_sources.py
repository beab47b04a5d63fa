import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tallyframe import session
from tallyframe.operators import audit, metrics, records
from tallyframe.plans import dataset_build, file_queries, fixtures  # noqa: F401
from tallyframe.plans.registry import QUERIES
from tallyframe.sources import annotations, files, sinks
from tallyframe.sources import conversations as readers
from tallyframe.sources.files import annotation_files


def png(width, height, value=7):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\x00" + bytes([value, (x * 3) % 256, 200] * 1)[:3] * 1 if width == 1 else
                   b"\x00" + b"".join(bytes([value, 100, 200]) for x in range(width)) for _ in range(height))
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def put(root, name, content=b"x"):
    target = root / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
    return str(target)


@pytest.fixture()
def dataset(tmp_path):
    """A dataset folder with annotation files of every kind."""
    root = tmp_path / "data"
    for name in ("imgs/h1.png", "imgs/tb2.PNG", "imgs/s3.jpg", "imgs/sub/x4.png", "imgs/sub/x5.png", "other/x6.png", "x7.png", "note.md"):
        put(root, name)
    put(root, "meta/train.csv", "﻿Image Name,Finding\nimgs/h1.png,active tb\nimgs/none.png,healthy\n\"imgs/sub/x4.png\",latent\n")
    put(root, "meta/extra.tsv", "file\tclass\tphase\nx5.png\tsick\tvalidation\nx6.png\t\ttest\nx7.png\thealthy\t\n")
    put(root, "meta/test.txt", "imgs/s3.jpg whatever\n\n  /gone/x6.png, healthy train\n")
    put(root, "meta/words.txt", "path label set\nx7.png normal train\n")
    put(root, "meta/rows.json", json.dumps({"info": [1], "annotations": "no", "images": [{"file_name": "x4.png", "category": "tb", "split": "val"}, 3]}))
    put(root, "meta/list.json", json.dumps([{"img": "imgs/tb2.PNG", "subset": "train"}, "junk"]))
    put(root, "meta/lines.jsonl", '{"path": "x5.png", "label": "healthy", "set": "test"}\n\n{"path": "h1.png", "set": "val"}\n')
    put(root, "meta/bad.jsonl", '{"path": "x5.png", "label": "tb", "set": "test"}\n{broken\n')
    put(root, "meta/latin.csv", "path,label,split\n".encode() + b"x5.png,tb\xff,test\n")
    put(root, "README.txt", "x5.png tb train")
    return root


def test_inventory(spark, dataset):
    inventory = files.file_inventory(spark, str(dataset))
    root = str(dataset)
    found = sorted(r["path"][len(root) + 1:] for r in files.images(inventory).collect())
    assert found == ["imgs/h1.png", "imgs/s3.jpg", "imgs/sub/x4.png", "imgs/sub/x5.png", "imgs/tb2.PNG", "other/x6.png", "x7.png"]
    listed = [r["path"][len(root) + 6:] for r in annotation_files(inventory).collect()]
    assert listed == ["bad.jsonl", "extra.tsv", "latin.csv", "lines.jsonl", "list.json", "rows.json", "test.txt", "train.csv", "words.txt"]
    assert files.file_inventory(spark, root + "/absent").count() == 0


def test_annotation_records(spark, dataset):
    root = str(dataset)
    inventory = files.file_inventory(spark, root)
    found = annotations.annotation_records(spark, root, inventory).collect()
    got = sorted((r["source"][len(root) + 6:], r["path"][len(root) + 1:], r["split"], r["category"]) for r in found)
    assert got == [
        ("extra.tsv", "imgs/sub/x5.png", "val", "sick_but_non_tb"),
        ("lines.jsonl", "imgs/h1.png", "val", "healthy"),
        ("lines.jsonl", "imgs/sub/x5.png", "test", "healthy"),
        ("list.json", "imgs/tb2.PNG", "train", "active_tb"),
        ("rows.json", "imgs/sub/x4.png", "val", "active_tb"),
        ("test.txt", "imgs/s3.jpg", "test", "sick_but_non_tb"),
        ("test.txt", "other/x6.png", "test", "healthy"),
        ("train.csv", "imgs/h1.png", "train", "active_tb"),
        ("train.csv", "imgs/sub/x4.png", "train", "latent_tb"),
        ("words.txt", "x7.png", "train", "healthy"),
    ]
    combined, used, kind = dataset_build.load_records(spark, root)
    assert kind == "annotations" and used.count() == 7
    assert combined.count() == 10
    assert records.missing_categories(combined).count() == 0


def test_quoted_line_breaks_and_long_strings(spark, tmp_path):
    root = tmp_path / "d"
    for name in ("imgs/h1.png", "imgs/h2.png", "imgs/tb1.png"):
        put(root, name)
    put(root, "meta/a.csv", 'path,"a\nlong ""name""",label,split\nimgs/h1.png,"two\nlines, ""quoted""",latent tb,train\n\nimgs/tb1.png,x,healthy,val\n')
    put(root, "meta/b.tsv", 'path\tlabel\tlabel\tset\nimgs/h2.png\thealthy\t"active\n tb"\ttest\n')
    put(root, "meta/c.jsonl", json.dumps({"path": "imgs/h1.png", "note": "y" * 21_000_000, "label": "healthy", "set": "val"}) + "\n5\n[1]\n")
    put(root, "meta/d.json", json.dumps({"records": [{"path": "imgs/h2.png", "note": "z" * 21_000_000, "label": "tb", "set": "val"}]}))
    found = annotations.annotation_records(spark, str(root), files.file_inventory(spark, str(root))).collect()
    assert sorted((r["source"][-5:], r["path"][-6:], r["split"], r["category"]) for r in found) == [
        (".json", "h2.png", "val", "active_tb"), ("a.csv", "b1.png", "val", "healthy"),
        ("a.csv", "h1.png", "train", "latent_tb"), ("b.tsv", "h2.png", "test", "active_tb"), ("jsonl", "h1.png", "val", "healthy")]


def test_many_small_annotation_files(spark, tmp_path):
    root = tmp_path / "d"
    for number in range(1500):
        put(root, f"imgs/{number}.png")
        put(root, f"meta/{number}.csv", f"path,label,c{number % 7}\nimgs/{number}.png,healthy,x\n")
    found = annotations.annotation_records(spark, str(root), files.file_inventory(spark, str(root)))
    assert found.where("category = 'healthy'").count() == 0  # no split is told
    put(root, "meta/train.csv", "path,label\n" + "".join(f"imgs/{n}.png,healthy\n" for n in range(1500)))
    found = annotations.annotation_records(spark, str(root), files.file_inventory(spark, str(root)))
    assert found.count() == 1500


def test_folder_dataset(spark, tmp_path):
    root = tmp_path / "d"
    for name in ("train/h1.png", "val/tb2.png", "misc/s3.png", "misc/other.png"):
        put(root, name)
    combined, used, kind = dataset_build.load_records(spark, str(root))
    assert (used, kind) == (None, "folders")
    assert sorted((r["split"], r["category"]) for r in combined.collect()) == [
        ("train", "healthy"), ("unsplit", "sick_but_non_tb"), ("val", "active_tb")]


def test_lists_and_choice_of_records(spark, tmp_path):
    root = tmp_path / "d"
    for name in ("full/imgs/health/a.png", "full/imgs/tb/b.png", "flat/images/h1.png", "flat/images/h2.png", "flat/images/tb1.png",
                 "flat/images/tb2.png", "flat/images/deeper/h3.png"):
        put(root, name)
    listing = put(root, "full/lists/all_train.txt", "health/a.png\n\n tb/b.png \ntb/none.png\n")
    assert files.count_list_entries(spark, listing) == 3
    assert files.count_list_entries(spark, listing + ".absent") is None
    quotas = {s: {"healthy": 1, "active_tb": 1} for s in ("train", "val")}
    chosen = dataset_build.choose_records(
        spark, str(root), {"train": listing, "val": listing + ".absent"}, f"{root}/full/imgs", f"{root}/flat/images", quotas)
    assert sorted((r["split"], r["path"][len(str(root)) + 1:], r["category"]) for r in chosen.collect()) == [
        ("train", "full/imgs/health/a.png", "healthy"), ("train", "full/imgs/tb/b.png", "active_tb"),
        ("val", "flat/images/h2.png", "healthy"), ("val", "flat/images/tb2.png", "active_tb")]
    built = dataset_build.build_dataset(chosen, files.file_inventory(spark, str(root)), str(tmp_path / "out"), expected=quotas)
    assert built.differences.count() == 0
    assert [(r["split"], r["is_valid"], r["total_records"]) for r in built.summaries.orderBy("split").collect()] == [
        ("train", True, 2), ("val", True, 2)]
    # A split without rows, one that was not asked for, and a row without a split.
    odd = chosen.select("path", F.when(F.col("split") == "val", "test").when(F.col("category") == "healthy", "train").alias("split"), "category")
    built = dataset_build.build_dataset(odd, files.file_inventory(spark, str(root)), str(tmp_path / "odd"), expected=quotas)
    assert sorted((str(r["split"]), r["expected_split"], r["total_records"]) for r in built.summaries.collect()) == [
        ("None", False, 1), ("test", False, 2), ("train", True, 1), ("val", True, 0)]
    assert built.differences.count() == 6
    with pytest.raises(ValueError, match="Too few images"):
        dataset_build.flat_folder_records(files.file_inventory(spark, str(root)), f"{root}/flat/images", str(root), {"train": {"healthy": 9}})


def test_records_of_a_root_that_only_the_inventory_knows(spark, tmp_path):
    root = tmp_path / "d"
    put(root, "test/h1.png")
    put(root, "notes.csv", "image,label,split\ntest/h1.png,sick,test\n")
    there = files.file_inventory(spark, str(root)).select("path")

    def chosen(**given):
        rows = dataset_build.choose_records(spark, str(root), {"test": f"{root}.absent"}, str(root), f"{root}/flat", {}, there, **given)
        return [(r["split"], r["category"]) for r in rows.collect()]

    assert ("test", "sick_but_non_tb") in chosen()
    assert chosen(folder=f"{root}.absent") == [("test", "healthy")]


def test_the_query_on_chosen_records_reads_nothing_below_its_made_up_root(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(annotations, "exists", lambda spark, path: asked.append(path) or files.exists(spark, path))
    assert not QUERIES["chosen_records"].run(spark, "/root/testdata/sf0.001").isEmpty()
    assert asked and not [path for path in asked if f"{path}/".startswith(f"{fixtures.ROOT}/")]


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_small_blocks_hold_for_one_read_and_share_tasks(spark, tmp_path, monkeypatch, kind):
    rows = [(f"{tmp_path}/test/p{n}.png", "healthy" if n % 2 else "sick") for n in range(1500)]
    if kind == "csv":
        text = "image,label,split\n" + "".join(f'{path},"{label}\n",test\n' for path, label in rows)
    else:
        text = json.dumps([{"image": path, "label": label, "split": "test"} for path, label in rows])
    name = put(tmp_path / "notes", f"n.{kind}", text)
    inventory = spark.createDataFrame([(name,)] + [(path,) for path, _ in rows], "path string")
    cut = {}

    def watched(df, name):
        cut[name] = df.rdd.getNumPartitions(), spark.conf.get("spark.sql.files.maxPartitionBytes")
        made = session.materialize(df, name)
        if name == "blocks":
            cut["found"] = made.select("block").distinct().count()
        return made

    monkeypatch.setattr(annotations, "materialize", watched)
    found = annotations.annotation_records(spark, str(tmp_path), inventory, folder=str(tmp_path / "notes"), block_bytes=1024)
    assert sorted((r["path"], r["category"]) for r in found.collect()) == sorted(
        (path, "healthy" if label == "healthy" else "sick_but_non_tb") for path, label in rows)
    assert cut.pop("found") > 50 and cut["blocks"] == (spark.sparkContext.defaultParallelism, "1024")
    assert "1024" not in [size for name, (_, size) in cut.items() if name != "blocks"]


@pytest.mark.parametrize("name", ["annotation_line_breaks", "annotation_document_blocks"])
def test_queries_in_small_blocks_cut_no_tables_so(spark, monkeypatch, name):
    sizes = {}

    def watched(df, name):
        sizes[name] = spark.conf.get("spark.sql.files.maxPartitionBytes")
        return session.materialize(df, name)

    monkeypatch.setattr(annotations, "materialize", watched)
    assert not QUERIES[name].run(spark, "/root/testdata/sf0.001").isEmpty()
    assert [found for found, size in sizes.items() if size == "8192"] == ["blocks"]


def test_sample_records(spark):
    rows = spark.createDataFrame(
        [("/b", "train", "healthy"), ("/a", "val", "healthy"), ("/t", "val", "active_tb"), ("/s", "train", "sick_but_non_tb")],
        "path string, split string, category string")
    found = {r["category"]: r["path"] for r in dataset_build.sample_records(rows.limit(0), rows).collect()}
    assert found == {"healthy": "/b", "active_tb": "/t", "sick_but_non_tb": "/s"}


def test_coco_chain(spark, tmp_path):
    document = {
        "categories": [{"id": 1, "name": "ActiveTuberculosis"}, {"id": 2, "name": "Other"}],
        "annotations": [{"image_id": 10, "category_id": 2}, {"image_id": 11, "category_id": 1}, {"image_id": 12, "category_id": 1}],
        "images": [{"id": 12, "file_name": "tb/unlisted.png"}, {"id": 10, "file_name": "tb/a.png"}, {"id": 11, "file_name": "tb/b.png"}],
    }
    categories, notes, pictures = readers.coco_tables(spark, put(tmp_path, "coco.json", json.dumps(document, indent=1)))
    entries = files.list_entries(spark, put(tmp_path, "list.txt", "tb/a.png\ntb/b.png\n"))
    found = records.annotated_listed_images(categories, notes, pictures, entries, "ActiveTuberculosis").collect()
    assert [tuple(r) for r in found] == [(2, "tb/b.png")]
    empty = readers.coco_tables(spark, put(tmp_path, "empty.json", "{}"))
    assert [t.count() for t in empty] == [0, 0, 0]


def test_listed_samples(spark, tmp_path):
    root = tmp_path / "d"
    for name in ("imgs/health/b.png", "imgs/sick/c.png", "imgs/tb/b.png"):
        put(root, name)
    listing = put(root, "lists/train.txt", "health/gone.png\nsick/c.png\nhealth/b.png\ntb/b.png\nhealthy2/z.png\n")
    document = {"categories": [{"id": 1, "name": "Active"}], "annotations": [{"image_id": 7, "category_id": 1}],
                "images": [{"id": 7, "file_name": "tb/b.png"}]}
    coco = readers.coco_tables(spark, put(root, "coco.json", json.dumps(document)))
    inventory = files.image_inventory(spark, str(root))
    prefixes = {"healthy": "health", "sick_but_non_tb": "sick"}
    entries = files.list_entries(spark, listing)
    found = dataset_build.listed_samples(entries, inventory, f"{root}/imgs", prefixes, coco, ("active_tb", "Active"))
    assert {r["category"]: r["path"][len(str(root)) + 6:] for r in found.collect()} == {
        "healthy": "health/b.png", "sick_but_non_tb": "sick/c.png", "active_tb": "tb/b.png"}
    fallback = found.withColumn("path", F.lit("/other")).withColumn("split", F.lit("train"))
    assert "/other" not in {r["path"] for r in dataset_build.sample_records(found, fallback).collect()}
    partial = dataset_build.listed_samples(entries, inventory, f"{root}/imgs", prefixes)
    assert {r["path"] for r in dataset_build.sample_records(partial, fallback).collect()} == {"/other"}
    assert dataset_build.dataset_size(spark, {"train": listing, "val": listing}, str(root)) == (5, 5)
    assert dataset_build.dataset_size(spark, {"train": listing, "val": listing + ".no"}, str(root))[1] == 0


def test_image_audit(spark, tmp_path):
    root = tmp_path / "im"
    put(root, "good.png", png(512, 512))
    put(root, "small.png", png(3, 2, value=9))
    put(root, "broken.png", b"no image")
    headers = files.image_headers(spark, str(root))
    found = {r["path"].split("/")[-1]: (r["width"], r["height"], r["readable"]) for r in headers.collect()}
    assert found["good.png"] == (512, 512, True) and found["small.png"] == (3, 2, True) and not found["broken.png"][2]
    head, rest = audit.first_violations(audit.wrong_size(headers), shown=1)
    assert [r["path"].split("/")[-1] for r in head.collect()] == ["broken.png"] and rest.first()["more"] == 1
    extent = files.pixel_ranges(spark, [f"{root}/small.png"]).first()
    assert (extent["low"], extent["high"], extent["shape"]) == (9, 200, [2, 3, 3])


def test_sizes(spark, tmp_path):
    put(tmp_path, "m/a.bin", b"0" * 1024)
    put(tmp_path, "m/deep/er/b.bin", b"0" * 1024)
    assert files.path_size_bytes(spark, f"{tmp_path}/m") == 2048
    assert files.path_size_bytes(spark, f"{tmp_path}/m/a.bin") == 1024
    with pytest.raises(FileNotFoundError):
        files.path_size_bytes(spark, f"{tmp_path}/none")
    assert files.file_metadata(spark, f"{tmp_path}/m").first()["size_gb"] == 2048 / 1024**3
    tree = files.files_per_directory(files.file_inventory(spark, f"{tmp_path}/m"), f"{tmp_path}/m").collect()
    top = f"{tmp_path}/m"
    assert [(r["directory"][len(top):], r["depth"], r["direct_files"]) for r in tree] == [("", 0, 1), ("/deep", 1, 0), ("/deep/er", 2, 1)]


def test_checkpoint_documents(spark, tmp_path):
    for step, f1 in ((400, 0.5), (800, 0.75)):
        document = {"accuracy": 0.9, "macro_f1": f1, "total_samples": 10, "per_class": {"healthy": {"f1": 0.5, "support": 3}},
                    "gate": {"name": "g", "passed": step == 800}}
        put(tmp_path, f"checkpoint-{step}-full-val/eval_results.json", json.dumps(document, indent=2))
    pattern = f"{tmp_path}/checkpoint-*/eval_results.json"
    found = readers.checkpoint_metrics(spark, pattern, [400, 800, 1600])
    assert [(r["step"], r["found"]) for r in found.collect()] == [(400, True), (800, True), (1600, False)]
    best = metrics.best_checkpoint(found.where("found")).first()
    assert best["step"] == 800 and best["gate"]["passed"] and best["per_class"]["healthy"]["support"] == 3
    none = readers.checkpoint_metrics(spark, f"{tmp_path}/absent-*/x.json", [1])
    assert [(r["step"], r["found"]) for r in none.collect()] == [(1, False)]


def test_evaluation_output(spark, tmp_path):
    rows = spark.createDataFrame([(0, "healthy", "healthy", 0.25)], "index bigint, true_label string, predicted_label string, binary_score double")
    target = str(tmp_path / "out")
    sinks.write_evaluation(metrics.compute_metrics(rows), rows, target)
    line = spark.read.text(f"{target}/predictions.jsonl").first()[0]
    assert line == '{"binary_score":0.25,"index":0,"predicted_label":"healthy","true_label":"healthy"}'
    document = json.loads(spark.read.text(f"{target}/eval_results.json").first()[0])
    assert list(document) == sorted(document) and document["binary_roc_auc"] is None and document["accuracy"] == 1.0


def test_count_differences(spark):
    rows = spark.createDataFrame([("train", "a"), ("train", "a"), ("val", "z")], "split string, category string")
    expected = spark.createDataFrame([("train", "a", 2), ("train", "b", 1)], "split string, category string, n bigint")
    found = records.count_differences(rows, expected).orderBy("split").collect()
    assert [tuple(r) for r in found] == [("train", "b", 1, 0), ("val", "z", 0, 1)]


def test_scratch_tables_are_deleted_by_their_owner(spark):
    kept = session.materialize(spark.range(3), "kept")
    with session.scratch_tables(spark):
        path = session.scratch_path(spark, "mine")
        spark.range(3).write.parquet(path)
        assert files.exists(spark, path) and session.materialize(spark.range(2), "inner").count() == 2
    assert not files.exists(spark, path) and kept.count() == 3
