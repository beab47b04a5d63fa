import json
import random

from pyspark.sql import functions as F

from tallyframe.sources import annotations, files, json_documents

KEYS = ("annotations", "rows")
PIECES = "source string, block bigint, seq bigint, value string"


def wanted(text):
    """The rows as the json module reads them, or none."""
    try:
        document = json.loads(text)
    except ValueError:
        return []
    if isinstance(document, dict):
        document = next((document[key] for key in KEYS if isinstance(document.get(key), list)), [])
    return document if isinstance(document, list) else []


def read(spark, texts, draw):
    pieces = []
    for name, text in texts.items():
        size = draw.choice([1, 2, 7, 1000])
        pieces += [(name, n // size, n, value) for n, value in enumerate(text.split(","))]
    draw.shuffle(pieces)
    found = json_documents.row_items(spark.createDataFrame(pieces, PIECES).repartition(5), KEYS)
    got = {name: [] for name in texts}
    for row in found.orderBy("source", "block", "seq").collect():
        got[row.source].append(json.loads(row.item))
    return got


def random_value(draw, depth=0):
    kind = draw.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return draw.choice(["", "a,b", '"', "\\", '\\"', "[{", "}],", "é,\n", '","rows":[', "x" * 40])
    if kind < 4:
        return draw.choice([0, -1.5, None, True, 12345])
    if kind < 6:
        return {draw.choice(["k", "a,b", 'q"', "rows", "\\"]): random_value(draw, depth + 1) for _ in range(draw.randrange(4))}
    return [random_value(draw, depth + 1) for _ in range(draw.randrange(4))]


def test_rows_match_the_json_module(spark, many_partitions):
    draw = random.Random(5)
    texts = {}
    for n in range(60):
        rows = [random_value(draw) for _ in range(draw.randrange(9))]
        other = {draw.choice(["meta", "a,b", "z", 'annotations"']): random_value(draw) for _ in range(draw.randrange(3))}
        document = draw.choice([rows, {"rows": rows}, {**other, "rows": rows}, {"rows": rows, **other}, {"annotations": {"rows": [1]}, "rows": rows},
                                {"rows": ["not", "these"], "annotations": rows, **other}, other])
        texts[f"f{n}"] = json.dumps(document, indent=draw.choice([None, 1]), ensure_ascii=draw.random() < 0.5)
    assert sum(len(wanted(text)) for text in texts.values()) > 100
    assert read(spark, texts, draw) == {name: wanted(text) for name, text in texts.items()}


def test_broken_and_odd_documents_have_no_rows(spark):
    texts = {"open": '[{"a":1},{"b":2}', "text": '[{"a":"x},{"b":2}]', "scalar": "5", "blank": " ", "none": "{}", "empty": "[]",
             "object": '{"rows":{"a":[1,2]}}', "held": '{"rows":[ ]}', "more": '[{"a":1}]]'}
    assert read(spark, texts, random.Random(1)) == {name: [] for name in texts}
    assert json_documents.row_items(spark.createDataFrame([], PIECES), KEYS).count() == 0


def test_equal_keys_count_as_the_last(spark):
    assert read(spark, {"a": '{"rows":[1,2],"x":0,"rows":[3,4]}'}, random.Random(2)) == {"a": [3, 4]}


def test_one_document_is_read_by_several_tasks(spark, tmp_path):
    root = tmp_path / "d"
    (root / "imgs").mkdir(parents=True)
    for n in range(40):
        (root / "imgs" / f"h{n}.png").write_bytes(b"x")
    rows = [{"path": f"imgs/h{n % 40}.png", "note": 'say, "x" [{' * (n % 9), "label": "latent tb"} for n in range(3000)]
    (root / "train.json").write_text(json.dumps({"info": {"a": [1, 2]}, "annotations": rows, "images": [{"path": "imgs/h1.png"}]}))
    (root / "bad.json").write_text('[{"path": "imgs/h1.png", "label": "healthy"}, {"path": }]')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        inventory = files.file_inventory(spark, str(root))
        listed = annotations.annotation_files(inventory).select("path")
        lines = annotations._lines(spark, str(root), listed, ".json", separator=json_documents.SEPARATOR)
        blocks = lines.where(F.col("source").endswith("train.json")).select("block").distinct().count()
        found = annotations.annotation_records(spark, str(root), inventory)
        counts = {(r.source.rsplit("/")[-1], r.split, r.category): r["count"] for r in found.groupBy("source", "split", "category").count().collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert blocks > 5
    assert counts == {("train.json", "train", "latent_tb"): 3000}
