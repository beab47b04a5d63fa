import csv
import io
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import annotations, delimited, files


def rows_of(text, mark):
    """The csv module's rows, with null for nothing between delimiters (which the module does not tell from "")."""
    return [[field or None for field in row] for row in csv.reader(io.StringIO(text, newline=""), delimiter=mark)]


@pytest.mark.parametrize("mark", [",", "\t", " "])
def test_fields_match_the_csv_module(spark, mark):
    draw = random.Random(ord(mark))
    pieces = ["", "a", "é", '"', '""', '"x"', mark, f'"y{mark}z"', '"q ""w"" e"', "\x01", "\x01b", "n\x01a"]
    lines = ["".join(draw.choices(pieces, k=draw.randint(1, 9))) for _ in range(3000)]
    lines = [line for line in lines if line]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string").select("n", delimited.fields(F.col("line"), F.lit(mark)).alias("f"))
    got = {r.n: [field or None for field in r.f] for r in df.collect()}
    wrong = [(line, rows_of(line, mark)[0], got[n]) for n, line in enumerate(lines) if rows_of(line, mark)[0] != got[n]]
    assert not wrong, wrong[:5]


def test_records_of_several_blocks_match_the_csv_module(spark, many_partitions):
    draw = random.Random(11)
    files_of, texts = [], {}
    for number in range(12):
        rows = []
        for _ in range(60):
            value = draw.choice(["x", "two\nlines", 'say "hi"', 'a\n"b"\n\nc', 'inch 5" wide', "", ",", '",\n,"'])
            rows.append([str(draw.randrange(99)), value, "end"])
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(rows)
        text = out.getvalue() + ("5\" stays,plain\n" if number % 3 == 0 else "")
        texts[f"f{number}.csv"] = text
        size = draw.choice([1, 3, 10, 1000])
        for seq, line in enumerate(text[:-1].split("\n")):
            files_of.append((f"f{number}.csv", seq // size, seq, line, ","))
    draw.shuffle(files_of)
    lines = spark.createDataFrame(files_of, "source string, block bigint, seq bigint, value string, mark string").repartition(5)
    records = delimited.logical_records(lines).orderBy("source", "place")
    got = {}
    for row in records.select("source", delimited.fields(F.col("value"), F.lit(",")).alias("f")).collect():
        got.setdefault(row.source, []).append([field or None for field in row.f])
    assert got == {name: rows_of(text, ",") for name, text in texts.items()}


def test_an_open_quote_takes_the_rest_of_the_file(spark):
    rows = [("a.csv", n // 2, n, line, ",") for n, line in enumerate(["h,i", 'x,"y', "z,1", "z,2", "z,3"])]
    rows += [("b.csv", 0, n, line, ",") for n, line in enumerate(["h,i", 'x"y,z', "w,1"])]
    lines = spark.createDataFrame(rows, "source string, block bigint, seq bigint, value string, mark string")
    got = sorted((r.source, r.value) for r in delimited.logical_records(lines).collect())
    assert got == [("a.csv", "h,i"), ("a.csv", 'x,"y\nz,1\nz,2\nz,3'), ("b.csv", "h,i"), ("b.csv", "w,1"), ("b.csv", 'x"y,z')]


def test_files_in_several_blocks_and_a_long_first_line(spark, tmp_path):
    """Quoted line breaks across the borders of scan tasks, beside a file whose first line has 10,000 words."""
    root = tmp_path / "d"
    (root / "imgs").mkdir(parents=True)
    for n in range(40):
        (root / "imgs" / f"h{n}.png").write_bytes(b"x")
    with open(root / "train.csv", "w", newline="") as file:
        rows = csv.writer(file, lineterminator="\n")
        rows.writerow(["note\nof it", "path", "label"])
        rows.writerows([f'line one of {n}, "quoted",\n' + "and on\n" * (n % 50), f"imgs/h{n % 40}.png", "latent tb"] for n in range(2000))
    (root / "prose.txt").write_text(" ".join(f"word{n}" for n in range(10_000)) + "\nimgs/h1.png tb val\n")
    (root / "wide.csv").write_text(",".join(f"c{n}" for n in range(9_998)) + ',path,set\n' + "," * 9_998 + "imgs/h2.png,test\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        began = time.time()
        found = annotations.annotation_records(spark, str(root), files.file_inventory(spark, str(root)))
        counts = {(r.source.rsplit("/")[-1], r.split, r.category): r["count"] for r in found.groupBy("source", "split", "category").count().collect()}
        assert time.time() - began < 120
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert counts == {("train.csv", "train", "latent_tb"): 2000, ("prose.txt", "val", "active_tb"): 1, ("wide.csv", "test", "healthy"): 1}


def test_equal_header_names(spark):
    from tallyframe.functions import tokens

    df = spark.createDataFrame([(["Image", "x", "image "],), (["my file", "my_file", "z"],), (["q"],), ([],)], "h array<string>")
    got = [r[0] for r in df.select(tokens.column_lookup(F.col("h"), ["path", "image", "file"])).collect()]
    assert got == ["image ", "my_file", None, None]
