import json

import pytest
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.functions import messages as msg
from tallyframe.operators import conversations
from tallyframe.sources import conversations as readers
from tallyframe.sources import sinks


def parsed(spark, lines):
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, value string")
    return rows.withColumn("messages", msg.parse_messages(F.col("value"))).orderBy("i")


def user(items):
    return {"role": "user", "content": items}


def assistant(content):
    return {"role": "assistant", "content": content}


GOOD = json.dumps({"messages": [user([{"type": "image", "path": "/a/ü.png"}, {"type": "text", "text": "q"}]),
                                assistant("Classification: healthy")]}, ensure_ascii=False)


def test_labels_and_paths(spark):
    lines = [
        GOOD,
        json.dumps({"messages": [assistant(["Classification: x"]), assistant("no\u2028Classification: active_tb \nClassification: y")]}),
        json.dumps({"messages": [user("text"), user([{"type": "image"}, {"type": "image", "path": ""}, {"type": "image", "path": "r/x"}])]}),
        "{broken", json.dumps([1, 2]), json.dumps({"messages": []}),
        json.dumps({"messages": [assistant("[Classification: healthy"), assistant("xClassification: healthy")]}),
    ]
    found = parsed(spark, lines).select(msg.answer_label(F.col("messages")), msg.image_path(F.col("messages"))).collect()
    assert [tuple(r) for r in found] == [
        ("healthy", "/a/ü.png"), ("active_tb", None), (None, "r/x"), (None, None), (None, None), (None, None), (None, None)]


def test_round_trip_keeps_json(spark):
    payload = [
        {"role": "system", "content": "be [brief] \"please\"\n\u00e9"},
        user([{"type": "image", "path": "/x", "size": [1, 2], "deep": {"a": None, "b": 1.5}}, {"type": "text", "text": "[q]"}]),
        assistant("[not a list]"), assistant([]), {"role": "tool"},
    ]
    line = parsed(spark, [json.dumps({"messages": payload})]).select(msg.jsonl_line(F.col("messages"))).first()[0]
    assert json.loads(line)["messages"] == payload


@pytest.mark.parametrize("place", ["text", "part", "object", "role"])
def test_lines_above_16_mb_follow_the_same_rule(spark, place):
    """A line with a long filler gives what it gives with a short one."""
    def line(filler):
        at = {name: filler if name == place else "f" for name in ("text", "part", "object", "role")}
        parts = [1, -1.5, 2e30, None, True, "5", "true", "", "[x", "[1]", "{}", '{"b": 1}', 'é "q" \\ \n/', {"z": [2, "[3]"], "a": None},
                 ["4", {}], at["part"], {"type": "text", "text": at["object"]}, "end"]
        contents = ["plain", "[b", '{"c": 1}', "5", "NaN", 5, 1.5, True, {"d": 1}, {}, None, [], at["text"], parts, ["{", at["part"]]]
        return json.dumps({"messages": [assistant(content) for content in contents] + [{"role": at["role"], "content": "é"}, {"role": "x"}]})

    filler = "long" * 4_400_000
    small, large = (r[0] for r in parsed(spark, [line("f"), line(filler)]).select("messages").collect())
    short = [(m.role.replace(filler, "f"), m.text and m.text.replace(filler, "f"), None if m.parts is None else [p.replace(filler, "f") for p in m.parts]) for m in large]
    assert short == [(m.role, m.text, m.parts) for m in small]


def test_structured_label(spark):
    given = {"Classification: active_tb": "active_tb", "  Classification:  healthy \n": "healthy",
             "Classification: latent_tb": None, "Finding: active_tb": None, "Classification: healthy\nmore": None, None: None}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(msg.structured_label(F.col("t"))).collect()] == list(given.values())


def test_answer_of_unknown_class_is_an_error(spark):
    with pytest.raises(Exception, match="Unsupported class: latent_tb"):
        spark.range(1).select(msg.answer_text(F.lit("latent_tb"))).collect()


def test_vision_and_candidate_messages(spark):
    payload = [user([{"type": "image", "path": "im/a b.png"}, {"type": "image", "image": "file:///k", "path": "/z"},
                     {"type": "text", "text": "q"}]), assistant("Classification: healthy")]
    rows = parsed(spark, [json.dumps({"messages": payload})])
    talk = F.col("messages")
    short, full, candidate, prompt = rows.select(
        msg.messages_json(msg.vision_messages(talk, base_dir="/base")), msg.messages_json(msg.vision_messages(talk, True, "/base")),
        msg.messages_json(msg.candidate_messages(talk, "active_tb")), msg.messages_json(msg.prompt_messages(talk)),
    ).first()
    expected = user([{"type": "image", "image": "file:///base/im/a%20b.png"}, payload[0]["content"][1], payload[0]["content"][2]])
    assert json.loads(short) == [expected]
    assert json.loads(full) == [expected, payload[1]]
    assert json.loads(candidate) == [payload[0], assistant([{"type": "text", "text": "Classification: active_tb"}])]
    assert json.loads(prompt) == payload[:1]


@pytest.fixture()
def chat_file(spark, tmp_path):
    def write(lines, name="train.jsonl"):
        target = tmp_path / name
        target.write_text("\n".join(lines) + "\n", encoding="utf-8")
        return str(target)

    return write


def test_validation(spark, chat_file):
    path = chat_file([GOOD, "", GOOD.replace("/a/", "a/"), GOOD.replace("healthy", "active_tb")])
    rows = readers.parsed_lines(spark, path)
    inventory = spark.createDataFrame([("/a/ü.png",)], "path string")
    summary = conversations.validation_summary(rows, inventory, strict=True).first()
    assert summary["total_records"] == 3 and summary["category_counts"] == {"healthy": 2, "active_tb": 1}
    assert (summary["missing_paths"], summary["relative_paths"], summary["is_valid"]) == (1, 1, False)
    assert sorted(r["problem"] for r in conversations.path_problems(rows, inventory).collect()) == ["missing", "relative"]
    only_good = conversations.validation_summary(readers.parsed_lines(spark, chat_file([GOOD, GOOD])), inventory).first()
    assert only_good["is_valid"] and only_good["total_records"] == 2


def test_bad_lines_are_listed_or_raised(spark, chat_file):
    path = chat_file([GOOD, "{broken", json.dumps({"messages": [assistant("Classification: healthy")]})])
    rows = readers.parsed_lines(spark, path)
    assert sorted(r["problem"] for r in conversations.violations(rows).collect()) == ["invalid JSON", "missing image path"]
    with pytest.raises(ValueError, match="invalid JSON"):
        conversations.validation_summary(rows, spark.createDataFrame([], "path string"), strict=True)


def test_evaluation_samples_and_training_rows(spark, chat_file):
    lines = [GOOD.replace("ü", f"{i:04d}") for i in range(500)]
    path = chat_file(lines[:250] + ["", "   "] + lines[250:])
    samples = readers.evaluation_samples(spark, path).orderBy("index").collect()
    assert [s["index"] for s in samples] == list(range(500))
    assert [s["image_path"] for s in samples] == [f"/a/{i:04d}.png" for i in range(500)]
    assert readers.evaluation_samples(spark, path, limit=7).count() == 7
    rows = readers.training_rows(spark, path, limit=3).collect()
    assert [json.loads(r["messages_json"])[0]["content"][0]["path"] for r in rows] == ["/a/0000.png", "/a/0001.png", "/a/0002.png"]
    with pytest.raises(FileNotFoundError):
        readers.training_rows(spark, path + ".absent")
    with pytest.raises(ValueError, match="without an answer"):
        readers.evaluation_samples(spark, chat_file([GOOD, '{"messages":[]}'], "bad.jsonl"))


def test_index_over_many_blocks(spark, chat_file):
    path = chat_file([GOOD.replace("ü", f"{i:05d}") for i in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = readers.evaluation_samples(spark, path).select("index", "image_path").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r[0], r[1]) for r in found) == [(i, f"/a/{i:05d}.png") for i in range(3000)]


def test_sample_document(spark, tmp_path):
    rows = spark.createDataFrame([("/t.png", "active_tb"), ("/h.png", "healthy"), ("/s.png", "sick_but_non_tb")],
                                 "path string, category string")
    target = str(tmp_path / "samples")
    sinks.write_sample_array(readers.sample_documents(rows), target)
    stored = json.loads(spark.read.text(target).first()[0])
    assert [m["messages"][1]["content"] for m in stored] == [
        "Classification: healthy", "Classification: active_tb", "Classification: sick_but_non_tb"]
    assert stored[0]["messages"][0]["content"] == [{"type": "image", "path": "/h.png"}, {"type": "text", "text": defaults.PROMPT}]


def test_strings_beyond_the_parsers_own_limit(spark, tmp_path):
    long = "x" * 25_000_000
    rows = [
        (1, '{"messages":[{"role":"user","content":[{"type":"image","path":"/a.png"},{"type":"text","text":"%s"}]},'
            '{"role":"assistant","content":"Classification: healthy"}]}' % long),
        (2, '{"messages":[{"role":"user","content":"[%s"},{"role":"assistant","content":"Classification: active_tb"}]}' % long),
    ]
    lines = spark.createDataFrame(rows, "i int, value string").withColumn("m", msg.parse_messages(F.col("value")))
    found = lines.select(
        "i", msg.answer_label(F.col("m")).alias("label"), msg.image_path(F.col("m")).alias("path"),
        F.length(F.get("m", F.lit(0))["text"]).alias("text"),
        F.length(F.get(F.get("m", F.lit(0))["parts"], F.lit(1))).alias("part"),
    ).collect()
    assert sorted((r["i"], r["label"], r["path"], r["text"]) for r in found) == [
        (1, "healthy", "/a.png", None), (2, "active_tb", None, len(long) + 1)]
    assert [r["part"] for r in found if r["i"] == 1] == [len(long) + len('{"type":"text","text":""}')]
