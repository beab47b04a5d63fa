"""Conversation expressions.

A conversation is ``array<struct<role string, text string, parts array<string>>>``: ``text`` holds a plain answer,
``parts`` the raw JSON of each item of a list-valued content; exactly one of the two is set. Keeping items as raw JSON
carries fields that no operator looks at through unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.functions import paths
from tallyframe.functions.text import let, strip, text_lines

MESSAGES_TYPE = "array<struct<role:string,text:string,parts:array<string>>>"


def message(role: str | Column, text: Column | None = None, parts: Column | None = None) -> Column:
    return F.struct(
        (F.lit(role) if isinstance(role, str) else role).alias("role"),
        (F.lit(None).cast("string") if text is None else text).alias("text"),
        (F.lit(None).cast("array<string>") if parts is None else parts).alias("parts"),
    )


def image_item(path: Column) -> Column:
    return F.to_json(F.struct(F.lit("image").alias("type"), path.alias("path")))


def text_item(text: Column) -> Column:
    return F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text")))


def answer_text(category: Column, classes: Sequence[str] = defaults.CLASS_LABELS) -> Column:
    """The answer line of a class; a class outside the list stops the query with an error."""
    checked = F.when(category.isin(*classes), category).otherwise(
        F.raise_error(F.concat(F.lit("Unsupported class: "), F.coalesce(category, F.lit("null")))).cast("string")
    )
    return F.concat(F.lit(defaults.ANSWER_PREFIX), checked)


def is_supported(category: Column, classes: Sequence[str] = defaults.CLASS_LABELS) -> Column:
    """Row-wise form of the same check, for callers that list violations instead of failing."""
    return F.coalesce(category.isin(*classes), F.lit(False))


def training_messages(
    path: Column,
    category: Column,
    classes: Sequence[str] = defaults.CLASS_LABELS,
    prompt: str = defaults.PROMPT,
) -> Column:
    """User message with image and prompt, then the assistant's answer."""
    return F.array(
        message("user", parts=F.array(image_item(path), text_item(F.lit(prompt)))),
        message("assistant", text=answer_text(category, classes)),
    )


_STORED_MESSAGES = "array<struct<role:string,content:variant>>"


# The same contents by what their JSON is: a text for any kind, the others null unless it is of that kind.
_KINDS_OF_CONTENT = {"text": "string", "list": "array<string>", "object": "map<string,string>", "number": "double", "truth": "boolean"}
# The parsers' own limit on one string, 20 million characters, is lifted to what a column can hold.
JSON_OPTIONS = {"maxStringLen": str((1 << 31) - 1)}


def _quoted(text: Column) -> Column:
    return let(F.to_json(F.array(text)), lambda listed: listed.substr(F.lit(2), F.length(listed) - 2))


def _raw_parts(raw_list: Column, parts: Column) -> Column:
    """The JSON of each part of a list, given the JSON of the list and its parts read as texts.

    Parsing a list as texts takes the quotes from its texts only, so a part is a text if a quote stands where it begins.
    """

    def walked(octets: Column) -> Column:
        def step(at: Column, part: Column) -> Column:
            plain = F.coalesce(part, F.lit("null"))
            is_text = F.substring(octets, at["place"], F.lit(1)) == F.encode(F.lit('"'), "UTF-8")
            length = F.octet_length(F.when(is_text, _quoted(plain)).otherwise(plain))
            seen = F.concat(at["seen"], F.when(is_text, "t").otherwise("r"))
            return F.struct((at["place"] + length + 1).alias("place"), seen.alias("seen"))

        start = F.struct(F.lit(2).alias("place"), F.lit("").alias("seen"))
        return F.split(F.aggregate(parts, start, step)["seen"], "")

    def written(kinds: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            plain = F.coalesce(part, F.lit("null"))
            raw = F.coalesce(F.to_json(F.try_parse_json(plain)), plain)
            return F.when(F.get(kinds, i) == "t", _quoted(plain)).otherwise(raw)

        return F.transform(parts, one)

    return let(let(F.encode(raw_list, "UTF-8"), walked), written)


def parse_messages(json_text: Column, key: str | None = "messages") -> Column:
    """Parse the message list below ``key``, or the text itself as a list when ``key`` is None.

    Null when the text is no JSON or holds no message list. Contents are parsed as variants, which keep lists and texts
    apart even when a text starts with a bracket. A variant holds 16 MB; where it cannot be made, contents are read once
    for each kind of JSON, which tells the same apart. A content that is neither a text nor a list leaves both null.
    """
    def read(schema: str) -> Column:
        if key is None:
            return F.from_json(json_text, schema, JSON_OPTIONS)
        return F.from_json(json_text, f"struct<{key}:{schema}>", JSON_OPTIONS)[key]

    def large() -> Column:
        kinds = F.struct(*[read(f"array<struct<content:{kind}>>").alias(name) for name, kind in _KINDS_OF_CONTENT.items()])

        def with_kinds(found: Column) -> Column:
            def one_large(item: Column, i: Column) -> Column:
                text, parts, held, number, truth = (F.get(found[name], i)["content"] for name in _KINDS_OF_CONTENT)
                # Names of numbers that are not finite parse as doubles although they are texts.
                is_number = number.isNotNull() & text.rlike("^-?[0-9]")
                is_text = parts.isNull() & held.isNull() & truth.isNull() & ~is_number
                return F.struct(
                    item["role"].alias("role"),
                    F.when(is_text, text).alias("text"),
                    F.when(parts.isNotNull(), _raw_parts(text, parts)).alias("parts"),
                )

            return F.transform(read("array<struct<role:string>>"), one_large)

        return let(kinds, with_kinds)

    def one(item: Column) -> Column:
        return let(
            F.try_variant_get(item["content"], "$", "array<variant>"),
            lambda parts: F.struct(
                item["role"].alias("role"),
                F.when(
                    parts.isNull() & (F.schema_of_variant(item["content"]) == "STRING"),
                    F.try_variant_get(item["content"], "$", "string"),
                ).alias("text"),
                F.transform(parts, lambda part: F.to_json(part)).alias("parts"),
            ),
        )

    return F.coalesce(F.transform(read(_STORED_MESSAGES), one), large())


def messages_json(messages: Column) -> Column:
    """JSON text of a conversation; list-valued contents are written as lists again."""
    def one(item: Column) -> Column:
        as_text = F.to_json(F.struct(item["role"].alias("role"), item["text"].alias("content")))
        head = F.to_json(F.struct(item["role"].alias("role")))
        as_list = F.concat(
            F.regexp_replace(head, r"\}$", ""),
            F.when(item["role"].isNotNull(), F.lit(",")).otherwise(F.lit("")),
            F.lit('"content":['),
            F.array_join(item["parts"], ","),
            F.lit("]}"),
        )
        return F.when(item["parts"].isNotNull(), as_list).otherwise(as_text)

    return F.concat(F.lit("["), F.array_join(F.transform(messages, one), ","), F.lit("]"))


def jsonl_line(messages: Column) -> Column:
    return F.concat(F.lit('{"messages":'), messages_json(messages), F.lit("}"))


def answer_label(messages: Column) -> Column:
    """Rest of the first answer line of the assistant messages, stripped; null when there is none."""
    answers = F.filter(messages, lambda m: (m["role"] == "assistant") & m["text"].isNotNull())
    lines = F.flatten(F.transform(answers, lambda m: text_lines(m["text"])))
    line = F.get(F.filter(lines, lambda text: text.startswith(defaults.ANSWER_PREFIX)), F.lit(0))
    return strip(F.substr(line, F.lit(len(defaults.ANSWER_PREFIX) + 1)))


def image_path(messages: Column) -> Column:
    """Path of the first image item of the user messages; null when there is none."""
    lists = F.filter(messages, lambda m: (m["role"] == "user") & m["parts"].isNotNull())
    items = F.flatten(F.transform(lists, lambda m: m["parts"]))
    found = F.transform(
        F.transform(items, lambda item: F.from_json(item, "type string, path string", JSON_OPTIONS)),
        lambda item: F.when(item["type"] == "image", item["path"]),
    )
    return F.get(F.filter(found, lambda path: path.isNotNull() & (path != "")), F.lit(0))


def structured_label(text: Column, classes: Sequence[str] = defaults.CLASS_LABELS) -> Column:
    """Class of a text that is nothing but one answer line with a known class; else null."""
    prefix = defaults.ANSWER_PREFIX

    def check(stripped: Column) -> Column:
        label = strip(F.substr(stripped, F.lit(len(prefix) + 1)))
        return F.when(
            ~stripped.contains("\n") & stripped.startswith(prefix) & label.isin(*classes),
            label,
        )

    return let(strip(text), check)


def has_locked_format(messages: Column) -> Column:
    """Whether the second message is one line with the answer prefix."""
    answer = F.get(messages, F.lit(1))["text"]
    return F.coalesce(answer.startswith(defaults.ANSWER_PREFIX) & ~answer.contains("\n"), F.lit(False))


def vision_messages(messages: Column, include_answer: bool = False, base_dir: str = "") -> Column:
    """Drop the answers unless asked for, and turn local image paths into ``file://`` URIs.

    A relative path is taken below ``base_dir``.
    """
    def absolute(path: Column) -> Column:
        prefix = base_dir.rstrip("/") + "/"
        return paths.clean_path(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(prefix), path)))

    def rewrite(item: Column) -> Column:
        parsed = F.from_json(item, "type string, path string, image string", JSON_OPTIONS)
        path, image = parsed["path"], parsed["image"]
        convert = (
            (parsed["type"] == "image")
            & (F.coalesce(image, F.lit("")) == "")
            & (F.coalesce(path, F.lit("")) != "")
        )
        as_uri = F.to_json(F.struct(F.lit("image").alias("type"), paths.file_uri(absolute(path)).alias("image")))
        return F.when(convert, as_uri).otherwise(item)

    kept = messages if include_answer else F.filter(
        messages, lambda m: F.coalesce(m["role"], F.lit("")) != "assistant"
    )
    return F.transform(
        kept, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"),
                                 F.transform(m["parts"], rewrite).alias("parts"))
    )


def candidate_messages(
    messages: Column, candidate: str | Column, classes: Sequence[str] = defaults.CLASS_LABELS
) -> Column:
    """The first message followed by the answer for ``candidate``, as a list-valued content."""
    label = F.lit(candidate) if isinstance(candidate, str) else candidate
    answer = message("assistant", parts=F.array(text_item(answer_text(label, classes))))
    return F.array(F.get(messages, F.lit(0)), answer)


def feature_messages(messages: Column, stored_json: Column) -> Column:
    """The conversation itself, else the one parsed from its stored JSON text."""
    return F.coalesce(messages, parse_messages(stored_json, None))


def prompt_messages(messages: Column) -> Column:
    return F.slice(messages, 1, 1)


def roles(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["role"]), ",")

