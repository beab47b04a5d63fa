"""Delimited text in lines: records that go on over quoted line breaks, found in parallel, and their fields, however many.

A line turns the state it starts in (outside or inside a quoted field) into the state it ends in. These small functions are
composed inside each block of a file, then over the blocks, so that every block learns its first state from a few rows and
no task reads a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import let
from tallyframe.session import broadcast_if_small, materialize

QUOTE = '"'
# Where a walk over a record is: at the start of a field, in a plain field, inside quotes, behind a closing quote.
START, PLAIN, INSIDE, CLOSED = range(4)
# In a record that is split, this character is followed by "a" for itself and by "b" for a border of fields.
_SIGN, _ITSELF, _BORDER = "\x01", "\x01a", "\x01b"


def sniff_delimiter(path: Column, first_line: Column) -> Column:
    """Comma for .csv, tab for .tsv; for .txt the first of tab, comma, space that the first line holds."""
    lower = F.lower(path)
    found = F.when(first_line.contains("\t"), "\t").when(first_line.contains(","), ",").when(first_line.contains(" "), " ")
    return F.when(lower.endswith(".tsv"), "\t").when(lower.endswith(".csv"), ",").otherwise(found)


def _read(state: Column, part: Column, mark: Column) -> Column:
    """The state behind text without quotes."""
    return F.when((state == INSIDE) | (part == ""), state).when(part.endswith(mark), START).otherwise(PLAIN)


def _quote(state: Column) -> Column:
    """The state behind a quote: it opens at the start of a field, closes inside, and opens again behind a closing one."""
    return F.when((state == START) | (state == CLOSED), INSIDE).when(state == INSIDE, CLOSED).otherwise(PLAIN)


def _ends_inside(line: Column, mark: Column, start: int) -> Column:
    """Whether a line that starts in the state ``start`` ends inside quotes."""

    def walked(parts: Column) -> Column:
        before = F.slice(parts, 1, F.size(parts) - 1)
        state = F.aggregate(before, F.lit(start), lambda state, part: _quote(_read(state, part, mark)))
        return _read(state, F.element_at(parts, -1), mark) == INSIDE

    return F.when(line.contains(QUOTE), let(F.split(line, QUOTE, -1), walked)).otherwise(start == INSIDE)


def _composed(window: Window) -> tuple[Column, Column]:
    """The states (0 outside, 1 inside) at the end of the window's rows for both states at its start.

    A row has ``from0`` and ``from1``, its ends for both starts. The last row whose ends are equal decides; behind it (or
    without one) only rows that swap the states count.
    """
    swaps = F.sum((F.col("from0") > F.col("from1")).cast("int")).over(window)
    fixed = F.col("from0") == F.col("from1")
    decided = F.last(F.when(fixed, F.col("from0")), ignorenulls=True).over(window)
    since = swaps - F.last(F.when(fixed, F.col("swaps")), ignorenulls=True).over(window)
    return tuple(F.when(decided.isNull(), F.coalesce(swaps, F.lit(0)) + start).otherwise(decided + since) % 2 for start in (0, 1))


def _with_swaps(rows: DataFrame, window: Window) -> DataFrame:
    return rows.withColumn("swaps", F.sum((F.col("from0") > F.col("from1")).cast("int")).over(window))


def _spanning(lines: DataFrame) -> DataFrame:
    """Records of files in which quoted fields may go on over line breaks."""
    line = Window.partitionBy("source", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ends = {
        name: _ends_inside(F.col("value"), F.col("mark"), start).cast("int") for name, start in (("from0", START), ("from1", INSIDE))
    }
    walked = _with_swaps(lines.withColumns(ends), line)
    after0, after1 = _composed(line)
    walked = materialize(
        walked.select("source", "block", "seq", "value", after0.alias("after0"), after1.alias("after1")), "record-states"
    )

    # One row per block of a file.
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = walked.groupBy("source", "block").agg(
        F.max_by("after0", "seq").alias("from0"), F.max_by("after1", "seq").alias("from1")
    )
    through = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    starts = _with_swaps(blocks, through).select("source", "block", _composed(earlier)[0].alias("start"))
    known = walked.join(broadcast_if_small(materialize(starts, "block-starts")), ["source", "block"])

    inside = F.when(F.col("start") == 0, F.col("after0")).otherwise(F.col("after1"))
    whole = Window.partitionBy("source", "block").orderBy("seq")
    known = known.withColumn("inside", inside).withColumn("before", F.coalesce(F.lag("inside").over(whole), F.col("start")))
    begins = F.when(F.col("before") == 0, F.struct("block", "seq"))
    known = known.withColumn("own", F.last(begins, ignorenulls=True).over(line))
    known = known.select("source", "block", "seq", "value", "inside", "before", "own")

    alone = known.where("before = 0 AND inside = 0").select("source", F.struct("block", "seq").alias("place"), "value")
    parts = known.where("before = 1 OR inside = 1")
    last = parts.groupBy("source", "block").agg(F.max("own").alias("last"))
    carried = last.select("source", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    parts = parts.join(broadcast_if_small(carried), ["source", "block"])
    joined = parts.groupBy("source", F.coalesce("own", "carried").alias("place")).agg(
        F.sort_array(F.collect_list(F.struct("block", "seq", "value"))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda part: part["value"]), "\n")
    return alone.unionByName(joined.select("source", "place", text.alias("value")))


def logical_records(lines: DataFrame) -> DataFrame:
    """``source, place, value`` of records, given ``source, block, seq, value`` of lines and the ``mark`` of their file.

    Lines are joined where a quoted field goes on over a line break; ``place`` (block, seq) is that of the first. Only
    files with such a line are ordered, block by block, and only the lines of records that span lines are gathered. A
    quote that no other closes makes one record of the rest of its file. Positions must not change between passes.
    """
    open_ended = lines.where(F.col("value").contains(QUOTE) & _ends_inside(F.col("value"), F.col("mark"), START))
    spanning = materialize(open_ended.select("source").distinct(), "quoted-files")
    plain = lines.join(spanning, "source", "left_anti").select("source", F.struct("block", "seq").alias("place"), "value")
    if spanning.isEmpty():
        return plain
    return plain.unionByName(_spanning(lines.join(spanning, "source", "left_semi")))


def _plain(field: Column) -> Column:
    """A field without its quotes; nothing between two delimiters is null."""

    def unquoted(inner: Column) -> Column:
        close = F.instr(inner, QUOTE)
        within = F.replace(F.when(close > 0, F.left(inner, close - 1)).otherwise(inner), F.lit(_BORDER), F.lit(QUOTE))
        # Behind the closing quote, quotes are characters like any other.
        behind = F.replace(F.substr(inner, close + 1), F.lit(_BORDER), F.lit(QUOTE * 2))
        return F.when(close > 0, F.concat(within, behind)).otherwise(within)

    # Borders are gone by now, so that their sign may stand for doubled quotes.
    inner = F.replace(F.substr(field, F.lit(2)), F.lit(QUOTE * 2), F.lit(_BORDER))
    text = F.when(field.startswith(QUOTE), let(inner, unquoted)).otherwise(F.nullif(field, F.lit("")))
    return F.replace(text, F.lit(_ITSELF), F.lit(_SIGN))


def fields(record: Column, mark: Column) -> Column:
    """The fields of a record as an array as long as the record has fields; the work grows with the record alone.

    Quotes count at the start of a field only; a doubled quote in a quoted field is one quote.
    """

    def split(parts: Column) -> Column:
        walk = F.aggregate(
            parts,
            F.struct(F.lit(START).alias("state"), F.lit("").alias("seen")),
            lambda at, part: F.struct(
                _quote(_read(at["state"], part, mark)).alias("state"), F.concat(at["seen"], at["state"].cast("string")).alias("seen")
            ),
        )
        border = F.lit(_BORDER)
        bordered = let(
            walk["seen"],
            lambda seen: F.transform(
                parts,
                lambda part, i: F.when(F.substr(seen, i + 1, F.lit(1)) == str(INSIDE), part).otherwise(F.replace(part, mark, border)),
            ),
        )
        return F.transform(F.split(F.array_join(bordered, QUOTE), _BORDER, -1), _plain)

    escaped = F.replace(record, F.lit(_SIGN), F.lit(_ITSELF))
    simple = F.transform(F.split(record, mark, -1), lambda field: F.nullif(field, F.lit("")))
    return F.when(record.contains(QUOTE), let(F.split(escaped, QUOTE, -1), split)).otherwise(simple)
