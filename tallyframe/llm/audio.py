"""Audio fingerprints from pitch classes, and the alignment of recordings by them (operator 6).

Short spectra are folded onto the twelve pitch classes. Filters over areas of (time, pitch class), summed in an integral
image, compare neighbouring areas; each gives two bits, and all of them one packed integer per step of time. Recordings
that share sound share integers at one offset: a histogram of offsets finds it, and the differing bits of the run of
integers that votes for it confirm it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.batches import bound_batches
from tallyframe.session import materialize

RATE = 4000
FRAME = 1024
HOP = 256
LOWEST_HZ, HIGHEST_HZ = 60.0, 1900.0
CLASSES = 12
# Neighbouring frames are averaged with these weights.
SMOOTHING = (0.25, 0.75, 1.0, 0.75, 0.25)
# Comparisons below the first, up to the second, up to the third and above give the Gray codes 0, 1, 3, 2.
LEVELS = (-0.15, 0.0, 0.15)
MAX_WIDTH = 16

# What has to meet at one offset: so many different pairs of integers in one run of two recordings, or this share of a
# recording's pairs in their whole overlap; the most bits that may differ there, and its least length.
MIN_VOTES = 8
VOTE_SHARE = 0.3
MAX_BIT_ERROR = 0.25
MIN_OVERLAP = 16
# A query is heard from so many places inside its first step of time on, so that one of them nearly falls on the steps of
# any recording that it shares sound with.
PHASES = 8
# Places that vote pairwise at once; integers that meet more often vote by a Fourier transform.
VOTES_AT_ONCE = 1 << 22


def _filters() -> list[tuple[int, int, int, int]]:
    """Sixteen areas (kind, first pitch class, classes, frames): kinds by turns, sizes by a rule."""
    widths = (4, 8, 12, MAX_WIDTH)
    return [(n % 4, (5 * n) % (CLASSES - 3), 2 + 2 * (n % 2), widths[(n // 4) % 4]) for n in range(16)]


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Pitch-class energies, one row of length 1 per frame (zeros where it is silent)."""
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES))
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    used = (hertz >= LOWEST_HZ) & (hertz <= HIGHEST_HZ)
    pitch = np.round(12 * np.log2(np.where(used, hertz, 440.0) / 440.0)).astype(int) % CLASSES
    fold = np.zeros((len(hertz), CLASSES))
    fold[np.flatnonzero(used), pitch[used]] = 1.0
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    folded = np.empty((len(frames), CLASSES))
    # A few seconds at once bound the memory for recordings of any length.
    for at in range(0, len(frames), 256):
        folded[at : at + 256] = np.abs(np.fft.rfft(frames[at : at + 256] * np.hanning(FRAME))) ** 2 @ fold
    weights = np.array(SMOOTHING) / sum(SMOOTHING)
    padded = np.pad(folded, ((len(weights) // 2,) * 2, (0, 0)), mode="edge")
    smooth = sum(weight * padded[n : n + len(folded)] for n, weight in enumerate(weights))
    norm = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(norm > 1e-6, smooth / np.maximum(norm, 1e-6), 0.0)


def packed(frames: np.ndarray) -> np.ndarray:
    """One 32-bit integer per frame that has ``MAX_WIDTH`` frames from it on."""
    count = len(frames) - MAX_WIDTH + 1
    if count < 1:
        return np.empty(0, np.int32)
    image = np.zeros((len(frames) + 1, CLASSES + 1))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    start = np.arange(count)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[start + t1, c1] - image[start + t0, c1] - image[start + t1, c0] + image[start + t0, c0]

    out = np.zeros(count, np.uint32)
    for kind, first, height, width in _filters():
        middle_c, last_c, middle_t = first + height // 2, first + height, width // 2
        if kind == 0:  # lower classes against upper ones
            a, b = area(0, width, first, middle_c), area(0, width, middle_c, last_c)
        elif kind == 1:  # earlier against later
            a, b = area(0, middle_t, first, last_c), area(middle_t, width, first, last_c)
        elif kind == 2:  # the two diagonals
            a = area(0, middle_t, first, middle_c) + area(middle_t, width, middle_c, last_c)
            b = area(0, middle_t, middle_c, last_c) + area(middle_t, width, first, middle_c)
        else:  # the area against the rest of its frames
            a = area(0, width, first, last_c)
            b = (area(0, width, 0, CLASSES) - a) * height / (CLASSES - height)
        ratio = np.log((1.0 + a) / (1.0 + b))
        level = np.searchsorted(LEVELS, ratio, side="left").astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out.view(np.int32)


def pcm16(raw: bytes | None) -> np.ndarray:
    """Samples of signed 16-bit little-endian audio with one channel; a last odd byte is left out."""
    raw = raw or b""
    return np.frombuffer(raw[: len(raw) // 2 * 2], "<i2") / 32768.0


def fingerprint(audio: Column, rate: int = RATE, decode: Callable[[object], np.ndarray] = pcm16) -> Column:
    """Packed integers of a media column; ``decode`` turns one of its values into samples, ``rate`` per second.

    One recording at a time is decoded, so only values, not samples, of a batch are held. A null or too short recording
    has no integers.
    """

    @F.arrow_udf("array<int>")
    def ints(column: pa.Array) -> pa.Array:
        return pa.array([packed(chroma(decode(value.as_py()), rate)) for value in column], pa.list_(pa.int32()))

    return ints(audio)


def phases(audio: Column, rate: int = RATE, decode: Callable[[object], np.ndarray] = pcm16, count: int = PHASES) -> Column:
    """Packed integers as by ``fingerprint``, ``count`` times: each from ``HOP / count`` samples later on than the last."""

    @F.arrow_udf("array<array<int>>")
    def ints(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.list_(pa.int32()))
        rows = []
        for value in column:
            samples = decode(value.as_py())
            rows.append([packed(chroma(samples[HOP * n // count :], rate)) for n in range(count)])
        return pa.array(rows, kind)

    return ints(audio)


def _offset_votes(query: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many places of ``query`` and ``other`` hold equal numbers, by offset (plus the length of ``query``)."""
    size = len(query) + len(other) + 1
    votes = np.zeros(size, np.int64)
    order = np.argsort(other, kind="stable")
    listed = other[order]
    known, times = np.unique(query, return_counts=True)
    first, last = np.searchsorted(listed, known), np.searchsorted(listed, known, "right")
    often = known[times * (last - first) > VOTES_AT_ONCE]
    for number in often:
        sides = [np.zeros(size) for _ in range(2)]
        sides[0][len(query) - np.flatnonzero(query == number)] = 1
        sides[1][np.flatnonzero(other == number)] = 1
        votes += np.rint(np.fft.irfft(np.prod([np.fft.rfft(side, 2 * size) for side in sides], axis=0), 2 * size)[:size]).astype(np.int64)
    places = np.flatnonzero(~np.isin(query, often))
    first, last = np.searchsorted(listed, query[places]), np.searchsorted(listed, query[places], "right")
    met = places[last > first]
    first, count = first[last > first], (last - first)[last > first]
    cuts = np.searchsorted(np.cumsum(count), np.arange(VOTES_AT_ONCE, count.sum() + VOTES_AT_ONCE, VOTES_AT_ONCE))
    for part in np.split(np.arange(len(met)), np.unique(cuts[cuts < len(met)])):
        if len(part):
            begin = np.repeat(first[part] - np.append(0, np.cumsum(count[part])[:-1]), count[part])
            found = order[begin + np.arange(len(begin))]
            votes += np.bincount(found - np.repeat(met[part], count[part]) + len(query), minlength=size)
    return votes


def _runs(score: np.ndarray, pairs: np.ndarray, same: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places (begin, end) of the runs of highest score that are long enough and hold ``MIN_VOTES`` different pairs."""
    todo = [(0, len(score))]
    while todo:
        low, high = todo.pop()
        if high - low < MIN_OVERLAP or len(np.unique(pairs[low : high - 1][same[low : high - 1]])) < MIN_VOTES:
            continue
        sums = np.concatenate([[0.0], score[low:high].cumsum()])
        gain = sums - np.minimum.accumulate(sums)
        end = int(gain.argmax())
        if gain[end] <= 0:
            continue
        begin, end = low + int(sums[: end + 1].argmin()), low + end
        voted = pairs[begin : end - 1][same[begin : end - 1]]
        if end - begin >= MIN_OVERLAP and len(np.unique(voted)) >= MIN_VOTES:
            yield begin, end
        todo += [(low, begin), (end, high)]


def _shared(query: np.ndarray, other: np.ndarray, phase: int) -> list[tuple[int, int, int, int, int, int]]:
    """All runs of one phase of a query and another recording."""
    grams = [(a[:-1].astype(np.int64) << 32) | a[1:].view(np.uint32) for a in (query, other)]
    votes = _offset_votes(*grams)
    if not len(grams[0]):
        return []
    shift = len(query) - len(grams[0])
    share = max(1, int(np.ceil(len(grams[0]) * VOTE_SHARE)))
    allowed = 32 * MAX_BIT_ERROR
    found = []
    for place in np.flatnonzero(votes >= min(share, MIN_VOTES)):
        offset = int(place) - len(query) + shift
        begin, end = max(0, -offset), min(len(query), len(other) - offset)
        differing = (query[begin:end] ^ other[begin + offset : end + offset]).view(np.uint32)
        errors = np.bitwise_count(differing).astype(np.int64)
        pairs = grams[0][begin : end - 1]
        same = pairs == grams[1][begin + offset : end - 1 + offset]
        if votes[place] >= share and end - begin >= MIN_OVERLAP and errors.sum() <= allowed * (end - begin):
            runs = [(0, end - begin)]
        else:
            runs = _runs(allowed - errors, pairs, same)
        for low, high in runs:
            equal = int(same[low : high - 1].sum())
            found.append((offset, equal, high - low, int(errors[low:high].sum()), begin + low, phase))
    return found


def alignments(query: np.ndarray | list[np.ndarray], other: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """Where ``query`` (its integers, or a list of them by phase) and ``other`` share sound: offset in ``other``, equal
    pairs of integers, length, bit errors, begin in ``query`` and phase of each run, those with most equal pairs first,
    then those of the smallest offset.

    Every offset that enough pairs vote for is tried. The run is the whole overlap if ``VOTE_SHARE`` of the query's pairs
    are equal and few enough of its bits differ, else each part with ``MIN_VOTES`` different equal pairs. A run that
    adds fewer than ``MIN_OVERLAP`` integers of either recording to those before it is left out.
    """
    listed = query if isinstance(query, list) else [query]
    found = [run for phase, ints in enumerate(listed) for run in _shared(ints, other, phase)]
    heard = np.zeros(max(map(len, listed), default=0), bool), np.zeros(len(other), bool)
    kept = []
    for run in sorted(found, key=lambda run: (-run[1], run[0], run[4], run[5])):
        offset, _, length, _, begin, _ = run
        parts = heard[0][begin : begin + length], heard[1][begin + offset : begin + offset + length]
        if max(length - int(part.sum()) for part in parts) >= MIN_OVERLAP:
            kept.append(run)
            for part in parts:
                part[:] = True
    return kept


def align(query: np.ndarray, other: np.ndarray) -> tuple[int, int, int, int]:
    """Offset, equal pairs, length and bit errors of the first of the ``alignments``; zeros without one."""
    return next((run[:4] for run in alignments(query, other)), (0, 0, 0, 0))


def _votes_needed(count: Column) -> Column:
    return F.greatest(F.ceil(count * VOTE_SHARE), F.lit(1))


_RUN_COLUMNS = "class_id match_class offset votes overlap bit_errors begin phase".split()


def _align_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for q, r, tried, x, y in zip(*(batch.column(n) for n in ("q", "r", "tried", "q_phases", "r_ints"))):
            tried = set(tried.as_py())
            heard = [np.array(ints if n in tried else [], np.int32) for n, ints in enumerate(x.as_py())]
            rows += [(q.as_py(), r.as_py(), *run) for run in alignments(heard, np.array(y.as_py(), np.int32))]
        columns = [pa.array([row[n] for row in rows], pa.int64()) for n in range(len(_RUN_COLUMNS))]
        yield pa.record_batch(columns, _RUN_COLUMNS)


def _grams(ints: Column) -> Column:
    """Pairs of neighbouring integers, as one number each."""
    pair = lambda a, b: F.call_function("shiftleft", a.cast("bigint"), F.lit(32)).bitwiseOR(
        b.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    )
    first = F.slice(ints, 1, F.greatest(F.size(ints) - 1, F.lit(0)))
    return F.transform(first, lambda a, i: pair(a, F.get(ints, i + 1)))


def align_recordings(
    recordings: DataFrame, queries: Column, id_col: str = "rec_id", ints_col: str = "ints", phases_col: str | None = None
) -> DataFrame:
    """Align the recordings where ``queries`` holds with all recordings.

    Recordings with the same integers are one class, named by its smallest id. Returns a row per recording with
    ``class_id`` and ``n_ints``; a query has a row for each run that it shares with another class: ``match_class``,
    ``offset`` (place of the query's start in the match), ``votes``, ``overlap`` (integers in the run), ``bit_errors``,
    ``begin`` (the run's place in the query) and ``phase``; without a match, and for other recordings, these are null. For
    what counts as a run, see ``alignments``; of its bits at most ``MAX_BIT_ERROR`` are in error.

    ``phases_col`` holds the ``phases`` of the queries; without it a query is heard on its own steps of time only, and
    sound that lies between the steps of the other recording is lost. A class is heard by its query of the smallest id.
    Ids are whole numbers; rows with a null id are left out, since no result could name them. A null list of integers
    matches nothing. An empty table gives no rows.

    Candidates share one of the query's rarer pairs. As many of the commonest are left out as a match by either rule can
    do without, so no match is lost, and the few pairs that most recordings hold, such as silence, are not joined.
    """
    bound_batches(recordings.sparkSession)
    own = F.array(F.col(ints_col))
    heard = F.coalesce(phases_col, own) if phases_col else own
    stored = recordings.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(ints_col, F.array().cast("array<int>")).alias("ints"),
        F.coalesce(queries, F.lit(False)).alias("is_query"),
        F.when(queries, heard).alias("phases"),
    )
    stored = materialize(stored, "audio-prints")
    first_query = F.min_by("phases", F.when(F.col("is_query"), F.col("id")))
    classes = materialize(
        stored.groupBy("ints").agg(F.min("id").alias("class_id"), F.max("is_query").alias("is_query"), first_query.alias("phases")),
        "audio-classes",
    )
    index = materialize(classes.select("class_id", F.explode(_grams(F.col("ints"))).alias("gram")), "audio-index")
    phased = classes.where("is_query").select(F.col("class_id").alias("q"), F.posexplode("phases").alias("phase", "ints"))
    asked = materialize(phased.select("q", "phase", F.posexplode(_grams(F.col("ints"))).alias("at", "gram")), "audio-asked")
    common = index.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    by_phase = Window.partitionBy("q", "phase")
    rare = (
        asked.join(common, "gram", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("place", F.row_number().over(by_phase.orderBy("n", "gram", "at")))
        .withColumn("kind", F.dense_rank().over(by_phase.orderBy("n", "gram")))
        .withColumn("count", F.count("*").over(by_phase))
        .withColumn("kinds", F.max("kind").over(by_phase))
        .where(
            (F.col("place") <= F.col("count") - _votes_needed(F.col("count")) + 1)
            | (F.col("kind") <= F.col("kinds") - MIN_VOTES + 1)
        )
        .where("n > 0")
        .select("q", "phase", "gram")
        .distinct()
    )
    candidates = (
        rare.join(index.select(F.col("class_id").alias("r"), "gram").distinct(), "gram")
        .where(F.col("q") != F.col("r"))
        .groupBy("q", "r")
        .agg(F.collect_set("phase").alias("tried"))
    )
    paired = candidates.join(classes.select(F.col("class_id").alias("q"), F.col("phases").alias("q_phases")), "q").join(
        classes.select(F.col("class_id").alias("r"), F.col("ints").alias("r_ints")), "r"
    )
    kinds = ", ".join(f"{name} bigint" for name in _RUN_COLUMNS)
    aligned = paired.select("q", "r", "tried", "q_phases", "r_ints").mapInArrow(_align_pairs, kinds)
    matches = aligned.withColumn("is_query", F.lit(True))
    named = stored.join(classes.select("ints", "class_id"), "ints").withColumn("n_ints", F.size("ints"))
    found = named.select("id", "class_id", "n_ints", "is_query").join(matches, ["class_id", "is_query"], "left")
    runs = [name for name in _RUN_COLUMNS if name != "class_id"]
    return found.select(F.col("id").alias(id_col), *["class_id", "n_ints", "is_query", *runs])
