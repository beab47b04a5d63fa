import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import collocations, quotient

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, top=2000):
    """(text, lang) rows to the expected rows, by the definition."""
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3, 4):
                for at in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[at : at + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        longest = Counter()
        for p, a in candidates.items():
            for inner in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                longest[inner] = max(longest[inner], a)
        listed = []
        for p, a in candidates.items():
            if 100 * longest[p] >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            listed.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def corpus():
    draw = random.Random(7)
    words = ["a", "B", "é", "Ünïcode", "the", "of", "日本語", "x y", "🙂"] + [f"w{n}" for n in range(30)]
    rows = []
    for lang in ("en", "de", None, "und", ""):
        for _ in range(25):
            parts = []
            for _ in range(draw.randrange(120)):
                parts.append(draw.choice(["the of w1", "w2 w3 w4 w5 w6", "w7  w8", "w9\tw10", words[draw.randrange(12)], draw.choice(words)]))
                parts.append(draw.choice([" ", " ", " ", ". ", ",", "\n", "\t", " \x0b", "  "]))
            rows.append(("".join(parts), lang))
    rows += [rows[3]] * 4 + [(None, "en"), ("", "en"), (" \t\n.,", None), ("once", "fr"), ("q q q q q q", "it")]
    long = " ".join("w2 w3 long." if n % 3 else f"rare{n}" for n in range(150_000))
    return rows + [(long, "en")]


@pytest.mark.parametrize("max_broadcast", [collocations.MAX_BROADCAST_BYTES, 0])
def test_phrases_match_brute_force(spark, many_partitions, max_broadcast):
    rows = corpus()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = collocations.mine(df, min_count=4, max_broadcast=max_broadcast).collect()
    want = brute(rows, 4)
    assert sorted(tuple(r) for r in got) == want
    assert {"en", "und", "", "it"} <= {row[0] for row in want} and len(want) > 200


def test_top_phrases_and_ties(spark):
    rows = [(". ".join(f"p{n:02} q{n:02}" for n in range(40)), "en")] * 5
    df = spark.createDataFrame(rows, "text string, lang string")
    got = collocations.mine(df, min_count=5, top=7).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5, top=7) and len(got) == 7


def test_nothing_and_clashing_names(spark, nothing):
    assert collocations.mine(nothing, lang_col="source").count() == 0
    schema = "text string, lang string, word string, id int, n int, row string, block string"
    df = spark.createDataFrame([("a b. a b. a b", "x", "w", 1, 2, "r", "b")], schema)
    assert [tuple(r) for r in collocations.mine(df, min_count=3).collect()] == [("x", 1, "a b", 3, 3, 3, 6, 1_000_000)]


def test_awkward_documents(awkward):
    rows = [(r.text, r.source) for r in awkward.collect()]
    got = collocations.mine(awkward, lang_col="source", min_count=5).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5) and got


@pytest.mark.parametrize("bits", [16, 20, 33, 64])
def test_filters_are_lossless(bits):
    draw = np.random.default_rng(bits)
    top = np.uint64((1 << bits) - 1)
    high = draw.integers(0, 2**63, 5000, np.uint64) & top
    low = draw.integers(0, 2**63, 5000, np.uint64) & top
    high[1000:3000], low[1000:3000] = high[0], low[0]
    want = Counter(zip(high.tolist(), low.tolist()))
    keys = quotient.count(*quotient.permute(high, low, bits), bits)
    blocks = quotient.split(keys, bits, 3)
    assert len(blocks) == 8
    got = {}
    for block, data in blocks:
        decoded, half = quotient.decode(data)
        assert half == bits and set((decoded.high >> np.uint64(bits - 3)).tolist()) == {block}
        restored = quotient.restore(decoded.high, decoded.low, half)
        got |= dict(zip(zip(*[x.tolist() for x in restored]), decoded.count.tolist()))
    assert got == want


def test_merged_filters_add_up():
    bits, draw = 20, np.random.default_rng(3)
    parts, want = [], Counter()
    for _ in range(5):
        high, low = draw.integers(0, 40, (2, 3000)).astype(np.uint64)
        want.update(zip(high.tolist(), low.tolist()))
        parts.append(quotient.count(*quotient.permute(high, low, bits), bits))
    merged = quotient.merge(parts, bits)
    restored = quotient.restore(merged.high, merged.low, bits)
    assert dict(zip(zip(*[x.tolist() for x in restored]), merged.count.tolist())) == want
    again, _ = quotient.decode(quotient.encode(merged, bits, 0, 0))
    assert all((a == b).all() for a, b in zip(again, merged))


def test_filters_are_compact():
    keys = quotient.count(*quotient.permute(np.arange(1 << 16, dtype=np.uint64), np.zeros(1 << 16, np.uint64), 24), 24)
    assert sum(len(data) for _, data in quotient.split(keys, 24, 4)) < 7 * len(keys.high)


def test_empty_filter():
    none = np.zeros(0, np.uint64)
    keys = quotient.count(none, none, 20)
    assert quotient.split(keys, 20, 3) == []
    assert len(quotient.decode(quotient.encode(keys, 20, 3, 2))[0].high) == 0
