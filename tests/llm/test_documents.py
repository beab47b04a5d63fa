"""Quality rules, line dedup, near duplicates, mixing, shards, pseudonyms and audio against plain Python."""

import random
import re
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import audio, components, lines, mixing, pii, quality, queries, sharding, simhash
from tests.llm.conftest import SF, prose
from tests.oracle import compare, connect

SPACE = "[ \t-\r]"


def words(text):
    return re.findall("[^ \t-\r]+", text or "")


# Queries with SQL


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    wanted = SimpleNamespace(run=queries.QUERIES[name], sql=queries.SQL[name])
    assert compare(spark, connect(SF), wanted, SF) is None


# Quality rules


def expected_figures(text):
    text = text or ""
    listed = words(text)
    windows = Counter(tuple(listed[i : i + 5]) for i in range(len(listed) - 4))
    covered = {i + k for i in range(len(listed) - 4) if windows[tuple(listed[i : i + 5])] > 1 for k in range(5)}
    with_word = [line for line in text.split("\n") if words(line)]
    return (
        len(listed),
        sum(map(len, listed)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(with_word) - len(set(with_word)),
        len(covered),
    )


def test_quality_figures(awkward):
    rows = quality.measure(awkward).collect()
    assert len(rows) == awkward.count()
    for row in rows:
        figures = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)
        assert figures == expected_figures(row.text)
        assert row.base_failed == (row.n_words < 10 or 100 * row.n_repeat_words > 20 * row.n_words)
        assert row.kept is not None and not (row.kept and row.base_failed)


def test_quality_filter_keeps_what_measure_keeps(awkward, nothing):
    measured = quality.measure(awkward).where("kept")
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, measured.select(*awkward.columns).collect()))
    assert quality.keep_good(nothing).collect() == [] and quality.measure(nothing).collect() == []


@pytest.mark.parametrize(
    "text, rule",
    [
        (" | ".join(WORD for WORD in prose(1, 60).split()), "few_symbols"),
        ("x" * 400 + " " + prose(1, 12), "word_length"),
        ("\n".join(["one line that repeats"] * 9), "few_duplicate_lines"),
        ("12 34 5 . .. " * 20 + prose(1, 10), "lettered_words"),
        (prose(1, 60).upper(), "few_capitals"),
        ("too short", "enough_words"),
        (prose(1, 12) + " " + prose(1, 12), "few_repeated_windows"),
    ],
)
def test_each_rule_rejects_its_case(spark, text, rule):
    frame = spark.createDataFrame([(text,), (prose(5, 80),)], "t string")
    chosen = [r for r in quality.BASE_RULES + quality.RULES if r.name == rule]
    assert [r[0] for r in frame.select(quality.verdict(F.col("t"), chosen)).collect()] == [False, True]


def test_rules_are_ordered_by_rejections_per_second(spark):
    """With the constants as they are, on a table smaller than the sample: rejections first, then costs."""
    rows = [(prose(n, 300).upper() if n % 2 else prose(n, 300),) for n in range(60)]
    docs = spark.createDataFrame(rows, "text string")
    lower = lambda f: f.text == F.lower(f.text)
    rules = [
        quality.Rule("never", lambda f: f.text.isNotNull()),
        quality.Rule("dear", lambda f: lower(f) & (f.n_repeat_words >= 0) & (quality.repeated_words(F.reverse(f.words)) >= 0)),
        quality.Rule("cheap", lower),
    ]
    assert [r.name for r in quality.order_rules(docs, rules)] == ["cheap", "dear", "never"]
    measured = {m.rule.name: m for m in quality.measure_rules(docs, rules)}
    assert [measured[name].rejected for name in ("never", "dear", "cheap")] == [0, 30, 30]
    assert measured["dear"].seconds > 2 * measured["cheap"].seconds
    assert quality.measure_rules(docs.limit(0), rules) == [] and quality.order_rules(docs.limit(0), rules) == rules


def test_quality_keeps_clean_documents(spark):
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    docs = queries.documents(spark, SF.replace("0.001", "0.01")).join(labels, "doc_id")
    rows = quality.measure(docs).groupBy("quality").agg(F.avg((~F.col("base_failed")).cast("int")), F.avg(F.col("kept").cast("int")))
    shares = {r[0]: (r[1], r[2]) for r in rows.collect()}
    assert shares[1][1] >= shares[1][0] - 0.01 and shares[0][1] < 0.05


# Line dedup


def expected_lines(rows, least=40, documents=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\r\x0b\x0c"))
    holders = defaultdict(set)
    rank = lambda doc: (doc is not None, doc)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(doc)
    shared = {k: max(d, key=rank) for k, d in holders.items() if len(d) >= documents}
    out = []
    for doc, text in rows:
        split = (text or "").split("\n")
        kept = [line for line in split if not (key(line) in shared and shared[key(line)] != doc)]
        out.append((str(doc), "\n".join(kept), len(split), len(split) - len(kept)))
    return sorted(out)


def test_line_dedup(awkward, nothing):
    rows = lines.drop_shared_lines(awkward)
    assert rows.columns == [*awkward.columns, "n_lines", "n_dropped"]
    found = sorted((str(r.doc_id), r.text or "", r.n_lines, r.n_dropped) for r in rows.collect())
    assert found == expected_lines([(r.doc_id, r.text) for r in awkward.collect()])
    assert sum(n for *_, n in found) == 10
    assert lines.drop_shared_lines(nothing).collect() == []


def test_line_dedup_limits(spark):
    rows = [(n % 5, ("A" * 40 + "\n") * 3 + "b" * 39) for n in range(10)] + [(None, " " + "a" * 40 + "\t\nrest")]
    rows += [(9, ""), (10, "c" * 50), (11, "c" * 50), (11, "c" * 50), (12, "C" * 50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((str(r.doc_id), r.text or "", r.n_lines, r.n_dropped) for r in lines.drop_shared_lines(docs).collect())
    assert found == expected_lines(rows)


# Near duplicates


def reference_fingerprint(text):
    listed = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not listed:
        return 0
    shingles = [" ".join(listed[i : i + 4]) for i in range(len(listed) - 3)] or [" ".join(listed)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Brute force: sets of linked fingerprints (unsigned)."""
    values = np.array(sorted(prints), np.uint64)
    parent = list(range(len(values)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for n, value in enumerate(values):
        for other in np.flatnonzero(np.bitwise_count(values ^ value) <= 4):
            a, b = sorted((root(n), root(int(other))))
            parent[b] = a
    out = defaultdict(set)
    for n, value in enumerate(values):
        out[root(n)].add(int(value))
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("crowd", [256, 4, 1])
def test_links_lose_no_component(spark, crowd):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(20)}
    for start in list(prints)[:6]:
        for _ in range(25):
            value = start
            for _ in range(rng.randint(1, 5)):
                value ^= 1 << rng.randrange(64)
            prints.add(value)
    chain = next(iter(prints))
    for _ in range(30):
        for bit in rng.sample(range(64), 4):
            chain ^= 1 << bit
        prints.add(chain)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = defaultdict(set)
    for row in simhash.components(spark.createDataFrame(signed, "fingerprint bigint"), crowd).collect():
        found[row.root].add(row.fingerprint % (1 << 64))
    assert {frozenset(v) for v in found.values()} == {c for c in classes(prints) if len(c) > 1}


def test_near_duplicates(awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    prints = {}
    for row in rows:
        assert int(row.fingerprint, 16) == reference_fingerprint(row.text)
        prints.setdefault(int(row.fingerprint, 16), []).append(row.doc_id)
    for linked in classes(prints):
        ids = [doc for p in linked for doc in prints[p] if doc is not None]
        assert {r.component_id for r in rows if int(r.fingerprint, 16) in linked} == {min(ids, default=None)}
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(classes(prints))
    assert simhash.near_duplicates(nothing).collect() == [] and simhash.keep_one(nothing).collect() == []


def test_near_duplicate_query(spark):
    rows = queries.op9_simhash_balls(spark, SF).collect()
    by_print = defaultdict(list)
    for row in rows:
        by_print[int(row.fingerprint, 16)].append(row.doc_id)
    for linked in classes(by_print):
        ids = {doc for p in linked for doc in by_print[p]}
        assert {r.component_id for r in rows if r.doc_id in ids} == {min(ids)}


def test_components_of_chains_and_stars(spark):
    links = [(n, n + 1) for n in range(200)] + [(1000, n) for n in range(1001, 1100)] + [(5000, 5000), (5001, 5000)]
    found = components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    wanted = {n: 0 for n in range(201)} | {n: 1000 for n in range(1000, 1100)} | {5000: 5000, 5001: 5000}
    assert {r.node: r.root for r in found} == wanted and len(found) == len(wanted)


# Mixing


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + n % 3 for n, s in enumerate(order)}
    left, full, out = float(sum(sizes.values())), set(), {}
    while True:
        level = left / max(1, sum(weight[s] for s in order if s not in full))
        over = {s for s in order if s not in full and level * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in order if s not in full}
        full |= over
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1, None: 5}, {"x": 0, "y": 7}, {"x": 0}, {"é": 3, "z": 3, "Z": 3}])
def test_targets(spark, sizes):
    docs = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    found = {r.source: r.target for r in mixing.source_targets(docs, "source", "size").collect()}
    assert found == pytest.approx(expected_targets(sizes))


def mixed(docs):
    rows = mixing.mix(docs).collect()
    sums = defaultdict(lambda: [0, 0, 0])
    for row in rows:
        assert row.taken == row.copies * row.size and 0 <= row.copies <= 3
        sums[row.source][0] += row.taken
        sums[row.source][1] = row.target
        sums[row.source][2] = max(sums[row.source][2], row.size)
    return rows, sums


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(n, rng.choice("aaaaaabcd"), int(rng.paretovariate(1.2) * 20)) for n in range(6000)]
    rows += [(7, "a", 30)] * 500 + [(8, None, 0), (9, None, 4), (None, "b", 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint").withColumn("copies", F.lit("x"))
    found, sums = mixed(docs)
    assert len(found) == len(rows)
    for taken, target, largest in sums.values():
        assert abs(taken - target) <= max(0.01 * target, largest)
    again, _ = mixed(docs.repartition(7))
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.copies)
    assert sorted(map(key, found)) == sorted(map(key, again))
    counts = Counter(r.source for r in found)
    for source, (_, target, _) in sums.items():
        expected = target / max(1, sum(r.size for r in found if r.source == source)) * counts[source]
        assert abs(sum(r.copies for r in found if r.source == source) - expected) < 1.01


def test_mix_of_equal_rows_and_odd_sizes(spark):
    """Thousands of equal rows are spread over blocks; null and negative sizes count as 0."""
    rows = [("a", 10)] * 3000 + [("b", n % 7 + 1) for n in range(2000)] + [("c", None), ("c", -4), (None, 5)]
    docs = spark.createDataFrame(rows, "source string, size bigint").repartition(6)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows) and all(0 <= r.copies <= 3 for r in found)
    for source in ("a", "b"):
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target
    assert all(r.taken == 0 and r.source_size == 0 for r in found if r.source == "c")
    units = spark.range(1000).select(F.struct(F.lit(7).alias("key"), F.col("id").alias("uid")).alias("unit"))
    assert mixing._with_turns(units).groupBy("turn").count().agg(F.max("count")).first()[0] == mixing.BLOCK_ROWS


def brute_targets(sizes):
    """Shares by weights 1, 2, 3 and so on, over sources by code point, null last; what passes three sizes is dealt anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {name: n % 3 + 1 for n, name in enumerate(names)}
    total, targets, open_names = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(targets.values())
        shares = {name: left * weights[name] / sum(weights[n] for n in open_names) for name in open_names}
        full = [name for name in open_names if shares[name] > 3 * sizes[name]]
        if not full:
            return {**targets, **shares}
        for name in full:
            targets[name] = 3 * sizes[name]
            open_names.remove(name)


def test_mix_query(spark):
    rows = queries.op4_source_mixing(spark, SF).collect()
    docs = {r.doc_id: r for r in queries.documents(spark, SF).collect()}
    words = {doc: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for doc, r in docs.items()}
    sizes = Counter()
    for doc, r in docs.items():
        sizes[r.source] += words[doc]
    targets, taken = brute_targets(sizes), Counter()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        source = docs[r.doc_id].source
        taken[source] += r.taken
        assert r.size == words[r.doc_id] and r.source_size == sizes[source] and r.target == pytest.approx(targets[source])
        assert r.taken in {0, r.size, 2 * r.size, 3 * r.size}
    largest = {s: max(words[d] for d, r in docs.items() if r.source == s) for s in sizes}
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in sizes)
    again = queries.op4_source_mixing(spark, SF).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in rows}


def test_mix_of_awkward_and_empty_tables(awkward, nothing):
    # ``size`` is a string column there: the operator is given another one.
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(quality.WORD)).cast("bigint")
    found = mixing.mix(awkward.withColumn("n", size), "n")
    assert found.count() == awkward.count() and "extra" in found.columns
    assert mixing.mix(nothing.withColumn("n", size), "n").collect() == []
    repeated = mixing.repeat_copies(found, awkward.columns)
    assert repeated.count() == found.agg(F.sum("copies")).first()[0]


# Shards


def skewed_rows():
    rng = random.Random(4)
    rows = [(n, rng.getrandbits(63), int(rng.paretovariate(2) * 50)) for n in range(8000)]
    # One hash holds a third of the rows, one id a tenth, and many rows are as small as can be.
    return rows + [(10_000 + n, 77, 60) for n in range(4000)] + [(5, 99, 10)] * 1200 + [(None, -5, 1)] * 500


def good_shards(found, count):
    """Sizes near equal, slots without gaps, and keys in order over the shards."""
    sizes, slots = Counter(), defaultdict(list)
    for row in found:
        sizes[row.shard] += row.size
        slots[row.shard].append(row.slot)
    fair = sum(sizes.values()) / 16
    order = [(r.h, -1 if r.doc_id is None else r.doc_id) for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    return (
        len(found) == count
        and set(slots) == set(range(16))
        and all(sorted(s) == list(range(len(s))) for s in slots.values())
        and all(abs(size - fair) <= max(r.size for r in found) for size in sizes.values())
        and order == sorted(order)
    )


def test_shards(spark):
    rows = skewed_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, h bigint, size bigint").withColumn("slot", F.lit("x"))
    assert good_shards(sharding.shard_by_size(docs, "h", "doc_id", "size").collect(), len(rows))


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    """Two first ranges, and four parts at once: several rounds, after which no range is overfull."""
    monkeypatch.setattr(sharding, "MAX_RANGES", 2)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 128)
    monkeypatch.setattr(sharding, "PARTS", 8)
    rows, seen = skewed_rows(), []
    whole = sharding._subdivide
    monkeypatch.setattr(sharding, "_subdivide", lambda *given: seen.append(whole(*given)) or seen[-1])
    docs = spark.createDataFrame(rows, "doc_id bigint, h bigint, size bigint").withColumns({"n": F.lit("x"), "r": F.lit(1)})
    assert good_shards(sharding.shard_by_size(docs, "h", "doc_id", "size").collect(), len(rows))
    _, stats, rounds = seen[0]
    counts = [r.n for r in stats.collect()]
    assert rounds >= 2 and sum(counts) == len(rows) and max(counts) <= sharding.OVERFULL * 128 and len(counts) > 30


def test_shards_of_awkward_rows(spark):
    rows = [(None, None, None), (1, None, -5), (2, 9, None), (3, 9, 100), (3, 9, 100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, h bigint, size bigint").withColumn("__llm", F.lit(1))
    found = sharding.shard_by_size(docs, "h", "doc_id", "size", shards=2).collect()
    assert sorted((r.shard, r.slot) for r in found) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0)]
    assert [r.doc_id for r in sorted(found, key=lambda r: (r.shard, r.slot))][-2:] == [3, 3]


def test_shards_of_few_and_no_rows(spark):
    docs = spark.createDataFrame([(1, 5, 3), (2, 6, 4)], "doc_id bigint, h bigint, size bigint")
    assert sharding.shard_by_size(docs, "h", "doc_id", "size").count() == 2
    assert sharding.shard_by_size(docs.limit(0), "h", "doc_id", "size").collect() == []


def test_shard_query(spark):
    rows = queries.op7_sampled_splitters(spark, SF).collect()
    texts = {r.doc_id: r.text for r in queries.documents(spark, SF).collect()}
    for row in rows:
        raw = texts[row.doc_id].encode()
        assert (row.size, row.text_crc32, row.law, row.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes, slots, shards = Counter(), defaultdict(list), defaultdict(set)
    for row in rows:
        sizes[row.shard] += row.size
        slots[row.shard].append(row.slot)
        shards[texts[row.doc_id]].add(row.shard)
    assert all(sorted(places) == list(range(len(places))) for places in slots.values()) and set(sizes) == set(range(16))
    assert all(abs(size - sum(sizes.values()) / 16) <= max(r.size for r in rows) for size in sizes.values())
    # Equal texts lie side by side: in one shard, or in the two at whose border they are.
    assert all(max(found) - min(found) <= 1 for found in shards.values())


# Pseudonyms

KEY = b"0123456789abcdef"
VALUES = {
    "email": ["und.34@mail7.example.com", "ÑandÉ.1@x.org"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    "ymd": ["2024-02-29"],
    "ip": ["97.51.17.173"],
    "dmy": ["29.02.2024", "12/31/1999"],
    "phone": ["+1 (017) 555-7713", "(415) 555-1234", "415-555-1234", "+49 30 1234567"],
    "ssn": ["123-45-6789", "667-01-0001", "665-99-9999"],
    "card": ["4111 1111 1111 1111", "4845168114407329", "378282246310005"],
    "secret": ["04dbebab91ab85687d33eeaaf9ac699e1188f962"],
}


@pytest.mark.parametrize("kind, value", [(k, v) for k, vs in VALUES.items() for v in vs])
def test_pseudonyms(kind, value):
    other = pii.pseudonym(kind, value, KEY)
    assert other != value and pii.pseudonym(kind, other, KEY, True) == value
    form = lambda text: re.sub(r"\w+", "x", text)
    assert form(other) == form(value)
    text, count = pii.replace(f'{value}, to {value}.\n"{value}"%%% {value}!!', KEY)
    assert count == 4 and text == f'{other}, to {other}.\n"{other}"%%% {other}!!'
    assert pii.pseudonym(kind, value, KEY[::-1]) != other


@pytest.mark.parametrize(
    "text",
    ["4845168114407328", "0000 0000 0000 0000", "2023-02-29", "31.04.2020", "300.1.1.1", "000-12-3456", "GB83 WEST 1234 5698 7654 32",
     "version 1.2.3", "call 12 or 345", "a@b", "1899-12-31", "deadbeefdeadbeefdeadbeefdeadbeef of", "x" * 40, "12345678901"],
)
def test_what_fails_validation_stays(text):
    assert pii.replace(f"see {text} here", KEY) == (f"see {text} here", 0) or "deadbeef" in text


@pytest.mark.parametrize("size", [1, 2, 3, 10, 1000])
def test_permutations(size):
    image = [pii.permute(n, size, KEY, "t") for n in range(size)]
    assert sorted(image) == list(range(size)) and [pii.permute(n, size, KEY, "t", True) for n in image] == list(range(size))


def test_pseudonymize_documents(spark, awkward, nothing):
    value = "+1 (017) 555-7713"
    docs = spark.createDataFrame([(1, f"call {value} now"), (2, f"{value}\n4845168114407329"), (3, None), (4, "none")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pii.pseudonymize(docs, KEY).collect()}
    other = pii.pseudonym("phone", value, KEY)
    assert rows[1].text == f"call {other} now" and rows[2].text.startswith(other) and rows[2].n_values == 2
    assert (rows[3].text, rows[3].n_values, rows[4].text, rows[4].n_values) == (None, 0, "none", 0)
    for row, old in zip(pii.pseudonymize(awkward, KEY).collect(), awkward.collect()):
        assert (row.doc_id, row.text, row.n_values) == (old.doc_id, old.text, 0)
    assert pii.pseudonymize(nothing, KEY).collect() == []


def test_keys_of_either_case():
    lower = VALUES["secret"][0]
    mixed = lower[:20].upper() + lower[20:]
    other = pii.pseudonym("secret", lower, KEY)
    assert pii.replace(f'TOKEN = "{lower.upper()}"', KEY) == (f'TOKEN = "{other.upper()}"', 1)
    assert pii.pseudonym("secret", other.upper(), KEY, True) == lower.upper()
    text, count = pii.replace(f"{mixed};", KEY)
    assert count == 1 and text != f"{mixed};" and text not in (text.lower(), text.upper())
    assert pii.pseudonym("secret", text[:-1], KEY, True) == mixed


@pytest.mark.parametrize(
    "kind, value, after",
    [("ymd", "2024-01-05", "T10:00:00Z"), ("ymd", "2024-01-05", "Z"), ("dmy", "05.01.2024", "T10:00"), ("dmy", "25/12/2024", " 10:00"),
     ("phone", "+442079460958", ""), ("phone", "+123456789012345", ", 3"), ("iban", "BE68 5390 0754 7034", " EUR"),
     ("iban", "BE68539007547034", " EURO 1234"), ("iban", "ES91 2100 0418 4502 0005 1332", " ABCD"),
     ("iban", "PL61 1090 1014 0000 0712 1981 2874", " A1"), ("iban", "DE89 3704 0044 0532 0130 00", " EUR")],
)
def test_forms_of_values(kind, value, after):
    other = pii.pseudonym(kind, value, KEY)
    assert other != value and pii.pseudonym(kind, other, KEY, True) == value
    assert pii.replace(f"see {value}{after} here", KEY) == (f"see {other}{after} here", 1)
    assert pii.replace(f"see {other} here", KEY)[1] == 1


def test_value_behind_an_iban():
    ibans, days = "BE68 5390 0754 7034", "2024-01-05"
    wanted = f"{pii.pseudonym('iban', ibans, KEY)} {pii.pseudonym('ymd', days, KEY)}"
    assert pii.replace(f"{ibans} {days}", KEY) == (wanted, 2)


def test_day_first_dates_stay_day_first():
    days = [f"{day}/{month:02d}/2024" for month in range(1, 13) for day in range(13, 29)]
    others = [pii.pseudonym("dmy", day, KEY) for day in days]
    assert len(set(others)) == len(days) and all(12 < int(o[:2]) <= 31 and int(o[3:5]) <= 12 for o in others)
    assert [pii.pseudonym("dmy", o, KEY, True) for o in others] == days
    assert pii.replace("31/02/2024 or 25/13/2024", KEY)[1] == 0


@pytest.mark.parametrize(
    "value",
    ["иван.петров@почта.рф", "Łukasz.Żółć@świat.pl", "νίκος@παράδειγμα.ελ", "王小明@例子.中国", "jose\u0301@x.org",
     "नमस्ते@उदाहरण.भारत", "علی\u200cرضا@مثال.ir", "ǅ\u212bĸ@x.org", "Иван7@mail.example.com"],
)
def test_addresses_in_any_script(value):
    other = pii.pseudonym("email", value, KEY)
    assert pii.replace(f"({value}), <{value}>", KEY) == (f"({other}), <{other}>", 2)
    assert pii.pseudonym("email", other, KEY, True) == value and len(other) == len(value)
    # No letter stays as it is in all addresses of this form, and none changes its category.
    name, top = value.rpartition(".")[::2]
    images = [pii.pseudonym("email", value, bytes([n]) * 16) for n in range(40)]
    for place, letter in enumerate(name):
        seen = {image[place] for image in images}
        assert (len(seen) > 1) == (unicodedata.category(letter)[0] in "LNM")
    assert all(image.endswith("." + top) for image in images)


def test_every_letter_has_an_alphabet():
    for letter in map(chr, range(sys.maxunicode + 1)):
        if letter.isalnum() or unicodedata.category(letter)[0] == "M":
            kind = pii._alphabet(letter)
            assert len(kind) > 1 and letter in kind
    # Nothing to permute, nothing replaced.
    assert pii.replace("_@-.com", KEY) == ("_@-.com", 0)


@pytest.mark.parametrize("kind, value", [("card", "４８４５１６８１１４４０７３２９"), ("phone", "+٤٤ ٢٠ ٧٩٤٦ ٠٩٥٨")])
def test_digits_of_other_scripts(kind, value):
    other = pii.pseudonym(kind, value, KEY)
    assert pii.replace(value, KEY) == (other, 1) and pii.pseudonym(kind, other, KEY, True) == value
    assert sum(a != b for a, b in zip(value, other)) > 3 and not re.search("[0-9]", other)


def test_digits_of_other_scripts_in_texts(spark):
    """Values without any ASCII digit or at sign, through the operator, in their script and undone."""
    arabic = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
    hindi = str.maketrans("0123456789", "०१२३४५६७८९")
    values = {"ymd": "2024-01-05", "phone": "+966 55 123 4567", "dmy": "25.12.2024", "ip": "192.168.10.7", "ssn": "123-45-6789"}
    rows = [(kind, f"قبل {value.translate(script)} بعد") for kind, value in values.items() for script in (arabic, hindi)]
    df = spark.createDataFrame(rows, "kind string, text string")
    made = pii.pseudonymize(df.withColumn("old", F.col("text")), KEY).collect()
    assert len(made) == 10
    for row in made:
        assert row.n_values == 1 and row.text != row.old and not re.search("[0-9]", row.text)
        script = arabic if row.old.translate({v: None for v in arabic.values()}) != row.old else hindi
        assert set(filter(str.isdecimal, row.text)) <= set("0123456789".translate(script))
        assert pii.pseudonym(row.kind, row.text[4:-4], KEY, True) == row.old[4:-4]


def test_planted_values_are_gone(spark):
    texts = {r.doc_id: r.text for r in queries.documents(spark, SF.replace("0.001", "0.01")).collect()}
    planted = r"\S+@mail\d\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b"
    seen = 0
    for row in queries.op5_pii_pseudonyms(spark, SF.replace("0.001", "0.01")).collect():
        for value in re.findall(planted, texts[row.doc_id]):
            seen += 1
            assert value not in row.text
        if not re.search("[0-9@]", texts[row.doc_id]):
            assert row.text == texts[row.doc_id] and row.n_values == 0
    assert seen > 20


# Audio


def sound(notes):
    hertz = np.repeat(220 * 2 ** (np.array(notes) / 12), 512)
    return np.sin(2 * np.pi * np.cumsum(hertz) / audio.RATE)


def raw(samples):
    return (np.clip(samples, -1, 1) * 16000).astype("<i2").tobytes()


def test_alignment_of_noisy_and_cut_recordings(spark):
    rng = np.random.default_rng(0)
    whole, other = sound(rng.integers(-12, 12, 64)), sound(rng.integers(-12, 12, 64))
    table = [
        (1, raw(whole)), (2, raw(whole)), (3, raw(other)), (50, raw(whole + rng.normal(0, 0.05, len(whole)))),
        (100, raw(whole[audio.HOP * 20 :])), (150, None), (200, b"\x01"), (250, raw(np.zeros(20_000))), (300, raw(np.zeros(20_000))),
    ]
    recordings = spark.createDataFrame(table, "rec_id bigint, audio binary").withColumn("votes", F.lit("x"))
    prints = recordings.select("rec_id", audio.fingerprint(F.col("audio")).alias("ints"))
    rows = audio.align_recordings(prints, F.col("rec_id") % 50 == 0).collect()
    found = {(r.rec_id, r.match_class): r for r in rows}
    assert found[50, 1].offset == 0 and found[100, 1].offset == 20 and (100, 50) in found
    assert not any(r.match_class == 3 for r in rows)
    # Copies and silent recordings are classes; recordings without integers match nothing.
    by_id = {r.rec_id: r for r in rows}
    assert by_id[2].class_id == 1 and by_id[300].class_id == 250 and by_id[200].class_id == 150
    assert by_id[150].n_ints == 0 and by_id[150].match_class is None and {r.rec_id for r in rows} == {t[0] for t in table}


def quoting(rng, shared, before, behind, noise=0.0):
    """Integers of a recording with the notes ``shared`` between unrelated ones."""
    samples = sound(np.concatenate([rng.integers(-12, 12, before), shared, rng.integers(-12, 12, behind)]))
    return audio.packed(audio.chroma(samples + rng.normal(0, noise, len(samples))))


def test_recall_of_quotes(spark):
    """Each query shares a passage of 24 notes, two frames a note, with one recording only, both of them long."""
    rng = np.random.default_rng(1)
    table, wanted = [], {}
    for n in range(20):
        shared, first, second = rng.integers(-12, 12, 24), *map(int, rng.integers(0, 150, 2))
        query = quoting(rng, shared, first, 150 - first, 0.02)
        table += [(100 * n, query.tolist()), (100 * n + 1, quoting(rng, shared, second, 150 - second, 0.02).tolist())]
        wanted[100 * n, 100 * n + 1] = 2 * (second - first), 2 * first
    prints = spark.createDataFrame(table, "rec_id bigint, ints array<int>")
    rows = [r for r in audio.align_recordings(prints, F.col("rec_id") % 100 == 0).collect() if r.match_class is not None]
    found = {(r.rec_id, r.match_class): r for r in rows}
    assert set(found) == set(wanted) and len(rows) == len(wanted)
    for pair, (offset, begin) in wanted.items():
        row = found[pair]
        assert row.offset == offset and abs(row.begin - begin) <= audio.MAX_WIDTH and 24 <= row.overlap <= 72
        assert row.bit_errors <= 32 * audio.MAX_BIT_ERROR * row.overlap


def shifted(rng, shared, shift, count, before=75, behind=75, noise=0.02):
    """Integers, by phase, of a recording that starts ``shift`` samples late."""
    samples = sound(np.concatenate([rng.integers(-12, 12, before), shared, rng.integers(-12, 12, behind)]))[shift:]
    samples = samples + rng.normal(0, noise, len(samples))
    return [audio.packed(audio.chroma(samples[audio.HOP * n // count :])).tolist() for n in range(count)]


def test_recall_at_random_shifts(spark):
    """Quotes of 24, 48 and 100 notes between the steps of time: at least nine of ten are found, and no others."""
    rng = np.random.default_rng(4)
    table, wanted = [], {}
    for n in range(45):
        shared, shift = rng.integers(-12, 12, (24, 48, 100)[n % 3]), int(rng.integers(0, audio.HOP))
        query = shifted(rng, shared, 0, audio.PHASES)
        table += [(100 * n, query[0], query), (100 * n + 1, shifted(rng, shared, shift, 1)[0], None)]
        wanted[100 * n, 100 * n + 1] = -shift / audio.HOP
    prints = spark.createDataFrame(table, "rec_id bigint, ints array<int>, phases array<array<int>>")
    rows = audio.align_recordings(prints, F.col("rec_id") % 100 == 0, phases_col="phases").collect()
    found = {(r.rec_id, r.match_class): r.offset - r.phase / audio.PHASES for r in rows if r.match_class is not None}
    assert set(found) <= set(wanted) and all(abs(found[pair] - wanted[pair]) <= 1 for pair in found)
    for kind in range(3):
        assert sum((100 * n, 100 * n + 1) in found for n in range(kind, 45, 3)) >= 0.9 * 15


def test_offset_votes_match_all_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    for at_once in (1 << 22, 50):
        monkeypatch.setattr(audio, "VOTES_AT_ONCE", at_once)
        for size in (0, 1, 30, 200):
            query, other = rng.integers(0, 9, size) ** 2, np.concatenate([np.zeros(size // 2, int), rng.integers(0, 9, 90) ** 2])
            plain = np.zeros(len(query) + len(other) + 1, int)
            for i, j in zip(*np.nonzero(query[:, None] == other[None, :])):
                plain[j - i + len(query)] += 1
            assert (audio._offset_votes(query, other) == plain).all()


def test_null_ids_and_clashing_names(spark):
    ints = quoting(np.random.default_rng(6), np.arange(40) % 13, 0, 0).tolist()
    schema = "class_id bigint, ints array<int>, offset string, phase string"
    rows = [(1, ints, "x", "y"), (None, ints, "x", "y"), (50, ints[2:], None, None), (100, None, None, None)]
    made = audio.align_recordings(spark.createDataFrame(rows, schema), F.col("class_id") % 50 == 0, "class_id")
    assert sorted((r[0], r[1], r["match_class"], r["offset"]) for r in made.collect()) == [(1, 1, None, None), (50, 50, 1, 2), (100, 100, None, None)]
    assert audio.align_recordings(spark.createDataFrame([], schema), F.lit(True), "class_id").count() == 0


def test_silence_does_not_outvote_shared_sound():
    rng = np.random.default_rng(2)
    shared, still = rng.integers(-12, 12, 40), np.zeros(240 * audio.HOP)
    whole = [sound(np.concatenate([rng.integers(-12, 12, n), shared])) for n in (10, 30)]
    query = audio.packed(audio.chroma(np.concatenate([still, whole[0]])))
    other = audio.packed(audio.chroma(np.concatenate([whole[1], still])))
    assert 2 * 30 - 240 - 2 * 10 in {run[0] for run in audio.alignments(query, other)}
    # Silence alone is no shared sound of two recordings.
    apart = [np.concatenate([still, sound(rng.integers(-12, 12, 300))]) for _ in range(2)]
    lone = [audio.packed(audio.chroma(a)) for a in (apart[0], np.concatenate([apart[1], still]))]
    assert all(run[1] >= audio.VOTE_SHARE * (len(lone[0]) - 1) for run in audio.alignments(*lone))


def test_two_quotes_at_two_offsets():
    rng = np.random.default_rng(3)
    one, two = rng.integers(-12, 12, (2, 40))
    query = quoting(rng, np.concatenate([one, rng.integers(-12, 12, 80), two]), 5, 5)
    other = quoting(rng, np.concatenate([two, rng.integers(-12, 12, 50), one]), 9, 9)
    assert {(run[0], run[4] // 40) for run in audio.alignments(query, other)} == {(2 * (9 + 90 - 5), 0), (2 * (9 - 125), 6)}


def test_audio_query_matches_brute_force(spark):
    rows = queries.op6_audio_fingerprints(spark, SF).collect()
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    by_id = {r.vec_id: r.embedding for r in vectors.collect()}
    medley = [(v, by_id[v][:32] + by_id.get(v - v % 50, by_id[v])[32:]) for v in by_id]
    sounded = spark.createDataFrame(medley, "vec_id bigint, notes array<double>")
    ints = {r[0]: np.array(r[1], np.int32) for r in sounded.select("vec_id", audio.fingerprint(F.col("notes"), decode=queries.sounded)).collect()}
    heard = sounded.where("vec_id % 50 = 0").select("vec_id", audio.phases(F.col("notes"), decode=queries.sounded).alias("p")).collect()
    by_phase = {r.vec_id: [np.array(x, np.int32) for x in r.p] for r in heard}
    firsts = {}
    for vec in sorted(ints):
        firsts.setdefault(ints[vec].tobytes(), vec)

    def at_offset(query, other, offset):
        """Equal pairs and differing bits of the overlap, one integer after the other."""
        places = [i for i in range(len(query)) if 0 <= i + offset < len(other)]
        same = [query[i] == other[i + offset] for i in places]
        bits = sum(int(query[i] ^ other[i + offset]).bit_count() if query[i] ^ other[i + offset] >= 0 else
                   (int(query[i] ^ other[i + offset]) & 0xFFFFFFFF).bit_count() for i in places)
        return sum(a and b for a, b in zip(same, same[1:])), bits, len(places)

    found = {(r.vec_id, r.match_class): r for r in rows if r.match_class is not None}
    # Every run that is returned holds what it says, by count.
    for r in rows:
        if r.match_class is not None:
            part = by_phase[r.vec_id][r.phase][r.begin : r.begin + r.overlap]
            votes, errors, length = at_offset(part, ints[r.match_class], r.offset + r.begin)
            assert (votes, errors, length) == (r.votes, r.bit_errors, r.overlap)
            assert length >= 16 and errors <= 32 * audio.MAX_BIT_ERROR * length
    # Every pair of one query's share of pairs at any offset and phase is found.
    wanted = 0
    for query in sorted(by_phase)[:2]:
        for other in firsts.values():
            if other == firsts[ints[query].tobytes()]:
                continue
            for phase in (0, 3):
                own, theirs = by_phase[query][phase], ints[other]
                for offset in range(16 - len(own), len(theirs) - 15):
                    low, high = max(0, -offset), min(len(own), len(theirs) - offset)
                    same = own[low:high] == theirs[low + offset : high + offset]
                    if (same[1:] & same[:-1]).sum() >= audio.VOTE_SHARE * (len(own) - 1):
                        votes, errors, length = at_offset(own, theirs, offset)
                        if errors <= 32 * audio.MAX_BIT_ERROR * length:
                            wanted += 1
                            assert (query, other) in found
    assert {r.vec_id for r in rows} == set(by_id) and wanted
