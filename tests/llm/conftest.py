import pytest

SF = "/root/testdata/sf0.001"

WORDS = "the of and house river stone light paper green seven walks under over again never".split()


def prose(seed: int, count: int) -> str:
    """Words in an order that repeats no window of five."""
    out, state = [], seed * 7919 + 1
    for number in range(count):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 16) % len(WORDS)] + (str(number) if number % 3 == 0 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and names that operators use themselves."""
    shared = "This line stands in many documents, and is long enough.\n"
    rows = [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \t\r\n ", None),
        (None, prose(1, 50), "b"),
        (5, prose(2, 60), "b"),
        (5, prose(2, 60), "b"),
        (6, prose(2, 60), None),
        (7, "\n".join(prose(n, 40) for n in range(400)), "c"),
        (8, "x" * 100_000, "c"),
        (9, "Ünïcode ÉÈ ß, 日本語 🙂 <|endoftext|> it's here\x00\x1c é", "d"),
    ]
    rows += [(20 + n, shared + prose(50 + n, 30) + "\n" + shared.upper().strip(), "d") for n in range(6)]
    rows.append((25, shared + prose(90, 30), "d"))
    table = [
        (doc, text, source, "kept", "kept", "kept", "kept", "kept", None if n % 2 else n)
        for n, (doc, text, source) in enumerate(rows)
    ]
    names = "n_tokens string, ids string, size string, shard string, fingerprint string, extra int"
    return spark.createDataFrame(table, f"doc_id bigint, text string, source string, {names}").repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
