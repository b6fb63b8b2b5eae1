import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba co di fu ge hi jo ka lu me".split() for b in "ran sto ti vel wo xen yul zim por que".split()]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (".\n" if r.random() < 0.08 else "") for _ in range(n)).replace("\n ", "\n")


def edge_rows() -> list[tuple]:
    """Nulls in every column, blank and very long texts, repeated rows, white space at edges, other scripts."""
    texts = [None, "", " ", "\n\n", "one", "two words", "a  b\n c ", " lead", "trail ", "x" * 5000, "<|endoftext|> <s> </s>", "你好 世界", "é" * 300, "tab\tand\x0bothers\x0c", prose(1, 20000), prose(2, 300), prose(2, 300), "nul\x00byte"]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[15], (None, "null id", None, None, None), (100, prose(3, 80), None, None, 1)]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Documents with extra columns whose names operators use themselves."""
    names = "_row _text host text_ id ids n_lines n_dropped_lines log_weight sample_key kept node n piece measured n_words component_id".split()
    row = (1, prose(5, 60), "en", "s0", 7, *["x"] * len(names))
    return spark.createDataFrame([row, (2, None, None, None, None, *[None] * len(names))], SCHEMA + "".join(f", `{n}` string" for n in names))
