import pytest

LONG = " ".join(f"word{i % 977} and more{i % 31}" for i in range(40_000))

# Nulls in any column, empty and long texts, ties, repeated rows, and clashing names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, h long, node string, `a.b` int"
ROWS = [
    (1, None, "en", "s", 0, "x", 1, "n", 1),
    (2, "", None, None, None, None, None, None, None),
    (3, " \n\t ", "de", "s", 3, "x", 1, "n", 1),
    (4, LONG, "en", "s", None, "x", 1, "n", 1),
    (None, "a null id has these few words too", "en", "s", 9, "x", 1, "n", 1),
    (6, "the same words stand in each of these rows today", "en", "s", 9, "x", 1, "n", 1),
    (6, "the same words stand in each of these rows today", "en", "s", 9, "x", 1, "n", 1),
    (7, "the same words stand in each of these rows today", None, "s", 9, "x", 1, "n", 1),
    (8, "42 + 17 = 59!", "fr", "s", 9, "x", 1, "n", 1),
    (8, "one id and another text", "fr", "s", 9, "x", 1, "n", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def union_find(nodes, edges):
    """The least node of each node's component."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
