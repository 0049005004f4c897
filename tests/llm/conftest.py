import pytest

# Columns of names that the operators use themselves.
CLASHING = ("size", "key", "kind", "n", "part", "taken", "times", "of", "all", "base", "text_key", "_1", "class", "copy", "places", "rank", "vector")


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with clashing extra columns."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", 0, *range(len(CLASHING))) for r in rows]
        extra = ", ".join(f"`{c}` int" for c in CLASHING)
        schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make


def prose(n, seed):
    """n made-up words."""
    x, out = seed * 2654435761 % 2**32 + 1, []
    for _ in range(n):
        x = (1103515245 * x + 12345) % 2**31
        out.append("".join("etaoinsrhld"[x >> s & 7] for s in (3, 7, 11, 15)[: 2 + x % 3]))
    return " ".join(out)


# Null and empty texts, blanks, a null id, repeated rows, a very long text.
EDGES = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (None, "no id here"), (5, "short"), (5, "short"),
    (7, prose(60_000, 7)), (8, "   \U0001d4b3 é \x1c\x85"), (9, "x" * 5_000),
]
