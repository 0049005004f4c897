import random

from larder.llm import substring_dedup
from tests.llm import brute
from tests.llm.conftest import EDGES, prose


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digests(df).collect()}


def test_equals_plain_version(documents):
    random.seed(1)
    passages = [prose(random.randint(15, 60), 1000 + i).split() for i in range(6)]
    rows = []
    for d in range(60):
        words = prose(random.randint(0, 150), d).split()
        for _ in range(random.randint(0, 3)):
            p = random.choice(passages)
            a = random.randint(0, len(p) - 1)
            at = random.randint(0, len(words))
            words[at:at] = p[a : a + random.randint(10, 60)]
        rows.append((d * 3, " ".join(words)))
    rows += [(500, rows[3][1]), (2, rows[3][1]), (501, "a " * 100), (502, "a b " * 40)]
    assert result(documents(rows)) == brute.repeats(rows)


def test_windows_of_exactly_twenty_words(documents):
    words = prose(60, 5).split()
    rows = [(1, " ".join(words)), (2, "x " + "\n".join(words[10:30]) + " y"), (3, " ".join(words[10:29]))]
    got = result(documents(rows))
    assert [got[d][1] for d in (1, 2, 3)] == [0, 20, 0]


def test_edges(documents):
    got = substring_dedup.digests(documents(EDGES)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in EDGES)
    plain = brute.repeats([r for r in EDGES if r[0] is not None])
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == plain[r["doc_id"]]


def test_repeated_rows_are_one_place(documents):
    text = prose(50, 3)
    got = [r["n_removed"] for r in substring_dedup.digests(documents([(4, text), (4, text), (6, text)])).orderBy("doc_id").collect()]
    assert got == [0, 0, 50]


def test_kept_text(documents):
    text = prose(40, 9)
    rows = substring_dedup.without_repeats(documents([(1, text), (2, f"head  {text}\ntail")])).collect()
    assert {r["doc_id"]: r["kept_text"] for r in rows} == {1: text, 2: "head tail"}


def test_empty_table(documents):
    assert result(documents([])) == {}
