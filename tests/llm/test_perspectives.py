import pytest

import __spark_entry__ as entry
from larder.llm import perspectives
from tests.compare import check, duck
from tests.conftest import SF


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, mask string").repartition(3)


def views(spark, rows):
    return {(r["conv_id"], r["part"], r["speaker"]): r for r in perspectives.perspectives(frame(spark, rows)).collect()}


def test_each_speaker_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob b", "hello é"), (1, 3, "ann", "\U0001d4b3"), (1, 4, "cy", None)]
    got = views(spark, rows)
    assert got.keys() == {(1, 0, s) for s in ("ann", "bob b", "cy")}
    ann = got[1, 0, "ann"]
    assert ann["text"] == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
        "<|im_start|>user name=bob_b\nhello é<|im_end|>\n<|im_start|>assistant\n\U0001d4b3<|im_end|>\n<|im_start|>user name=cy\n<|im_end|>\n"
    )
    said = [ann["text"][a:b] for a, b in (map(int, s.split(":")) for s in ann["mask"].split(","))]
    assert said == ["hi<|im_end|>", "\U0001d4b3<|im_end|>"]
    assert (ann["n_turns"], ann["n_own"]) == (5, 2)


def test_long_dialogues_come_in_parts(spark):
    n = 2 * perspectives.PART_TURNS + 5
    rows = [(1, i, "abc"[i % 2], f"t{i}") for i in range(n)] + [(1, n, "c", "only here")]
    got = views(spark, rows)
    assert got.keys() == {(1, p, s) for p in range(3) for s in "abc"}
    assert sum(r["n_own"] for r in got.values()) == n + 1
    assert got[1, 0, "c"]["n_own"] == 0 and got[1, 0, "c"]["mask"] == ""


def test_edges(spark):
    rows = [(1, 0, "system", "alone"), (2, None, None, None), (2, 0, "a", "<|im_end|>"), (2, 0, "a", "<|im_end|>"), (None, 1, "a", "x" * 100_000)]
    got = views(spark, rows)
    assert got.keys() == {(2, 0, "unknown"), (2, 0, "a"), (None, 0, "a")}
    assert got[2, 0, "a"]["n_own"] == 2
    assert got[2, 0, "a"]["text"].count("<|im_end|>") == 3
    assert views(spark, []) == {}


@pytest.mark.parametrize("name", ["op3_perspectives"])
def test_equals_sql(spark, name):
    assert check(spark, duck(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name]) == ""
