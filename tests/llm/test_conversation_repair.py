import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from larder.llm import audit_paths, conversation_repair
from larder.llm.audit_paths import BLANK, DUPLICATE, FINE, TRUNCATED, cheapest
from tests.conftest import SF

ORDER = re.compile(r"(s?(ua)+)?")


def plain_cheapest(signs):
    """Whole audits as texts, the least (cost, audit) for every ending of the order."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def grow(best):
        for _ in range(4):
            for place, (cost, audit) in list(best.items()):
                for new in "ua":
                    to = step.get((place, new))
                    if to:
                        best[to] = min(best.get(to, (10**9, "")), (cost + 3, audit + "I"))
        return best

    best = grow({"": (0, "")})
    for sign in signs:
        kind, role = divmod(sign, 4)
        role, extra, after = "?sua"[role], 3 * (kind == TRUNCATED), {}
        for place, (cost, audit) in best.items():
            moves = [(place, 4, "D")]
            if kind not in (BLANK, DUPLICATE):
                moves += [(step.get((place, role)), extra, "K")] + [(step.get((place, n)), 3 + extra, "R") for n in "ua"]
            for to, more, edit in moves:
                if to is not None:
                    after[to] = min(after.get(to, (10**9, "")), (cost + more, audit + edit))
        best = grow(after)
    return min(best[p] for p in ("", "a") if p in best)


def every_audit(signs):
    """The least (cost, audit) of all audits of a few rows with a few rows put in."""
    found = []

    def go(i, roles, cost, audit, inserts):
        if i == len(signs) and ORDER.fullmatch(roles):
            found.append((cost, audit))
        if inserts < 4:
            for new in "ua":
                go(i, roles + new, cost + 3, audit + "I", inserts + 1)
        if i == len(signs):
            return
        kind, role = divmod(signs[i], 4)
        go(i + 1, roles, cost + 4, audit + "D", inserts)
        if kind not in (BLANK, DUPLICATE):
            extra = 3 * (kind == TRUNCATED)
            go(i + 1, roles + "?sua"[role], cost + extra, audit + "K", inserts)
            for new in "ua":
                go(i + 1, roles + new, cost + 3 + extra, audit + "R", inserts)

    go(0, "", 0, "", 0)
    return min(found)


def plain_rows(rows, damage):
    """{conv_id: rows in order} of (conv_id, turn, role, text)."""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        out[conv] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256, repaired rows)."""
    seen, signs = set(), []
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        kind = BLANK if not body else DUPLICATE if (role, text) in seen else FINE if body[-1] in ".!?" else TRUNCATED
        seen.add((role, text))
        signs.append(kind * 4 + ("sua".find(role[:1]) + 1 if role else 0))
    cost, audit = plain_cheapest(signs)
    out, at, place = [], 0, ""
    for edit in audit:
        wanted = "a" if place == "u" else "u"
        if edit == "K":
            out.append(rows[at][1:])
        elif edit != "D":
            out.append(({"u": "user", "a": "assistant"}[wanted], rows[at][2] if edit == "R" else ""))
        if edit != "D":
            place = out[-1][0][0]
        at += edit != "I"
    assert at == len(rows) and ORDER.fullmatch("".join(r[:1] for r, _ in out))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    kinds = [s // 4 for s in signs]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *(kinds.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit, digest), out


def check(spark, rows, damage, partitions=3):
    schema = "conv_id long, turn long, role string, text string, audit int, of int, digest int, id int, fault int"
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], schema).repartition(partitions)
    got = conversation_repair.digests(df, damage).collect()
    want = {c: plain_repair(r)[0] for c, r in plain_rows(rows, damage).items()}
    assert len(got) == len(want)
    assert {r[0]: tuple(r[1:]) for r in got} == want


SIGNS = st.lists(st.integers(0, 15), max_size=40)


@settings(max_examples=300, deadline=None)
@given(SIGNS, st.sampled_from([(1 << 61) - 1, 1, 3, 101]), st.sampled_from([2, 17, 40_000]))
def test_cheapest_equals_whole_texts(signs, modulus, settle):
    """Also with hashes that collide and with audits settled all the time."""
    assert cheapest(signs, modulus, settle) == plain_cheapest(signs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=3))
def test_cheapest_equals_every_audit(signs):
    assert cheapest(signs) == every_audit(signs)


@pytest.mark.parametrize("signs", [[2], [3], [2, 3], [1, 2, 3, 1], [2, 2, 3], [15], [0]], ids=str)
def test_few_roles_in_long(signs):
    rows = signs * (6_000 // len(signs))
    assert cheapest(rows, settle=500) == plain_cheapest(rows)


def test_nodes_stay_few():
    paths = audit_paths.Cheapest(settle=1_000)
    for i in range(50_000):
        paths.push((2, 3)[i % 2] + 4 * (i % 7 == 0))
    assert len(paths.audits.edit) <= paths.limit == 1_000


def random_rows(seed, conversations, longest):
    r = random.Random(seed)
    said = ["Yes.", "No!", "why", "a b?  ", "", " \t\x0b", None, "\U0001d4b3é.", "x\x85", "Two.\nLines.", "Yes. "]
    rows = []
    for conv in range(conversations):
        for turn in range(r.randrange(longest)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"])
            rows.append((conv, r.choice([turn, turn, turn, turn + 5, None]), role, r.choice(said) if r.random() < 0.6 else f"t{r.random()}."))
    return rows


@pytest.mark.parametrize("damage", [True, False])
@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_version(spark, seed, damage):
    check(spark, random_rows(seed, 60, 14), damage)


def test_edges(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (1, 0, "user", "x" * 200_000), (1, 1, "assistant", "done."),
        (2, None, "user", "A."), (2, 7, "user", "A."), (2, -4, "assistant", "B."), (3, 0, "", ""), (-9, 2**40, "assistant", "C."),
    ]
    check(spark, rows, True)
    check(spark, rows, False, partitions=1)
    check(spark, [(c, 0, "user", "A.") for c in range(60)], True)
    check(spark, [], True)


def test_one_long_conversation(spark):
    rows = [(5, i, ("user", "assistant")[i % 2], f"t{i % 2_500}.") for i in range(5_000)] + [(c, 0, "user", "A.") for c in range(40)]
    check(spark, rows, True)


def test_repaired_rows(spark):
    rows = random_rows(9, 30, 12)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in conversation_repair.repaired(df).collect())
    want = [(c, i, *r) for c, of in plain_rows(rows, False).items() for i, r in enumerate(plain_repair(of)[1])]
    assert got == sorted(want)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = entry.queries()["op13_conversation_repair"](spark, SF).collect()
    want = {c: plain_repair(r)[0] for c, r in plain_rows(rows, True).items()}
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(want)
