import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from larder.llm import pii
from tests.llm.conftest import EDGES, prose

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4)
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def plain(text):
    found = []
    for n, (kind, rule) in enumerate(RULES.items()):
        found += [(m.start(), n, kind, m.end()) for m in re.finditer(rule, text or "") if valid(kind, m.group())]
    spans = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
    counts = tuple(sum(f[2] == k for f in found) for k in RULES)
    return (*counts, hashlib.sha256(spans.encode()).hexdigest())


def rule_part(r):
    return tuple(r[f"n_{k}"] for k in RULES) + (r["base_sha256"],)


def test_rules_equal_plain_version(documents):
    random.seed(2)
    bits = ["1.2.3.4", "a@b.c", "%", "+1 (555) 555-1234", "4111111111111111", "4111 1111-1111 1111", " ", "-", ".", "1", "0",
            "é", "\U0001d4b3", "@", "x", "255.1.2.300 ", "\n", "000.001.255.256", "+", "(", "99"]
    rows = [(i, "".join(random.choice(bits) for _ in range(random.randint(0, 25)))) for i in range(500)]
    got = {r["doc_id"]: rule_part(r) for r in pii.personal_data(documents(rows)).collect()}
    assert got == {d: plain(t) for d, t in rows}


@pytest.mark.parametrize("text", ["1" * 40_000, "a" * 100_000 + "@", "1." * 3_000, "+1" + "(" * 50_000, "a@b" + ".c" * 20_000, "1 " * 20_000])
def test_long_runs(documents, text):
    r = pii.personal_data(documents([(1, text)])).first()
    if "a" * 1000 not in text:
        assert rule_part(r) == plain(text)


def in_context(n):
    """Seeds behind two patterns, and identifiers that no rule knows behind the same."""
    rows = [(i, f"{prose(5, i)} reach me via user{i}@mail.example.com today {prose(5, i)}") for i in range(n)]
    return rows + [(100 + i, f"{prose(4, i)} reach me via ZX-{1000 + i}-77{i} today {prose(3, i)}") for i in range(4)]


def test_context_discovers_unseen_identifiers(documents):
    rows = in_context(20) + [(200, "order no 7777-1234 shipped"), (201, "in 20201231 nothing")]
    got = {r["doc_id"]: r for r in pii.personal_data(documents(rows)).collect()}
    for d, text in rows:
        found = [s for s in got[d]["spans"].split(",") if s.startswith("id:")]
        if 100 <= d < 104:
            _, a, b = found[0].split(":")
            assert text[int(a) : int(b)].startswith("ZX-")
        else:
            assert not found
        assert rule_part(got[d]) == plain(text)


def test_context_discovers_identifiers_of_few_digits(documents):
    """Every token in a trusted pattern is looked up, also far into a text, behind marks and without a null id."""
    texts = {
        300: "reach me via jane_doe today", 301: "reach me via AB-12-C today", None: f"reach  me\tvia\nJosé.", 302: "jane_doe went home",
        303: f" {prose(3_000, 3)}  reach me via mary_k today {prose(700, 4)}", 304: "reach me via (bob_x) today",
    }
    rows = [(i, f"reach me via user{i}@mail.example.com today") for i in range(60)] + list(texts.items())
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(documents(rows)).collect()}
    def at(d, token):
        start = texts[d].index(token)
        return f"id:{start}:{start + len(token)}"

    assert got[300] == at(300, "jane_doe") and got[301] == at(301, "AB-12-C") and got[None] == at(None, "José")
    assert got[303] == at(303, "mary_k")
    assert got[302] == got[304] == ""
    assert all(got[i] and "id:" not in got[i] for i in range(60))
    masked = {r["doc_id"]: r["text"] for r in pii.masked_documents(documents(rows)).collect()}
    assert masked[301] == "reach me via [ID] today" and masked[302] == texts[302]


def test_words_in_a_pattern_take_its_trust(documents):
    """A pattern that mostly holds common words finds nothing, however many seeds it has."""
    rows = [(i, f"reach me via user{i}@mail.example.com today") for i in range(20)]
    rows += [(100 + i, f"reach me via {w} today") for i, w in enumerate(dict.fromkeys(prose(200, 5).split()))]
    assert len(rows) > 50
    got = pii.personal_data(documents(rows)).collect()
    assert all(r["n_found"] == 0 for r in got)


def test_too_few_seeds_teach_nothing(documents):
    got = pii.personal_data(documents(in_context(pii.MIN_SUPPORT - 1))).collect()
    assert all(r["n_found"] == 0 for r in got)


def test_edges(documents):
    got = pii.personal_data(documents(EDGES)).collect()
    assert len(got) == len(EDGES)
    assert all(r["spans"] == "" for r in got)
    assert pii.personal_data(documents([])).count() == 0


def test_masked_documents(documents):
    rows = in_context(20) + [(500, "mail a.b@c.de or 1.2.3.4!"), (500, "mail a.b@c.de or 1.2.3.4!"), (300, None), (None, "x 1.2.3.4 y")]
    df = documents(rows)
    got = pii.masked_documents(df)
    assert got.columns == df.columns
    texts = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(texts) == len(rows)
    assert texts.count((500, "mail [EMAIL] or [IP]!")) == 2
    assert (300, None) in texts and (None, "x [IP] y") in texts
    assert all("[ID]" in t for d, t in texts if d in range(100, 104))


def test_no_python_in_the_plan(documents, capsys):
    pii.personal_data(documents(in_context(3))).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow", plan)


def test_plan_of_the_look_up_has_no_python(documents, capsys):
    rows = [(i, f"reach me via user{i}@mail.example.com today") for i in range(20)] + [(100, "reach me via jane_doe today")]
    scored = pii.staged(pii._scored(documents(rows)), "test")
    _, held = pii.trusted(scored)
    assert not held.isEmpty()
    pii._standing(documents(rows), pii._pattern_texts(scored, held)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_sifting_changes_no_result(documents, monkeypatch):
    """More than 64 trusted patterns, half of which mostly hold ordinary words."""
    words = list(dict.fromkeys(prose(400, 5).split()))[:30]
    rows = []
    for k in range(140):
        key = f"key{chr(97 + k // 26)}{chr(97 + k % 26)}"
        rows += [f"{key} word user{k}x{i}@mail.example.com {key}end" for i in range(10)]
        rows += [f"{key} word {w} {key}end" for w in (words if k % 2 else ["jane_doe", "mary_k"])]
    rows = list(enumerate(rows))
    got = sorted(map(tuple, pii.personal_data(documents(rows)).collect()))
    monkeypatch.setattr(pii, "SIFTING", ())
    assert got == sorted(map(tuple, pii.personal_data(documents(rows)).collect()))
    found = {r[0] for r in got if r[-1]}
    assert found == {d for d, t in rows if "jane_doe" in t or "mary_k" in t}


def test_masked_documents_with_any_column_names(documents):
    df = documents(in_context(20)).withColumn("PII_ID", F.lit(1)).withColumn("pii_spans", F.lit("x"))
    got = pii.masked_documents(df)
    assert got.columns == df.columns
    assert {(r["PII_ID"], r["pii_spans"]) for r in got.collect()} == {(1, "x")}


def test_only_places_of_sought_patterns_become_rows(documents):
    """Of the pieces behind a pattern's word, those with another word behind them make no rows, nor do a token's other patterns."""
    rows = [(i, f"via word{chr(97 + i % 26)} tomorrow and on") for i in range(200)]
    rows += [(300, "go via bob today x"), (301, "via jane, today"), (302, "via (mary) today"), (303, "via ann today"), (304, "via"), (305, "via eve.  today ")]
    texts = documents(rows).sparkSession.createDataFrame([("LR|via today",)], "text string").withColumn("pattern", F.xxhash64("text"))
    near = pii._pieces(documents(rows), texts)
    assert sorted(r[0] for r in near.select(F.trim("own")).collect()) == ["(mary)", "ann", "bob", "eve.", "jane,"]
    found = pii._standing(documents(rows), texts)
    assert sorted(r[0] for r in found.select("doc_id").collect()) == [300, 303]


def test_first_part_sifts_on_few_texts(documents, monkeypatch):
    """A frequent pattern that fails is looked up in a bounded part of the texts: before, in one of 64."""
    monkeypatch.setattr(pii, "SIFTED_TEXTS", 2)
    rows = [(i, f"reach me via user{i}@mail.example.com today") for i in range(20)]
    rows += [(100 + i, " ".join(f"reach me via {w} today" for w in prose(200, i).split())) for i in range(1100)]
    docs = documents(rows)
    scored = pii.staged(pii._scored(docs), "test")
    _, held = pii.trusted(scored)
    seen, standing = [], pii._standing
    monkeypatch.setattr(pii, "_standing", lambda some, texts: seen.append(some.count()) or standing(some, texts))
    assert not held.isEmpty()
    assert pii._standing_judged(docs, scored, held) is None
    assert len(seen) == 1 and 0 < seen[0] < len(rows) // 128
