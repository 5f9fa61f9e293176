import random

import pytest

from graphloom.llm import reading

EASY = ["The cat sat on the box and it was red.", "We look at the map first and then we go home.", "You can put the ball in the box here.", "There is a dog in the house and it is big."]
HARD = ["Were the epistemic commitment regarded as contingent, one would be obliged to concede that the ontological taxonomy, whose coherence is unfalsifiable, presumes an idempotent lattice.", "Notwithstanding the antecedent axiomatisation, the verisimilitude of its constituents precludes any parsimonious characterisation.",
        "That the order which, unless the rule whose point the guide would close is held, we skip should mark the bug is what the map which the letter had to count is meant to show."]


def test_prose_only():
    text = "# Heading words here\n\nThe list is short and\nit ends here. See `x.y` for that.\n\n```\nfunc the of and to is(a) {}\n```\n| a | b | c |\n2025-01-01T00:00:00 INFO the of and\n- We keep the old list in the box\n\nDer Index wird aus der Datei gelesen und ist neu.\n\nthe tallyvine/core/common package is read by the CloseFieldList handler."
    found = [" ".join(w) for w, _ in reading.prose_sentences(text)]
    assert "the list is short and it ends here" in found and any(s.startswith("we keep the old list") for s in found)
    assert not any("func" in s or "heading" in s or "wird" in s or "closefieldlist" in s or "common" in s.split() for s in found)


@pytest.mark.parametrize("text", ["", " \n\t", "```\nnever closed", "|||", "a", "日本語のテキストです。", "\x00 \ufffd", "the " * 50000])
def test_odd_texts(text):
    reading.prose_sentences(text)


def test_main_clauses():
    """A chain of plain clauses is many sentences; nested ones stay one, however long."""
    flat = "the form asks for the paper and then you join the screen and the note is bad and so you save the side but it counts the team".split()
    assert reading.main_clauses(flat) == 5
    assert reading.main_clauses(HARD[2].lower().replace(",", "").split()) == 1
    assert reading.main_clauses([]) == 1 and reading.main_clauses("and but so".split()) == 1 and reading.main_clauses("salt and the pepper".split()) == 1


def test_formula_alone_decides(spark):
    """A decision is a function of the two terms: nothing else about a document moves it."""
    docs, labels = corpus()
    got = run(spark, docs, labels).values()
    seen = {}
    for r in got:
        if r["level"] is not None:
            assert seen.setdefault((r["unfamiliar"], r["sentence_words"]), (r["demanding"], r["level"])) == (r["demanding"], r["level"])
    hard, easy = ([r for r in got if r["level"] is not None and r["demanding"] == d] for d in (True, False))
    for h in hard:  # nothing demanding is below something easy in both terms
        assert not any(e["unfamiliar"] > h["unfamiliar"] and e["sentence_words"] > h["sentence_words"] for e in easy)


def corpus(seed=0, n=240):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        hard = i % 4 == 0
        docs.append((i, " ".join(r.choice(HARD if hard else EASY) for _ in range(6)), "x"))
        labels += [(i, "r1", 5 if hard else r.choice([1, 2, 3])), (i, "r1", 5 if hard else 2), (i, "r2", None), (i, "r3", 9)]
    docs += [(9000, None, "x"), (9001, "", "x"), (9002, "Too short to say.", "x"), (9003, "Der Index wird gelesen und die Datei ist neu. " * 9, "x")]
    return docs, labels + [(77777, "r1", 4), (None, "r1", 4)]


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, level string")
    lab = spark.createDataFrame(labels, "doc_id long, rater string, level_no int")
    return {r["doc_id"]: r for r in reading.reading_levels(d, lab, shares=(0.3, 0.4)).collect()}


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    held = [x for x in labels if x[0] is None or x[0] % 3]
    got = run(spark, docs, held)
    assert len(got) == len(docs)
    test = [i for i in range(240) if i % 3 == 0]
    assert sum(got[i]["demanding"] == (i % 4 == 0) for i in test) >= 0.97 * len(test)
    assert got[0]["level"] > got[1]["level"]
    for i in (9000, 9001, 9002, 9003):
        assert got[i]["level"] is None and not got[i]["demanding"]


def test_without_labels(spark):
    docs, _ = corpus(1, 60)
    got = run(spark, docs, [])
    assert sum(got[i]["demanding"] == (i % 4 == 0) for i in range(60)) >= 50


def test_empty(spark):
    assert run(spark, [], []) == {}
