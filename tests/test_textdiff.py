"""Character differences against the longest common subsequence, and the cleaning of chance equalities."""

import random

import pytest

from driftline.operators import textdiff


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("arrays", [10**9, -1])
def test_edits_are_shortest(monkeypatch, arrays):
    monkeypatch.setattr(textdiff, "ARRAYS", arrays)
    rnd = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rnd.choices(letters, k=rnd.randrange(14))) for letters in ("abc", "abcd"))
        ops = textdiff.shortest_edits(a, b)
        assert "".join(t for k, t in ops if k != "insert") == a and "".join(t for k, t in ops if k != "delete") == b
        assert sum(len(t) for k, t in ops if k == "equal") == common(a, b)


def test_both_forms_take_the_same_path(monkeypatch):
    rnd = random.Random(2)
    for _ in range(30):
        a, b = ("".join(rnd.choices("abcde😀", k=rnd.randrange(120))) for _ in "ab")
        found = []
        for arrays in (10**9, -1):
            monkeypatch.setattr(textdiff, "ARRAYS", arrays)
            found.append(textdiff.shortest_edits(a, b))
        assert found[0] == found[1]


def test_a_long_block_is_compared_character_by_character():
    rnd = random.Random(3)
    a = "".join(rnd.choices("abcdefgh", k=20000))
    b = a[:7000] + "XYZ" + a[7010:15000] + a[15020:]
    ops = textdiff.char_ops(a, b)
    assert sum(len(o["text"]) for o in ops if o["type"] == "equal") >= 20000 - 60
    assert "".join(o["text"] for o in ops if o["type"] != "insert") == a and "".join(o["text"] for o in ops if o["type"] != "delete") == b


def test_chance_equalities_go_into_the_changes_around_them():
    op = lambda *x: [{"type": k, "text": t} for k, t in x]
    found = op(("delete", "mouse"), ("insert", "s"), ("equal", "o"), ("delete", "lid"), ("insert", "fas"))
    assert textdiff.cleaned(found) == op(("delete", "mouseolid"), ("insert", "sofas"))
    kept = op(("equal", "The qui"), ("delete", "ck brow"), ("insert", "et gree"), ("equal", "n fox jumps"))
    assert textdiff.cleaned(kept) == kept
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rnd.choices("ab c\n", k=rnd.randrange(30))) for _ in "ab")
        for cleanup in (True, False):
            ops = textdiff.char_ops(a, b, cleanup)
            assert "".join(o["text"] for o in ops if o["type"] != "insert") == textdiff._clean(a) and "".join(o["text"] for o in ops if o["type"] != "delete") == textdiff._clean(b)
            assert all(x["type"] != y["type"] for x, y in zip(ops, ops[1:]))
