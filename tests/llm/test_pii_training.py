"""The trained field: marginals against full enumeration, and what hidden matches are told from."""

import itertools

import numpy as np

from tallyloom.llm import pii


def exact(model, g):
    """Marginals from the sum over all labellings of the nodes that are not observed."""
    own = model.own(g) + model.distant * g.alike
    free = np.flatnonzero(g.label < 0)
    edges = [(i, j, model.near) for i, j in g.near] + [(i, j, model.distant) for i, j in g.repeats]
    total = np.zeros((len(g.words), pii.OTHER + 1))
    y = g.label.copy()
    for labels in itertools.product(range(pii.OTHER + 1), repeat=len(free)):
        y[free] = labels
        weight = np.exp(sum(own[i, y[i]] for i in free) + sum(pull * (y[i] == y[j]) for i, j, pull in edges))
        total[np.arange(len(y)), y] += weight
    return total / total.sum(1, keepdims=True)


def model(near=1.2, distant=1.5):
    m = pii.Potentials([("1a@30", 0, 60), ("200", 3, 9), ("300", 4, 12)])
    m.near, m.distant = near, distant
    m.beside = {"<call": np.array([0, 0, 0, 1.0, 0]), ">now": np.array([0, 0, 0.5, 0, 0.5])}
    return m


def marginals(text, m):
    g = pii.Graph(text, *pii.base_spans(text))
    return m.marginals(g), exact(m, g), g


def test_trees_are_exact():
    """Words in a row, and a repetition: no loop, so message passing gives the marginals."""
    for text in ("call 555 1234 now", "1234567 and x 1234567 call 99 9 now", "kim.77@mail.example.com says kim.77 and 12", "7 8 9 10 11 call 12"):
        got, want, g = marginals(text, model())
        free = g.label < 0
        assert free.any() and np.allclose(got[free], want[free], atol=1e-5)


def test_loops_are_near():
    """Two repeated neighbours make a loop."""
    got, want, g = marginals("1234 5678 then 1234 5678 now", model(0.8, 0.8))
    assert len(g.near) == 2 and len(g.repeats) == 2
    assert np.abs(got - want).max() < 0.05 and (got.argmax(1) == want.argmax(1)).all()


def test_training_raises_the_likelihood():
    texts = [f"write to kim.{i:02d}@mail.example.com today, not to room {i} of 20{i:02d}, phone +1 (257) 555-{4000 + i} now" for i in range(80)]
    nodes = [x for t in texts for x in pii.training_nodes(t)]
    assert {x[4] for x in nodes} == {0, 3, pii.OTHER}

    def loss(m):
        out = 0.0
        for shape, features, near, alike, label, weight in nodes:
            told = m.local.get(shape, m.default) + sum((m.beside[f] for f in features if f in m.beside), np.zeros(pii.OTHER + 1)) + m.near * np.array(near) + m.distant * np.array(alike)
            out -= weight * (told[label] - np.logaddexp.reduce(told))
        return out

    start, trained = pii.Potentials([]), pii.Potentials([]).train(nodes)
    assert loss(trained) < 0.2 * loss(start)
    assert trained.beside["<room"][pii.OTHER] > 0
    # the same nodes in another order, and none at all
    again = pii.Potentials([]).train(sorted(nodes, key=repr))
    assert abs(again.near - trained.near) < 1e-6
    assert pii.Potentials([]).train([]).beside == {}


def test_hidden_matches_are_found_again():
    """Matches hidden in texts not trained on: told from their surroundings, others left alone."""
    texts = [f"write to kim.{i:02d}@mail.example.com today, not to room {i} of 20{i % 100:02d}, phone +1 (257) 555-{4000 + i} now" for i in range(160)]
    m = pii.Potentials([]).train([x for t in texts[:80] for x in pii.training_nodes(t)])
    right = wrong = missed = 0
    for t in texts[80:]:
        found, failed = pii.base_spans(t)
        away = pii.hidden(t, found)
        added = m.added(t, [s for s in found if s not in away], failed)
        covered = [any(a < s[2] and s[0] < b for a, _, b in added) for s in away]
        right += sum(covered)
        missed += len(away) - sum(covered)
        wrong += sum(not any(a < s[2] and s[0] < b for s in away) for a, _, b in added)
    assert right > 50 and missed < 0.1 * right and wrong < 0.05 * right


def test_long_text_and_empty():
    assert pii.training_nodes("") == [] and pii.training_nodes("no node") == []
    assert len(pii.training_nodes("1 2 3 " * 20_000)) < 4 * pii.SAMPLE_NODES
    assert sum(x[5] for x in pii.training_nodes("17 " * 1000)) > 100


def test_numbers_of_neighbouring_words():
    words = lambda text: [(m.start(), m.end(), m[0], i) for i, m in enumerate(pii._NODE.finditer(text))]
    assert pii.numbers(words("4111  1111\n1111 1111, 4111-1111-1111-1112 12 x 7 8")) == ["=6long"] * 6 + [""] + ["=2short"] * 2
    assert pii.numbers(words("(4111 1111 1111 1111) or 4111-1111-1111-1112")) == ["=4card"] * 4 + ["", "=1other"]
    assert pii.numbers(words("a1 2b 1.5 kim@x")) == [""] * 4 and pii.numbers([]) == []
    assert set(pii.numbers(words("1234567 " * 5000))) == {"=8long"}


def test_a_long_neighbour_is_told_whole():
    one, two = ("word" * 40 + end for end in ("a", "b"))
    assert pii._plain_word(one, False) != pii._plain_word(two, False) and pii._plain_word("Room:", False) == "room" and pii._plain_word("x" * 16, False) == "x" * 16


def test_hidden_cards_are_found_again():
    """Numbers that pass the check of cards are told from those that don't."""
    import random

    rng = random.Random(6)

    def number(good):
        while True:
            digits = "".join(rng.choice("0123456789") for _ in range(16))
            if pii.luhn(digits) == good:
                return digits

    texts = [f"pay with {number(True)} by order {number(False)} of 20{i % 100:02d} at {i}" for i in range(300)]
    m = pii.Potentials([]).train([x for t in texts[:200] for x in pii.training_nodes(t)])
    right = missed = wrong = 0
    for t in texts[200:]:
        found, failed = pii.base_spans(t)
        away = pii.hidden(t, found)
        added = m.added(t, [s for s in found if s not in away], [])
        right += sum(any(a < s[2] and s[0] < b for a, _, b in added) for s in away)
        missed += sum(not any(a < s[2] and s[0] < b for a, _, b in added) for s in away)
        wrong += sum(not any(a < s[2] and s[0] < b for s in away) for a, _, b in added)
    assert right > 30 and missed <= 0.1 * right and wrong <= 0.05 * right
