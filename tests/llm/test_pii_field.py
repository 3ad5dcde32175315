"""Repetitions at any distance in the field of personal data."""

from tallyloom.llm import pii


def model():
    return pii.Potentials([("1a@30", 0, 60), ("near", 1, 50), ("distant", 1, 500)])


def added(text):
    return [text[a:b] for a, _, b in model().added(text, *pii.base_spans(text))]


def test_late_repetitions():
    """Forty bare repetitions of one observed address, and those of a number with other words between."""
    assert added("kim.77@mail.example.com wrote " + "then kim.77 said " * 40) == ["kim.77"] * 40
    assert added("+1-257-555-9236 " + "".join(f"or to the desk {i} then 2575559236 " for i in range(30))).count("2575559236") == 30


def test_partners_count_once():
    """Words that share several keys are one pair; the sum over subsets of keys is the count of the union."""
    text = "kim.77@mail.example.com kim.77@other.example.com kim.77@mail.example.com 4711 kimé.77 kim.77"
    g = pii.Graph(text, *pii.base_spans(text))
    of = [pii.keys(w[2]) for w in g.words]
    for i in range(len(of)):
        want = [sum(g.label[j] == k and bool(of[i] & of[j]) for j in range(len(of))) for k in range(pii.OTHER + 1)] if g.label[i] < 0 else [0] * (pii.OTHER + 1)
        assert g.alike[i].tolist() == want


def test_texts_without_base_spans(spark):
    """An address that the base pattern can't match is masked whether or not the text has a base span."""
    rows = [(i, f"write kim.{i:02d}@mail.example.com today") for i in range(60)]
    rows += [(100, "write kim.01é@mail.example.com today"), (101, "write kim.01é@mail.example.com today or lee.02@mail.example.com"), (102, "room 4711 of 1999"), (103, "no such word")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].n_email == 0 and got[100].masked == "write [email] today"
    assert got[101].masked == "write [email] today or [email]"
    assert got[102].masked == rows[62][1] and got[103].masked == rows[63][1]
