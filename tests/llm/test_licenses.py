import random

from leadlens.llm import licenses
from tests.llm.conftest import prose


def found(text, **options):
    return licenses.scan_text(licenses.Index(), text, **options)


def test_every_template_is_found_where_it_stands():
    for name, template in licenses.TEMPLATES.items():
        text = f"{prose(1, 50)} {template} {prose(2, 50)}"
        match = next(m for m in found(text) if m[0] == name)
        assert match[1] == 1.0
        assert licenses.words(text[match[3] : match[4]]) == licenses.words(template)


def test_changed_words_are_tolerated_and_counted():
    words = licenses.TEMPLATES["mit-permission"].split()
    draw = random.Random(5)
    for k in sorted(draw.sample(range(5, len(words) - 5), 6)):
        words[k] = "changed"
    del words[40:42]
    words.insert(60, "extra")
    match = next(m for m in found("intro " + " ".join(words) + " outro") if m[0] == "mit-permission")
    assert 0.85 <= match[1] < 1.0


def test_clean_text_and_parts_do_not_match():
    assert found(prose(3, 2000)) == []
    assert found("The license of the software and the following conditions for any person") == []
    assert found(None) == [] and found("") == []


def test_each_statement_matches_once(docs, spark):
    line = licenses.TEMPLATES["mit-line"]
    rows = [(1, f"{line}\n{prose(1, 40)}\n{line.upper()}", "s"), (2, None, "s"), (3, prose(4, 6000) + " " + line, "s"), (None, line, "s"), (None, line, "s")]
    out = licenses.license_matches(docs(rows, ["license", "coverage"]).repartition(2)).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "1", "3", "None", "None"]
    assert {r.license for r in out} == {"mit-line"}
    assert licenses.license_matches(docs([])).count() == 0


def test_winnowing_finds_any_common_run():
    """Against brute force: all runs of GRAM + WINDOW - 1 template words."""
    index = licenses.Index()
    need = licenses.GRAM + licenses.WINDOW - 1
    for t, template in enumerate(index.texts):
        for k in range(len(template) - need + 1):
            text = ["zz"] * 3 + template[k : k + need] + ["yy"] * 3
            assert any(c == (t, 3 - k) or (c[0] == t and abs(c[1] - (3 - k)) <= licenses.BAND) for c in index.candidates(text))
