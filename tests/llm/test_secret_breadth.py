"""How widely a value is copied counts by owners and distinct texts, not by copies of a document."""

import random

from leadlens.llm import secrets
from tests.llm.conftest import prose


def value(seed):
    draw = random.Random(seed)
    return "".join(draw.choice("abcdefghjkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(24))


def text(k, seed):
    return f"{prose(seed, 5)} token={value(k)}"


def test_copies_of_one_owner_stay_live(docs):
    rows = [(k, text(1, 1), "a") for k in range(40)]  # one document, many copies
    rows += [(100 + k, text(2, k), "a") for k in range(8)]  # one owner, many documents
    rows += [(200 + k, text(3, 1), f"s{k % 2}") for k in range(40)]  # copies with two owners are two texts
    rows += [(300 + k, text(4, k), f"s{k % 2}") for k in range(6)]  # two owners, many texts
    rows += [(400 + k, text(5, k), f"s{k}") for k in range(3)]  # three owners
    out = secrets.secret_spans(docs(rows).repartition(3)).collect()
    kinds = {}
    for r in out:
        kinds.setdefault(r.doc_id // 100, set()).update(s.split(":")[0] for s in r.spans.split(","))
    # the first 100 ids are the first case
    assert kinds == {0: {"assign", "live"}, 1: {"assign", "live"}, 2: {"assign"}, 3: {"assign", "example"}, 4: {"assign", "example"}}
    assert len(out) == len(rows)
