"""What counts in a model's reply, item by item."""

import json

import pytest

from pagewright.operators import replies

HITS = [
    ("Acme", ("Acme", 1)), (" Bolt ", ("Bolt", 1)), ("", None), (5, None), (None, None), (True, None), ([], None), ({}, None),
    (["Cog", 3], ("Cog", 3)), (["Cog", "4"], ("Cog", 4)), (["Cog", 2.9], ("Cog", 2)), (["Cog", "2.9"], ("Cog", 1)), (["Cog", -3], ("Cog", 1)), (["Cog", None], ("Cog", 1)), ([7, 2], ("7", 2)), ([["x"], 2], None), ([None], None),
    ({"n": "Dyn", "c": 2}, ("Dyn", 2)), ({"name": "Dyn", "count": "3"}, ("Dyn", 3)), ({"companyName": "Dyn"}, ("Dyn", 1)), ({"person": "Eve", "c": "x", "count": 9}, ("Eve", 1)), ({"n": None, "name": "Eve"}, None), ({"n": 12}, ("12", 1)), ({"count": 4}, None),
    ("[1, 2]", ("[1, 2]", 1)), ('{"n": "x"}', ('{"n": "x"}', 1)), ("a // b", ("a // b", 1)), ("x, ]", ("x, ]", 1)), (["Big", 2**40], ("Big", 1)),
]


@pytest.mark.parametrize("shape", ["p", "pages"])
def test_hits(spark, shape):
    rows = [(k, "so ```json\n" + json.dumps({shape: [{"page": 2, "companies": [hit]}]}) + "\n```") for k, (hit, _) in enumerate(HITS)]
    got = {r["doc_id"]: (r["name"], r["count"]) for r in replies.reply_facts(spark.createDataFrame(rows, "doc_id long, raw string")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(HITS) if want}


def test_pages_and_shapes(spark):
    raw = [
        '{"p": [{"n": "3", "r": ["A"]}, {"page": 2.5, "r": ["B"]}, {"n": 0, "r": ["C"]}, {"n": true, "r": ["D"]}, 7, {"r": ["E"]}, {"n": " 4 ", "r": "F"}]}',
        '{"p": 1, "pages": [{"n": 1, "c": ["G"], "r": ["H"]}]}', '{"p": {}, "companies": ["I"], "persons": 4}', '{"pages": [], "companies": ["J"]}', "[1]", "{", None, "", '{"a": 1,} trailing }',
    ]
    got = replies.reply_facts(spark.createDataFrame(list(enumerate(raw)), "doc_id long, raw string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(0, "compact", 3, "person", "A", 1), (0, "compact", 2, "person", "B", 1), (1, "paged", 1, "company", "G", 1), (1, "paged", 1, "person", "H", 1), (2, "flat", None, "company", "I", 1)]))
