import pytest
from pyspark.sql import functions as F

from quarryline.operators import commit, requests

IN = "ord long, title string, company string, locations array<string>, source_key string, kind string, value string"
SRC = "source_key string, kind string, value string, posting_id long, is_primary boolean"
POST = "id long, title string, company string, locations array<string>, first_seen_at string, last_seen_at string"


def test_commit_associates_merges_and_inserts(rows):
    incoming = rows(
        IN, (0, "Data Engineer", "Acme", ["Berlin"], "s", "id", "1"), (1, "Data Engineer (m/w/d)", "ACME", ["Berlin Mitte"], "s", "id", "2"),
        (2, "Chef", "Acme", ["Rome"], "s", "id", "3"), (3, "chef", "Acme", ["Rome"], "t", "id", "3"), (4, "Pilot", "Air", [], "s", "id", "9"),
    )
    sources = rows(SRC, ("s", "id", "9", 7, True))
    postings = rows(POST, (5, "Data Engineer", "acme", ["Berlin"], "t0", "t0"), (7, "Pilot", "Air", ["Oslo"], "t0", "t0"))
    got = {r.ord: (r.posting_id, r.how) for r in commit.associate(incoming, sources, postings).collect()}
    assert got == {0: (5, "similar"), 1: (5, "similar"), 2: (8, "inserted"), 3: (8, "inserted"), 4: (7, "exact")}
    out = commit.commit(1, "t1", incoming, sources, postings)
    after = {r.id: r for r in out["postings"].collect()}
    assert after[5].title == "Data Engineer" and after[5].locations == ["Berlin", "Berlin Mitte"] and after[5].last_seen_at == "t1"
    assert after[8].title == "Chef" and after[8].first_seen_at == "t1" and after[7].locations == ["Oslo"]
    primaries = {(r.posting_id, r.source_key, r.value): r.is_primary for r in out["sources"].collect()}
    assert primaries[8, "s", "3"] is True and primaries[8, "t", "3"] is False and primaries[5, "s", "1"] is False
    assert sorted(r.posting_id for r in out["matches"].collect()) == [5, 7, 8]


def test_two_identities_fail_the_commit(rows):
    incoming = rows(IN, (0, "A", "C", [], "s", "id", "1"), (0, "A", "C", [], "s", "id", "2"))
    sources = rows(SRC, ("s", "id", "1", 1, True), ("s", "id", "2", 2, True))
    with pytest.raises(Exception, match="two identities"):
        commit.associate(incoming, sources, rows(POST)).collect()


def test_requests_are_validated():
    good = {"include_rules": [{"kind": "text", "value": "x"}], "locations": ["a"], "radius_km": 5, "source_keys": ["s"]}
    assert requests.validate_request(good) == []
    bad = {"include_rules": [{"kind": "regex", "value": "("}, {"kind": "odd", "value": "x"}], "radius_km": -1, "source_keys": [], "status": "odd"}
    assert len(requests.validate_request(bad)) == 6
    with pytest.raises(ValueError, match="credential"):
        requests.check_body({"json": {"a": [{"API_Key": 1}]}})
    with pytest.raises(ValueError):
        requests.check_body({"json": {}, "text": ""})


def test_body_overlay_types(rows):
    df = rows("p string", ("7",), ('a"b',), ("007",))
    got = [r.x for r in df.select(requests.overlay_body({"p": 0, "z": [1, "x"]}, {"p": F.col("p")}).alias("x")).collect()]
    assert got == ['{"p":7,"z":[1, "x"]}', '{"p":"a\\"b","z":[1, "x"]}', '{"p":"007","z":[1, "x"]}']
    with pytest.raises(ValueError):
        requests.overlay_body({}, {"p": F.col("p")})
