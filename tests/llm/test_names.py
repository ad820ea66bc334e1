"""Operators on tables whose key has the name of one of their own columns, and on keys that are null or repeat."""

from collections import Counter

from quarryline.llm import fingerprints, sampled_pieces, secrets

SECRET = "password = hunter2hunter2"


def test_secrets_by_a_path_named_blob(rows):
    df = rows("blob string, text string, spans int", ("a", SECRET, 1), ("b", "nothing", 2), (None, SECRET, 3), (None, None, 4))
    found, ledger = secrets.scan(df, path="blob")
    assert found.columns == ["blob", "_blob", "spans"] and sorted((r.blob or "", len(r.spans)) for r in found.collect()) == [("", 0), ("", 1), ("a", 1), ("b", 0)]
    found, _ = secrets.scan(df.select("spans", "text"), ledger, path="spans")
    assert found.columns == ["spans", "blob", "_spans"] and sorted((r.spans, len(r._spans)) for r in found.collect()) == [(1, 1), (2, 0), (3, 1), (4, 0)]


def test_a_ledger_spares_what_it_holds(rows):
    df = rows("doc_id long, text string", (1, SECRET), (2, SECRET), (2, SECRET), (None, SECRET), (3, "x"), (4, None))
    assert sorted(r.text or "" for r in secrets.unseen(df, None).collect()) == ["", SECRET, "x"]
    _, ledger = secrets.scan(df)
    assert ledger.count() == 3 and secrets.unseen(df, ledger).count() == 0


def test_pieces_by_a_key_named_ids(rows):
    out = sampled_pieces.encode(rows("ids long, text string", (1, "some words"), (2, None)), key="ids")
    assert out.columns == ["ids", "draw", "_ids", "log_prob", "log_inclusion"] and {r.ids for r in out.collect()} == {1, 2}


def test_differences_of_null_and_repeated_keys(rows):
    schema = "new long, text string"
    old = rows(schema, (None, "the same\nold line here"), (1, "one"), (1, "two"), (2, None))
    new = rows(schema, (None, "the same\nnew line here"), (1, "two"), (1, "one"), (2, ""))
    got = fingerprints.difference(old, new, "new")
    assert got.columns == ["new", "digest", "sign"]
    assert Counter((r.new, r.sign) for r in got.collect()) == {(None, 1): 1, (None, -1): 1}
