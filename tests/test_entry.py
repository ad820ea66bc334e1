import __spark_entry__ as entry


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_corpus_queries_only_with_their_package():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert len(names) == (13 if entry.installed("quarryline.llm") else 0)
