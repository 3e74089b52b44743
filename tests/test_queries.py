import pytest

from tessera.plans import further, more, queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_fnv_fingerprints(spark, sf_dir):
    """By a loop over bytes, for every document."""
    import pathlib

    import pyarrow.parquet as pq

    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"fnv_fingerprints"}
    docs = pq.read_table(pathlib.Path(sf_dir, "documents.parquet")).to_pylist()

    def fnv(data):
        h = 0xCBF29CE484222325
        for c in data:
            h = (h ^ c) * 0x100000001B3 & (1 << 64) - 1
        return h

    got = {r.doc_id: r.fingerprint for r in queries.QUERIES["fnv_fingerprints"](spark, sf_dir).collect()}
    assert got == {d["doc_id"]: f"{fnv((d['text'] or '').encode()):016x}" for d in docs}


def test_entry_without_the_subpackage(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
