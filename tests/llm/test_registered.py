import pytest

from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
        seen.append(len(rows))
    assert seen[0] >= seen[1] >= seen[2] == seen[3] > 0 and seen[5] >= seen[4] > 0
    assert sum(r.length for r in rows) <= 4096 * len({r.sequence_id for r in rows})


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows():
    passage = " ".join(f"w{k}" for k in range(40))
    texts = [None, "", " \n", "one", "a b c", passage + " end of one", "start " + passage, passage, "big " + " ".join(f"n{k % 977}-{k}" for k in range(9000)), passage.upper(), "é ñ 𐀀", *(" ".join(f"d{k}x{j}" for j in range(60)) for k in range(12))]
    rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return rows + [rows[3], rows[3], rows[8], (None, "one", None, None, None), (None, None, None, None, None), (12, texts[11] + " more", "en", "s0", 1)]


@pytest.mark.parametrize("name", ["toxicity", "simhash", "substrings", "mixing", "packing"])
def test_stages_on_edge_rows(spark, sf_dir, name):
    """Nulls, empty, long, repeated and alike rows through each stage alone, against brute force where rows are decided one by one."""
    import corpus_pipeline
    from test_text_operators import kept_words, similar_groups, words

    stage, rows = dict(corpus_pipeline.STAGES)[name], edge_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = stage(spark, docs, sf_dir)
    got = out.collect()
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    if name != "packing":
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    key = lambda x: str(x)
    if name == "toxicity":
        assert {tuple(r) for r in got} <= set(rows) and len({tuple(r) for r in got}) >= len(set(rows)) - 1
    elif name == "simhash":
        want = [min((r[0] for r in g if r[0] is not None), default=None) for g in similar_groups(rows)]
        assert sorted((r.doc_id for r in got), key=key) == sorted(want, key=key) and {tuple(r) for r in got} <= set(rows)
    elif name == "substrings":
        want = [(r[0], " ".join(k) if len(k) < len(words(r[1])) else r[1]) for r, k in zip(rows, kept_words([words(r[1]) for r in rows]), strict=True)]
        assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(want, key=key)
        assert all(r.n_chars == len(r.text) for r in got if r.text is not None and r.text not in {x[1] for x in rows})
    elif name == "mixing":
        assert {tuple(r) for r in got} <= set(rows)
    else:
        assert {(r.doc_id, r.piece) for r in got} >= {(r[0], 0) for r in rows}
        ends = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
        assert max(ends.values()) <= 4096
