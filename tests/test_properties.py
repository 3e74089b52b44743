import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import extraction

LETTERS = st.text(alphabet=st.sampled_from("ab#| \t\n\r\x0b\x0c\x1c\x1e\x85\xa0 é𝐀"), max_size=40)
QUIET = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def blocks_of(text):
    """Blocks by walking lines, for comparison."""
    out, now = [], []

    def flush():
        joined = "\n".join(now).strip()
        now.clear()
        if joined:
            out.append(("paragraph", joined))

    for line in (x.strip() for x in text.splitlines()):
        marks, _, title = line.partition(" ")
        if not line:
            flush()
        elif title and set(marks) == {"#"} and len(marks) <= 8:
            flush()
            out.append(("heading", title.strip()))
        else:
            now.append(line)
    flush()
    return out


@QUIET
@given(st.lists(LETTERS, min_size=30, max_size=30))
def test_text_columns_against_python(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select("k", T.lines(F.col("t")).alias("lines"), T.strip(F.col("t")).alias("strip"), T.squeeze(F.col("t")).alias("squeeze"), extraction.blocks(F.col("t"), True).alias("blocks")).collect()
    for r in rows:
        t = texts[r.k]
        assert r.lines == t.splitlines() and r.strip == t.strip() and r.squeeze == " ".join(t.split())
        assert [(b.kind, b.text) for b in r.blocks] == blocks_of(t)


@QUIET
@given(st.lists(st.one_of(LETTERS, st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=6).map(json.dumps)), min_size=30, max_size=30))
def test_json_validity_against_python(spark, texts):
    def fine(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in df.select("k", T.is_json(F.col("t")).alias("x")).collect():
        assert r.x == fine(texts[r.k]), texts[r.k]
