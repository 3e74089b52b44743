import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, components, embedding_dedup, langid, mixing, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


def make(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema).repartition(3)


def water(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    t, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and free:
        share = sum(w[s] for s in free)
        for s in free:
            t[s] += left * w[s] / share
        left = 0.0
        for s in list(free):
            if t[s] > cap * sizes[s]:
                left += t[s] - cap * sizes[s]
                t[s] = float(cap * sizes[s])
                free.discard(s)
    return t


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_meets_its_targets(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["b", "a", "é", None, "Z", "tiny"]
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 60))), None, names[int(rng.choice(6, p=[0.4, 0.2, 0.15, 0.1, 0.13, 0.02]))], None) for k in range(300)]
    rows += [(5, "x y z", None, "a", None)] * 3 + [(None, None, None, "nul", None)]
    got = mixing.mix_documents(make(spark, rows)).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = water(sizes)
    taken = collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r["size"] and r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mixing.mix_documents(make(spark, rows[::-1])).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))


def test_mixed_rows_are_repeated(spark):
    rows = [(k, f"a{k} b c d", "en", f"s{k % 3}", k) for k in range(40)] + [(1, "a1 b c d", "en", "s1", 1)]
    out = mixing.repeat_documents(make(spark, rows)).collect()
    per = collections.Counter(r.doc_id for r in out)
    assert max(per.values()) <= 6 and set(out[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}
    assert mixing.repeat_documents(make(spark, [])).count() == 0 and mixing.mix_documents(make(spark, [])).count() == 0


@pytest.mark.parametrize("clash", ["k2", "K3", "times", "size"])
def test_rows_are_repeated_each_with_its_own_columns(spark, clash):
    """One text in two sources is two rows, which keep their source; a clashing column stays."""
    rows = [(1, "a b c d e", "x", "p"), (1, "a b c d e", "y", "q"), (2, None, None, "r"), (2, "", "x", None), *[(k, "w " * (k % 9), "xyz"[k % 3], "c") for k in range(10, 60)]]
    out = mixing.repeat_documents(spark.createDataFrame(rows, f"doc_id long, text string, source string, {clash} string").repartition(3))
    assert out.columns == ["doc_id", "text", "source", clash]
    got = collections.Counter(tuple(r) for r in out.collect())
    assert set(got) <= set(rows)
    times = {(r.doc_id, r.source): r for r in mixing.mix_documents(spark.createDataFrame(rows, f"doc_id long, text string, source string, {clash} string")).collect()}
    for k in (0, 1):
        r = times[rows[k][0], rows[k][2]]
        assert got[rows[k]] == r.copies + (2 * r.part >= r["size"] and r.part > 0)


def test_running_sums(spark):
    rng = np.random.default_rng(2)
    rows = [(int(x), k) for k, x in enumerate(rng.integers(0, 50, 200))]
    got = common.running(spark.createDataFrame(rows, "x long, y long").repartition(5), [F.col("x").asc(), F.col("y").asc()], s=F.col("y")).collect()
    at = 0
    for n, (r, want) in enumerate(zip(sorted(got, key=lambda r: r.nth), sorted(rows), strict=True)):
        assert (r.x, r.y, r.nth, r.s) == (*want, n, at)
        at += want[1]


def vectors(seed, labels=3):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in range(labels):
        for v in rng.standard_normal((60, 16)):
            rows.append((k, v.tolist(), label))
            k += 1
        for c in rng.standard_normal((4, 16)):
            for _ in range(15):
                rows.append((k, (c + 0.08 * rng.standard_normal(16)).tolist(), label))
                k += 1
        rows += [(k + j, c.tolist(), label) for j in range(20)]
        k += 20
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e300] * 16, [2e300] * 16]
    rows += [(k + j, v, 0) for j, v in enumerate(odd)] + [(k + 50, rows[0][1], None), (k + 51, rows[0][1], 1)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_embeddings_against_brute_force(spark, seed):
    rows = vectors(seed)
    got = {r.vec_id: r for r in embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    unit = {}
    for i, v, label in rows:
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v) / np.max(np.abs(v))
            unit[i] = (label, x / np.linalg.norm(x))
    links = {i: [j for j in unit if j != i and unit[i][0] == unit[j][0] and len(unit[i][1]) == len(unit[j][1]) and unit[i][1] @ unit[j][1] >= 0.93] for i in unit}
    found = sum(got[i].n_links for i in unit)
    true = sum(map(len, links.values()))
    assert found >= 0.9 * true and all(got[i].n_links <= len(links[i]) for i in unit)
    for i, *_ in rows:
        todo, seen = [i], {i}
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i].component_id == min(seen) and got[i].kept == (min(seen) == i)
    assert len(got) == len(rows)


@pytest.mark.parametrize("tile", [4, 2048])
def test_embeddings_count_links_by_tiles(spark, tile):
    """Dense groups of unlike vectors, lengths and labels: links are counted, not written, and cross all tiles."""
    rng = np.random.default_rng(12)
    rows, k = [], 0
    for dims in range(2, 82):  # eighty lengths, a linked pair each
        v = rng.standard_normal(dims)
        rows += [(k, v.tolist(), "x"), (k + 1, (1.5 * v).tolist(), "x"), (k + 2, (-v).tolist(), "x")]
        k += 3
    centre = rng.standard_normal(24)
    for j in range(300):
        rows.append((k + j, (centre + 0.22 * rng.standard_normal(24)).tolist(), "dense group"))
    rows += [(k + 3, rows[-1][1], "dense group"), (None, rows[-2][1], "dense group")]
    got = embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(7), tile=tile).collect()
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    want = [sum(j != i and lab == rows[j][2] and len(v) == len(rows[j][1]) and unit[i] @ unit[j] >= 0.93 for j in range(len(rows))) for i, (_, v, lab) in enumerate(rows)]
    assert sorted((str(r.vec_id), r.n_links) for r in got) == sorted((str(i), n) for (i, *_), n in zip(rows, want, strict=True))
    assert {r.component_id for r in got if r.vec_id is not None and r.vec_id < 240} == {x for x in range(240) if x % 3 != 1}


def test_passes_grow_with_the_label():
    found = [embedding_dedup.passes_for(n, 0.93, 64) for n in (0, 500, 10**5, 10**9)]
    assert found == sorted(found) and found[0] == 16 and found[-1] > 60


def test_forest():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 200, 300), rng.integers(0, 200, 300)
    keep, group = components.forest(a, b, 200)
    assert (group[a] == group[b]).all() and len(keep) == 200 - len(np.unique(group))
    again = components.forest(a[keep], b[keep], 200)[1]
    assert len(np.unique(again)) == len(np.unique(group))


def test_embeddings_none(spark):
    assert embedding_dedup.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    r = embedding_dedup.embedding_groups(spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")).first()
    assert (r.n_links, r.component_id, r.kept) == (0, 1, True)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)], [(9, 3), (3, 9), (7, 9), (100, 50), (50, -4)], [(k, (k * 7919) % 60) for k in range(60)]])
def test_components(spark, edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)


SOUNDS = {"aa": ["lor", "mip", "sa", "tun"], "bb": ["krz", "wyx", "ob", "ug"], "cc": ["ñe", "çoi", "ré", "ü"]}


def speech(lang, rng, n=40):
    return " ".join("".join(rng.choice(SOUNDS[lang], rng.integers(1, 4))) for _ in range(n))


def test_language_held_out(spark):
    rng = np.random.default_rng(5)
    langs = ["aa", "bb", "cc"]
    rows = [(k, speech(langs[k % 3], rng), langs[k % 3], "s", 1) for k in range(240)]
    rows += [(1000, None, "aa", "s", 1), (1001, "", "bb", "s", 1), (1002, "12 34 !!", None, "s", 1), (1003, speech("aa", rng), None, "s", 1), (None, speech("bb", rng), None, "s", 1), (1004, "x", None, None, 1), (1005, speech("cc", rng, 30000), None, None, 1)]
    d = make(spark, rows, "doc_id long, text string, lang string, lang_pred string, n_chars long")
    got = {r.doc_id: r for r in langid.identify(d, langid.fit_languages(d)).collect()}
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "aa" and got[None].lang_pred == "bb" and got[1005].lang_pred == "cc"
    held = [k for k in range(240) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([got[k].lang_pred == langs[k % 3] for k in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and all(r.lang_pred in (*langs, "und") for r in got.values())
    none = make(spark, [])
    assert langid.identify(none, langid.fit_languages(none)).count() == 0


def test_language_never_learns_from_the_held_out(spark):
    rows = [(k, "abc def", "aa" if zlib.crc32(str(k).encode()) % 4 != 2 else "zz", "s", 1) for k in range(60)]
    assert set(langid.fit_languages(make(spark, rows)).languages) == {"aa"}


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(6)
    bad = ["vilegrub", "dirtlump", "snarkoaf"]
    rows, labels = [], []
    for k in range(500):
        ws = speech("aa", rng, int(rng.integers(20, 200))).split()
        toxic = k % 4 == 0
        if toxic:
            for w in rng.choice(bad, 3):
                w = str(w) if k % 8 else str(w)[:6] + "x" + str(w)[6:]
                ws.insert(int(rng.integers(0, len(ws))), w.upper() if k % 3 == 0 else w + "!")
        rows.append((k, " ".join(ws), "aa", "s", 1))
        labels.append((k, 1, int(toxic)))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "calm " * 20000 + "vilegrub dirtlump snarkoaf vilegrub", None, None, None)]
    d, lab = make(spark, rows, "doc_id long, text string, lang string, predicted string, n_chars long"), spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    held = [k for k in range(500) if zlib.crc32(str(k).encode()) % 5 == 0]
    right = np.mean([got[k].predicted == int(k % 4 == 0) for k in held])
    assert right > 0.95, right
    assert got[1000].score == got[1001].score and got[1002].predicted == 1 and all(0 <= r.score <= 1 for r in got.values())
    nobody = toxicity.toxicity(d, lab.limit(0)).select(F.max("predicted").alias("p")).first()
    assert nobody.p == 0 and toxicity.toxicity(d.limit(0), lab).count() == 0


ODD = [None, "", " \n\t ", "12 34 !!", "x", "Ünïcode ÑANDÚ straße", "lor mip. SA!tun  tun -- lor", "\x85odd\xa0space ctl\x1fx", "é", "a" * 300]


def plain_grams(text):
    """Counts of hashed byte 2- and 3-grams, one by one."""
    table = {c: c for c in (*range(0x61, 0x7B), *range(0x80, 0x100))}
    data = [table.get(c, 0x20) for c in (text or "").lower().encode()]
    out = collections.Counter()
    for n in (2, 3):
        for i in range(len(data) - n + 1):
            gram = data[i : i + n]
            if any(x == y == 0x20 for x, y in zip(gram, gram[1:], strict=False)):
                continue
            h = n
            for c in gram:
                h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
            out[(h ^ h >> 15) % 4096] += 1
    return out


@pytest.mark.parametrize("piece", [5, 64, 1 << 20])
def test_language_against_plain_cosine(spark, piece):
    rng = np.random.default_rng(3)
    texts = [*ODD, *(speech(x, rng, int(rng.integers(1, 60))) for x in ("aa", "bb", "cc") * 20)]
    counts = langid.counts_of(pa.array(texts, pa.string()), piece)
    for row, t in zip(counts, texts, strict=True):
        assert {int(k): int(row[k]) for k in np.flatnonzero(row)} == plain_grams(t)
    model = langid.fit(pa.array(texts[10:40], pa.string()), ["aa", "bb", "cc"] * 10)
    rows = {r.doc_id: r for r in langid.identify(make(spark, [(k, t, None, None, None) for k, t in enumerate(texts)]), model).collect()}
    for k, t in enumerate(texts):
        vector = {g: math.sqrt(c) * float(model.idf[g]) for g, c in plain_grams(t).items()}
        norm = math.sqrt(sum(x * x for x in vector.values())) or 1.0
        sims = [sum(x * float(model.centroids[g, c]) for g, x in vector.items()) / norm for c in range(len(model.languages))]
        if not any(c.isalpha() for c in t or ""):
            assert (rows[k].lang_pred, rows[k].score) == ("und", 0.0)
            continue
        assert abs(rows[k].score - max(0.0, *sims)) < 1e-4
        assert sims[[n for n, x in enumerate(model.languages) if x == rows[k].lang_pred][0]] > -1 and max(s for s, x in zip(sims, model.languages, strict=True) if x == rows[k].lang_pred) > max(sims) - 1e-4
        assert rows[k].rejected == (rows[k].score < model.least)


def plain_buckets(word):
    """Buckets of a word's character n-grams and of itself, one by one."""
    mask, prime = (1 << 64) - 1, 0x100000001B3
    data = ("\x02" + word.lower().strip(toxicity.PUNCTUATION) + "\x03").encode()
    keys = []
    for n in toxicity.GRAMS:
        for i in range(len(data) - n + 1):
            h = n
            for c in data[i : i + n]:
                h = (h ^ c) * prime & mask
            keys.append(h)
    keys.append(sum((c + 1) * (2 * p + 1) * prime * (c + 7) * (p + 11) for p, c in enumerate(data)) & mask)
    return [((h ^ h >> 31) * 0x9E3779B97F4A7C15 & mask) >> (64 - toxicity.BUCKETS.bit_length() + 1) for h in keys]


def test_toxicity_against_plain_scoring():
    """Mean of embeddings, softmax and most toxic stretch, with a model of random numbers, value by value."""
    rng = np.random.default_rng(4)
    texts = [*ODD, *(speech("aa", rng, int(rng.integers(1, 90))) for _ in range(30))]
    model = toxicity.Model(rng.standard_normal((toxicity.BUCKETS, toxicity.DIMS)).astype(np.float32), rng.standard_normal((toxicity.DIMS, 2)), rng.standard_normal(2))
    got = toxicity.score(pa.array(texts, pa.string()), model.gains(), float(model.bias[1] - model.bias[0]))
    for s, t in zip(got.tolist(), texts, strict=True):
        words, span = WORD.findall(t or ""), toxicity.SPAN
        vectors_of = [np.mean([model.table[b].astype(float) for b in plain_buckets(w)], axis=0) for w in words]
        begins = sorted({min(k, max(0, len(words) - span)) for k in range(0, max(1, len(words) - span // 2 + 1), span // 2)}) if words else []
        odds = []
        for k in begins:
            hidden = np.mean(vectors_of[k : k + span], axis=0)
            z = hidden @ model.weights + model.bias
            odds.append(z[1] - z[0])
        want = 1 / (1 + math.exp(-(max(odds) if odds else float(model.bias[1] - model.bias[0]))))
        assert abs(s - want) < 1e-6


def test_toxicity_in_pieces():
    rng = np.random.default_rng(5)
    gains = rng.standard_normal(toxicity.BUCKETS).astype(np.float32) - 3
    bad = "snarkoaf vilegrub dirtlump snarkoaf vilegrub dirtlump snarkoaf vilegrub"
    for b in {x for w in bad.split() for x in plain_buckets(w)}:
        gains[b] = 9.0
    for at in range(0, 400, 37):
        calm = speech("bb", rng, 400).split()
        text = " ".join([*calm[:at], bad, *calm[at:]])
        assert toxicity.score(pa.array([text]), gains, 0.0, 100)[0] > 0.99
        assert toxicity.score(pa.array([" ".join(calm)]), gains, 0.0, 100)[0] < 0.5


def test_samples_are_bounded(spark):
    """One labelled id with many rows, one long text and many languages do not make the samples grow."""
    rows = [(3, f"word{k} other", "aa", "s", 1) for k in range(300)] + [(k, "abc " * 60000, "bb", "s", 1) for k in range(20, 24)] + [(k, f"text {k}", f"l{k}", "s", 1) for k in range(100, 160)]
    d = make(spark, rows)
    model = toxicity.fit_toxicity(d, spark.createDataFrame([(3, 1, 1), (101, 1, 0), (21, 1, 0)], "doc_id long, quality int, toxic int"))
    assert model.table.shape == (toxicity.BUCKETS, toxicity.DIMS)
    found = langid.fit_languages(d)
    assert "bb" not in found.languages and {f"l{k}" for k in range(100, 160) if zlib.crc32(str(k).encode()) % 4 != 2} <= set(found.languages)
