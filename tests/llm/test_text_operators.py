"""Against brute force, with nulls, empty and long texts, repeats, clashing columns and empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from tessera.llm import chat_format, common, packing, quality, queries, simhash, substring_dedup, token_output
from tessera.llm.tokens import WordEncoder
from tessera.llm.words import gram_hashes, slide_min, words_of

WORD = re.compile("[^\x20\x09-\x0d]+")
PASSAGE = " ".join(f"w{k}" for k in range(40))
TEXTS = [
    None, "", " \n\t", "one", "One two", "a b c", PASSAGE, "x " + PASSAGE + " y", " ".join(PASSAGE.split()[:35]), "z " + " ".join(PASSAGE.split()[3:39]) + "\x0bq",
    "rep " * 80, "\x85odd\xa0space \x1c ctl\x1fx", "é É ñ. Ñ, ß", "<|endoftext|> It's 12.5!! ###", "big " + " ".join(f"n{k % 977}-{k}" for k in range(30000)), PASSAGE, PASSAGE, "a b\nc d\na b\n\na b", "\U0001d400 \U0001f600 𝐀",
]
ROWS = [(k, t, "en", f"s{k % 3}", 7, "clash") for k, t in enumerate(TEXTS)] + [(3, "one", "en", "s0", 7, "clash"), (None, "one", None, None, None, None), (None, PASSAGE, None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {} string"


def docs(spark, clash="extra", rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA.format(clash)).repartition(3)


def words(t):
    return WORD.findall(t or "")


def test_hash_helpers():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 60, 100).astype(np.uint64)
    for n in (1, 2, 3, 7, 24, 35, 100):
        assert list(slide_min(v, n)) == [v[i : i + n].min() for i in range(100 - n + 1)]
        g = gram_hashes(np.concatenate([v, v]), n)
        assert len(g) == 200 - n + 1 and (g[: 100 - n + 1] == g[100 : 200 - n + 1]).all() and len(set(g[: 100 - n + 1])) == 100 - n + 1
    assert len(gram_hashes(v[:3], 5)) == 0 and len(slide_min(v[:3], 5)) == 0


def test_words_are_those_of_the_pattern():
    w = words_of(pa.array(TEXTS, pa.string()))
    names = w.distinct.to_pylist()
    assert [names[k] for k in w.which] == [x for t in TEXTS for x in words(t)]
    assert list(w.counts) == [len(words(t)) for t in TEXTS]


def kept_words(rows):
    """By counting every window as it stands."""
    seen = collections.Counter(tuple(ws[i : i + 35]) for ws in rows for i in range(len(ws) - 34))
    out = []
    for ws in rows:
        gone = {j for i in range(len(ws) - 34) if seen[tuple(ws[i : i + 35])] > 1 for j in range(i, i + 35)}
        out.append([w for j, w in enumerate(ws) if j not in gone])
    return out


@pytest.mark.parametrize("held,crowded,clash", [(1_000_000, 1000, "ka"), (300, 1000, "SPANS"), (40, 2, "anchors"), (1_000_000, 1, "__k1"), (1, 1000, "__spans"), (1_000_000, 1000, "n")])
def test_substring_dedup(spark, held, crowded, clash):
    got = substring_dedup.substring_dedup(docs(spark, clash), held=held, crowded=crowded).collect()
    want = sorted((str(r[0]), len(words(r[1])), hashlib.sha256(" ".join(k).encode()).hexdigest()) for r, k in zip(ROWS, kept_words([words(r[1]) for r in ROWS]), strict=True))
    assert sorted((str(r.doc_id), r.n_words, r.kept_sha256) for r in got) == want
    assert all(r[clash] == "clash" for r in got if r.doc_id is not None)
    assert all(r.text == (TEXTS[r.doc_id]) for r in got if r.doc_id is not None and r.n_removed == 0)


@pytest.mark.parametrize("crowded", [1000, 50])
def test_substring_dedup_in_one_hot_block(spark, crowded):
    """One anchor in every context: above `crowded` places its windows go through a shuffle."""
    rng = np.random.default_rng(2)
    core = "aa " * 3 + " ".join(PASSAGE.split()[:20])
    rows = [(k, " ".join(f"r{x}" for x in rng.integers(0, 9, 30)) + " " + core + " " + " ".join(f"r{x}" for x in rng.integers(0, 9, 30)), None, None, None, None) for k in range(200)]
    rows += [(1000 + k, r[1], *r[2:]) for k, r in enumerate(rows[:20])]
    got = {r.doc_id: r.kept_sha256 for r in substring_dedup.substring_dedup(docs(spark, rows=rows), held=500, crowded=crowded).collect()}
    for r, k in zip(rows, kept_words([words(r[1]) for r in rows]), strict=True):
        assert got[r[0]] == hashlib.sha256(" ".join(k).encode()).hexdigest()


def test_texts_without_ids_are_told_apart(spark):
    """Many texts under a null id, and few words, so that windows repeat within and between them."""
    rng = np.random.default_rng(9)
    rows = [(None, " ".join(f"r{x}" for x in rng.integers(0, 2, int(rng.integers(30, 90)))) + (" " + PASSAGE) * (k % 3), None, None, None, None) for k in range(150)]
    got = collections.Counter(r.kept_sha256 for r in substring_dedup.substring_dedup(docs(spark, rows=rows), window=12, gram=5).collect())
    seen = collections.Counter(tuple(ws[i : i + 12]) for ws in (words(r[1]) for r in rows) for i in range(len(ws) - 11))
    want = collections.Counter()
    for ws in (words(r[1]) for r in rows):
        gone = {j for i in range(len(ws) - 11) if seen[tuple(ws[i : i + 12])] > 1 for j in range(i, i + 12)}
        want[hashlib.sha256(" ".join(w for j, w in enumerate(ws) if j not in gone).encode()).hexdigest()] += 1
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_factors_against_a_plain_greedy_parser(seed):
    rng = np.random.default_rng(seed)
    parts = [[f"p{x}" for x in rng.integers(0, 3, int(rng.integers(5, 16)))] for _ in range(6)]
    stretches = sorted({" ".join(w for k in rng.integers(0, 6, int(rng.integers(1, 5))) for w in parts[k]) for _ in range(25)})
    copies, window = (rng.random(len(stretches)) < 0.15) + 1, 9
    f = substring_dedup.factors(pa.array([s.encode() for s in stretches], pa.binary()), copies, window)
    ws = [s.split() for s in stretches]
    starts = [(k, i) for k, w in enumerate(ws) for i in range(len(w) - window + 1)]

    def match(a, b):
        n = 0
        while a[1] + n < len(ws[a[0]]) and b[1] + n < len(ws[b[0]]) and ws[a[0]][a[1] + n] == ws[b[0]][b[1] + n]:
            n += 1
        return n

    got = sorted(zip(*(x.tolist() for x in f), strict=True))
    for k, i, n, src, at in got:
        assert (src, at) != (k, i) or copies[k] > 1
        assert match((k, i), (src, at)) >= n
    want = []
    for k, w in enumerate(ws):
        i = 0
        while i <= len(w) - window:
            n = len(w) - i if copies[k] > 1 else max((match((k, i), s) for s in starts if s != (k, i)), default=0)
            if n >= window:
                want.append((k, i, n))
                i += n - window + 1
            else:
                i += 1
    assert sorted((k, i, n) for k, i, n, *_ in got) == sorted(want)


def test_substring_dedup_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(4)
    text = " ".join(f"w{x}" for x in rng.integers(0, 3000, 3000))
    text = text + " " + " ".join(text.split()[500:900]) + " tail"
    raw = text.encode()
    pos, stop = np.array([10, 5, 2000, 3000]), np.array([60, 30, 2100, 3401])
    gone = {j for a, b in zip(pos, stop, strict=True) for j in range(a, b)}
    kept = " ".join(w for j, w in enumerate(text.split()) if j not in gone).encode()
    whole = substring_dedup.strip_spans(raw, pos, stop)
    assert whole == (kept, 3401, len(gone), hashlib.sha256(kept).hexdigest())
    cut = common.cut_at_spaces
    for most in (300, 2000):
        monkeypatch.setattr(substring_dedup, "cut_at_spaces", lambda raw, most=most: cut(raw, most))
        monkeypatch.setattr(substring_dedup, "PIECE", most)
        assert substring_dedup.strip_spans(raw, pos, stop) == whole
        b = pa.RecordBatch.from_pydict({"text": [text]})
        seen = []
        for texts, before in substring_dedup._parts(b, 35):
            r = substring_dedup._runs(texts, 35, 12)
            if r is not None:
                seen += [(p + before + k, a) for p, a, n in zip(r.place.tolist(), r.anchors.tolist(), r.windows.tolist(), strict=True) for k in range(n)]
        r = substring_dedup._runs(pa.array([text]), 35, 12)
        assert seen == [(p + k, a) for p, a, n in zip(r.place.tolist(), r.anchors.tolist(), r.windows.tolist(), strict=True) for k in range(n)]


def plain_fingerprint(t):
    ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    got = simhash.simhash_groups(docs(spark)).collect()
    fps = [plain_fingerprint(r[1]) for r in ROWS]
    parent = list(range(len(ROWS)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in range(len(ROWS)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(ROWS):
        least[find(i)].append(r[0])
    want = sorted((str(r[0]), f"{fps[i]:016x}", str(min((x for x in least[find(i)] if x is not None), default=None))) for i, r in enumerate(ROWS))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("segments,hot", [(2, 1000), (2, 3), (3, 1000), (3, 1), (4, 1000), (8, 5)])
def test_simhash_pairs_against_all_pairs(spark, segments, hot):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 30)
    fps = {int(b) for b in base}
    for b in list(fps):
        for _ in range(6):
            x = b
            for k in rng.integers(0, 63, rng.integers(1, 4)):
                x ^= 1 << int(k)
            fps.add(x)
    pairs = {tuple(sorted(r)) for r in simhash.near_pairs(spark.createDataFrame([(f,) for f in fps], "fp long"), segments, hot=hot).collect()}
    parent = {f: f for f in fps}

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    mine = dict(parent)
    for a, b in pairs:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
        mine[find(mine, a)] = find(mine, b)
    for a in fps:
        for b in fps:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                parent[find(parent, a)] = find(parent, b)
    groups = lambda p: sorted(sorted(g) for g in collections.Counter(find(p, f) for f in fps) and [[f for f in fps if find(p, f) == r] for r in {find(p, f) for f in fps}])
    assert groups(mine) == groups(parent)


def test_simhash_balls_are_not_broadcast(spark):
    """Exploded rows are many times what the planner takes them for, so that no side of their join may be gathered in the driver."""
    pairs = simhash.near_pairs(common.materialize(spark.createDataFrame([(f,) for f in range(100)], "fp long"), "fps"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def similar_groups(rows):
    """Groups by Jaccard similarity of five-word shingles, all pairs compared."""
    sets = []
    for r in rows:
        ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets.append(frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) or frozenset([tuple(ws)] if ws else []))
    parent = list(range(len(rows)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = collections.defaultdict(list)
    for i, r in enumerate(rows):
        out[find(i)].append(r)
    return list(out.values())


@pytest.mark.parametrize("clash", ["k1", "K2", "root"])
def test_one_near_copy_stays(spark, clash):
    got = simhash.drop_near_copies(docs(spark, clash)).collect()
    want = {min((r[0] for r in g if r[0] is not None), default=None) for g in similar_groups(ROWS)}
    assert {r.doc_id for r in got} == want and len(got) == len(want)
    assert all(r[clash] in ("clash", None) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_against_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for _ in range(60):
        ws = [f"v{x}" for x in rng.integers(0, 4000, int(rng.integers(60, 500)))]
        for c in range(int(rng.integers(1, 8))):
            own = list(ws)
            for _ in range(0 if c == 0 else int(rng.integers(0, max(1, len(ws) // 45)))):
                own[int(rng.integers(0, len(own)))] = f"e{rng.integers(0, 10**9)}"
            rows.append((k, " ".join(own), None, None, None, None))
            k += 1
    groups = similar_groups(rows)
    got = {r.doc_id for r in simhash.drop_near_copies(docs(spark, rows=rows)).collect()}
    want = {min(r[0] for r in g) for g in groups}
    assert want <= got, "a document without a near copy is gone"
    assert len(got - want) <= 0.02 * (len(rows) - len(want)), (len(got - want), len(rows), len(want))


def test_near_copies_within_a_family(spark):
    """Near copies among many texts that share boilerplate, whose first of a table entry belongs to none of them."""
    rng = np.random.default_rng(5)
    common, rows = [f"c{k}" for k in range(165)], []
    for k in range(1500):
        own = [f"o{k}x{n}" for n in range(39)]
        rows.append((k, " ".join(common + own), None, None, None, None))
        if k % 25 == 0:  # a pair at 0.9, which shares what is its own
            rows.append((10000 + k, " ".join(common + own[:-11] + [f"p{k}x{n}" for n in range(11)]), None, None, None, None))
    got = {r.doc_id for r in simhash.drop_near_copies(docs(spark, rows=[rows[n] for n in rng.permutation(len(rows))])).collect()}
    assert set(range(1500)) <= got, "a text of the family without a near copy is gone"
    assert len(got) <= 1501, len(got) - 1500


@pytest.mark.parametrize("layout", [simhash.LAYOUTS[0], simhash.LAYOUTS[1], simhash.LAYOUTS[2]])
def test_candidates_at_the_least_similarity(spark, layout):
    """Of lone pairs at 0.8 at least nine in ten become candidates."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(400):
        n = (154, 404)[k % 2]
        own = [f"q{x}" for x in rng.integers(0, 10**9, n)]
        cut = round((n - 4) / 9)  # n - 4 shingles, a ninth of them replaced: 8 / 10
        rows += [(2 * k, " ".join(own), None, None, None, None), (2 * k + 1, " ".join(own[:-cut] + [f"r{k}x{x}" for x in range(cut)]), None, None, None, None)]
    ds = docs(spark, rows=rows)
    marks = simhash._wide_marks(ds, layout)
    keys = {r.id: r.k1 for r in marks.collect()}
    found = {tuple(sorted((keys[r.a], keys[r.b]))) for r in simhash._candidates(marks, layout).collect()}
    assert sum((2 * k, 2 * k + 1) in found for k in range(400)) >= 360, sum((2 * k, 2 * k + 1) in found for k in range(400))


def test_candidates_of_a_family_are_few(spark):
    """About a pair a text, however many firsts a text meets, that unite what all texts of an entry linked to its first unite."""
    rng = np.random.default_rng(4)
    layout, rows = simhash.LAYOUTS[0], []
    for family, n in enumerate((150, 40, 9)):
        base = [f"f{family}w{k}" for k in range(200)]
        for _ in range(n):
            own = list(base)
            for k in rng.integers(0, 200, 4):
                own[k] = f"e{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(own), None, None, None, None))
    marks = simhash._wide_marks(docs(spark, rows=rows), layout)
    words_of_id = {r.id: [r[f"f{k}"] for k in range(layout.parts)] for r in marks.collect()}
    entries = collections.defaultdict(list)
    for r in simhash._keys(marks, layout).collect():
        entries[r.key].append(r.id)
    near = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(words_of_id[a], words_of_id[b], strict=True)) <= layout.never
    stars = {(min(e), b) for e in entries.values() for b in e if b != min(e) and near(min(e), b)}
    found = [(r.a, r.b) for r in simhash._candidates(marks, layout).collect()]
    ids = sorted(words_of_id)
    roots = []
    for pairs in (stars, set(found)):
        a, b = (np.searchsorted(ids, [p[k] for p in pairs]) for k in range(2))
        label = simhash.forest(a, b, len(ids))[1]
        roots.append([int(np.flatnonzero(label == x)[0]) for x in label])
    assert roots[0] == roots[1] and set(found) <= stars
    assert len(found) <= 2 * len(rows) < len(stars), (len(found), len(stars))


def test_layouts_follow_the_count():
    chosen = [simhash.layout_for(n) for n in (0, 10**5, 10**7, 10**8, 10**9, 10**10)]
    assert [x.bits for x in chosen] == sorted(x.bits for x in chosen) and chosen[0] == simhash.LAYOUTS[0] and chosen[-1].bits >= 44
    assert all(x.segments * x.bits <= 64 * x.parts for x in simhash.LAYOUTS)


def test_texts_of_one_entry_meet_wherever_they_stand(spark):
    """Two like texts of an entry whose first belongs to neither find each other, whatever its size."""
    layout = simhash.LAYOUTS[0]
    fill = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, (12, layout.parts))
    for n in (3, 8, 9, 12):
        f = fill[:n].copy()
        f[n // 2] = f[n - 1]
        f[:, 0] = (f[:, 0] & ((1 << 36) - 1)) | (5 << 36)  # one value in the first segment
        rows = [(k, 0, k, k, *map(int, f[k]), bytes(range(layout.uncertain)) * layout.segments, k) for k in range(n)]
        marks = spark.createDataFrame(rows, "id long, k1 long, k2 long, k3 long, " + ", ".join(f"f{k} long" for k in range(layout.parts)) + ", low binary, root long")
        found = {(r.a, r.b) for r in simhash._open_pairs(marks, layout).collect()}
        assert (n // 2, n - 1) in found, n


def test_very_long_texts(spark):
    """Pieces give what the whole text gives."""
    rng = np.random.default_rng(8)
    text = " ".join(f"w{x}" for x in rng.integers(0, 5000, 3000)) + " \t " + "longword" * 40
    whole, piece = simhash.fingerprint(text.encode()), common.cut_at_spaces
    for most in (64, 333, 1000):
        assert b"".join(common.cut_at_spaces(text.encode(), most)) == text.encode()
        simhash.cut_at_spaces = lambda raw, most=most: piece(raw, most)
        try:
            assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)
            assert [simhash.fingerprint(x.encode()) for x in ("a b", "a b c d", " ", "one")] == [plain_fingerprint(x) for x in ("a b", "a b c d", " ", "one")]
        finally:
            simhash.cut_at_spaces = piece


def test_quality(spark):
    out = {}
    for r in quality.quality(docs(spark, "n_words")).collect():
        out.setdefault(r.doc_id, r)
    for k, t in enumerate(TEXTS):
        ws, r = words(t), out[k]
        seen = collections.Counter(zip(ws, ws[1:], ws[2:], strict=False))
        cover = {j for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for j in range(i, i + 3)}
        ls = [x for x in (t or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), len(re.findall("[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(cover))
        assert r.base_failed == (len(ws) < 50 or 100 * len(cover) > 50 * len(ws)) and not (r.base_failed and r.kept)
    assert "length" in out[0].failed_rules and out[0].text is None


def test_tokens_equal_the_library(spark):
    enc = WordEncoder(queries.vocabulary(), most=50)
    for texts in (TEXTS, ["abc!! abc' abc's x..., Éa### a*********b c********** d_ __ 'll we'll' é. ª! |a| a|b| <|endoftext|>. <|startoftext|", "a\u0301. \u0301! ʼn, İ. ſ!"], [""], [None], TEXTS[::-1]):
        ids, lens = enc.encode(pa.array(texts, pa.string()), 7)
        ends = np.concatenate([[0], np.cumsum(lens)])
        for k, t in enumerate(texts):
            assert list(ids[ends[k] : ends[k + 1]]) == [*enc.tok.encode(t or "", add_special_tokens=False).ids, 7]


@pytest.mark.parametrize("ids", [[], [5], list(range(1000)), [3] * 300, [0, 2**32 - 1] * 200, list(np.random.default_rng(4).integers(0, 50000, 3333)), [1] * 250 + [2**31] * 10])
def test_segments_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert (token_output.unpack(token_output.pack(ids)) == ids).all()


def test_token_files(spark):
    enc = WordEncoder(queries.vocabulary())
    files = token_output.write_token_files(docs(spark), queries.vocabulary(), 2, segment_ids=500)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in token_output.read_token_files(files).collect())
    at, seen = 0, collections.Counter()
    for (d, start, n, c) in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
        seen[d, n, c] += 1
    want = collections.Counter()
    for r in ROWS:
        ids = np.array([*enc.tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want[-1 if r[0] is None else r[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert seen == want
    order = [d for d, *_ in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order)


@pytest.mark.parametrize("clash,ranked", [("salt", 1_000_000), ("rank", 2), ("base", 1)])
def test_packing(spark, clash, ranked):
    enc = WordEncoder(queries.vocabulary())
    pieces = common.materialize(packing.cut_pieces(docs(spark, clash), queries.vocabulary(), 1, 4096), "pieces")
    got = packing.pack_pieces(pieces, 4096, ranked).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    want = collections.Counter()
    for r in ROWS:
        ids = [*enc.tok.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want[r[0], k // 4096, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert len(packing.pack_documents(docs(spark, clash), queries.vocabulary()).collect()) == len(got)
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert len(by) == -(-sum(r.length for r in got) // 4096)


@pytest.mark.parametrize("seed", range(6))
def test_histogram_packing(seed):
    rng = np.random.default_rng(seed)
    cap = int(rng.integers(8, 60))
    counts = {int(k): int(rng.integers(0, 40)) for k in rng.integers(1, cap + 1, 12)}
    used = packing.pack_histogram(counts, cap)
    back = collections.Counter()
    for pattern, n in used:
        assert 0 < sum(pattern) <= cap and n > 0
        for k in pattern:
            back[k] += n
    assert back == {k: v for k, v in counts.items() if v}
    # no worse than first fit decreasing, piece by piece
    bins = []
    for k in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        for b in range(len(bins)):
            if bins[b] + k <= cap:
                bins[b] += k
                break
        else:
            bins.append(k)
    assert sum(n for _, n in used) <= len(bins) + 1


TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <turn> b \\ </turn>\n\\l \\n"), (1, 2, "us\ner<turn>", None), (2, 0, "assistant", ""), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (3, 5, None, "<"), (3, 6, "assistant", "turn> é 𝐀"), (None, 0, "assistant", "null id"), (4, None, "user", "</turn"), (4, 1, "user", "x" * 50000)]


def test_chat(spark):
    rows = chat_format.digest_conversations(chat_format.format_turns(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(3))).collect()
    want = {}
    for c in {t[0] for t in TURNS}:
        own = sorted((t for t in TURNS if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        want[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == want


def test_chat_segments_hold_no_control_string_inside():
    roles, texts = pa.array([t[2] for t in TURNS], pa.string()), pa.array([t[3] for t in TURNS], pa.string())
    segments, begin, end = chat_format.assemble(roles, texts)
    for s, b, e, t in zip(segments.to_pylist(), begin.tolist(), end.tolist(), texts.to_pylist(), strict=True):
        assert s.count("<turn>") == 1 and s.count("</turn>") == 1 and s.startswith("<turn>") and s.endswith("</turn>\n")
        assert chat_format.unescape(s.encode()[b:e]).decode() == (t or "")


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_chat_in_pieces(piece):
    rng = np.random.default_rng(piece)
    bits = ["<turn>", "</turn>", "\\", "\n", "é", "<", "turn>", "x", "𐀀", "l", "n", "/"]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 60)))) for _ in range(40)] + [None, "", "<turn"]
    part = chat_format.Part(pa.array(texts, pa.string()), newline=True, piece=piece)
    out = np.zeros(int(part.lens.sum()), np.uint8)
    ends = np.cumsum(part.lens)
    part.scatter(out, ends - part.lens)
    for t, a, b in zip(texts, (ends - part.lens).tolist(), ends.tolist(), strict=True):
        raw = out[a:b].tobytes()
        assert b"<turn>" not in raw and b"</turn>" not in raw and b"\n" not in raw
        assert b"".join(chat_format.unescaped(memoryview(raw), piece)).decode() == (t or "") == chat_format.unescape(raw).decode()
        assert chat_format.code_points(raw, piece) == len(raw.decode())


def test_empty_tables(spark):
    none = docs(spark, rows=[])
    v = queries.vocabulary()
    assert substring_dedup.substring_dedup(none).count() == 0
    assert simhash.simhash_groups(none).count() == 0 and simhash.drop_near_copies(none).count() == 0
    assert quality.quality(none).count() == 0
    assert packing.pack_documents(none, v).count() == 0
    assert token_output.read_token_files(token_output.write_token_files(none, v, 2)).count() == 0
    assert chat_format.digest_conversations(chat_format.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
