"""Components, near-duplicates, vectors and the pipeline against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from mailsieve.llm import neardup, secrets, toxicity, vectors  # noqa: E402
from mailsieve.llm.links import components  # noqa: E402


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(2)
    pairs = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "chain": [(i, i + 1) for i in range(120)],
        "star": [(500, i) for i in range(200)] + [(7, 7), (3, 500)],
        "none": [],
    }[shape]
    want = {n: r for n, r in roots({x for p in pairs for x in p if p[0] != p[1]}, pairs).items()}
    got = components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert {r.node: r.component for r in got.collect()} == want


# --- near-duplicate texts ---------------------------------------------------------------

def test_words_against_plain():
    texts = ["The Cat, the cat!", None, "", "x", "a-b c_d 12é ", "\nend", "same Words", "SAME words."]
    rows, hashes = [], []
    for begin, _, row, value in neardup.words(pa.array(texts)):
        rows += (row + begin).tolist()
        hashes += value.tolist()
    plain = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\W_]+", (t or "").lower())]
    assert rows == [i for i, _ in plain]
    seen = {}
    for (_, w), h in zip(plain, hashes):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_samples_collide_as_often_as_texts_are_alike():
    rng = np.random.default_rng(1)
    sampler = neardup.Sampler(2000)
    for shared in (0.3, 0.8):
        common = rng.integers(0, 1 << 44, 400).astype(np.uint64)
        own = rng.integers(0, 1 << 44, (2, int(400 * (1 - shared) / shared / 2))).astype(np.uint64)
        weight = {h: w for h, w in zip(np.r_[common, own.ravel()].tolist(), rng.uniform(1, 9, 400 + own.size))}
        sides = [np.sort(np.r_[common, o]) for o in own]
        rows = np.repeat([0, 1], [len(s) for s in sides])
        values = np.concatenate(sides)
        weights = np.array([weight[h] for h in values.tolist()], np.float32)
        _, samples = sampler.sample(rows, values, weights)
        low = sum(weight[h] for h in common.tolist())
        assert abs((samples[0] == samples[1]).mean() - low / (sum(weight.values()))) < 0.04


def shingle_counts(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("l", "m", "n", "r", "s", "t")]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = text(40)
    rows = [" ".join(text(rng.randint(20, 150)) + (passage if i % 3 == 0 else [])) for i in range(120)]
    for i in range(40):
        words = rows[i].split()
        for _ in range(rng.choice([1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(" ".join(words))
    rows += [rows[0]] * 30 + [rows[1].upper() + "!", None, None, "", "", " .. ", "short one", "Short, one", "z " * 20_000]
    table = [(i, t, "en", i) for i, t in enumerate(rows)]
    table += [(None, rows[0], "en", 1), (5, rows[5], "en", 1)]
    return table, spark.createDataFrame(table, "doc_id bigint, text string, lang string, class_id int")


def test_classes(spark, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 4)
    table, df = corpus
    got = neardup.classes(df).collect()
    assert len(got) == len(table)
    found = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    texts = {i: t for i, t, *_ in table if i is not None}
    df_words, n = collections.Counter(), len(table)
    for _, t, *_ in table:
        df_words.update(set(re.findall(r"[^\W_]+", (t or "").lower())))
    idf = lambda w: 1 + np.log((n + 1) / (df_words[w] + 1))
    weights = {}
    for i, t in texts.items():
        weights[i] = {s: c * np.mean([idf(w) for w in s]) for s, c in shingle_counts(t).items()}

    def alike(a, b):
        if texts[a] is not None and texts[a] == texts[b]:
            return 1.0
        low = sum(min(w, weights[b].get(s, 0)) for s, w in weights[a].items())
        high = sum(weights[a].values()) + sum(weights[b].values()) - low
        return low / high if high else 0.0

    ids = sorted(texts)
    sure = [(a, b) for a in ids for b in ids if a < b and alike(a, b) >= 0.85]
    maybe = [(a, b) for a in ids for b in ids if a < b and alike(a, b) >= 0.75]
    low, high = roots(ids, sure), roots(ids, maybe)
    assert all(found[a] == found[b] for a, b in sure)
    assert all(high[i] == high[found[i]] for i in ids)
    assert all(found[i] == i for i in ids if low[i] == i == high[i])
    # the row without an id is a copy of the first
    assert {(r.class_id, r.kept) for r in got if r.doc_id is None} == {(0, False)}
    assert neardup.classes(df.where("false")).count() == 0


def test_one_row_of_each_class_stays(spark):
    """Different texts under one id, copies without an id, repeated rows, clashing columns."""
    alpha, beta = "alpha one two three four five six seven", "beta nine eight seven six five four three"
    rows = [(1, alpha, 1), (1, beta, 2), (2, beta, 3), (None, alpha, 4), (3, None, 5), (3, None, 6), (None, None, 7), (4, "x", 8), (4, "x", 8),
            (None, "lonely", 9), (None, "lonely", 10), (5, "", 11), (6, "", 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _key int")
    got = neardup.unique(df)
    assert got.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [
        (1, alpha), (1, beta), (3, None), (3, None), (None, None), (4, "x"), (None, "lonely"), (5, "")]))
    found = {(r.doc_id, r.class_id, r.kept) for r in neardup.classes(df).collect()}
    assert {(1, 1, True), (2, 1, False), (None, 1, False), (None, None, True), (6, 5, False)} <= found


def test_linked_finds_a_spanning_set():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(60, rng.integers(30, 60), replace=False)).astype(np.uint64) for _ in range(40)]
    found = neardup.linked(list(range(40)), [s.tobytes() for s in sets], [np.ones(len(s), np.float32).tobytes() for s in sets],
                           list(range(40)), 0.7)
    pairs = [(a, b) for a in range(40) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.7]
    assert roots(range(40), found) == roots(range(40), pairs)
    assert set(map(frozenset, found)) <= set(map(frozenset, pairs))


# --- vectors ----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((400, 16))
    near = base[:60].repeat(3, 0) + 0.25 * rng.standard_normal((180, 16))
    rows = [[float(x) for x in v] for v in np.r_[base, near]]
    rows += [None, [], [0.0] * 16, [1.0] * 15 + [float("nan")], [1.0] * 15 + [None], [float("inf")] * 16, rows[0], rows[0], [1e-300] * 16, [2e200] * 16, [1.0] * 8]
    table = [(i, v, i % 3, i) for i, v in enumerate(rows)]
    table += [(None, rows[0], 1, 1), (3, rows[3], 1, 1)]
    return table, spark.createDataFrame(table, "vec_id bigint, embedding array<double>, label int, n_links int")


@pytest.mark.parametrize("window, tile", [(128, 2048), (8, 5)])
def test_vectors(spark, points, monkeypatch, window, tile):
    monkeypatch.setattr(vectors.link_counts, "__kwdefaults__", {"cosine": 0.9, "tile": tile})
    table, df = points
    got = vectors.near_duplicates(df, window=window).collect()
    assert len(got) == len(table)
    usable = {}
    for i, v, *_ in table:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            v = np.array(v) / np.abs(v).max()
            usable[i] = v / np.linalg.norm(v)
    pairs = [(a, b) for a in usable for b in usable if a < b and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= 0.9]
    degree = collections.Counter(x for p in pairs for x in p)
    root = roots({i for i, *_ in table if i is not None}, pairs)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (degree[r.vec_id], root[r.vec_id], root[r.vec_id] == r.vec_id)


def test_no_vectors(spark, points):
    assert vectors.near_duplicates(points[1].where("false")).count() == 0


@pytest.mark.parametrize("kind", ["common mean", "topic"])
def test_crowded_vectors(spark, kind):
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    v, middle = unit(rng.standard_normal((6000, 48))), unit(rng.standard_normal((1, 48)))
    crowd = slice(None) if kind == "common mean" else slice(0, 3000)
    v[crowd] = unit(0.85 * middle + (1 - 0.85**2) ** 0.5 * v[crowd])
    other = unit(rng.standard_normal((300, 48)))
    other = unit(other - (other * v[:300]).sum(1, keepdims=True) * v[:300])
    v = np.r_[v, 0.905 * v[:300] + (1 - 0.905**2) ** 0.5 * other, v[:1].repeat(700, 0)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, window=8).collect()}
    near = v @ v.T >= 0.9
    a, b = np.nonzero(np.triu(near, 1))
    root = roots(range(len(v)), zip(a.tolist(), b.tolist()))
    wrong = [i for i in range(len(v)) if got[i] != (near[i].sum() - 1, root[i])]
    assert len(b) > 300 and len(wrong) <= 4


# --- pipeline ---------------------------------------------------------------------------

def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    states = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        states[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in states.items()}
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(raw, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(raw, model).where("score < 0.7").collect()}
    assert set(ids["toxicity"]) == clean
    kept = {r.doc_id for r in neardup.classes(states["toxicity"]).where("kept").collect()}
    assert sorted(ids["near-duplicates"]) == sorted(kept) and len(kept) < len(clean)
    assert sorted(ids["secrets"]) == sorted(ids["mixing"]) == sorted(kept)
    assert not [r for r in states["secrets"].collect() if secrets.base_spans(r.text, ["access", "hex"])]
    assert all(r.n_chars == len(r.text) for r in states["secrets"].where("text like '%[assign]%'").collect())
    assert ids["mixing"] != ids["secrets"]
    assert set(ids["packing"]) == kept
    assert corpus_pipeline.run(spark, sf_dir).count() == states["packing"].count()


STAGE_ROWS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _key int, mix_block int, spans int, score double"


@pytest.mark.parametrize("rows", [[], [
    (1, "alpha beta gamma delta epsilon zeta", "en", "src0", 36, 1, 1, 1, 0.5), (1, "another text under the same id here", None, "own", 3, 1, 1, 1, 0.5),
    (None, "no id at all, but a text of its own", "en", None, None, 1, 1, 1, 0.5), (2, None, "en", "src1", None, 1, 1, 1, None), (3, "", "en", "own", 0, 1, 1, 1, 0.5),
    (4, "long text " * 5000, "en", "src2", 1, 1, 1, 1, 0.5), (5, "password=abcdef123", "en", "src2", 18, 1, 1, 1, 0.5)]], ids=["empty", "odd"])
def test_each_stage_on_odd_tables(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, STAGE_ROWS)
    spark.createDataFrame([(1, 0), (None, 1)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = sorted(str(r[0]) for r in rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        assert sorted(str(r.doc_id) for r in got.collect()) == want, name
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).where("start = 0")
    assert sorted(str(r.doc_id) for r in packed.collect()) == want


def test_sequences_follow_the_mix(spark, sf_dir):
    shares = {"src0": 19, "src1": 8, "src5": 3}
    names = [s for s, n in shares.items() for _ in range(n * 64)]
    rows = [(i, "one two three " * 60, s) for i, s in enumerate(names)] + [(None, "null id", "src0"), (0, "again", "src1"), (None, None, None)]
    placed = corpus_pipeline.pack(spark, spark.createDataFrame(rows, "doc_id bigint, text string, source string"), sf_dir).collect()
    assert placed[0].__fields__ == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "sequence_id", "offset"]
    assert sum(r.start == 0 for r in placed) == len(rows)
    assert {r.sequence_id for r in placed} == set(range(1 + max(r.sequence_id for r in placed)))
    ends = collections.Counter()
    for r in sorted(placed, key=lambda r: (r.sequence_id, r.offset)):
        assert ends[r.sequence_id] == r.offset
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024
    for part in (0.1, 0.3, 0.5, 0.9):
        early = collections.Counter()
        for r in placed:
            if r.doc_id is not None and r.sequence_id < part * len(ends):
                early[names[r.doc_id]] += r.length
        for s, n in shares.items():
            assert abs(early[s] / sum(early.values()) - n / 30) < 0.05


def test_sequences_follow_the_files(spark, sf_dir, tmp_path):
    """What the stage before wrote is packed in the order of its files and rows."""
    rows = [(i, "one two three " * 60, "src0" if i % 7 else "src1") for i in range(600)]
    for down in (False, True):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        docs.orderBy(F.desc("doc_id") if down else "doc_id").write.option("maxRecordsPerFile", 90).parquet(str(tmp_path / str(down)))
        placed = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / str(down))), sf_dir).collect()
        wanted = [r[0] for r in (rows[::-1] if down else rows)]
        at = {r.doc_id: r.sequence_id for r in placed if r.start == 0}
        assert all(at[a] <= at[b] + 1 for a, b in zip(wanted, wanted[100:]))
