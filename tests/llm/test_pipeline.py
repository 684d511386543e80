"""The pipeline's stages against brute-force versions, each on what the stage before kept."""

from collections import Counter

import public_tokenizers
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], sf_dir).write.parquet(at)
        out.append(spark.read.parquet(at))
    return out


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    for r in stages[0].collect():
        w = words(r.text)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert (r.doc_id in kept) == (len(w) >= 50 and 100 * len(marked) <= 50 * len(w))  # no line is in enough documents here


def test_near_duplicates(stages):
    rows = {r.doc_id: r for r in stages[1].collect()}
    sets = {}
    for i, r in rows.items():
        w = words(r.text.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    parent = {i: i for i in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {tuple(r) for r in stages[2].collect()}
    assert got == {tuple(rows[i]) for i in ids if top(i) == i}


def test_passages(stages):
    got, seen = {r.doc_id: r for r in stages[3].collect()}, set()
    for r in sorted(stages[2].collect(), key=lambda r: r.doc_id):
        w = words(r.text)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(k)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        if not kept:
            assert r.doc_id not in got
        else:
            new = got[r.doc_id]
            assert words(new.text) == kept and new.n_chars == len(new.text)
            assert (new.lang, new.source) == (r.lang, r.source)
            if not any(gone):
                assert new.text == r.text


def test_mix(stages):
    before = {tuple(r) for r in stages[3].collect()}
    rows = [tuple(r) for r in stages[4].collect()]
    assert set(rows) <= before and max(Counter(rows).values()) <= 3
    have, taken = Counter(), Counter()
    for _, text, _, source, _ in before:
        have[source] += len(words(text))
    for _, text, _, source, _ in rows:
        taken[source] += len(words(text))
    assert abs(sum(taken.values()) - sum(have.values())) < 0.05 * sum(have.values())


def test_packed(stages):
    from quillwork.llm.tokens import Encoder

    own = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    docs = stages[4].collect()
    want = Counter((r.doc_id, len(x) // 2 + 1) for r, x in zip(docs, own.ids([r.text for r in docs]), strict=True))
    got = {}
    for r in stages[5].collect():
        got.setdefault(r.row, [r.doc_id, 0])[1] += r.length
        assert len(r.ids) == r.length
    assert Counter(map(tuple, got.values())) == want


def test_odd_rows(spark, sf_dir):
    text = " ".join(f"word{i}" for i in range(80))
    found = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text + " more", None, None, None), (3, None, "en", "a", 0), (4, "", "en", None, 0), (5, text.upper(), "en", "b", 1), (6, " ".join(f"other{i}" for i in range(60)), "en", None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in found], "doc_id long, text string, lang string, source string, n_chars long, digest string, row int")
    for start in (df, df.where("false")):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), df.schema)
            assert docs.columns == df.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0 if start is not df else {r.doc_id for r in docs.collect()} <= {None, 6}


def test_near_duplicates_of_an_original_that_is_not_the_least(spark):
    import numpy as np

    from quillwork.llm import simhash

    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 1 << 30, 250)]
    rows = [(1000, " ".join(base))]
    for i in range(150):
        own = list(base)
        for at in range(int(rng.integers(0, 50)), 250, 60):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.root for r in (lambda known, groups: known.join(groups, "digest"))(*simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    ids = [i for i, _ in rows]
    fps = {i: simhash._sketch(t, simhash._mixers(12))[1] for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    top = {i: i for i in ids}
    for a in ids:
        for b in ids:
            near = any(((x ^ y) & (1 << 64) - 1).bit_count() <= 3 for x, y in zip(fps[a], fps[b], strict=True))
            shared = len(sets[a] & sets[b])
            if near and shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) and top[a] != top[b]:
                old, new = top[a], top[b]
                top = {i: new if t == old else t for i, t in top.items()}
    assert len(set(top.values())) < 10
    assert len(set(got.values())) == len(set(top.values())) == len({(got[i], top[i]) for i in ids})


def test_quality_rules_take_frequent_lines_out(spark, sf_dir):
    body = lambda i, n: "\n".join(f"  {' '.join(f'd{i}l{k}w{j}' for j in range(20))}" for k in range(n))
    banner = " ".join(f"b{j}" for j in range(30))
    rows = [(i, f"{banner}\n{body(i, 3 + i)}\n\n{banner.upper()} ", "a", 7) for i in range(40)] + [(99, f"{banner}\n{body(99, 9)}", "b", 7)]
    rows += rows[:1] + rows[-1:] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = Counter(map(tuple, corpus_pipeline.quality_rules(spark, df, sf_dir).collect()))
    clean = [(i, f"{body(i, 3 + i)}\n", "a", len(body(i, 3 + i)) + 1) for i in range(40)]
    assert got == Counter(clean + clean[:1] + rows[-1:] * 3)
