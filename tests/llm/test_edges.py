"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names."""

import numpy as np
import public_tokenizers
import pytest

from quillwork.llm import html_text, kneser_ney, mixing, packing, permutation_ann, quality, sharding, simhash, sstable, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, fp string, size string, tie int, block int, shard string, n int, h string, at string, digest string, kept string"
LONG = " ".join(f"long{i % 5000}" for i in range(60_000))


def rows(spark, found):
    return spark.createDataFrame([(*r, None, None, -1, "f", "s", 1, 2, "x", 3, "h", "a", "d", "k") for r in found], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    text = " ".join(f"word{i}" for i in range(80))
    found = [(1, text, "a"), (1, text, "a"), (2, text, "b"), (3, None, "a"), (4, "", None), (5, " \n\t ", None), (None, "a null id with some words", None), (None, None, None), (1, "another text under the same id", "b"), (6, LONG, "b"), (7, "one", "c"), (-5, "two words", "c"), (8, "  ퟿ \U0001f600 é", "c")]
    return spark.createDataFrame([(i, t, "en", s, 1, -1, "f", "s", 1, 2, "x", 3, "h", "a", "d", "k") for i, t, s in found], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def run_all(df, spark):
    path, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    yield "simhash", simhash.near_duplicates(df)
    yield "sharding", sharding.shard_by_bytes(df)
    yield "substring", substring.deduplicate(df, texts=True)
    yield "mixing", mixing.mix(df)
    yield "quality", quality.judge(df)
    yield "lm", kneser_ney.train_and_score(df)
    yield "sstable", sstable.read_tables(sstable.write_tables(df, sstable.fresh_folder(spark), byte))


def test_a_row_for_each_row(spark, odd, none):
    for name, df in run_all(odd, spark):
        assert df.count() == odd.count(), name
    for name, df in run_all(none, spark):
        assert df.count() == 0, name
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert simhash.one_of_each(none).count() == 0


def test_simhash_of_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    empty = [r for r in got if r.fingerprint == "0" * 16]
    assert sorted(r.doc_id or 0 for r in empty) == [0, 3, 4, 5]
    assert {r.component_id for r in empty} == {3}
    assert {r.component_id for r in got if r.doc_id == 2} == {1}


def test_one_of_each_of_odd_rows(odd):
    got = simhash.one_of_each(odd)
    assert got.columns == odd.columns
    assert sorted((r.doc_id if r.doc_id is not None else -99) for r in got.collect()) == [-99, -99, -5, 1, 1, 6, 7, 8]


def test_packing_of_odd_rows(odd):
    got = packing.pack(odd, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len({r.row for r in got}) == odd.count()
    assert all(len(r.ids) == r.length for r in got)
    whole = {r.row: r.doc_tokens for r in got}
    assert sum(r.length for r in got) == sum(whole.values())
    assert sorted(whole.values())[:4] == [1, 1, 1, 1]


@pytest.mark.parametrize("lengths", [[4096], [4095, 1], [2049] * 50, [4000] * 9 + [3000] * 9, [1] * 700, [1500] * 40 + [3000] * 30, [10_000, 1, 2048, 1024, 512], [511, 1023, 2047, 4095], [1 + (i * 37) % 5000 for i in range(2000)]])
def test_plan(lengths):
    lengths = np.array(lengths)
    k, r = lengths // 4096, lengths % 4096
    counts = np.bincount(r, minlength=4096)
    counts[0] = 0
    plan, number, k_at, full = packing.plan(counts, int(k.sum())), 0, 0, {}
    n_cut = set()
    for i in np.lexsort((np.arange(len(r)), r)):
        got, at = packing.pieces(plan, int(lengths[i]), number, k_at), 0
        number, k_at = number + int(r[i] > 0), k_at + int(k[i])
        for start, length, sequence, offset, tier, group, piece_cut in got:
            assert start == at and length > 0
            at += length
            full.setdefault(sequence, []).append((offset, length, tier, group))
            if piece_cut:
                n_cut.add(i)
        assert at == lengths[i]
    padding, groups = 0, {}
    for own in full.values():
        own.sort()
        assert [x[0] for x in own] == [0, *np.cumsum([x[1] for x in own])[:-1]]
        n = sum(x[1] for x in own)
        assert n <= own[0][2] and len({x[2:] for x in own}) == 1
        groups.setdefault(own[0][2], []).append(own[0][3])
        padding += 0 if n & (n - 1) == 0 else 4096 - n
    assert padding < 4096
    for own in groups.values():
        share = np.bincount(own, minlength=plan.groups)
        assert share.max() - share.min() <= 1
    if len(lengths) == 2000:
        assert len(n_cut) < 0.1 * len(lengths)


def test_substring_of_odd_rows(odd):
    got = substring.deduplicate(odd, texts=True).collect()
    assert all(r.n_removed == 0 for r in got if r.doc_id == 1)  # a repeated row is the same document
    (two,) = [r for r in got if r.doc_id == 2]
    assert (two.n_words, two.n_removed, two.text) == (80, 80, "")
    (long,) = [r for r in got if r.doc_id == 6]
    assert (long.n_words, long.n_removed) == (60_000, 55_000)
    assert [r.text for r in got if r.doc_id == 3] == [None]


def test_sharding_of_odd_rows(odd):
    got = sharding.shard_by_bytes(odd, shards=3).collect()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sorted((r.size, r.text_crc32) for r in got)[:3] == [(8, 0)] * 3


def test_mixing_of_odd_rows(odd):
    got = mixing.mix(odd).collect()
    assert {r.source_size for r in got if r.source is None} == {6}
    assert all(0 <= r.copies <= 3 for r in got)


def test_lm_of_odd_rows(odd):
    got = kneser_ney.train_and_score(odd).collect()
    assert all(r.score < 0 and r.base_score < 0 and np.isfinite(r.score) for r in got)
    assert sorted(r.n_tokens for r in got)[:4] == [1, 1, 1, 1]


def test_tables_of_odd_rows(odd):
    got = sstable.read_tables(sstable.write_tables(odd, sstable.fresh_folder(odd.sparkSession), public_tokenizers.path("byte_bpe_50k.json"))).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]


def test_quality_of_odd_rows(odd):
    got = quality.judge(odd).collect()
    assert sum(r.n_words == 0 for r in got) == 4
    assert sum(r.kept for r in got) == 3 and all(r.doc_id in (1, 2) for r in got if r.kept) or any(r.doc_id == 6 for r in got)


def test_pages_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "", "t"), (2, None, "<p>" + LONG, "t")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in html_text.extract(df).collect()) == [0, 0, 0, len(LONG)]
    assert html_text.extract(df.where("false")).count() == 0


def test_vectors(spark):
    v = [1.0, 0.0]
    found = [(0, v), (20, v), (1, v), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (40, [1.0, 2.0, 3.0]), (None, v), (60, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, x, 1, "e") for i, x in found], "vec_id long, embedding array<float>, rank int, entry string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in permutation_ann.neighbours(df, k=3).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 2, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 0.5), (60, 1, 2, -0.5), (60, 2, 0, -1.0), (60, 3, 1, -1.0)]
    assert permutation_ann.neighbours(df.where("false")).count() == 0


def test_copies_of_one_vector(spark):
    """A third of all rows are one vector: each query of them gets the least other ids, with no row for each pair."""
    rng = np.random.default_rng(0)
    found = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(300 + i, [float(x) for x in rng.normal(size=4)]) for i in range(600)]
    got = permutation_ann.neighbours(spark.createDataFrame(found, "vec_id long, embedding array<double>")).where("query_id < 300").collect()
    for q in range(0, 300, 20):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for i in range(22) if i != q][:20]
