"""Near duplicates, connected components, the pipeline and what is registered."""

import collections
import random
import re

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from hazewell.llm import near_dups, words as numbers
from hazewell.llm.common import components
from hazewell.llm.words import word_numbers
from hazewell.session import stored
from tests.llm.conftest import DOCS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_sets(texts, n):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(UP))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def plain_components(ids, sets):
    top = list(range(len(ids)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.fixture(scope="module")
def copies(words, odd_docs):
    """Exact and near copies around one base, chains, stars whose ends are not similar to each other, and strangers."""
    rnd = random.Random(6)
    rows = [d[:2] for d in odd_docs]
    for g in range(6):
        base = words(60 + 30 * g, g)
        for k in range(14):
            w = list(base)
            for _ in range(k % 5):
                w[rnd.randrange(len(w))] = f"edit{rnd.random()}"
            rows.append((1000 * (g + 1) + k, " ".join(w).upper() if k % 3 else "\n".join(w)))
        chain = list(base)
        for k in range(8):
            chain = chain[3:] + words(3, 100 * g + k)
            rows.append((500 + 20 * g + k, " ".join(chain)))
    return rows + [(9000 + i, " ".join(words(40, 7000 + i))) for i in range(60)]


@pytest.mark.parametrize("settings", [{}, {"BAND_MEMBERS": 3, "BLOCK_SHINGLES": 700}])
def test_groups_agree_with_all_pairs(frame, copies, monkeypatch, settings):
    """Also with bands and clusters that are too large for one task."""
    for k, v in settings.items():
        monkeypatch.setattr(near_dups, k, v)
    monkeypatch.setattr(near_dups.candidates, "__defaults__", (near_dups.ESTIMATE, near_dups.BAND_MEMBERS))
    monkeypatch.setattr(near_dups.verified, "__defaults__", (near_dups.BLOCK_SHINGLES,))
    for n in (4, 5):
        out = near_dups.near_duplicates(frame([(*r, 3) for r in copies], "doc_id long, text string, uid int"), words=n).collect()
        ids, texts = zip(*copies)
        sets = plain_sets(texts, n)
        want = collections.Counter((d, len(s), c, d == c) for d, s, c in zip(ids, sets, plain_components(ids, sets)))
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == want


def test_one_row_of_each_group_stays(frame, copies):
    rows = frame([(*r, "x", i) for i, r in enumerate(copies)], "doc_id long, text string, first string, row_uid int")
    left = near_dups.deduplicate(rows)
    assert left.columns == rows.columns
    ids, texts = zip(*copies)
    sets = plain_sets(texts, 5)
    parts = plain_components(ids, sets)
    lone, other = sum(not s for s in sets), 1  # two unlike texts have id 6
    assert left.count() == lone + other + len({p for p, s in zip(parts, sets) if s and p is not None}) + sum(p is None and bool(s) for p, s in zip(parts, sets))
    assert {r.doc_id for r in left.collect() if r.doc_id and r.doc_id >= 10} == {p for p, s in zip(parts, sets) if s and p is not None and p >= 10}
    assert near_dups.deduplicate(frame([], "doc_id long, text string")).count() == 0


def test_estimate_is_close_to_resemblance(words):
    both, a, b = words(400, 1), words(100, 2), words(100, 3)
    sets = [near_dups.shingle_sets(__import__("pyarrow").array([" ".join(both + x)]), 1)[0] for x in (a, b)]
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    packed = [near_dups.pack(near_dups.minima(s)) for s in sets]
    assert abs(near_dups.similarity(packed[0], packed[1][None, :])[0] - true) < 0.15
    assert abs(near_dups.similarity(packed[0], near_dups.pack(near_dups.minima(sets[0] ^ np.uint64(2**63 + 12345)))[None, :])[0]) < 0.15


def test_exact_links_of_random_sets():
    rnd = np.random.Generator(np.random.PCG64(2))
    for _ in range(40):
        base = rnd.integers(0, 60, 40)
        sets = [np.unique(np.where(rnd.random(40) < rnd.choice([0, 0.05, 0.15]), rnd.integers(0, 1000, 40), base)).astype(np.uint64) for _ in range(rnd.integers(1, 14))]
        root = near_dups.linked(sets, 80)
        want = plain_components(list(range(len(sets))), [set(s.tolist()) for s in sets])
        assert [want.index(w) for w in want] == [root.tolist().index(r) for r in root.tolist()]


def test_word_numbers_agree_with_plain_words(odd_docs, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(numbers, "SPAN", 64)
    texts = [d[1] for d in odd_docs] + ["A b\x00c", "tail ", "", None, "x" * 300 + " y"]
    got, first = word_numbers(pa.array(texts))
    name = {}
    for t, a, b in zip(texts, first[:-1], first[1:]):
        w = WORD.findall((t or "").translate(UP))
        assert len(w) == b - a
        for x, n in zip(w, got[a:b].tolist()):
            assert name.setdefault(x, n) == n
    assert len(set(name.values())) == len(name)
    sliced, _ = word_numbers(pa.array(texts).slice(4, 3))
    assert sliced.tolist() == got[first[4] : first[7]].tolist()


def test_components_of_a_long_path_and_a_hub(frame):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000), (None, 3)]
    out = {r.node: r.root for r in components(frame(links, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(400)}}
    assert components(frame([], "a long, b long")).count() == 0


def test_pipeline_stages_keep_columns_and_clean_documents(spark, frame, words, tmp_path):
    rows = [(i, " ".join(words(60 + i % 50, i)), "en", f"s{i % 3}", 0) for i in range(300)]
    rows += [(1000 + i, rows[i][1], "en", "s1", 0) for i in range(40)]  # copies
    rows += [(2000 + i, " ".join(words(30, i + 9000) + words(20, 987654) + words(30, i + 9500)), "en", "s2", 0) for i in range(10)]  # leaks
    rows += [(3000 + i, "too short", "en", "s0", 0) for i in range(5)] + [(None, None, None, None, None)]
    frame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    frame([(0, " ".join(words(20, 987654)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), "stage")
        left.append([r.doc_id for r in docs.select("doc_id").collect()])
        assert docs.columns[:5] == columns
    assert sorted(left[0]) == [*range(300), *range(1000, 1040), *range(2000, 2010)]
    assert sorted(left[1]) == [*range(300), *range(2000, 2010)] and sorted(left[2]) == [*range(300)]
    assert set(left[3]) <= set(left[2]) and sorted(left[3]) == sorted(left[4]) and docs.columns[5:] == ["slot", "shard"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


def test_every_operator_is_registered_once():
    found = __spark_entry__.queries()
    for n in range(1, 11):
        assert len([k for k in found if k.startswith(f"op{n}_")]) == 1
    assert "pipeline" in found and set(__spark_entry__.oracle_sql()) <= set(found)


@pytest.mark.parametrize("key", ["op1_url_filter", "op7_warc", "op11_secret_owners", "op13_resampling"])
def test_queries_agree_with_their_sql(spark, key):
    from tests.oracle import connect, rows_of

    folder = "/root/testdata/sf0.01"
    got = __spark_entry__.queries()[key](spark, folder)
    want = connect(folder).sql(__spark_entry__.oracle_sql()[key])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())
    assert sorted(got.columns) == sorted(want.columns)


def test_queries_over_nothing(spark, frame, tmp_path):
    """Empty tables give empty results with the same columns."""
    frame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    frame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    frame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for key, query in __spark_entry__.queries().items():
        if re.match(r"op\d+_|pipeline", key):
            assert query(spark, str(tmp_path)).count() == 0, key
