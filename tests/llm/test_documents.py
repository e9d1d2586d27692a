"""Quality rules, decontamination, scores, the mix, token files and shards."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hazewell.llm import backoff_model, qgram_leaks, robust_rules, shard_table, source_mix, token_files
from hazewell.session import shared_dir, stored
from tests.llm.conftest import DOCS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def plain_counts(text):
    text = text or ""
    w, seen, covered = WORD.findall(text), collections.defaultdict(list), set()
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_agree_with_brute_force(frame, odd_docs, words):
    rnd = random.Random(1)
    docs = [*odd_docs]
    for i in range(120):
        few = words(6, i)
        docs.append((100 + i, "".join(rnd.choice(few) + rnd.choice([" ", "  ", "\n", "\n\n", "\t", " # ", " $%\n"]) for _ in range(rnd.randint(0, 90))), "en", "s", 0))
    out = robust_rules.with_counts(frame([(*d, 77) for d in docs], DOCS + ", n_words int")).collect()
    got = collections.Counter((r.doc_id, r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == collections.Counter((d[0], d[1], *plain_counts(d[1])) for d in docs)


def test_outliers_go_and_clean_rows_stay(frame, odd_docs, words):
    clean = [(1000 + i, " ".join(words(30 + 7 * (i % 90), i)), "en", f"s{i % 2}", 0) for i in range(400)]
    junk = [(5000 + i, " ".join(w + " ##$%" for w in words(60, i)), "en", f"s{i % 2}", 0) for i in range(120)]
    long = [(9000, " ".join(words(40_000, 77)), "en", "s0", 0)]
    out = robust_rules.judge(frame([(*d, True, 1.5) for d in odd_docs + clean + junk + long], DOCS + ", kept boolean, distance double")).collect()
    assert len(out) == len(odd_docs) + 521
    by = {r.doc_id: r for r in out}
    assert all(by[d[0]].kept for d in clean + long) and not any(by[d[0]].kept for d in junk)
    for r in out:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert robust_rules.judge(frame([], DOCS)).count() == 0


def test_too_few_rows_have_no_distance_and_stay(frame, words):
    out = robust_rules.judge(frame([(i, " ".join(words(30, i)), None, None, 0) for i in range(5)], DOCS)).collect()
    assert all(r.kept and r.distance is None for r in out)


def test_each_statistic_alone_can_reject(frame, words):
    """Short lines that are mostly duplicates, and repeated words, go though the text is usual in all else."""
    clean = [(i, "\n".join(" ".join(words(10, 100 * i + k)) for k in range(3 + i % 9)), "en", "s", 0) for i in range(300)]
    lines = [" ".join(words(1, 7)), *(" ".join(words(10, 40_000 + k)) for k in range(6))]
    many = [(1000, "\n".join([lines[0]] * 20 + lines[1:]), "en", "s", 0)]  # 19 of 26 lines, and 20 of 80 words
    again = [(1001, "\n".join([" ".join(words(10, 41_000))] * 2 + [" ".join(words(10, 42_000 + k)) for k in range(6)]), "en", "s", 0)]  # 1 of 8 lines, 20 of 80 words
    apart = [(1002, "\n".join(x for k in range(7) for x in (lines[0], " ".join(words(10, 43_000 + k)))), "en", "s", 0)]  # 6 of 14 lines, no repeated window
    by = {r.doc_id: r for r in robust_rules.judge(frame(clean + many + again + apart, DOCS)).collect()}
    assert all(by[d[0]].kept for d in clean)
    assert (by[1000].n_dup_lines, by[1000].n_lines, by[1000].base_failed, by[1000].kept) == (19, 26, False, False)
    assert (by[1001].n_dup_lines, by[1001].n_repeat_words, by[1001].n_words, by[1001].kept) == (1, 20, 80, False)
    assert (by[1002].n_dup_lines, by[1002].n_repeat_words, by[1002].kept) == (6, 0, True)
    reach = (math.pi / 2, math.asin(math.sqrt(robust_rules.MOST_REPEATED / 100)))
    assert all(r / robust_rules.FLOORS[i] > robust_rules.CUTOFF for i, r in zip((2, 3), reach))


def test_estimate_is_the_determinant_minimum_of_its_starts(frame):
    """A contaminated normal sample: centre and spread are those of the clean part."""
    rnd = np.random.Generator(np.random.PCG64(3))
    good, bad = rnd.normal(size=(3000, 5)) * [1, 2, 3, 2, 4] + 5, rnd.normal(size=(1200, 5)) + 60
    rows = frame([("g", *map(float, v)) for v in np.vstack([good, bad])], "g string, v0 double, v1 double, v2 double, v3 double, v4 double")
    est = robust_rules.estimates(stored(rows, "t")).first()
    assert all(abs(est[f"m{i}"] - 5) < 0.5 for i in range(5))
    assert all(abs(est[f"l{i}{i}"] / s - 1) < 0.25 for i, s in enumerate([1, 2, 3, 2, 4]))


def test_rejection_keeps_own_columns(frame, words):
    rows = frame([(i, " ".join(words(40, i)), "en", "s", 1, 3.5) for i in range(150)] + [(999, "short", "en", "s", 1, 2.5)], DOCS + ", n_words double")
    out = robust_rules.reject(rows)
    assert out.columns == rows.columns and out.count() == 150 and out.filter("n_words != 3.5").count() == 0


def edits_within(item, text):
    """Least edits of the item against any part of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_agree_with_full_alignment(frame, words):
    rnd = random.Random(4)
    items = [(i, ". ".join(" ".join(words(4, 50 * i + k)).capitalize() for k in range(rnd.randint(2, 7)))) for i in range(12)] + [(90, None), (91, ""), (92, "short one"), (None, " ".join(words(30, 4242)))]
    docs = []
    for d in range(90):
        i, text = items[d % 12]
        chars = list(text)
        for _ in range(d % 23):
            at = rnd.randrange(len(chars))
            chars[at : at + 1] = rnd.choice([[], [rnd.choice("abcdef")], [chars[at], "x"]])
        docs.append((d, " ".join(words(rnd.randint(0, 60), d)) + " " + "".join(chars).upper() + " " + " ".join(words(rnd.randint(0, 60), d + 500))))
    docs += [(200, None), (201, ""), (None, "a " + items[3][1]), (202, items[15][1]), (202, items[15][1])]
    out = qgram_leaks.find_leaks(frame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), frame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    fold = lambda t: "".join(map(chr, qgram_leaks.fold([t]).code)).strip()
    want = set()
    for d, text in docs:
        for i, item in items:
            a, b = fold(item or ""), fold(text or "")
            if len(a) >= qgram_leaks.MIN_CHARS and len(b) and edits_within(a, b) <= int(len(a) * qgram_leaks.BUDGET):
                want.add((d, i))
    assert got == want and 40 < len(want) < 96
    assert sum(r.doc_id == 202 for r in out) == 2
    for r in out:
        text = next(t for d, t in docs if d == r.doc_id)
        assert edits_within(fold(next(t for i, t in items if i == r.item_id)), fold(text[r.first : r.end])) == r.edits


def test_parts_of_items_and_short_items_are_leaks(words):
    long, middle = " ".join(words(100, 1)), " ".join(words(20, 2))
    items = qgram_leaks.Items([1, 2, 3, 4, 5], [long, middle, "What is 6x7?", "日本の首都はどこですか", ""])
    near = long[: len(long) // 2]
    near = "".join(c for i, c in enumerate(near) if i % 16)  # an edit in each 16 characters: no long passage word for word
    texts = [
        "a " + near + " z", "a " + middle[: len(middle) * 85 // 100], middle[len(middle) // 2 :] + " " + " ".join(words(40, 9)), "so WHAT is 6x7, then", "so what is 6x75", "somewhat is 6x7",
        "質問:日本の首都はどこですか?東京です", middle[:40] + " " + " ".join(words(40, 10)), "", None, " ".join(words(400, 11)),
    ]
    got = qgram_leaks.search(items, texts)
    assert [(t, i) for t, i, *_ in got] == [(0, 1), (1, 2), (2, 2), (3, 3), (6, 4)]
    by = {t: r for t, *r in got}
    assert by[1][3] == by[2][3] == by[3][3] == by[6][3] == 0 < by[0][3] <= qgram_leaks.REGION * qgram_leaks.BUDGET
    assert texts[3][by[3][1] : by[3][2]] == "WHAT is 6x7" and texts[6][by[6][1] : by[6][2]] == "日本の首都はどこですか"


def test_blocks_of_items_and_filtering(frame, words, monkeypatch):
    items = frame([(i, " ".join(words(12, i))) for i in range(30)], "item_id long, text string")
    docs = frame([(i, "before " + " ".join(words(12, i)) + " after", 7) for i in range(0, 60, 2)] + [(None, None, 7)], "doc_id long, text string, edits long")
    want = sorted((r.doc_id, r.item_id) for r in qgram_leaks.find_leaks(docs, items).collect())
    monkeypatch.setattr(qgram_leaks.item_blocks, "__defaults__", (300,))
    assert sorted((r.doc_id, r.item_id) for r in qgram_leaks.find_leaks(docs, items).collect()) == want == [(i, i) for i in range(0, 30, 2)]
    left = qgram_leaks.without_leaks(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, *range(30, 60, 2)]
    none = frame([], "item_id long, text string")
    assert qgram_leaks.find_leaks(docs, none).count() == 0 and qgram_leaks.without_leaks(docs, none).count() == 31
    assert qgram_leaks.find_leaks(frame([], "doc_id long, text string"), items).count() == 0


UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_scores(docs, held_out, order=3):
    """All n-grams counted and every probability worked out from its definition; docs are (doc_id, text)."""
    tokens = lambda t: WORD.findall((t or "").translate(UP)) + [None]
    train = [tokens(t) for d, t in docs if not held_out(d)]
    c = collections.Counter(w for t in train for w in t)
    total, types = sum(c.values()), len(c)
    grams, arcs = {1: {(w,): n for w, n in c.items()}}, collections.defaultdict(list)
    for n in range(2, order + 1):
        found = collections.Counter(tuple(x[i : i + n]) for t in train for x in [[None, *t]] for i in range(len(x) - n + 1))
        grams[n] = {g: k for g, k in found.items() if k >= 2}
        for g, k in grams[n].items():
            arcs[g[:-1]].append(k)

    def p(gram):
        if len(gram) == 1:
            return (c[gram[0]] + 1) / (total + types + 1)
        state = gram[:-1]
        if not arcs[state]:
            return p(gram[1:])
        of = grams[len(state)][state]
        left = 1 - sum(k - 0.75 for k in arcs[state]) / of
        return (max(grams[len(gram)].get(gram, 0) - 0.75, 0)) / of + left * p(gram[1:])

    out = []
    for d, text in docs:
        t = tokens(text)
        x = [None, *t]
        score = sum(math.log10(p(tuple(x[max(0, i - order + 1) : i + 1]))) for i in range(1, len(x)))
        base = sum(math.log10((c[w] + 1) / (total + types + 1)) for w in t)
        out.append((d or 0, held_out(d), len(t), sum(c[w] > 0 for w in t), total, round(base, 6), round(score, 6)))
    return sorted(out), p, c, list(arcs)


@pytest.mark.parametrize("order, chunk, part, vocabulary", [(3, None, None, None), (3, 50, 40, 5), (3, 7, 300, 0), (2, None, None, 3), (1, None, None, None)])
def test_scores_agree_with_brute_force(frame, odd_docs, words, monkeypatch, order, chunk, part, vocabulary):
    """Also with texts that are cut into many chunks, many ranges, and few or no words with a code."""
    rnd = random.Random(8)
    common = words(12, 1)
    docs = [*odd_docs[:4], *odd_docs[5:]] + [(100 + i, " ".join(rnd.choice(common) if rnd.random() < 0.8 else rnd.choice(words(300, 2)) for _ in range(rnd.randint(0, 60))).title(), "en", "s", 0) for i in range(150)]
    held_out = lambda d: (d or 0) % 7 == 2
    want, p, c, states = plain_scores([d[:2] for d in docs], held_out, order)
    some = [s for s in states if len(s) == 1][:3] + [s for s in states if len(s) == 2][:3]
    assert len(some) == {3: 6, 2: 3, 1: 0}[order]
    for state in some:  # every state's probabilities sum to one, the unseen type among them
        assert abs(sum(p((*state, w)) for w in c) + p((*state, "never seen")) - 1) < 1e-9
    for name, value in (("CHUNK", chunk), ("RANGE", part)):
        if value:
            monkeypatch.setattr(backoff_model, name, value)
    options = {} if vocabulary is None else {"words_broadcast": vocabulary}
    rows = frame([(*d, 0.5, 1) for d in docs], DOCS + ", score double, chunk int")
    out = backoff_model.score(rows, F.coalesce(F.col("doc_id"), F.lit(0)) % 7 != 2, order=order, **options).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in out) == want
    assert sum(r.doc_id is None for r in out) == sum(d[0] is None for d in docs)


def test_rare_words_and_grams_are_states_in_any_corpus(frame, words):
    """Beside half a million other tokens, a word pair seen twice still carries its own probability."""
    docs = [(10 + i, " ".join(words(1000, i))) for i in range(500)] + [(i, "rare1 rare2 rare3") for i in (1, 2)]
    want, p, *_ = plain_scores(docs, lambda d: False)
    assert p(("rare1", "rare2")) > (2 - 0.75) / 2
    for size in (100, 1 << 20):
        out = backoff_model.score(frame([(*d, "en", "s", 0) for d in docs], DOCS), F.lit(True), words_broadcast=size).collect()
        assert [(r.doc_id, r.n_known) for r in sorted(out)] == [(w[0], w[3]) for w in want]
        assert [r.score for r in sorted(out)] == pytest.approx([w[6] for w in want], abs=2e-6)


def test_the_walk_carries_a_state(words):
    """The state after a token is the longest one that ends with it; a failure arc costs its weight once."""
    from hazewell.llm.words import mix

    texts = ["a b c", "a b c", "a b d", "x b c", "x b c"]
    numbers = {w: mix(np.array([i + 1], np.uint64))[0] for i, w in enumerate("abcdx")} | {None: backoff_model.END}
    seq = [[*t.split(), None] for t in texts]
    c = collections.Counter(w for t in seq for w in t)
    vocab = backoff_model.Words(np.array([numbers[w] for w in c if c[w] > 1]), np.array([c[w] for w in c if c[w] > 1]), None)
    codes = [vocab.codes(np.array([numbers[w] for w in [None, *t]])) for t in seq]
    docs = backoff_model.pack([np.arange(5), np.arange(5), np.ones(5, int), np.zeros(5, int), np.array([len(t) for t in seq]), np.ones(5, int)])
    grams = backoff_model.Grams(docs, backoff_model.pack([np.concatenate(codes)]), vocab, 3, places=True)
    number, *_, total, mass, arcs = backoff_model.totals(*grams.columns(), grams.count, 2)
    a, b, w, total, mass, arcs = backoff_model.totals(*grams.columns(), grams.count, 2)[1:]
    kept = (w == 0) & (b > 0) & (total > 0)
    by_word = [np.bincount(a[kept].astype(int), v, len(vocab.counts)).astype(int) for v in (total[kept], np.ones(kept.sum()))]
    machine = backoff_model.Automaton(grams, vocab, *by_word, [x[number] for x in (total, mass, arcs)], float(sum(c.values()) + len(c) + 1), 0.75)
    ends = lambda i, j: machine.state[grams.first[i] + j]
    assert [ends(0, j) for j in range(4)] == [1, 2, 2, 2] and ends(2, 3) == 0  # d was seen once: no state
    at = grams.first[2] + 3  # "d" after "a b": no arc there nor after "b"; down to the root
    assert np.isnan(machine.arc[2][at]) and np.isnan(machine.arc[1][at]) and machine.fail[2][at] < 0 and machine.fail[1][at] < 0
    steps = machine.walk(int(grams.first[2]), 1, 4)
    one, two, three = machine.arc
    f = grams.first[2]
    assert abs(steps - (two[f + 1] + three[f + 2] + machine.fail[2][at] + machine.fail[1][at] + one[at] + one[at + 1])) < 1e-12


def test_ngrams_of_words_without_codes_are_put_in_order_by_one_number(monkeypatch):
    """The same order as by three columns, without sorting three times."""
    rnd = np.random.Generator(np.random.PCG64(5))
    words = np.concatenate([np.arange(2_000_001, dtype=np.uint64), rnd.integers(0, 2**63, 60, dtype=np.uint64) | backoff_model.HASHED])
    columns = [np.where(rnd.random(5_000) < 0.5, words[-80:][rnd.integers(0, 80, 5_000)], words[rnd.integers(0, 40, 5_000)]) for _ in range(3)]
    want = np.lexsort(columns[::-1])

    def slow(*_):
        raise AssertionError("sorted column by column")

    monkeypatch.setattr(np, "lexsort", slow)
    for columns, want in ((columns, want), ([c[:0] for c in columns], [])):
        got = backoff_model.totals(*columns, np.ones(len(columns[0]), np.int64), 2)
        assert [list(x[got[0]]) for x in got[1:4]] == [list(x) for x in columns]
        assert [list(x[i]) for x, i in zip(columns, [backoff_model.in_order(*columns)] * 3)] == [list(x[want]) if len(x) else [] for x in columns]


def test_more_words_than_fit_are_put_in_order_column_by_column(monkeypatch):
    rnd = np.random.Generator(np.random.PCG64(6))
    monkeypatch.setattr(backoff_model, "BITS", np.uint64(5))
    monkeypatch.setattr(backoff_model, "LOW", np.uint64(31))
    words = np.concatenate([np.arange(20, dtype=np.uint64), rnd.integers(0, 2**63, 40, dtype=np.uint64) | backoff_model.HASHED])
    a, b, w = (words[rnd.integers(0, 60, 1_000)] for _ in range(3))
    assert [list(x[backoff_model.in_order(a, b, w)]) for x in (a, b, w)] == [list(x[np.lexsort((w, b, a))]) for x in (a, b, w)]


def test_marks_have_every_word_and_few_others(spark):
    rnd = np.random.Generator(np.random.PCG64(4))
    keys = rnd.integers(0, 2**64, 30_000, dtype=np.uint64)
    marks = backoff_model.marked(spark.createDataFrame([(int(k),) for k in keys[:10_000].view(np.int64)], "key long"))
    hit = backoff_model.Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), marks).repeated(keys | backoff_model.HASHED)
    assert hit[:10_000].all() and hit[10_000:].mean() < 0.001


def test_packed_columns_come_back():
    rnd = np.random.Generator(np.random.PCG64(3))
    for columns in ([], [np.zeros(0, np.uint64)], [np.zeros(5, np.uint64), rnd.integers(0, 2**64, 100, dtype=np.uint64), np.arange(300)]):
        back = backoff_model.unpack(backoff_model.pack(columns))
        assert len(back) == len(columns) and all((x == y.astype(np.uint64)).all() for x, y in zip(back, columns))


def test_scores_of_nothing(frame):
    assert backoff_model.score(frame([], DOCS), F.lit(True)).count() == 0
    r = backoff_model.score(frame([(1, "a b", "e", "s", 1)], DOCS), F.lit(False)).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.score) == (True, 3, 0, 0, 0.0)


def test_targets_stop_at_three_passes():
    assert source_mix.targets([10, 10, 1000], [5, 2, 1]) == [30.0, 30.0, 960.0]
    assert source_mix.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert source_mix.targets([0, 0], [5, 2]) == [0.0, 0.0] and source_mix.targets([], []) == []


def test_mix_reaches_its_targets(frame, odd_docs, words):
    rnd = random.Random(2)
    docs = [d for d in odd_docs if d[0] != 4] + [(1000 + i, " ".join(words(rnd.randint(1, 200), i)), "en", rnd.choice(["big"] * 8 + ["s1", "zz", "Å", None]), 0) for i in range(700)]
    rows = frame([(*d, 5) for d in docs], DOCS + ", taken int")
    pieces, taken = source_mix.mix(rows)
    got = taken.collect()
    assert len(got) == len(docs)
    size = collections.Counter()
    for d in docs:
        size[d[3]] += len(WORD.findall(d[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    share = dict(zip(names, source_mix.targets([size[s] for s in names], [[5, 2, 1][i % 3] for i in range(len(names))])))
    took = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - share[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        took[r.source] += r.taken
    assert all(abs(took[s] - share[s]) <= 3 * source_mix.BLOCK_WORDS for s in names)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, source_mix.mix(rows.repartition(5))[1].collect()), key=repr)
    # every stretch of the schedule is close to the weights
    half = pieces.filter(F.col("t") < 300).groupBy("s").agg(F.sum("words").alias("w")).collect()
    assert all(abs(r.w / (300 * source_mix.BLOCK_WORDS) - share[names[r.s]] / sum(share.values())) < 0.05 for r in half)
    out = source_mix.mixed_rows(rows)
    assert out.columns == rows.columns
    times = collections.Counter(r.doc_id for r in out.collect() if r.doc_id and r.doc_id >= 1000)
    assert times == {r.doc_id: math.ceil(r.taken / r.size) for r in got if r.doc_id and r.doc_id >= 1000 and r.taken}
    assert source_mix.mix(frame([], DOCS))[1].count() == 0 and source_mix.mixed_rows(frame([], DOCS)).count() == 0


def test_token_files_give_the_ids_back(spark, frame, odd_docs, tmp_path):
    docs = [*odd_docs, (50, "  a  b \n c", None, None, 0), (51, "it's <|endoftext|> 's\r\n 12,5 %", None, None, 0), (52, "a\x1c b \x85 c\u2028 d", None, None, 0)]
    folder = shared_dir(spark, f"test-{tmp_path.name}")
    files = stored(token_files.write(frame(docs, DOCS), folder, TOKENIZER, files=4), "t")
    out = token_files.with_starts(spark, files).orderBy("start").collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    want, start = [], 0
    for d in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = np.array([*whole.encode(d[1] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((d[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out] == want
    ids = {(r.doc_id, r.n_tokens): r.ids for r in token_files.read(spark, files, ids=True).collect()}
    assert ids[5, 2][-1] == 2 and all(len(v) == n for (_, n), v in ids.items())
    assert token_files.write(frame([], DOCS), folder + "-none", TOKENIZER).count() == 0


def test_shuffled_reads_fetch_by_offset(spark, frame, words, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "OPEN_FILES", 2)
    docs = [(i, " ".join(words(i % 9, i)), "e", "s", 0) for i in range(300)] + [(None, "no id", "e", "s", 0)]
    files = stored(token_files.write(frame(docs, DOCS), shared_dir(spark, f"turns-{tmp_path.name}"), TOKENIZER, files=5), "t")
    plain = {(r.file, r.place): (r.doc_id, tuple(r.ids)) for r in token_files.read(spark, files, ids=True).collect()}
    orders = []
    for seed in (1, 1, 2):
        rows = token_files.read_shuffled(spark, files, seed, parts=4).collect()
        assert {(r.file, r.place): (r.doc_id, tuple(r.ids)) for r in rows} == plain and len(rows) == 301
        assert [r.turn for r in rows] == sorted(r.turn for r in rows) and all(r.n_tokens == len(r.ids) for r in rows)
        orders.append([r.doc_id for r in rows])
    assert orders[0] == orders[1] != orders[2] and sum(abs((a or 0) - (b or 0)) > 1 for a, b in zip(orders[0], orders[0][1:])) > 280
    assert token_files.read_shuffled(spark, files.limit(0)).count() == 0


def test_pieces_have_the_ids_of_whole_texts():
    rnd = random.Random(1)
    signs = ["a", "B", "é", "ß", "1", "²", "'", "s", "t", ".", ",", " ", "  ", "\n", "\t", " ", " ", "_", "-", "$", "日", "ж", "\x1c", "\r", "ʰ", "٠", "😀"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    for kind, code in ((None, "<u2"), ("I", "<u4")):
        coder = token_files.Encoder(TOKENIZER, 500, kind)  # small enough for pieces to be forgotten
        assert coder.kind == (kind or "H") and coder.direct
        for i in range(0, len(texts), 100):
            want = [np.asarray(e.ids, code).tobytes() for e in coder.tokenizer.encode_batch(texts[i : i + 100], add_special_tokens=False)]
            assert coder.encode(texts[i : i + 100]) == want


def test_damaged_records_are_noticed():
    data = token_files.frame(b"payload") + token_files.frame(b"")
    first, at = token_files.read_frame(data, 0)
    assert bytes(first) == b"payload" and token_files.read_frame(data, at) == (b"", len(data))
    for i in range(len(data)):
        broken = bytearray(data)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            token_files.read_frame(broken, token_files.read_frame(broken, 0)[1])
    with pytest.raises(ValueError):
        token_files.read_frame(data[:10], 0)


def test_shard_table_is_even_and_steady():
    names = [f"n{i}" for i in range(11)]
    owner = shard_table.fill(names, 1009)
    count = collections.Counter(owner)
    assert max(count.values()) - min(count.values()) <= 1 and len(count) == 11
    fewer = shard_table.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 10)
    assert moved < 0.15 * 1009
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            shard_table.fill(*bad)


def test_placement_agrees_with_a_plain_lookup(frame, odd_docs):
    import hashlib

    out = shard_table.place(frame([(*d, 1, 2) for d in odd_docs], DOCS + ", slot long, owner_slot int"))
    owner = shard_table.fill()
    assert out.count() == len(odd_docs)
    for r in out.collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % shard_table.SLOTS
        assert (r.slot, r.shard, r.owner_slot) == (slot, shard_table.SHARDS[owner[slot]], 2)
    assert shard_table.place(frame([], DOCS)).count() == 0
