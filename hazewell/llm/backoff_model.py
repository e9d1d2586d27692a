"""Language-model scores by a weighted backoff automaton.

States are the contexts of up to two words that some kept n-gram continues. A state's arcs carry the log probabilities of
its continuations, smoothed by absolute discounting; its failure arc leads to the context without its first word and carries
the log of what the discounts left over. The root has an arc for every word, add-one smoothed, one unseen type included.
So every state's probabilities sum to one:

    p(w | h) = (c(h w) - d) / c(h) + left(h) p(w | shorter h)    with an arc,    left(h) p(w | shorter h)    without

A text is scored in one traversal from left to right: the state is carried from token to token, failure arcs are followed
until a state has an arc for the token, and log probabilities add up.

All words are counted, and every n-gram seen ``MIN_COUNT`` times is kept, whatever the corpus. No task holds the model.
Texts become chunks of word codes. A chunk sends each of its distinct n-grams once, packed, to the range of hashes that
its first two words fall in; a range adds up all chunks' counts and answers each chunk with the totals of just the n-grams
that it sent. With these answers a chunk has all states and arcs that its own texts can meet, and walks them.

The broadcast part is bounded: codes and totals of the ``VOCABULARY`` most frequent words. Other words are their hash, and
their totals come in the answers. A word seen once has no kept n-gram: so that its n-grams needn't be sent, the other words
that were seen more often are marked in a table of bits of fixed size. Marks that fall together cost a few n-grams sent
in vain, and change nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazewell.llm.words import U64, mix, pieces, word_numbers
from hazewell.session import stored

ORDER = 3
#: Occurrences from which an n-gram of two or more words is kept, whatever the corpus.
MIN_COUNT = 2
DISCOUNT = 0.75
#: Words that have short codes: 32 bytes each are broadcast. Codes fit in 21 bits.
VOCABULARY = 2_000_000
#: Bits of the table that marks other words seen MIN_COUNT times.
MARKS = 1 << 27
#: Tokens of a chunk, at most: their distinct words and context fit in 21 bits, and a chunk's n-grams in some 200 MB.
CHUNK = 700_000
#: Tokens of the corpus for each range of hashes: a range's n-grams take some 200 MB.
RANGE = 1_500_000
#: The end of a text is a token too; before its first word a text is in the state of having just ended.
END = U64(0x5851F42D4C957F2D)
BITS = U64(21)
LOW = U64((1 << 21) - 1)
HASHED = U64(1 << 63)
FLUSH = 1_000_000


# --- packed columns ------------------------------------------------------------------------------------

def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of non-negative whole numbers as compressed byte planes; each column takes as many bytes a number as its largest needs."""
    head, body = [len(columns)], []
    for c in columns:
        c = np.ascontiguousarray(c.astype(np.uint64))
        width = (int(c.max(initial=0)).bit_length() + 7) // 8
        head += [len(c), width]
        body += [(c >> U64(8 * k)).astype(np.uint8).tobytes() for k in range(width)]
    raw = b"".join(body)
    return np.array([*head, len(raw)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 2 * n + 2)
    raw = np.frombuffer(pa.decompress(blob[8 * len(head) :], int(head[-1]), codec="zstd"), np.uint8)
    out, at = [], 0
    for size, width in zip(head[1:-1:2].tolist(), head[2:-1:2].tolist()):
        c = np.zeros(size, np.uint64)
        for k in range(width):
            c |= raw[at : at + size].astype(np.uint64) << U64(8 * k)
            at += size
        out.append(c)
    return out


# --- words ---------------------------------------------------------------------------------------------

def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens of column ``text``, an end after each text, and where each text starts, with one more end."""
    numbers, first = word_numbers(batch.column(batch.schema.get_field_index("text")))
    return np.insert(numbers, first[1:], END), first + np.arange(len(first))


def word_counts(rows: DataFrame) -> DataFrame:
    """key, c (training) and seen (all) of every token; summed in the tasks before the shuffle."""

    def out(held):
        keys, train = (np.concatenate(x) for x in zip(*held))
        found, at, seen = np.unique(keys, return_inverse=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(at, train, len(found)).astype(np.int64)), pa.array(seen)], ["key", "c", "seen"])

    def count(batches):
        held, size = [], 0
        for whole in batches:
            for batch in pieces(whole, "text"):
                tokens, first = _tokens(batch)
                train = ~np.asarray(batch.column(batch.schema.get_field_index("held_out")))
                held.append((tokens, np.repeat(train, np.diff(first))))
                size += len(tokens)
                if size > FLUSH:
                    yield out(held)
                    held, size = [], 0
        if size:
            yield out(held)

    return rows.select("text", "held_out").mapInArrow(count, "key long, c long, seen long").groupBy("key").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


class Words:
    """Codes 1, 2, .. of the most frequent words, by falling count, and their counts; ``marks`` if other words were seen MIN_COUNT times."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, marks: np.ndarray | None):
        order = np.lexsort((keys, -counts))
        keys, self.counts, self.marks = keys[order], np.concatenate(([0], counts[order])), marks
        by_key = np.argsort(keys)
        self.keys, self.code = keys[by_key], (by_key + 1).astype(np.uint32)

    def repeated(self, codes: np.ndarray) -> np.ndarray:
        """Which of these codes may be of words seen MIN_COUNT times: all that were are among them."""
        out = codes < HASHED
        if self.marks is not None:
            other = np.flatnonzero(~out)
            out[other] = np.logical_and.reduce([self.marks[at >> U64(3)] >> (at & U64(7)).astype(np.uint8) & 1 for at in mark_places(codes[other])])
        return out

    def codes(self, numbers: np.ndarray) -> np.ndarray:
        """A word's code, or its hash with the highest bit set."""
        found, at = np.unique(numbers, return_inverse=True)
        where = np.minimum(np.searchsorted(self.keys, found), max(len(self.keys) - 1, 0))
        hit = self.keys[where] == found if len(self.keys) else np.zeros(len(found), bool)
        return np.where(hit, self.code[where].astype(np.uint64) if len(self.keys) else U64(0), found | HASHED)[at]


def mark_places(numbers: np.ndarray) -> list[np.ndarray]:
    """Two bits of the table of marks for each word's number (its highest bit doesn't matter)."""
    return [numbers & U64(MARKS - 1), (numbers >> U64(27)) & U64(MARKS - 1)]


def marked(types: DataFrame) -> np.ndarray:
    """The table of marks of these words: ``MARKS`` bits, put together in pieces by Spark."""
    places = F.explode(F.array(F.col("key").bitwiseAND(MARKS - 1), F.shiftrightunsigned("key", 27).bitwiseAND(MARKS - 1))).alias("at")
    rows = types.select(places).select((F.col("at") + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(MARKS // 8, np.uint8)
    for r in rows.collect():  # at most MARKS bits
        bits = np.frombuffer(r["bits"], np.uint8)
        begin = (r["piece"] - 1) * len(bits)
        out[begin : begin + len(bits)] = bits
    return out


def vocabulary(types: DataFrame, size: int) -> Words:
    """The most frequent words: all of those counts that ``size`` words have room for."""
    seen = types.filter(F.col("c") >= MIN_COUNT)
    least, room, whole = None, size, True
    for r in seen.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():
        if r["n"] > room:
            whole = False
            break
        least, room = r["c"], room - r["n"]
    marks = None if whole else marked(seen.filter(F.lit(True) if least is None else F.col("c") < least))
    found = types.filter(F.lit(False) if least is None else F.col("c") >= least).select("key", "c").toArrow()  # at most ``size`` rows
    return Words(found.column("key").to_numpy().view(np.uint64), found.column("c").to_numpy(), marks)


# --- chunks --------------------------------------------------------------------------------------------

def chunks(rows: DataFrame, shared) -> DataFrame:
    """The texts as chunks: chunk, docs (row, doc_id, whether it has one, held out, own tokens and context of each part of a text), part (their codes).

    A text longer than a chunk goes on in the next one, which begins with the two tokens before it as context.
    """

    def run(batches):
        words, task = shared.value, TaskContext.get().partitionId()
        at, made, held, size = task << 36, task << 24, [], 0

        def out():
            docs = [np.array([h[k] for h in held], np.int64) for k in range(6)]
            return pa.RecordBatch.from_arrays([pa.array([made]), pa.array([pack(docs)]), pa.array([pack([np.concatenate([h[6] for h in held])])])], ["chunk", "docs", "part"])

        for whole in batches:
            for batch in pieces(whole, "text"):
                tokens, first = _tokens(batch)
                codes, held_out = words.codes(np.append(tokens, END)), np.asarray(batch.column(batch.schema.get_field_index("held_out")))
                end, ids = codes[-1:], batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
                for i in range(batch.num_rows):
                    begin, stop = int(first[i]), int(first[i + 1])
                    while begin < stop:
                        last = min(stop, begin + CHUNK - size)
                        before = end if begin == first[i] else np.concatenate([end, codes[first[i] : begin]])[-2:] if begin - first[i] < 2 else codes[begin - 2 : begin]
                        held.append((at + i, ids[i] or 0, int(ids[i] is not None), int(held_out[i]), last - begin, len(before), np.concatenate([before, codes[begin:last]])))
                        size += last - begin
                        begin = last
                        if size >= CHUNK:
                            yield out()
                            held, size, made = [], 0, made + 1
                at += batch.num_rows
        if held:
            yield out()

    return rows.select("doc_id", "text", "held_out").mapInArrow(run, "chunk long, docs binary, part binary")


class Grams:
    """A chunk's tokens and its distinct n-grams.

    ``key`` has the n-grams in order: the places of up to three words among the chunk's distinct words, 21 bits each, 0 where
    there is none. Bigrams have no third word, single words (those without a code) no second. With ``places``, ``two`` and
    ``three`` say for each token where the bigram and the trigram that end there are in ``key``, -1 where there is none.
    """

    def __init__(self, docs: bytes, part: bytes, words: Words, order: int, places: bool = False):
        self.rows, self.ids, self.has_id, self.held_out, self.own, context = (c.view(np.int64) for c in unpack(docs))
        self.codes = unpack(part)[0]
        length = self.own + context
        self.first = np.concatenate(([0], np.cumsum(length)))[:-1]
        place = np.arange(len(self.codes)) - np.repeat(self.first, length)
        self.is_own = place >= np.repeat(context, length)
        train = np.repeat(self.held_out == 0, length) & self.is_own
        coded = self.codes < HASHED
        code = self.codes[coded].astype(np.int64)
        used = np.zeros(len(words.counts) + 1, bool)
        used[code] = True
        hashed, which = np.unique(self.codes[~coded], return_inverse=True)
        self.distinct = np.concatenate([np.flatnonzero(used).astype(np.uint64), hashed])
        local = np.empty(len(self.codes), np.uint64)
        local[coded] = np.cumsum(used, dtype=np.int32)[code]
        local[~coded] = (len(self.distinct) - len(hashed) + 1 + which).astype(np.uint64)
        known = words.repeated(self.codes)  # an n-gram with a word seen once can't be seen twice
        pair = np.flatnonzero((place >= 1) & known & np.roll(known, 1)) if order > 1 else np.zeros(0, int)
        triple = pair[(place[pair] >= 2) & known[pair - 2] & self.is_own[pair]] if order > 2 else np.zeros(0, int)
        del place, known, code
        one = np.flatnonzero(~coded)
        all_ = np.concatenate([local[one] << (BITS + BITS), (local[pair - 1] << (BITS + BITS)) | (local[pair] << BITS),
                               (local[triple - 2] << (BITS + BITS)) | (local[triple - 1] << BITS) | local[triple]])
        all_ = (all_ << U64(1)) | train[np.concatenate([one, pair, triple])]
        order_ = np.argsort(all_) if places else None
        all_ = all_[order_] if places else np.sort(all_)
        new = np.ones(len(all_), bool)
        new[1:] = (all_[1:] >> U64(1)) != (all_[:-1] >> U64(1))
        first = np.flatnonzero(new)
        self.key = all_[first] >> U64(1)
        self.count = np.add.reduceat((all_ & U64(1)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        if places:
            at = np.empty(len(all_), np.int64)
            at[order_] = np.cumsum(new) - 1
            self.one, self.two, self.three = (np.full(len(local), -1) for _ in range(3))
            self.one[one], self.two[pair], self.three[triple] = np.split(at, [len(one), len(one) + len(pair)])

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the n-grams' words, 0 where there is none."""
        codes = np.concatenate([np.zeros(1, np.uint64), self.distinct])
        return codes[self.key >> (BITS + BITS)], codes[(self.key >> BITS) & LOW], codes[self.key & LOW]

    def by_range(self, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each range and its n-grams, in order. A word without a code is in one range with all that it begins; a frequent word's n-grams are dealt by their second word too."""
        a, b, _ = self.columns()
        of = (mix(np.where(a < HASHED, a * U64(0x9E3779B97F4A7C15) + b, a)) % U64(ranges)).astype(np.int64)
        of = of.astype(np.uint16) if ranges < 1 << 16 else of  # short numbers are sorted digit by digit
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(ranges + 1))
        for r in range(ranges):
            if edges[r] < edges[r + 1]:
                yield r, order[edges[r] : edges[r + 1]]


def sent(stored_chunks: DataFrame, shared, ranges: int, order: int) -> DataFrame:
    """chunk, range, and the chunk's n-grams in that range with their counts, packed."""

    def run(batches):
        for batch in batches:
            for chunk, docs, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                grams = Grams(docs.as_py(), part.as_py(), shared.value, order)
                a, b, w = grams.columns()
                for r, at in grams.by_range(ranges):
                    step = np.diff(a[at], prepend=U64(0))  # places are in order of codes: small steps
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([r], pa.int32()), pa.array([pack([step, b[at], w[at], grams.count[at]])])], ["chunk", "range", "blob"])

    return stored_chunks.select("chunk", "docs", "part").mapInArrow(run, "chunk long, range int, blob binary")


def in_order(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the n-grams in order of their words, which are packed into one number; words are numbered anew if some have no code."""
    number = lambda c: c
    if max(int(c.max(initial=0)) for c in (a, b, w)) > int(LOW):
        used = np.zeros(1 << int(BITS), bool)
        for c in (a, b, w):
            used[c[c < HASHED]] = True
        hashed = np.unique(np.concatenate([c[c >= HASHED] for c in (a, b, w)]))
        local = np.cumsum(used, dtype=np.uint32)
        least = U64(local[-1]) + U64(1)
        if int(least) + len(hashed) > int(LOW):
            return np.lexsort((w, b, a))

        def number(c):
            other = np.flatnonzero(c >= HASHED)
            out = c.copy()
            out[other] = U64(0)
            out = local[out].astype(np.uint64)
            out[other] = np.searchsorted(hashed, c[other]).astype(np.uint64) + least
            return out

    key = number(a) << BITS
    key |= number(b)
    key <<= BITS
    key |= number(w)
    return np.argsort(key)


def totals(a: np.ndarray, b: np.ndarray, w: np.ndarray, count: np.ndarray, limit: int):
    """Over all chunks' n-grams of a range: for each its number among the distinct ones; and of these codes, total (0 below the limit), and how
    much its kept continuations add up to and are."""
    order = in_order(a, b, w)
    a, b, w = a[order], b[order], w[order]
    head = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
    new = head | np.concatenate(([True], w[1:] != w[:-1]))[: len(a)]
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    total = np.add.reduceat(count[order], first) if len(first) else np.zeros(0, np.int64)
    a, b, w, head = a[first], b[first], w[first], head[first]
    total = np.where((total >= limit) | (b == 0), total, 0)
    n, mass, arcs = len(first), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    three = np.flatnonzero((w > 0) & (total > 0))
    owner = np.flatnonzero(head)[np.cumsum(head) - 1] if n else np.zeros(0, int)  # a kept trigram's bigram is there, first of its group
    np.add.at(mass, owner[three], total[three])
    np.add.at(arcs, owner[three], 1)
    # what a word without a code continues with lies in this range as well
    two = np.flatnonzero((w == 0) & (b > 0) & (total > 0))
    word = np.flatnonzero((b == 0) & (a >= HASHED))
    if len(word):
        at = np.minimum(np.searchsorted(a[word], a[two]), len(word) - 1)
        mine = a[word[at]] == a[two]
        np.add.at(mass, word[at[mine]], total[two[mine]])
        np.add.at(arcs, word[at[mine]], 1)
    return number, a, b, w, total, mass, arcs


def answers(asked: DataFrame, limit: int) -> DataFrame:
    """For each chunk and range the totals of its n-grams in the order in which they were sent; and as chunk -1 what each coded word's kept continuations in the range add up to and are."""

    def run(table):
        blobs = [unpack(b.as_py()) for b in table.column("blob")]
        a = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in blobs])
        number, a, b, w, total, mass, arcs = totals(a, *(np.concatenate([x[k] for x in blobs]) for k in (1, 2)), np.concatenate([x[3] for x in blobs]).astype(np.int64), limit)
        out, at = [], 0
        for x in blobs:
            mine = number[at : at + len(x[0])]
            at += len(x[0])
            out.append(pack([total[mine], mass[mine], arcs[mine]]))
        kept = np.flatnonzero((w == 0) & (b > 0) & (total > 0) & (a < HASHED))
        word, of = np.unique(a[kept], return_inverse=True)
        out.append(pack([word, np.bincount(of, total[kept], len(word)).astype(np.int64), np.bincount(of, minlength=len(word))]))
        chunk = [*table.column("chunk").to_pylist(), -1]
        return pa.table([pa.array(chunk, pa.int64()), pa.array([table.column("range")[0].as_py()] * len(chunk), pa.int32()), pa.array(out, pa.binary())], ["chunk", "range", "blob"])

    return asked.groupBy("range").applyInArrow(run, "chunk long, range int, blob binary")


def word_arcs(answered: DataFrame, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """By code: what a word's kept continuations add up to, and how many they are."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                word, mass, arcs = unpack(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (word, mass, arcs)], ["word", "mass", "arcs"])

    rows = answered.filter("chunk < 0").select("blob").mapInArrow(run, "word long, mass long, arcs long").groupBy("word").agg(F.sum("mass").alias("mass"), F.sum("arcs").alias("arcs")).toArrow()
    mass, arcs = np.zeros(len(words.counts), np.int64), np.zeros(len(words.counts), np.int32)
    mass[rows.column("word").to_numpy()], arcs[rows.column("word").to_numpy()] = rows.column("mass").to_numpy(), rows.column("arcs").to_numpy()
    return mass, arcs


# --- the automaton -------------------------------------------------------------------------------------

class Automaton:
    """The states and arcs that a chunk's texts can meet, token by token.

    For each token: ``arc[k]`` is the log probability of the arc for it from the state of the k tokens before it (NaN where
    that state has none), ``fail[k]`` the weight of that state's failure arc, and ``state`` how many tokens the longest state
    that ends with this token has.
    """

    def __init__(self, grams: Grams, words: Words, mass: np.ndarray, arcs: np.ndarray, answer, size: float, discount: float):
        total, own_mass, own_arcs = answer
        n = len(grams.codes)
        coded = grams.codes < HASHED
        code = np.where(coded, grams.codes, U64(0)).astype(np.int64)
        count, left, more = words.counts[code].astype(float), mass[code].astype(float), arcs[code].astype(float)
        at = grams.one[~coded]
        count[~coded], left[~coded], more[~coded] = total[at], own_mass[at], own_arcs[at]
        of = lambda x, at: np.where(at >= 0, x[at], 0).astype(float) if len(x) else np.zeros(n)
        with np.errstate(divide="ignore", invalid="ignore"):
            rest1 = np.where(more > 0, 1.0 - (left - discount * more) / count, 1.0)
            self.count, p1 = count, (count + 1.0) / size
            c2, m2, k2 = (of(x, grams.two) for x in (total, own_mass, own_arcs))
            c3 = of(total, grams.three)
            rest2 = np.where(k2 > 0, 1.0 - (m2 - discount * k2) / c2, 1.0)
            before = lambda x, k: np.concatenate([np.ones(k), x[:-k]])[:n]
            p2 = np.where(c2 > 0, (c2 - discount) / before(count, 1), 0.0) + before(rest1, 1) * p1
            p3 = np.where(c3 > 0, (c3 - discount) / before(c2, 1), 0.0) + before(rest2, 1) * p2
            nothing = np.nan
            self.arc = [np.log10(p1), np.where(c2 > 0, np.log10(p2), nothing), np.where(c3 > 0, np.log10(p3), nothing)]
            self.fail = [np.zeros(n), np.log10(before(rest1, 1)), np.log10(before(rest2, 1))]
        self.state = np.where(k2 > 0, 2, np.where(more > 0, 1, 0))
        self.begin, self.context = grams.first, np.diff(np.append(grams.first, n)) - grams.own

    @cached_property
    def steps(self) -> np.ndarray:
        """What each token adds on its way, in this order: the failure arc from a state of two tokens; the arc from that state, or the
        arc or failure arc from one of one token; the root's arc. 0 where the way doesn't lead. A token's state is the one after the token before it."""
        state, begin = np.roll(self.state, 1), self.begin + self.context
        state[begin] = np.minimum(self.state[begin - 1], self.context)
        arc = [~np.isnan(x) for x in self.arc]
        fell2 = (state == 2) & ~arc[2]
        one = fell2 | (state == 1)
        fell1 = one & ~arc[1]
        out = np.zeros((len(state), 3))
        out[:, 0] = np.where(fell2, self.fail[2], 0.0)
        out[:, 1] = np.where(fell1, self.fail[1], np.where(one, self.arc[1], np.where(state == 2, self.arc[2], 0.0)))
        out[:, 2] = np.where(fell1 | (state == 0), self.arc[0], 0.0)
        return out

    def walk(self, first: int, context: int, own: int) -> float:
        """Log probability of the ``own`` tokens after the context, added up from left to right."""
        begin = first + context
        return float(np.cumsum(self.steps[begin : begin + own])[-1]) if own else 0.0


def score(docs: DataFrame, training, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, discount: float = DISCOUNT, words_broadcast: int = VOCABULARY) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` is a condition on the documents; those for which it does not hold are held out of training, null counts
    as training. base_score adds the add-one unigram log10 probabilities of all tokens, score is the automaton's. A null
    or empty text is its end token alone. Texts of any length are walked whole. Rows are neither dropped nor merged.
    Without training texts every token has probability 1 and no state but the root exists. ``order`` is 1, 2 or 3.
    ``words_broadcast`` moves work between broadcast and answers, and changes no score.
    """
    if not (1 <= order <= 3 and min_count >= 2 and 0 < discount < 1):
        raise ValueError("an order of 1 to 3, a least count of 2 or more, and a discount between 0 and 1")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (~F.coalesce(training, F.lit(True))).alias("held_out"))
    types = stored(word_counts(rows), "types")
    n_train, n_types, n_all = types.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("seen"), F.lit(0))).first()
    size = float(n_train + n_types + 1)
    words = vocabulary(types, words_broadcast)
    shared = spark.sparkContext.broadcast(words)
    parts = stored(chunks(rows, shared), "chunks")
    ranges = max(1, -(-int(n_all) // RANGE))
    answered = stored(answers(sent(parts, shared, ranges, order).repartition(ranges, "range"), min_count), "answers")
    arcs = spark.sparkContext.broadcast(word_arcs(answered, words))
    n_chunks = max(1, min(parts.count(), 10 * ranges))

    def run(left, right):
        grams = Grams(left.column("docs")[0].as_py(), left.column("part")[0].as_py(), shared.value, order, places=True)
        blobs = dict(zip(right.column("range").to_pylist(), right.column("blob")))
        answer = [np.zeros(len(grams.key), np.int64) for _ in range(3)]
        for r, at in grams.by_range(ranges):
            for whole, some in zip(answer, unpack(blobs[r].as_py())):
                whole[at] = some.astype(np.int64)
        machine = Automaton(grams, shared.value, *arcs.value, answer, size, discount)
        length = np.diff(np.append(grams.first, len(grams.codes)))
        context = length - grams.own
        own_sum = lambda x: np.add.reduceat(np.where(grams.is_own, x, 0), grams.first)
        scores = [machine.walk(*span) for span in zip(grams.first.tolist(), context.tolist(), grams.own.tolist())]
        return pa.table([pa.array(grams.rows), pa.array(grams.ids, mask=grams.has_id == 0), pa.array(grams.held_out != 0), pa.array(grams.own), pa.array(own_sum(machine.count > 0).astype(np.int64)), pa.array(own_sum(machine.arc[0])), pa.array(scores, pa.float64())], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    asked = parts.repartition(n_chunks, "chunk").groupBy("chunk")
    walked = asked.cogroup(answered.filter("chunk >= 0").repartition(n_chunks, "chunk").groupBy("chunk")).applyInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    # parts of one text add up in decimals: their order doesn't matter
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,14)")).cast("double")
    whole = walked.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), exact("base").alias("base_score"), exact("score").alias("score"))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"), "base_score", "score")
