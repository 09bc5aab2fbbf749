"""Spelling variants by finite-state composition.

The vocabulary is counted in Spark. Words are near when the one-edit transducer carries one to the
other, so near pairs are the accepted pairs of ``acceptor o one edit o acceptor``. The place of the
edit is the length of the common beginning, and it lies in exactly one block ``lo:hi`` of the
shorter word; a pair of words agrees on everything outside of that block. Words are dealt by what
lies outside (the initial state of the composition), once as the shorter or equally long word of a
pair and once as the longer one, for two blocks each. A task compiles the blocks' contents of its
initial states into one minimised acceptor, whose states are shared by all of them, and enumerates the pairs.

Initial states with more than ``GROUP_CHARS`` characters (a beginning or an end that very many words
share, or very long words) are cut: their block is halved, again and again, down to one character,
where the alphabet bounds what can meet. Every pair is found once, whatever was halved, and only
counts and best partners of words leave a task, never pairs.

Defined cases: null and empty texts have no words; rows that repeat are counted as often as they
occur; a null id is the empty text in the hash; a word of any length counts; an empty table gives an
empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.sources.shared import discard, written

LETTERS = "[a-zÀ-ÿ]+"
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Characters of blocks that one acceptor holds.
GROUP_CHARS = 200_000
KEY = ("m", "lo", "hi", "outside")


def damaged_runs(df: DataFrame, key: str, text: str, every: int, least_length: int) -> DataFrame:
    """``word`` of every run of letters, one code point deleted where the checksum says so."""
    folded = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    runs = df.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(folded, F.lit(LETTERS), F.lit(0))).alias("run"),
    ).filter(F.length("run") >= least_length)
    check = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    cut = F.expr("concat(substring(run, 1, `check` % length(run)), substring(run, `check` % length(run) + 2))")
    runs = runs.withColumn("check", check)
    return runs.select(F.when(F.col("check") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    every: int = 97,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""
    words = damaged_runs(df, key, text, every, least_length).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


class Acceptor:
    """Minimal acceptors of sets of words of one length, sharing their states.

    A state's words are numbered in order; an arc knows how many of them come before its own.
    State 0 accepts the empty word alone.
    """

    def __init__(self):
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]
        self.sizes = [1]
        self.known: dict[tuple, int] = {}
        self.replaced: dict[int, list[tuple[int, int]]] = {0: []}

    def _state(self, arcs: list[tuple[str, int]]) -> int:
        name = tuple(arcs)
        found = self.known.get(name)
        if found is None:
            found = self.known[name] = len(self.arcs)
            size, placed = 0, {}
            for letter, target in arcs:
                placed[letter] = target, size
                size += self.sizes[target]
            self.arcs.append(placed)
            self.sizes.append(size)
        return found

    def compiled(self, words: list[str]) -> int:
        """The initial state of distinct sorted words of one length."""
        width = len(words[0])
        open_: list[list[tuple[str, int]]] = [[] for _ in range(width)]
        for word, after in zip(words, [*words[1:], None]):
            same = 0
            if after is not None:
                while word[same] == after[same]:
                    same += 1
            target = 0
            for depth in range(width - 1, same - 1, -1):
                open_[depth].append((word[depth], target))
                if depth > same or after is None:
                    target = self._state(open_[depth])
                    open_[depth] = []
        return target

    def common(self, p: int, q: int, at: int, to: int) -> Iterator[tuple[int, int]]:
        """Numbers of the words that both states accept, counted from ``at`` and ``to``."""
        left = [(p, q, at, to)]
        while left:
            p, q, at, to = left.pop()
            if p == q:
                for i in range(self.sizes[p]):
                    yield at + i, to + i
                continue
            own, other = self.arcs[p], self.arcs[q]
            for letter in own.keys() & other.keys():
                (a, i), (b, j) = own[letter], other[letter]
                left.append((a, b, at + i, to + j))

    def replacements(self, state: int) -> list[tuple[int, int]]:
        """Pairs of the state's words that differ in one letter."""
        todo = [state]
        while todo:
            p = todo[-1]
            if p in self.replaced:
                todo.pop()
                continue
            arcs = list(self.arcs[p].values())
            missing = [t for t, _ in arcs if t not in self.replaced]
            if missing:
                todo += missing
                continue
            found = [(at + i, at + j) for t, at in arcs for i, j in self.replaced[t]]
            for (t, at), (u, to) in combinations(arcs, 2):
                if t == u or self.arcs[t].keys() & self.arcs[u].keys():
                    found += self.common(t, u, at, to)
            self.replaced[p] = found
            todo.pop()
        return self.replaced[state]

    def insertions(self, p: int, q: int, at_end: bool) -> Iterator[tuple[int, int]]:
        """Pairs of a word of ``p`` and the word of ``q`` that has one more letter.

        The letter stands behind the longest common beginning; at the very end only with ``at_end``.
        """
        left = [(p, q, 0, 0)]
        while left:
            p, q, at, to = left.pop()
            if p == 0:
                if at_end:
                    for _, j in self.arcs[q].values():
                        yield at, to + j
                continue
            own = self.arcs[p]
            for letter, (b, j) in self.arcs[q].items():
                behind = self.arcs[b]
                for other in own.keys() & behind.keys():
                    if other != letter:
                        (a, i), (c, k) = own[other], behind[other]
                        yield from self.common(a, c, at + i, to + j + k)
                if letter in own:
                    a, i = own[letter]
                    left.append((a, b, at + i, to + j))


class Partners:
    """For each word the number of near words and the best of them."""

    def __init__(self):
        self.best: dict[str, tuple[int, int, str]] = {}

    def add(self, word: str, partner: str, n: int) -> None:
        seen, most, best = self.best.get(word, (0, 0, ""))
        if n > most or n == most and partner < best:
            most, best = n, partner
        self.best[word] = seen + 1, most, best

    def batch(self) -> pa.RecordBatch:
        rows = list(zip(*self.best.values())) or [(), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array(c, k) for c, k in zip((list(self.best), *rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "near_n", "near"])


def _compose(acceptor: Acceptor, partners: Partners, key: tuple, rows: list[tuple[str, int]]) -> None:
    """Near pairs of one initial state; ``rows`` are its words and counts in order."""
    m, lo, hi, _ = key
    short = [(w, n) for w, n in rows if len(w) == m]
    long = [(w, n) for w, n in rows if len(w) > m]
    if not short or len(rows) < 2:
        return
    first = acceptor.compiled([w[lo:hi] for w, _ in short])
    pairs = [(short[i], short[j]) for i, j in acceptor.replacements(first)]
    if long:
        second = acceptor.compiled([w[lo : hi + 1] for w, _ in long])
        pairs += [(short[i], long[j]) for i, j in acceptor.insertions(first, second, hi == m)]
    for (a, n), (b, k) in pairs:
        partners.add(a, b, k)
        partners.add(b, a, n)


def _partners(group_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of their initial states, which may go on in the next batch."""
        acceptor, partners, chars = Acceptor(), Partners(), 0
        key, rows = None, []
        for batch in batches:
            *names, words, counts = (batch[c].to_pylist() for c in (*KEY, "word", "n"))
            for *name, word, n in zip(*names, words, counts):
                if name != key:
                    if rows:
                        _compose(acceptor, partners, key, rows)
                    if chars > group_chars:
                        yield partners.batch()
                        acceptor, partners, chars = Acceptor(), Partners(), 0
                    key, rows = name, []
                rows.append((word, n))
                chars += key[2] - key[1] + 1
        if rows:
            _compose(acceptor, partners, key, rows)
        yield partners.batch()

    return run


def _outside(rows: DataFrame) -> DataFrame:
    """The same with what lies outside of the block; a longer word's block has one letter more."""
    ends = "substring(word, 1, lo), '|', substring(word, hi + length(word) - m + 1)"
    return rows.withColumn("outside", F.expr(f"concat({ends})"))


def initial_states(words: DataFrame, least_length: int = LEAST_LENGTH, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``word, n, m, lo, hi, outside``: every word at the initial states of its compositions."""
    roles = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")
    rows = words.select("word", "n", roles).filter(F.col("m") >= least_length)
    half = F.expr("m div 2")
    blocks = F.array(
        F.struct(F.lit(0).cast("bigint").alias("lo"), half.alias("hi")),
        F.struct(half.alias("lo"), F.col("m").cast("bigint").alias("hi")),
    )
    rows = _outside(rows.select("word", "n", "m", F.inline(blocks)))
    kept = []
    while True:
        rows = written(rows, "initial_states")
        sizes = rows.groupBy(*KEY).agg(F.count("*").alias("words"))
        hot = sizes.filter((F.col("words") * (F.col("hi") - F.col("lo") + 1) > group_chars) & F.expr("hi - lo > 1"))
        hot = written(hot.filter("words > 1").select(*KEY), "hot_states")
        if hot.isEmpty():
            kept.append(rows)
            break
        kept.append(rows.join(hot, list(KEY), "left_anti"))
        middle = F.expr("(lo + hi) div 2")
        halves = F.array(
            F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi"))
        )
        rows = rows.join(hot, list(KEY), "left_semi").select("word", "n", "m", F.inline(halves))
        rows = _outside(rows)
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``word, n_near, near_n, near`` of the words ``word, n`` that have near words.

    ``near`` is the most frequent of them, of equally frequent ones the first in code-point order.
    """
    states = initial_states(words, least_length, group_chars)
    states = states.repartition(*KEY).sortWithinPartitions(*KEY, "word")
    found = states.mapInArrow(_partners(group_chars), "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.least")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words ``word, form``: the last of the forms, by pointer jumping."""
    links = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = links.select("word", "root").join(ahead, "root", "left")
        longer = written(
            joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "roots",
        )
        discard(links)
        links = longer
        if links.filter("moved").isEmpty():
            return links.select("word", "root")


def spelling_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", group_chars: int = GROUP_CHARS, **options
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of the vocabulary."""
    words = written(vocabulary(df, key, text, **options), "vocabulary")
    near = near_words(words, options.get("least_length", LEAST_LENGTH), group_chars)
    follows = F.col("near_n") >= 2 * F.col("n")
    known = written(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(follows, F.col("near")).alias("form"),
            F.when(follows, F.col("near_n")).alias("form_n"),
        ),
        "known_words",
    )
    last = roots(known.filter("form IS NOT NULL"))
    return known.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
