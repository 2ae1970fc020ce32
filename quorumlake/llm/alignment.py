"""Sentence pairs of bilingual records (problem 2).

Three passes. Every record is first aligned by sentence lengths alone (dynamic programming over beads 1-1, 1-0, 0-1, 2-1,
1-2); its confident 1-1 beads, reduced to plain words and counted, are the training pairs. Word-translation probabilities
in both directions are trained on them by expectation-maximisation (each iteration is one distributed pass and one
aggregate). Then every record is aligned again by dynamic programming over lexical scores, and what crosses the order is
matched from the rest.

A record never leaves its row, so no shuffle carries texts; what is shuffled are training pairs, word pairs and results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.session import written

#: Iterations; least probability kept while training and in the table used; a score below ACCEPT is no translation.
ITERATIONS, PRUNE, KEEP, ACCEPT = 5, 0.003, 0.05, 0.42
#: A word that occurs in fewer training pairs is no part of the table: it can only match
#: the very same word on the other side, as names and figures do.
LEAST = 3
#: Training pairs up to which each counts with the root of its number.
PAIRS = 500_000

# The rule for sentences and words, as patterns for Spark: they are applied to whole texts in generated code. A figure is
# written alike in both languages; tags and line breaks end a sentence, and so do . ? ! before white space; a number or
# letter with a stop in front keeps to what follows it (its blank is hidden behind a mark), and is then dropped, since
# numbering may differ between languages; words are letters, or digits with inner points.
_SPACE = r"[\s\u00a0\u202f]"
_FRONT = r"\(?(?:\d{1,4}|[A-Za-z]|[ivxIVX]{1,5})"
# Every pattern begins with a character that is seldom there; what must stand before it is looked at afterwards.
_STEPS = (
    (r"<[^>]*>", "\n"),
    (r"[ ,\u00a0\u202f](?=\d{3}(?!\d))(?<=(?<!\d)\d{1,3}.)", ""),
    (r",(?=\d)(?<=\d,)", "."),
    (rf"(^|\n{_SPACE}*|[.?!]{_SPACE}+)({_FRONT}[.)]*\.)[ \t\u00a0]+(?=\S)", "$1$2\u0001"),
    (rf"([.?!]){_SPACE}+", "$1\n"),
    (rf"\n{_SPACE}*", "\n"),
    (rf"(?dm)^(?:{_FRONT}[.)]+[ \u0001\u00a0]+|\d{{1,4}} +(?=[A-ZÀ-ÖØ-Þ]))", ""),
)
_EDGE = " \t\n\r\u00a0\u202f"


def sentence_words(text: Column) -> Column:
    """The sentences of a text in order, one per line, as lower-case words and figures between blanks; a sentence without any
    word is a line with a blank. Null gives null, a text without sentences ''."""
    text = F.replace(F.btrim(text, F.lit(_EDGE)), F.lit("\r"), F.lit("\n"))
    for k, (pattern, by) in enumerate(_STEPS):
        text = F.regexp_replace(text, pattern, by)
        if k in (2, 5):
            text = F.btrim(text, F.lit(_EDGE))
    return F.regexp_replace(F.lower(text), r"[[^ a-z]&&[^\p{L}\d.:\n ]]+|[.:](?:(?!\d)|(?<!\d.))", " ")


#: Quotients of like lengths: their logarithm is less than a quarter.
_LIKE = math.exp(-0.25), math.exp(0.25)


def by_length(a: list[int], b: list[int], ratio: float) -> list[tuple[int, int, int, int]]:
    """Beads (i, di, j, dj) of the cheapest length alignment: sentence lengths are expected in proportion `ratio`."""
    n, m = len(a), len(b)
    if n == m and all(_LIKE[0] < (y + 4.0) / (x * ratio + 4.0) < _LIKE[1] for x, y in zip(a, b)):
        return [(i, 1, i, 1) for i in range(n)]  # no other path can be cheaper by more than it differs
    inf = 1e18
    # Logarithms of all single and double sentences, so the inner loop only subtracts.
    la = [math.log(x * ratio + 4.0) for x in a]
    lb = [math.log(y + 4.0) for y in b]
    la2 = [math.log((x + y) * ratio + 4.0) for x, y in zip(a, a[1:])]
    lb2 = [math.log(x + y + 4.0) for x, y in zip(b, b[1:])]
    cost = [[inf] * (m + 1) for _ in range(n + 1)]
    back: list[list[tuple[int, int]]] = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    cost[0][0] = 0.0
    for i in range(n + 1):
        row, below = cost[i], cost[i + 1] if i < n else None
        for j in range(m + 1):
            c = row[j]
            if c >= inf:
                continue
            if i < n:
                if j < m:
                    d = c + 4.0 * abs(lb[j] - la[i])
                    if d < below[j + 1]:
                        below[j + 1], back[i + 1][j + 1] = d, (1, 1)
                d = c + 4.5
                if d < below[j]:
                    below[j], back[i + 1][j] = d, (1, 0)
            if j < m:
                d = c + 4.5
                if d < row[j + 1]:
                    row[j + 1], back[i][j + 1] = d, (0, 1)
                if i + 1 < n:
                    d = c + 2.3 + 4.0 * abs(lb[j] - la2[i])
                    if d < cost[i + 2][j + 1]:
                        cost[i + 2][j + 1], back[i + 2][j + 1] = d, (2, 1)
                if i < n and j + 1 < m:
                    d = c + 2.3 + 4.0 * abs(lb2[j] - la[i])
                    if d < below[j + 2]:
                        below[j + 2], back[i + 1][j + 2] = d, (1, 2)
    out = []
    i, j = n, m
    while i or j:
        di, dj = back[i][j]
        i, j = i - di, j - dj
        out.append((i, di, j, dj))
    return out[::-1]


def _pair(x: str, y: str) -> str:
    """'words TAB words' of two sentences without what they share; '' where they aren't confident: nothing is left, or a figure
    stands on one side only."""
    u, v = set(x.split()), set(y.split())
    same = u & v
    left, right = sorted(u - same), sorted(v - same)
    if left and right and left[0] > ":" and right[0] > ":":
        return " ".join(left) + "\t" + " ".join(right)
    return ""


#: Pairs of sentences that a task remembers: stock phrases come again and again.
REMEMBERED = 200_000


def _training(a: list[str], b: list[str], ratio: float, known: dict[tuple[str, str], str]) -> list[str]:
    """Confident pairs of one record (its sentences as words) as 'words TAB words'; `known` remembers those met before."""
    out = []
    for i, di, j, dj in by_length([len(s) for s in a], [len(s) for s in b], ratio):
        x, y = a[i] if di else "", b[j] if dj else ""
        if di == dj == 1 and 0.5 <= (len(y) + 8) / (len(x) * ratio + 8) <= 2.0:
            got = known.get((x, y))
            if got is None:
                if len(known) > REMEMBERED:
                    known.clear()
                got = known[x, y] = _pair(x, y)
            if got:
                out.append(got)
    return out


class Lexicon:
    """What each word of a language may be translated by, and its weight."""

    def __init__(self, table: pd.DataFrame, weights: pd.DataFrame) -> None:
        found: dict[str, dict[str, list[tuple[str, float]]]] = {"e": {}, "f": {}}
        for e, f, pf, pe in table.itertuples(index=False):
            if pf >= KEEP:
                found["e"].setdefault(e, []).append((f, min(1.0, pf / 0.3)))
            if pe >= KEEP:
                found["f"].setdefault(f, []).append((e, min(1.0, pe / 0.3)))
        #: word -> (weight, ((translation, probability) from the most probable down))
        self.words: dict[str, dict[str, tuple[float, tuple[tuple[str, float], ...]]]] = {"e": {}, "f": {}}
        for s, w, x in weights.itertuples(index=False):
            own = sorted(found[s].get(w, []), key=lambda z: (-z[1], z[0]))
            self.words[s][w] = (x if x >= STOP else 0.0, tuple(own))

    def shown(self, words: set[str], other: set[str], lang: str) -> float:
        """How much of the words the other sentence shows, by weight."""
        total = got = 0.0
        get = self.words[lang].get
        for t in words:
            w, known = get(t, _STRANGE)
            if w:
                total += w
                if t in other:
                    got += w
                else:
                    for k, p in known:
                        if k in other:
                            got += w * p
                            break
        return got / total if total else 0.0

    def side(self, words: set[str], lang: str) -> tuple[list[tuple[str, float]], float, dict[str, float]]:
        """(words with weights, their sum, what the other language may show for them)."""
        out, total = [], 0.0
        shown: dict[str, float] = {}
        get = self.words[lang].get
        for t in words:
            w, known = get(t, _STRANGE)
            if w:
                out.append((t, w))
                total += w
                for k, p in known:
                    if k not in shown or p > shown[k]:
                        shown[k] = p
                shown[t] = 1.0  # figures, names, and words that both languages share
        return out, total or 1.0, shown

    def sure(self, x: set[str], y: set[str]) -> bool:
        return self.shown(x, y, "e") >= SURE and self.shown(y, x, "f") >= SURE

    def pairs(self, a: list[set[str]], b: list[set[str]]) -> set[tuple[int, int]] | None:
        """Pairs of sentences, None for all i = j. What covers its counterpart surely from the front and from the back is
        settled; the rest, with a neighbour on either side, is searched."""
        n, m = len(a), len(b)
        least = min(n, m)
        p = 0
        while p < least and self.sure(a[p], b[p]):
            p += 1
        if p == n == m:
            return None
        s = 0
        while s < least - p and self.sure(a[n - 1 - s], b[m - 1 - s]):
            s += 1
        p, s = max(0, p - 1), max(0, s - 1)
        got = by_words([self.side(x, "e") for x in a[p : n - s]], [self.side(x, "f") for x in b[p : m - s]])
        return {(i, i) for i in range(p)} | {(p + i, p + j) for i, j in got} | {(n - 1 - k, m - 1 - k) for k in range(s)}


#: Least score of a pair of two sentences left over, wherever they stand.
CROSSING = 0.36
#: A pair covered so far in both directions needs no comparison with others.
SURE = 0.62
#: Weight of a figure or a word without translations; words of less than STOP (in more than a fifth of all pairs) tell
#: nothing apart and count for nothing.
UNKNOWN, STOP = 5.0, 1.6
_STRANGE = (UNKNOWN, ())


def _cover(words: list[tuple[str, float]], total: float, shown: dict[str, float]) -> float:
    got = 0.0
    for t, w in words:
        if t in shown:
            got += w * shown[t]
    return got / total


def _covers(a: list, b: list) -> list[list[float]]:
    """`_cover` of each of a by each of b."""
    shown = [y[2] for y in b]
    out = []
    for words, total, _ in a:
        row = []
        for z in shown:
            got = 0.0
            for t, w in words:
                if t in z:
                    got += w * z[t]
            row.append(got / total)
        out.append(row)
    return out


def _both(x: dict[str, float], y: dict[str, float]) -> dict[str, float]:
    out = dict(x)
    for k, v in y.items():
        if v > out.get(k, 0.0):
            out[k] = v
    return out


def by_words(a: list, b: list) -> set[tuple[int, int]]:
    """Pairs (i, j) of sentences that translate each other; a and b as of `Lexicon.side`."""
    n, m = len(a), len(b)
    ce = _covers(a, b)  # how much of the English sentence the French one shows
    cf = list(zip(*_covers(b, a)))
    one = [[(ce[i][j] + cf[i][j]) / 2 for j in range(m)] for i in range(n)]
    if n == m == 1:
        return {(0, 0)} if one[0][0] >= ACCEPT * 0.8 else set()
    neg = -1e18
    best = [[neg] * (m + 1) for _ in range(n + 1)]
    back: list[list[tuple[int, int]]] = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        row, steps = best[i], back[i]
        if i == n:
            for j in range(m):
                if row[j] > row[j + 1]:
                    row[j + 1], steps[j + 1] = row[j], (0, 1)
            break
        below, under = best[i + 1], back[i + 1]
        ones, e0, f0 = one[i], ce[i], cf[i]
        e1 = ce[i + 1] if i + 1 < n else None
        for j in range(m + 1):
            c = row[j]
            if c > below[j]:
                below[j], under[j] = c, (1, 0)
            if j == m:
                break
            if c > row[j + 1]:
                row[j + 1], steps[j + 1] = c, (0, 1)
            g = ones[j] - ACCEPT
            if g > 0 and c + g > below[j + 1]:
                below[j + 1], under[j + 1] = c + g, (1, 1)
            # Two sentences of one side against one of the other, of which each shows a good part.
            if e1 is not None and e0[j] >= 0.45 and e1[j] >= 0.45:
                g = 1.6 * ((_cover(b[j][0], b[j][1], _both(a[i][2], a[i + 1][2])) + (e0[j] + e1[j]) / 2) / 2 - ACCEPT)
                if g > 0 and c + g > best[i + 2][j + 1]:
                    best[i + 2][j + 1], back[i + 2][j + 1] = c + g, (2, 1)
            if j + 1 < m and f0[j] >= 0.45 and f0[j + 1] >= 0.45:
                g = 1.6 * ((_cover(a[i][0], a[i][1], _both(b[j][2], b[j + 1][2])) + (f0[j] + f0[j + 1]) / 2) / 2 - ACCEPT)
                if g > 0 and c + g > below[j + 2]:
                    below[j + 2], under[j + 2] = c + g, (1, 2)
    out: set[tuple[int, int]] = set()
    i, j = n, m
    while i or j:
        di, dj = back[i][j]
        i, j = i - di, j - dj
        out |= {(i + x, j + y) for x in range(di) for y in range(dj)}
    # What crosses the order: the best of the rest, each once.
    left_a, left_b = set(range(n)) - {x for x, _ in out}, set(range(m)) - {y for _, y in out}
    if left_a and left_b:
        for s, x, y in sorted(((one[x][y], x, y) for x in left_a for y in left_b if one[x][y] >= CROSSING), key=lambda z: (-z[0], z[1], z[2])):
            if x in left_a and y in left_b:
                out.add((x, y))
                left_a.discard(x)
                left_b.discard(y)
    # One left over may be a part of a sentence that already has a partner and shows more than the partner covers.
    for x in sorted(left_a):
        y = max(range(m), key=lambda y: ce[x][y])
        mates = [p for p, q in out if q == y]
        if ce[x][y] >= 0.6 and len(mates) == 1 and sum(q == y for _, q in out) == 1 and sum(p == mates[0] for p, _ in out) == 1:
            if _cover(b[y][0], b[y][1], _both(a[x][2], a[mates[0]][2])) >= cf[mates[0]][y] + 0.15:
                out.add((x, y))
    for y in sorted(left_b):
        x = max(range(n), key=lambda x: cf[x][y])
        mates = [q for p, q in out if p == x]
        if cf[x][y] >= 0.6 and len(mates) == 1 and sum(q == mates[0] for _, q in out) == 1:
            if _cover(a[x][0], a[x][1], _both(b[y][2], b[mates[0]][2])) >= ce[x][mates[0]] + 0.15:
                out.add((x, y))
    return out


#: Word pairs of two vocabularies up to which a task holds the place of each in the table; and cells that are looked at at once.
PLACES, CELLS = 1 << 24, 400_000


def _expected(keys: np.ndarray | None, pf: np.ndarray | None, pe: np.ndarray | None, height: int, width: int):
    """A pass that sums the expected counts of word pairs under a table (sorted keys e * width + f; None: all alike)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, room = 0, height * width if keys is None else len(keys)
        place = sums = None
        if keys is not None and height * width <= PLACES:
            place = np.full(height * width, -1, dtype=np.int64)
            place[keys] = np.arange(len(keys))

        def told(k: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": k if keys is None else keys[k], "cf": a, "ce": b})

        def summed() -> pa.RecordBatch:
            k, a, b = (np.concatenate(x) for x in zip(*held))
            u, inv = np.unique(k, return_inverse=True)
            return told(u, np.bincount(inv, a), np.bincount(inv, b))

        for batch in batches:
            lists = [batch.column(c) for c in ("e", "f")]
            each = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
            words = [x.flatten().to_numpy().astype(np.int64) for x in lists]
            ends = [np.concatenate(([0], np.cumsum(n))) for n in each]
            weight, cells = batch.column("w").to_numpy(), np.cumsum(each[0] * each[1])
            lo = 0
            while lo < len(cells):
                hi = max(lo + 1, int(np.searchsorted(cells, (cells[lo - 1] if lo else 0) + CELLS, side="right")))
                ne, nf, w = each[0][lo:hi], each[1][lo:hi], weight[lo:hi]
                e, f = (words[i][ends[i][lo] : ends[i][hi]] for i in (0, 1))
                lo = hi
                # One cell per word pair of a sentence pair: word slots ie, jf, of which several make one sum.
                per = np.repeat(nf, ne)
                jf = np.repeat(np.repeat(np.cumsum(nf) - nf, ne) - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
                at = np.repeat(e * width, per) + f[jf]
                if keys is None:  # each word of the other side gets the same share
                    ca, cb = np.repeat(w * (1.0 / ne), ne * nf), np.repeat(w * (1.0 / nf), ne * nf)
                elif len(keys):
                    if place is not None:
                        at = place[at]
                        hit = np.flatnonzero(at >= 0)
                        at = at[hit]
                    else:
                        pos = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
                        hit = np.flatnonzero(keys[pos] == at)
                        at = pos[hit]
                    if not len(hit):
                        continue
                    jf, ie = jf[hit], np.repeat(np.arange(len(e)), per)[hit]
                    a, b = pf[at], pe[at]
                    # The weight of a pair over the sum of a word's row or column, by word; none where the sum is nothing.
                    sa, sb = np.bincount(jf, a, len(f)), np.bincount(ie, b, len(e))
                    ca = a * np.divide(np.repeat(w, nf), sa, out=np.zeros_like(sa), where=sa > 0)[jf]
                    cb = b * np.divide(np.repeat(w, ne), sb, out=np.zeros_like(sb), where=sb > 0)[ie]
                else:
                    continue
                if room <= 4 * CELLS:  # few enough word pairs to sum at their places
                    got = np.bincount(at, ca, room), np.bincount(at, cb, room)
                    sums = got if sums is None else (sums[0] + got[0], sums[1] + got[1])
                    continue
                u, inv = np.unique(at, return_inverse=True)
                held.append((u, np.bincount(inv, ca, len(u)), np.bincount(inv, cb, len(u))))
                size += len(u)
                if size > 3_000_000:
                    yield summed()
                    held, size = [], 0
        if sums is not None:
            some = np.flatnonzero((sums[0] > 0) | (sums[1] > 0))
            yield told(some, sums[0][some], sums[1][some])
        if held:
            yield summed()

    return run


def train_lexicon(pairs: DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(table e, f, t(f|e), t(e|f); word weights) from counted training pairs (en, fr, n).

    IBM model 1 in both directions at once: a pass over the pairs gives expected counts under the last table, which an
    aggregate sums and normalises. The first pass counts co-occurrence. A pair counts with the root of its number, so that
    stock phrases don't drown the rest. In an input of more than `PAIRS` pairs numbers are first brought to those of so many,
    and what is then below one counts as it is: chance pairs, of which there are ever new ones, would otherwise outweigh the
    phrases as the input grows."""
    said = lambda s, c: pairs.select(F.lit(s).alias("s"), F.explode(F.split(c, " ")).alias("w"), "n")
    occ = said("e", "en").unionByName(said("f", "fr")).filter("w <> ''").groupBy("s", "w").agg(F.sum("n").alias("n"))
    occ = written(occ, "p2-words")
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # The words in the table, the same however large the rest of the input is: every task holds at most 2 / KEEP entries of each.
    known = occ.filter(F.col("n") >= LEAST)
    scale = F.log(F.lit(float(max(total, 2))) / F.col("n"))
    weights = known.select("s", "w", F.least(F.lit(UNKNOWN), F.greatest(F.lit(0.2), scale)).alias("x")).orderBy("s", "w").toArrow().to_pandas()
    # Words that count for nothing aren't trained either.
    vocab = weights[weights["x"] >= STOP]
    es, fs = (vocab.loc[vocab["s"] == s, "w"].tolist() for s in "ef")
    ids = pairs.sparkSession.sparkContext.broadcast((es, fs))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [pa.array(words, type=pa.string()) for words in ids.value]
        for batch in batches:
            out = []
            for c, words in zip(("en", "fr"), known):
                said = pc.split_pattern(batch.column(c), " ")
                at = pc.index_in(said.flatten(), value_set=words)
                # Where each row's words begin once those without a number are left out.
                before = np.concatenate(([0], np.cumsum(at.is_valid().to_numpy(zero_copy_only=False))))
                ends = np.concatenate(([0], np.cumsum(said.value_lengths().to_numpy(zero_copy_only=False))))
                out.append(pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), at.drop_null()))
            both = pc.and_(pc.greater(out[0].value_lengths(), 0), pc.greater(out[1].value_lengths(), 0))
            yield pa.RecordBatch.from_arrays([*out, batch.column("n")], ["e", "f", "n"]).filter(both)

    coded = pairs.select("en", "fr", "n").mapInArrow(encode, "e array<int>, f array<int>, n long")
    coded = coded.groupBy("e", "f").agg((F.sum("n") / max(1.0, total / PAIRS)).alias("w"))
    coded = written(coded.withColumn("w", F.least("w", F.sqrt("w"))), "p2-coded")
    height, width = max(1, len(es)), max(1, len(fs))
    keys = pf = pe = None
    for it in range(ITERATIONS + 1):
        sums = coded.mapInArrow(_expected(keys, pf, pe, height, width), "key long, cf double, ce double").groupBy("key").agg(
            F.sum("cf").alias("cf"), F.sum("ce").alias("ce")
        ).withColumn("e", F.expr(f"key div {width}L")).withColumn("f", F.expr(f"key % {width}L"))
        sums = written(sums, f"p2-em{it}")
        te, tf = sums.groupBy("e").agg(F.sum("cf").alias("te")), sums.groupBy("f").agg(F.sum("ce").alias("tf"))
        keep = KEEP if it == ITERATIONS else PRUNE
        table = (
            sums.join(te, "e").join(tf, "f").select("key", "cf", (F.col("cf") / F.col("te")).alias("pf"), (F.col("ce") / F.col("tf")).alias("pe"))
            .filter((F.col("pf") >= keep) | (F.col("pe") >= keep)).toArrow().to_pandas().sort_values("key")  # at most 2 / keep per word
        )
        keys, pf, pe = table["key"].to_numpy(), table["pf"].to_numpy(), table["pe"].to_numpy()
    table = table[table["cf"] >= 0.5]
    at = table["key"].to_numpy()
    table = pd.DataFrame({"e": [es[k] for k in at // width], "f": [fs[k] for k in at % width], "pf": table["pf"].to_numpy(), "pe": table["pe"].to_numpy()})
    return table, weights


def aligned(records: DataFrame) -> DataFrame:
    """record_kind, record_id, en_no, fr_no of all sentence pairs of `records` (record_kind, record_id, version, en, fr).

    Records with a null or empty text in one language, and rows with a null id, have no pairs. Of rows with one kind and id
    the one of the greatest version counts, of equal ones the one that sorts last by its pairs. Texts are used whole."""
    usable = records.filter("record_id is not null and trim(en) <> '' and trim(fr) <> ''")
    sizes = usable.agg(F.sum(F.length("en")).alias("e"), F.sum(F.length("fr")).alias("f")).first()
    ratio = (sizes.f or 1) / (sizes.e or 1)

    @F.pandas_udf("string")
    def training(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[tuple[str, str], str] = {}
        for en, fr in batches:
            yield pd.Series(["\n".join(_training(x.split("\n"), y.split("\n"), ratio, known)) if x and y else "" for x, y in zip(en, fr)], dtype=object)

    cut = usable.select("record_kind", "record_id", "version", sentence_words(F.col("en")).alias("en"), sentence_words(F.col("fr")).alias("fr"))
    told = cut.withColumn("pairs", training("en", "fr"))
    told = written(told, "p2-words-of-records")
    pairs = told.filter("pairs <> ''").select(F.explode(F.split("pairs", "\n")).alias("p"))
    pairs = pairs.select(F.split("p", "\t").alias("p")).select(F.col("p")[0].alias("en"), F.col("p")[1].alias("fr"))
    pairs = written(pairs.groupBy("en", "fr").agg(F.count("*").alias("n")), "p2-training")
    lexicon = records.sparkSession.sparkContext.broadcast(train_lexicon(pairs))

    @F.pandas_udf("string")
    def align(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        lex = Lexicon(*lexicon.value)
        diagonal: dict[int, str] = {}
        for ens, frs in batches:
            out = []
            for en, fr in zip(ens, frs):
                if not en or not fr:
                    out.append("")
                    continue
                a, b = [set(x.split()) for x in en.split("\n")], [set(x.split()) for x in fr.split("\n")]
                got = lex.pairs(a, b)
                if got is None:
                    n = len(a)
                    if n not in diagonal:
                        diagonal[n] = " ".join(f"{i}:{i}" for i in range(1, n + 1))
                    out.append(diagonal[n])
                else:
                    out.append(" ".join(f"{i + 1}:{j + 1}" for i, j in sorted(got)))
            yield pd.Series(out, dtype=object)

    got = told.select("record_kind", "record_id", "version", align("en", "fr").alias("p"))
    got = got.groupBy("record_kind", "record_id").agg(F.max(F.struct("version", "p"))["p"].alias("p")).filter("p <> ''")
    got = got.select("record_kind", "record_id", F.explode(F.split("p", " ")).alias("p"))
    no = lambda k: F.split_part("p", F.lit(":"), F.lit(k)).cast("int")
    return got.select("record_kind", "record_id", no(1).alias("en_no"), no(2).alias("fr_no"))
