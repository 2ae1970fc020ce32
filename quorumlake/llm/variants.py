"""Variant spellings of persons and organisations, linked (problem 5).

Typed forms become character 3-gram vectors, TF-IDF weighted, in three fields (family name, given name, organisation). Linked
are all pairs of forms with a cosine of at least `THRESHOLD` whose parts of the names pass a check, since people of one family
name or organisation are as similar as spellings of one person. Every gram is borne by a part of all forms, so pairs that share
grams grow with the square of the input, even with the rarest ones only. The join is therefore made on what the check asks of
any pair: like family names, or organisations of which each has a word like one of the other. It is exact, there is no cap on
partners, and the cosine is taken for what passes. Components of the links are then grouped by average linkage.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm import names as N
from quorumlake.session import written

#: Least cosine of a candidate pair; weight of each field's unit vector; least average similarity within a group.
THRESHOLD, FIELD_WEIGHT, LINKAGE = 0.45, {"f": 0.8, "g": 0.3, "o": 0.52, "x": 1.0}, 0.25

#: Forms per part of a family name in the join.
SPLIT = 1000


def _grams(words: list[str], field: str) -> list[str]:
    return [f"{field}{w[i : i + 3]}" for x in words for w in (f"^{x}$",) for i in range(max(1, len(w) - 2))]


def parts(who: str | None, context: str | None) -> dict:
    """The comparable parts of a typed form and its grams."""
    who, context = who or "", context or ""
    if N.is_organisation(who):
        words, kind = N.organisation(context if N.is_acronym(who) and N.is_organisation(context) else who)
        acr = N.initials(words[1:], kind) if len(words) > 2 else ""
        words = [w for i, w in enumerate(words) if not (i == 0 and w == acr)]
        return {"org": True, "given": "", "middle": "", "family": "", "words": words, "kind": kind, "grams": _grams(sorted(words), "x") + ([f"x#{kind}"] if kind else [])}
    given, middle, family = N.person(who)
    words, kind = N.organisation(context)
    grams = _grams(family.split(), "f") + _grams([given] if given else [], "g") + _grams(sorted(words), "o")
    return {"org": False, "given": given, "middle": middle, "family": family, "words": words, "kind": kind, "grams": grams}


# --- the check of a pair ---------------------------------------------------------------------------------------------


def _edits(a: str, b: str, most: int) -> int:
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    p2, p1 = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            d = min(p1[j] + 1, cur[-1] + 1, p1[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, p2[j - 2] + 1)
            cur.append(d)
        if min(cur) > most:
            return most + 1
        p2, p1 = p1, cur
    return p1[-1]


def _alike(a: str, b: str) -> bool:
    """Equal but for typing errors: two edits in long words, one in short ones, none in very short."""
    most = 2 if min(len(a), len(b)) >= 7 else 1 if min(len(a), len(b)) >= 4 else 0
    return _edits(a, b, most) <= most


def _cut(a: str, b: str, least: int) -> bool:
    """One is the beginning of the other, or nearly."""
    if len(a) > len(b):
        a, b = b, a
    return len(a) >= least and (b.startswith(a) or len(a) >= 6 and _alike(a, b[: len(a)]))


def _same_org(a: list[str], ka: str, b: list[str], kb: str) -> float:
    """1 same, 0.5 unknown or one cut off, 0 different."""
    if not a and not ka or not b and not kb:
        return 0.5
    if ka and kb and ka != kb:
        return 0.0
    for x, k in ((a, kb), (b, ka)):
        if len(x) == 1 and k and _cut(x[0], k, 2) and x[0] not in N.DIRECTIONS:
            return 0.5  # only the beginning of the kind is left
    rest, left, hit, cut = list(b), [], 0, False
    for w in a:
        m = next((x for x in rest if x == w), None)
        if m is None and w not in N.DIRECTIONS:
            m = next((x for x in rest if x not in N.DIRECTIONS and _alike(w, x)), None)
        if m is None:
            left.append(w)
        else:
            rest.remove(m)
            hit += 1
    for w in list(left):
        known = N.DIRECTIONS
        m = next((x for x in rest if _cut(w, x, 2) and not (w in known and x in known)), None)
        if m is not None:
            left.remove(w)
            rest.remove(m)
            cut = True
    if left and rest:
        known = set(N.DIRECTIONS)
        # A cut off kind ("Associ") stands beside words of the fuller form.
        loose = [w for w in left + rest if not any(_cut(w, k, 2) for k in (ka, kb) if k)]
        if any(w in known for w in loose) or any(w in left for w in loose) and any(w in rest for w in loose):
            return 0.0
    if hit >= 2 and (not left or not rest) or hit and ka and ka == kb and not left and not rest:
        return 1.0
    return 0.5 if cut or hit else 0.0


def short_form(a: str, b: str) -> bool:
    """Whether one given name may be the short form of the other: shorter, and all but two of its letters, three at least,
    in a row of the other."""
    if len(a) > len(b):
        a, b = b, a
    n = max(3, len(a) - 2)
    return 3 <= len(a) < len(b) and any(a[i : i + n] in b for i in range(len(a) - n + 1))


def same_witness(a: dict, b: dict, nick: bool = False) -> bool:
    """Whether two forms can stand for one witness; `nick`: their given names are known to be used for one person. A name
    may also be the other's short form where family and organisation are the same."""
    if a["org"] != b["org"]:
        return False
    if a["org"]:
        if not a["words"] or not b["words"]:
            return False
        own = [[w for w in x["words"] if w not in N.DIRECTIONS] for x in (a, b)]
        return _same_org(a["words"], a["kind"], b["words"], b["kind"]) > 0 and any(
            w == x or len(w) > 5 and len(x) > 5 and (_cut(w, x, 5) or _alike(w, x)) for w in own[0] for x in own[1]
        )
    ga, gb, fa, fb = a["given"], b["given"], a["family"], b["family"]
    if not fa or not fb:
        return False
    org = _same_org(a["words"], a["kind"], b["words"], b["kind"])
    if org == 0.0:
        return False
    if a["middle"] and b["middle"] and a["middle"] != b["middle"]:
        return False
    given = nick or ga == gb or _alike(ga, gb) or 1 in (len(ga), len(gb)) and ga[:1] == gb[:1] or not ga or not gb
    given = given or org == 1.0 and short_form(ga, gb) and _alike(fa.replace(" ", ""), fb.replace(" ", ""))
    if not given:
        return False
    family = fa == fb or _alike(fa.replace(" ", ""), fb.replace(" ", ""))
    if family:
        return True
    if len(ga) > 1 and len(gb) > 1 and org >= 0.5 and _cut(fa, fb, 3):
        return True
    wa, wb = fa.split(), fb.split()
    return org == 1.0 and len(wa) != len(wb) and (wa[0] in wb or wb[0] in wa)


# --- grouping ----------------------------------------------------------------------------------------------------------


def average_linkage(n: int, edges: list[tuple[int, int, float]], least: float) -> list[int]:
    """Group number of each of n items: the two groups with the greatest average similarity are joined while it is at least
    `least`. Pairs without an edge have similarity 0. Sums of similarities between groups are kept sparse, so the work
    follows the number of edges. Ties go to the lower numbers."""
    size = [1] * n
    sums: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, s in edges:
        sums[a][b] = sums[b][a] = s
    heap = [(-s, a, b, 1, 1) for a, b, s in ((min(a, b), max(a, b), s) for a, b, s in edges) if s >= least]
    heapq.heapify(heap)
    alive = [True] * n
    parent = list(range(n))
    while heap:
        _, a, b, na, nb = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or size[a] != na or size[b] != nb:
            continue
        alive[b] = False
        parent[b] = a
        size[a] += size[b]
        for c, s in sums[b].items():
            sums[c].pop(b, None)
            if c != a:
                sums[a][c] = sums[c][a] = sums[a].get(c, 0.0) + s
        sums[a].pop(b, None)
        for c, s in sums[a].items():
            avg = s / (size[a] * size[c])
            if avg >= least:
                x, y = min(a, c), max(a, c)
                heapq.heappush(heap, (-avg, x, y, size[x], size[y]))
    out = []
    for i in range(n):
        while parent[i] != i:
            i = parent[i]
        out.append(i)
    return out


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, component (its least node) for links (a, b) between numbers, by alternating large and small stars. Each round
    is written to the shared folder, so the plan stays short and a lost executor costs one round."""
    cur = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    k = 0
    while True:
        k += 1
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        nxt = written(nxt, f"{name}-{k}")
        tell = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        a, b = tell(cur), tell(nxt)
        cur = nxt
        if tuple(a) == tuple(b):
            break
    heads = cur.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads).distinct()


def _near_sql(x: str, y: str) -> str:
    """A bound on `_alike`: a swap of neighbours is two plain edits."""
    m = f"least(length({x}), length({y}))"
    return f"(case when {m} >= 7 then levenshtein({x}, {y}, 4) >= 0 when {m} >= 4 then levenshtein({x}, {y}, 2) >= 0 else {x} = {y} end)"


def _begins_sql(x: str, y: str) -> str:
    """A bound on `_cut`."""
    m = f"least(length({x}), length({y}))"
    return f"levenshtein(left({x}, {m}), left({y}, {m}), 4) >= 0"


def _bare(x: str) -> str:
    return f"replace({x}, ' ', '')"


def _alike_sql(x: str, y: str) -> str:
    """What `_alike` says, or little more: where the plain edits are too many, neighbours were swapped, so the letters are
    the same but for what the other edit allows."""
    m = f"least(length({x}), length({y}))"
    letters = lambda z: f"array_join(array_sort(split({z}, '')), '')"
    return f"""(case when {m} >= 7 then levenshtein({x}, {y}, 4) >= 0 and (levenshtein({x}, {y}, 2) >= 0 or levenshtein({letters(x)}, {letters(y)}, 2) >= 0)
      when {m} >= 4 then levenshtein({x}, {y}, 2) >= 0 and (levenshtein({x}, {y}, 1) >= 0 or {letters(x)} = {letters(y)}) else {x} = {y} end)"""


def _cut_sql(x: str, y: str, least: int) -> str:
    """What `_cut` says, as `_alike_sql`."""
    m = f"least(length({x}), length({y}))"
    a, b = f"left({x}, {m})", f"left({y}, {m})"
    return f"({m} >= {least} and ({a} = {b} or {m} >= 6 and {_alike_sql(a, b)}))"


#: Two given names are taken for one name if they stand in at least so many pairs of family and organisation, and that is at
#: least such a part of the pairs in which the rarer of them stands beside another name.
NICK_MIN, NICK_SHARE = 2, 0.5


def nicknames(told: DataFrame) -> DataFrame:
    """x < y: given names that are used for one person, learned from the parts of the forms (`_PARTS`).

    In each pair of family and organisation every given name is set against the most frequent one, so the work follows the
    number of names, not of their pairs. Misspellings of a name aren't learned: they are told by their letters."""
    said = told.filter("not org and length(given) > 1 and family <> '' and size(words) > 0")
    said = said.groupBy("family", F.array_sort("words").alias("words"), "kind", "given").agg(F.count("*").alias("n"))
    key = ["family", "words", "kind"]
    top = said.groupBy(*key).agg(F.max(F.struct("n", "given"))["given"].alias("top"), F.count("*").alias("names")).filter("names > 1")
    beside = said.join(top, key).filter("given <> top and levenshtein(given, top) > 2")
    beside = beside.select(F.least("given", "top").alias("x"), F.greatest("given", "top").alias("y"))
    pairs = beside.groupBy("x", "y").agg(F.count("*").alias("c"))
    alone = pairs.select(F.explode(F.array("x", "y")).alias("g"), "c").groupBy("g").agg(F.sum("c").alias("all"))
    of = lambda s: alone.select(F.col("g").alias(s), F.col("all").alias(f"all_{s}"))
    got = pairs.filter(F.col("c") >= NICK_MIN).join(of("x"), "x").join(of("y"), "y")
    return got.filter(F.col("c") >= NICK_SHARE * F.least("all_x", "all_y")).select("x", "y")


_FA, _FB = "replace(family_a, ' ', '')", "replace(family_b, ' ', '')"
_LONG, _SHORT = "if(length(given_a) > length(given_b), given_a, given_b)", "if(length(given_a) > length(given_b), given_b, given_a)"
#: What `short_form` says.
_PART = f"length(given_a) <> length(given_b) and length({_SHORT}) > 2 and exists(sequence(1, 3), i -> i <= greatest(3, length({_SHORT})) - greatest(3, length({_SHORT}) - 2) + 1 and contains({_LONG}, substr({_SHORT}, i, greatest(3, length({_SHORT}) - 2))))"
#: What `same_witness` implies, in SQL: of given names, of all parts.
_GIVEN = f"""(nick or given_a = '' or given_b = '' or least(length(given_a), length(given_b)) = 1 and left(given_a, 1) = left(given_b, 1) or {_near_sql("given_a", "given_b")}
    or {_PART})"""
_MUST = f"""org_a = org_b and case when org_a then
  (kind_a = '' or kind_b = '' or kind_a = kind_b)
  and exists(split(words_a, ' '), x -> exists(split(words_b, ' '), y -> x = y or length(x) > 5 and length(y) > 5 and {_begins_sql("x", "y")}))
else
  {_GIVEN}
  and ({_near_sql(_FA, _FB)} or {_begins_sql("family_a", "family_b")} or arrays_overlap(split(family_a, ' '), split(family_b, ' ')))
end"""

_PARTS = "fid long, org boolean, given string, middle string, family string, words array<string>, kind string"


#: Letters of a word by which it is looked up among words like it.
HEAD = 7


def head_keys(head: str) -> set[str]:
    """`head` (at most HEAD letters) without up to two of its letters, one if it is shorter than HEAD, none below four.

    Words that are `_alike`, and a word and the beginning that is `_alike` it, share one of them: of the letters that two
    words have in common in order those within both heads are left, and neither head loses more than the edits allow."""
    out, last = {head}, {head}
    for _ in range(2 if len(head) >= HEAD else 1 if len(head) > 3 else 0):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


def _like(words: DataFrame, least: int) -> DataFrame:
    """x, y: all pairs of words, in both orders and each with itself, that `_alike` (read without blanks) or `_cut` (from
    `least` letters on) may accept. Heads are compared first, so the work follows the number of words like a word."""

    def keys(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            # A short word is looked up whole among the beginnings of others.
            got = [(h, f"-{k}", True, True) for h in pdf["h"] for k in head_keys(h)]
            got += [(h, f"+{h[:i]}", True, i == len(h)) for h in pdf["h"] for i in range(least, min(len(h), HEAD - 1) + 1)]
            yield pd.DataFrame(got, columns=["h", "k", "l", "s"])

    heads = F.expr(f"array_distinct(array(left(w, {HEAD}), left({_bare('w')}, {HEAD})))")
    of = written(words.select("w", F.explode(heads).alias("h")), "p5-heads")
    keyed = of.select("h").distinct().mapInPandas(keys, "h string, k string, l boolean, s boolean")
    pairs = keyed.filter("l").select("k", F.col("h").alias("hx")).join(keyed.filter("s").select("k", F.col("h").alias("hy")), "k").select("hx", "hy")
    pairs = pairs.unionByName(pairs.select(F.col("hy").alias("hx"), F.col("hx").alias("hy"))).distinct()
    got = of.select(F.col("w").alias("x"), F.col("h").alias("hx")).join(pairs, "hx").join(of.select(F.col("w").alias("y"), F.col("h").alias("hy")), "hy")
    return got.filter(F.expr(f"{_alike_sql(_bare('x'), _bare('y'))} or {_cut_sql('x', 'y', least)}")).select("x", "y").distinct()


def _nicked(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """`pairs` (given_a, given_b) with `nick`: few pairs of names are used for one person; names that differ are looked up."""
    differ = F.col("given_a") != F.col("given_b")
    both = pairs.withColumn("x", F.when(differ, F.least("given_a", "given_b"))).withColumn("y", F.when(differ, F.greatest("given_a", "given_b")))
    return both.join(known, ["x", "y"], "left").withColumn("nick", F.coalesce("nick", F.lit(False))).drop("x", "y")


def _people(told: DataFrame, known: DataFrame) -> DataFrame:
    """a < b: people whose family names may be one, and whose given names may be."""
    forms = told.filter("not org and family <> ''").select("fid", "given", "family")
    sizes = written(forms.groupBy("family").agg(F.count("*").alias("n")), "p5-families")
    # One family name is the other's beginning or like it, or a double name holds the single one.
    words = sizes.select("family", F.array_remove(F.split("family", " "), "").alias("p")).select("family", F.size("p").alias("n"), F.explode(F.array_distinct("p")).alias("p"))
    one = lambda s: words.select("p", F.col("family").alias(s), F.col("n").alias(f"n_{s}"))
    held = one("x").join(one("y"), "p").filter("n_x <> n_y").select("x", "y")
    like = _like(sizes.select(F.col("family").alias("w")), 3).unionByName(held).distinct()
    like = written(like.join(sizes.select(F.col("family").alias("y"), (1 + F.floor(F.col("n") / SPLIT)).cast("int").alias("parts")), "y"), "p5-like-families")
    # A family name of many forms is no single key: one side is dealt into parts, the other goes to all of them.
    a = forms.select(F.col("fid").alias("a"), F.col("given").alias("given_a"), F.col("family").alias("x"))
    a = a.join(like, "x").select("a", "given_a", "y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    b = forms.join(sizes, "family").withColumn("part", F.pmod(F.xxhash64("fid"), 1 + F.floor(F.col("n") / SPLIT)).cast("int"))
    b = b.select(F.col("fid").alias("b"), F.col("given").alias("given_b"), F.col("family").alias("y"), "part")
    both = a.join(b, ["y", "part"]).filter("a < b").select("a", "b", "given_a", "given_b")
    return _nicked(both, known).filter(F.expr(_GIVEN)).select("a", "b")


def _organisations(told: DataFrame) -> DataFrame:
    """a < b: organisations of kinds that agree, one of which has no word, but directions and beginnings of kinds, that may
    not be one of the other. So one word is looked up for each, that which begins the fewest words."""
    forms = told.filter("org").select("fid", "kind", F.explode(F.array_distinct("words")).alias("w")).filter("w <> ''")
    sizes = written(forms.groupBy("w").agg(F.count("*").alias("n")), "p5-organisation-words")
    begun = sizes.select(F.explode(F.expr("transform(sequence(1, length(w)), i -> left(w, i))")).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n"))
    known = list(N.DIRECTIONS)

    def kinds(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            yield pd.DataFrame({"w": pdf["w"], "loose": [any(_cut(w, k, 2) for k in N.KINDS) for w in pdf["w"]]})

    words = sizes.select("w").filter(~F.col("w").isin(known)).mapInPandas(kinds, "w string, loose boolean").join(begun, "w")
    own = forms.join(words, "w")
    # Where all words may be the beginning of a kind, each is looked up.
    first = own.groupBy("fid", "kind").agg(F.min(F.when(~F.col("loose"), F.struct("n", "w"))).alias("m"), F.collect_set("w").alias("all"))
    first = first.select(F.col("fid").alias("i"), F.col("kind").alias("ki"), F.explode(F.when(F.col("m").isNull(), F.col("all")).otherwise(F.array("m.w"))).alias("x"))
    like = _like(sizes.select("w"), 2)
    both = first.join(like, "x").join(forms.select(F.col("fid").alias("j"), F.col("kind").alias("kj"), F.col("w").alias("y")), "y")
    both = both.filter("i <> j and (ki = '' or kj = '' or ki = kj)")
    return both.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def _similar(forms: DataFrame) -> DataFrame:
    """a, b (fid, a < b) and cosine of the pairs of forms that can stand for one witness."""

    def cut(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            got = [parts(w, c) for w, c in zip(pdf["who"], pdf["context"])]
            out = pd.DataFrame(got, columns=["org", "given", "middle", "family", "words", "kind", "grams"])
            out.insert(0, "fid", pdf["fid"].to_numpy())
            yield out

    told = written(forms.mapInPandas(cut, _PARTS + ", grams array<string>"), "p5-parts")
    known = written(nicknames(told), "p5-nicknames").withColumn("nick", F.lit(True))
    # What any pair of one witness must fulfil is asked in SQL, the rest of the check in Python.
    flat = told.select("fid", "org", "given", "middle", "family", F.array_join("words", " ").alias("words"), "kind")
    side = lambda s: flat.select(F.col("fid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in flat.columns if c != "fid"])
    pairs = written(_people(told, known).unionByName(_organisations(told)), "p5-candidates")
    near = _nicked(pairs.join(side("a"), "a").join(side("b"), "b"), known).filter(F.expr(_MUST))

    def plausible(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def form(pdf: pd.DataFrame, s: str) -> list[dict]:
            cols = [pdf[f"{c}_{s}"] for c in ("org", "given", "middle", "family", "kind")]
            return [
                {"org": o, "given": g, "middle": m, "family": f, "kind": k, "words": w.split()}
                for o, g, m, f, k, w in zip(*cols, pdf[f"words_{s}"])
            ]

        for pdf in rows:
            keep = [same_witness(x, y, k) for x, y, k in zip(form(pdf, "a"), form(pdf, "b"), pdf["nick"])]
            yield pdf.loc[keep, ["a", "b"]]

    close = near.mapInPandas(plausible, "a long, b long")
    close = written(close, "p5-close")
    grams = told.select("fid", F.explode("grams").alias("g")).groupBy("fid", "g").agg(F.count("*").alias("tf"))
    df = grams.groupBy("g").agg(F.count("*").alias("df"))
    n = told.count()
    weighed = grams.join(df, "g").withColumn("w", F.col("tf") * F.log(1 + F.lit(float(n)) / F.col("df")))
    # Only forms with a partner are compared; what is common is counted over all.
    ends = close.select(F.explode(F.array("a", "b")).alias("fid")).distinct()
    weighed = weighed.join(ends, "fid", "left_semi")
    vectors = weighed.groupBy("fid").agg(F.collect_list(F.struct("df", "g", "w")).alias("v"))  # the grams of one form
    weight, limit = dict(FIELD_WEIGHT), THRESHOLD

    def scaled(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for fid, v in zip(pdf["fid"], pdf["v"]):
                cells = sorted((int(x["df"]), x["g"], float(x["w"])) for x in v)
                norm: dict[str, float] = {}
                for _, g, w in cells:
                    norm[g[0]] = norm.get(g[0], 0.0) + w * w
                total = math.sqrt(sum(weight[f] ** 2 for f in norm))
                w = np.array([w / math.sqrt(norm[g[0]]) * weight[g[0]] / total for _, g, w in cells])
                out.append((fid, [g for _, g, _ in cells], w.tolist()))
            yield pd.DataFrame(out, columns=["fid", "g", "w"])

    sparse = written(vectors.mapInPandas(scaled, "fid long, g array<string>, w array<double>"), "p5-vectors")
    vector = sparse.select("fid", F.map_from_arrays("g", "w").alias("v"))
    full = close.join(vector.select(F.col("fid").alias("a"), F.col("v").alias("_x")), "a").join(
        vector.select(F.col("fid").alias("b"), F.col("v").alias("_y")), "b"
    )
    dot = F.expr("aggregate(map_entries(_x), 0D, (s, e) -> s + e.value * coalesce(_y[e.key], 0D))")
    return full.select("a", "b", F.least(F.lit(1.0), dot).alias("cosine")).filter(F.col("cosine") >= limit - 1e-9)


def link_variants(df: DataFrame, *, key: str, name: str, context: str) -> DataFrame:
    """fid (the least key of each typed form), name, context, entity (the least fid of its group), n_links.

    A form is a distinct pair (name, context); null is a value of its own here and read as ''. Forms without any letter, and
    those that nothing is like, are entities of their own. Every form comes out, every link between forms counts."""
    forms = df.groupBy(F.col(name).alias("who"), F.col(context).alias("context")).agg(F.min(key).cast("long").alias("fid"))
    forms = written(forms.filter("fid is not null"), "p5-forms")
    links = written(_similar(forms), "p5-links")
    comp = components(links, "p5-components")
    edges = links.join(comp.withColumnRenamed("node", "a"), "a")
    least = LINKAGE

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.r_[pdf["a"].to_numpy(), pdf["b"].to_numpy()])
        at = {v: i for i, v in enumerate(ids)}
        got = average_linkage(len(ids), [(at[a], at[b], s) for a, b, s in zip(pdf["a"], pdf["b"], pdf["cosine"])], least)
        return pd.DataFrame({"fid": ids, "entity": [ids[g] for g in got]})

    def group(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted by component; a component may go on in the next batch."""
        rest: pd.DataFrame | None = None
        for pdf in rows:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = pdf["component"] == pdf["component"].iloc[-1]
            rest = pdf[last]
            done = [linked(g) for _, g in pdf[~last].groupby("component")]
            if done:
                yield pd.concat(done)
        if rest is not None:
            yield linked(rest)

    # A component is the spellings of a few namesakes: checked links only, never a block of candidates.
    edges = edges.select("component", "a", "b", "cosine").repartition("component").sortWithinPartitions("component")
    grouped = edges.mapInPandas(group, "fid long, entity long")
    ends = links.select(F.explode(F.array("a", "b")).alias("fid")).groupBy("fid").agg(F.count("*").alias("n_links"))
    out = forms.join(grouped, "fid", "left").join(ends, "fid", "left")
    return out.select("fid", F.col("who").alias(name), F.col("context").alias(context), F.coalesce("entity", "fid").alias("entity"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """id_a < id_b for all pairs of forms of one entity."""
    m = linked.select("entity", "fid")
    a, b = m.withColumnRenamed("fid", "id_a"), m.withColumnRenamed("fid", "id_b")
    return a.join(b, "entity").filter("id_a < id_b").select("id_a", "id_b")
