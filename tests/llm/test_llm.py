"""The operators of the llm package against brute force, round trips and hand-made cases."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import alignment, mixing, names, packing, quality, truncation, turns, variants
from quorumlake.llm.sizes import encoder, n_tokens, token_sizes

T = dt.datetime


# --- p1 ----------------------------------------------------------------------------------------------------------------


def test_fit_finds_limits():
    rng = np.random.default_rng(1)
    true = np.exp(rng.normal(3.6, 0.6, 4000)).astype(int) + 1
    cut = np.minimum(true, 60)
    lengths, counts = np.unique(cut, return_counts=True)
    found = truncation.fit_limits(lengths, counts.astype(float))
    assert [f[0] for f in found] == [60] and found[0][1] > 0.8
    lengths, counts = np.unique(true, return_counts=True)
    assert truncation.fit_limits(lengths, counts.astype(float)) == []


def test_a_value_of_any_length_is_fitted():
    rng = np.random.default_rng(1)
    n = np.bincount(np.minimum(rng.lognormal(3.6, 0.4, 4000).astype(int) + 1, 50))
    lengths = np.r_[np.nonzero(n)[0], 200_000_000]
    got = truncation.fit_limits(lengths, np.r_[n[n > 0], 1].astype(float))
    assert [g[0] for g in got] == [50] and truncation.fit_limits(np.array([3, 300_000_000]), np.array([1.0, 1.0])) == []


def test_fit_limit_of_a_part():
    rng = np.random.default_rng(2)
    true = np.exp(rng.normal(3.6, 0.6, 6000)).astype(int) + 1
    cut = np.where(np.arange(6000) % 2 == 0, np.minimum(true, 50), true)
    lengths, counts = np.unique(cut, return_counts=True)
    found = truncation.fit_limits(lengths, counts.astype(float))
    assert [f[0] for f in found] == [50] and 0.3 < found[0][2] < 0.7


def _values(n=400):
    rng = random.Random(4)
    given = [a + b for a in ("Al", "Be", "Ca", "Do", "Er") for b in ("mond", "rick", "trina", "bert")]
    family = [a + b for a in ("Hol", "Mar", "Ven", "Zor") for b in ("denby", "quist", "tarow", "linsky", "oskar")]
    post = ["Minister of Fisheries and Coastal Communities", "Minister of Housing", "Critic for Transport and Harbours"]
    return [f"{rng.choice(given)} {rng.choice(family)} ({rng.choice(post)}, {rng.choice(['Prairie', 'Harbour'])})" for _ in range(n)]


def test_truncated_values(spark):
    vals = _values()
    rows, truth = [], set()
    for i, v in enumerate(vals):
        feed = "clean" if i % 2 else "short"
        w = v[:40] if feed == "short" else v
        if w != v:
            truth.add(i)
        rows.append((i, feed, w, "", "x"))
    rows += [(9000, None, None, None, "x"), (9001, "clean", "", "", "x"), rows[0]]
    df = spark.createDataFrame(rows, "id long, feed string, who string, ctx string, source string")
    cut, report, limits = truncation.find_truncated(df, key="id", source="feed", fields=["who", "ctx"])
    got = {r.id for r in cut.collect()}
    assert len(got & truth) / len(truth) > 0.95 and len(got - truth) <= 0.02 * len(vals)
    shares = {r.feed: r.cut_share for r in report.collect()}
    assert shares["short"] > 0.9 and shares["clean"] < 0.02
    assert ("short", 40) in {(r.source, r.len) for r in limits.collect()}
    none = truncation.find_truncated(df.limit(0), key="id", source="feed", fields=["who", "ctx"])
    assert none[0].count() == none[1].count() == 0


# --- p2 ----------------------------------------------------------------------------------------------------------------


def test_sentences(spark):
    cases = {
        "One. Two? Three!": ["one", "two", "three"],
        "<p>A big 3.5 b.</p>\n<p>(Division)</p> ": ["a big 3.5 b", "division"],
        "1. The Act. (a) Next one.\nHeading\n2 Last.": ["the act", "next one", "heading", "last"],
        "13 661 jours, 3,2 % ?": ["13661 jours 3.2"],
        "437 files of 1,234,567. Done": ["437 files of 1234567", "done"],
        "Word.\n\n...\nEnd": ["word", "", "end"],
        "": [], "  <br> \n": [],
    }
    df = spark.createDataFrame(list(enumerate(cases)) + [(99, None)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", alignment.sentence_words(F.col("t")).alias("w")).collect()}
    assert got[99] is None
    for i, want in enumerate(cases.values()):
        assert [" ".join(x.split()) for x in got[i].split("\n")] == (want or [""]), i


_EN = [a + b for a in ("hou", "riv", "brid", "doc", "schoo", "win", "eng", "farm") for b in ("ser", "min", "tol", "gan", "pes")]
_FR = [a + b for a in ("mai", "vir", "pon", "med", "col", "hiv", "tou", "agr") for b in ("zon", "ques", "lier", "fait", "brou")]


def _record(rng, n):
    picks = [rng.sample(range(len(_EN)), 4) for _ in range(n)]
    en = ["The " + " and ".join(_EN[k] for k in p) + "." for p in picks]
    fr = ["Le " + " et ".join(_FR[k] for k in p[::-1]) + "." for p in picks]
    return en, fr


def test_alignment_with_omission_merge_and_order(spark):
    rng = random.Random(8)
    rows, truth = [], set()
    for r in range(250):
        en, fr = _record(rng, rng.randint(1, 5))
        gold = [(i, i) for i in range(len(en))]
        k = r % 5
        if k == 1 and len(en) > 2:
            fr = fr[:1] + fr[2:]
            gold = [(i, i - (i > 1)) for i in range(len(en)) if i != 1]
        if k == 2 and len(en) > 2:
            fr[1] = fr[1][:-1] + ", alors que " + fr[2][0].lower() + fr[2][1:]
            del fr[2]
            gold = [(i, i if i < 2 else i - 1) for i in range(len(en))]
        if k == 3 and len(en) > 3:
            fr[0], fr[1] = fr[1], fr[0]
            gold = [({0: 1, 1: 0}.get(i, i), i) for i in range(len(en))]
        rows.append(("statement", r, T(2020, 1, 1), "<p>" + " ".join(en) + "</p>", " ".join(fr)))
        truth |= {(r, i + 1, j + 1) for i, j in gold}
    rows += [rows[0], ("statement", 900, None, "Some words.", ""), ("statement", 901, None, None, "x."), ("bill_text", None, None, "A.", "B.")]
    df = spark.createDataFrame(rows, "record_kind string, record_id long, version timestamp_ntz, en string, fr string")
    got = {(r.record_id, r.en_no, r.fr_no) for r in alignment.aligned(df).collect()}
    assert len(got & truth) / len(got) > 0.95 and len(got & truth) / len(truth) > 0.95
    assert alignment.aligned(df.limit(0)).count() == 0


def test_lexicon_keeps_rare_translations():
    table = pd.DataFrame([("bank", "rive", 0.06, 0.0), ("bank", "caisse", 0.04, 0.0)], columns=["e", "f", "pf", "pe"])
    weights = pd.DataFrame([("e", "bank", 5.0)], columns=["s", "w", "x"])
    lex = alignment.Lexicon(table, weights)
    assert lex.shown({"bank"}, {"rive"}, "e") == pytest.approx(0.2) and lex.shown({"bank"}, {"caisse"}, "e") == 0
    assert not lex.sure({"u", "v", "w", "x", "y"}, {"u", "v", "w", "z", "t"})  # 0.6 in both directions is searched
    assert alignment.ITERATIONS == 5


def test_lexicon_keeps_words_however_many_there_are(spark, monkeypatch):
    monkeypatch.setattr(alignment, "TABLE_ROWS", 100, raising=False)  # a bound that 120 words are far beyond
    pairs = [(f"e{chr(97 + i % 26)}{i} same", f"f{chr(97 + i % 26)}{i} autre", 3) for i in range(60)]
    table, weights = alignment.train_lexicon(spark.createDataFrame(pairs, "en string, fr string, n long"))
    assert {(s, w) for s, w in zip(weights["s"], weights["w"])} >= {("e", p[0].split()[0]) for p in pairs} | {("f", p[1].split()[0]) for p in pairs}
    assert set(zip(table["e"], table["f"])) == {(p[0].split()[0], p[1].split()[0]) for p in pairs}


def test_lexicon_holds_however_much_chance_there_is(spark, monkeypatch):
    """The same share of wrong pairs in an input sixty-four times as large gives the same table."""
    monkeypatch.setattr(alignment, "PAIRS", 1200, raising=False)
    rng = random.Random(3)
    said = [tuple(sorted(rng.sample(range(len(_EN)), 3))) for _ in range(400)]
    text = lambda p, words: " ".join(sorted(words[k] for k in p))

    def table(times):
        """A third of the pairs are two phrases that stand beside each other by chance."""
        n = {}
        for p in said:
            n[p, p] = n.get((p, p), 0) + 2 * times
        for _ in range(len(said) * times):
            k = rng.choice(said), rng.choice(said)
            n[k] = n.get(k, 0) + 1
        rows = [(text(a, _EN), text(b, _FR), c) for (a, b), c in n.items()]
        got = alignment.train_lexicon(spark.createDataFrame(rows, "en string, fr string, n long"))[0]
        return {(e, f): max(pf, pe) for e, f, pf, pe in got.itertuples(index=False)}

    few, many = table(1), table(64)
    right = set(zip(_EN, _FR))
    least = [min(t.get(k, 0.0) for k in right) for t in (few, many)]
    assert least[1] >= least[0] - 0.1, least


@pytest.mark.parametrize("places, cells", [(1 << 24, 400_000), (0, 400_000), (1 << 24, 5), (0, 5)])
def test_expected_counts_are_those_of_the_model(monkeypatch, places, cells):
    """A pass gives the counts of each word pair, however words are looked up and rows are cut into chunks."""
    monkeypatch.setattr(alignment, "PLACES", places, raising=False)
    monkeypatch.setattr(alignment, "CELLS", cells, raising=False)
    rng = random.Random(5)
    rows = [([rng.randrange(6) for _ in range(rng.randint(1, 5))], [rng.randrange(7) for _ in range(rng.randint(1, 5))], rng.randint(1, 4) / 2) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"e": pa.array([r[0] for r in rows], pa.list_(pa.int32())), "f": pa.array([r[1] for r in rows], pa.list_(pa.int32())), "w": [r[2] for r in rows]})
    keys = np.array(sorted(rng.sample(range(42), 20)))
    for table in (None, {int(k): (rng.random(), rng.random()) for k in keys}):
        want = {}
        at = lambda e, f: (1.0, 1.0) if table is None else table.get(e * 7 + f, (0.0, 0.0))
        for es, fs, w in rows:
            for e in es:
                for f in fs:
                    sa, sb = sum(at(x, f)[0] for x in es), sum(at(e, y)[1] for y in fs)
                    old = want.get(e * 7 + f, (0.0, 0.0))
                    want[e * 7 + f] = (old[0] + (w * at(e, f)[0] / sa if sa else 0), old[1] + (w * at(e, f)[1] / sb if sb else 0))
        args = (None, None, None) if table is None else (keys, *(np.array([table[int(k)][i] for k in keys]) for i in (0, 1)))
        got = {}
        for out in alignment._expected(*args, 6, 7)(iter([batch.slice(0, 25), batch.slice(25)])):
            for k, a, b in zip(*(out.column(c).to_pylist() for c in ("key", "cf", "ce"))):
                got[k] = (got.get(k, (0, 0))[0] + a, got.get(k, (0, 0))[1] + b)
        want = {k: v for k, v in want.items() if v[0] or v[1]}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


# --- p3 ----------------------------------------------------------------------------------------------------------------


def test_tagger():
    m = turns.Model()
    run = lambda t: turns.segments(turns.tokens(t)[0], m.decode(turns.tokens(t)[1]))
    assert run("[10:00:01] Um, the  bill <noise> is er... fine.") == [(None, "the bill is fine.")]
    assert run("Do you know how many? you know, ten") == [(None, "Do you know how many? ten")]
    assert run("as agreed. — MR. STONE: Thank you. (laughter)") == [(None, "as agreed."), ("— MR. STONE:", "Thank you.")]
    assert run("It is done. Ms. Ann Lee (North Bay): No.")[1] == ("Ms. Ann Lee (North Bay):", "No.")
    assert run("(inaudible 00:29:06) {coughs} ♪ ♪") == [] and run("") == [] and run("I mean...") == []
    # Annotations of any length; a bracket that isn't closed in its line is none, and many of them cost no more than one.
    assert run("Yes [" + "noise " * 500 + "] no.") == [(None, "Yes no.")] and run("It (is\nso) far.") == [(None, "It (is so) far.")]
    assert run("[" * 200_000 + " end")[0][1].endswith("end") and run("* * *bell rings* go") == [(None, "go")]


def test_training_settles_on_the_data(spark):
    """The probabilities are those of the corpus, and an empty one leaves the prior."""
    syms = spark.createDataFrame([("wwww.", 500), ("wwqww.", 40), ("wQw.", 30), ("fww.", 50), ("hcewww.", 20)], "syms string, n long")
    m = turns.train(syms)
    again = turns.Model.train({})
    assert m.decode("hcewww.") == "LLESSSS" and m.decode("fww.") == "FSSS" and again.decode("fww.") == "FSSS"
    assert m.move["S"]["S"] != again.move["S"]["S"] and abs(sum(math.exp(x) for x in m.move["S"].values()) - 1) < 1e-9
    assert turns.train(syms.limit(0)).decode("fww.") == "FSSS"


def test_decode_is_the_best_path():
    m = turns.Model()
    rng = random.Random(3)
    for _ in range(60):
        syms = "".join(rng.choice("wcdhe.tafkn") for _ in range(rng.randint(1, 5)))

        def score(path):
            s, prev = 0.0, "^"
            for a, x in zip(path, syms):
                if a not in m.emit[x]:
                    return -math.inf
                s, prev = s + m.emit[x][a] + m.move[prev].get(a, -1e9), a
            return s - (1e9 if path[-1] == "L" else 0)

        best = max(score(p) for p in itertools.product(turns.STATES, repeat=len(syms)))
        assert score(m.decode(syms)) == pytest.approx(best)


def test_resolve():
    labels = [("Ms. Hélène Thogan", 3), ("Thogan, Tomasz", 3), ("H. THOGAN", 1), ("Mr. Thogan:", 1), ("Mr. Tomasz Thogan", 1), ("Thoggan", 1),
              ("The Speaker", 2), (">> Mr. Speaker:", 1), ("Ms. Stonebridge", 1), ("Stonebrigde, Eva", 4)]
    got = turns.resolve(labels)
    assert got["Ms. Hélène Thogan"] == got["H. THOGAN"] and got["Mr. Thogan:"] == got["Thogan, Tomasz"] == got["Mr. Tomasz Thogan"]
    assert got["Thoggan"].startswith("?") and got["The Speaker"] == got[">> Mr. Speaker:"]
    assert got["Ms. Stonebridge"] == got["Stonebrigde, Eva"]


def test_turns(spark):
    t = lambda s: T(2020, 1, 1, 10, 59, 50) + dt.timedelta(seconds=s)
    rows = [
        (1, 7, t(0), "Mr. John Stone", "Good morning."),
        (2, 7, t(5), "", "[10:59:55]"),  # nothing left
        (3, 7, t(6), "Some hon. members", "(laughter)"),  # breaks nothing, names nobody
        (4, 7, t(20), "", "We go on. >> Ms. Eva Reed: I do not agree."),
        (5, 7, t(25), None, "Not at all."),
        (6, 7, t(30), "STONE:", "Well."),
        (9, 7, t(30), "STONE:", "Well."),  # sent again
        (10, 8, t(0), "", "Who speaks?"),
        (11, None, t(0), "X", "a"), (12, 8, None, "X", "a"), (13, 8, t(9), "X", None), (14, 8, t(9), "X", ""),
    ]
    df = spark.createDataFrame(rows, "id long, document_id long, time timestamp_ntz, who string, content string")
    got = sorted((r.document_id, r.turn_no, r.id) for r in turns.speaker_turns(df).collect())
    assert got == [(7, 1, 1), (7, 1, 4), (7, 2, 4), (7, 2, 5), (7, 3, 6), (8, 1, 10)]
    assert turns.speaker_turns(df.limit(0)).count() == 0


# --- p5 ----------------------------------------------------------------------------------------------------------------


def test_name_parts():
    assert names.person("Dr. Zoé Vasondtho, PhD") == ("zoe", "", "vasondtho")
    assert names.person("VASONDTHO, Dr. Z.") == ("z", "", "vasondtho")
    assert names.person("Bill K. Stone-Reed") == ("bill", "k", "stone reed")
    assert names.person("") == ("", "", "")
    assert names.organisation("V.P., Inst. of Broadband, N. Zorvold") == (["broadband", "northern", "zorvold"], "institute")
    assert names.is_organisation("EIVF") and names.is_organisation("The Greater Zor Dairy Coun.") and not names.is_organisation("Stone, Eva")
    assert not names.is_organisation("Dr. Eva Stone") and names.organisation("Exec. Dir., S. Water Assn.") == (["southern", "water"], "association")
    assert names.expand("fdn.", tuple(names.KINDS)) == "" and names.expand("hosi...", tuple(names.KINDS)) is None and names.is_post("sec.-treas.")
    assert not names.is_post("policy research") and names.is_post("ch. economist") and names.is_post("v.p.")


def test_average_linkage_brute():
    rng = random.Random(2)
    for _ in range(20):
        n = 7
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.5]
        got = variants.average_linkage(n, edges, 0.3)
        sim = {}
        for a, b, s in edges:
            sim[a, b] = sim[b, a] = s
        groups = [{i} for i in range(n)]
        while True:
            best = max(((sum(sim.get((a, b), 0) for a in x for b in y) / len(x) / len(y), -i, -j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j), default=(0, 0, 0))
            if best[0] < 0.3:
                break
            i, j = -best[1], -best[2]
            groups[i] |= groups[j]
            del groups[j]
        assert {frozenset(k for k in range(n) if got[k] == g) for g in set(got)} == {frozenset(g) for g in groups}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (30, 30)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in variants.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, **{100 + i: 100 for i in range(41)}}


@pytest.mark.parametrize("split", [1000, 5])
def test_similarity_join_is_exact(spark, monkeypatch, split):
    monkeypatch.setattr(variants, "SPLIT", split)
    rng = random.Random(6)
    fams = ["zorven", "holtin", "maskel", "perrow", "quilda"]
    forms = [(i, f"Eva {rng.choice(fams)}{rng.choice(fams)[: rng.randint(2, 6)]}", rng.choice(["", "President, Northern Zor Dairy Council"])) for i in range(60)]
    df = spark.createDataFrame(forms, "fid long, who string, context string")
    got = {(r.a, r.b) for r in variants._similar(df).collect()}
    P = {i: variants.parts(w, c) for i, w, c in forms}
    dfs = {}
    for p in P.values():
        for g in set(p["grams"]):
            dfs[g] = dfs.get(g, 0) + 1

    def vec(p):
        v = {g: p["grams"].count(g) * math.log(1 + len(P) / dfs[g]) for g in p["grams"]}
        norm = {}
        for g, w in v.items():
            norm[g[0]] = norm.get(g[0], 0) + w * w
        total = math.sqrt(sum(variants.FIELD_WEIGHT[f] ** 2 for f in norm))
        return {g: w / math.sqrt(norm[g[0]]) * variants.FIELD_WEIGHT[g[0]] / total for g, w in v.items()}

    V = {i: vec(p) for i, p in P.items()}
    want = {
        (a, b) for a in P for b in P
        if a < b and variants.same_witness(P[a], P[b]) and sum(w * V[b].get(g, 0) for g, w in V[a].items()) >= variants.THRESHOLD
    }
    assert got == want and len(want) > 5


def test_candidates_are_whole_and_few(spark, monkeypatch):
    """All pairs that pass the check are candidates, for names of shared syllables, mistyped, cut and doubled; the many pairs
    that share grams aren't."""
    monkeypatch.setattr(variants, "SPLIT", 3)
    rng = random.Random(11)
    parts = ["zor", "holt", "mask", "perr", "quil", "dess", "lund", "vik", "ost", "ferm"]
    name = lambda k: "".join(rng.choice(parts) for _ in range(k)).capitalize()

    def typed(w):
        for _ in range(rng.choice([0, 0, 1, 2])):
            i = rng.randrange(len(w) - 1)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "x" + w[i + 1 :], w[: max(3, i)]])
        return w

    forms = []
    for _ in range(60):
        given, family, org = rng.choice(["Eva", "Thomas", "Kwame", "Tom", "E."]), name(rng.choice([1, 2, 3])), f"Northern {name(3)} {rng.choice(['Dairy', 'Housing'])} Council"
        family += f"-{name(2)}" if rng.random() < 0.3 else ""
        for _ in range(3):
            forms.append((f"{given} {typed(rng.choice([family, family.split('-')[0]]))}", rng.choice(["", org, typed(org)])))
            forms.append((typed(org[9:-8]) + rng.choice([" Council", " Coun.", ""]), "") if rng.random() < 0.5 else (org[: rng.randint(14, len(org))], "Brief"))
    forms = [(i, w, c) for i, (w, c) in enumerate(dict.fromkeys(forms))]
    P = {i: variants.parts(w, c) for i, w, c in forms}
    told = spark.createDataFrame([(i, p["org"], p["given"], p["middle"], p["family"], p["words"], p["kind"]) for i, p in P.items()], variants._PARTS)
    known = spark.createDataFrame([], "x string, y string, nick boolean")
    got = {(r.a, r.b) for r in variants._people(told, known).unionByName(variants._organisations(told)).collect()}
    want = {(a, b) for a in P for b in P if a < b and variants.same_witness(P[a], P[b])}
    shared = sum(bool(set(P[a]["grams"]) & set(P[b]["grams"])) for a in P for b in P if a < b)
    assert want <= got and len(want) > 200 and sum(P[a]["org"] for a, _ in want) > 50 and len(got) < shared / 5


def test_variants(spark):
    rows = [
        (1, "Dr. Zoé Vasondtho", "Director of Research, Central Quildrawist Dairy Federation"), (2, "VASONDTHO, Dr. Z.", "CENTRAL QUILDRAWIST DAIRY FEDERATION"),
        (3, "Dr. Zoé Vaondtho", ""), (4, "Mr. Carl Vasondtho", "President, Central Quildrawist Dairy Federation"), (5, "Eastern Ildcald Veterans Federation", "Brief"),
        (6, "EIVF", "Eastern Ildcald Veterans Federation"), (7, "Western Ildcald Veterans Federation", "Brief"), (8, None, None), (9, "", ""), (1, "Dr. Zoé Vasondtho", "Director of Research, Central Quildrawist Dairy Federation"),
        (10, "Zoe B. Vasondtho", "Federation of Dairy, Central Quildrawist"),
    ]
    df = spark.createDataFrame(rows, "id long, who string, ctx string").withColumn("fid", F.lit(0)).withColumn("entity", F.lit(0))
    linked = variants.link_variants(df, key="id", name="who", context="ctx")
    ent = {r.fid: r.entity for r in linked.collect()}
    assert len(ent) == 10 and ent[1] == ent[2] == ent[3] == ent[10] == 1 and ent[4] == 4
    assert ent[5] == ent[6] == 5 and ent[7] == 7 and ent[8] == 8 and ent[9] == 9
    assert sorted((r.id_a, r.id_b) for r in variants.variant_pairs(linked).collect()) == [(1, 2), (1, 3), (1, 10), (2, 3), (2, 10), (3, 10), (5, 6)]
    assert variants.link_variants(df.limit(0), key="id", name="who", context="ctx").count() == 0


def test_nicknames_are_learned(spark):
    """Names that no list and no table has: short forms are told by their letters and the organisation, others learned."""
    fams = ["Zorven", "Holtin", "Maskel", "Perrow", "Quilda"]
    rows = []
    for k, f in enumerate(fams[:4]):
        one, two = f"{f}ton Dairy Council", f"Central {f}ford Grain Union"
        rows += [(10 * k, f"Thomas {f}", f"President, {one}"), (10 * k + 1, f"Tomo {f}", one), (10 * k + 2, f"Margaret {f}", two), (10 * k + 3, f"Peggy {f}", f"{two}, President")]
        rows += [(10 * k + 4, f"{['Ada', 'Ben', 'Cora', 'Dora'][k]} {f}", f"{f}wick Steel Board"), (10 * k + 5, f"Hugo {f}", f"{f}wick Steel Board")]
    rows += [(100, "Peggy Quilda", ""), (101, "Margaret Quilda", "Northern Steel Board"), (102, "Jennifer Quilda", "Ferry Board"), (103, "Jen Quilda", "The Ferry Board"), (104, "Tomo Zane", "")]
    rows += [(105, "Theodore Zane", "Steel Union"), (106, "Katherine Zane", "Steel Union")]
    df = spark.createDataFrame(rows, "id long, who string, ctx string")
    ent = {r.fid: r.entity for r in variants.link_variants(df, key="id", name="who", context="ctx").collect()}
    assert all(ent[10 * k + 2] == ent[10 * k + 3] == 10 * k + 2 and ent[10 * k] == ent[10 * k + 1] == 10 * k for k in range(4))
    assert all(ent[10 * k + 4] == 10 * k + 4 and ent[10 * k + 5] == 10 * k + 5 for k in range(4))
    assert ent[100] == ent[101] == 100 and ent[102] == ent[103] == 102 and ent[105] == 105 and ent[106] == 106


def test_organisations_of_short_words(spark):
    forms = [(1, "Dairy Board", ""), (2, "The DAIRY Board", ""), (3, "Steel Council", ""), (4, "Steel Coun.", ""), (5, "Steel Board", ""), (6, "Dairy Council", "")]
    linked = variants.link_variants(spark.createDataFrame(forms, "id long, who string, ctx string"), key="id", name="who", context="ctx")
    assert sorted((r.id_a, r.id_b) for r in variants.variant_pairs(linked).collect()) == [(1, 2), (3, 4)]


# --- p7, p8 ------------------------------------------------------------------------------------------------------------


def test_pack_follows_the_rule():
    """Against a plain version that tries every level."""
    rng = np.random.default_rng(3)
    for cap in (1, 2, 10, 37):
        sizes = rng.integers(1, cap + 1, 300)
        got = packing.pack(sizes, cap)
        fill = {}
        for c, s in zip(got, sizes):
            before = dict(fill)
            levels = [0] * (cap + 1)
            for v in before.values():
                if 0 < v < cap:
                    levels[v] += 1
            at = before.get(c, 0)

            def cost(h):
                lv = list(levels)
                if h:
                    lv[h] -= 1
                if h + s < cap:
                    lv[h + s] += 1
                return sum(x * x for x in lv)

            assert cost(at) == min(cost(h) for h in range(cap - s + 1) if h == 0 or levels[h])
            fill[c] = at + s
            assert fill[c] <= cap


def test_containers(spark):
    rng = random.Random(5)
    sizes = [(i, rng.randint(0, 300)) for i in range(500)] + [(9000, None), (9001, 1000)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    specs = spark.createDataFrame([(1, 100), (2, 256), (2, 256), (3, 0), (None, 5)], "spec_id int, capacity_tokens int")
    got = packing.fill_containers(df, specs, shard=200).toPandas()
    assert set(got.spec_id) == {1, 2}
    for (_, cap), g in got.groupby(["spec_id", "capacity"]):
        assert g.groupby("container").n_tokens.sum().max() <= cap
        assert g.groupby("doc_id").n_tokens.sum().to_dict() == {i: n for i, n in sizes if n}
        whole = g.groupby("doc_id").size()
        assert all(whole[i] == -(-n // cap) for i, n in sizes if n)
        firsts = g.sort_values(["doc_id", "piece_no"])
        assert all(r.first_token == (r.piece_no - 1) * cap for r in firsts.itertuples())
    one = packing.unused(packing.fill_containers(df, specs)).orderBy("spec_id").collect()
    many = packing.unused(packing.fill_containers(df, specs, shard=20)).orderBy("spec_id").collect()
    assert all(m.containers <= 1.05 * o.containers and m.tokens == o.tokens for o, m in zip(one, many))  # the open ones of 25 shards are put together
    assert packing.fill_containers(df.limit(0), specs).count() == 0
    assert packing.fill_containers(df, specs.limit(0)).count() == 0
    assert packing.unused(packing.fill_containers(df, specs)).count() == 2


def test_token_sizes(spark):
    enc = encoder()
    texts = ["", None, "Hello there <|endoftext|>", "é" * 50, "a b " * 40_000, "x" * 200_000, "a" + " " * 5000 + "b\n" + "\n" * 3000 + "1", " " * 4000, " " * 3000 + "word"]
    got = token_sizes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(enc.encode_ordinary(t or "")) for t in texts]
    assert n_tokens(enc, "a" + " " * 2_000_000 + "b") > 1000  # more than the pattern by itself can take


def test_water_fill():
    tokens, share, rep = {"a": 100, "b": 1000, "c": 10}, {"a": 0.5, "b": 0.3, "c": 0.1, "d": 0.1}, {"a": 2, "b": 2, "c": 3, "d": 2}
    got = mixing.water_fill(tokens, share, rep, 1000)
    assert got["a"] == 200 and got["c"] == 30 and got["d"] == 0 and got["b"] == pytest.approx(770)
    assert mixing.water_fill(tokens, share, rep, 1e6) == {"a": 200, "b": 2000, "c": 30, "d": 0}
    small = mixing.water_fill(tokens, share, rep, mixing.largest_total(tokens, share, rep))
    assert small["a"] / small["b"] == pytest.approx(5 / 3) and small["a"] <= 200 + 1e-6 and small["c"] <= 30 + 1e-6


def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, ["a", "b", "c", "zz", None][i % 5], rng.randint(0, 90)) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    w = spark.createDataFrame([("a", 0.6, 3), ("b", 0.3, 2), ("c", 0.05, 1), ("none", 0.05, 2), ("a", 0.6, 3)], "source string, target_share double, max_repeats int")
    sel, rep = mixing.mix(df, w, total=mixing.EXACT)
    got = sel.toPandas()
    limit = {"a": 3, "b": 2, "c": 1}
    assert set(got.source) == set(limit) and all(got.copies <= got.source.map(limit)) and got.doc_id.is_unique
    r = {x.source: x for x in rep.collect()}
    for s, t in (("a", 0.6), ("b", 0.3), ("c", 0.05)):
        assert r[s].reached_share == pytest.approx(t / 0.95, rel=0.003)
    assert r["none"].taken_tokens == 0
    again = mixing.mix(df.repartition(7).union(df.limit(100)), w, total=mixing.EXACT)[0].toPandas()  # repeated rows count once
    assert set(map(tuple, again.values)) == set(map(tuple, got.values))
    assert mixing.mix(df.limit(0), w)[0].count() == 0 and mixing.mix(df, w.limit(0))[0].count() == 0


def test_mix_clamps_in_turn(spark):
    """All tokens once: `a` is clamped at its two repeats; what it can't give puts `b` over its one, and `c` gets the rest."""
    docs = [(i, s, 10) for s, n in (("a", 10), ("b", 36), ("c", 54)) for i in range({"a": 0, "b": 1000, "c": 2000}[s], {"a": 0, "b": 1000, "c": 2000}[s] + n)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    w = spark.createDataFrame([("a", 0.5, 2), ("b", 0.25, 1), ("c", 0.25, 9)], "source string, target_share double, max_repeats int")
    sel, rep = mixing.mix(df, w)
    r = {x.source: (x.goal_tokens, x.taken_tokens, x.reached_share) for x in rep.collect()}
    assert r == {"a": (200.0, 200, 0.2), "b": (360.0, 360, 0.36), "c": (440.0, 440, 0.44)}
    got = sel.toPandas()
    assert set(got[got.source == "a"].copies) == {2} and set(got[got.source == "b"].copies) == {1} and got[got.source == "c"].copies.sum() == 44


def test_mix_passes_over_large_texts(spark):
    """One text of each source is larger than its goal; the others reach it, wherever the large one stands in the order."""
    docs = [(100 * s + i, f"s{s}", 1000 if i == 0 else 10) for s in range(8) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    w = spark.createDataFrame([(f"s{s}", 0.125, 1) for s in range(8)], "source string, target_share double, max_repeats int")
    sel, rep = mixing.mix(df, w, total=8 * 905.0)
    assert {r.source: r.taken_tokens for r in rep.collect()} == {f"s{s}": 900 for s in range(8)}
    got = sel.toPandas()
    assert set(got.copies) == {1} and got.doc_id.is_unique and set(got.n_tokens) == {10}


# --- p9 ----------------------------------------------------------------------------------------------------------------


def test_forms(spark):
    """The scores decide: the same lines in one table with prose, and prose of every kind stays prose."""
    prose = "The committee heard {} witnesses. It was late, and nobody had read the report that we sent to them in {}."
    kinds = {
        prose.format("nine", "May").upper(): "prose", "- the first item\n- the second item\n* a third": "list", "a\t1\t2\nb\t3\t4\nc\t5\t": "table",
        "Name;Yes;No\nNorth;1;2\nSouth;3;4%": "table", '<div class="x"><a href="#">Menu</a></div>\n' * 4: "junk",
        "1. " + prose.format(3, "June") + "\n2. " + prose.format(4, "July"): "prose", "Title\n\n" + prose.format("six", "March"): "prose",
        "Kelton\nMirford\nHulsey\nGalton": "list", "zx!!|q ^^~~ #@ {{ }} |/|\\ ~~ ^^": "junk", "organ, aid, fund, care, debt, ice, road, grain, tax, water, plan": "junk",
        "North Kelton, Mirford, Hulsey, Galton, Tasley, Orrsey, Dorgate, Lunford, Jorton, Wenano": "list",
    }
    rng = random.Random(3)
    said = ["The committee heard {} witnesses.", "It was late, and nobody had read the report.", "We sent {} of them to the house in May.", "Will the member tell us what that has cost?",
            "I have a letter from Mirford about the rules for grain; it is a long one.", "There will be {} new jobs.", "They closed the office, as you know.", "This is not what we were told by the minister in {}."]
    many = lambda: " ".join(rng.choice(said).format(rng.randint(2, 2000)) for _ in range(rng.randint(1, 30)))
    texts = [(i, rng.choice(["", "", "Opening remarks\n\n", "1. "]) + many(), "en") for i in range(300)] + [(1000 + k, t, "en") for k, t in enumerate(kinds)]
    form = {r.doc_id: r.form for r in quality.text_quality(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect()}
    assert [form[1000 + k] for k in range(len(kinds))] == list(kinds.values())
    assert {form[i] for i in range(300)} == {"prose"}


def test_ranks_and_quality(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["en", "fr", None]), float(rng.randint(0, 5)), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, lg string, x double, y double")
    got = {(r.doc_id, r.stat): (r.low, r.high) for r in quality.tail_probabilities(df.na.fill("und", ["lg"]), "doc_id", "lg", ["x", "y"]).collect()}
    for i, lg, x, y in rows:
        for stat, v, k in (("x", x, 2), ("y", y, 3)):
            own = [r[k] for r in rows if r[1] == lg]
            assert got[i, stat] == pytest.approx((sum(o <= v for o in own) / len(own), sum(o >= v for o in own) / len(own)))
    prose = "The committee heard nine witnesses in {}. It was late, and nobody had read the report that we sent to them."
    texts = [(i, prose.format(i), "en", 1) for i in range(300)] + [(1000, None, None, 1), (1001, "", "EN", 1), (1002, "vote! " * 40, "en", 1),
             (1003, "a;1\nb;2\nc;3", "", 1), (1004, "x" * 20000, "fr", 1), (1005, prose.format(1), "en", 1)]
    out = quality.text_quality(spark.createDataFrame(texts, "doc_id long, text string, lang string, words long"))
    form = {r.doc_id: r.form for r in out.collect()}
    assert len(form) == 306 and form[5] == form[1005] == "prose" and form[1000] == form[1001] == form[1002] == "junk" and form[1003] == "table"
    assert quality.text_quality(out.select("doc_id", F.lit("").alias("text"), F.lit("").alias("lang")).limit(0)).count() == 0


def test_copies_and_small_languages_are_judged_as_one_text_of_many(spark):
    prose = "The committee heard {} witnesses in {}. It was late, and nobody had read the report that we sent to them."
    junk = "Xelqar vontrip zumbed aklorin drevast quomple tindrax belvoor snarquil ophtern.\n" * 3
    once = [(i, prose.format(i, "May" if i % 2 else "the old house of June"), "en") for i in range(200)] + [(1000, junk, "en")]
    often = once + [(1001 + i, junk, "en") for i in range(150)]  # more than a third of the language
    few = [(2000, junk, "fr"), (2001, "Le comité a entendu les témoins de la ville. Il est tard, et nous avons lu le rapport.", "fr")]
    lone = [(3000, junk, "en")]
    german = [(4000, "Der Ausschuss hörte gestern neun Zeugen. Niemand kannte den Bericht.", "de")]
    for texts in (once, often, once + few, lone, german):
        form = {r.doc_id: r.form for r in quality.text_quality(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect()}
        assert form == {i: "junk" if t == junk else "prose" for i, t, _ in texts}
