"""Raw captions into clean, ordered speaker turns (problem 3).

A fragment is cut into tokens, each with a symbol for its shape. A hidden Markov model tags them as speech, filler,
timestamp, annotation, speaker label or label end; labels can only end with a colon. Its probabilities start from a prior
and are re-estimated on all fragments by Viterbi training (state counts are summed by a distributed aggregate). The
decoded tags cut a fragment into segments, each under the fragment's own speaker or under a label inside it.

Different spellings of a speaker are resolved per document against the document's own labels: family names within a small
edit distance, given names, initials, the gender of the form of address. Then two ordered scans give the turns: who spoke
last is carried over fragments without a name, and a change of speaker starts a turn.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.runs import fill_forward, run_numbers
from quorumlake.session import written

STATES = "SFTALE"  # speech, filler, timestamp, annotation, speaker label, label end
#: Which states may show a symbol, with the prior probability of the symbol in the state.
EMIT = {
    "w": {"S": 0.7, "L": 0.01}, ".": {"S": 0.1, "L": 0.001}, "c": {"S": 0.12, "L": 0.35}, "d": {"S": 0.04, "L": 0.001}, "u": {"S": 0.002, "L": 0.1},
    "n": {"S": 0.01, "L": 0.06}, "i": {"S": 0.001, "L": 0.08}, "h": {"S": 0.002, "L": 0.2}, "m": {"S": 0.002, "L": 0.15},
    "a": {"A": 0.98, "L": 0.03, "T": 0.01, "S": 0.0002}, "t": {"T": 0.98, "A": 0.02, "S": 0.0002}, "f": {"F": 0.5, "S": 0.0002}, "k": {"F": 0.4, "S": 0.0002},
    "q": {"F": 0.1, "S": 0.0002}, "Q": {"F": 0.001, "S": 0.002}, "e": {"E": 0.99, "S": 0.0002}, "l": {"E": 0.001, "S": 0.005},
}
MOVE = {
    "^": {"S": 0.75, "F": 0.08, "T": 0.08, "A": 0.05, "L": 0.02, "E": 0.02},
    "S": {"S": 0.9, "F": 0.04, "T": 0.02, "A": 0.02, "L": 0.01, "E": 0.005},
    "F": {"S": 0.9, "F": 0.04, "T": 0.02, "A": 0.02, "L": 0.01, "E": 0.005},
    "T": {"S": 0.9, "F": 0.04, "T": 0.02, "A": 0.02, "L": 0.01, "E": 0.005},
    "A": {"S": 0.9, "F": 0.04, "T": 0.02, "A": 0.02, "L": 0.01, "E": 0.005},
    "L": {"L": 0.5, "E": 0.5},
    "E": {"S": 0.85, "F": 0.08, "T": 0.03, "A": 0.03, "L": 0.005, "E": 0.005},
}
#: The prior counts as so many observations of each state in the re-estimation, which ends when no path changes any more.
PRIOR_WEIGHT, ROUNDS = 20.0, 10

_TIME = r"[\[(<{]?\s*\d{1,2}(?::\d{2}(?::\d{2})?|h\d{2}(?:m\d{2}s?)?)\s*[\])>}]?(?!\w)"
_OTHER = r"(?P<w>\S+?(?=>>|—(?=\s)|\s|[\[<{{]|$))|\S"
_TOKEN = re.compile(
    rf"(?P<t>{_TIME})|(?P<b>[\[({{<*♪])|(?P<k>\b(?:you\s+know|i\s+mean)\b(?P<kp>[,.…]*))|(?P<m>>>|—|–|(?<=\s)--?(?=\s))|{_OTHER}",
    re.I,
)
_PLAIN = re.compile(_OTHER)
_CLOSE = {"[": "]", "(": ")", "{": "}", "<": ">", "*": "*", "♪": "♪"}
_FILLER = re.compile(r"(?:u+h+m*|u+m+|e+r+m*|a+h+|e+u+h+|h+m+|m+h*m+|oh)[,.…;!?-]*", re.I)
_HONORIFIC = re.compile(r"(?:mr|mrs|ms|miss|hon|dr|prof|chief|m|mme|rt)\.?", re.I)
_ASKED = re.compile(r"\s*(?:how|what|where|why|who|which|whether|if)\b", re.I)
_INITIAL = re.compile(r"[^\W\d_]\.(?:-?[^\W\d_]\.)*")


class _Closers:
    """Where a bracket of a text ends: at the next mark of its kind in its line. The next mark is looked for once, so a text
    of opening brackets costs no more than its length."""

    def __init__(self, text: str) -> None:
        self.text, self.next = text, {}

    def find(self, mark: str, at: int) -> int:
        """The first `mark` from `at` on, the length of the text where there is none; `at` never falls for a mark."""
        got = self.next.get(mark, -1)
        if got < at:
            got = self.text.find(mark, at)
            self.next[mark] = got = len(self.text) if got < 0 else got
        return got

    def end(self, at: int) -> int:
        """The end of the annotation that begins at `at`, or `at` for none."""
        opener = self.text[at]
        to = self.find(_CLOSE[opener], at + 1 + (opener == "*"))
        if to < min(len(self.text), self.find("\n", at)):
            return to + 1
        return at + 1 if opener == "♪" else at


def tokens(text: str) -> tuple[list[str], str]:
    """Tokens of a fragment and the string of their symbols (see EMIT), one each."""
    toks: list[str] = []
    syms: list[str] = []
    last, pos, closers = "", 0, _Closers(text)
    while x := _TOKEN.search(text, pos):
        at, pos = x.span()
        noted = 0
        if x["b"]:
            noted = closers.end(at)
            if noted > at:
                pos = noted
            else:
                x, noted = _PLAIN.match(text, at), 0
                pos = x.end()
        s = text[at:pos]
        if noted:
            if text.startswith(":", pos):
                s, sym, pos = s + ":", "e", pos + 1
            else:
                sym = "t" if re.fullmatch(_TIME, s.strip("[](){}<>*♪ ")) else "a"
        elif x.re is _TOKEN and x["t"]:
            sym = "t"
        elif x.re is _TOKEN and x["k"]:
            if x["kp"]:
                sym = "k"
            else:
                asked = last.lower().strip(",.") == "do" or _ASKED.match(text, pos)
                sym = "Q" if asked and s.lower().startswith("you") else "q"
        elif x.re is _TOKEN and x["m"]:
            sym = "m"
        elif _FILLER.fullmatch(s):
            sym = "f"
        elif s.endswith(":"):
            sym = "e" if s[0].isupper() or s[0] in ")]" else "l"
        elif _HONORIFIC.fullmatch(s) and s[0].isupper():
            sym = "h"
        elif _INITIAL.fullmatch(s) and s[0].isupper():
            sym = "i"
        elif s[0].isupper():
            bare = s.rstrip(",.?!;…")
            sym = "n" if s.endswith(",") else "d" if bare != s else "u" if len(bare) > 1 and bare.isupper() else "c"
        elif not any(ch.isalnum() for ch in s):
            sym = "."
        else:
            sym = "." if s[-1] in ".?!" else "w"
        if sym not in "fta":
            last = s
        toks.append(s)
        syms.append(sym)
    return toks, "".join(syms)


class Model:
    """Log probabilities of the tagger; `train` gives one from counts."""

    def __init__(self, emit: dict | None = None, move: dict | None = None) -> None:
        self.emit = {s: {k: math.log(v) for k, v in row.items()} for s, row in (emit or EMIT).items()}
        self.move = {a: {b: math.log(v) for b, v in row.items()} for a, row in (move or MOVE).items()}

    def decode(self, syms: str) -> str:
        """The best path of states for the symbols (Viterbi); '' for none."""
        if not syms:
            return ""
        best = {"^": 0.0}
        back: list[dict[str, str]] = []
        for s in syms:
            now: dict[str, float] = {}
            came: dict[str, str] = {}
            for b, e in self.emit[s].items():
                top, arg = -1e300, ""
                for a, p in best.items():
                    q = p + self.move[a].get(b, -1e9)
                    if q > top:
                        top, arg = q, a
                now[b], came[b] = top + e, arg
            best = now
            back.append(came)
        # A label must end: a path that stops inside one is as good as impossible.
        at = max(best, key=lambda k: best[k] - (1e9 if k == "L" else 0))
        path = []
        for came in reversed(back):
            path.append(at)
            at = came[at]
        return "".join(reversed(path))

    @staticmethod
    def train(counts: dict[tuple[str, str, str], float]) -> Model:
        """Counts of ('e', state, symbol) and ('m', state, state) joined with the prior."""
        emit: dict[str, dict[str, float]] = {s: {} for s in EMIT}
        for st in STATES:
            own = {s: PRIOR_WEIGHT * row[st] + counts.get(("e", st, s), 0.0) for s, row in EMIT.items() if st in row}
            total = sum(own.values())
            for s, v in own.items():
                emit[s][st] = v / total
        move = {}
        for a, row in MOVE.items():
            own = {b: PRIOR_WEIGHT * v + counts.get(("m", a, b), 0.0) for b, v in row.items()}
            total = sum(own.values())
            move[a] = {b: v / total for b, v in own.items()}
        return Model(emit, move)


def _learn(model: Model, before: Model | None):
    """A pass over distinct symbol strings and their numbers: counts under `model`, and how many tokens it tags otherwise
    than `before` did, as ('c', '', '')."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in rows:
            for syms, n in zip(pdf["syms"], pdf["n"]):
                path = model.decode(syms)
                total["c", "", ""] += n * (sum(a != b for a, b in zip(path, before.decode(syms))) if before else 1)
                for a, s in zip(path, syms):
                    total["e", a, s] += n
                for a, b in zip("^" + path, path):
                    total["m", a, b] += n
        yield pd.DataFrame([(*k, float(v)) for k, v in total.items()], columns=["kind", "a", "b", "n"])

    return run


def train(syms: DataFrame) -> Model:
    """The tagger for symbol strings `syms` (syms, n): Viterbi training until no token changes its tag. Each round is a pass
    over the distinct strings and an aggregate of at most some hundred (state, symbol) and (state, state) pairs."""
    model, before = Model(), None
    for _ in range(ROUNDS):
        got = syms.mapInPandas(_learn(model, before), "kind string, a string, b string, n double").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
        counts = {(r.kind, r.a, r.b): r.n for r in got.collect()}
        if not counts.pop(("c", "", ""), 0.0):
            break
        model, before = Model.train(counts), model
    return model


def segments(toks: list[str], path: str) -> list[tuple[str | None, str]]:
    """(label or None for the fragment's own speaker, clean words) in order; a label may be followed by no words."""
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    label: list[str] = []
    for tok, st in zip(toks, path):
        if st in "LE":
            label.append(tok)
            if st == "E":
                out.append((" ".join(label), []))
                label = []
        elif st == "S":
            out[-1][1].append(tok)
    clean = [(a, " ".join(w) if any(ch.isalnum() for x in w for ch in x) else "") for a, w in out]
    return [x for x in clean if x[0] is not None or x[1]]


# --- who is meant by a label -------------------------------------------------------------------------------------------

_ROLE = re.compile(r"^(?:the |mr |madam |ms |mrs )*(?:acting |deputy )?(speaker|chair|chairman|clerk|president)$")
_CROWD = re.compile(r"^(?:some |an |a |the )*(?:hon |right hon )*(members?|voices?|senators?)$")
_GENDER = {"mr": "M", "ms": "F", "mrs": "F", "miss": "F", "mme": "F", "madam": "F"}


def fold(s: str) -> str:
    """Lower case without accents."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(ch))


def parse_label(label: str) -> tuple[str, str, str, str]:
    """(role, family, given, gender); role is set for offices and crowds, else family; given may be an initial."""
    s = re.sub(r"[(\[][^)\]]*[)\]]?", " ", label)
    s = fold(s).replace(">>", " ").strip(" :—–-.\t ")
    bare = re.sub(r"[.\s ]+", " ", s).strip()
    if m := _ROLE.match(bare):
        return m[1], "", "", ""
    if _CROWD.match(bare):
        return "crowd:" + bare, "", "", ""
    gender = ""
    parts = re.split(r"\s*,\s*", s)
    words = [[w.strip(".") for w in re.split(r"[\s ]+", p) if w.strip(".")] for p in parts]
    for ws in words:
        while ws and _HONORIFIC.fullmatch(ws[0]) and (len(ws) > 1 or len(words) > 1 or len(ws[0]) > 1):
            gender = gender or _GENDER.get(ws[0], "")
            ws.pop(0)
    words = [ws for ws in words if ws]
    if not words:
        return "crowd:" + bare, "", "", gender
    if len(words) > 1:
        return "", words[0][-1] if len(words[0]) == 1 else " ".join(words[0]), words[1][0], gender
    ws = words[0]
    return "", ws[-1], ws[0] if len(ws) > 1 else "", gender


def _near(a: str, b: str, most: int) -> int:
    """Edit distance with neighbour swaps, or most + 1 where it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            cur.append(d)
        if min(cur) > most:
            return most + 1
        prev2, prev = prev, cur
    return prev[-1]


def resolve(labels: list[tuple[str, int]]) -> dict[str, str]:
    """Speaker of each label of one document, given with its number of uses. '?family' where several people of that name
    fit equally: the scan then takes whoever of them spoke last."""
    parsed = {lab: parse_label(lab) for lab, _ in labels}
    uses = Counter()
    for lab, n in labels:
        if not parsed[lab][0]:
            uses[parsed[lab][1]] += n
    family: dict[str, str] = {}
    kept: list[str] = []
    for f, n in sorted(uses.items(), key=lambda x: (-x[1], x[0])):
        most = 2 if len(f) >= 7 else 1 if len(f) >= 4 else 0
        found = [(d, i) for i, k in enumerate(kept) if (d := _near(f, k, most)) <= most]
        if found and n <= uses[kept[min(found)[1]]]:
            family[f] = kept[min(found)[1]]
        else:
            family[f] = f
            kept.append(f)
    people: dict[str, Counter] = {}
    sex: dict[tuple[str, str], set[str]] = {}
    for lab, n in labels:
        role, f, g, gender = parsed[lab]
        if not role and len(g) > 1:
            people.setdefault(family[f], Counter())[g] += n
    merged: dict[tuple[str, str], str] = {}
    for f, givens in people.items():
        firm: list[str] = []
        for g, _ in sorted(givens.items(), key=lambda x: (-x[1], x[0])):
            same = next((k for k in firm if _near(g, k, 1 if len(g) < 7 else 2) <= (1 if len(g) < 7 else 2)), None)
            if same is None:
                firm.append(g)
            merged[f, g] = same or g
    for lab, _ in labels:
        role, f, g, gender = parsed[lab]
        if not role and len(g) > 1 and gender:
            sex.setdefault((family[f], merged[family[f], g]), set()).add(gender)
    out = {}
    for lab, _ in labels:
        role, f, g, gender = parsed[lab]
        if role:
            out[lab] = role
            continue
        f = family[f]
        who = sorted({v for (k, _), v in merged.items() if k == f})
        if len(g) > 1:
            who = [merged[f, g]]
        elif g:
            who = [w for w in who if w[0] == g] or [g]
        if len(who) > 1 and gender:
            who = [w for w in who if gender in sex.get((f, w), {gender})] or who
        out[lab] = f"{f}|{who[0]}" if len(who) == 1 else f"{f}|" if not who else f"?{f}"
    # A family name never met with a given name is one person, also where an initial was seen.
    alone: dict[str, set[str]] = {}
    for v in out.values():
        if "|" in v:
            alone.setdefault(v.split("|")[0], set()).add(v.split("|")[1])
    for lab, v in out.items():
        f, _, g = v.partition("|")
        if v[0] != "?" and not g and "|" in v:
            rest = alone[f] - {""}
            out[lab] = f"{f}|{next(iter(rest))}" if len(rest) == 1 else f"?{f}" if rest else v
    return out


def speaker_turns(df: DataFrame) -> DataFrame:
    """Turn parts of captions `df` (id, document_id, time, who, content): document_id, turn_no, part_no, id, speaker, words.

    A fragment sent again (same document, time and content) counts once, under its smallest id; rows equal in id count
    once. Null content or time: the row has no words and belongs to no turn; null who is an empty one. Fragments of equal
    time are ordered by id. Before anyone is named the speaker is ''. Texts are tagged whole, whatever their length."""
    kept = (
        df.filter(F.col("document_id").isNotNull() & F.col("time").isNotNull() & F.col("content").isNotNull())
        .groupBy("document_id", "time", "content")
        .agg(F.min(F.struct("id", "who")).alias("_k"))
        .select("document_id", "time", "content", F.col("_k.id").alias("id"), F.coalesce("_k.who", F.lit("")).alias("who"))
    )

    def cut(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            got = [tokens(t) for t in pdf["content"]]
            yield pd.DataFrame(
                {"document_id": pdf["document_id"], "time": pdf["time"], "id": pdf["id"], "who": pdf["who"],
                 "toks": [a for a, _ in got], "syms": [b for _, b in got]}
            )

    base = dict(kept.dtypes)
    cols = f"document_id {base['document_id']}, time {base['time']}, id {base['id']}, who string"
    tagged = written(kept.mapInPandas(cut, f"{cols}, toks array<string>, syms string"), "p3-tokens")
    model = train(written(tagged.groupBy("syms").agg(F.count("*").alias("n")), "p3-symbols"))

    def split(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for doc, t, i, who, toks, syms in pdf.itertuples(index=False):
                for k, (label, words) in enumerate(segments(list(toks), model.decode(syms))):
                    out.append((doc, t, i, k, who if label is None else label, label is not None, words))
            yield pd.DataFrame(out, columns=["document_id", "time", "id", "part", "label", "inside", "words"])

    shape = f"document_id {base['document_id']}, time {base['time']}, id {base['id']}, part int, label string, inside boolean, words string"
    parts = written(tagged.mapInPandas(split, shape), "p3-parts")
    labels = parts.filter(F.trim("label") != "").groupBy("document_id", "label").agg(F.count("*").alias("n"))

    def who_is(pdf: pd.DataFrame) -> pd.DataFrame:
        got = resolve(list(zip(pdf["label"], pdf["n"].astype(int))))
        return pd.DataFrame({"document_id": pdf["document_id"], "label": pdf["label"], "speaker": [got[x] for x in pdf["label"]]})

    # One row per spelling used in a sitting: the distinct labels, never the fragments.
    speakers = labels.groupBy("document_id").applyInPandas(
        who_is, f"document_id {base['document_id']}, label string, speaker string"
    )
    # The scans read their input several times, so it is written before each.
    named = parts.join(speakers, ["document_id", "label"], "left").withColumn("chunk", F.date_trunc("hour", "time"))
    order = ["time", "id", "part"]
    # Someone of several of one name: whoever of that name spoke last in the document, else one of their own.
    unsure = F.col("speaker").startswith("?")
    fam = F.when(unsure, F.expr("substring(speaker, 2)")).otherwise(F.split("speaker", r"\|").getItem(0))
    named = named.withColumn("_fam", F.coalesce(fam, F.lit(""))).withColumn("_sure", F.when(~unsure, F.col("speaker")))
    named = fill_forward(written(named, "p3-named"), ["document_id", "_fam"], order, "_sure", "_last", "chunk")
    named = named.withColumn("speaker", F.when(unsure, F.coalesce("_last", "speaker")).otherwise(F.col("speaker"))).drop("_fam", "_sure", "_last")
    # A part without words names the next speaker only where it is a label inside a fragment.
    spoke = written(named.filter((F.col("words") != "") | F.col("inside")), "p3-spoke")
    filled = fill_forward(spoke, ["document_id"], order, "speaker", "who", "chunk").filter("words <> ''")
    filled = filled.withColumn("who", F.coalesce("who", F.lit("")))
    turns = run_numbers(written(filled, "p3-filled"), ["document_id"], order, "who", "turn_no", "chunk")
    return turns.select(
        "document_id", F.col("turn_no").cast("int").alias("turn_no"), "time", "id", F.col("part").alias("part_no"),
        F.col("who").alias("speaker"), "words",
    )
