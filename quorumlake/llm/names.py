"""Names of people and organisations as typed, brought to comparable parts."""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

# Common forms of address, credentials, English words for kinds of organisation, directions and posts, and
# what stands in place of an organisation. Only whole words are listed; abbreviations are told from them by rule.
ADDRESS = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "chief", "hon", "rt", "sir", "mme", "elder", "rev", "the"}
CREDENTIALS = {"md", "phd", "p.eng", "peng", "qc", "q.c", "kc", "k.c", "m.d", "ph.d", "cpa", "ca", "llb", "mba", "ba", "ma", "msc", "bsc", "jd", "rn", "jr", "sr", "esq"}
KINDS = """academy agency alliance assembly association authority bank board bureau centre chamber club coalition college commission committee
    company congress cooperative corporation council department federation forum foundation group guild hospital institute league ministry
    museum network office organization partnership school secretariat service society syndicate trust union university""".split()  # fmt: skip
DIRECTIONS = "northern southern eastern western central greater upper lower inner outer".split()
HEADS = """president director chair chairman chairwoman chairperson secretary treasurer counsel economist adviser advisor officer manager
    coordinator analyst administrator registrar superintendent scientist consultant spokesperson representative principal dean founder
    vp ceo cfo coo""".split()  # fmt: skip
POST_WORDS = frozenset(HEADS) | set("""of and the for vice chief executive deputy assistant associate senior junior general policy research acting interim past former
    public affairs relations government external internal communications operations legal financial national international co""".split())  # fmt: skip
NO_CONTEXT = {"", "as an individual", "individual", "intervener", "brief", "written submission", "witness"}


def abbreviates(short: str, word: str) -> bool:
    """Whether the letters of `short` are letters of `word` in order, from its first on."""
    if not short or short[0] != word[0] or len(short) >= len(word):
        return False
    at = iter(word)
    return all(ch in at for ch in short)


@lru_cache(maxsize=1 << 16)
def expand(token: str, words: tuple[str, ...]) -> str | None:
    """The one of `words` that the token is or, ending with a stop or written with an apostrophe, abbreviates best (the
    longest common beginning); '' where several fit equally, None for none."""
    bare = token.strip(".'-").replace("'", "")
    if bare in words:
        return bare
    if token.endswith("..") or not (token.endswith(".") or "'" in token.strip("'")):
        return None
    fit = [(len(os.path.commonprefix([bare, w])), w) for w in words if abbreviates(bare, w)]
    if not fit:
        return None
    most = max(n for n, _ in fit)
    best = [w for n, w in fit if n == most]
    return best[0] if len(best) == 1 else ""


_KINDS, _DIRECTIONS, _POSTS = tuple(KINDS), tuple(DIRECTIONS), tuple(sorted(POST_WORDS))


@lru_cache(maxsize=1 << 16)
def is_post(part: str) -> bool:
    """Whether all words of the (folded) part are those of a post, one of them its head; words may be abbreviated."""
    words = [w for w in re.split(r"[\s-]+", part) if w]
    known = [expand(w, _POSTS) for w in words]
    if not words or any(k is None for k in known):
        return not part.strip(".") or bool(re.fullmatch(r"(?:[a-z]\.){2,3}[a-z]?\.?", part))
    return any(k in HEADS or k == "" or k != w.strip(".") for k, w in zip(known, words))


def fold(s: str) -> str:
    """Lower case without accents, any space one blank."""
    s = unicodedata.normalize("NFKD", (s or "").replace(" ", " "))
    return re.sub(r"\s+", " ", "".join(c for c in s if not unicodedata.combining(c)).lower()).strip()


def _words(s: str) -> list[str]:
    return [w for w in re.split(r"[\s,;/()\[\]—–]+", s) if w.strip(".'-")]


def _direction(word: str, first: bool) -> str | None:
    """The direction a word of an organisation names: a whole one, its beginning (north), or in front an abbreviation."""
    bare = word.strip(".'-")
    if bare in DIRECTIONS:
        return bare
    if len(bare) >= 4 and f"{bare}ern" in DIRECTIONS or bare == "center":
        return f"{bare}ern" if bare != "center" else "central"
    return (expand(word, _DIRECTIONS) or None) if first else None


def organisation(text: str) -> tuple[list[str], str]:
    """(words of an organisation's name in full form, its kind or ''): posts, legal endings and small words are left out."""
    parts = [p.strip(" ") for p in re.split(r",|;", fold(text))]
    kept = [p for p in parts if p and p.strip(".") not in NO_CONTEXT and not is_post(p) and not p.endswith(" office")]
    words, kind = [], ""
    for p in kept:
        first = True
        for w in _words(p):
            b = w.strip(".'-")
            if b in ("inc", "ltd", "llc", "corp", "limited", "incorporated", "the", "of", "and", "for"):
                continue
            k = None if kind else expand("centre" if b == "center" else w, _KINDS)
            d = _direction(w, first)
            first = False
            if d:
                words.append(d)
            elif k is not None:
                kind = k
            else:
                words.append(b)
    return words, kind


_ACRONYM = re.compile(r"(?:[A-Z]\.?){3,7}")


def is_acronym(who: str) -> bool:
    return bool(_ACRONYM.fullmatch((who or "").strip()))


def is_organisation(who: str) -> bool:
    """A kind of organisation in the name, a direction in front, or an acronym."""
    words = [w for w in _words(fold(who)) if w != "the"]
    named = (w for w in words if len(w.strip(".'")) > 2 and w.strip(".'") not in ADDRESS | CREDENTIALS)
    if is_acronym(who) or any(expand(w, _KINDS) is not None for w in named):
        return True
    if not words or "," in who:
        return False
    return words[0] in DIRECTIONS or len(words) > 2 and len(words[0]) > 2 and _direction(words[0], True) is not None


def person(who: str) -> tuple[str, str, str]:
    """(given, middle initials, family), folded; given may be an initial or ''."""
    f = re.sub(r"[(\[].*?[)\]]", " ", fold(who)).strip(" :")
    parts = [[w.strip(".'") for w in p.split() if w.strip(".'-")] for p in f.split(",")]
    parts = [[w for w in p if w not in ADDRESS or len(p) == 1 and len(parts) == 1] for p in parts]
    parts = [[w for w in p if w not in CREDENTIALS] for p in parts]
    parts = [p for p in parts if p]
    if not parts:
        return "", "", ""
    if len(parts) > 1:
        family, rest = " ".join(parts[0]), parts[1]
    else:
        # Double names come with a hyphen or a blank: all but the given name and initials.
        ws = parts[0]
        rest = ws[:1] if len(ws) > 1 else []
        tail = ws[1:] if len(ws) > 1 else ws
        while len(tail) > 1 and len(tail[0]) == 1:
            rest, tail = [*rest, tail[0]], tail[1:]
        family = " ".join(tail)
    given = rest[0] if rest else ""
    middle = "".join(w[0] for w in rest[1:])
    return given, middle, family.replace("-", " ")


def initials(words: list[str], kind: str) -> str:
    return "".join(w[0] for w in words) + kind[:1]
