"""Transcript XML into statements, and the two languages of a sitting put together.

A document is walked once, in document order, by one task; documents are spread over the cluster. What a walk carries from
element to element (headings, time, language, the open statement) is the state that no set operation has."""

from __future__ import annotations

import datetime as dt
import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What becomes of the elements of a transcript. Contents of EXCLUDED are dropped; RENAMED stay as tags under
# another name; of TEXT_ONLY the text stays. Any other element without a handler is an error of the document.
EXCLUDED = ("CatchLine", "Prayer", "QuestionID", "Appendix")
RENAMED = {"I": "em", "Sup": "sup", "Sub": "sub", "table": "table", "row": "tr", "entry": "td"}
TEXT_ONLY = (
    "Quote", "QuotePara", "ForceColumnBreak", "SubjectOfBusinessContent", "Content", "HansardBody", "Intro", "Poetry", "Query", "Motion", "MotionBody",
    "CommitteeQuote", "LegislationQuote", "Pause", "StartPause", "EndPause", "Date", "Insertion", "colspec", "tgroup", "tbody", "thead", "title", "EditorsNotes",
)
ROLES = {"28": "witness", "27": "clerk", "26": "analyst"}
# How labels of speakers begin, the words that open a sitting, and how a bill's stage is headed.
_LABEL = re.compile(r"^(?:Mr\.?\s|Mrs\.?\s|Ms\.?\s|Miss\.?\s|Hon\.?\s|Right\sHon\.\s|The\sSpeaker|Le\sprésident|The\sChair|The\sDeputy|The\sActing|An\s[hH]on\.?\s|Une\svoix|Des\svoix|Some\s[hH]on\.\s|M\.\s|Acting\s|L.hon\.?\s|Le\strès\s|Assistant\s|Mme\.?\s|Mlle\.?\s|Dr\.?\s)")
_HONORIFIC = re.compile(r"^(?:Mr\.?\s|Mrs\.?\s|Ms\.?\s|Miss\.?\s|Hon\.?\s|Right\sHon\.\s|M\.\s|L.hon\.?\s|Mme\.?\s|Mlle\.?\s|Dr\.?\s)")
_SOMEONE = re.compile(r"^(?:An?|Une)\s")
_MET = re.compile(r"^\s*(?:The\s+House\s+met\s+at|La\s+séance\s+est\s+ouverte\s+à)\s+(\d[\d:.]*)\s*([ap]\.m\.|)", re.I)
_BILL = re.compile(r"\s*(?:Projet de loi|Bill)\s+([CS]).(\d+)[,:\-.\s]+(.+)", re.I)
_THRONE = ("speech from the throne", "le discours du trône")
_META = {"MetaDateNumYear": "year", "MetaDateNumMonth": "month", "MetaDateNumDay": "day", "ParliamentNumber": "parliament", "SessionNumber": "session",
         "MetaDocumentCategory": "category", "Number": "number", "Acronyme": "acronym"}
_SITE = "http://www.parl.gc.ca"

STATEMENT = (
    "path string, document string, date date, session_id string, number string, category string, seq int, id string, time timestamp_ntz, who string, who_id string, "
    "context string, role string, kind string, written string, h1 string, h2 string, h3 string, bill string, stage string, lang string, procedural boolean, "
    "content string, pids array<string>, error string"
)
_COLS = [c.split()[0] for c in STATEMENT.split(", ")]


def _space(s: str | None) -> str:
    return re.sub(r"\s+", " ", s or "").strip()


def _letters(s: str | None) -> str:
    return re.sub(r"[^a-z]", "", (s or "").lower())


def _bare(who: str | None) -> str:
    """A speaker's name without brackets and form of address."""
    return _HONORIFIC.sub("", re.sub(r"\s*\(.+\)\s*", "", _space(who))).strip()


def _title(s: str) -> str:
    return s.title() if s.isupper() or s.islower() else s


def _tag(name: str, attrs: dict[str, str | None]) -> str:
    return f"<{name}" + "".join(f' {k}="{html.escape(v)}"' for k, v in sorted(attrs.items()) if v is not None) + ">"


class _Walk:
    """One document in document order. Elements go to `on_<tag>` methods, which may be added by a subclass; `state` is carried
    until it changes, `pending` belongs to the next statement."""

    def __init__(self, root: ET.Element) -> None:
        self.meta = {v: "" for v in _META.values()}
        for x in root.iter("ExtractedItem"):
            if x.get("Name") in _META:
                self.meta[_META[x.get("Name")]] = _space("".join(x.itertext()))
        m = self.meta
        try:
            self.day = dt.date(int(m["year"]), int(m["month"]), int(m["day"]))
        except ValueError:
            self.day = None
        self.language = (root.get("{http://www.w3.org/XML/1998/namespace}lang") or "en")[:2].lower()
        self.state: dict = {"lang": self.language, "time": None, "h1": "", "h2": "", "h3": "", "bill": None}
        self.pending: dict = {}
        self.open: dict | None = None
        self.done: list[dict] = []
        self.main: tuple[str | None, str] = ("", "")
        self.back: ET.Element | None = None  # whose child the next paragraph must be to go back to the main speaker
        self.unnamed = False  # whether `back` is set
        self.known: dict[str, dict[str, str]] = {}
        self.parent = {c: p for p in root.iter() for c in p}
        self.skipped: set[ET.Element] = set()

    # --- statements ---

    def add(self, text: str) -> None:
        if not text:
            return
        if self.open is None:
            self.open = {"parts": [], "pids": [], "plain": False, **self.state, **self.pending}
            self.pending = {}
        self.open["parts"].append(text)

    def close(self) -> None:
        if self.open is not None:
            if not re.sub(r"<[^>]*>|\s", "", "".join(self.open["parts"])):
                raise ValueError("a statement without content")
            self.done.append(self.open)
            self.open = None

    def person(self, hoc: str | None, label: str, kind: str | None = None) -> None:
        who, bare = _space(label), _bare(label)
        if self.open is not None:
            same = hoc == self.open.get("who_id") if hoc else _letters(bare) == _letters(_bare(self.open.get("who")))
            if same and not _SOMEONE.search(who):
                return
            self.close()
        seen = self.known.get(bare, {})
        got = {"who": who, "who_id": hoc or seen.get("who_id"), "role": ROLES.get(kind, "") if kind else seen.get("role", "")}
        inner = re.search(r"\s?\((.+)\)\s*$", who)
        got["context"] = inner[1] if inner else seen.get("context", "")
        for k, v in got.items():
            if v:
                self.pending[k] = v
        for name in (who, bare):
            self.known.setdefault(name, {}).update({k: v for k, v in got.items() if v and k != "who" and (k != "who_id" or hoc)})

    def speaking(self) -> bool:
        at = self.open if self.open is not None else self.pending
        return bool(at.get("who") or at.get("who_id"))

    # --- text inside a paragraph ---

    def inline(self, e: ET.Element) -> str:
        out = "" if e in self.skipped else html.escape(e.text or "", quote=False)
        return out + "".join(self.child(c) + html.escape(c.tail or "", quote=False) for c in e)

    def child(self, c: ET.Element) -> str:
        if not isinstance(c.tag, str) or c.tag in EXCLUDED:
            return ""
        if c.tag in RENAMED:
            return f"<{RENAMED[c.tag]}>{self.inline(c)}</{RENAMED[c.tag]}>"
        if c.tag == "B":
            return self.inline(c) if c in self.skipped else "" if c.text == ":" else f"<strong>{self.inline(c)}</strong>"
        if c.tag == "Verse":
            return f'<span class="verse">{self.inline(c)}</span>'
        if c.tag == "Line":
            return f"{self.inline(c)}<br>"
        if c.tag in ("Affiliation", "Document"):
            return self.link(c)
        if c.tag == "Division":
            return self.division(c)
        if c.tag in TEXT_ONLY:
            return self.inline(c)
        if handler := getattr(self, f"on_{c.tag}", None):
            handler(c)
            return ""
        raise ValueError(f"unknown element {c.tag}")

    def link(self, c: ET.Element) -> str:
        """A person or a bill that the text names, linked where it has a number."""
        body, hoc = self.inline(c), c.get("DbId")
        if not hoc or c in self.skipped:
            return body
        lang = self.language[0].upper()
        if c.tag == "Affiliation":
            href, kind = f"{_SITE}/MembersOfParliament/ProfileMP.aspx?Key={hoc}&Language={lang}", "politician"
        else:
            href, kind = f"{_SITE}/LegisInfo/BillDetails.aspx?&Mode=1&billId={hoc}&Language={lang}", "legislation"
        return _tag("a", {"href": href, "data-HoCid": hoc, "class": f"related_link {kind}"}) + body + "</a>"

    def division(self, c: ET.Element) -> str:
        n, m = c.get("DivisionNumber"), self.meta
        href = f"{_SITE}/HouseChamberBusiness/ChamberVoteDetail.aspx?Language={self.language[0].upper()}&Mode=1&Parl={m['parliament']}&Ses={m['session']}&Vote={n}"
        a = _tag("a", {"class": "related_link vote", "href": href, "data-number": n, "data-HoCid": c.get("id")})
        return f'<p class="division procedural">{a}Vote #{n}</a></p>'

    # --- paragraphs ---

    def follows(self, first: ET.Element, e: ET.Element) -> str:
        """The character after the first child of a paragraph."""
        rest = (first.tail or "") + "".join((c.text or "") + (c.tail or "") for c in list(e)[1:])
        return rest.strip()[:1]

    def label(self, e: ET.Element) -> ET.Element | None:
        """The bold text or affiliation in front of a paragraph that names a new speaker (X4): with a colon, in an interjection,
        or a title before a capital."""
        first = next(iter(e), None)
        if (e.text or "").strip() or first is None or first.tag not in ("B", "Affiliation"):
            return None
        said, nxt = (first.text or "").strip(), self.follows(first, e)
        if not said or not said[0].isupper() or not nxt:
            return None
        titled = bool(_LABEL.search(said)) and nxt.isupper()
        return first if said.endswith(":") or nxt == ":" or e.get("Interjection") or titled else None

    def para(self, e: ET.Element, procedural: bool = False) -> None:
        text, parent = (e.text or "").strip(), self.parent.get(e)
        if not "".join(e.itertext()).strip():
            return
        if (met := _MET.match(text)) and parent is not None and parent.tag == "Intro":
            self.state["time"] = self.sat(met[1], met[2])
            return
        first = self.label(e)
        if first is not None:
            hoc = first.get("DbId") if first.tag == "Affiliation" else None
            who = _space(first.text.replace(":", ""))
            # A role that isn't the main speaker says one line; the next unlabelled paragraph is the main speaker's again.
            self.unnamed = hoc != self.main[0] and not _letters(self.main[1]).startswith(_letters(who)) and not _HONORIFIC.search(who)
            self.back = parent if self.unnamed else None
            self.person(hoc, who)
            if not first.text.endswith(":") and (first.tail or "").startswith(":"):
                first.tail = first.tail[1:]
            self.skipped.add(first)
        elif self.unnamed:
            if self.back is parent:
                self.person(*self.main)
            self.unnamed, self.back = False, None
        if not self.speaking():
            if self.state["h2"].lower() in _THRONE and not self.state["h3"]:
                self.throne()
            else:
                procedural = True
        if text.startswith(("moved", "demande")):
            procedural = True
            self.drop_said(e, parent)
        procedural = procedural or text[:1] in ("(", "[") and bool(text)
        body = _space(self.inline(e))
        pid = e.get("id") or "0"
        attrs = {"data-HoCid": pid, "class": "procedural" if procedural else None, "data-originallang": None if procedural else self.state["lang"]}
        out = _tag("p", attrs) + body + "</p>"
        if next(e.iter("QuotePara"), None) is not None:
            out = f"<blockquote>{out}</blockquote>"
            if self.open and self.open["parts"] and self.open["parts"][-1].endswith("</blockquote>"):
                self.open["parts"][-1] = self.open["parts"][-1][: -len("</blockquote>")]
                out = out[len("<blockquote>") :]
        self.add(out)
        self.open["plain"] = self.open["plain"] or not procedural
        if e.get("id"):
            self.open["pids"].append(pid)

    def drop_said(self, e: ET.Element, parent: ET.Element | None) -> None:
        """After a motion the next paragraph that isn't quoted begins with a needless 'He said:'."""
        rest = iter(parent) if parent is not None else iter(())
        for c in rest:
            if c is e:
                break
        for c in rest:
            if c.tag == "ParaText" and next(c.iter("QuotePara"), None) is None:
                c.text = re.sub(r"^\s*([S]?[hH]e said:|--)\s*", "", c.text or "")
                return

    def throne(self) -> None:
        names = ("King Charles III", "Le roi Charles III") if (self.meta["parliament"], self.meta["session"]) == ("45", "1") else ("The Governor General", "Le gouverneur général")
        self.person(None, names[self.language != "en"])

    def sat(self, number: str, half: str) -> dt.datetime | None:
        h, _, m = number.strip(".:").replace(".", ":").partition(":")
        if not self.day or not h.isdigit():
            return None
        hour = int(h) % 12 + 12 * half.lower().startswith("p") if half else int(h)
        return dt.datetime.combine(self.day, dt.time()) + dt.timedelta(hours=hour, minutes=int(m) if m.isdigit() else 0)

    # --- elements ---

    def run(self, e: ET.Element) -> None:
        if not isinstance(e.tag, str) or e.tag in EXCLUDED:
            return
        if handler := getattr(self, f"on_{e.tag}", None):
            handler(e)
        elif e.tag in TEXT_ONLY or e.tag in RENAMED:
            self.children(e)
        else:
            raise ValueError(f"unknown element {e.tag}")

    def children(self, e: ET.Element) -> None:
        for c in e:
            self.run(c)

    def on_ParaText(self, e: ET.Element) -> None:
        self.para(e)

    on_ThroneSpeechPara = on_ParaText

    def on_ThroneSpeech(self, e: ET.Element) -> None:
        self.throne()
        self.children(e)

    def on_ProceduralText(self, e: ET.Element) -> None:
        """A heading of the table of contents tells the bill and its stage (X5), other procedural text is a paragraph."""
        if e.get("TocType") != "TPC":
            self.para(e, True)
            return
        from quorumlake.functions.markup import STAGES

        text, now = _space("".join(e.itertext())), self.state["bill"]
        named = _BILL.match(text)
        if not named and not now:
            return
        raw = named[3] if named else e.text or ""
        code = next((c for name, c in STAGES if name in raw.lower()), None)
        if named or code:
            number = f"{named[1]}-{named[2]}" if named else now.split(",")[0]
            self.state["bill"] = f"{number},{code or f'other[{raw}]'}"
            if self.open is not None:
                self.open["bill"] = self.state["bill"]

    def on_Intervention(self, e: ET.Element) -> None:
        self.pending["kind"], self.pending["id"] = e.get("Type") or "", e.get("id")
        self.children(e)
        self.close()

    def on_QuestionContent(self, e: ET.Element) -> None:
        self.pending["written"] = {"QuestionContent": "Q", "ResponseContent": "R"}[e.tag]
        self.children(e)
        self.close()

    on_ResponseContent = on_QuestionContent

    def on_WrittenQuestionResponse(self, e: ET.Element) -> None:
        qid = e.find("QuestionID")
        if qid is not None:
            self.state["h3"] = _space("".join(qid.itertext())).replace("--", "").strip()
        self.children(e)
        if self.state["h3"].lower().startswith("question"):
            self.state["h3"] = ""

    def on_PersonSpeaking(self, e: ET.Element) -> None:
        aff = e.find("Affiliation")
        if aff is None or not (aff.text or "").strip():
            return
        # The colon after a label is no part of the name.
        who = _space(aff.text).rstrip(":").strip()
        self.person(aff.get("DbId"), who, aff.get("Type"))
        self.main = (aff.get("DbId"), who)
        said = (aff.tail or "").replace(":", "").strip()
        if said and not said.startswith("("):
            self.add(html.escape(said, quote=False))

    on_Questioner = on_Responder = on_PersonSpeaking

    def on_Timestamp(self, e: ET.Element) -> None:
        h, m = (e.get("Hr") or "").replace(" ", ""), e.get("Mn") or "0"
        if self.day and h.isdigit() and m.isdigit():
            # Hours from 24 on are after midnight of the sitting day.
            self.state["time"] = dt.datetime.combine(self.day, dt.time()) + dt.timedelta(hours=int(h), minutes=int(m))
            if self.open is not None and not self.open["plain"]:
                self.open["time"] = self.state["time"]

    def on_FloorLanguage(self, e: ET.Element) -> None:
        lang = (e.get("language") or "").lower()
        self.state["lang"] = lang if lang in ("en", "fr") else None

    def on_OrderOfBusinessTitle(self, e: ET.Element) -> None:
        self.state["h1"] = _title(_space("".join(e.itertext())))

    def on_SubjectOfBusinessTitle(self, e: ET.Element) -> None:
        self.state.update(h2=_space("".join(e.itertext())), bill=None)

    def on_SubjectOfBusinessQualifier(self, e: ET.Element) -> None:
        self.state["h3"] = _space("".join(e.itertext()))

    def on_SubjectOfBusiness(self, e: ET.Element) -> None:
        self.children(e)
        self.state["h3"] = ""

    def on_OrderOfBusiness(self, e: ET.Element) -> None:
        self.children(e)
        self.state.update(h1="", h2="", bill=None)

    def on_Division(self, e: ET.Element) -> None:
        self.add(self.division(e))


def parse(data: bytes, path: str = "") -> list[dict]:
    """Statement rows of one document; a broken document is one row with the error."""
    text = data.decode("utf-8", errors="replace")
    text = re.sub(r"<B\s*/>|<ParaText\s*/>", "", text).replace("&nbsp;", " ").replace("&ccedil;", "ç")
    try:
        root = ET.fromstring(text.encode())
        w = _Walk(root)
        w.run(root.find("HansardBody") if root.find("HansardBody") is not None else root)
        w.close()
    except (ET.ParseError, ValueError, RecursionError) as e:
        return [dict.fromkeys(_COLS) | {"path": path, "seq": 0, "error": f"{type(e).__name__}: {e}"}]
    number = w.meta["number"].split()[-1].lstrip("0") if w.meta["number"] else ""
    out = []
    for k, s in enumerate(w.done):
        h1, h2, h3 = s["h1"], s["h2"], s["h3"]
        if h1 and not h2:
            h2, h3 = h3, ""
        bill, _, stage = (s["bill"] or "").partition(",")
        first = re.search(r'data-HoCid="([^"]+)"', "".join(s["parts"]))
        out.append({
            "path": path, "document": root.get("id"), "date": w.day, "session_id": f"{w.meta['parliament']}-{w.meta['session']}", "number": number, "category": w.meta["category"],
            "seq": k, "id": s.get("id") or (f"p{first[1]}" if first else None), "time": s["time"], "who": s.get("who", "")[:300], "who_id": s.get("who_id"),
            "context": s.get("context", "")[:300], "role": s.get("role", ""), "kind": (s.get("kind") or "").lower(), "written": s.get("written", ""), "h1": h1, "h2": h2, "h3": h3,
            "bill": bill or None, "stage": (stage if stage in ("1", "2", "3", "report", "senate") else "other") if bill else None, "lang": s["lang"],
            "procedural": not s["plain"], "content": "\n".join(s["parts"]), "pids": s["pids"], "error": None,
        })
    return out


def parsed(files: DataFrame) -> DataFrame:
    """Statements of the documents in `files` (path, content); one bad document doesn't stop the others, its row has the
    error (G8). A null content is such a document."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for p, c in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(parse(b"" if c is None else bytes(c), p), columns=_COLS)

    return files.select("path", "content").mapInPandas(run, STATEMENT)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Statements of all XML files below a path."""
    return parsed(spark.read.format("binaryFile").load(path))


def new_documents(files: DataFrame, stored: DataFrame) -> DataFrame:
    """The files that have no statements yet (J12, G8): `stored` has the path of every statement there is."""
    return files.join(stored.select("path"), "path", "left_anti")


def as_html(st: DataFrame) -> DataFrame:
    """path, html: each document's statements as elements with what is known of them (K13). A document is one text by its
    definition; its statements are gathered for that alone."""
    from quorumlake.functions.text import escaped, tag

    known = {"class": F.lit("statement"), "data-timestamp": F.col("time").cast("string"), "id": F.col("id"), "data-person-speaking-attribution": F.col("who"),
             "data-person-speaking-HoCid": F.col("who_id"), "data-person-speaking-type": F.col("role"), "data-h1": F.col("h1"), "data-h2": F.col("h2"), "data-h3": F.col("h3"),
             "data-intervention-type": F.col("kind"), "data-written-question": F.col("written"), "data-bill-stage": F.concat_ws(",", "bill", "stage")}
    attrs = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.nullif(v, F.lit("")))])
    one = F.concat(tag("div", attrs), F.replace("content", F.lit("</p>"), F.lit("</p>\n\t")), F.lit("</div>"))
    title = F.concat_ws(", ", F.when(F.lower("category") == "debates", "House Debates").otherwise(F.col("category")), F.col("date").cast("string"))
    rows = st.filter("error is null").select("path", "seq", one.alias("x"), title.alias("title"))
    body = rows.groupBy("path").agg(F.min("title").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x"))), lambda e: e["x"]), "\n").alias("body"))
    head = F.concat(F.lit("<!DOCTYPE html>\n<html><head>\n<meta charset=\"utf-8\">\n<title>"), escaped(F.col("title")), F.lit("</title>\n</head>\n<body>"))
    return body.select("path", F.concat(head, F.col("body"), F.lit("</body></html>")).alias("html"))


def merge_languages(en: DataFrame, fr: DataFrame) -> DataFrame:
    """English statements with `content_fr` (J13): the French statement of the same id with the same paragraphs, else the
    French paragraphs of the statement's paragraph ids in order, null where one is missing."""
    by_id = fr.select("document", "id", F.col("pids").alias("_pids"), F.col("content").alias("_whole"))
    para = fr.select("document", F.explode(F.arrays_zip("pids", F.split("content", "\n").alias("p"))).alias("x")).select("document", F.col("x.pids").alias("pid"), F.col("x.p").alias("_p")).dropDuplicates(["document", "pid"])
    wanted = en.select("document", "id", F.size("pids").alias("_n"), F.posexplode("pids").alias("pos", "pid"))
    parts = wanted.join(para, ["document", "pid"]).groupBy("document", "id", "_n").agg(F.array_sort(F.collect_list(F.struct("pos", "_p"))).alias("_l"))
    parts = parts.filter(F.size("_l") == F.col("_n")).select("document", "id", F.array_join(F.transform("_l", lambda x: x["_p"]), "\n").alias("_parts"))
    got = en.join(by_id, ["document", "id"], "left").join(parts, ["document", "id"], "left")
    return got.withColumn("content_fr", F.when(F.col("_pids") == F.col("pids"), F.col("_whole")).otherwise(F.col("_parts"))).drop("_pids", "_whole", "_parts")


def slug_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """document, old_slug, new_slug: where the first paragraph an old statement shares with any new one now stands."""
    a = old.select("document", F.col("slug").alias("old_slug"), F.posexplode("pids").alias("pos", "pid"))
    b = new.select("document", F.col("slug").alias("new_slug"), F.explode("pids").alias("pid"))
    first = a.join(b, ["document", "pid"]).groupBy("document", "old_slug").agg(F.min_by("new_slug", F.struct("pos", "new_slug")).alias("new_slug"))
    return first.filter("old_slug <> new_slug")


def free_slugs(new: DataFrame, taken: DataFrame) -> DataFrame:
    """`slug` of new statements, with -a, -b … where an old statement of another paragraph keeps the slug (X11)."""
    w = Window.partitionBy("document", "slug").orderBy("seq")
    clash = taken.select("document", "slug", F.lit(1).alias("_old")).distinct()
    got = new.join(clash, ["document", "slug"], "left").withColumn("_n", F.row_number().over(w))
    # a … z, then aa, ab …
    letter = F.expr("concat(if(_n > 26, chr(96 + int((_n - 1) / 26)), ''), chr(97 + (_n - 1) % 26))")
    return got.withColumn("slug", F.when(F.col("_old").isNotNull(), F.concat_ws("-", "slug", letter)).otherwise(F.col("slug"))).drop("_old", "_n")
