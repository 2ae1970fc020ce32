"""The list resources of the interface: filter sets, natural orders, and what a row looks like as JSON.

Every function takes frames with the reference's column names and gives a `Resource`; a filter that names something in
another table is a semi-join, so lists stay one row per entity whatever the other table repeats."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import text as tx
from quorumlake.operators.filters import NUMBERS, BadRequest, ByChoice, ByColumn, ByFunction, ByPerson, Resource

BALLOTS = {"Y": "Yes", "N": "No", "P": "Paired", "A": "Didn't vote"}
RESULTS = {"Y": "Passed", "N": "Failed", "T": "Tie"}


@dataclass(frozen=True)
class ByPath:
    """A path whose last parts are a natural key of `lookup` (id and `keys` in order); rows whose `column` is an id of it."""

    column: str
    lookup: DataFrame
    keys: tuple[str, ...]

    def apply(self, df: DataFrame, op: str, raw: str) -> DataFrame:
        parts = [p for p in raw.split("/") if p]
        if len(parts) < len(self.keys):
            raise BadRequest(f"{raw} has too few parts")
        kinds = dict(self.lookup.dtypes)
        found = self.lookup
        for k, v in zip(self.keys, parts[-len(self.keys) :]):
            found = found.filter(F.col(k) == F.lit(v).try_cast(kinds[k]))
        return df.join(found.select(F.col("id").alias(self.column)), self.column, "left_semi")


@dataclass(frozen=True)
class ByLast:
    """A path whose last part is the value of the column."""

    column: str

    def apply(self, df: DataFrame, op: str, raw: str) -> DataFrame:
        last = [p for p in raw.split("/") if p][-1:] or [""]
        return df.filter(F.col(self.column) == F.lit(last[0]).try_cast(dict(df.dtypes)[self.column]))


@dataclass(frozen=True)
class ByBridge:
    """Rows that a filter on the bridge table (its own `column`, the rows' id in `owner`) keeps: containment."""

    bridge: DataFrame
    owner: str
    inner: object

    def apply(self, df: DataFrame, op: str, raw: str) -> DataFrame:
        ids = self.inner.apply(self.bridge, op, raw).select(F.col(self.owner).alias("id"))
        return df.join(ids, "id", "left_semi")


@dataclass(frozen=True)
class ByDocument:
    """The address of a sitting (/debates/Y/M/D/) or of a committee's meeting (/committees/slug/session/number/); the rows of
    its document (P12). `documents` has id, document_type, date; `meetings` committee, session, number, evidence_id."""

    documents: DataFrame
    meetings: DataFrame

    def apply(self, df: DataFrame, op: str, raw: str) -> DataFrame:
        u = raw.strip("/").split("/")
        if len(u) < 4 or u[-4] not in ("debates", "committees"):
            raise BadRequest("no address of a document")
        if u[-4] == "debates":
            try:
                day = dt.date(*map(int, u[-3:]))
            except ValueError:
                raise BadRequest("no date") from None
            found = self.documents.filter((F.col("document_type") == "D") & (F.col("date") == F.lit(day))).select(F.col("id").alias("document_id"))
        else:
            if not u[-1].isdigit():
                raise BadRequest("no number of a meeting")
            m = self.meetings
            found = m.filter((m["committee"] == u[-3]) & (m["session"] == u[-2]) & (m["number"] == int(u[-1]))).select(F.col("evidence_id").alias("document_id"))
        return df.join(found, "document_id", "left_semi")


def bills(df: DataFrame, people: DataFrame) -> Resource:
    own = {k: ByColumn(k) for k in ("session", "legisinfo_id", "number", "law", "status_code")}
    return Resource(df, own | {
        "introduced": ByColumn("introduced", NUMBERS), "private_member_bill": ByColumn("privatemember"),
        "sponsor_politician": ByPerson("sponsor_politician_id", people), "sponsor_politician_membership": ByLast("sponsor_member_id"),
    }, (F.desc("introduced"), F.col("id")))


def votes(df: DataFrame, bills: DataFrame) -> Resource:
    numbers = {k: ByColumn(k, NUMBERS) for k in ("yea_total", "nay_total", "paired_total", "date", "number")}
    return Resource(df, numbers | {
        "session": ByColumn("session"), "bill": ByPath("bill_id", bills, ("session", "number")), "result": ByChoice("result", RESULTS),
    }, (F.desc("date"), F.desc("number"), F.col("id")))


def ballots(df: DataFrame, votes: DataFrame, people: DataFrame) -> Resource:
    return Resource(df, {
        "vote": ByPath("votequestion_id", votes, ("session", "number")), "politician": ByPerson("politician_id", people), "politician_membership": ByLast("member_id"),
        "ballot": ByChoice("vote", BALLOTS), "dissent": ByColumn("dissent"),
    }, (F.col("id"),))


def politicians(df: DataFrame, current: DataFrame) -> Resource:
    """`current`: politician_id of everyone in office. Without `include` only they are listed; 'former' lists the others who
    held office (`df` is those), 'all' both."""
    ids = current.select(F.col("politician_id").alias("id"))

    def include(rows: DataFrame, raw: str) -> DataFrame:
        return rows if raw == "all" else rows.join(ids, "id", "left_anti" if raw == "former" else "left_semi")

    filters = {"name": ByColumn("name"), "family_name": ByColumn("name_family"), "given_name": ByColumn("name_given"), "include": ByFunction(include)}
    return Resource(df, filters, (F.col("name_family"), F.col("id")), default_limit=338, always={"include": "current"})


def speeches(df: DataFrame, people: DataFrame, bills: DataFrame, documents: DataFrame, meetings: DataFrame, mentions: DataFrame) -> Resource:
    """`mentions` has statement_id with politician_id or bill_id."""
    key = ("session", "number")
    return Resource(df, {
        "procedural": ByColumn("procedural"), "document": ByDocument(documents, meetings), "politician": ByPerson("politician_id", people),
        "politician_membership": ByLast("member_id"), "time": ByColumn("time", NUMBERS),
        "mentioned_politician": ByBridge(mentions, "statement_id", ByPerson("politician_id", people)),
        "mentioned_bill": ByBridge(mentions, "statement_id", ByPath("bill_id", bills, key)), "bill_debated": ByPath("bill_debated_id", bills, key),
    }, (F.col("document_id"), F.col("sequence"), F.col("id")))


def debates(df: DataFrame) -> Resource:
    return Resource(df, {"session": ByColumn("session"), "date": ByColumn("date", NUMBERS), "number": ByColumn("number")}, (F.desc("date"), F.col("id")))


def committees(df: DataFrame, sessions: DataFrame, current: str) -> Resource:
    """Committees shown and without a parent; `sessions` has committee_id and session. Without a session the current one."""
    top = df.filter(F.col("parent_id").isNull() & F.col("display"))
    return Resource(top, {"session": ByBridge(sessions, "committee_id", ByColumn("session"))}, (F.col("name"), F.col("id")), always={"session": current})


def meetings(df: DataFrame) -> Resource:
    return Resource(df, {
        "number": ByColumn("number", NUMBERS), "session": ByColumn("session"), "date": ByColumn("date", NUMBERS), "in_camera": ByColumn("in_camera"), "committee": ByLast("committee"),
    }, (F.desc("date"), F.col("id")))


# --- rows as JSON ----------------------------------------------------------------------------------------------------------


def _both(name: str) -> Column:
    return F.struct(F.col(f"{name}_en").alias("en"), F.col(f"{name}_fr").alias("fr"))


def _day(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def _labelled(labels: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), c)


def as_json(df: DataFrame, key: str, fields: list[Column]) -> DataFrame:
    """key and the fields as one JSON object, nulls included."""
    return df.select(key, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def politician_fields() -> list[Column]:
    return [F.col("name")]


def politician_detail(people: DataFrame, memberships: DataFrame) -> DataFrame:
    """id, json: a person with all memberships (`membership_fields` as m, with id, politician_id, start_date and end_date), the latest end first,
    open ones before. A person has some memberships, never many."""
    last_first = F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("end_date", F.lit("9999-12-31").cast("date")).alias("e"), "start_date", F.col("id").alias("i"), "m")), asc=False), lambda x: x["m"])
    held = memberships.groupBy(F.col("politician_id").alias("id")).agg(last_first.alias("memberships"))
    gender = F.when(F.col("gender") == "M", "male").when(F.col("gender") == "F", "female").otherwise("")
    fields = [F.col("name"), F.col("name_given").alias("given_name"), F.col("name_family").alias("family_name"), gender.alias("gender"), F.coalesce("memberships", F.array()).alias("memberships")]
    return as_json(people.join(held, "id", "left"), "id", fields)


def membership_fields(detail_of_person: bool = False) -> list[Column]:
    """Fields of a membership joined with its party (party_en, party_short_en) and riding (riding_name, riding_province)."""
    own = [
        tx.role_url(F.col("id")).alias("url"), _day("start_date"), _day("end_date"),
        F.struct(F.struct(F.col("party_en").alias("en")).alias("name"), F.struct(F.col("party_short_en").alias("en")).alias("short_name")).alias("party"),
        F.struct(F.concat(F.col("party_short_en"), F.lit(" MP for "), F.col("riding_name")).alias("en")).alias("label"),
        F.struct(F.struct(F.col("riding_name").alias("en")).alias("name"), F.col("riding_province").alias("province"), F.col("riding_id").alias("id")).alias("riding"),
    ]
    return own if detail_of_person else [*own, F.col("politician_url")]


def document_fields(detail: bool = False) -> list[Column]:
    own = [_day("date"), F.col("number"), F.struct(F.col("most_frequent_word").alias("en")).alias("most_frequent_word")]
    kind = _labelled({"D": "Debate", "E": "Committee Evidence"}, F.col("document_type"))
    return [*own, F.col("source_id"), F.col("source_url"), F.col("session"), kind.alias("document_type")] if detail else own


def statement_fields() -> list[Column]:
    return [
        F.col("time").cast("string").alias("time"), _both("who").alias("attribution"), _both("content").alias("content"), F.col("url"), F.col("politician_url"),
        tx.role_url(F.col("member_id")).alias("politician_membership_url"), F.col("procedural"), F.col("source_id"), tx.above(F.col("url")).alias("document_url"),
    ]


def bill_fields(detail: bool = False) -> list[Column]:
    own = [F.col("session"), F.col("legisinfo_id"), _day("introduced"), _both("name").alias("name"), F.col("number")]
    if not detail:
        return own
    return [
        *own, _both("short_title").alias("short_title"), _labelled({"C": "House", "S": "Senate"}, F.col("institution")).alias("home_chamber"), F.col("law"),
        F.col("sponsor_politician_url"), tx.role_url(F.col("sponsor_member_id")).alias("sponsor_politician_membership_url"), F.col("vote_urls"),
        F.col("privatemember").alias("private_member_bill"), F.col("status_code"), F.struct(F.col("status").alias("en")).alias("status"),
    ]


def vote_fields(detail: bool = False) -> list[Column]:
    own = [
        F.col("bill_url"), F.col("session"), F.col("number"), _day("date"), _both("description").alias("description"), _labelled(RESULTS, F.col("result")).alias("result"),
        F.col("yea_total"), F.col("nay_total"), F.col("paired_total"),
    ]
    return [*own, F.col("party_votes")] if detail else own


def ballot_fields() -> list[Column]:
    return [F.col("vote_url"), F.col("politician_url"), tx.role_url(F.col("member_id")).alias("politician_membership_url"), _labelled(BALLOTS, F.col("vote")).alias("ballot")]


def committee_fields(detail: bool = False) -> list[Column]:
    own = [_both("name").alias("name"), _both("short_name").alias("short_name"), F.col("slug"), F.col("parent_url")]
    return [*own, F.col("sessions"), F.col("subcommittees")] if detail else own


def meeting_fields(detail: bool = False) -> list[Column]:
    own = [_day("date"), F.col("number"), F.col("in_camera"), F.col("evidence_id").isNotNull().alias("has_evidence"), F.concat(F.lit("/committees/"), F.col("committee"), F.lit("/")).alias("committee_url")]
    return [*own, F.col("start_time"), F.col("end_time"), F.col("session")] if detail else own


def wrapped(rows: DataFrame, fields: list[Column]) -> DataFrame:
    """Rows that are lists as the interface gives them: {"content": …} (K7)."""
    return rows.select(F.to_json(F.struct(F.struct(*fields).alias("content")), {"ignoreNullFields": "false"}).alias("json"))
