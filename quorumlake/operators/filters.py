"""The filter algebra of list queries: name[__op]=value pairs over a declared resource."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class BadRequest(ValueError):
    """A filter that is refused: unknown operator, value or page."""


# Spellings of truth values and null in query strings.
_WORDS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None, "null": None}
_TESTS: dict[str, Callable[[Column, object], Column]] = {
    "exact": lambda c, v: c.isNull() if v is None else c == v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
    "iexact": lambda c, v: F.lower(c) == str(v).lower(),
    "contains": lambda c, v: c.contains(v),
    "icontains": lambda c, v: F.lower(c).contains(str(v).lower()),
    "startswith": lambda c, v: c.startswith(v),
    "istartswith": lambda c, v: F.lower(c).startswith(str(v).lower()),
    "endswith": lambda c, v: c.endswith(v),
    "iendswith": lambda c, v: F.lower(c).endswith(str(v).lower()),
}
NUMBERS = ("exact", "gt", "gte", "lt", "lte", "isnull", "range")
STRINGS = ("exact", "iexact", "contains", "icontains", "startswith", "istartswith", "endswith", "iendswith")


@dataclass(frozen=True)
class ByColumn:
    """Filter on a column with the operators allowed; `range=a,b` holds both ends."""

    column: str
    ops: tuple[str, ...] = ("exact",)

    def apply(self, df: DataFrame, op: str, raw: str) -> DataFrame:
        if op not in self.ops:
            raise BadRequest(f"operator {op} isn't allowed here")
        c = F.col(self.column)
        kind = dict(df.dtypes)[self.column]
        if op == "range":
            ends = raw.split(",")
            if len(ends) != 2:
                raise BadRequest("range takes two values")
            return df.filter(c.between(F.lit(ends[0]).try_cast(kind), F.lit(ends[1]).try_cast(kind)))
        v: object = _WORDS.get(raw, raw)
        if op == "isnull" and not isinstance(v, bool):
            v = raw == "1"
        elif isinstance(v, str) and op in NUMBERS and kind != "string":
            v = F.lit(v).try_cast(kind)
        return df.filter(_TESTS[op](c, v))


@dataclass(frozen=True)
class ByChoice:
    """Filter on a coded column that takes the code or its label."""

    column: str
    labels: dict[str, str]

    def apply(self, df: DataFrame, op: str, raw: str) -> DataFrame:
        if op != "exact":
            raise BadRequest("choices take no operator")
        code = raw if raw in self.labels else {v: k for k, v in self.labels.items()}.get(raw)
        if code is None:
            raise BadRequest(f"{raw} is none of {sorted(self.labels)}")
        return df.filter(F.col(self.column) == code)


@dataclass(frozen=True)
class ByPerson:
    """A number is an id, anything else the last part of a path and a slug, looked up in `people` by a semi-join."""

    column: str
    people: DataFrame
    slug: str = "slug"

    def apply(self, df: DataFrame, op: str, raw: str) -> DataFrame:
        last = [p for p in raw.split("/") if p][-1:] or [""]
        if last[0].isdigit():
            return df.filter(F.col(self.column) == int(last[0]))
        ids = self.people.filter(F.col(self.slug) == last[0]).select(F.col("id").alias(self.column))
        return df.join(ids, self.column, "left_semi")


@dataclass(frozen=True)
class ByFunction:
    """Any DataFrame -> DataFrame."""

    run: Callable[[DataFrame, str], DataFrame]

    def apply(self, df: DataFrame, op: str, raw: str) -> DataFrame:
        return self.run(df, raw)


@dataclass(frozen=True)
class Resource:
    """A list resource: base rows, filters by name, order, page sizes."""

    base: DataFrame
    filters: dict[str, object]
    order: tuple[Column, ...]
    default_limit: int = 20
    most: int = 500
    hidden: tuple[str, ...] = field(default=())
    #: Filters that hold where the request doesn't name them.
    always: dict[str, str] = field(default_factory=dict)

    def query(self, params: list[tuple[str, str]] | dict[str, str]) -> DataFrame:
        """The filtered rows. The last of repeated names counts, empty values and unknown names are passed over."""
        df = self.base
        asked = dict(params)
        named = {n.partition("__")[0] for n, raw in asked.items() if raw != ""}
        for name, raw in [*asked.items(), *((k, v) for k, v in self.always.items() if k not in named)]:
            key, _, op = name.partition("__")
            if raw == "" or key not in self.filters:
                continue
            df = self.filters[key].apply(df, op or "exact", raw)
        return df.drop(*self.hidden)

    def page(self, params: dict[str, str]) -> tuple[DataFrame, int, int]:
        """(rows of the page and one more if there is a next page, limit, offset). limit=0 is the default, more than `most`
        is `most`; anything but a whole number from 0 is refused."""
        asked = []
        for name in ("limit", "offset"):
            raw = params.get(name) or "0"
            if not raw.isdigit():
                raise BadRequest(f"{name} must be a whole number")
            asked.append(int(raw))
        limit = min(asked[0] or self.default_limit, self.most)
        rows = self.query({k: v for k, v in params.items() if k not in ("limit", "offset")})
        return rows.orderBy(*self.order).offset(asked[1]).limit(limit + 1), limit, asked[1]
