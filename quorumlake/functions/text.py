"""Text functions as Column expressions; pandas UDFs only where Spark has no Unicode normalisation or the rule is a parser."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters with marks and their plain letters (the Latin-1 and Latin Extended-A range used in both languages).
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def plain_letters(c: Column) -> Column:
    """Without accents, for the letters of ACCENTED; stays in generated code."""
    return F.translate(c, ACCENTED, PLAIN)


@F.pandas_udf(T.StringType())
def remove_accents(s: pd.Series) -> pd.Series:
    """Without accents for any script: canonical decomposition without combining marks. Null stays null."""
    return s.map(lambda x: None if x is None else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)))


def tame_space(c: Column) -> Column:
    """Runs of any white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def slug(c: Column, digits: bool = False) -> Column:
    """Lower-case letters (and digits) with single hyphens between; hyphens at the ends stay."""
    return F.regexp_replace(F.lower(plain_letters(c)), "[^a-z0-9]+" if digits else "[^a-z]+", "-")


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "‘’“”", "''\"\"")


def without_honorific(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?:Right Hon\.|Hon\.|Mr\.|Mrs\.|Ms\.|Miss|Dr\.|Mme|M\.) +", "")


def normal_name(c: Column) -> Column:
    """Form in which names are compared."""
    return straight_quotes(tame_space(plain_letters(F.lower(without_honorific(c)))))


def words_of(c: Column) -> Column:
    """Tokens as the language models count them: lower case, only word characters, apostrophes and hyphens kept, split at
    blanks and em dashes; empty tokens at a leading blank or dash are kept."""
    clean = F.regexp_replace(F.lower(c), r"[^\s\p{L}\p{N}_'’—-]", "")
    return F.split(clean, r"(?U)[\s—]+")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by blanks; none in shorter arrays. Shifted copies are zipped, so the tokens are made a fixed
    number of times per row and not once per run."""
    many = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    out = F.slice(tokens, F.lit(1), many)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(tokens, F.lit(k), many), lambda a, b: F.concat_ws(" ", a, b))
    return out


def html_text(c: Column) -> Column:
    """Plain text of simple HTML: line feeds dropped, breaks as line feeds, paragraphs as blank lines, tags dropped."""
    x = F.replace(c, F.lit("\n"), F.lit(""))
    x = F.regexp_replace(x, r"<br ?/?>", "\n")
    x = F.replace(x, F.lit("</p>"), F.lit("\n\n"))
    x = F.replace(F.regexp_replace(x, "<[^>]*>", ""), F.lit("&amp;"), F.lit("&"))
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def paragraphs(c: Column) -> Column:
    """array<struct<pid, original, body>> of <p data-HoCid=… data-originallang=…>…</p>."""
    found = F.regexp_extract_all(c, F.lit(r"(?s)(<p[^>]*>.*?</p>)"), 1)
    return F.transform(
        found,
        lambda p: F.struct(
            F.nullif(F.regexp_extract(p, r'data-HoCid="(\d+)"', 1), F.lit("")).alias("pid"),
            F.nullif(F.regexp_extract(p, r'data-originallang="(\w+)"', 1), F.lit("")).alias("original"),
            F.regexp_extract(p, r"(?s)<p[^>]*>(.*)</p>", 1).alias("body"),
        ),
    )


def word_count(c: Column) -> Column:
    """Words between white space; none in an empty text."""
    t = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def english_list(items: Column, by: str = ", ") -> Column:
    """'', 'a', 'a and b'; of three and more all but the last are followed by `by`, which stands before ' and ' too."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), by)
    last = F.try_element_at(items, F.lit(-1))
    return F.when(n == 0, "").when(n == 1, last).when(n == 2, F.concat(head, F.lit(" and "), last)).otherwise(F.concat(head, F.lit(by + " and "), last))


def shorten(c: Column, most: int, keep: int) -> Column:
    return F.when(F.length(c) >= most, F.concat(F.left(c, F.lit(keep)), F.lit("…"))).otherwise(c)


def first_words(c: Column, n: int) -> Column:
    w = F.split(c, " ")
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("…"))).otherwise(c)


def person_parts(who: Column) -> Column:
    """struct<display, post> of a speaker label: 'Hon. A B (Minister of C, D)' or 'The Speaker (Hon. A B)'."""
    inner = F.nullif(F.regexp_extract(who, r"\(([^)]*)\)", 1), F.lit(""))
    outer = F.trim(F.regexp_replace(who, r" ?\([^)]*\)?", ""))
    office = outer.rlike(r"^(The|An?|Some) ")
    return F.struct(
        F.when(office & inner.isNotNull(), without_honorific(inner)).otherwise(without_honorific(outer)).alias("display"),
        F.when(office, outer).otherwise(inner).alias("post"),
    )


def postcode(c: Column) -> Column:
    x = F.upper(c)
    pat = r"^\s*([A-Z]\d[A-Z])\s*(\d[A-Z]\d)\s*$"
    return F.when(x.rlike(pat), F.concat(F.regexp_extract(x, pat, 1), F.regexp_extract(x, pat, 2)))


def session_id(c: Column) -> Column:
    """'41st Parliament, 1st Session' -> '41-1'."""
    pat = r"(\d+)\w* Parliament,\s*(\d+)\w* Session"
    return F.when(c.rlike(pat), F.concat_ws("-", F.regexp_extract(c, pat, 1), F.regexp_extract(c, pat, 2)))


def guid(c: Column) -> Column:
    """Longer identifiers by their hash."""
    return F.when(F.length(c) > 50, F.sha1(c)).otherwise(c)


def markdown_links(c: Column) -> Column:
    x = F.regexp_replace(c, r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>')
    return F.regexp_replace(x, r"\*\*([^*]+)\*\*", "<strong>$1</strong>")


def strip_markdown_links(c: Column) -> Column:
    return F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")


# The digits of the identifier alphabet, and the sign.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


def int64_to_text(n: int) -> str:
    sign, n = ("$", -n) if n < 0 else ("", n)
    out = ""
    while True:
        n, r = divmod(n, 64)
        out = DIGITS[r] + out
        if not n:
            return sign + out


def text_to_int64(s: str) -> int:
    sign, s = (-1, s[1:]) if s.startswith("$") else (1, s)
    n = 0
    for ch in s:
        n = n * 64 + DIGITS.index(ch)
    return sign * n


@F.pandas_udf(T.StringType())
def encode_id(s: pd.Series) -> pd.Series:
    return s.map(lambda n: None if n is None or n != n else int64_to_text(int(n)))


@F.pandas_udf(T.LongType())
def decode_id(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else text_to_int64(t)).astype("Int64")


@F.pandas_udf(T.StringType())
def strip_tags(s: pd.Series) -> pd.Series:
    """Tags dropped and entities resolved by a parser, for HTML that patterns can't take."""
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.parts: list[str] = []

        def handle_data(self, data: str) -> None:
            self.parts.append(data)

    def run(x: str | None) -> str | None:
        if x is None:
            return None
        p = Text()
        p.feed(x)
        p.close()
        return "".join(p.parts)

    return s.map(run)


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def highlight(c: Column, term: str) -> Column:
    """Whole words that begin with the term, marked."""
    return F.regexp_replace(c, rf"(?i)\b({re.escape(term)}\w*)", "<em>$1</em>")


# --- names, lists and phrases as pages show them -------------------------------------------------------------------------


def title_case(c: Column) -> Column:
    """Every run of letters with a capital in front and small letters after it, so also after apostrophes and hyphens."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1 << 30)))), "")


def title_if_necessary(c: Column) -> Column:
    """Title case where there is no small letter of the plain alphabet; anything else stays."""
    return F.when(c.rlike("[a-z]"), c).otherwise(title_case(c))


def smart_title(c: Column) -> Column:
    """Title case where all letters are capitals or all are small."""
    return F.when((F.upper(c) != F.lower(c)) & ((F.upper(c) == c) | (F.lower(c) == c)), title_case(c)).otherwise(c)


def without_parens(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\(.+\)\s*", "")


# How a label of someone without a name begins, in both languages.
OFFICES = r"^(?:The\s(?:Speaker|Chair|Deputy|Acting)|Le\sprésident|An\s[hH]on\.?\s|Une\svoix|Des\svoix|Some\s[hH]on\.\s|Acting\s|Assistant\s)"


def is_office(c: Column) -> Column:
    """Whether a speaker's label names an office or a crowd and no person."""
    return c.rlike(OFFICES)


def list_prefix(items: Column, prefix: str) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit(prefix), x))


def list_filter(items: Column, value: Column) -> Column:
    return F.filter(items, lambda x: x != value)


def strip_act(c: Column) -> Column:
    """A bill's name without 'An Act (to)' in front, the next letter a capital, and without ' Act' at the end."""
    pat = r"(?s)^(.*?)An Act (?:to )?([a-z])(.*)$"
    part = lambda k: F.regexp_extract(c, pat, k)
    return F.regexp_replace(F.when(c.rlike(pat), F.concat(part(1), F.upper(part(2)), part(3))).otherwise(c), " Act$", "")


def friendly_minutes(minutes: Column) -> Column:
    """'45 minutes', beyond that whole hours, half hours to the even one."""
    hours = F.bround(minutes / 60).cast("int")
    return F.when(minutes <= 45, F.concat(minutes.cast("string"), F.lit(" minutes"))).when(hours == 1, "1 hour").otherwise(F.concat(hours.cast("string"), F.lit(" hours")))


def month_name(month: Column) -> Column:
    return F.date_format(F.make_date(F.lit(2010), month, F.lit(1)), "MMMM")


# The words for a person by gender; the rest is for any other value.
PRONOUNS = {"subject": ("She", "He", "He/she"), "possessive": ("Her", "His", "Their"), "object": ("Her", "Him", "Them"), "title": ("Ms.", "Mr.", "Mr./Ms.")}
# The first two digits of an electoral district's number, and the provinces' names.
DISTRICTS = {"10": "NL", "11": "PE", "12": "NS", "13": "NB", "24": "QC", "35": "ON", "46": "MB", "47": "SK", "48": "AB", "59": "BC", "60": "YT", "61": "NT", "62": "NU"}
PROVINCES = {"AB": "Alberta", "BC": "British Columbia", "SK": "Saskatchewan", "MB": "Manitoba", "ON": "Ontario", "QC": "Québec", "NB": "New Brunswick", "NS": "Nova Scotia",
             "PE": "Prince Edward Island", "NL": "Newfoundland & Labrador", "YT": "Yukon", "NT": "Northwest Territories", "NU": "Nunavut"}


def _looked_up(values: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def pronoun(kind: str, gender: Column) -> Column:
    f, m, other = PRONOUNS[kind]
    return F.when(gender == "F", f).when(gender == "M", m).otherwise(other)


def district_province(edid: Column) -> Column:
    """The province of an electoral district by its number; null for none."""
    return _looked_up(DISTRICTS, F.left(edid.cast("string"), F.lit(2)))


def province_name(code: Column) -> Column:
    return _looked_up(PROVINCES, code)


# --- values as other systems write them --------------------------------------------------------------------------------


def munge_date(c: Column) -> Column:
    """Null for an empty date and for one with 0000 in it."""
    return F.when((c == "") | (c == "&nbsp;") | c.contains("0000"), F.lit(None)).otherwise(c)


def munge_decimal(c: Column) -> Column:
    """A number with commas; 0 for anything else."""
    return F.coalesce(F.replace(c, F.lit(","), F.lit("")).try_cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)"))


def munge_int(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "").try_cast("bigint")


def munge_time(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d\d:\d\d:\d\d)", 1), F.lit(""))


def munge_postcode(c: Column) -> Column:
    """A postal code in capitals with its blank; null for none."""
    x = F.upper(c)
    x = F.when(F.length(x) == 6, F.concat(F.left(x, F.lit(3)), F.lit(" "), F.right(x, F.lit(3)))).otherwise(x)
    return F.when(x.rlike(r"^[ABCEGHJKLMNPRSTVXYZ]\d[A-Z] \d[A-Z]\d$"), x)


def escaped(c: Column, quotes: bool = False) -> Column:
    """&, < and > as entities, and quotation marks where they stand in an attribute."""
    x = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) + ((('"', "&quot;"),) if quotes else ()):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def tag(name: str, attributes: Column) -> Column:
    """An opening tag with the entries of a map as attributes, sorted by name; entries without a value are left out."""
    known = F.filter(F.sort_array(F.map_entries(attributes)), lambda e: e["value"].isNotNull())
    each = F.transform(known, lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escaped(e["value"], True), F.lit('"')))
    return F.concat(F.lit(f"<{name}"), F.array_join(each, ""), F.lit(">"))


def floor_text(en: Column, fr: Column) -> Column:
    """Line by line the language spoken (F13): the French line where the English one is marked French. English where there is
    no French or the numbers of lines differ. A mark at the very start of a line doesn't count, and a line without any mark is
    asked at the place where one would end."""
    mark = 'data-originallang="'
    e, f = F.split(en, "\n"), F.split(fr, "\n")

    def pick(x: Column, y: Column) -> Column:
        at = F.instr(x, mark)
        return F.when((at != 1) & (F.substr(x, at + 19, F.lit(2)) == "fr"), y).otherwise(x)

    return F.when((F.coalesce(fr, F.lit("")) == "") | (F.size(e) != F.size(f)), en).otherwise(F.array_join(F.zip_with(e, f, pick), "\n"))


def shared_text(description: Column, url: Column, plug: str) -> Column:
    """A message of at most 140 characters: description, the plug where there is room, and the link."""
    n = F.length(description) + F.length(url)
    text = F.when(n > 139, F.concat(F.substr(description, F.lit(1), F.lit(136) - F.length(url)), F.lit("..."))).when(
        n + len(plug) < 140, F.concat(description, F.lit(plug))
    )
    return F.concat(F.coalesce(text, description), F.lit(" "), url)


def bill_title(name: Column, short: Column) -> Column:
    """The name, or where it has 150 characters and more the short title, else its beginning."""
    return F.when(F.length(name) >= 150, F.coalesce(F.nullif(short, F.lit("")), F.concat(F.left(name, F.lit(140)), F.lit("…")))).otherwise(name)


def mc_names(c: Column) -> Column:
    """'Mcdonald' as 'McDonald' (F36)."""
    runs = F.regexp_extract_all(c, F.lit(r"(\bMc\p{Ll}\p{L}*|(?s).)"), 1)
    big = lambda x: F.concat(F.lit("Mc"), F.upper(F.substring(x, 3, 1)), F.substring(x, 4, 1 << 30))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^Mc\p{Ll}"), big(x)).otherwise(x)), "")


# --- addresses ------------------------------------------------------------------------------------------------------------


def debate_url(day: Column) -> Column:
    return F.concat_ws("/", F.lit("/debates"), F.year(day).cast("string"), F.month(day).cast("string"), F.dayofmonth(day).cast("string"), F.lit(""))


def meeting_url(committee: Column, session: Column, number: Column) -> Column:
    return F.concat_ws("/", F.lit("/committees"), committee, session, number.cast("string"), F.lit(""))


def bill_url(session: Column, number: Column) -> Column:
    return F.concat_ws("/", F.lit("/bills"), session, number.cast("string"), F.lit(""))


def vote_url(session: Column, number: Column) -> Column:
    return F.concat_ws("/", F.lit("/votes"), session, number.cast("string"), F.lit(""))


def person_url(slug: Column, number: Column) -> Column:
    return F.concat_ws("/", F.lit("/politicians"), F.coalesce(F.nullif(slug, F.lit("")), number.cast("string")), F.lit(""))


def role_url(member: Column) -> Column:
    """Null for no membership."""
    return F.when(member.isNotNull(), F.concat_ws("/", F.lit("/politicians/roles"), member.cast("string"), F.lit("")))


def above(url: Column) -> Column:
    """An address without its last part: a statement's document."""
    return F.regexp_replace(url, "[^/]+/$", "")


def marked(c: Column, term: str, on: str = "~hl~", off: str = "~/hl~") -> Column:
    """Whole words that begin with the term between the marks of a search engine."""
    return F.regexp_replace(c, rf"(?i)\b({re.escape(term)}\w*)", f"{on}$1{off}")


def autohighlight(c: Column, plain: bool = True) -> Column:
    """A marked snippet as HTML (F19): everything else is escaped where the text is plain, the marks become emphasis."""
    return F.regexp_replace(escaped(c) if plain else c, "~(/?)hl~", "<$1em>")
