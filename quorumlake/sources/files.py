"""Sources of the records: seed files, election tables, member and bill lists, votes.

Every reader has a fixed schema; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fixtures(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Seed files: a JSON array of {model, pk, fields}; `fields` is the schema of the fields."""
    return spark.read.schema(f"model string, pk string, fields struct<{fields}>").option("multiLine", True).json(path).select("pk", "fields.*")


def jdbc(spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A database table read in `parts` ranges of a numeric key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=options)


def election_results(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated results; only rows that begin with a district number. Validated rows of a district beat preliminary ones."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("c")).filter(F.col("c")[0].rlike("^[0-9]+$"))
    rows = raw.select(
        F.col("c")[0].cast("int").alias("district"), F.trim(F.col("c")[3]).alias("kind"), F.trim(F.col("c")[5]).alias("family"), F.trim(F.col("c")[7]).alias("given"),
        F.trim(F.col("c")[8]).alias("party"), F.expr("try_cast(c[10] as int)").alias("votes"), F.expr("try_cast(c[11] as decimal(5,2))").alias("percent"),
    )
    best = rows.groupBy("district").agg(F.max(F.col("kind") == "validated").alias("_any"))
    return rows.join(best, "district").filter((F.col("kind") == "validated") | ~F.col("_any")).drop("_any")


_MEMBER = """objects array<struct<name: string, party_name: string, district_name: string, email: string, personal_url: string,
  offices: array<struct<type: string, tel: string, fax: string, postal: string>>>>"""


def members_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per member and office; members without an office have one row."""
    schema = _MEMBER
    got = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("objects").alias("m")).select("m.*")
    return got.select("name", "party_name", "district_name", "email", "personal_url", F.explode_outer("offices").alias("office")).select("*", "office.*").drop("office")


def ridings_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "objects array<struct<external_id: string, metadata: struct<ED_NAMEE: string, ED_NAMEF: string, PROVCODE: string>>>"
    got = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("objects").alias("r"))
    return got.select(
        F.col("r.external_id").cast("int").alias("edid"), F.col("r.metadata.ED_NAMEE").alias("name_en"), F.col("r.metadata.ED_NAMEF").alias("name_fr"), F.col("r.metadata.PROVCODE").alias("province")
    )


def votes_xml(spark: SparkSession, path: str) -> DataFrame:
    """Recorded divisions; results as Y, N, T."""
    schema = """DecisionDivisionNumber int, ParliamentNumber int, SessionNumber int, DecisionEventDateTime string, DecisionDivisionNumberOfYeas int,
      DecisionDivisionNumberOfNays int, DecisionDivisionNumberOfPaired int, DecisionResultName string, BillNumberCode string, DecisionDivisionSubject string"""
    v = spark.read.format("xml").option("rowTag", "Vote").schema(schema).load(path)
    name = F.col("DecisionResultName")
    result = F.when(name.startswith("Agreed"), "Y").when(name.startswith("Negatived"), "N").when(name == "Tie", "T")
    return v.select(
        F.concat_ws("-", "ParliamentNumber", "SessionNumber").alias("session_id"), F.col("DecisionDivisionNumber").alias("number"),
        F.to_date(F.substring("DecisionEventDateTime", 1, 10)).alias("date"), F.col("DecisionDivisionNumberOfYeas").alias("yea_total"),
        F.col("DecisionDivisionNumberOfNays").alias("nay_total"), F.col("DecisionDivisionNumberOfPaired").alias("paired_total"),
        result.alias("result"), F.nullif(F.col("BillNumberCode"), F.lit("")).alias("bill"), F.col("DecisionDivisionSubject").alias("description"),
    )


def ballots_xml(spark: SparkSession, path: str) -> DataFrame:
    p = spark.read.format("xml").option("rowTag", "VoteParticipant").schema("PersonId long, ConstituencyName string, IsVoteYea string, IsVoteNay string, IsVotePaired string").load(path)
    yes = lambda c: F.lower(F.trim(c)) == "true"
    # Paired goes before the side on which the pair was recorded.
    vote = F.when(yes("IsVotePaired"), "P").when(yes("IsVoteYea"), "Y").when(yes("IsVoteNay"), "N")
    return p.select(F.col("PersonId").alias("person_id"), F.col("ConstituencyName").alias("riding"), vote.alias("vote"))


_BILL = """Id long, NumberCode string, LongTitleEn string, LongTitleFr string, ShortTitleEn string, ShortTitleFr string, SponsorPersonId long, StatusName string,
  PassedHouseFirstReadingDateTime string, PassedSenateFirstReadingDateTime string, LatestBillEventDateTime string, Publications array<struct<PublicationId: long>>,
  SimilarBills array<struct<Id: long, NumberCode: string, ParliamentNumber: int>>"""


def bills_json(spark: SparkSession, path: str) -> DataFrame:
    """Bills with derived columns: first reading is the earlier of the two houses', the text the last publication's."""
    b = spark.read.schema(_BILL).option("multiLine", True).json(path)
    day = lambda c: F.to_date(F.left(F.col(c), F.lit(10)))
    return b.select(
        F.col("Id").alias("legisinfo_id"), F.col("NumberCode").alias("number"), F.substring("NumberCode", 1, 1).alias("institution"),
        F.expr("try_cast(regexp_replace(NumberCode, '[^0-9]', '') as int)").alias("number_only"),
        (F.expr("try_cast(regexp_replace(NumberCode, '[^0-9]', '') as int)") >= 200).alias("privatemember"),
        F.col("LongTitleEn").alias("name_en"), F.col("LongTitleFr").alias("name_fr"), F.col("ShortTitleEn").alias("short_title_en"), F.col("StatusName").alias("status"),
        (F.col("StatusName") == "Royal assent received").alias("law"), F.least(day("PassedHouseFirstReadingDateTime"), day("PassedSenateFirstReadingDateTime")).alias("introduced"),
        day("LatestBillEventDateTime").alias("status_date"), F.try_element_at("Publications.PublicationId", F.lit(-1)).alias("text_docid"), "SimilarBills",
    )


def similar_bills(bills: DataFrame) -> DataFrame:
    """Links between bills in both directions, each once."""
    one = bills.select(F.col("legisinfo_id").alias("a"), F.explode("SimilarBills.Id").alias("b"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()


_STAGES = "HouseBillStages array<struct<ParliamentNumber: int, SessionNumber: int, CommitteeMeetings: array<struct<CommitteeAcronym: string, Number: int>>>>"


def committee_meetings(bills: DataFrame, key: str, stages: str) -> DataFrame:
    """key, session_id, acronym, number: the meetings of the first stage that has any, of its first meeting's committee."""
    s = bills.select(key, F.filter(F.from_json(stages, _STAGES)["HouseBillStages"], lambda x: F.size(x["CommitteeMeetings"]) > 0).alias("s"))
    first = s.filter(F.size("s") > 0).select(key, F.col("s")[0].alias("s"))
    every = first.select(key, F.concat_ws("-", "s.ParliamentNumber", "s.SessionNumber").alias("session_id"), F.col("s.CommitteeMeetings")[0]["CommitteeAcronym"].alias("acronym"), F.explode("s.CommitteeMeetings").alias("m"))
    return every.filter("m.CommitteeAcronym = acronym").select(key, "session_id", "acronym", F.col("m.Number").alias("number"))
