"""Derived and computed properties of bills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of the status codes.
STATUS = {
    "BillNotActive": "Not active",
    "WillNotBeProceededWith": "Dead",
    "RoyalAssentAwaiting": "Awaiting royal assent",
    "BillDefeated": "Defeated",
    "HouseAtReportStage": "Report stage (House)",
    "SenateAtReportStage": "Report stage (Senate)",
    "RoyalAssentGiven": "Law (royal assent given)",
    "SenateAt1stReading": "First reading (Senate)",
    "HouseAt1stReading": "First reading (House)",
    "HouseAtReferralToCommitteeBeforeSecondReading": "Referral to committee before 2nd reading (House)",
    "HouseAt2ndReading": "Second reading (House)",
    "HouseAtReportStageAndSecondReading": "Report stage and second reading (House)",
    "SenateAt2ndReading": "Second reading (Senate)",
    "SenateAt3rdReading": "Third reading (Senate)",
    "HouseAt3rdReading": "Third reading (House)",
    "HouseInCommittee": "In committee (House)",
    "SenateInCommittee": "In committee (Senate)",
    "SenateConsiderationOfCommitteeReport": "Considering committee report (Senate)",
    "HouseConsiderationOfCommitteeReport": "Considering committee report (House)",
    "SenateConsiderationOfAmendments": "Considering amendments (Senate)",
    "HouseConsiderationOfAmendments": "Considering amendments (House)",
    "Introduced": "Introduced",
    "ProForma": "Not a real bill (bills C-1 and S-1 are weird procedural relics)",
    "SenateBillWaitingHouse": "Senate bill, now waiting to be considered in the House",
    "HouseBillWaitingSenate": "Bill passed the House, now waiting to be considered in the Senate",
    "OutsideOrderPrecedence": "Outside the Order of Precedence (a private member's bill that hasn't yet won the draw that determines which private member's bills can be debated)",
    "SenConsideringHouseAmendments": "At consideration in the Senate of amendments made by the House of Commons",
    "HouseConsideringSenAmendments": "At consideration in the House of Commons of amendments made by the Senate",
}
DEAD = ("BillNotActive", "WillNotBeProceededWith", "BillDefeated")


def _or(df: DataFrame, name: str, value: Column) -> Column:
    """The stored value where the column is there and isn't null, else the derived one."""
    return (F.coalesce(F.col(name), value) if name in df.columns else value).alias(name)


def derived(bills: DataFrame) -> DataFrame:
    """`bills` (number, status_code …) with number_only, privatemember, institution and law, where they aren't stored."""
    digits = F.regexp_replace("number", r"\D", "").try_cast("int")
    only = F.coalesce(F.col("number_only"), digits) if "number_only" in bills.columns else digits
    law = F.coalesce(F.col("status_code") == "RoyalAssentGiven", F.lit(False))
    law = (F.coalesce(F.col("law"), F.lit(False)) | law) if "law" in bills.columns else law
    new = ("number_only", "privatemember", "institution", "law")
    return bills.select(*[c for c in bills.columns if c not in new], only.alias("number_only"), _or(bills, "privatemember", only >= 200), _or(bills, "institution", F.left("number", F.lit(1))), law.alias("law"))


def computed(bills: DataFrame, as_of: Column) -> DataFrame:
    """`bills` (status_code, status_date, introduced) with status, dead, dormant (150 days without a change) and latest_date."""
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("status_code"))
    return bills.withColumns({
        "status": F.coalesce(label, F.lit("Unknown")), "dead": F.coalesce(F.col("status_code").isin(*DEAD), F.lit(False)),
        "dormant": F.coalesce(F.datediff(as_of, "status_date") > 150, F.lit(False)), "latest_date": F.coalesce("status_date", "introduced"),
    })
