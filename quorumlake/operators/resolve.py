"""Who or what a name stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.text import normal_name, slug

# Misspelt slugs of ridings and the right ones.
RIDINGS = {
    "richmond-arthabasca": "richmond-arthabaska", "richemond-arthabaska": "richmond-arthabaska", "battle-river": "westlock-st-paul", "vancouver-est": "vancouver-east",
    "calgary-ouest": "calgary-west", "kitchener-wilmot-wellesley-woolwich": "kitchener-conestoga", "carleton-orleans": "ottawa-orleans", "frazer-valley-west": "fraser-valley-west",
    "laval-ouest": "laval-west", "medecine-hat": "medicine-hat", "lac-st-jean": "lac-saint-jean", "vancouver-north": "north-vancouver", "laval-est": "laval-east",
    "ottawa-ouest-nepean": "ottawa-west-nepean", "cap-breton-highlands-canso": "cape-breton-highlands-canso", "winnipeg-centre-sud": "winnipeg-south-centre",
    "renfrew-nippissing-pembroke": "renfrew-nipissing-pembroke", "the-battleford-meadow-lake": "the-battlefords-meadow-lake", "esquimalt-de-fuca": "esquimalt-juan-de-fuca",
    "sint-hubert": "saint-hubert",
}


def riding_slug(name: Column) -> Column:
    """The slug under which a riding is stored."""
    s = slug(name)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RIDINGS.items() for x in kv]), s), s)


def people_by_name(asked: DataFrame, aliases: DataFrame, held: DataFrame, people: DataFrame, strict: bool = False) -> DataFrame:
    """key, politician_id, stage ('alias', 'surname') and problem ('ambiguous', 'unknown') of every row of `asked`.

    `asked`: key, name, session, riding_id, party_id, where null isn't asked for. `aliases`: politician_id, name; `held`:
    politician_id, session, riding_id, party_id of memberships; `people`: id, name_family. People one of whose names is
    the name asked for, in its normal form, must fit what else is asked for; one of them is the answer, several are an error.
    Without any, and if a session is asked for, the last word of the name is looked up as a family name among the members of
    the session, and of the riding if there is one; several are no answer there, but an error where the riding was given."""
    bare = asked.select("key", normal_name(F.col("name")).alias("_n"), "name", "session", "riding_id", "party_id")
    named = bare.join(aliases.select("politician_id", normal_name(F.col("name")).alias("_n")).distinct(), "_n").drop("_n", "name")
    free = F.col("session").isNull() & F.col("riding_id").isNull() & F.col("party_id").isNull()
    h = held.select("politician_id", F.col("session").alias("_s"), F.col("riding_id").alias("_r"), F.col("party_id").alias("_p")).distinct()
    fits = (F.col("session").isNull() | (F.col("session") == F.col("_s"))) & (F.col("riding_id").isNull() | (F.col("riding_id") == F.col("_r"))) & (F.col("party_id").isNull() | (F.col("party_id") == F.col("_p")))
    fitting = named.filter(~free).join(h, "politician_id").filter(fits).select("key", "politician_id").unionByName(named.filter(free).select("key", "politician_id")).distinct()
    first = fitting.groupBy("key").agg(F.count("*").alias("n"), F.min("politician_id").alias("politician_id"), F.lit("alias").alias("stage"), F.lit(True).alias("_err"))
    if strict:
        second = first.limit(0)
    else:
        last = F.regexp_extract(F.trim("name"), r"\s([A-Z][\w-]+)$", 1)
        rest = bare.filter("session is not null").withColumn("name_family", last).filter("name_family <> ''").join(first.select("key"), "key", "left_anti")
        rest = rest.join(people.select(F.col("id").alias("politician_id"), "name_family"), "name_family").join(h, "politician_id")
        rest = rest.filter((F.col("session") == F.col("_s")) & (F.col("riding_id").isNull() | (F.col("riding_id") == F.col("_r")))).select("key", "politician_id", F.col("riding_id").isNotNull().alias("_err")).distinct()
        second = rest.groupBy("key").agg(F.count("*").alias("n"), F.min("politician_id").alias("politician_id"), F.lit("surname").alias("stage"), F.max("_err").alias("_err"))
    got = first.unionByName(second)
    one = F.col("n") == 1
    problem = F.when(one, F.lit(None)).when((F.col("n") > 1) & F.col("_err"), "ambiguous").otherwise("unknown")
    return asked.select("key").join(got, "key", "left").select("key", F.when(one, F.col("politician_id")).alias("politician_id"), F.when(one | F.col("_err"), F.col("stage")).alias("stage"), problem.alias("problem"))


def candidates_by_name(asked: DataFrame, aliases: DataFrame, ran: DataFrame) -> DataFrame:
    """key, politician_id, problem of candidates (J17). `asked`: key, first, last, province, party_id; `aliases`: politician_id,
    name; `ran`: politician_id, province, party_id of memberships and candidacies. People of the full name, where there are
    none and several given names those of the first one, count if they stood for the same party in the same province; none is
    a new person (null), several are 'ambiguous'."""
    known = aliases.select("politician_id", normal_name(F.col("name")).alias("_n")).distinct()
    stood = ran.select("politician_id", "province", "party_id").distinct()
    full = asked.withColumn("_n", normal_name(F.concat_ws(" ", "first", "last")))
    by_full = full.join(known, "_n")
    short = full.join(by_full.select("key"), "key", "left_anti").filter(F.trim("first").contains(" "))
    short = short.withColumn("_n", normal_name(F.concat_ws(" ", F.split_part(F.trim("first"), F.lit(" "), F.lit(1)), F.col("last")))).join(known, "_n")
    hit = by_full.unionByName(short, allowMissingColumns=True).join(stood, ["politician_id", "province", "party_id"], "left_semi")
    n = hit.groupBy("key").agg(F.countDistinct("politician_id").alias("n"), F.min("politician_id").alias("politician_id"))
    return asked.select("key").join(n, "key", "left").select("key", F.when(F.col("n") == 1, F.col("politician_id")).alias("politician_id"), F.when(F.col("n") > 1, "ambiguous").alias("problem"))
