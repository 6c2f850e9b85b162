"""Canonical names, states and technologies over the register, the customers and the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import names as nm
from gridloom.registry import Registry
from gridloom.session import table

REG = Registry()


def _register(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "neso_tec_register")


_PROJECT = r"regexp_replace(regexp_replace(regexp_replace(upper({}), '\([^)]*\)', ' ', 'g'), '[^A-Z0-9 ]', ' ', 'g'), '\b(I{{1,3}}|IV|V|VI{{0,3}}|IX|X)\b', ' ', 'g')"
_TIDY = r"nullif(trim(regexp_replace({}, '\s+', ' ', 'g')), '')"
_NOISE = "|".join(nm.NAME_NOISE).upper()


def _project(c: str) -> str:
    return _TIDY.format(rf"regexp_replace({_PROJECT.format(c)}, '\b({_NOISE})\b', ' ', 'g')")


def _organisation(c: str) -> str:
    t = rf"regexp_replace(trim(regexp_replace(regexp_replace(replace(lower({c}), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), '\bco[\s-]?operatives?\b|\bco[\s-]?ops?\b', ' cooperative ', 'g')), '^the\s+', '')"
    for _ in range(3):
        t = rf"trim(regexp_replace(regexp_replace({t}, '\b({'|'.join(nm.ORG_FORMS)})\b', ' ', 'g'), '\s+', ' ', 'g'))"
    plural = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in nm.ORG_PLURALS.items())
    return f"nullif(upper(array_to_string(list_transform(string_split({t}, ' '), lambda w: CASE w {plural} ELSE w END), ' ')), '')"


_CUSTOMER = "CASE row_id % 4 WHEN 0 THEN 'The ' || customer_name || ' & Co-Op, L.L.C.' WHEN 1 THEN customer_name || ' Holdings (Utilities) Inc. Co.' WHEN 2 THEN customer_name ELSE 'LLC, Inc.' END"


@REG.add("norm_name", f"SELECT row_id, {_project('''project_name || CASE row_id % 3 WHEN 0 THEN ' III (Q-12)' WHEN 1 THEN ' Phase 2' ELSE '' END''')} AS name FROM neso_tec_register WHERE project_name IS NOT NULL")
def norm_name(spark: SparkSession, d: str) -> DataFrame:
    """Project names without brackets, numerals and noise words."""
    tail = F.when(F.col("row_id") % 3 == 0, " III (Q-12)").when(F.col("row_id") % 3 == 1, " Phase 2").otherwise("")
    return _register(spark, d).where("project_name is not null").select("row_id", nm.norm_project(F.concat("project_name", tail)).alias("name"))


def _customer() -> F.Column:
    k, name = F.col("row_id") % 4, F.col("customer_name")
    return F.when(k == 0, F.concat(F.lit("The "), name, F.lit(" & Co-Op, L.L.C."))).when(k == 1, F.concat(name, F.lit(" Holdings (Utilities) Inc. Co."))).when(k == 2, name).otherwise("LLC, Inc.")


@REG.add("norm_org_key", f"WITH c AS (SELECT row_id, {_CUSTOMER} AS customer_name FROM neso_tec_register) SELECT row_id, coalesce({_organisation('customer_name')}, upper(trim(customer_name))) AS org FROM c")
def norm_org_key(spark: SparkSession, d: str) -> DataFrame:
    """Organisation keys of the register's customers."""
    return _register(spark, d).select("row_id", nm.organisation_key(_customer()).alias("org"))


@REG.add("organisations_resolved", f"""
WITH c AS (SELECT row_id, snapshot_date, coalesce({_organisation('customer_name')}, upper(trim(customer_name))) AS org, customer_name FROM neso_tec_register WHERE customer_name IS NOT NULL),
n AS (SELECT org, customer_name, count(*) AS n, max(snapshot_date) AS last FROM c GROUP BY 1, 2)
SELECT org, arg_max(customer_name, (n, last, customer_name)) AS canonical, count(*) AS spellings, CAST(sum(n) AS BIGINT) AS records FROM n GROUP BY 1""")
def organisations_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one organisation key merged under the spelling that most records attest."""
    keyed = _register(spark, d).where("customer_name is not null").select(nm.organisation_key(F.col("customer_name")).alias("org"), "customer_name", "snapshot_date")
    spelled = keyed.groupBy("org", "customer_name").agg(F.count(F.lit(1)).alias("n"), F.max("snapshot_date").alias("last"))
    return spelled.groupBy("org").agg(F.max_by("customer_name", F.struct("n", "last", "customer_name")).alias("canonical"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("records"))


def _case(x: str) -> str:
    def test(p: str) -> str:
        if "(?<!than )" in p:  # this dialect has no look-behind
            return f"(regexp_matches({x}, 'offshore\\s*wind|wind\\s*offshore') OR regexp_matches({x}, 'federal\\s*offshore') AND NOT regexp_matches({x}, 'than federal\\s*offshore'))"
        return f"regexp_matches({x}, '{p}')"

    return "CASE " + " ".join(f"WHEN {test(p)} THEN '{t}'" for p, t in nm.TECHNOLOGIES) + " ELSE 'other' END"


_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


@REG.add("classify_plant", rf"""
WITH c AS (SELECT row_id, CASE row_id % 6 WHEN 0 THEN plant_type || ';Battery' WHEN 1 THEN 'Combined Cycle + Storage' WHEN 2 THEN ' ' WHEN 3 THEN 'Steam Turbine other than Combined-Cycle' ELSE plant_type END AS t FROM neso_tec_register),
p AS (SELECT row_id, t, list_filter(list_transform(regexp_split_to_array(trim(t), '\s*;\s*|\s+\+\s+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM c),
k AS (SELECT *, list_transform(parts, lambda x: {_case('lower(x)')}) AS techs FROM p),
f AS (SELECT *, list_filter(parts, lambda x, i: NOT list_contains({_LIST(nm.NOT_FIRM)}, techs[i])) AS firm FROM k),
w AS (SELECT *, lower(array_to_string(CASE WHEN len(parts) > 1 AND list_contains(techs, 'storage') AND len(firm) > 0 AND NOT list_has_any(techs, {_LIST(nm.HYBRID_PARTS)}) THEN firm ELSE parts END, ' + ')) AS said FROM f)
SELECT row_id, CASE WHEN coalesce(trim(t), '') = '' THEN 'unknown' ELSE {_case('said')} END AS technology FROM w""")
def classify_plant(spark: SparkSession, d: str) -> DataFrame:
    """Technologies of plant types, compounds by their firm part."""
    k, kind = F.col("row_id") % 6, F.col("plant_type")
    said = F.when(k == 0, F.concat(kind, F.lit(";Battery"))).when(k == 1, "Combined Cycle + Storage").when(k == 2, " ").when(k == 3, "Steam Turbine other than Combined-Cycle").otherwise(kind)
    return nm.with_technology(_register(spark, d), said, "technology").select("row_id", "technology")


_STATUS = {"Scoping": "announced", "Awaiting Consents": "filed", "Consents Approved": "permitted", "Built": "built"}


@REG.add("harmonised_status", """
WITH c AS (SELECT row_id, trim(project_status) AS s, gate = '2' AS g FROM neso_tec_register)
SELECT row_id, CASE WHEN coalesce(g, false) THEN 'contracted' WHEN coalesce(s, '') = '' THEN 'unknown' ELSE coalesce(MAP {'Scoping': 'announced', 'Awaiting Consents': 'filed', 'Consents Approved': 'permitted', 'Built': 'built'}[s], 'unknown') END AS state,
       CASE WHEN coalesce(g, false) THEN 'tec.gate' WHEN coalesce(s, '') = '' THEN 'tec.blank' WHEN s IN ('Scoping', 'Awaiting Consents', 'Consents Approved', 'Built') THEN 'tec.map' ELSE 'tec.unmapped' END AS rule FROM c""")
def harmonised_status(spark: SparkSession, d: str) -> DataFrame:
    """States of the register's rows and the rule each came by."""
    state, rule = nm.harmonised("tec", F.col("project_status"), _STATUS, [("tec.gate", F.col("gate") == "2", "contracted")])
    return _register(spark, d).select("row_id", state.alias("state"), rule.alias("rule"))


@REG.add("states_and_counties", r"""
WITH c AS (SELECT atlas_id, CASE atlas_id % 5 WHEN 0 THEN ' new york ' WHEN 1 THEN right(state, 2) WHEN 2 THEN 'Ontario' WHEN 3 THEN 'N/A' ELSE lower(right(state, 2)) END AS s, city_a || CASE atlas_id % 3 WHEN 0 THEN ' County' WHEN 1 THEN ' (Parish)' ELSE ' / Borough' END AS k FROM ethanol_atlas)
SELECT atlas_id, CASE WHEN regexp_full_match(trim(s), '\p{L}{2}') THEN upper(trim(s)) WHEN lower(trim(s)) = 'new york' THEN 'NY' WHEN regexp_full_match(trim(s), '\p{L}+') THEN upper(trim(s))[1:2] END AS state,
       nullif(trim(regexp_replace(regexp_replace(regexp_replace(upper(k), '\bCOUNT(Y|IES)\b|\bPARISH\b|\bBOROUGH\b', ' ', 'g'), '[^A-Z0-9/ ]', ' ', 'g'), '\s+', ' ', 'g')), '') AS county FROM c""")
def states_and_counties(spark: SparkSession, d: str) -> DataFrame:
    """Normalised states and counties."""
    k, code = F.col("atlas_id"), F.right("state", F.lit(2))
    state = F.when(k % 5 == 0, " new york ").when(k % 5 == 1, code).when(k % 5 == 2, "Ontario").when(k % 5 == 3, "N/A").otherwise(F.lower(code))
    county = F.concat("city_a", F.when(k % 3 == 0, " County").when(k % 3 == 1, " (Parish)").otherwise(" / Borough"))
    return table(spark, d, "ethanol_atlas").select("atlas_id", nm.norm_state(state).alias("state"), nm.norm_county(county).alias("county"))


@REG.add("phase_numbers", r"""
WITH c AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents WHERE title IS NOT NULL),
n AS (SELECT doc_id, list_concat(list_transform(w, lambda x: CASE WHEN list_position(['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x'], x) > 0 THEN list_position(['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x'], x) WHEN regexp_full_match(x, '\d{1,2}') THEN CAST(x AS INTEGER) END),
      [list_position(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'], w[-1])]) AS n FROM c)
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(n, lambda x: x IS NOT NULL AND x >= 0))), '|'), '') AS phases FROM n""".replace("[list_position(['one'", "[nullif(list_position(['one'").replace("w[-1])]) AS n", "w[-1]), 0)]) AS n"))
def phase_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Phase numbers in titles."""
    phases = F.array_join(F.transform(nm.phase_numbers(F.col("title")), lambda x: x.cast("string")), "|")
    return table(spark, d, "documents").where("title is not null").select("doc_id", phases.alias("phases"))


@REG.add("lettered_bases", r"""
WITH c AS (SELECT project_name || ' ' || substr('ABVI', CAST(row_id % 4 + 1 AS INTEGER), 1) AS p FROM neso_tec_register),
b AS (SELECT trim(regexp_replace(regexp_replace(lower(regexp_replace(p, '\s+[A-HJ-UWYZ][\s.)]*$', '')), '[^a-z0-9]+', ' ', 'g'), '\s+', ' ', 'g')) AS base, regexp_extract(p, '\s([A-HJ-UWYZ])[\s.)]*$', 1) AS letter FROM c WHERE regexp_matches(p, '[A-Za-z0-9)]\s+[A-HJ-UWYZ][\s.)]*$'))
SELECT base, count(DISTINCT letter) AS letters FROM b WHERE base <> '' GROUP BY 1 HAVING count(DISTINCT letter) >= 2""")
def lettered_bases(spark: SparkSession, d: str) -> DataFrame:
    """Base names that occur with two or more letters."""
    name = F.concat("project_name", F.lit(" "), F.substr(F.lit("ABVI"), (F.col("row_id") % 4 + 1).cast("int"), F.lit(1)))
    base, letter = nm.lettered_base(name)
    return _register(spark, d).select(base.alias("base"), letter.alias("letter")).where("base is not null").groupBy("base").agg(F.count_distinct("letter").alias("letters")).where("letters >= 2")


@REG.add("word_keys", r"""
SELECT row_id, nullif(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(project_name), '[^a-z0-9]+'), lambda w: length(w) >= 2 AND NOT list_contains(['park', 'works', 'stage', 'solar', 'wind', 'farm'], w)))), ' '), '') AS key FROM neso_tec_register""")
def word_keys(spark: SparkSession, d: str) -> DataFrame:
    """Identity words of project names, sorted."""
    return _register(spark, d).select("row_id", nm.word_key(F.col("project_name"), ["park", "works", "stage", "solar", "wind", "farm"], 2).alias("key"))


_PLACE = r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(connection_site), '\b\d+(\.\d+)?(/\d+(\.\d+)?)*\s*-?\s*KV\b', ' ', 'g'), '\b(BUS|NODE)\s*#?\s*[A-Z0-9]*\d[A-Z0-9]*\b', ' ', 'g'), '\b(SUBSTATION|SUBSTATIONS|SUB|SWITCHYARD|SWITCHING|STATION|TAP|POI|BUS|NODE|GSP|GRID|SUPPLY|POINT)\b', ' ', 'g'), '[^A-Z0-9]+', ' ', 'g')), '')"


@REG.add("connection_points", rf"""
SELECT row_id, {_PLACE} AS key, list_max(list_transform(regexp_extract_all(lower(connection_site), '(\d+(?:\.\d+)?)\s*-?\s*kv\b', 1), lambda v: CAST(v AS DOUBLE))) AS kv FROM neso_tec_register WHERE connection_site IS NOT NULL""")
def connection_points(spark: SparkSession, d: str) -> DataFrame:
    """Keys and voltages of the stated connection sites."""
    point = nm.connection_point(F.col("connection_site"))
    return _register(spark, d).where("connection_site is not null").select("row_id", point.alias("p")).select("row_id", "p.key", "p.kv")


@REG.add("point_totals", rf"""
WITH c AS (SELECT {_PLACE} AS point, plant_type, try_cast(mw_connected AS DECIMAL(18, 3)) AS mw FROM neso_tec_register WHERE connection_site IS NOT NULL)
SELECT point, plant_type, count(*) AS records, count(mw) AS stated, sum(mw) AS mw FROM c GROUP BY 1, 2""")
def point_totals(spark: SparkSession, d: str) -> DataFrame:
    """Records and capacity by connection point and plant type; nothing stated stays null."""
    rows = _register(spark, d).where("connection_site is not null").select(nm.place_key(F.col("connection_site")).alias("point"), "plant_type", F.col("mw_connected").try_cast("decimal(18,3)").alias("mw"))
    return rows.groupBy("point", "plant_type").agg(F.count(F.lit(1)).alias("records"), F.count("mw").alias("stated"), F.sum("mw").alias("mw"))


@REG.add("relevance_verdict", r"""
WITH t AS (SELECT doc_id, regexp_replace(lower(text), 'power of attorney|wind down|solar plexus', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN regexp_matches(t, '\bwind\b|\bsolar\b|\bbatter') THEN true ELSE false END AS relevant,
       CASE WHEN regexp_matches(t, '\bwind\b|\bsolar\b|\bbatter') THEN 'source' WHEN regexp_matches(t, '\bgeotherm') THEN 'heat' WHEN regexp_matches(t, '\bminutes\b') THEN 'minutes' END AS rule FROM t""".replace("THEN true ELSE false END AS relevant", r"OR regexp_matches(t, '\bgeotherm') THEN true ELSE false END AS relevant"))
def relevance_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whether each text is about energy and by which rule, with false friends removed first."""
    relevant, rule = nm.relevance(F.col("text"), ["power of attorney", "wind down", "solar plexus"], [("source", r"\bwind\b|\bsolar\b|\bbatter"), ("heat", r"\bgeotherm")], [("minutes", r"\bminutes\b")])
    return table(spark, d, "documents").where("text is not null").select("doc_id", relevant.alias("relevant"), rule.alias("rule"))


@REG.add("person_like_filers", r"""
SELECT doc_id, coalesce((regexp_matches(trim(n), '^(?:[A-ZÀ-Þ][a-zß-ÿ]+(?:[-''][A-ZÀ-Þ][a-zß-ÿ]+)*|[A-ZÀ-Þ]\.)(?: (?:[A-ZÀ-Þ][a-zß-ÿ]+(?:[-''][A-ZÀ-Þ][a-zß-ÿ]+)*|[A-ZÀ-Þ]\.)){1,3}$') AND NOT regexp_matches(lower(n), '\b(energy|county|utilities|authority|council|group|llc)\b')) AND NOT regexp_matches(lower(n), '\b(inc|corp|co|ltd|power|solar|wind|grid|holdings?|partners|city|board|department|association|cooperative|services?|systems?|water|park|farm)\b'), false) AS person
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Mary-Ann K. Stone' ELSE replace(filer, 'Utilities', 'Energy') END AS n FROM documents)""")
def person_like_filers(spark: SparkSession, d: str) -> DataFrame:
    """Filers whose name reads as a natural person."""
    name = F.when(F.col("doc_id") % 3 == 0, "Mary-Ann K. Stone").otherwise(F.regexp_replace("filer", "Utilities", "Energy"))
    return table(spark, d, "documents").select("doc_id", nm.looks_like_person(name).alias("person"))


@REG.add("first_positive", """
WITH c AS (SELECT row_id, try_cast(mw_connected AS DOUBLE) AS a, try_cast(mw_increase_decrease AS DOUBLE) AS b, try_cast(stage AS DOUBLE) AS s FROM neso_tec_register)
SELECT row_id, coalesce(CASE WHEN a > 0 AND NOT isnan(a) THEN a END, CASE WHEN b > 0 AND NOT isnan(b) THEN b END, CASE WHEN s > 0 AND NOT isnan(s) THEN s END) AS mw FROM c""")
def first_positive(spark: SparkSession, d: str) -> DataFrame:
    """The first positive number among three text columns."""
    number = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))
    positive = [F.when(number(c) > 0, number(c)) for c in ("mw_connected", "mw_increase_decrease", "stage")]
    return _register(spark, d).select("row_id", F.coalesce(*positive).alias("mw"))


@REG.add("relabelled_parts", "SELECT p_partkey, CASE WHEN p_type = 'SMALL' AND p_brand = 'Brand#11' THEN 'small eleven' WHEN p_type = 'PROMO' AND p_brand = 'Brand#22' THEN 'offer' ELSE p_type || ' ' || p_brand END AS label FROM part")
def relabelled_parts(spark: SparkSession, d: str) -> DataFrame:
    """Labels of pairs of codes."""
    label = nm.relabelled(F.col("p_type"), F.col("p_brand"), {("SMALL", "Brand#11"): "small eleven", ("PROMO", "Brand#22"): "offer"})
    return table(spark, d, "part").select("p_partkey", label.alias("label"))
