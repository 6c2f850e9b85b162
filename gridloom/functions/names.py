"""Canonical names, states and kinds: chains of built-in expressions that stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import collapse

# Names and codes of the states of the USA.
STATES = dict(
    pair.rsplit(" ", 1)
    for pair in (
        "alabama AL,alaska AK,arizona AZ,arkansas AR,california CA,colorado CO,connecticut CT,delaware DE,district of columbia DC,florida FL,georgia GA,hawaii HI,idaho ID,illinois IL,indiana IN,iowa IA,kansas KS,kentucky KY,"
        "louisiana LA,maine ME,maryland MD,massachusetts MA,michigan MI,minnesota MN,mississippi MS,missouri MO,montana MT,nebraska NE,nevada NV,new hampshire NH,new jersey NJ,new mexico NM,new york NY,north carolina NC,"
        "north dakota ND,ohio OH,oklahoma OK,oregon OR,pennsylvania PA,rhode island RI,south carolina SC,south dakota SD,tennessee TN,texas TX,utah UT,vermont VT,virginia VA,washington WA,west virginia WV,wisconsin WI,wyoming WY"
    ).split(",")
)
# Words that say nothing about which project is named.
NAME_NOISE = "project solar wind energy center centre storage bess battery farm park facility generating generation station plant llc inc lp phase site hybrid expansion".split()
# Legal forms, and nothing else.
ORG_FORMS = ("llc", "l l c", "inc", "incorporated", "corp", "corporation", "co", "company", "companies", "lp", "l p", "llp", "lllp", "ltd", "limited", "plc", "pllc")
# Plurals of the trade that mean the same as the singular.
ORG_PLURALS = {
    "associates": "associate", "developments": "development", "energies": "energy", "enterprises": "enterprise", "farms": "farm", "fuels": "fuel", "generators": "generator", "holdings": "holding", "industries": "industry",
    "investments": "investment", "operations": "operation", "partners": "partner", "pipelines": "pipeline", "projects": "project", "properties": "property", "renewables": "renewable", "resources": "resource",
    "services": "service", "solutions": "solution", "systems": "system", "technologies": "technology", "turbines": "turbine", "utilities": "utility", "ventures": "venture",
}
# Technologies by ordered patterns, the first that fits wins.
TECHNOLOGIES = (
    (r"liquefied\s*natural\s*gas|\blng\b", "lng_terminal"),
    (r"\bgas\b.*\bpipe\s*-?\s*lines?\b|\bpipe\s*-?\s*lines?\b.*\bgas\b", "gas_pipeline"),
    (r"\bpipe\s*-?\s*lines?\b", "pipeline"),
    (r"carbon\s*(dioxide\s*)?(capture|sequestration|storage)|\bco2\s*(capture|sequestration|storage)|\bccu?s\b", "ccs"),
    (r"pump(ed)?\s*storage", "pumped_storage"),
    (r"solar\s*thermal\s+without\b", "solar_thermal"),
    (r"(solar|photovolt|\bsun\b|\bpv\b).*(storage|batter|\bbat\b)", "solar_storage"),
    (r"(storage|batter|\bbat\b).*(solar|photovolt|\bsun\b|\bpv\b)", "solar_storage"),
    (r"(wind|\bwnd\b).*(storage|batter|\bbat\b)", "wind_storage"),
    (r"(storage|batter|\bbat\b).*(wind|\bwnd\b)", "wind_storage"),
    (r"offshore\s*wind|wind\s*offshore|(?<!than )federal\s*offshore", "wind_offshore"),
    (r"wind|\bwnd\b", "wind"),
    (r"solar\s*thermal", "solar_thermal"),
    (r"solar|photovolt|\bsun\b|\bpv\b", "solar"),
    (r"batter|\bbess\b|energy\s*storage|^storage|\bbat\b|\bstorage\b|flywheel", "storage"),
    (r"nuclear|\bnuc\b", "nuclear"),
    (r"\bcoal\b.*\bgasification\b|\bigcc\b", "coal"),
    (r"steam\s*turbine.*(other than|not part of).*combined", "gas_steam"),
    (r"(combustion|gas)[\s()a-z]*turbine.*(other than|not part of).*combined", "gas_ct"),
    (r"combined[\s-]*cycle|\bcc\b", "gas_cc"),
    (r"(combustion|gas)\s*turbine|\bct\b|\bgt\b", "gas_ct"),
    (r"internal\s*combustion|reciprocating|\bice\b", "gas_ice"),
    (r"geotherm", "geothermal"),
    (r"landfill|biomass|\bwds\b|\blfg\b|biogas|digest|wood", "biomass"),
    (r"municipal\s*solid|waste", "waste"),
    (r"coal|\bbit\b|lignite|\bsub\b", "coal"),
    (r"petroleum|fuel\s*oil|\bdfo\b|diesel|\bjf\b|oil", "oil"),
    (r"fuel\s*cell|\bfc\b", "fuel_cell"),
    (r"hydrogen", "hydrogen"),
    (r"\btidal\b|\bwave\s*(energy|power)\b|marine\s*energy", "marine"),
    (r"hydro|\bwat\b|water", "hydro"),
    (r"steam\s*turbine|\bst\b", "gas_steam"),
    (r"natural\s*gas|methane|dual\s*fuel|\bng\b|^gas|other\s*gases", "gas_other"),
    (r"\bchp\b|combined\s*heat\s*(and|&)\s*power|cogenerat", "chp"),
    (r"reactive\s*(power\s*)?compensat|synchronous\s*condens|\bstatcom\b", "grid_equipment"),
    (r"transmission|\bac\b|\bdc\b|line|cable", "transmission"),
    (r"load|data\s*cent", "load"),
)
# Technologies that are not the plant itself where a compound also has storage.
NOT_FIRM = ("storage", "solar", "solar_thermal", "solar_storage", "wind", "wind_offshore", "wind_storage", "other", "unknown", "transmission", "grid_equipment", "lng_terminal", "gas_pipeline", "pipeline", "ccs", "load")
HYBRID_PARTS = ("solar", "solar_thermal", "solar_storage", "wind", "wind_offshore", "wind_storage")
# Numbers in words after which a name means a phase.
PHASE_WORDS = "one two three four five six seven eight nine ten".split()
# Countries by name.
COUNTRIES = {"united states": "US", "united states of america": "US", "usa": "US", "united kingdom": "GB", "great britain": "GB", "germany": "DE", "deutschland": "DE", "france": "FR", "spain": "ES", "españa": "ES", "canada": "CA", "mexico": "MX"}


def _or_null(text: Column) -> Column:
    return F.nullif(collapse(text), F.lit(""))


def lookup(text: Column, names: Mapping[str, str]) -> Column:
    """The value of a text in a small fixed table, null if it is not there."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), text)


def norm_state(text: Column) -> Column:
    """Two-letter code: as written, by name, or the first two letters of another lone word; null for anything else."""
    t = F.trim(text)
    word = t.rlike(r"^\p{L}+$")
    return F.when(t.rlike(r"^\p{L}{2}$"), F.upper(t)).otherwise(F.coalesce(lookup(F.lower(t), STATES), F.when(word, F.substring(F.upper(t), 1, 2))))


def norm_county(text: Column) -> Column:
    """Upper case without county, parish, borough and punctuation but the slash."""
    t = F.regexp_replace(F.upper(text), r"\bCOUNT(Y|IES)\b|\bPARISH\b|\bBOROUGH\b", " ")
    return _or_null(F.regexp_replace(t, r"[^A-Z0-9/ ]", " "))


def norm_project(text: Column) -> Column:
    """Upper case without brackets, punctuation, roman numerals up to ten and noise words; null if nothing is left."""
    t = F.regexp_replace(F.upper(text), r"\([^)]*\)", " ")
    t = F.regexp_replace(t, r"[^A-Z0-9 ]", " ")
    t = F.regexp_replace(t, r"\b(I{1,3}|IV|V|VI{0,3}|IX|X)\b", " ")
    return _or_null(F.regexp_replace(t, r"\b(" + "|".join(NAME_NOISE).upper() + r")\b", " "))


def norm_organisation(text: Column) -> Column:
    """Organisation key: & as and, co-operative in one spelling, no leading article, legal forms off wherever they
    stand until none is left, plurals of the trade as singulars; null if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), "&", " and "), r"[^a-z0-9 ]", " ")
    t = F.regexp_replace(t, r"\bco[\s-]?operatives?\b|\bco[\s-]?ops?\b", " cooperative ")
    t = F.regexp_replace(F.trim(t), r"^the\s+", "")
    forms = r"\b(" + "|".join(ORG_FORMS) + r")\b"
    # Blanks between the letters of a form may only show once others are gone, so the pass is repeated; a pass that
    # changes nothing is the fixed point, and forms of at most three words need no more than three.
    for _ in range(3):
        t = collapse(F.regexp_replace(t, forms, " "))
    plurals = F.create_map(*[F.lit(x) for kv in ORG_PLURALS.items() for x in kv])
    words = F.transform(F.split(t, " "), lambda w: F.coalesce(F.try_element_at(plurals, w), w))
    return F.nullif(F.upper(F.array_join(words, " ")), F.lit(""))


def organisation_key(text: Column) -> Column:
    """``norm_organisation``, or the trimmed upper-case text itself where that leaves nothing."""
    return F.coalesce(norm_organisation(text), F.upper(F.trim(text)))


def _first(text: Column) -> Column:
    rules = reduce(lambda c, r: c.when(text.rlike(r[0]), r[1]), TECHNOLOGIES[1:], F.when(text.rlike(TECHNOLOGIES[0][0]), TECHNOLOGIES[0][1]))
    return rules.otherwise("other")


def with_technology(df: DataFrame, text: Column, out: str) -> DataFrame:
    """``df`` with the technology of a text; of a compound joined by ; or + that has storage and a firm plant but
    neither sun nor wind, the technology of its firm parts. Nothing stated is ``unknown``.

    Each step is a column of its own, so that the patterns are matched once for a part and once for the whole.
    """
    parts = F.filter(F.transform(F.split(F.trim("_t"), r"\s*;\s*|\s+\+\s+"), F.trim), lambda p: p != "")
    df = df.withColumn("_t", text).withColumn("_parts", parts)
    df = df.withColumn("_classes", F.when(F.size("_parts") > 1, F.transform("_parts", lambda p: F.struct(p.alias("p"), _first(F.lower(p)).alias("t")))))
    df = df.withColumn("_techs", F.transform("_classes", lambda c: c["t"])).withColumn("_firm", F.transform(F.filter("_classes", lambda c: ~c["t"].isin(*NOT_FIRM)), lambda c: c["p"]))
    plant = F.array_contains("_techs", "storage") & (F.size("_firm") > 0) & ~F.arrays_overlap("_techs", F.array(*[F.lit(h) for h in HYBRID_PARTS]))
    df = df.withColumn("_said", F.lower(F.array_join(F.when(F.coalesce(plant, F.lit(False)), F.col("_firm")).otherwise(F.col("_parts")), " + ")))
    df = df.withColumn(out, F.when(F.coalesce(F.trim("_t"), F.lit("")) == "", "unknown").otherwise(_first(F.col("_said"))))
    return df.drop("_t", "_parts", "_classes", "_techs", "_firm", "_said")


def relabelled(kind: Column, fuel: Column, names: Mapping[tuple[str, str], str]) -> Column:
    """The label of a pair of codes in a small fixed table, else the two codes themselves."""
    return F.coalesce(lookup(F.concat_ws("|", kind, fuel), {"|".join(k): v for k, v in names.items()}), F.concat_ws(" ", kind, fuel))


def harmonised(source: str, value: Column, mapping: Mapping[str, str], refine: Sequence[tuple[str, Column, str]] = ()) -> tuple[Column, Column]:
    """(state, rule): the first refining rule (id, condition, state) that holds, else the source's map, else ``unknown``.

    The rule tells which it was: its id, <source>.map, <source>.blank or <source>.unmapped.
    """
    key = F.trim(value)
    mapped = lookup(key, mapping)
    blank = F.coalesce(key, F.lit("")) == ""
    hit = lambda out: reduce(lambda c, r: c.when(F.coalesce(r[1], F.lit(False)), out(r)), refine, F)
    tail = lambda c, a, b, m: c.when(blank, a).when(mapped.isNull(), b).otherwise(m)
    return tail(hit(lambda r: r[2]), "unknown", "unknown", mapped), tail(hit(lambda r: r[0]), f"{source}.blank", f"{source}.unmapped", f"{source}.map")


def phase_numbers(text: Column) -> Column:
    """Sorted phase numbers of a name: figures of one or two digits and roman numerals that are words of their own, and
    numbers in words that end the name."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")
    romans = {r: str(i) for i, r in enumerate("i ii iii iv v vi vii viii ix x".split(), 1)}
    figures = F.transform(words, lambda w: F.coalesce(lookup(w, romans), F.when(w.rlike(r"^\d{1,2}$"), w)).cast("int"))
    last = lookup(F.try_element_at(words, F.lit(-1)), {w: str(i) for i, w in enumerate(PHASE_WORDS, 1)}).cast("int")
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(figures, F.array(last)))))


def lettered_base(text: Column) -> tuple[Column, Column]:
    """(base, letter) of a name that ends in a lone capital that is no roman numeral; null otherwise."""
    fits = text.rlike(r"[A-Za-z0-9)]\s+[A-HJ-UWYZ][\s.)]*$")
    base = collapse(F.regexp_replace(F.lower(F.regexp_replace(text, r"\s+[A-HJ-UWYZ][\s.)]*$", "")), r"[^a-z0-9]+", " "))
    return F.when(fits & (base != ""), base), F.when(fits & (base != ""), F.regexp_extract(text, r"\s([A-HJ-UWYZ])[\s.)]*$", 1))


def word_key(text: Column, generic: Sequence[str], least: int = 1) -> Column:
    """The words of a name that are not ``generic``, sorted and joined; null if none is left."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: (F.length(w) >= least) & ~w.isin(*generic))
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(words)), " "), F.lit(""))


def place_key(text: Column) -> Column:
    """A connection place in upper case without voltages, bus and node numbers and words for the kind of node."""
    t = F.regexp_replace(F.upper(text), r"\b\d+(\.\d+)?(/\d+(\.\d+)?)*\s*-?\s*KV\b", " ")
    t = F.regexp_replace(t, r"\b(BUS|NODE)\s*#?\s*[A-Z0-9]*\d[A-Z0-9]*\b", " ")
    t = F.regexp_replace(t, r"\b(SUBSTATION|SUBSTATIONS|SUB|SWITCHYARD|SWITCHING|STATION|TAP|POI|BUS|NODE|GSP|GRID|SUPPLY|POINT)\b", " ")
    return _or_null(F.regexp_replace(t, r"[^A-Z0-9]+", " "))


def connection_point(text: Column) -> Column:
    """Struct of a stated point of connection: highest kv, bus, the two ends of a tapped line, and its key."""
    kv = F.array_max(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\d+(?:\.\d+)?)\s*-?\s*kv\b"), 1), lambda v: v.cast("double")))
    bus = F.nullif(F.regexp_extract(F.upper(text), r"\bBUS\s*#?\s*([A-Z0-9]*\d[A-Z0-9]*)", 1), F.lit(""))
    line = r"(?i)^\s*(.*?)\s+(?:-|–|to)\s+(.*?)\s+(?:\d+(?:\.\d+)?\s*-?\s*kv\b)?\s*(?:line|circuit|tap)\b.*$"
    a, b = (F.nullif(place_key(F.regexp_extract(text, line, i)), F.lit("")) for i in (1, 2))
    both = a.isNotNull() & b.isNotNull()
    key = F.when(both, F.concat(F.least(a, b), F.lit(" - "), F.greatest(a, b))).otherwise(place_key(text))
    return F.struct(kv.alias("kv"), bus.alias("bus"), F.when(both, F.least(a, b)).alias("end_a"), F.when(both, F.greatest(a, b)).alias("end_b"), key.alias("key"))


def tag_voltages(text: Column) -> Column:
    """Kilovolts of a voltage tag in volts, its values joined by ; or ,; texts that are no positive number are left out."""
    each = F.transform(F.split(text, r"\s*[;,]\s*"), lambda v: F.trim(v).try_cast("double") / 1000)
    return F.array_sort(F.array_distinct(F.filter(each, lambda v: v > 0)))


def codes(text: Column, separator: str = r"[,;/ ]+") -> Column:
    """Distinct upper-case codes of a list, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.upper(text), separator), lambda c: c != "")))


def scheme_codes(text: Column) -> Column:
    """``scheme:code`` for every identifier of a JSON object scheme -> list of codes, sorted."""
    found = F.from_json(text, "map<string, array<string>>")
    each = F.flatten(F.transform(F.map_entries(found), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit(":"), v))))
    return F.array_sort(F.array_distinct(F.array_compact(each)))


def iso2(text: Column) -> Column:
    """Country code of a name or code, null if it is neither."""
    t = F.lower(F.trim(text))
    return F.coalesce(lookup(t, COUNTRIES), F.when(t.rlike("^[a-z]{2}$"), F.upper(t)))


def title_in(titles: Column, languages: Sequence[str]) -> Column:
    """The title of a map language -> title in the first language that has one, else in the first by code."""
    stated = F.map_filter(titles, lambda _, v: v.isNotNull() & (F.trim(v) != ""))
    keys = F.array_sort(F.map_keys(stated))
    return F.coalesce(*[F.try_element_at(stated, F.lit(x)) for x in languages], F.try_element_at(stated, F.try_element_at(keys, F.lit(1))))


def relevance(text: Column, false_friends: Sequence[str], yes: Sequence[tuple[str, str]], no: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(relevant, rule): by the first of the ordered rules that fits once the false friends are out of the text."""
    t = F.lower(text)
    t = F.regexp_replace(t, "|".join(false_friends), " ") if false_friends else t
    rules = [*[(True, n, p) for n, p in yes], *[(False, n, p) for n, p in no]]
    pick = lambda at: reduce(lambda c, r: c.when(t.rlike(r[2]), r[at]), rules, F)
    return F.coalesce(pick(0), F.lit(False)), pick(1)


def looks_like_person(text: Column) -> Column:
    """Whether a party's name reads as a natural person: two to four capitalised words or initials, or Surname, First;
    no figures and no word of a company."""
    word = r"(?:[A-ZÀ-Þ][a-zß-ÿ]+(?:[-'][A-ZÀ-Þ][a-zß-ÿ]+)*|[A-ZÀ-Þ]\.)"
    firm = r"(?i)\b(llc|inc|corp|corporation|company|co|ltd|limited|lp|plc|gmbh|group|energy|power|solar|wind|grid|holdings?|partners|trust|county|city|council|authority|board|department|university|association|cooperative|services?|systems?|society|forum|chamber|union|water|park|farm)\b"
    t = F.trim(text)
    return F.coalesce((t.rlike(rf"^{word}(?: {word}){{1,3}}$") | t.rlike(rf"^{word}, {word}(?: {word}){{0,2}}$")) & ~t.rlike(firm), F.lit(False))


_BASE32 = "0123456789abcdefghjkmnpqrstvwxyz"


def crockford(uuid: Column) -> Column:
    """26 letters of Crockford's base 32 for a UUID text, in order-keeping form; null if it is none."""
    hexes = F.regexp_replace(F.lower(uuid), "-", "")
    bits = F.array_join(F.transform(F.split(hexes, "(?!^)"), lambda h: F.lpad(F.conv(h, 16, 2), 4, "0")), "")
    padded = F.concat(F.lit("00"), bits)
    letters = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.substr(F.lit(_BASE32), F.conv(F.substr(padded, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)))
    return F.when(hexes.rlike("^[0-9a-f]{32}$"), F.array_join(letters, ""))
