"""Label columns: taxonomies, tiers, outcomes, regions and ids. All are column expressions; pandas-style nulls are kept with null-safe tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class maps, ambiguous types, country codes and taxonomies.
AMBIGUOUS_TYPES = ("Farm: Mixed", "Farm: Other", "Farm: Unknown", "Farm: PigsOrPoultry")
THREE_CLASS = {"NotFarm": 0, "Farm: Poultry: Meat Chickens": 1, "Farm: Poultry: Eggs": 1, "Farm: Poultry: Unspecified/Other": 1, "Farm: Pigs": 2, "Farm: Cattle": 2}
SEVEN_CLASS = {
    "NotFarm": 0, "Farm: Poultry: Meat Chickens": 1, "Farm: Poultry: Eggs": 2, "Farm: Poultry: Unspecified/Other": 3, "Farm: Pigs": 4, "Farm: Cattle": 5,
    "Farm: Mixed": 6, "Farm: Other": 6, "Farm: Unknown": 6, "Farm: PigsOrPoultry": 6,
}
SEVEN_TO_FIVE = {0: 0, 1: 1, 2: 1, 3: 1, 4: 2, 5: 3, 6: 4}
SEVEN_TO_THREE = {0: 0, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2}
ADM0_KEYS = {
    "USA": "united_states", "BRA": "brazil", "MEX": "mexico", "THA": "thailand", "CHL": "chile", "ARG": "argentina",
    "CAN": "canada", "GBR": "united_kingdom", "AUS": "australia", "DEU": "germany", "ZAF": "south_africa",
}
FACILITY_CATEGORIES = {
    "farm (meat)": ("farm", "farm_meat"), "farm (dairy)": ("farm", "farm_dairy"), "farm (eggs)": ("farm", "farm_eggs"), "farm (wool)": ("farm", "farm_wool"),
    "farm (skins/fur)": ("farm", "farm_fur"), "farm": ("farm", "farm_generic"), "hatchery": ("farm", "hatchery"), "slaughterhouse": ("processing", "slaughterhouse"),
    "rendering plant": ("processing", "rendering_plant"), "saleyard": ("processing", "saleyard"), "depot / holding yard": ("processing", "holding_yard"),
    "live market": ("processing", "live_market"), "experimentation": ("other", "experimentation"), "zoo": ("other", "zoo"), "rodeo": ("other", "rodeo"),
    "wildlife": ("other", "wildlife"), "race training/breeding": ("other", "racing"),
}
TAG_LABELS = {
    "building=farm": ("farm", "farm_generic"), "building=barn": ("farm", "barn"), "building=sty": ("farm", "farm_meat"), "building=cowshed": ("farm", "farm_dairy"),
    "building=farm_auxiliary": ("farm", "farm_auxiliary"), "building=chicken_coop": ("farm", "farm_eggs"), "building=stable": ("farm", "stable"), "building=hatchery": ("farm", "hatchery"),
    "building=greenhouse": ("agricultural", "greenhouse"), "landuse=farmyard": ("farm", "farm_generic"), "landuse=farmland": ("agricultural", "farmland"),
    "industrial=livestock": ("farm", "farm_generic"), "place=farm": ("farm", "farm_generic"), "building=warehouse": ("industrial", "warehouse"),
    "building=industrial": ("industrial", "industrial"), "building=commercial": ("commercial", "commercial"), "building=retail": ("commercial", "retail"),
    "building=office": ("commercial", "office"), "building=church": ("institutional", "church"), "building=school": ("institutional", "school"),
    "building=hospital": ("institutional", "hospital"), "building=hangar": ("industrial", "hangar"), "building=garage": ("residential", "garage"),
    "building=house": ("residential", "house"), "building=residential": ("residential", "residential"), "building=apartments": ("residential", "apartments"),
    "building=shed": ("agricultural", "shed"), "building=yes": ("unknown", "building_unclassified"),
}
SPECIES_ALIASES = {
    "cows/cattle": "cattle", "cows/cattle (unconfirmed)": "cattle", "chickens (unconfirmed)": "chickens", "pigs (unconfirmed)": "pigs",
    "fish/sealife": "fish", "alligators": "reptiles", "crocodiles": "reptiles", "greyhounds": "dogs",
}
SPECIES_KEYWORDS = {
    "Chickens": ("chicken", "poultry", "broiler", "layer", "egg", "hen", "chicken_coop", "hatchery"),
    "Pigs": ("pig", "swine", "pork", "sow", "boar", "sty"), "Cattle": ("cattle", "cow", "beef", "dairy", "buffalo", "cowshed"), "Ducks": ("duck",), "Turkeys": ("turkey",),
}
OSM_FARM_WORDS = "sty|chicken|poultry|cowshed|livestock|animal_breeding|pig|farm"


def _map(values: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(values: Mapping, key: Column) -> Column:
    """The value of a key, null where there is none."""
    return F.element_at(_map(values), key)


# Coordinates, categories, species.
def valid_coords(lat: str = "lat", lng: str = "lng") -> Column:
    return F.col(lat).isNotNull() & F.col(lng).isNotNull() & (F.col(lat) != 0) & (F.col(lng) != 0)


def category_any_of(column: str, names: Sequence[str]) -> Column:
    """Whether the category contains one of the names, in any case; null contains none."""
    text = F.lower(F.coalesce(F.col(column), F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n.lower())) for n in names], F.lit(False))


def species_in(column: str, names: Sequence[str]) -> Column:
    return F.coalesce(F.col(column).isin(list(names)), F.lit(False))


# Regions.
def parse_region(region: str) -> Column:
    """country_key and state of `country` or `country/state`."""
    parts = F.split(F.col(region), "/", 2)
    return F.struct(parts[0].alias("country_key"), F.when(F.size(parts) > 1, parts[1]).alias("state"))


def region_string(country_key: str = "country_key", state: str = "state") -> Column:
    return F.concat_ws("/", F.col(country_key), F.when(F.col(state) != "", F.col(state)))


def filter_regions(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows of a listed region: same country and, where both name a state, the same one. regions: country_key, state (null: the whole country)."""
    wanted = regions.select(F.col("country_key").alias("_key"), F.col("state").alias("_state"))
    free = F.col("_state").isNull() | F.col("state").isNull() | (F.col("state") == "") | (F.col("state") == F.col("_state"))
    return df.join(wanted, (F.col("country_key") == F.col("_key")) & free, "left_semi")


def with_region(df: DataFrame, countries: DataFrame) -> DataFrame:
    """Adds country_key, for the country's display name, and region, `country` or `country/state`; unknown countries get null. countries: country, country_key, one row each."""
    keys = countries.select(F.col("country").alias("_name"), F.col("country_key").alias("_key"))
    named = df.drop("country_key").join(keys, F.col("country") == F.col("_name"), "left").withColumn("country_key", F.col("_key")).drop("_name", "_key")
    return named.withColumn("region", F.when(F.col("country_key").isNotNull(), region_string()))


def all_regions(*lists: Sequence[str] | None) -> list[str]:
    """The regions of all lists, in their order; missing lists have none."""
    return [r for one in lists for r in one or ()]


def labeled_only(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label).cast("int") != -1)


# Cluster labels.
def not_ambiguous(column: str) -> Column:
    return ~F.col(column).eqNullSafe("Ambiguous")


def not_excluded(column: str, names: Sequence[str]) -> Column:
    return F.coalesce(~F.col(column).isin(list(names)), F.lit(True))


def is_osm_farm(original: str = "original_label", standardized: str = "standardized_label") -> Column:
    """An original label that names OSM and is a farm by its standard label, or by its words where that is missing."""
    text = F.coalesce(F.col(original), F.lit(""))
    farm = F.coalesce(F.col(standardized).startswith("Farm"), F.lit(False)) | (F.col(standardized).isNull() & text.rlike(f"(?i){OSM_FARM_WORDS}"))
    return text.rlike("(?i)OSM") & farm


def label_binary(column: str) -> Column:
    c = F.col(column)
    return F.when(c.isNull(), -1).when(c == "NotFarm", 0).otherwise(1)


def label_poultry(column: str) -> Column:
    """1 for every label that contains Poultry, also PigsOrPoultry."""
    c = F.col(column)
    return F.when(c.isNull(), -1).when(c.contains("Poultry"), 1).otherwise(0)


def label_three_class(column: str) -> Column:
    return F.coalesce(lookup(THREE_CLASS, F.col(column)), F.lit(-1))


def label_multiclass(column: str) -> Column:
    return F.coalesce(lookup(SEVEN_CLASS, F.col(column)), F.lit(-1))


def three_way(column: str) -> Column:
    c = F.col(column)
    return F.when(c == "NotFarm", "NotFarm").when(c.contains("Poultry"), "Poultry").when(c.isNotNull(), "OtherFarm")


def collapse(column: Column, classes: Mapping[int, int]) -> Column:
    return F.coalesce(lookup(classes, column), F.lit(-1))


def country_key_of(adm0: str) -> Column:
    """Registry key of a code; the lower-case code where it isn't listed."""
    return F.coalesce(lookup(ADM0_KEYS, F.col(adm0)), F.lower(adm0))


def country_name_of(adm0: str) -> Column:
    """Display name of a code: the key in capitalised words; the code itself where it isn't listed."""
    return F.coalesce(F.initcap(F.replace(lookup(ADM0_KEYS, F.col(adm0)), F.lit("_"), F.lit(" "))), F.col(adm0))


def fill_defaults(df: DataFrame, texts: Sequence[str] = (), flags: Sequence[str] = ()) -> DataFrame:
    """Missing texts become '', missing or boolean flags 0 or 1; columns that aren't there are left out for texts and added for flags."""
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in texts if c in df.columns})
    return out.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in df.columns else F.lit(0) for c in flags})


# Unified taxonomy.
def normalise_species(column: str) -> Column:
    plain = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    return F.coalesce(lookup(SPECIES_ALIASES, plain), plain)


def match_category(column: str) -> Column:
    """(group, label) of a facility category: trimmed, lower-cased, without a closing '(unconfirmed)', first of several."""
    text = F.regexp_replace(F.lower(F.trim(F.col(column))), r"\s*\(unconfirmed\)\s*$", "")
    key = F.trim(F.substring_index(text, ",", 1))
    return F.struct(lookup({k: v[0] for k, v in FACILITY_CATEGORIES.items()}, key).alias("group"), lookup({k: v[1] for k, v in FACILITY_CATEGORIES.items()}, key).alias("label"))


def match_tag(tag: Column) -> Column:
    return F.struct(lookup({k: v[0] for k, v in TAG_LABELS.items()}, tag).alias("group"), lookup({k: v[1] for k, v in TAG_LABELS.items()}, tag).alias("label"))


def first_tag(tags: Column) -> Column:
    """The first `key=value` of a map that the taxonomy knows."""
    known = F.array(*map(F.lit, TAG_LABELS))
    pairs = F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.get(F.filter(pairs, lambda p: F.array_contains(known, p)), F.lit(0))


def unify_label(source: str, category: str, species: str, tags: Column | None = None) -> Column:
    """Struct of group, label, species, is_farm: by facility category, then tags, then the category as a tag, then species; else unknown."""
    kind = normalise_species(species)
    by_category = match_category(category)
    by_tag = match_tag(first_tag(tags)) if tags is not None else F.struct(F.lit(None).cast("string").alias("group"), F.lit(None).cast("string").alias("label"))
    text = F.lower(F.trim(F.col(category)))
    by_text = match_tag(F.when(text.contains("="), text))
    first = F.when(F.col(source).isin("FarmTransparency", "farm_transparency") & by_category["group"].isNotNull(), by_category).when(by_tag["group"].isNotNull(), by_tag).when(by_text["group"].isNotNull(), by_text)
    group = F.coalesce(first["group"], F.when(kind != "", "farm").otherwise("unknown"))
    label = F.coalesce(first["label"], F.when(kind != "", "farm_generic").otherwise("unknown"))
    return F.struct(group.alias("group"), label.alias("label"), kind.alias("species"), (group == "farm").alias("is_farm"))


def parse_tag(column: str) -> Column:
    parts = F.split(F.col(column), "=", 2)
    return F.struct(F.trim(parts[0]).alias("key"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("value"))


def classify_species(name: Column, values: Column | None = None, keywords: Mapping[str, Sequence[str]] = SPECIES_KEYWORDS) -> Column:
    """Struct of category and species: the first species of the list with a keyword in the name or the tag values."""
    text = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), *([F.array_join(values, " ")] if values is not None else [])))
    found = F.coalesce(*[F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), species) for species, words in keywords.items()])
    return F.struct(F.when(found.isNull(), "Farm").otherwise("Farm (meat)").alias("category"), F.coalesce(found, F.lit("Unknown")).alias("species"))


# Scores and ids.
def confidence_tier(score: str, high: float = 0.9, medium: float = 0.7, low: float = 0.5) -> Column:
    s = F.col(score)
    return F.when(s >= high, "high").when(s >= medium, "medium").when(s >= low, "low").otherwise("very_low")


def predict_label(probs: Column, threshold: float = 0.5) -> Column:
    """Struct of label and score: for two classes the second at the threshold, else the most likely one."""
    top = F.array_max(probs)
    two = F.struct((probs[1] >= threshold).cast("int").alias("label"), probs[1].alias("score"))
    return F.when(F.size(probs) == 2, two).otherwise(F.struct((F.array_position(probs, top) - 1).cast("int").alias("label"), top.alias("score")))


def iso_prefix(column: str) -> Column:
    return F.upper(F.substring_index(column, "_", 1))


def state_from_id(column: str) -> Column:
    return F.regexp_extract(column, "_([A-Z]{2})_", 1)


def maps_url(lat: str = "lat", lng: str = "lng") -> Column:
    return F.format_string("https://www.google.com/maps?q=%.6f,%.6f&t=k", lat, lng)
