"""Tags in one form: lower case, mapped, singular."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words with a preferred form that no ending rule gives (fixed values).
PREFERRED = {
    "houses": "house",
    "heated": "heater", "heating": "heater", "cooled": "cooler", "cooling": "cooler", "collected": "collector",
    "collecting": "collector", "powered": "power", "powering": "power", "stored": "storage", "storing": "storage",
    "pumped": "pump", "pumping": "pump", "filtered": "filter", "filtering": "filter", "insulated": "insulation",
    "insulating": "insulation", "installed": "installation", "installing": "installation", "designed": "design",
    "designing": "design", "built": "build", "building": "build", "constructed": "construction",
    "constructing": "construction", "measured": "measurement", "measuring": "measurement", "tested": "test",
    "testing": "test", "calculated": "calculation", "calculating": "calculation", "estimated": "estimate",
    "estimating": "estimate", "improved": "improvement", "improving": "improvement", "upgraded": "upgrade",
    "upgrading": "upgrade", "modified": "modification", "modifying": "modification", "converted": "conversion",
    "converting": "conversion", "connected": "connection", "connecting": "connection", "mounted": "mount",
    "mounting": "mount", "attached": "attachment", "attaching": "attachment", "sealed": "seal", "sealing": "seal",
    "glazed": "glazing", "glazing": "glazing",
    "collection": "collector", "collections": "collector", "home": "house", "residential": "house", "domestic": "house",
    "photovoltaic": "pv", "photovoltaics": "pv", "thermal": "heat", "electric": "electrical", "electricity": "electrical",
    "h2o": "water", "aqua": "water", "sunlight": "solar", "sunshine": "solar", "windmill": "wind", "hydroelectric": "hydro",
    "hydropower": "hydro", "geothermal": "geo", "biomass": "bio", "biofuel": "bio",
}


def normalise(tag: Column) -> Column:
    low = F.trim(F.lower(tag))
    mapped = F.element_at(F.create_map(*map(F.lit, chain.from_iterable(PREFERRED.items()))), low)
    long = F.length(low) > 3
    ies = long & F.endswith(low, F.lit("ies")) & ~low.isin("series", "species")
    es = (F.length(low) > 4) & low.rlike("(s|x|z|ch|sh)es$") & ~F.endswith(low, F.lit("tes"))
    s = long & F.endswith(low, F.lit("s")) & ~low.rlike("(ss|us|is)$")
    ruled = (
        F.when(ies, F.concat(F.left(low, F.length(low) - 3), F.lit("y")))
        .when(es, F.left(low, F.length(low) - 2))
        .when(s, F.left(low, F.length(low) - 1))
        .otherwise(low)
    )
    return F.coalesce(mapped, ruled)


def normalise_all(tags: Column) -> Column:
    """Each tag once, in order of first use; empty ones go."""
    return F.array_distinct(F.filter(F.transform(tags, normalise), lambda t: t.isNotNull() & (t != "")))
