"""Recoding and the label tables the reports use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Region names in the hospital report → names of the calibration series.
HOSPITAL_REGIONS = {
    "NATIONAL CAPITAL REGION (NCR)": "NCR",
    "REGION IV-A (CALABAR ZON)": "Region_IV_A_Calabarzon",
    "REGION V (BICOL REGION)": "Region_V_Bicol",
    "REGION VII (CENTRAL VISAYAS)": "Region_VII_Central_Visayas",
}

# Region names in the hospital report → names of the weekly series.
HOSPITAL_REGIONS_SHORT = {
    "NATIONAL CAPITAL REGION (NCR)": "manila",
    "REGION IV-A (CALABAR ZON)": "calabarzon",
    "REGION VII (CENTRAL VISAYAS)": "central-visayas",
}

# Region codes of the admission line list.
LINE_LIST_REGIONS = {
    "NCR": "NCR",
    "4A": "Region_IV_A_Calabarzon",
    "5": "Region_V_Bicol",
    "7": "Region_VII_Central_Visayas",
}

# Region codes of the imputed line list.
LINE_LIST_REGIONS_SHORT = {
    "NCR": "manila",
    "4A": "calabarzon",
    "07": "central-visayas",
}

# Region names of the residence line list.
RESIDENCE_REGIONS = {
    "NCR": "NCR",
    "Region IV-A: CALABARZON": "Region_IV_A_Calabarzon",
    "Region V: Bicol Region": "Region_V_Bicol",
    "Region VII: Central Visayas": "Region_VII_Central_Visayas",
}

# Region tags of model runs and of processed series → display names.
MODEL_REGIONS = {
    "covid_19-philippines": "Philippines",
    "covid_19-calabarzon": "Calabarzon",
    "covid_19-central-visayas": "Central Visayas",
    "covid_19-manila": "National Capital Region",
}
SERIES_REGIONS = {
    "philippines": "Philippines",
    "calabarzon": "Calabarzon",
    "central_visayas": "Central Visayas",
    "manila": "National Capital Region",
}

# Indicator names → display names.
INDICATOR_LABELS = {
    "accum_deaths": "Cumulative deaths",
    "icu_occupancy": "ICU occupancy",
    "incidence": "Incidence",
    "proportion_seropositive": "Percentage recovered",
}

# Reported metric, the model output it is compared with, display name.
METRICS = [
    ("notifications", "notifications", "Notifications"),
    ("icu", "prevXlate_activeXclinical_icuXamong", "ICU occupancy"),
    ("deaths", "infection_deathsXall", "Deaths"),
]

# Scenario numbers and their labels, in display order.
SCENARIO_LABELS = {
    0: "Baseline (current\nconditions sustained)",
    2: "50% home workers\nreturn onsite",
    6: "Re-open schools",
    4: "50% reduction MHS",
    3: "70% reduction MHS",
    5: "End MHS",
}

# Mobility columns shown and their labels, in display order.
MOBILITY_LABELS = {
    "residential_percent_change_from_baseline": "Home",
    "workplaces_percent_change_from_baseline": "Work",
    "other": "Other locations",
}

REGION_ORDER = ["Philippines", "Calabarzon", "Central Visayas", "National Capital Region"]


def recode(c: Column | str, mapping: Mapping) -> Column:
    """Mapped values replaced, all others kept."""
    value = F.col(c) if isinstance(c, str) else c
    pairs = [(old, new) for old, new in mapping.items() if old != new]
    if not pairs:
        return value
    chain = F.when(value == F.lit(pairs[0][0]), F.lit(pairs[0][1]))
    for old, new in pairs[1:]:
        chain = chain.when(value == F.lit(old), F.lit(new))
    return chain.otherwise(value)


def ordinal(c: Column | str, levels: Sequence) -> Column:
    """Display position of a label, from 1; null when it is not a level."""
    value = F.col(c) if isinstance(c, str) else c
    chain = F.lit(None).cast("int")
    for position, level in reversed(list(enumerate(levels, start=1))):
        chain = F.when(value == F.lit(level), F.lit(position)).otherwise(chain)
    return chain


def tag(df: DataFrame, **constants) -> DataFrame:
    """Constant columns."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})
