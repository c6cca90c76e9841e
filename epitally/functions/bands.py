"""Five-year age bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BAND_STARTS = list(range(0, 75, 5))
AGE_LEVELS = [f"{start}-{start + 4}" for start in BAND_STARTS] + ["75+"]
OLD_BANDS = ["75-79", "80-84", "85-89", "90-94", "95-99", "100+"]
POPULATION_BANDS = AGE_LEVELS[:-1] + OLD_BANDS


def age_band(age: Column | str) -> Column:
    """Band label of an age.

    Bounds are closed on whole years, so 4.5 falls in no band. The first band has no lower
    bound and the last no upper one.
    """
    years = F.col(age) if isinstance(age, str) else age
    chain = F.when(years <= 4, F.lit(AGE_LEVELS[0]))
    for start in BAND_STARTS[1:]:
        chain = chain.when((years >= start) & (years <= start + 4), F.lit(f"{start}-{start + 4}"))
    return chain.when(years >= 75, F.lit("75+"))


def band_of_start(start: Column | str) -> Column:
    """Band label from the text of its first year: ``5`` → ``5-9``, ``75`` → ``75+``."""
    text = F.col(start) if isinstance(start, str) else start
    first = text.try_cast("int")
    known = first.isin(BAND_STARTS) & (first.cast("string") == text)
    return (
        F.when(text == "75", F.lit("75+"))
        .when(known, F.concat_ws("-", text, (first + 4).cast("string")))
        .otherwise(text)
    )
