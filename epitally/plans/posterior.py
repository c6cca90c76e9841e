"""Model parameters: prior against posterior draws, parameter table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import ordinal
from ..operators.density import GRID, density
from ..operators.joins import with_labels
from ..operators.quantiles import exact_quantiles
from ..operators.reshape import append
from ..operators.sampling import prior_draws
from ..session import materialize
from ..sources.readers import literal_table

# The parameters, their priors and their labels, in display order.
PRIORS = [
    {"name": "sojourn.compartment_periods_calculated.exposed.total_period",
     "kind": "normal", "mean": 5.5, "sd": 0.97, "lower": 1.0, "label": "Incubation period"},
    {"name": "sojourn.compartment_periods_calculated.active.total_period",
     "kind": "normal", "mean": 6.5, "sd": 0.77, "lower": 4.0, "label": "Duration actively infectious"},
    {"name": "contact_rate",
     "kind": "uniform", "low": 0.02, "high": 0.04, "label": "Infection risk per contact"},
    {"name": "testing_to_detection.assumed_cdr_parameter",
     "kind": "uniform", "low": 0.02, "high": 0.11, "label": "Case detection rate\nat base testing rate"},
    {"name": "mobility.microdistancing.behaviour.parameters.max_effect",
     "kind": "uniform", "low": 0.1, "high": 0.6, "label": "Max MHS effect"},
    {"name": "infectious_seed",
     "kind": "uniform", "low": 10.0, "high": 100.0, "label": "Initial infectious individuals"},
    {"name": "clinical_stratification.props.symptomatic.multiplier",
     "kind": "normal", "mean": 1.0, "sd": 0.2, "lower": 0.5, "label": "Symptomatic proportion\nadjuster for LMIC"},
    {"name": "clinical_stratification.props.hospital.multiplier",
     "kind": "normal", "mean": 1.0, "sd": 0.2, "lower": 0.5, "label": "Hospitalisation \nadjuster for LMIC"},
    {"name": "infection_fatality.multiplier",
     "kind": "normal", "mean": 1.0, "sd": 0.2, "lower": 0.5, "label": "Infection fatality rate\nadjuster for LMIC"},
]
DRAW_TYPES = ["Prior", "Posterior"]


def prior_samples(draws: DataFrame, seed: int, priors: Sequence[Mapping] = PRIORS, anchor: str = "contact_rate",
                  key: str = "draw_id") -> DataFrame:
    """As many draws from each prior as there are posterior draws of the anchor parameter."""
    return prior_draws(draws.where(F.col("name") == anchor).select(key), key, priors, seed)


def prior_and_posterior(draws: DataFrame, region: str, seed: int, priors: Sequence[Mapping] = PRIORS) -> DataFrame:
    """Draws of the listed parameters in one region, and draws from their priors, with labels and order."""
    names = [p["name"] for p in priors]
    posterior = draws.where(F.col("name").isin(names) & (F.col("region") == region))
    both = append(
        posterior.select("name", "value", F.lit("Posterior").alias("type")),
        prior_samples(posterior, seed, priors).select("name", "value", F.lit("Prior").alias("type")),
    )
    rows = [(p["name"], p["label"], i) for i, p in enumerate(priors, start=1)]
    labels = literal_table(draws.sparkSession, rows, "name string, label string, position int")
    return with_labels(both, "name", labels).withColumn("type_position", ordinal("type", DRAW_TYPES))


def prior_posterior_density(draws: DataFrame, region: str, seed: int, priors: Sequence[Mapping] = PRIORS,
                            grid: int = GRID) -> DataFrame:
    """Density of both kinds of draws per parameter, on the range of the two together.

    The draws are passed over three times, so they are made once and written.
    """
    both = prior_and_posterior(draws, region, seed, priors).select("name", "type", "value")
    return density(materialize(both, "draws"), ["name"], ["type"], grid=grid)


def parameter_table(draws: DataFrame, region: str) -> DataFrame:
    """Median and 95 % interval of every parameter; the number of draws has no bound."""
    kept = draws.where(F.col("region") == region)
    return exact_quantiles(kept, ["name"], "value", {0.025: "q025", 0.5: "q50", 0.975: "q975"})
