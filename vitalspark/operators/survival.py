"""Real-world overall survival and Kaplan-Meier estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.functions import dates

#: Fixed value: normal quantile of a 95 % interval.
Z_95 = 1.959963984540054
#: Months at which the plot counts who is at risk.
AT_RISK_MONTHS = (0, 6, 12, 18, 24, 36, 48)


def survival_records(patients: DataFrame) -> DataFrame:
    """patient_id, index_date, event_date, os_days, event, vital_status, index_date_precision, index_date_assumed, age_at_index.

    patients: patient_id, advanced_diagnosis_date, vital_status, date_of_death, last_known_alive_date, age_at_advanced_diagnosis as text.
    A death without a date is censored when last known alive; without an index or end date there is no record; no time is negative.
    """
    index = dates.parse_partial_date(F.col("advanced_diagnosis_date"))
    vital = F.lower(F.coalesce(F.nullif(F.col("vital_status"), F.lit("")), F.lit("unknown")))
    death, alive = dates.resolve_date(F.col("date_of_death")), dates.resolve_date(F.col("last_known_alive_date"))
    dead = (vital == "deceased") & death.isNotNull()
    rows = patients.select("patient_id", index.alias("i"), vital.alias("vital_status"), F.when(dead, death).otherwise(alive).alias("end"), dead.cast("int").alias("event"), F.col("age_at_advanced_diagnosis").try_cast("double").try_cast("int").alias("age_at_index"))
    rows = rows.where("i.date IS NOT NULL AND end IS NOT NULL")
    return rows.select(
        "patient_id", F.col("i.date").alias("index_date"), F.greatest("end", "i.date").alias("event_date"), F.greatest(F.datediff("end", "i.date"), F.lit(0)).alias("os_days"), "event", "vital_status",
        F.col("i.precision").alias("index_date_precision"), F.col("i.assumed").alias("index_date_assumed"), "age_at_index",
    )


def survival_mart(patients: DataFrame) -> DataFrame:
    """The warehouse's variant: dates resolved by length, vital status compared as it is spelt, months added."""
    index, death, alive = (dates.resolve_date_by_length(F.col(c)) for c in ("advanced_diagnosis_date", "date_of_death", "last_known_alive_date"))
    observed = F.coalesce((F.col("vital_status") == "deceased") & death.isNotNull(), F.lit(False))
    rows = patients.select("patient_id", "vital_status", index.alias("index_date"), F.when(observed, death).otherwise(alive).alias("event_date"), observed.alias("event_observed"), F.col("age_at_advanced_diagnosis").try_cast("int").alias("age_at_index"))
    days = F.greatest(F.datediff("event_date", "index_date"), F.lit(0))
    return rows.where("index_date IS NOT NULL AND event_date IS NOT NULL").select("*", F.col("event_observed").cast("int").alias("event"), days.alias("os_days"), dates.months(days).alias("rwos_months"))


def plot_records(patients: DataFrame) -> DataFrame:
    """The plot's variant: every death is an event, months are 30.44 days, a bare month counts from its first day, and the data cut-off stands in for a missing last date."""

    def day(c: str) -> Column:
        text = F.col(c)
        return F.try_to_date(F.when(F.char_length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(F.left(text, F.lit(10))), "yyyy-MM-dd")

    dead = F.lower("vital_status") == "deceased"
    end = F.coalesce(F.when(dead, day("date_of_death")), day("last_known_alive_date"), day("data_cutoff_date"))
    rows = patients.select("patient_id", dates.plot_months(F.datediff(end, day("advanced_diagnosis_date"))).alias("months"), F.coalesce(dead, F.lit(False)).cast("int").alias("event"))
    return rows.where("months IS NOT NULL")


def kaplan_meier(records: DataFrame, time: str = "os_days", strata: tuple[str, ...] = ()) -> DataFrame:
    """strata, time, n_risk, n_event, survival, greenwood: the curve after each distinct time.

    Records are first counted by time: what the running product and sums go over are distinct days, not patients.
    """
    steps = records.groupBy(*strata, F.col(time).alias("time")).agg(F.count("*").alias("leaving"), F.sum("event").alias("n_event"))
    group = Window.partitionBy(*strata)
    before = group.orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    upto = group.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("n_risk", F.sum("leaving").over(group) - F.coalesce(F.sum("leaving").over(before), F.lit(0)))
    stay = F.col("n_risk") - F.col("n_event")
    term = F.when((F.col("n_event") > 0) & (stay > 0), F.col("n_event") / (F.col("n_risk") * stay)).otherwise(0.0)
    return steps.select(*strata, "time", "n_risk", "n_event", F.product(1 - F.col("n_event") / F.col("n_risk")).over(upto).alias("survival"), F.sum(term).over(upto).alias("greenwood"))


def with_anchor(curve: DataFrame, strata: tuple[str, ...] = ()) -> DataFrame:
    """The curve with a row of time 0 and survival 1 for each stratum."""
    anchor = curve.groupBy(*strata).agg(F.max("n_risk").alias("n_risk")).select(*strata, F.lit(0).cast(curve.schema["time"].dataType).alias("time"), "n_risk", F.lit(0).cast("bigint").alias("n_event"), F.lit(1.0).alias("survival"), F.lit(0.0).alias("greenwood"))
    return anchor.unionByName(curve.select(*strata, "time", "n_risk", "n_event", "survival", "greenwood"))


def median_with_ci(curve: DataFrame, strata: tuple[str, ...] = ()) -> DataFrame:
    """strata, median, ci_lower, ci_upper: first times at which the curve, and its log-log bands, are at 0.5 or below."""
    s, v = F.col("survival"), F.col("greenwood")
    c = F.lit(Z_95) * F.sqrt(v) / F.ln(s)
    inside = (s < 1) & (s > 0) & (v > 0)
    one, two = F.pow(s, F.exp(c)), F.pow(s, F.exp(-c))
    bands = curve.select(*strata, "time", s.alias("s"), F.when(inside, F.least(one, two)).otherwise(s).alias("low"), F.when(inside, F.greatest(one, two)).otherwise(s).alias("high"))
    return bands.groupBy(*strata).agg(*(F.min(F.when(F.col(c) <= 0.5, F.col("time"))).alias(name) for c, name in (("s", "median"), ("low", "ci_lower"), ("high", "ci_upper"))))


def greenwood_variance(curve: DataFrame, at: float, strata: tuple[str, ...] = ()) -> DataFrame:
    """strata, variance of the survival at a time: squared survival times the running sum at the last time until then; 0 before the first."""
    until = F.col("time") <= at
    last = F.max_by(F.when(until, F.pow("survival", F.lit(2)) * F.col("greenwood")), F.when(until, F.col("time")))
    return curve.groupBy(*strata).agg(F.greatest(F.coalesce(last, F.lit(0.0)), F.lit(0.0)).alias("variance"))


def at_risk(records: DataFrame, strata: tuple[str, ...] = (), months: tuple[int, ...] = AT_RISK_MONTHS) -> DataFrame:
    """strata, month, n_risk: records whose months reach each of the given months."""
    counts = records.groupBy(*strata).agg(*(F.count_if(F.col("months") >= m).alias(str(m)) for m in months))
    return counts.unpivot(list(strata), [str(m) for m in months], "month", "n_risk").withColumn("month", F.col("month").cast("int"))


def follow_up(records: DataFrame, strata: tuple[str, ...] = ()) -> DataFrame:
    """strata, n, n_events, n_censored, median_days."""
    return records.groupBy(*strata).agg(F.count("*").alias("n"), F.sum("event").alias("n_events"), F.count_if(F.col("event") == 0).alias("n_censored"), F.median("os_days").alias("median_days"))
