"""Drug episodes and lines of therapy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.functions import dates, drugs

#: Days without a drug that end its episode, days in which drugs make one combination, days of a single drug at the end that make maintenance, days from the last dose in which death ends a line, longest sound line.
GAP, COMBINE, MAINTENANCE, DEATH, LONGEST = 90, 28, 42, 90, 3650


def administrations(medications: DataFrame) -> DataFrame:
    """patient_id, drug, start, end, drug_class of (patient_id, display, drug_name, medication_code, start_date, end_date, drug_class) as text; rows without a name or start are left out."""
    name = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("display", "drug_name", "medication_code")))
    start = dates.resolve_date(F.col("start_date"))
    end = F.greatest(F.coalesce(dates.resolve_date(F.col("end_date")), start), start)
    return medications.select("patient_id", drugs.drug_name(name).alias("drug"), start.alias("start"), end.alias("end"), "drug_class").where("drug IS NOT NULL AND start IS NOT NULL")


def progressions(events: DataFrame) -> DataFrame:
    """patient_id, date of (patient_id, event_date, progression_type); the event that defines the cohort is no progression."""
    date = dates.resolve_date(F.col("event_date"))
    return events.where(F.lower(F.coalesce("progression_type", F.lit(""))) != "to_advanced").select("patient_id", date.alias("date")).where("date IS NOT NULL")


def episodes(admins: DataFrame, gap: int = GAP) -> DataFrame:
    """patient_id, drug, start, end, n_admins, drug_class (the first's): stretches of a drug without a gap of more than `gap` days."""
    tie = [F.col("start").asc(), F.col("end").asc(), F.col("drug_class").asc_nulls_last()]
    order = Window.partitionBy("patient_id", "drug").orderBy(*tie)
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = admins.withColumn("new", (F.datediff("start", reached) > gap).cast("int")).withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by("drug_class", F.struct("start", "end", F.col("drug_class").isNull(), "drug_class"))
    return islands.groupBy("patient_id", "drug", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_admins"), first.alias("drug_class")).drop("island")


def line_numbers(found: DataFrame, progressed: DataFrame, combine: int = COMBINE) -> DataFrame:
    """patient_id, drug, start, end, drug_class, line: each episode's line.

    A patient's episodes are folded in order of (start, drug): what an episode does to the open line depends on all
    that the line has taken in, so a window can't say it. A patient's episodes are an array; patients are spread by the shuffle.
    """
    item = F.struct("start", "drug", "end", "drug_class")
    listed = found.groupBy("patient_id").agg(F.array_sort(F.collect_list(item)).alias("e"))
    dated = progressed.groupBy("patient_id").agg(F.collect_set("date").alias("p"))
    rows = listed.join(dated, "patient_id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<date>")))
    out_type = "array<struct<start:date,drug:string,end:date,drug_class:string,line:int>>"
    empty = F.struct(F.lit(0).alias("n"), F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"), F.array().cast("array<string>").alias("drugs"), F.array().cast(out_type).alias("out"))

    def step(line: Column, e: Column) -> Column:
        again = F.array_contains(line["drugs"], e["drug"])
        after = F.exists(F.col("p"), lambda d: (d >= line["start"]) & (d <= e["start"]))
        near = (F.datediff(e["start"], line["start"]) <= combine) | (F.datediff(e["start"], line["end"]) <= combine)
        new = (line["n"] == 0) | again | after | ~near
        n = line["n"] + new.cast("int")
        placed = F.struct(e["start"].alias("start"), e["drug"].alias("drug"), e["end"].alias("end"), e["drug_class"].alias("drug_class"), n.alias("line"))
        return F.struct(
            n.alias("n"), F.when(new, e["start"]).otherwise(line["start"]).alias("start"), F.when(new, e["end"]).otherwise(F.greatest(line["end"], e["end"])).alias("end"),
            F.when(new, F.array(e["drug"])).otherwise(F.concat(line["drugs"], F.array(e["drug"]))).alias("drugs"), F.concat(line["out"], F.array(placed)).alias("out"),
        )

    folded = rows.select("patient_id", F.explode(F.aggregate("e", empty, step, lambda x: x["out"])).alias("x"))
    return folded.select("patient_id", "x.*")


def lines(numbered: DataFrame, progressed: DataFrame, deaths: DataFrame | None = None) -> DataFrame:
    """patient_id, line_number, drugs, start_date, end_date, end_reason, is_maintenance, regimen_label, drug_class of each line.

    deaths: (patient_id, death_date) of the deceased.
    """
    item = F.struct("start", "drug", "end")
    per = numbered.groupBy("patient_id", F.col("line").alias("line_number")).agg(
        F.array_sort(F.collect_list(item)).alias("e"), F.min("start").alias("start_date"), F.max("end").alias("end_date"), F.collect_set(drugs.drug_class(F.col("drug"), F.col("drug_class"))).alias("classes")
    )
    ends = F.sort_array(F.transform("e", lambda x: x["end"]), asc=False)
    maintenance = (F.size("e") > 1) & (F.datediff(F.get(ends, F.lit(0)), F.get(ends, F.lit(1))) >= MAINTENANCE)
    names = F.transform("e", lambda x: x["drug"])
    per = per.withColumn("next", F.lead("start_date").over(Window.partitionBy("patient_id").orderBy("line_number")))
    dated = progressed.groupBy("patient_id").agg(F.collect_set("date").alias("p"))
    per = per.join(dated, "patient_id", "left")
    per = per.join(deaths, "patient_id", "left") if deaths is not None else per.withColumn("death_date", F.lit(None).cast("date"))
    progressed_before = F.exists(F.coalesce("p", F.array().cast("array<date>")), lambda d: (d >= F.col("end_date")) & (d <= F.col("next")))
    reason = (
        F.when(F.col("next").isNull() & (F.abs(F.datediff("death_date", "end_date")) <= DEATH), "death")
        .when(F.col("next").isNotNull(), F.when(progressed_before, "progression").otherwise("completion"))
        .otherwise("unknown")
    )
    return per.select(
        "patient_id", "line_number", names.alias("drugs"), "start_date", "end_date", reason.alias("end_reason"), F.coalesce(maintenance, F.lit(False)).alias("is_maintenance"),
        F.array_join(names, " + ").alias("regimen_label"), drugs.regimen_class(F.col("classes")).alias("drug_class"),
    )


def lines_of_therapy(admins: DataFrame, progressed: DataFrame, deaths: DataFrame | None = None, gap: int = GAP, combine: int = COMBINE) -> DataFrame:
    return lines(line_numbers(episodes(admins, gap), progressed, combine), progressed, deaths)


def lines_mart(admins: DataFrame, progressed: DataFrame, gap: int = GAP) -> DataFrame:
    """The warehouse's variant: sessions by window functions.

    patient_id, line_number, line_start_date, line_end_date, drugs, drug_classes, n_administrations. A row opens a line if
    it is the first, or if its drug was never started on an earlier day and a progression or a long gap lies before it.
    admins: patient_id, drug, start, end, drug_class; a null drug is never new. Rows of one start are in the order of drug, end and class;
    rows alike in all of these can change places.
    """
    place = Window.partitionBy("patient_id").orderBy(F.col("start").asc(), F.col("drug").asc_nulls_last(), "end", "drug_class")
    order = Window.partitionBy("patient_id").orderBy("place")
    first_start = F.min("start").over(Window.partitionBy("patient_id", "drug"))
    # Once a null drug was started on an earlier day, NOT IN is never true again.
    first_null = F.min(F.when(F.col("drug").isNull(), F.col("start"))).over(Window.partitionBy("patient_id"))
    none_earlier = F.col("start") == F.min("start").over(Window.partitionBy("patient_id"))
    new = none_earlier | (F.col("drug").isNotNull() & (F.col("start") == first_start) & (first_null.isNull() | (first_null >= F.col("start"))))
    rows = admins.withColumn("place", F.row_number().over(place)).withColumns({"previous": F.lag("start").over(order), "new": new})
    dated = progressed.groupBy("patient_id").agg(F.collect_set("date").alias("p"))
    since = F.exists(F.coalesce("p", F.array().cast("array<date>")), lambda d: (d <= F.col("start")) & (d > F.coalesce("previous", F.lit("1900-01-01").cast("date"))))
    opens = F.col("previous").isNull() | (F.col("new") & (since | (F.datediff("start", "previous") > gap)))
    rows = rows.join(dated, "patient_id", "left").withColumn("opens", opens.cast("int"))
    rows = rows.withColumn("line_number", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("patient_id", "line_number").agg(
        F.min("start").alias("line_start_date"), F.max("end").alias("line_end_date"), F.array_sort(F.collect_set("drug")).alias("drugs"), F.array_sort(F.collect_set("drug_class")).alias("drug_classes"), F.count("*").alias("n_administrations")
    )


def validate(found: DataFrame, index: DataFrame) -> DataFrame:
    """patient_id, code, line_number: what is wrong with lines. index: (patient_id, index_date)."""
    order = Window.partitionBy("patient_id").orderBy("line_number")
    first = found.withColumn("place", F.row_number().over(order))
    early = first.where("place = 1").join(index, "patient_id").where("start_date < index_date").select("patient_id", F.lit("treatment_before_diagnosis").alias("code"), F.lit(1).alias("line_number"))
    gaps = first.where("place <> line_number").select("patient_id", F.lit("non_sequential_line_numbers"), F.lit(None).cast("int")).distinct()
    unknown = found.select("patient_id", "line_number", F.explode("drugs").alias("drug")).where(~drugs.drug_name(F.col("drug")).isin(*drugs.ONCOLOGY)).select("patient_id", F.lit("unrecognized_drug"), "line_number")
    days = F.datediff("end_date", "start_date")
    spans = found.where((days < 0) | (days > LONGEST)).select("patient_id", F.when(days < 0, "end_before_start").otherwise("implausible_duration"), "line_number")
    return early.union(gaps).union(unknown).union(spans)


def summary(patients: DataFrame, found: DataFrame, curve_median: DataFrame | None = None) -> DataFrame:
    """One row: n_patients, n_treated, pct_reaching_line_2 and _3 of the treated, half-even to one place."""
    per = found.groupBy("patient_id").agg(F.max("line_number").alias("n"))
    treated = per.agg(F.count("*").alias("n_treated"), F.count_if(F.col("n") >= 2).alias("two"), F.count_if(F.col("n") >= 3).alias("three"))
    base = F.greatest("n_treated", F.lit(1))
    out = patients.agg(F.count("*").alias("n_patients")).join(treated).select("n_patients", "n_treated", F.bround(100.0 * F.col("two") / base, 1).alias("pct_reaching_line_2"), F.bround(100.0 * F.col("three") / base, 1).alias("pct_reaching_line_3"))
    return out if curve_median is None else out.join(curve_median)


def first_line_classes(found: DataFrame) -> DataFrame:
    return found.where("line_number = 1").groupBy("drug_class").agg(F.count("*").alias("n"))
