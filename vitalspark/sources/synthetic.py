"""A synthetic cohort: each value from a hash of the patient's number, so that any partitioning gives the same one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What is drawn, with weights.
HISTOLOGIES = (("adenocarcinoma", 65), ("squamous_cell_carcinoma", 22), ("large_cell_carcinoma", 4), ("nsclc_nos", 6), ("adenosquamous_carcinoma", 3))
STAGES, SEXES, FORMATS = (("IVA", 35), ("IVB", 35), ("IIIB", 20), ("IIIC", 10)), (("male", 54), ("female", 46)), (("fhir", 34), ("hl7v2", 33), ("csv", 33))
MUTATIONS = {"egfr": (("positive", 15), ("negative", 75), ("not_tested", 10)), "alk": (("positive", 5), ("negative", 83), ("not_tested", 12)), "ros1": (("positive", 2), ("negative", 83), ("not_tested", 15)), "braf": (("positive", 4), ("negative", 80), ("not_tested", 16)), "kras": (("positive", 25), ("negative", 60), ("not_tested", 15)), "pdl1": (("high", 30), ("low", 30), ("negative", 30), ("not_tested", 10))}
LABS = (("718-7", "Hemoglobin", "g/dL", 9.0, 15.0), ("26464-8", "White blood cell count", "10*3/uL", 3.0, 11.0), ("2160-0", "Creatinine", "mg/dL", 0.6, 1.4))
#: First lines by marker, and later ones in order of preference: by driver, for KRAS, without a driver, and for all.
FIRST_LINES = {"egfr": ("osimertinib",), "alk": ("alectinib",), "ros1": ("entrectinib",), "io": ("pembrolizumab",), "non_squamous": ("carboplatin", "pemetrexed", "pembrolizumab"), "squamous": ("carboplatin", "paclitaxel", "pembrolizumab")}
LATER_LINES = {
    "egfr": (("osimertinib",),),
    "alk": (("lorlatinib",),),
    "kras": (("sotorasib",), ("adagrasib",), ("docetaxel",)),
    "none": (("docetaxel",), ("docetaxel", "ramucirumab")),
    "all": (("gemcitabine",), ("carboplatin", "pemetrexed"), ("docetaxel",)),
}
SQUAMOUS = "squamous_cell_carcinoma"
#: Shares of treated patients, and of those that go on to a second and a third line; cycles of a line, days between two lines.
TREATED, GOES_ON, CYCLES, GAP = 0.75, (0.55, 0.5), (3, 6), (20, 60)
CYCLE_DAYS, CUTOFF = 21, "2024-12-31"
#: Patients that a task draws, on average.
TASK_PATIENTS = 20_000


def uniform(seed: int, *key: Column | str) -> Column:
    """Between 0 and 1, from a key."""
    return F.pmod(F.xxhash64(*(F.lit(k) if isinstance(k, str) else k for k in key), F.lit(seed)), F.lit(1_000_003)) / 1_000_003


def weighted(u: Column, choices: tuple[tuple[str, int], ...]) -> Column:
    total, reached, out = sum(w for _, w in choices), 0, None
    for value, weight in choices:
        reached += weight
        out = F.when(u < reached / total, value) if out is None else out.when(u < reached / total, value)
    return out.otherwise(choices[-1][0])


def patients(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    return patients_of(spark.range(n), seed)


def patients_of(ids: DataFrame, seed: int = 42) -> DataFrame:
    """A patient for each id (long), TASK_PATIENTS to a task whatever the files of the ids: the journeys of a patient are many times the id, and all that is grouped or joined by patient stays in its task."""
    i = F.col("id")
    rows = ids.select("id").withColumn("patient_id", F.concat(F.lit("P"), F.lpad(i.cast("string"), 8, "0")))
    rows = rows.repartition(max(ids.sparkSession.sparkContext.defaultParallelism, -(-ids.count() // TASK_PATIENTS)), "patient_id")
    draw = lambda name: uniform(seed, i, name)
    diagnosed = F.date_add(F.lit("2018-01-01").cast("date"), (draw("dx") * 1800).cast("int"))
    last = F.date_add(diagnosed, (90 + draw("follow") * 900).cast("int"))
    dead = draw("dead") < 0.3
    rows = rows.select(
        "id", "patient_id", weighted(draw("sex"), SEXES).alias("sex"), (40 + (draw("age") * 45).cast("int")).alias("age_at_advanced_diagnosis"), weighted(draw("hist"), HISTOLOGIES).alias("histology"), weighted(draw("stage"), STAGES).alias("stage_at_advanced_diagnosis"),
        diagnosed.alias("dx"), last.alias("last"), dead.alias("dead"), weighted(draw("format"), FORMATS).alias("source_format"), (draw("ecog") * 4).cast("int").alias("ecog_at_advanced_diagnosis"),
        *(weighted(draw(g), c).alias(f"{g}_status") for g, c in MUTATIONS.items()),
    )
    return rows.select(
        "*", F.col("dx").cast("string").alias("advanced_diagnosis_date"), F.when(F.col("dead"), "deceased").otherwise("alive").alias("vital_status"), F.when(F.col("dead"), F.col("last").cast("string")).alias("date_of_death"),
        F.col("last").cast("string").alias("last_known_alive_date"), F.lit(CUTOFF).alias("data_cutoff_date"), F.date_format(F.add_months("dx", -12 * F.col("age_at_advanced_diagnosis")), "yyyy-MM").alias("date_of_birth"),
    )


def biomarkers(cohort: DataFrame) -> DataFrame:
    """One row for each test that was made."""
    tests = F.explode(F.array(*(F.struct(F.lit(g).alias("biomarker_name"), F.col(f"{g}_status").alias("result")) for g in MUTATIONS)))
    rows = cohort.select("patient_id", F.col("dx").cast("string").alias("result_date"), tests.alias("t")).select("patient_id", "result_date", "t.*").where("result <> 'not_tested'")
    return rows.select(F.concat_ws("-", F.lit("B"), "patient_id", "biomarker_name").alias("biomarker_id"), "patient_id", "biomarker_name", "result", "result_date")


def conditions(cohort: DataFrame) -> DataFrame:
    return cohort.select(F.concat(F.lit("C-"), "patient_id").alias("condition_id"), "patient_id", F.lit("C34.11").alias("condition_code"), "histology", "stage_at_advanced_diagnosis", F.col("advanced_diagnosis_date").alias("onset_date"))


def observations(cohort: DataFrame, seed: int = 42) -> DataFrame:
    """Three rounds of laboratory values."""
    labs = F.explode(F.array(*(F.struct(F.lit(c).alias("loinc_code"), F.lit(d).alias("display"), F.lit(u).alias("unit"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for c, d, u, a, b in LABS)))
    rows = cohort.select("id", "patient_id", "dx", "last", labs.alias("l")).select("id", "patient_id", "dx", "last", "l.*").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(2))))
    date = F.least(F.date_add("dx", 30 * F.col("round")), "last")
    value = F.round(F.col("lo") + uniform(seed, F.col("id"), F.col("loinc_code"), F.col("round")) * (F.col("hi") - F.col("lo")), 1)
    return rows.select(F.concat_ws("-", F.lit("O"), "patient_id", "loinc_code", "round").alias("observation_id"), "patient_id", "loinc_code", "display", date.cast("string").alias("observation_date"), value.alias("value"), "unit")


def _drugs(*names: str) -> Column:
    return F.array(*map(F.lit, names))


def _later(cohort_column=F.col) -> Column:
    """Array of the later lines that a patient may have, the preferred ones first."""
    lines = lambda k: F.array(*(_drugs(*x) for x in LATER_LINES[k]))
    driver = {g: F.coalesce(cohort_column(f"{g}_status") == "positive", F.lit(False)) for g in ("egfr", "alk", "ros1", "kras")}
    doublet = F.array(F.when(cohort_column("histology") == SQUAMOUS, _drugs("carboplatin", "paclitaxel")).otherwise(_drugs("carboplatin", "pemetrexed")))
    none = F.array().cast("array<array<string>>")
    targeted = F.concat(F.when(driver["egfr"], lines("egfr")).otherwise(none), F.when(driver["alk"], lines("alk")).otherwise(none), doublet, F.array(_drugs("docetaxel")))
    own = F.when(driver["egfr"] | driver["alk"] | driver["ros1"], targeted).when(driver["kras"], lines("kras")).otherwise(lines("none"))
    return F.concat(own, lines("all"))


def choose(choices: Column, used: Column, u: Column) -> Column:
    """A choice, an array of drugs, whose first drug isn't used: of n that are left the k-th counts n - k + 1; null if none is left."""
    left = F.filter(choices, lambda x: ~F.array_contains(used, x[0]))
    n = F.size(left)
    reached = F.transform(left, lambda x, k: F.struct(((k + 1) * n - k * (k + 1) / 2).alias("to"), x.alias("drugs")))
    return F.get(F.filter(reached, lambda x: x["to"] > u * n * (n + 1) / 2), F.lit(0))["drugs"]


def regimens(cohort: DataFrame, seed: int = 42) -> DataFrame:
    """patient_id, line, drug, first day, cycles and last day of the patient: up to three lines of treated patients.

    A fold over the lines: each later line is drawn from what its patient may have without the drugs used so far, and begins
    some weeks after the last cycle of the line before.  Lines that would begin after the patient's last day are not there.
    """
    first = (
        F.when(F.col("egfr_status") == "positive", _drugs(*FIRST_LINES["egfr"])).when(F.col("alk_status") == "positive", _drugs(*FIRST_LINES["alk"])).when(F.col("ros1_status") == "positive", _drugs(*FIRST_LINES["ros1"]))
        .when(F.col("pdl1_status") == "high", _drugs(*FIRST_LINES["io"])).when(F.col("histology") == SQUAMOUS, _drugs(*FIRST_LINES["squamous"])).otherwise(_drugs(*FIRST_LINES["non_squamous"]))
    )
    draw = lambda name, k: uniform(seed, F.col("id"), F.lit(name), k)
    between = lambda u, low, high: (low + u * (high - low + 1)).cast("int")
    cycles = lambda k: between(draw("cycles", k), *CYCLES)
    line = lambda k, drugs, day: F.struct(k.alias("line"), drugs.alias("drugs"), day.alias("from"), cycles(k).alias("cycles"))
    rows = cohort.where(uniform(seed, F.col("id"), F.lit("treated")) < TREATED).withColumns({"one": first, "later": _later()})
    start = F.struct(F.col("one").alias("used"), F.array(line(F.lit(1), F.col("one"), F.date_add("dx", 14))).alias("lines"))

    def step(state: Column, k: Column) -> Column:
        goes_on = (F.size(state["lines"]) == k - 1) & (draw("again", k) < F.when(k == 2, GOES_ON[0]).otherwise(GOES_ON[1]))
        drugs = F.when(goes_on, choose(F.col("later"), state["used"], draw("choice", k)))
        before = F.element_at(state["lines"], -1)
        day = F.date_add(before["from"], CYCLE_DAYS * (before["cycles"] - 1) + between(draw("gap", k), *GAP))
        return F.struct(F.when(drugs.isNotNull(), F.array_union(state["used"], drugs)).otherwise(state["used"]).alias("used"), F.when(drugs.isNotNull(), F.array_append(state["lines"], line(k, drugs, day))).otherwise(state["lines"]).alias("lines"))

    lines = rows.select("id", "patient_id", "last", F.explode(F.aggregate(F.array(F.lit(2), F.lit(3)), start, step, lambda s: s["lines"])).alias("l"))
    return lines.where("l.from <= last").select("id", "patient_id", "l.line", F.explode("l.drugs").alias("drug"), F.col("l.from").alias("from"), "l.cycles", "last")


def medications(cohort: DataFrame, seed: int = 42) -> DataFrame:
    """A row for each drug and cycle, every 21 days, none after the last day."""
    rows = regimens(cohort, seed).withColumn("cycle", F.explode(F.sequence(F.lit(1), F.col("cycles")))).withColumn("day", F.date_add("from", CYCLE_DAYS * (F.col("cycle") - 1))).where("day <= last")
    return rows.select(F.concat_ws("-", F.lit("M"), "patient_id", "line", "drug", "cycle").alias("medication_id"), "patient_id", F.lit(None).cast("string").alias("rxnorm_code"), F.col("drug").alias("display"), F.lit(None).cast("string").alias("drug_class"), F.col("day").cast("string").alias("start_date"), F.col("day").cast("string").alias("end_date"), "cycle", F.concat_ws("-", F.lit("R"), "patient_id", "line").alias("regimen_id"))


def progressions(cohort: DataFrame, seed: int = 42) -> DataFrame:
    """A progression before each later line."""
    rows = regimens(cohort, seed).where("line > 1").groupBy("patient_id", "line").agg(F.min("from").alias("from"))
    return rows.select(F.concat_ws("-", F.lit("G"), "patient_id", "line").alias("progression_id"), "patient_id", F.date_sub("from", 7).cast("string").alias("event_date"), F.lit("on_treatment_progression").alias("progression_type"), F.array(F.lit("bone"), F.lit("liver")).alias("new_metastatic_sites"))


def journey_faults(cohort: DataFrame, drugs: DataFrame, progressed: DataFrame) -> DataFrame:
    """check, n_fail: what can't be in journeys: a later line without a drug of its own, before the end of the one before, or without a progression between them, and drugs after the last day."""
    lines = drugs.groupBy("patient_id", "regimen_id").agg(F.collect_set("display").alias("drugs"), F.min("start_date").alias("from"), F.max("start_date").alias("to"))
    order = Window.partitionBy("patient_id").orderBy("from", "regimen_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumns({"used": F.array_distinct(F.flatten(F.collect_list("drugs").over(before))), "ended": F.lag("to").over(order), "n": F.row_number().over(order)})
    later = lines.where("n > 1")
    between = later.join(progressed.select("patient_id", "event_date"), "patient_id", "left").groupBy("patient_id", "n").agg(F.max(F.coalesce(F.col("event_date").between(F.col("ended"), F.col("from")), F.lit(False))).alias("seen"))
    late = drugs.join(cohort.select("patient_id", "last"), "patient_id").where("start_date > last")
    parts = {"no drug of its own": later.where("size(array_except(drugs, used)) = 0"), "begins before the end": later.where("`from` <= ended"), "no progression between": between.where("NOT seen"), "after the last day": late}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n_fail")).select(F.lit(name).alias("check"), "n_fail")
        out = one if out is None else out.union(one)
    return out


def note_texts(cohort: DataFrame) -> DataFrame:
    """patient_id, note_order, text in the wording that the note rules read."""
    text = F.format_string(
        "Advanced %s, stage %s. ECOG performance status: %d. EGFR: %s; ALK: %s; KRAS: %s; PD-L1: %s.", F.replace("histology", F.lit("_"), F.lit(" ")), "stage_at_advanced_diagnosis", "ecog_at_advanced_diagnosis",
        *(F.replace(f"{g}_status", F.lit("_"), F.lit(" ")) for g in ("egfr", "alk", "kras", "pdl1")),
    )
    return cohort.select("patient_id", F.lit(1).alias("note_order"), text.alias("text"))


def manifest(cohort: DataFrame, seed: int = 42) -> DataFrame:
    """One row: seed, patients, and how many have each format."""
    return cohort.agg(F.lit(seed).alias("seed"), F.count("*").alias("n_patients"), *(F.count_if(F.col("source_format") == f).alias(f) for f, _ in FORMATS))
