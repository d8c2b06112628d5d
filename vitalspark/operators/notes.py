"""Fields from free-text notes by rules, their merge over a patient's notes, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vocabularies, in the order of search.
HISTOLOGIES = "adenosquamous_carcinoma squamous_cell_carcinoma large_cell_carcinoma sarcomatoid_carcinoma adenocarcinoma nsclc_nos".split()
TREATMENTS = "osimertinib alectinib lorlatinib entrectinib crizotinib sotorasib adagrasib pembrolizumab nivolumab carboplatin cisplatin pemetrexed paclitaxel nab-paclitaxel docetaxel gemcitabine bevacizumab".split()
SITES = "brain bone liver adrenal lung_contralateral lymph_node_distant".split()
GENES = "egfr alk ros1 kras braf".split()
#: Patterns.
STAGE, ECOG, PDL1 = r"(?i)\bstage\s+(IV[AB]|III[BC])\b", r"(?i)ECOG[^0-9]{0,30}?([0-4])", r"(?i)PD-?L1\s*:?\s*(high|low|negative)"
TPS, PROGRESSED = r"(?i)TPS\s*([0-9]+(?:\.[0-9]+)?)\s*%?", r"(?i)progression\s+(?:documented|identified)?[^0-9]{0,40}?(\d{4}-\d{2}-\d{2})"
STATUS = r"(?i)\b{}\b\s*:?\s*(positive|negative|not[ _]tested|unknown)"
#: Note files by name, in the order of search.
NOTE_TYPES = (("initial_consult", "consult"), ("consult", "consult"), ("pathology_report", "pathology"), ("pathology", "pathology"), ("radiology_report", "radiology"), ("radiology", "radiology"), ("progress_note", "progress"), ("progress", "progress"))

SCALARS = "histology stage egfr_status egfr_mutation alk_status ros1_status kras_status kras_variant braf_status pdl1_status ecog progression_mentioned progression_date".split()
NUMERIC, LISTS = "pdl1_tps", ("new_metastatic_sites", "treatments_mentioned")
CONFUSION = ("histology", "stage", "egfr_status")


def note_type(name: Column) -> Column:
    """Type of a note by its file's stem: the whole name first, then the first known part."""
    stem = F.lower(name)
    out = F.when(F.lit(False), "")
    for key, value in NOTE_TYPES:
        out = out.when(stem == key, value)
    for key, value in NOTE_TYPES:
        out = out.when(F.contains(stem, F.lit(key)), value)
    return out.otherwise("unknown")


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def extract(text: Column, lower: Column, statuses: Column) -> Column:
    """struct of the fields of a note: the first find of each pattern, of a gene's statuses the last; confidence by how many of four anchors are found.

    lower: the text in lower case. statuses: all genes with a status in it, in order.
    """

    def among(words: list[str], spaced: bool = False) -> Column:
        hits = [F.when(F.contains(lower, F.lit(w.replace("_", " ") if spaced else w)), F.lit(w)) for w in words]
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    def status_of(gene: str) -> Column:
        last = F.try_element_at(F.filter(statuses, lambda x: F.lower(x).startswith(gene)), F.lit(-1))
        return F.replace(F.regexp_extract(F.lower(last), r"(positive|negative|not[ _]tested|unknown)$", 1), F.lit(" "), F.lit("_"))

    status = {g: status_of(g) for g in GENES}
    stage, histology = F.upper(_first(text, STAGE)), F.get(among(HISTOLOGIES, spaced=True), F.lit(0))
    ecog, pdl1 = _first(text, ECOG).try_cast("int"), F.lower(_first(text, PDL1))
    progressed = F.contains(lower, F.lit("progression"))
    anchors = sum(x.isNotNull().cast("int") for x in (stage, histology, ecog, pdl1))
    sites = F.when(progressed | F.contains(lower, F.lit("new involvement at")), among(SITES)).otherwise(F.array().cast("array<string>"))
    fields = {
        "histology": histology,
        "stage": stage,
        "egfr_status": status["egfr"],
        "egfr_mutation": F.when(F.contains(lower, F.lit("exon 19")) | F.contains(lower, F.lit("exon19")), "exon19_deletion").when(F.contains(lower, F.lit("l858r")), "L858R"),
        "alk_status": status["alk"],
        "ros1_status": status["ros1"],
        "kras_status": status["kras"],
        "kras_variant": _first(text, r"\b(G12[A-Z])\b"),
        "braf_status": status["braf"],
        "pdl1_status": pdl1,
        "pdl1_tps": _first(text, TPS).try_cast("double"),
        "ecog": ecog,
        "progression_mentioned": progressed,
        "progression_date": _first(text, PROGRESSED),
        "new_metastatic_sites": sites,
        "treatments_mentioned": among(TREATMENTS),
        "extraction_confidence": F.when(anchors >= 3, "high").when(anchors >= 1, "medium").otherwise("low"),
        "uncertain_fields": F.filter(F.array(F.when(stage.isNull(), "stage"), F.when(histology.isNull(), "histology")), lambda x: x.isNotNull()),
    }
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def abstract(notes: DataFrame, text: str = "text") -> DataFrame:
    """notes with their fields in place of the text."""
    rows = notes.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumns({"_l": F.lower("_t"), "_s": F.regexp_extract_all("_t", F.lit(STATUS.format(f"(?:{'|'.join(GENES)})")), F.lit(0))})
    return rows.withColumn("_f", extract(F.col("_t"), F.col("_l"), F.col("_s"))).select(*(c for c in notes.columns if c != text), "_f.*")


def merge_notes(found: DataFrame, patient: str = "patient_id", order: str = "note_order", treatments: tuple[str, ...] = tuple(TREATMENTS), sites: tuple[str, ...] = tuple(SITES)) -> DataFrame:
    """One row for each patient: of scalars the first that isn't null in note order, of flags any, of sites the sorted and of treatments the ordered union.

    One grouping, so that notes are read once: each word of the two vocabularies is an aggregate of its own, and nothing
    that a patient gathers grows with the notes.  Words that are in neither vocabulary are left out.
    """
    scalars = [c for c in SCALARS if c != "progression_mentioned"] + [NUMERIC]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    at = [F.min(F.when(F.array_contains("treatments_mentioned", w), F.struct(F.col(order).alias("note"), F.array_position("treatments_mentioned", w).alias("place")))).alias(f"_t{i}") for i, w in enumerate(treatments)]
    seen = [F.bool_or(F.array_contains("new_metastatic_sites", w)).alias(f"_s{i}") for i, w in enumerate(sorted(sites))]
    rows = found.groupBy(patient).agg(*first, F.bool_or("progression_mentioned").alias("progression_mentioned"), *at, *seen)
    given = F.array_sort(F.filter(F.array(*(F.struct(F.col(f"_t{i}").alias("at"), F.lit(w).alias("drug")) for i, w in enumerate(treatments))), lambda x: x["at"].isNotNull()))
    told = F.filter(F.array(*(F.when(F.col(f"_s{i}"), F.lit(w)) for i, w in enumerate(sorted(sites)))), lambda x: x.isNotNull())
    return rows.select(patient, *scalars, "progression_mentioned", told.alias("new_metastatic_sites"), F.transform(given, lambda x: x["drug"]).alias("treatments_mentioned"))


#: Variants of a gene that are told apart, in the order of search.
KRAS_VARIANTS = ("G12C", "G12D", "G12V", "G12A", "G13D")


def ground_truth(patients: DataFrame, administrations: DataFrame, progressions: DataFrame, biomarkers: DataFrame) -> DataFrame:
    """patient_id and the fields that a perfect reader would find in all notes of a patient, as merge_notes() gives them.

    patients: patient_id, histology, stage_at_advanced_diagnosis, a status for each gene, pdl1_status, pdl1_tps, ecog. administrations: patient_id, display, place.
    progressions: patient_id, event_date, progression_type, new_metastatic_sites, place; only those on treatment are told, of these the latest, of equal ones the first.
    biomarkers: patient_id, biomarker_name, result, result_value, place; of several the last that names a variant. What was not tested is not told.
    """
    given = administrations.groupBy("patient_id", "display").agg(F.min("place").alias("place")).groupBy("patient_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "display"))), lambda x: x["display"]).alias("treatments_mentioned"))
    latest = progressions.where("progression_type = 'on_treatment_progression'").groupBy("patient_id").agg(F.max_by(F.struct("event_date", "new_metastatic_sites"), F.struct("event_date", -F.col("place"))).alias("p"))
    text = F.lower("result_value")
    egfr = F.when(F.contains(text, F.lit("exon 19")), "exon19_deletion").when(F.contains(text, F.lit("l858r")), "L858R")
    kras = F.coalesce(*(F.when(F.contains(F.upper("result_value"), F.lit(v)), v) for v in KRAS_VARIANTS))
    positive = biomarkers.where("result = 'positive'")
    named = {"egfr_mutation": F.when(F.col("biomarker_name") == "egfr", egfr), "kras_variant": F.when(F.col("biomarker_name") == "kras", kras)}
    variants = positive.groupBy("patient_id").agg(*(F.max_by(v, F.when(v.isNotNull(), F.col("place"))).alias(k) for k, v in named.items()))
    tested = [F.nullif(F.col(c), F.lit("not_tested")).alias(c) for c in (*(f"{g}_status" for g in GENES), "pdl1_status")]
    rows = patients.join(given, "patient_id", "left").join(latest, "patient_id", "left").join(variants, "patient_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "patient_id", "histology", F.col("stage_at_advanced_diagnosis").alias("stage"), *tested, "egfr_mutation", "kras_variant", "pdl1_tps", "ecog", F.col("p").isNotNull().alias("progression_mentioned"), F.col("p.event_date").cast("string").alias("progression_date"),
        F.coalesce("p.new_metastatic_sites", none).alias("new_metastatic_sites"), F.coalesce("treatments_mentioned", none).alias("treatments_mentioned"),
    )


def plain(value: Column) -> Column:
    """Text as it is compared: trimmed, lower case, spaces as underscores; blank is null."""
    return F.nullif(F.replace(F.lower(F.trim(value.cast("string"))), F.lit(" "), F.lit("_")), F.lit(""))


def _paired(truth: DataFrame, found: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    t = truth.select(key, *(F.col(f).alias(f"t_{f}") for f in fields))
    return t.join(found.select(key, *(F.col(f).alias(f"p_{f}") for f in fields)), key)


def scalar_scores(truth: DataFrame, found: DataFrame, key: str, fields: tuple[str, ...] = tuple(SCALARS)) -> DataFrame:
    """field, n, accuracy, miss_rate (of true values, how many were not found; 0 without any)."""
    both = _paired(truth, found, key, fields)
    tall = both.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), plain(F.col(f"t_{f}")).alias("t"), plain(F.col(f"p_{f}")).alias("p")) for f in fields))).alias("x")).select("x.*")
    missed = F.count_if(F.col("t").isNotNull() & F.col("p").isNull())
    return tall.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.col("t").eqNullSafe(F.col("p")).cast("double")).alias("accuracy"), F.coalesce(F.try_divide(missed.cast("double"), F.count("t")), F.lit(0.0)).alias("miss_rate"))


def numeric_accuracy(truth: DataFrame, found: DataFrame, key: str, field: str = NUMERIC, tolerance: float = 0.5) -> DataFrame:
    """field, n, accuracy: values at most `tolerance` apart, or both null."""
    both = _paired(truth, found, key, (field,))
    t, p = F.col(f"t_{field}"), F.col(f"p_{field}")
    close = F.coalesce(F.abs(t - p) <= tolerance, t.isNull() & p.isNull())
    return both.agg(F.count("*").alias("n"), F.avg(close.cast("double")).alias("accuracy")).select(F.lit(field).alias("field"), "n", "accuracy")


def set_scores(truth: DataFrame, found: DataFrame, key: str, fields: tuple[str, ...] = LISTS) -> DataFrame:
    """field, tp, fp, fn, precision, recall (1 without any), f1 (0 without any), over all rows together."""
    both = _paired(truth, found, key, fields)

    def norm(c: str) -> Column:
        return F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), plain))

    tall = both.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), norm(f"t_{f}").alias("t"), norm(f"p_{f}").alias("p")) for f in fields))).alias("x")).select("x.*")
    sums = tall.groupBy("field").agg(F.sum(F.size(F.array_intersect("t", "p"))).alias("tp"), F.sum(F.size(F.array_except("p", "t"))).alias("fp"), F.sum(F.size(F.array_except("t", "p"))).alias("fn"))
    precision, recall = (F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col(x)), F.lit(1.0)) for x in ("fp", "fn"))
    out = sums.withColumn("precision", precision).withColumn("recall", recall)
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def confusion(truth: DataFrame, found: DataFrame, key: str, fields: tuple[str, ...] = CONFUSION) -> DataFrame:
    """field, truth, found, n; a null counts as the label None."""
    both = _paired(truth, found, key, fields)
    none = F.lit("None")
    tall = both.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(plain(F.col(f"t_{f}")), none).alias("truth"), F.coalesce(plain(F.col(f"p_{f}")), none).alias("found")) for f in fields))).alias("x")).select("x.*")
    return tall.groupBy("field", "truth", "found").agg(F.count("*").alias("n"))


def macro_accuracy(scalars: DataFrame, numeric: DataFrame, sets: DataFrame) -> DataFrame:
    """Mean of all accuracies and F1s."""
    every = scalars.select(F.col("accuracy").alias("x")).union(numeric.select("accuracy")).union(sets.select("f1"))
    return every.agg(F.avg("x").alias("macro_accuracy"))
