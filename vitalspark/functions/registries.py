"""Code registries: laboratory codes, drugs, diagnoses. Small dimensions of a fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.functions.bind import bind

#: LOINC code, canonical column, unit, data type, aliases.
LOINC = (
    ("26464-8", "wbc_count", "10*3/uL", "quantity_with_unit", ("wbc", "white blood")),
    ("718-7", "hemoglobin", "g/dL", "quantity_with_unit", ("hgb", "hemoglobin")),
    ("4544-3", "hematocrit", "%", "quantity_with_unit", ("hct", "hematocrit")),
    ("777-3", "platelet_count", "10*3/uL", "quantity_with_unit", ("plt", "platelet")),
    ("751-8", "absolute_neutrophil_count", "10*3/uL", "quantity_with_unit", ("anc", "neutrophil")),
    ("731-0", "lymphocyte_count", "10*3/uL", "quantity_with_unit", ("lymphocyte",)),
    ("2345-7", "glucose", "mg/dL", "quantity_with_unit", ("glucose",)),
    ("2160-0", "creatinine", "mg/dL", "quantity_with_unit", ("creatinine",)),
    ("3094-0", "bun", "mg/dL", "quantity_with_unit", ("bun",)),
    ("2951-2", "sodium", "mEq/L", "quantity_with_unit", ("sodium", "na")),
    ("2823-3", "potassium", "mEq/L", "quantity_with_unit", ("potassium",)),
    ("2075-0", "chloride", "mEq/L", "quantity_with_unit", ("chloride",)),
    ("2028-9", "co2", "mEq/L", "quantity_with_unit", ("co2", "bicarbonate")),
    ("17861-6", "calcium", "mg/dL", "quantity_with_unit", ("calcium",)),
    ("1751-7", "albumin", "g/dL", "quantity_with_unit", ("albumin",)),
    ("1742-6", "alt", "U/L", "quantity_with_unit", ("alt", "sgpt")),
    ("1920-8", "ast", "U/L", "quantity_with_unit", ("ast", "sgot")),
    ("1975-2", "total_bilirubin", "mg/dL", "quantity_with_unit", ("bilirubin",)),
    ("85319-2", "pdl1_tps_value", "%", "quantity_with_unit", ("pdl1", "pd-l1", "tps")),
    ("48676-1", "egfr_status", None, "coded_value", ("egfr",)),
    ("48570-6", "alk_status", None, "coded_value", ("alk",)),
    ("82115-7", "ros1_status", None, "coded_value", ("ros1",)),
    ("21667-1", "kras_status", None, "coded_value", ("kras",)),
    ("62862-8", "braf_status", None, "coded_value", ("braf",)),
    ("89243-0", "ecog_at_advanced_diagnosis", None, "integer", ("ecog",)),
)

#: RxNorm code, drug, class, brand.
RXNORM = (
    ("1721560", "osimertinib", "EGFR_TKI", "Tagrisso"),
    ("450821", "gefitinib", "EGFR_TKI", "Iressa"),
    ("711442", "erlotinib", "EGFR_TKI", "Tarceva"),
    ("1430438", "afatinib", "EGFR_TKI", "Gilotrif"),
    ("1995158", "dacomitinib", "EGFR_TKI", "Vizimpro"),
    ("1535467", "crizotinib", "ALK_TKI", "Xalkori"),
    ("1727444", "alectinib", "ALK_TKI", "Alecensa"),
    ("1925188", "lorlatinib", "ALK_TKI", "Lorbrena"),
    ("1855581", "brigatinib", "ALK_TKI", "Alunbrig"),
    ("1996189", "entrectinib", "ROS1_TKI", "Rozlytrek"),
    ("2569878", "sotorasib", "KRAS_INHIBITOR", "Lumakras"),
    ("2641288", "adagrasib", "KRAS_INHIBITOR", "Krazati"),
    ("1547545", "pembrolizumab", "IO", "Keytruda"),
    ("1597876", "nivolumab", "IO", "Opdivo"),
    ("1792776", "atezolizumab", "IO", "Tecentriq"),
    ("1919505", "durvalumab", "IO", "Imfinzi"),
    ("1657797", "ipilimumab", "IO", "Yervoy"),
    ("40048", "carboplatin", "PLATINUM", "Paraplatin"),
    ("2555", "cisplatin", "PLATINUM", "Platinol"),
    ("482311", "pemetrexed", "CHEMO", "Alimta"),
    ("56946", "paclitaxel", "CHEMO", "Taxol"),
    ("72962", "docetaxel", "CHEMO", "Taxotere"),
    ("12574", "gemcitabine", "CHEMO", "Gemzar"),
    ("53557", "vinorelbine", "CHEMO", "Navelbine"),
    ("253337", "bevacizumab", "VEGF", "Avastin"),
    ("1535996", "ramucirumab", "VEGF", "Cyramza"),
    ("1424911", "dabrafenib", "BRAF_INHIBITOR", "Tafinlar"),
    ("1425099", "trametinib", "MEK_INHIBITOR", "Mekinist"),
    ("2378728", "selpercatinib", "RET_INHIBITOR", "Retevmo"),
    ("2374727", "capmatinib", "MET_INHIBITOR", "Tabrecta"),
    ("2569870", "amivantamab", "EGFR_MET_BISPECIFIC", "Rybrevant"),
)

#: ICD-10 code, canonical column.
ICD10 = (
    ("C34.00", "diagnosis_code"),
    ("C34.01", "diagnosis_code"),
    ("C34.02", "diagnosis_code"),
    ("C34.10", "diagnosis_code"),
    ("C34.11", "diagnosis_code"),
    ("C34.12", "diagnosis_code"),
    ("C34.2", "diagnosis_code"),
    ("C34.3", "diagnosis_code"),
    ("C34.90", "diagnosis_code"),
    ("C34.91", "diagnosis_code"),
    ("C34.92", "diagnosis_code"),
    ("I10", "comorbidity_code"),
    ("E11", "comorbidity_code"),
    ("J44", "comorbidity_code"),
    ("F32", "comorbidity_code"),
)

#: Hints in a column's name for drugs, and patterns of whole codes.
DRUG_HINTS = ("drug", "medication", "medicine", "treatment", "rxnorm")
LOINC_CODE, ICD10_CODE, RXNORM_CODE = r"^\d{1,5}-\d$", r"^[A-Z]\d{2}(\.\d+)?$", r"^\d{4,7}$"


def column_name(name: Column) -> Column:
    """A column's name in lower case, hyphens and spaces as underscores."""
    return F.translate(F.lower(name), "- ", "__")


def clean_samples(samples: Column) -> Column:
    """Samples trimmed, without nulls and blanks."""
    return F.filter(F.transform(samples, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def _entries(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def alias_codes(name: Column) -> Column:
    """Codes of the laboratory entries with an alias inside a normalised column name."""
    hits = []
    for code, _, _, _, aliases in LOINC:
        found = F.lit(False)
        for alias in aliases:
            found = found | F.contains(name, F.lit(alias.replace("-", "_").replace(" ", "_")))
        hits.append(F.when(found, code))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def lookup(source_column: Column, samples: Column) -> Column:
    """struct(canonical_name, data_type, unit, registry, code, matched_on), or null if no registry knows the column.

    In order: all samples one known LOINC code; all known ICD-10 codes (of several the least); a drug hint in the name and all
    samples one drug, by name, brand or code; an alias of exactly one laboratory entry in the name.
    """
    both = F.struct(column_name(source_column).alias("name"), clean_samples(samples).alias("samples"))
    return bind(both, lambda x: lookup_evidence(source_column, _sampled(x["samples"])))


def lookup_evidence(source_column: Column, evidence: Column) -> Column:
    """lookup() by what evidence() tells of all values of a column."""
    return bind(bind(F.struct(column_name(source_column).alias("name"), evidence.alias("e")), lambda x: _codes(x["name"], x["e"])), _verdict)


def _icd() -> Column:
    return _entries(list(ICD10))


def _drug(value: Column) -> Column:
    return F.try_element_at(_entries([(k, x[0]) for x in RXNORM for k in (x[1], x[3].lower())] + [(x[0], x[0]) for x in RXNORM]), F.lower(value))


def _is_icd(value: Column) -> Column:
    return value.rlike(ICD10_CODE) & F.map_contains_key(_icd(), F.upper(value))


def evidence(value: Column) -> Column:
    """Aggregate of a column's values: what lookup() asks of all of them, however many: struct(n, least, most, icd_all, icd, drug_all, drug_least, drug_most)."""
    clean = F.nullif(F.trim(value), F.lit(""))
    drug = _drug(clean)
    return F.struct(
        F.count(clean).alias("n"), F.min(clean).alias("least"), F.max(clean).alias("most"), F.bool_and(F.when(clean.isNotNull(), _is_icd(clean))).alias("icd_all"), F.min(F.upper(clean)).alias("icd"),
        F.bool_and(F.when(clean.isNotNull(), drug.isNotNull())).alias("drug_all"), F.min(drug).alias("drug_least"), F.max(drug).alias("drug_most"),
    )


def _sampled(clean: Column) -> Column:
    """evidence() of an array of clean samples."""
    drugs = F.transform(clean, _drug)
    return F.struct(
        F.size(clean).cast("long").alias("n"), F.array_min(clean).alias("least"), F.array_max(clean).alias("most"), F.forall(clean, _is_icd).alias("icd_all"), F.array_min(F.transform(clean, lambda x: F.upper(x))).alias("icd"),
        (~F.exists(drugs, lambda x: x.isNull())).alias("drug_all"), F.array_min(drugs).alias("drug_least"), F.array_max(drugs).alias("drug_most"),
    )


def _codes(name: Column, e: Column) -> Column:
    """struct(loinc, icd, drug, alias): what each strategy finds."""
    some = e["n"] > 0
    loinc_code = F.when(some & (e["least"] == e["most"]) & e["least"].isin(*(x[0] for x in LOINC)), e["least"])
    icd_code = F.when(some & e["icd_all"], e["icd"])
    hinted = F.lit(False)
    for hint in DRUG_HINTS:
        hinted = hinted | F.contains(name, F.lit(hint))
    drug = F.when(some & hinted & e["drug_all"] & (e["drug_least"] == e["drug_most"]), e["drug_least"])
    codes = alias_codes(name)
    alias = bind(codes, lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))))
    return F.struct(loinc_code.alias("loinc"), icd_code.alias("icd"), drug.alias("drug"), alias.alias("alias"))


def _verdict(found: Column) -> Column:
    """The first strategy's find as a verdict."""
    loinc_code, icd_code, drug, alias = (found[c] for c in ("loinc", "icd", "drug", "alias"))

    def field(at: int, code: Column) -> Column:
        return F.try_element_at(_entries([(x[0], x[at]) for x in LOINC if x[at]]), code)

    def verdict(canonical: Column, kind: Column, unit: Column, registry: str, code: Column, on: str) -> Column:
        return F.struct(canonical.alias("canonical_name"), kind.alias("data_type"), unit.cast("string").alias("unit"), F.lit(registry).alias("registry"), code.alias("code"), F.lit(on).alias("matched_on"))

    none = F.lit(None)
    return (
        F.when(loinc_code.isNotNull(), verdict(field(1, loinc_code), field(3, loinc_code), field(2, loinc_code), "LOINC", loinc_code, "sample_value_code"))
        .when(icd_code.isNotNull(), verdict(F.try_element_at(_entries(list(ICD10)), icd_code), F.lit("coded_value"), none, "ICD-10", icd_code, "sample_value_code"))
        .when(drug.isNotNull(), verdict(F.lit("drug_name"), F.lit("text"), none, "RxNorm", drug, "sample_value_code"))
        .when(alias.isNotNull(), verdict(field(1, alias), field(3, alias), field(2, alias), "LOINC", alias, "column_name"))
    )


def loinc_aliases(spark: SparkSession) -> DataFrame:
    """alias, code, canonical_name."""
    return spark.createDataFrame([(a.replace("-", "_").replace(" ", "_"), x[0], x[1]) for x in LOINC for a in x[4]], "alias string, code string, canonical_name string")


def drug_names(spark: SparkSession) -> DataFrame:
    """key (code, name or brand in lower case), drug, drug_class."""
    return spark.createDataFrame([(k, x[1], x[2]) for x in RXNORM for k in (x[0], x[1], x[3].lower())], "key string, drug string, drug_class string")
