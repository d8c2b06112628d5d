"""Clinical frames over the driver's tables: customers are patients, orders their drugs, events the decision log.

- patient: a customer with orders; index is the first order, last seen the last; deceased if the last order's status is F.
- administration: an order; its drug is the priority, it ends with its last shipment.
- progression: an order of status P.
- decision: an event; subject is the user, column the event's type.
- note: a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalspark.session import table


def patients(spark: SparkSession, folder: str) -> DataFrame:
    """patient_id, dates as text, vital_status, age_at_advanced_diagnosis, and the customer's columns."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    per = orders.groupBy("o_custkey").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.max_by("o_orderstatus", F.struct("day", "o_orderkey")).alias("status"))
    customers = table(spark, folder, "customer")
    dead = F.col("status") == "F"
    return per.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("patient_id"), F.col("first").cast("string").alias("advanced_diagnosis_date"), F.when(dead, "deceased").otherwise("alive").alias("vital_status"),
        F.when(dead, F.col("last").cast("string")).alias("date_of_death"), F.col("last").cast("string").alias("last_known_alive_date"), (20 + F.col("o_custkey") % 60).cast("string").alias("age_at_advanced_diagnosis"),
        "c_name", "c_nationkey", "c_mktsegment", "c_acctbal",
    )


def administrations(spark: SparkSession, folder: str) -> DataFrame:
    """patient_id, drug, start, end, drug_class."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("start"))
    shipped = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("ship"))
    rows = orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(F.col("o_custkey").alias("patient_id"), F.lower(F.trim("o_orderpriority")).alias("drug"), "start", F.greatest(F.coalesce("ship", "start"), "start").alias("end"), F.lit(None).cast("string").alias("drug_class"))


def progressions(spark: SparkSession, folder: str) -> DataFrame:
    """patient_id, date."""
    return table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("patient_id"), F.to_date("o_orderdate").alias("date"))


def deaths(spark: SparkSession, folder: str) -> DataFrame:
    """patient_id, death_date of the deceased."""
    return patients(spark, folder).where("vital_status = 'deceased'").select("patient_id", F.col("date_of_death").cast("date").alias("death_date"))


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """workspace_key, pkey, source, source_column, decided_by, verdict, canonical_name, similarity_score, decided_at, id."""
    by = {"view": "lookup", "click": "llm", "purchase": "normalizer", "signup": "haiku", "error": "operator"}
    verdict = F.when(F.col("event_type") == "signup", "append").when(F.col("event_type") == "error", "unclear").otherwise("join")
    who = F.create_map(*(F.lit(x) for p in by.items() for x in p))[F.col("event_type")]
    return table(spark, folder, "events").select(
        F.lit("default").alias("workspace_key"), F.col("user_id").alias("pkey"), F.lit("events").alias("source"), F.col("event_type").alias("source_column"), who.alias("decided_by"), verdict.alias("verdict"),
        F.upper("event_type").alias("canonical_name"), F.col("value").alias("similarity_score"), F.col("ts").alias("decided_at"), F.col("event_id").alias("id"),
    )


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """pkey, source, occurred_at, id, k (a number in JSON)."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, folder, "events").select(F.col("user_id").alias("pkey"), F.col("event_type").alias("source"), F.col("ts").alias("occurred_at"), F.col("event_id").alias("id"), k.alias("k"), "value")


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """patient_id, note_order, text: a document made to a note by adding a line from its number, so that every rule has finds."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # a file of one row group is one task
        docs = docs.repartition(spark.sparkContext.defaultParallelism)
    i = F.col("doc_id")
    pick = lambda *xs, by=1: F.element_at(F.array(*map(F.lit, xs)), (F.floor(i / by) % len(xs) + 1).cast("int"))
    line = F.concat(
        F.lit("\nAdvanced "), pick("adenocarcinoma", "squamous cell carcinoma", "lung cancer"), F.lit(", stage "), pick("IVA", "IIIB", "II", by=2), F.lit(". ECOG performance status: "), (i % 6).cast("string"),
        F.lit(". EGFR: "), pick("positive", "negative", "not tested", by=3), F.lit("; ALK negative. "), pick("exon 19 deletion", "L858R", "KRAS G12C seen", by=5), F.lit(". PD-L1: "), pick("high", "low", "n/a", by=7),
        F.lit(" (TPS "), (i % 100).cast("string"), F.lit(".5%). "), pick("progression documented on 2021-03-04 with new involvement at: bone, liver", "stable disease", by=4), F.lit(". Given "), pick("carboplatin and pemetrexed", "nab-paclitaxel", "osimertinib", by=11), F.lit("."),
    )
    return docs.select((i % 97).alias("patient_id"), i.alias("note_order"), F.concat(F.coalesce("text", F.lit("")), line).alias("text"))


def ranked_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with each one's number in its customer's order of time."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, folder, "orders").withColumn("n", F.row_number().over(order))


def _files(rows: DataFrame, text: str) -> DataFrame:
    """name, text, format, told from the name or the text, of texts as if they were files."""
    from vitalspark.sources.files import detect

    rows = rows.select("name", F.col(text).alias("text"))
    return rows.withColumn("format", detect(F.col("name"), F.col("text")))


def _chart(spark: SparkSession, folder: str, part: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Patients (customers whose number leaves `part` modulo 3), and their orders as conditions, observations and medications."""
    who = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate").cast("string")
    pick = lambda by, *xs: F.get(F.array(*map(F.lit, xs)), (by % len(xs)).cast("int"))
    rank = F.floor(k / 4)
    orders = table(spark, folder, "orders").where(F.col("o_custkey") % 3 == part)
    people = table(spark, folder, "customer").where(F.col("c_custkey") % 3 == part)
    patients = people.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("patient_id"), pick(F.col("c_custkey"), "male", "female").alias("sex"), F.concat(F.lit("19"), F.lpad((F.col("c_custkey") % 90 + 10).cast("string"), 2, "0"), F.lit("-03-04")).alias("date_of_birth"))
    conditions = orders.where(k % 4 == 1).select(k.cast("string").alias("condition_id"), who.alias("patient_id"), pick(rank, "C34.1", "C34.90", "J18.9").alias("condition_code"), pick(rank, "adenocarcinoma", "squamous | cell ^ type").alias("histology"), day.alias("onset_date"))
    observations = orders.where(k % 4 == 2).select(k.cast("string").alias("observation_id"), who.alias("patient_id"), pick(rank, "718-7", "2160-0", "99999-1").alias("loinc_code"), pick(rank, "Hemoglobin", "Creatinine", "Odd, \"new\" test").alias("display"), day.alias("observation_date"), (k % 9).cast("int").alias("value"), F.lit("g/dL").alias("unit"))
    medications = orders.where(k % 4 == 3).select(k.cast("string").alias("medication_id"), who.alias("patient_id"), pick(rank, "40048", None).alias("rxnorm_code"), pick(rank, "Keytruda", "Unknownib").alias("display"), day.alias("start_date"), day.alias("end_date"))
    return patients, conditions, observations, medications


def bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a bundle for each patient of the first third."""
    from vitalspark.sources import sinks

    return _files(sinks.bundles(*_chart(spark, folder, 0)).withColumn("name", F.concat("patient_id", F.lit(".json"))), "bundle")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Files of HL7 messages of the second third, told by their first characters."""
    from vitalspark.sources import sinks

    return _files(sinks.hl7_messages(*_chart(spark, folder, 1)).withColumn("name", F.concat("patient_id", F.lit(".txt"))), "message")


def extracts(spark: SparkSession, folder: str) -> DataFrame:
    """A flat extract for each nation of the last third: a line for each observation and medication, in order of their ids, texts in quotes."""
    _, _, observations, medications = _chart(spark, folder, 2)
    quoted = F.concat(F.lit('"'), F.replace("display", F.lit('"'), F.lit('""')), F.lit('"'))
    lines = observations.select("patient_id", F.col("observation_id").cast("long").alias("id"), F.concat_ws(",", "patient_id", "loinc_code", quoted, F.lit(""), F.lit(""), F.lit('"large\ncell"'), F.lit(""), "observation_date").alias("line"))
    lines = lines.union(medications.select("patient_id", F.col("medication_id").cast("long"), F.concat_ws(",", "patient_id", F.lit(""), quoted, F.coalesce("rxnorm_code", F.lit("")), F.lit("C34.2"), F.lit(""), "start_date", F.lit(""))))
    nation = table(spark, folder, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("patient_id"), "c_nationkey")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\r\n")
    files = lines.join(nation, "patient_id").groupBy("c_nationkey").agg(F.concat(F.lit("Patient_ID,loinc_code,display,rxnorm_code,icd10_code,histology,start_date,observation_date\n"), body).alias("text"))
    return _files(files.withColumn("name", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))), "text")
