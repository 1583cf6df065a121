"""Rule extractors over content items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.doctree import with_synthetic
from loomspan.functions.text import truncate
from loomspan.operators.doctree import first_wins
from loomspan.terms import annex_slug

OUT = ("uri_suffix", "type", "label", "summary", "paragraph_ref", "parent_artefact", "sector_slug", "is_biometric", "tbox_individual", "source_kind", "rule_id")


@dataclass(frozen=True)
class AnnexRule:
    rule_id: str
    annex: str
    type: str
    prefix: str
    parent: str
    least: int = 30


#: Which annexes hold which components.
ANNEX_RULES = (
    AnnexRule("annex_iv_components", "IV", "DocumentationComponent", "documentation_component", "TechnicalDocumentation_Annex_IV", 0),
    AnnexRule("annex_viii_fields", "VIII", "RegistrationField", "registration_field", "RegistrationRecord_Annex_VIII"),
    AnnexRule("annex_ix_fields", "IX", "TestingPlanField", "testing_plan_field", "TestingPlan_Annex_IX"),
    AnnexRule("annex_vii_steps", "VII", "ConformityAssessmentStep", "conformity_step", "ThirdPartyAssessment_Annex_VII"),
    AnnexRule("annex_vi_steps", "VI", "ConformityAssessmentStep", "conformity_step", "InternalControl_Annex_VI"),
)
#: The eight areas with their labels and summaries, and the requirements of notified bodies.
AREAS = (
    ("biometrics", "Biometrics", "Remote biometric identification, biometric categorisation by sensitive attributes, and emotion recognition systems."),
    ("critical_infrastructure", "Critical infrastructure", "Safety components in the management and operation of critical digital infrastructure, road traffic, and the supply of water, gas, heating and electricity."),
    ("education", "Education and vocational training", "AI used to determine access, admission, evaluation of learning outcomes, assessing appropriate level of education, or monitoring prohibited behaviour during tests."),
    ("employment", "Employment, workers management and access to self-employment", "Recruitment, selection, decisions affecting terms of work, promotion, termination, task allocation based on individual behaviour or traits, and monitoring/evaluation of performance."),
    ("essential_services", "Access to and enjoyment of essential private and public services", "Eligibility for public assistance benefits, creditworthiness evaluation, risk assessment and pricing in life and health insurance, and emergency call dispatch and triage."),
    ("law_enforcement", "Law enforcement", "Risk assessment of natural persons, polygraphs, evidence reliability assessment, profiling, and crime analytics."),
    ("migration", "Migration, asylum and border control management", "Polygraphs, risk assessments, examination of applications for asylum/visa/residence, and detection/recognition of natural persons at borders."),
    ("justice", "Administration of justice and democratic processes", "AI assisting judicial authorities in researching and interpreting facts and the law, and AI intended to influence the outcome of an election or voting behaviour."),
)
REQUIREMENTS = ("Organisational", "QualityManagement", "Resource", "Process", "Cybersecurity", "Independence", "Objectivity", "Impartiality", "ProfessionalIntegrity", "Competence", "Confidentiality", "LiabilityInsurance")


def _shaped(df: DataFrame) -> DataFrame:
    for c in OUT:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("boolean" if c in ("is_biometric", "tbox_individual") else "string"))
    return df.select(*OUT)


def annex_rule(items: DataFrame, rule: AnnexRule) -> DataFrame:
    """Components from an annex's items: a number, a label or enough text, no headings, one a reference."""
    own = items.where(F.upper("unit") == rule.annex).withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    own = own.where(~F.lower("text").startswith("section "))
    own = own.where((F.col("paragraph_number").isNotNull()) | F.col("list_label").isNotNull() | (F.length("text") >= max(rule.least, 1)))
    one = first_wins(own, ["reference"], ["pos"])
    return _shaped(one.select(F.concat(F.lit(rule.prefix + "_"), annex_slug(F.col("reference"))).alias("uri_suffix"), F.lit(rule.type).alias("type"), truncate(F.col("text")).alias("summary"), F.col("reference").alias("paragraph_ref"), F.lit(rule.parent).alias("parent_artefact"), F.lit("rule").alias("source_kind"), F.lit(rule.rule_id).alias("rule_id")))


def lettered_rule(items: DataFrame, article: int, paragraph: str, letters: str, type_: str, prefix: str, rule_id: str, size: int = 400) -> DataFrame:
    """Points of one article paragraph whose label is one of the letters, the first of each."""
    own = items.where((F.col("unit").cast("int") == article) & (F.col("paragraph_number") == paragraph) & F.col("list_label").rlike(f"^[{letters}]$"))
    one = first_wins(own, ["list_label"], ["pos"])
    return one.select("list_label", F.concat(F.lit(prefix), F.col("list_label")).alias("uri_suffix"), F.lit(type_).alias("type"), truncate(F.trim("text"), size).alias("summary"), F.col("reference").alias("paragraph_ref"), F.lit("rule").alias("source_kind"), F.lit(rule_id).alias("rule_id"))


def prohibited_practices(items: DataFrame) -> DataFrame:
    got = lettered_rule(items, 5, "1", "A-Ha-h", "ProhibitedPractice", "prohibited_practice_art5_1_", "article_5_practices", 800)
    bio = F.col("list_label") == "h"
    label = F.concat(F.lit("Article 5(1)("), F.col("list_label"), F.lit(") prohibited practice"), F.when(bio, " — real-time remote biometric identification").otherwise(""))
    return _shaped(got.withColumn("is_biometric", bio).withColumn("label", label).drop("list_label"))


def risk_controls(items: DataFrame) -> DataFrame:
    return _shaped(lettered_rule(items, 14, "4", "A-Za-z", "RiskControl", "risk_control_art14_4_", "article_14_risk_controls").drop("list_label"))


def areas(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(AREAS), "sector_slug string, label string, summary string")
    return _shaped(rows.select(F.concat(F.lit("area_of_application_"), "sector_slug").alias("uri_suffix"), F.lit("AreaOfApplication").alias("type"), "label", "summary", "sector_slug", F.lit("Annex III").alias("paragraph_ref"), F.lit("rule").alias("source_kind"), F.lit("annex_iii_sectors").alias("rule_id")))


def requirements(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(r + "Requirement",) for r in REQUIREMENTS], "uri_suffix string")
    return _shaped(rows.select("uri_suffix", F.lit("Requirement").alias("type"), F.lit("Article 31").alias("paragraph_ref"), F.lit(True).alias("tbox_individual"), F.lit("rule").alias("source_kind"), F.lit("notified_body_requirements").alias("rule_id")))


def extract_all(article_items: DataFrame, annex_items: DataFrame, annexes: DataFrame | None = None) -> DataFrame:
    """All rules over content items; annexes (unit, text), if given, serve those that have no items."""
    spark = article_items.sparkSession
    annex_items = annex_items if annexes is None else with_synthetic(annex_items, annexes)
    out = areas(spark).unionByName(requirements(spark)).unionByName(prohibited_practices(article_items)).unionByName(risk_controls(article_items))
    for rule in ANNEX_RULES:
        out = out.unionByName(annex_rule(annex_items, rule))
    return out


def summary(instances: DataFrame) -> DataFrame:
    """(by, name, n): counts by rule and by type, and the total."""
    rule = instances.groupBy(F.col("rule_id").alias("name")).agg(F.count("*").alias("n")).withColumn("by", F.lit("rule"))
    kind = instances.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("by", F.lit("type"))
    return rule.unionByName(kind).unionByName(instances.agg(F.count("*").alias("n")).select(F.lit("total").alias("name"), "n", F.lit("total").alias("by"))).select("by", "name", "n")
