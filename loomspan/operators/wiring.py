"""Extraction records to triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.text import article_reference, clamp, parse_reference
from loomspan.operators.graphs import merge
from loomspan.terms import LABEL, RDFS, TYPE, XSD, construct, iri, literal, paragraph_name, safe_suffix, term_struct, triples

COMMENT = RDFS + "comment"
#: Names of types in this vocabulary, of types in others, aliases, and names that are turned away.
OWN_TYPES = (
    "ConformityAssessmentObligation",
    "InternalControlObligation",
    "ThirdPartyAssessmentObligation",
    "TransparencyObligation",
    "PostMarketMonitoringObligation",
    "WorkerNotificationObligation",
    "FRIAObligation",
    "ProviderIncidentReport",
    "DeployerIncidentReport",
    "GPAISystemicRiskIncidentReport",
    "IncidentReportingObligation",
    "GeneralGPAIObligation",
    "SystemicRiskGPAIObligation",
    "GPAIObligation",
    "SupportMeasureObligation",
    "OversightPower",
    "InvestigativePower",
    "EnforcementPower",
    "AdvisoryPower",
    "NecessityCondition",
    "ProportionalityCondition",
    "ProceduralCondition",
    "PurposeCondition",
    "CEMarking",
    "AreaOfApplication",
    "DocumentationComponent",
    "RegistrationField",
    "ConformityAssessmentStep",
    "TestingPlanField",
    "CEMarkingComponent",
    "Requirement",
)
AIRO, AIACT, DPV = "https://w3id.org/airo#", "https://w3id.org/dpv/legal/eu/aiact#", "https://w3id.org/dpv#"
#: Types that other vocabularies name.
OTHER_TYPES = {
    "ProhibitedPractice": AIACT + "ProhibitedPractice",
    "TechnicalDocumentation": AIACT + "TechnicalDocumentation",
    "RiskControl": AIRO + "RiskControl",
    "AIRegulatorySandbox": AIACT + "AIRegulatorySandbox",
    "NaturalPersonSubject": DPV + "NaturalPerson",
}
#: Other names of types.
ALIASES = {
    "proceeduralcondition": "ProceduralCondition",
    "supportmeasuresobligation": "SupportMeasureObligation",
    "supportmeasureobligations": "SupportMeasureObligation",
    "naturalperson": "NaturalPersonSubject",
    "natural person": "NaturalPersonSubject",
    "naturalpersonsubject": "NaturalPersonSubject",
    "documentation": "TechnicalDocumentation",
    "technicaldocumentation": "TechnicalDocumentation",
    "riskcontrol": "RiskControl",
    "risk control": "RiskControl",
    "prohibitedpractice": "ProhibitedPractice",
    "prohibited practice": "ProhibitedPractice",
    "airegulatorysandbox": "AIRegulatorySandbox",
    "ai regulatory sandbox": "AIRegulatorySandbox",
    "regulatory sandbox": "AIRegulatorySandbox",
    "cemarking": "CEMarking",
    "ce marking": "CEMarking",
    "areaofapplication": "AreaOfApplication",
    "area of application": "AreaOfApplication",
    "documentationcomponent": "DocumentationComponent",
    "registrationfield": "RegistrationField",
    "conformityassessmentstep": "ConformityAssessmentStep",
    "testingplanfield": "TestingPlanField",
    "cemarkingcomponent": "CEMarkingComponent",
    "requirement": "Requirement",
}
SINGLETONS = {"AIRegulatorySandbox": "AIRegulatorySandboxInstance", "TechnicalDocumentation": "TechnicalDocumentation_Annex_IV"}
#: The individuals that stand for roles, who bears a type of obligation or power, and to whom a report goes.
PROVIDER, DEPLOYER, SME, OFFICE, SURVEILLANCE = "ProviderStakeholder", "DeployerStakeholder", "SMEStakeholder", "AIOffice", "MarketSurveillanceAuthority"
MODEL, RISKY_MODEL, SANDBOX, BODY = "GPAIModelInstance", "GPAISystemicRiskModelInstance", "AIRegulatorySandboxInstance", "NotifiedBody_Demo"
BEARERS = {
    "ConformityAssessmentObligation": (PROVIDER,),
    "InternalControlObligation": (PROVIDER,),
    "ThirdPartyAssessmentObligation": (PROVIDER,),
    "TransparencyObligation": (PROVIDER,),
    "PostMarketMonitoringObligation": (PROVIDER,),
    "ProviderIncidentReport": (PROVIDER,),
    "IncidentReportingObligation": (PROVIDER,),
    "GeneralGPAIObligation": (PROVIDER, MODEL),
    "GPAIObligation": (PROVIDER, MODEL),
    "SystemicRiskGPAIObligation": (PROVIDER, RISKY_MODEL),
    "GPAISystemicRiskIncidentReport": (PROVIDER, RISKY_MODEL),
    "WorkerNotificationObligation": (DEPLOYER,),
    "FRIAObligation": (DEPLOYER,),
    "DeployerIncidentReport": (DEPLOYER,),
    "SupportMeasureObligation": (SME, PROVIDER),
    "OversightPower": (OFFICE,),
    "InvestigativePower": (OFFICE,),
    "EnforcementPower": (OFFICE,),
    "AdvisoryPower": (OFFICE,),
}
REPORT_TARGETS = {"GPAISystemicRiskIncidentReport": OFFICE, "ProviderIncidentReport": SURVEILLANCE, "DeployerIncidentReport": SURVEILLANCE}


def type_table(spark: SparkSession, ns: str) -> DataFrame:
    """(name, canonical, iri): exact names, and aliases in lower case."""
    own = {t: ns + t for t in OWN_TYPES} | OTHER_TYPES
    rows = [(t, t, i, True) for t, i in own.items()] + [(a, t, own[t], False) for a, t in ALIASES.items()]
    return spark.createDataFrame(rows, "name string, canonical string, iri string, exact boolean")


def mapped_types(instances: DataFrame, ns: str) -> DataFrame:
    """instances with canonical and type_iri; rows with an unknown type go. The mapping is a constant of some sixty rows."""
    t = type_table(instances.sparkSession, ns)
    exact = F.broadcast(t.where("exact").select(F.col("name").alias("type"), F.col("canonical").alias("c1"), F.col("iri").alias("i1")))
    folded = F.broadcast(t.where("not exact").select(F.col("name").alias("_f"), F.col("canonical").alias("c2"), F.col("iri").alias("i2")))
    out = instances.join(exact, "type", "left").withColumn("_f", F.lower(F.trim("type"))).join(folded, "_f", "left")
    out = out.withColumn("canonical", F.coalesce("c1", "c2")).withColumn("type_iri", F.coalesce("i1", "i2"))
    return out.where("canonical is not null").drop("_f", "c1", "c2", "i1", "i2")


def reference_targets(ref: Column, ns: str) -> tuple[Column, Column]:
    """(article iri, annex iri) that a reference names; null if it names none."""
    r = parse_reference(ref)
    return F.concat(F.lit(ns + "Article_"), r["article"].cast("string")), F.concat(F.lit(ns + "Annex_"), r["annex"])


def paragraph_target(ref: Column, ns: str) -> Column:
    """The paragraph's iri, for a reference that names an article's paragraph; else null."""
    r = parse_reference(ref)
    return F.when(r["paragraph"].isNotNull(), F.concat(F.lit(ns), paragraph_name(article_reference(r["article"], r["paragraph"], r["label"]))))


def structural_triples(articles: DataFrame, items: DataFrame, annexes: DataFrame, ns: str, repeats: bool = False) -> DataFrame:
    """Articles (number, title, source_path), their items (unit, reference, text) and annexes (number, title). Without a title there is no label; items without reference or text go."""
    number = F.col("number").cast("string")
    a, x = F.concat(F.lit(ns + "Article_"), number), F.concat(F.lit(ns + "Annex_"), number)
    named = lambda kind: F.when(F.col("title") != "", F.concat(F.lit(kind), number, F.lit(" — "), F.col("title")))
    p = F.concat(F.lit(ns), paragraph_name(F.col("reference")))
    of = F.concat(F.lit(ns + "Article_"), F.col("unit").cast("string"))
    full = items.where("coalesce(reference, '') <> '' and coalesce(text, '') <> ''")
    return merge(
        construct(articles, term_struct(a, TYPE, F.lit(ns + "Article"), "iri"), term_struct(a, LABEL, named("Article "), lang="en"), term_struct(a, ns + "hasSourceURL", F.col("source_path"), dt=XSD + "string"), repeats=True),
        construct(annexes, term_struct(x, TYPE, F.lit(ns + "Annex"), "iri"), term_struct(x, LABEL, named("Annex "), lang="en"), repeats=True),
        construct(full, term_struct(p, TYPE, F.lit(ns + "Paragraph"), "iri"), term_struct(p, LABEL, F.col("reference"), lang="en"), term_struct(p, ns + "hasSummary", F.col("text"), dt=XSD + "string"), term_struct(of, ns + "hasParagraphReference", p, "iri"), repeats=True),
        repeats=repeats,
    )


def rule_triples(instances: DataFrame, ns: str, repeats: bool = False) -> DataFrame:
    """Rule instances with type, label, summary, references and links to their parent both ways.

    A requirement is an individual of the schema: the notified body meets it and
    nothing else is said. An area is named by its sector and refers to Annex III.
    """
    t = mapped_types(instances, ns)
    area = F.col("canonical") == "AreaOfApplication"
    s = F.concat(F.lit(ns), F.when(area, F.concat(F.lit("AreaOfApplication_"), F.coalesce("sector_slug", F.regexp_replace("uri_suffix", "area_of_application_", "")))).otherwise(safe_suffix(F.col("uri_suffix"))))
    t = t.withColumn("s", s)
    needs, rest = t.where("canonical = 'Requirement'"), t.where("canonical <> 'Requirement'")
    article, annex = reference_targets(F.col("paragraph_ref"), ns)
    parent = F.when(F.col("canonical").isin("DocumentationComponent", "RegistrationField", "TestingPlanField", "ConformityAssessmentStep"), F.concat(F.lit(ns), F.col("parent_artefact")))
    s = F.col("s")
    made = construct(
        rest,
        term_struct(s, TYPE, F.col("type_iri"), "iri"),
        term_struct(s, LABEL, F.coalesce("label", F.when(area, F.col("sector_slug")).otherwise(safe_suffix(F.col("uri_suffix")))), lang="en"),
        term_struct(s, ns + "hasSummary", F.when(area, F.coalesce("summary", F.lit(""))).otherwise(F.nullif("summary", F.lit(""))), dt=XSD + "string"),
        term_struct(s, ns + "hasArticleReference", F.when(~area, article), "iri"),
        term_struct(s, ns + "hasParagraphReference", F.when(~area, paragraph_target(F.col("paragraph_ref"), ns)), "iri"),
        term_struct(s, ns + "hasAnnexReference", F.when(area, F.lit(ns + "Annex_III")).otherwise(annex), "iri"),
        term_struct(parent, ns + "hasRequiredComponent", F.when(parent.isNotNull(), s), "iri"),
        term_struct(s, ns + "hasComponentOf", parent, "iri"),
        repeats=True,
    )
    return merge(made, construct(needs, term_struct(F.lit(ns + BODY), ns + "meetsRequirement", F.concat(F.lit(ns), F.col("uri_suffix")), "iri"), repeats=True), repeats=repeats)


def system_names(areas: DataFrame, ns: str) -> DataFrame:
    """(s, area, label) of the high-risk system of each area; areas are a constant of eight."""
    return areas.select(F.concat(F.lit(ns + "HighRiskAISystem_"), F.col("sector_slug")).alias("s"), F.concat(F.lit(ns + "AreaOfApplication_"), F.col("sector_slug")).alias("area"), "label")


def paired_systems(areas: DataFrame, controls: DataFrame, obligations: DataFrame, ns: str, most_areas: int = 64, repeats: bool = False) -> DataFrame:
    """One high-risk system for each area, joined to every control and every transparency obligation, by design all with all; more than most_areas areas raise."""
    base = system_names(areas, ns)
    if len(base.select("s").distinct().take(most_areas + 1)) > most_areas:
        raise ValueError("areas are a short list; every one is joined to every obligation")
    s = F.col("s")
    to = lambda p, name: term_struct(s, p, F.lit(name), "iri")
    own = construct(
        base, to(TYPE, AIACT + "HighRiskAISystem"), to(TYPE, AIRO + "AISystem"), term_struct(s, LABEL, F.concat(F.lit("High-risk AI system in "), F.col("label")), lang="en"), to(ns + "hasRiskLevel", ns + "HighRisk"),
        term_struct(s, ns + "hasAreaOfApplication", F.col("area"), "iri"), to(ns + "hasProvider", ns + PROVIDER), to(ns + "hasDeployer", ns + DEPLOYER), to(AIRO + "hasDocumentation", ns + "TechnicalDocumentation_Annex_IV"),
        to(AIRO + "hasAISubject", ns + "NaturalPersonSubject"), to(ns + "hasArticleReference", ns + "Article_6"), repeats=True,
    )
    small = F.broadcast(base.select("s").distinct())
    c = controls.select(F.concat(F.lit(ns), safe_suffix(F.col("uri_suffix"))).alias("o")).distinct().crossJoin(small)
    o = obligations.select(F.concat(F.lit(ns), safe_suffix(F.col("uri_suffix"))).alias("o")).distinct().crossJoin(small)
    return merge(own, construct(c, term_struct(s, AIRO + "hasRiskControl", F.col("o"), "iri"), repeats=True), construct(o, term_struct(s, ns + "hasObligation", F.col("o"), "iri"), repeats=True), repeats=repeats)


def named_instances(instances: DataFrame, ns: str) -> DataFrame:
    """Model instances with canonical, type_iri, s, and own (false for the types that one anchor stands for). Rows without type or suffix, or with an unknown type, go."""
    t = mapped_types(instances.where("trim(coalesce(type, '')) <> '' and trim(coalesce(uri_suffix, '')) <> ''"), ns)
    t = t.withColumn("uri_suffix", F.trim("uri_suffix"))
    anchor = F.lit(None).cast("string")
    for kind, name in SINGLETONS.items():
        anchor = F.when(F.col("canonical") == kind, F.lit(ns + name)).otherwise(anchor)
    t = t.withColumn("_a", anchor)
    return t.withColumn("s", F.coalesce("_a", F.concat(F.lit(ns), safe_suffix(F.col("uri_suffix"))))).withColumn("own", F.col("_a").isNull()).drop("_a")


def model_triples(instances: DataFrame, ns: str, biometric: str | None = None, repeats: bool = False) -> DataFrame:
    """Model instances (uri_suffix, type, summary, paragraph_ref, source_article int, source_annex string, cq_targets, evidence_text).

    Singleton types add their summary to the anchor alone. The article comes
    from the parsed reference, else from the source, and so does the annex, each
    by itself. ``biometric`` is the name of the practice that conditions of
    Article 5 belong to.
    """
    t = named_instances(instances, ns)
    s, own = F.col("s"), F.col("own")
    article, annex = reference_targets(F.col("paragraph_ref"), ns)
    article = F.when(own, F.coalesce(article, F.concat(F.lit(ns + "Article_"), F.col("source_article").cast("string"))))
    annex = F.when(own, F.coalesce(annex, F.concat(F.lit(ns + "Annex_"), F.upper("source_annex"))))
    summary, evidence = F.nullif(F.trim("summary"), F.lit("")), clamp(F.col("evidence_text"))
    base = construct(
        t, term_struct(s, TYPE, F.when(own, F.col("type_iri")), "iri"), term_struct(s, LABEL, F.when(own, F.col("uri_suffix")), lang="en"), term_struct(s, ns + "hasSummary", summary, dt=XSD + "string"),
        term_struct(s, ns + "hasArticleReference", article, "iri"), term_struct(s, ns + "hasParagraphReference", F.when(own, paragraph_target(F.col("paragraph_ref"), ns)), "iri"), term_struct(s, ns + "hasAnnexReference", annex, "iri"),
        term_struct(s, COMMENT, F.when(own & (F.length(evidence) > 0), F.concat(F.lit("evidence: "), evidence)), lang="en"), repeats=True,
    )
    goals = construct(t.where(own).select("s", F.explode("cq_targets").alias("cq")), term_struct(s, COMMENT, F.concat(F.lit("cq_target: "), F.col("cq")), lang="en"), repeats=True)
    return merge(base, goals, role_triples(t.where(own), ns, repeats=True), article_range_triples(t.where(own), ns, biometric, repeats=True), repeats=repeats)


def role_triples(typed: DataFrame, ns: str, repeats: bool = False) -> DataFrame:
    """Bearers and reporting targets by canonical type, from constant tables; typed has s and canonical."""
    spark = typed.sparkSession
    bearers = spark.createDataFrame([(k, b) for k, names in BEARERS.items() for b in names], "canonical string, bearer string")
    targets = spark.createDataFrame(list(REPORT_TARGETS.items()), "canonical string, target string")
    b = typed.select("s", "canonical").join(F.broadcast(bearers), "canonical")
    r = typed.select("s", "canonical").join(F.broadcast(targets), "canonical")
    link = F.when(F.col("canonical").endswith("Power"), ns + "hasPower").otherwise(ns + "hasObligation")
    made = construct(b, term_struct(F.concat(F.lit(ns), F.col("bearer")), link, F.col("s"), "iri"), repeats=True)
    return merge(made, construct(r, term_struct(F.col("s"), ns + "hasReportingTarget", F.concat(F.lit(ns), F.col("target")), "iri"), repeats=True), repeats=repeats)


def article_range_triples(typed: DataFrame, ns: str, biometric: str | None = None, repeats: bool = False) -> DataFrame:
    """Conditions wired by the article of their reference or of their source: 57 to 63 to the sandbox, 51 to the model with systemic risk, 5 to the biometric practice, if there is one."""
    named, source = parse_reference(F.col("paragraph_ref"))["article"], F.col("source_article")
    within = lambda low, high: F.coalesce(named.between(low, high), F.lit(False)) | F.coalesce(source.between(low, high), F.lit(False))
    none = F.lit(None).cast("string")
    rules = F.array(F.when(within(57, 63), ns + SANDBOX), F.when(within(51, 51), ns + RISKY_MODEL), F.when(within(5, 5), F.lit(ns + biometric)) if biometric else none)
    rows = typed.where(F.col("canonical").endswith("Condition")).select("s", F.explode(rules).alias("of"))
    return construct(rows, term_struct(F.col("of"), ns + "hasCondition", F.col("s"), "iri"), repeats=repeats)


#: What an enrichment may say, and its datatypes.
ENRICHMENTS = {"hasDeadline": "literal", "hasFine": "literal", "hasMaximumFineRatio": "literal", "hasArticleReference": "iri", "cites": "iri"}
DATATYPES = ("duration", "decimal", "string")


def enrichment_triples(records: DataFrame, known: DataFrame, ns: str, suffixes: DataFrame | None = None, repeats: bool = False, parts: int | None = None) -> DataFrame:
    """Enrichment records (subject, subject_type, predicate, object, object_datatype) as triples; a law that is named gets its stub once.

    A subject of type ``article`` is an article's name. Another is first looked
    up among suffixes (suffix, s), the names that model instances went by, then
    taken as a suffix that has a triple in known; the rest is passed over, as are
    other predicates. The records are looked up and written out in one pass,
    in ``parts`` partitions if the session's are fewer than it needs.
    """
    rows = records.where(F.col("predicate").isin(list(ENRICHMENTS)))
    article = F.coalesce(F.col("subject_type") == "article", F.lit(False))
    own = F.concat(F.lit(ns), safe_suffix(F.col("subject")))
    map_ = suffixes if suffixes is not None else records.sparkSession.createDataFrame([], "suffix string, s string")
    rows = rows.repartition(parts, "subject") if parts else rows
    rows = rows.join(map_.groupBy(F.col("suffix").alias("subject")).agg(F.max("s").alias("_mapped")), "subject", "left")
    # rows that need no second look get a key that no name is, each its own, as nulls would all meet in one task
    rows = rows.withColumn("_own", F.when(article | F.col("_mapped").isNotNull(), F.concat(F.lit("\0"), F.coalesce("subject", F.lit("")), F.lit("\0"), F.coalesce("object", F.lit("")))).otherwise(own))
    rows = rows.repartition(parts, "_own") if parts else rows
    rows = rows.join(known.select(F.col("s").alias("_own")).distinct().withColumn("_there", F.lit(True)), "_own", "left")
    s = F.when(article, F.concat(F.lit(ns), F.col("subject"))).otherwise(F.coalesce("_mapped", F.when(F.col("_there"), F.col("_own"))))
    ok = rows.withColumn("s", s).where("s is not null")
    p = F.concat(F.lit(ns), F.col("predicate"))
    value = F.col("predicate").isin([k for k, kind in ENRICHMENTS.items() if kind == "literal"])
    short = F.regexp_replace(F.coalesce("object_datatype", F.lit("string")), "^xsd:", "")
    dt = F.concat(F.lit(XSD), F.when(short.isin(*DATATYPES), short).otherwise("string"))
    to = F.concat(F.lit(ns), F.col("object"))
    said = F.struct(F.col("s").alias("s"), F.lit("iri").alias("s_kind"), p.alias("p"), F.when(value, F.col("object")).otherwise(to).alias("o"), F.when(value, "literal").otherwise("iri").alias("o_kind"), F.when(value, dt).alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    law = F.when(~value & F.col("object").like("Legislation\\_%"), to)
    number = F.regexp_replace("object", "Legislation_", "")
    return construct(ok, said, term_struct(law, TYPE, F.lit(ns + "EULegislation"), "iri"), term_struct(law, LABEL, F.concat(F.lit("EU legislation "), number), lang="en"), term_struct(law, ns + "hasCELEXNumber", number, dt=XSD + "string"), repeats=repeats)


def summary_triples(articles: DataFrame, annexes: DataFrame, ns: str) -> DataFrame:
    """Summaries (number, summary, source_url) of articles and annexes; empty ones are passed over and nothing new is named."""
    made = []
    for rows, kind in ((articles, "Article_"), (annexes, "Annex_")):
        s = F.concat(F.lit(ns + kind), F.col("number").cast("string"))
        full = rows.where("trim(coalesce(summary, '')) <> ''")
        made.append(construct(full, term_struct(s, ns + "hasSummary", F.col("summary"), dt=XSD + "string"), term_struct(s, ns + "hasSourceURL", F.col("source_url"), dt=XSD + "string")))
    return merge(*made)


#: The conditions that stand in where none was found: name, class, label, summary, article.
STUBS = {
    "biometric": ("necessity_condition_art5_biometric_stub", "NecessityCondition", "Strict necessity for law enforcement use", "Real-time remote biometric identification by law enforcement requires that the use is strictly necessary for one of the objectives listed in Article 5(1)(h).", "Article_5"),
    "model": ("proportionality_condition_art51_stub", "ProportionalityCondition", "GPAI systemic risk computational threshold (Article 51)", "A general-purpose AI model is presumed to have high impact capabilities — and thus systemic risk — when the cumulative amount of computation used for its training measured in floating point operations is greater than 10^25.", "Article_51"),
}


def backstops(instances: DataFrame, ns: str, biometric: str | None = None, repeats: bool = False) -> DataFrame:
    """The stub of Article 5 if there is a biometric practice and no condition names that article, and of Article 51 if none names that."""
    t = named_instances(instances, ns).where("own and endswith(canonical, 'Condition')")
    named, source = parse_reference(F.col("paragraph_ref"))["article"], F.col("source_article")
    seen = t.agg(*[F.coalesce(F.max(named.eqNullSafe(n) | source.eqNullSafe(n)), F.lit(False)).alias(k) for k, n in (("biometric", 5), ("model", 51))])
    parts = []
    for k, bearer in (("biometric", biometric), ("model", RISKY_MODEL)):
        if bearer:
            name, cls, label, summary, article = STUBS[k]
            s = F.lit(ns + name)
            parts.append(construct(seen.where(~F.col(k)), term_struct(s, TYPE, F.lit(ns + cls), "iri"), term_struct(s, LABEL, F.lit(label), lang="en"), term_struct(s, ns + "hasSummary", F.lit(summary), dt=XSD + "string"), term_struct(s, ns + "hasArticleReference", F.lit(ns + article), "iri"), term_struct(F.lit(ns + bearer), ns + "hasCondition", s, "iri"), repeats=True))
    return merge(*parts, repeats=repeats)


#: The individuals that a graph always has: name, classes, label.
ANCHORS = (
    (PROVIDER, (AIACT + "AIProvider",), "Generic AI provider stakeholder"),
    (DEPLOYER, (AIACT + "AIDeployer",), "Generic AI deployer stakeholder"),
    (OFFICE, (DPV + "Authority",), None),
    (SME, ("SMEProvider",), "SME provider stakeholder"),
    ("NaturalPersonSubject", (DPV + "NaturalPerson", AIRO + "AISubject"), "Generic natural person subject"),
    (MODEL, (AIACT + "GeneralPurposeAIModel", AIRO + "AISystem"), "Generic general-purpose AI model"),
    (RISKY_MODEL, ("GeneralPurposeAIModelWithSystemicRisk", AIACT + "GeneralPurposeAIModel", AIRO + "AISystem"), "Generic GPAI model with systemic risk"),
    (SANDBOX, (AIACT + "AIRegulatorySandbox",), "Generic AI regulatory sandbox"),
    ("TechnicalDocumentation_Annex_IV", (AIACT + "TechnicalDocumentation", AIRO + "Documentation"), "Annex IV technical documentation"),
    ("RegistrationRecord_Annex_VIII", (AIRO + "Documentation",), "Annex VIII registration record"),
    ("TestingPlan_Annex_IX", (AIRO + "Documentation",), "Annex IX real-world testing plan"),
    ("ThirdPartyAssessment_Annex_VII", (AIACT + "ConformityAssessment",), "Annex VII third-party conformity assessment procedure"),
    ("InternalControl_Annex_VI", (AIACT + "ConformityAssessment",), "Annex VI internal control conformity assessment procedure"),
    (SURVEILLANCE, (DPV + "Authority",), "National market surveillance authority"),
    (BODY, ("ConformityAssessmentBody", "NotifiedBody"), "Demonstration notified body (Article 31)"),
    ("HighRisk", ("RiskLevel",), "High risk"),
)
#: The articles and providers of anchors, and the annexes that they refer to where the text has them.
ANCHOR_LINKS = (
    (MODEL, "hasProvider", PROVIDER),
    (RISKY_MODEL, "hasProvider", PROVIDER),
    ("TechnicalDocumentation_Annex_IV", "hasArticleReference", "Article_11"),
    ("RegistrationRecord_Annex_VIII", "hasArticleReference", "Article_49"),
    ("TestingPlan_Annex_IX", "hasArticleReference", "Article_60"),
    ("ThirdPartyAssessment_Annex_VII", "hasArticleReference", "Article_43"),
    ("InternalControl_Annex_VI", "hasArticleReference", "Article_43"),
    (BODY, "hasArticleReference", "Article_31"),
)
ANCHOR_ANNEXES = {"IV": "TechnicalDocumentation_Annex_IV", "VI": "InternalControl_Annex_VI", "VII": "ThirdPartyAssessment_Annex_VII", "VIII": "RegistrationRecord_Annex_VIII", "IX": "TestingPlan_Annex_IX"}


def anchors(annexes: DataFrame, ns: str, most: int = 1500, repeats: bool = False) -> DataFrame:
    """The sixteen anchors; annexes (number, text) that are there give references, and Annex IV its text's first ``most`` characters as a summary."""
    spark = annexes.sparkSession
    full = lambda c: c if "://" in c else ns + c
    rows = [(ns + name, TYPE, iri(full(c))) for name, classes, _ in ANCHORS for c in classes]
    rows += [(ns + name, LABEL, literal(label, lang="en")) for name, _, label in ANCHORS if label]
    rows += [(ns + a, ns + p, iri(ns + b)) for a, p, b in ANCHOR_LINKS]
    of = F.lit(None).cast("string")
    for number, name in ANCHOR_ANNEXES.items():
        of = F.when(F.upper(F.col("number").cast("string")) == number, ns + name).otherwise(of)
    there = annexes.withColumn("s", of).where("s is not null")
    text = F.when(F.col("s") == ns + "TechnicalDocumentation_Annex_IV", F.nullif(F.substr("text", F.lit(1), F.lit(most)), F.lit("")))
    return merge(triples(spark, rows), construct(there, term_struct(F.col("s"), ns + "hasAnnexReference", F.concat(F.lit(ns + "Annex_"), F.upper(F.col("number").cast("string"))), "iri"), term_struct(F.col("s"), ns + "hasSummary", text, dt=XSD + "string"), repeats=True), repeats=repeats)
