"""The schema graph: classes, properties, individuals and axioms, from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.operators.rules import REQUIREMENTS
from loomspan.operators.wiring import AIACT, AIRO, DPV
from loomspan.terms import LABEL, OWL, RDF, RDFS, SUBCLASS, TYPE, XSD, bnode, iri, literal, triples

PREFIXES = {"airo": AIRO, "eu-aiact": AIACT, "dpv": DPV, "xsd": XSD}
#: Class, label, parents; prefixes as in PREFIXES, own names without one.
CLASSES = (
    ("ConformityAssessmentObligation", "Conformity Assessment Obligation", ("dpv:Obligation",)),
    ("InternalControlObligation", "Internal Control Conformity Assessment Obligation", ("ConformityAssessmentObligation",)),
    ("ThirdPartyAssessmentObligation", "Third-Party Conformity Assessment Obligation", ("ConformityAssessmentObligation",)),
    ("TransparencyObligation", "Transparency Obligation", ("dpv:Obligation",)),
    ("GPAIObligation", "GPAI Provider Obligation", ("dpv:Obligation",)),
    ("GeneralGPAIObligation", "General GPAI Obligation", ("GPAIObligation",)),
    ("SystemicRiskGPAIObligation", "Systemic Risk GPAI Obligation", ("GPAIObligation",)),
    ("PostMarketMonitoringObligation", "Post-Market Monitoring Obligation", ("dpv:Obligation",)),
    ("WorkerNotificationObligation", "Worker Notification Obligation", ("dpv:Obligation",)),
    ("FRIAObligation", "Fundamental Rights Impact Assessment Obligation", ("dpv:Obligation",)),
    ("IncidentReportingObligation", "Serious Incident Reporting Obligation", ("dpv:Obligation",)),
    ("ProviderIncidentReport", "Provider Incident Report", ("IncidentReportingObligation",)),
    ("DeployerIncidentReport", "Deployer Incident Report", ("IncidentReportingObligation",)),
    ("GPAISystemicRiskIncidentReport", "GPAI Systemic-Risk Incident Report", ("IncidentReportingObligation",)),
    ("SupportMeasureObligation", "SME Support Measure Obligation", ("dpv:Obligation",)),
    ("Power", "Regulatory Power", ()),
    ("OversightPower", "Oversight Power", ("Power",)),
    ("InvestigativePower", "Investigative Power", ("Power",)),
    ("EnforcementPower", "Enforcement Power", ("Power",)),
    ("AdvisoryPower", "Advisory Power", ("Power",)),
    ("Condition", "Legal Condition", ()),
    ("NecessityCondition", "Necessity Condition", ("Condition",)),
    ("ProportionalityCondition", "Proportionality Condition", ("Condition",)),
    ("ProceduralCondition", "Procedural Condition", ("Condition",)),
    ("PurposeCondition", "Purpose Condition", ("Condition",)),
    ("SMEProvider", "SME Provider", ("eu-aiact:AIProvider",)),
    ("CEMarking", "CE Marking", ("airo:Documentation",)),
    ("LegalText", "Legal Text", ()),
    ("Article", "Article", ("LegalText",)),
    ("Annex", "Annex", ("LegalText",)),
    ("Paragraph", "Paragraph", ("LegalText",)),
    ("Recital", "Recital", ("LegalText",)),
    ("AIActRegulation", "AI Act Regulation", ("airo:Regulation",)),
    ("EULegislation", "EU Legislation", ("airo:Regulation",)),
    ("ProvisionDeadline", "Provision Deadline", ()),
    ("ComplianceDeadlineProvision", "Compliance Deadline Provision", ("ProvisionDeadline",)),
    ("EntryIntoForceProvision", "Entry Into Force Provision", ("ProvisionDeadline",)),
    ("EntryIntoForceDate", "Entry Into Force Date", ("ProvisionDeadline",)),
    ("ConformityAssessmentBody", "Conformity Assessment Body", ("dpv:Authority",)),
    ("NotifiedBody", "Notified Body", ("ConformityAssessmentBody",)),
    ("Requirement", "Requirement", ()),
    ("RequiredComponent", "Required Component", ()),
    ("DocumentationComponent", "Documentation Component", ("RequiredComponent", "airo:Documentation")),
    ("RegistrationField", "Registration Field", ("RequiredComponent", "airo:Documentation")),
    ("ConformityAssessmentStep", "Conformity Assessment Step", ("RequiredComponent",)),
    ("TestingPlanField", "Testing Plan Field", ("RequiredComponent", "airo:Documentation")),
    ("CEMarkingComponent", "CE Marking Component", ("RequiredComponent",)),
)
#: Object property, domain, range, parent (None for none). A label is the name in words, lower case.
OBJECT_PROPERTIES = (
    ("hasObligation", None, "dpv:Obligation", "dpv:hasLegalBasis"),
    ("hasReportingTarget", "IncidentReportingObligation", "dpv:Authority", None),
    ("requiresControl", "dpv:Obligation", "airo:RiskControl", "airo:hasRiskControl"),
    ("hasPower", "dpv:Authority", "Power", None),
    ("hasCondition", None, "Condition", None),
    ("hasReference", None, "LegalText", None),
    ("hasArticleReference", None, "Article", "hasReference"),
    ("hasAnnexReference", None, "Annex", "hasReference"),
    ("hasParagraphReference", None, "Paragraph", "hasReference"),
    ("hasRecitalReference", None, "Recital", "hasReference"),
    ("isRegulatedBy", None, "AIActRegulation", "airo:compliesWithRegulation"),
    ("hasComplianceProvision", "AIActRegulation", "ComplianceDeadlineProvision", None),
    ("hasEntryIntoForceProvision", "AIActRegulation", "EntryIntoForceProvision", None),
    ("cites", None, "EULegislation", None),
    ("amends", "AIActRegulation", "EULegislation", None),
    ("createdBy", "AIActRegulation", "dpv:Authority", None),
    ("meetsRequirement", "ConformityAssessmentBody", "Requirement", None),
    ("hasRequiredComponent", None, "RequiredComponent", None),
    ("hasComponentOf", "RequiredComponent", None, None),
)
#: Data property, label, domain, range.
DATA_PROPERTIES = (
    ("hasSummary", "has summary", "LegalText", "xsd:string"),
    ("hasCellarURI", "has Cellar URI", "AIActRegulation", "xsd:string"),
    ("hasSourceURL", "has source URL", "LegalText", "xsd:string"),
    ("hasDeadline", "has deadline", "dpv:Obligation", "xsd:duration"),
    ("hasComplianceDeadline", "has compliance deadline", "dpv:Obligation", "xsd:date"),
    ("hasEffectiveDate", "has effective date", "EntryIntoForceDate", "xsd:date"),
    ("hasModifiedLocation", "has modified location", "EULegislation", "xsd:string"),
    ("hasProvisionDate", "has provision date", "ProvisionDeadline", "xsd:date"),
    ("hasCELEXNumber", "has CELEX number", "AIActRegulation", "xsd:string"),
    ("hasOJReference", "has OJ reference", "AIActRegulation", "xsd:string"),
    ("hasFine", "has fine", "EnforcementPower", "xsd:decimal"),
    ("hasMaximumFineRatio", "has maximum fine ratio", "EnforcementPower", "xsd:decimal"),
)
#: Properties with one value, and the individuals of the schema.
FUNCTIONAL = ("hasReportingTarget", "hasDeadline")
INDIVIDUALS = (
    ("ProviderStakeholder", "Provider (stakeholder role)", "eu-aiact:AIProvider"),
    ("DeployerStakeholder", "Deployer (stakeholder role)", "eu-aiact:AIDeployer"),
    ("AIOffice", "AI Office", "dpv:Authority"),
    ("HighRisk", "High Risk", "RiskLevel"),
)


def spaced(name: str) -> str:
    """hasFineRatio to has fine ratio."""
    return "".join(" " + c.lower() if c.isupper() else c for c in name).strip()


def tbox(spark: SparkSession, ns: str) -> DataFrame:
    """The schema as triples, lists and restrictions included."""

    def name(x: str) -> str:
        prefix, _, local = x.rpartition(":")
        return PREFIXES[prefix] + local if prefix else ns + local

    rows: list[tuple] = []
    for cls, label, parents in CLASSES:
        rows += [(name(cls), TYPE, iri(OWL + "Class")), (name(cls), LABEL, literal(label, lang="en"))]
        rows += [(name(cls), SUBCLASS, iri(name(p))) for p in parents]
    for prop, domain, range_, up in OBJECT_PROPERTIES:
        rows += [(name(prop), TYPE, iri(OWL + "ObjectProperty")), (name(prop), LABEL, literal(spaced(prop), lang="en"))]
        rows += [(name(prop), p, iri(name(x))) for p, x in ((RDFS + "domain", domain), (RDFS + "range", range_), (RDFS + "subPropertyOf", up)) if x]
    for prop, label, domain, range_ in DATA_PROPERTIES:
        rows += [(name(prop), TYPE, iri(OWL + "DatatypeProperty")), (name(prop), LABEL, literal(label, lang="en"))]
        rows += [(name(prop), RDFS + "domain", iri(name(domain))), (name(prop), RDFS + "range", iri(name(range_)))]
    rows += [(name(p), TYPE, iri(OWL + "FunctionalProperty")) for p in FUNCTIONAL]
    rows.append((name("hasComponentOf"), OWL + "inverseOf", iri(name("hasRequiredComponent"))))
    rows.append((name("InternalControlObligation"), OWL + "disjointWith", iri(name("ThirdPartyAssessmentObligation"))))
    needs = [(r + "Requirement", " ".join(_words(r + "Requirement")), "Requirement") for r in REQUIREMENTS]
    for x, label, cls in (*INDIVIDUALS, *needs):
        rows += [(name(x), TYPE, iri(name(cls))), (name(x), TYPE, iri(OWL + "NamedIndividual")), (name(x), LABEL, literal(label, lang="en"))]
    rows += defined(AIACT + "HighRiskAISystem", AIRO + "AISystem", [(name("hasRiskLevel"), name("HighRisk"))])
    rows += defined(name("NotifiedBody"), name("ConformityAssessmentBody"), [(name("meetsRequirement"), name(r + "Requirement")) for r in REQUIREMENTS])
    return triples(spark, rows).distinct()


def _words(name: str) -> list[str]:
    return [w.capitalize() for w in spaced(name).split()]


def defined(cls: str, base: str, values: list[tuple[str, str]]) -> list[tuple]:
    """cls is equivalent to base with all the given values: an intersection over a list of has-value restrictions."""
    tag = cls.rpartition("#")[2]
    rows: list[tuple] = [(cls, OWL + "equivalentClass", bnode(f"_:{tag}.x")), (f"_:{tag}.x", TYPE, iri(OWL + "Class")), (f"_:{tag}.x", OWL + "intersectionOf", bnode(f"_:{tag}.l0"))]
    members = [iri(base)]
    for k, (p, v) in enumerate(values):
        r = f"_:{tag}.r{k}"
        rows += [(r, TYPE, iri(OWL + "Restriction")), (r, OWL + "onProperty", iri(p)), (r, OWL + "hasValue", iri(v))]
        members.append(bnode(r))
    for k, m in enumerate(members):
        rows += [(f"_:{tag}.l{k}", RDF + "first", m), (f"_:{tag}.l{k}", RDF + "rest", bnode(f"_:{tag}.l{k + 1}") if k + 1 < len(members) else iri(RDF + "nil"))]
    return rows
