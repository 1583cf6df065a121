"""A graph built from the test tables by the construction layer, layer by layer, with the same triples as DuckDB text.

Parts are the items of articles, suppliers those of annexes, customers the
instances that a model found, orders the enrichments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import rules, wiring
from loomspan.operators.graphs import merge
from loomspan.plans.registry import query
from loomspan.plans.relational import EX, table
from loomspan.plans.tbox import tbox
from loomspan.session import written
from loomspan.sources.json_io import METADATA, existing, metadata_triples
from loomspan.terms import LABEL, OWL, RDFS, ROMAN, TYPE, XSD

AIRO, AIACT, DPV = wiring.AIRO, wiring.AIACT, wiring.DPV
#: Types as a model may write them: known ones, aliases, one that is turned away and one that is empty.
KINDS = (
    "ConformityAssessmentObligation", "TransparencyObligation", "PostMarketMonitoringObligation", "WorkerNotificationObligation", "FRIAObligation", "DeployerIncidentReport", "ProviderIncidentReport",
    "GeneralGPAIObligation", "SystemicRiskGPAIObligation", "GPAIObligation", "SupportMeasureObligation", "OversightPower", "EnforcementPower", "NecessityCondition", "proceeduralcondition",
    "Prohibited practice", "regulatory sandbox", "AI Office", "", " risk control ",
)
NUMBERS = (5, 14, 26, 27, 50, 51, 52, 53, 57, 60, 72, 99)
BIOMETRIC = "prohibited_practice_art5_1_h"


#: Rows of a table that one task makes triples of, and triples that one task tells apart: more are dealt to more tasks, so that a task's memory stays as it is.
SHARE, TRIPLES = 50_000, 250_000


def _dealt(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """A table over tasks of SHARE rows, whatever files hold it: a small file of many rows would be one task with all their triples."""
    rows = table(spark, d, name)
    n = -(-rows.count() // SHARE)  # from the files' footers
    return rows.repartition(n, key) if n > 1 else rows


def _wider(spark: SparkSession, n: int) -> int | None:
    """Partitions for n triples, if the session's own are too few for them."""
    parts = -(-n // TRIPLES)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def _distinct(g: DataFrame, n: int) -> DataFrame:
    """The distinct triples of some n."""
    parts = _wider(g.sparkSession, n)
    return (g.repartition(parts, "s", "p", "o") if parts else g).distinct()


def _pick(values: tuple, at) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def article_items(spark: SparkSession, d: str) -> DataFrame:
    n, k = (F.col("p_partkey") % 113 + 1).cast("int"), F.floor(F.col("p_partkey") / 113).cast("int")
    letter = F.when(n.isin(5, 14), F.char(97 + k % 10))
    paragraph = F.when(n == 5, "1").when(n == 14, "4").otherwise((k % 7 + 1).cast("string"))
    rows = _dealt(spark, d, "part", "p_partkey").select(n.alias("number"), n.cast("string").alias("unit"), F.col("p_partkey").cast("int").alias("pos"), F.col("p_name").alias("text"), paragraph.alias("paragraph_number"), letter.alias("list_label"))
    return rows.withColumn("reference", F.concat(F.lit("Article "), "unit", F.lit("("), "paragraph_number", F.lit(")"), F.coalesce(F.concat(F.lit("("), "list_label", F.lit(")")), F.lit(""))))


def articles(spark: SparkSession, d: str) -> DataFrame:
    return article_items(spark, d).groupBy("number").agg(F.min("text").alias("title"), F.concat(F.lit("part/"), F.min("pos").cast("string")).alias("source_path"))


def annex_items(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    paragraph = F.when(k % 3 != 0, (F.floor(k / 13) % 5 + 1).cast("string"))
    rows = _dealt(spark, d, "supplier", "s_suppkey").select(_pick(ROMAN, k % 13).alias("unit"), k.cast("int").alias("pos"), F.col("s_name").alias("text"), paragraph.alias("paragraph_number"), F.lit(None).cast("string").alias("list_label"))
    return rows.withColumn("reference", F.concat(F.lit("Annex "), "unit", F.coalesce(F.concat(F.lit("("), "paragraph_number", F.lit(")")), F.lit(""))))


def annexes(spark: SparkSession, d: str) -> DataFrame:
    return annex_items(spark, d).groupBy(F.col("unit").alias("number")).agg(F.min("text").alias("title"), F.min("text").alias("text"))


def instances(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    n = _pick(NUMBERS, F.floor(k / len(KINDS)) % len(NUMBERS))
    article = F.concat(F.lit("Article "), n.cast("string"))
    ref = F.when(k % 4 == 0, F.concat(article, F.lit("(2)"))).when(k % 4 == 1, F.concat(article, F.lit("(1)(b)"))).when(k % 4 == 3, "Annex iv(1)")
    return _dealt(spark, d, "customer", "c_custkey").select(
        F.concat(F.lit("item-"), k.cast("string")).alias("uri_suffix"), _pick(KINDS, k % len(KINDS)).alias("type"), F.when(k % 5 != 0, F.concat("c_mktsegment", F.lit(" "), k.cast("string"))).alias("summary"), ref.alias("paragraph_ref"),
        F.when(k % 8 != 7, n).alias("source_article"), F.when(k % 8 == 7, "ix").alias("source_annex"), F.when(k % 3 == 0, F.array(F.concat(F.lit("CQ"), (k % 10 + 1).cast("string")))).alias("cq_targets"), F.when(k % 6 == 0, F.concat(F.lit("ev "), k.cast("string"))).alias("evidence_text"),
    )


def enrichments(spark: SparkSession, d: str) -> DataFrame:
    k, j = F.col("o_orderkey"), F.col("o_orderkey") % 5
    item = F.concat(F.lit("item-"), F.col("o_custkey").cast("string"))
    law = F.concat(F.lit("Legislation_3"), (2000 + k % 24).cast("string"), F.lit("R"), F.lpad((k % 7).cast("string"), 4, "0"))
    number = lambda m: F.concat(F.lit("Article_"), (k % m + 1).cast("string"))
    return table(spark, d, "orders").select(
        F.when(j == 3, number(113)).when(j == 4, F.concat(F.lit("ghost-"), k.cast("string"))).otherwise(item).alias("subject"),
        F.when(j == 3, "article").otherwise("instance").alias("subject_type"),
        _pick(("hasMaximumFineRatio", "hasDeadline", "cites", "hasArticleReference", "hasFine"), j).alias("predicate"),
        F.when(j == 0, F.concat(F.lit("0.0"), (k % 9 + 1).cast("string"))).when(j == 1, F.concat(F.lit("P"), (k % 30 + 1).cast("string"), F.lit("D"))).when(j == 2, law).when(j == 3, number(50)).otherwise("1000").alias("object"),
        F.when(j == 0, "xsd:decimal").when(j == 1, "xsd:duration").alias("object_datatype"),
    )


def _rules(spark, d) -> DataFrame:
    return rules.extract_all(article_items(spark, d), annex_items(spark, d))


def _biometric(found: DataFrame) -> str | None:
    """The name of the biometric practice, if the rules found it."""
    return BIOMETRIC if found.where("is_biometric").take(1) else None


def structure(spark, d, repeats=False):
    return wiring.structural_triples(articles(spark, d), article_items(spark, d), annexes(spark, d), EX, repeats=repeats)


def ruled(spark, d, repeats=False):
    return wiring.rule_triples(_rules(spark, d), EX, repeats=repeats)


def systems(spark, d, repeats=False):
    found = _rules(spark, d)
    named = wiring.named_instances(instances(spark, d), EX).where("canonical = 'TransparencyObligation'")
    return wiring.paired_systems(found.where("type = 'AreaOfApplication'"), found.where("type = 'RiskControl'"), named, EX, repeats=repeats)


def modelled(spark, d, repeats=False):
    made = wiring.model_triples(instances(spark, d), EX, _biometric(_rules(spark, d)), repeats=True)
    return made if repeats else _distinct(made, 6 * table(spark, d, "customer").count())


def enriched(spark, d, known=None, repeats=False):
    named = wiring.named_instances(instances(spark, d), EX)
    known = known if known is not None else merge(structure(spark, d, repeats=True), modelled(spark, d, repeats=True), repeats=True)
    n = table(spark, d, "orders").count()
    made = wiring.enrichment_triples(enrichments(spark, d), known, EX, named.select(F.col("uri_suffix").alias("suffix"), "s"), repeats=True, parts=_wider(spark, n))
    return made if repeats else _distinct(made, n)


def backed(spark, d, repeats=False):
    return wiring.backstops(instances(spark, d), EX, _biometric(_rules(spark, d)), repeats=repeats)


_BUILT: dict[tuple, str] = {}


def _stamp(spark: SparkSession, d: str) -> str:
    """The names, sizes and times of a folder's files, so that a table that is written again is another one."""
    h = spark._jvm.org.apache.hadoop.fs.Path(d)
    found = h.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(h)
    return ";".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found))


def graph(spark: SparkSession, d: str) -> DataFrame:
    """All layers and the schema, written once for a session and a state of the tables, in order of predicates so that a pattern's filter skips row groups.

    The layers are made distinct once, all together.
    """
    name = (spark.sparkContext.applicationId, d, _stamp(spark, d))
    if name not in _BUILT or not existing(spark, _BUILT[name]):
        layers = [layer(spark, d, repeats=True) for layer in (structure, ruled, systems, modelled, backed)]
        base = written(merge(tbox(spark, EX), wiring.anchors(annexes(spark, d), EX, repeats=True), *layers, repeats=True), "graph-base")
        n = base.count() + table(spark, d, "orders").count()
        whole = _distinct(merge(base, enriched(spark, d, base, repeats=True), repeats=True), n).sortWithinPartitions("p")
        _BUILT[name] = written(whole, "graph").inputFiles()[0].rsplit("/", 1)[0]
    return spark.read.parquet(_BUILT[name])


# The same in SQL: one SELECT for each kind of triple.


def _t(rows: str, s: str, p: str, o: str, kind: str = "iri", dt: str | None = None, lang: str | None = None) -> str:
    text = lambda x: f"'{x}'" if x else "cast(null as varchar)"
    p = p if p.startswith("http") else EX + p
    return f"select {s} as s, 'iri' as s_kind, '{p}' as p, {o} as o, '{kind}' as o_kind, {text(dt)} as o_dt, {text(lang)} as o_lang from {rows} where ({s}) is not null and ({o}) is not null"


def _ex(x: str) -> str:
    return f"'{EX}' || {x}"


def _is(x: str) -> str:
    return f"'{x if '://' in x else EX + x}'"


STRING = XSD + "string"
_slug = lambda x: f"trim(regexp_replace({x}, '[^A-Za-z0-9]+', '_', 'g'), '_')"
_roman = "['" + "','".join(ROMAN) + "']"
_kinds = "['" + "','".join(KINDS) + "']"
_canonical = {"proceeduralcondition": "ProceduralCondition", "Prohibited practice": "ProhibitedPractice", "regulatory sandbox": "AIRegulatorySandbox", "AI Office": "", " risk control ": "RiskControl"}
_names = "['" + "','".join(_canonical.get(x, x) for x in KINDS) + "']"

RECORDS = f"""
items as (select n as number, cast(n as varchar) as unit, pos, text, para, label, 'Article ' || n || '(' || para || ')' || coalesce('(' || label || ')', '') as ref from
  (select n, pos, text, case n when 5 then '1' when 14 then '4' else cast(k % 7 + 1 as varchar) end as para, case when n in (5, 14) then chr(cast(97 + k % 10 as int)) end as label from
    (select p_partkey % 113 + 1 as n, p_partkey as pos, p_partkey // 113 as k, p_name as text from part))),
arts as (select number, min(text) as title, 'part/' || min(pos) as path from items group by 1),
parts as (select unit, pos, text, para, 'Annex ' || unit || coalesce('(' || para || ')', '') as ref from
  (select {_roman}[s_suppkey % 13 + 1] as unit, s_suppkey as pos, s_name as text, case when s_suppkey % 3 <> 0 then cast((s_suppkey // 13) % 5 + 1 as varchar) end as para from supplier)),
anns as (select unit as number, min(text) as title from parts group by 1),
practice as (select label, arg_min(text, pos) as text, arg_min(ref, pos) as ref from items where number = 5 and para = '1' and label between 'a' and 'h' group by 1),
control as (select label, arg_min(text, pos) as text, arg_min(ref, pos) as ref from items where number = 14 and para = '4' group by 1),
comp as (select unit, ref, arg_min(text, pos) as text, trim(regexp_replace(regexp_replace(lower(ref), '^annex\\s+', 'ann'), '[^a-z0-9]+', '_', 'g'), '_') as slug from parts
  where not starts_with(lower(trim(text)), 'section ') and (para is not null or length(trim(text)) >= case when unit = 'IV' then 1 else 30 end) and unit in ('IV', 'VI', 'VII', 'VIII', 'IX') group by 1, 2),
kinds as (select * from (values ('IV', 'documentation_component', 'DocumentationComponent', 'TechnicalDocumentation_Annex_IV'), ('VIII', 'registration_field', 'RegistrationField', 'RegistrationRecord_Annex_VIII'),
  ('IX', 'testing_plan_field', 'TestingPlanField', 'TestingPlan_Annex_IX'), ('VII', 'conformity_step', 'ConformityAssessmentStep', 'ThirdPartyAssessment_Annex_VII'), ('VI', 'conformity_step', 'ConformityAssessmentStep', 'InternalControl_Annex_VI')) v(unit, prefix, cls, parent)),
component as (select prefix || '_' || slug as name, cls, parent, text, ref, unit from comp join kinds using (unit)),
area as (select * from (values {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in rules.AREAS)}) v(slug, label, summary)),
inst as (select k, name, cls, text, ref, n, case when k % 8 <> 7 then n end as src, case when k % 8 = 7 then 'IX' end as ann, cls = 'AIRegulatorySandbox' as single from
  (select k, 'item_' || k as name, {_names}[k % {len(KINDS)} + 1] as cls, case when k % 5 <> 0 then c_mktsegment || ' ' || k end as text, n, case k % 4 when 0 then '(2)' when 1 then '(1)(b)' end as ref from
    (select c_custkey as k, c_mktsegment, {list(NUMBERS)!r}[(c_custkey // {len(KINDS)}) % {len(NUMBERS)} + 1] as n from customer)) where cls <> ''),
typed as (select *, case when cls = 'ProhibitedPractice' then '{AIACT}' || cls when cls = 'RiskControl' then '{AIRO}' || cls else '{EX}' || cls end as type from inst where not single)"""

STRUCTURE = [
    _t("arts", _ex("'Article_' || number"), TYPE, _is("Article")), _t("arts", _ex("'Article_' || number"), LABEL, "'Article ' || number || ' — ' || title", "literal", lang="en"), _t("arts", _ex("'Article_' || number"), "hasSourceURL", "path", "literal", STRING),
    _t("anns", _ex("'Annex_' || number"), TYPE, _is("Annex")), _t("anns", _ex("'Annex_' || number"), LABEL, "'Annex ' || number || ' — ' || title", "literal", lang="en"),
    _t("items", _ex(f"'Paragraph_' || {_slug('ref')}"), TYPE, _is("Paragraph")), _t("items", _ex(f"'Paragraph_' || {_slug('ref')}"), LABEL, "ref", "literal", lang="en"), _t("items", _ex(f"'Paragraph_' || {_slug('ref')}"), "hasSummary", "text", "literal", STRING),
    _t("items", _ex("'Article_' || number"), "hasParagraphReference", _ex(f"'Paragraph_' || {_slug('ref')}")),
]
_anchor_classes = (
    ("ProviderStakeholder", AIACT + "AIProvider"), ("DeployerStakeholder", AIACT + "AIDeployer"), ("AIOffice", DPV + "Authority"), ("SMEStakeholder", "SMEProvider"), ("NaturalPersonSubject", DPV + "NaturalPerson"), ("NaturalPersonSubject", AIRO + "AISubject"),
    ("GPAIModelInstance", AIACT + "GeneralPurposeAIModel"), ("GPAIModelInstance", AIRO + "AISystem"), ("GPAISystemicRiskModelInstance", "GeneralPurposeAIModelWithSystemicRisk"), ("GPAISystemicRiskModelInstance", AIACT + "GeneralPurposeAIModel"), ("GPAISystemicRiskModelInstance", AIRO + "AISystem"),
    ("AIRegulatorySandboxInstance", AIACT + "AIRegulatorySandbox"), ("TechnicalDocumentation_Annex_IV", AIACT + "TechnicalDocumentation"), ("TechnicalDocumentation_Annex_IV", AIRO + "Documentation"), ("RegistrationRecord_Annex_VIII", AIRO + "Documentation"), ("TestingPlan_Annex_IX", AIRO + "Documentation"),
    ("ThirdPartyAssessment_Annex_VII", AIACT + "ConformityAssessment"), ("InternalControl_Annex_VI", AIACT + "ConformityAssessment"), ("MarketSurveillanceAuthority", DPV + "Authority"), ("NotifiedBody_Demo", "ConformityAssessmentBody"), ("NotifiedBody_Demo", "NotifiedBody"), ("HighRisk", "RiskLevel"),
)
_anchor_labels = (
    ("ProviderStakeholder", "Generic AI provider stakeholder"), ("DeployerStakeholder", "Generic AI deployer stakeholder"), ("SMEStakeholder", "SME provider stakeholder"), ("NaturalPersonSubject", "Generic natural person subject"), ("GPAIModelInstance", "Generic general-purpose AI model"),
    ("GPAISystemicRiskModelInstance", "Generic GPAI model with systemic risk"), ("AIRegulatorySandboxInstance", "Generic AI regulatory sandbox"), ("TechnicalDocumentation_Annex_IV", "Annex IV technical documentation"), ("RegistrationRecord_Annex_VIII", "Annex VIII registration record"),
    ("TestingPlan_Annex_IX", "Annex IX real-world testing plan"), ("ThirdPartyAssessment_Annex_VII", "Annex VII third-party conformity assessment procedure"), ("InternalControl_Annex_VI", "Annex VI internal control conformity assessment procedure"),
    ("MarketSurveillanceAuthority", "National market surveillance authority"), ("NotifiedBody_Demo", "Demonstration notified body (Article 31)"), ("HighRisk", "High risk"),
)
_anchor_links = (
    ("GPAIModelInstance", "hasProvider", "ProviderStakeholder"), ("GPAISystemicRiskModelInstance", "hasProvider", "ProviderStakeholder"), ("TechnicalDocumentation_Annex_IV", "hasArticleReference", "Article_11"), ("RegistrationRecord_Annex_VIII", "hasArticleReference", "Article_49"),
    ("TestingPlan_Annex_IX", "hasArticleReference", "Article_60"), ("ThirdPartyAssessment_Annex_VII", "hasArticleReference", "Article_43"), ("InternalControl_Annex_VI", "hasArticleReference", "Article_43"), ("NotifiedBody_Demo", "hasArticleReference", "Article_31"),
)
_values = lambda rows, names: "(select * from (values " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + f") v({names}))"
_full = lambda c: f"case when {c} like 'http%' then {c} else '{EX}' || {c} end"
ANCHORED = [
    _t(_values(_anchor_classes, "a, c"), _ex("a"), TYPE, _full("c")), _t(_values(_anchor_labels, "a, l"), _ex("a"), LABEL, "l", "literal", lang="en"),
    *[_t(_values([(a, b)], "a, b"), _ex("a"), p, _ex("b")) for a, p, b in _anchor_links],
    _t("anns join (select distinct unit, parent from kinds) on unit = number", _ex("parent"), "hasAnnexReference", _ex("'Annex_' || number")), _t("(select * from anns where number = 'IV')", _is("TechnicalDocumentation_Annex_IV"), "hasSummary", "title", "literal", STRING),
]
_pr, _co = _ex("'prohibited_practice_art5_1_' || label"), _ex("'risk_control_art14_4_' || label")
RULED = [
    _t("component", _ex("name"), TYPE, _ex("cls")), _t("component", _ex("name"), LABEL, "name", "literal", lang="en"), _t("component", _ex("name"), "hasSummary", "text", "literal", STRING), _t("component", _ex("name"), "hasAnnexReference", _ex("'Annex_' || unit")),
    _t("component", _ex("parent"), "hasRequiredComponent", _ex("name")), _t("component", _ex("name"), "hasComponentOf", _ex("parent")),
    _t("area", _ex("'AreaOfApplication_' || slug"), TYPE, _is("AreaOfApplication")), _t("area", _ex("'AreaOfApplication_' || slug"), LABEL, "label", "literal", lang="en"), _t("area", _ex("'AreaOfApplication_' || slug"), "hasSummary", "summary", "literal", STRING), _t("area", _ex("'AreaOfApplication_' || slug"), "hasAnnexReference", _is("Annex_III")),
    _t("practice", _pr, TYPE, _is(AIACT + "ProhibitedPractice")), _t("practice", _pr, LABEL, "'Article 5(1)(' || label || ') prohibited practice' || case when label = 'h' then ' — real-time remote biometric identification' else '' end", "literal", lang="en"),
    _t("practice", _pr, "hasSummary", "text", "literal", STRING), _t("practice", _pr, "hasArticleReference", _is("Article_5")), _t("practice", _pr, "hasParagraphReference", _ex(f"'Paragraph_' || {_slug('ref')}")),
    _t("control", _co, TYPE, _is(AIRO + "RiskControl")), _t("control", _co, LABEL, "'risk_control_art14_4_' || label", "literal", lang="en"), _t("control", _co, "hasSummary", "text", "literal", STRING), _t("control", _co, "hasArticleReference", _is("Article_14")), _t("control", _co, "hasParagraphReference", _ex(f"'Paragraph_' || {_slug('ref')}")),
    _t("(select unnest(['Organisational','QualityManagement','Resource','Process','Cybersecurity','Independence','Objectivity','Impartiality','ProfessionalIntegrity','Competence','Confidentiality','LiabilityInsurance']) as r)", _is("NotifiedBody_Demo"), "meetsRequirement", _ex("r || 'Requirement'")),
]
_sys = _ex("'HighRiskAISystem_' || slug")
SYSTEMS = [
    _t("area", _sys, TYPE, _is(AIACT + "HighRiskAISystem")), _t("area", _sys, TYPE, _is(AIRO + "AISystem")), _t("area", _sys, LABEL, "'High-risk AI system in ' || label", "literal", lang="en"), _t("area", _sys, "hasRiskLevel", _is("HighRisk")), _t("area", _sys, "hasAreaOfApplication", _ex("'AreaOfApplication_' || slug")),
    _t("area", _sys, "hasProvider", _is("ProviderStakeholder")), _t("area", _sys, "hasDeployer", _is("DeployerStakeholder")), _t("area", _sys, AIRO + "hasDocumentation", _is("TechnicalDocumentation_Annex_IV")), _t("area", _sys, AIRO + "hasAISubject", _is("NaturalPersonSubject")), _t("area", _sys, "hasArticleReference", _is("Article_6")),
    _t("area, (select label as l from control)", _sys, AIRO + "hasRiskControl", _ex("'risk_control_art14_4_' || l")), _t("area, (select name from typed where cls = 'TransparencyObligation')", _sys, "hasObligation", _ex("name")),
]
_bearers = (
    ("ProviderStakeholder", "'ConformityAssessmentObligation','TransparencyObligation','PostMarketMonitoringObligation','ProviderIncidentReport','GeneralGPAIObligation','SystemicRiskGPAIObligation','GPAIObligation','SupportMeasureObligation'"),
    ("DeployerStakeholder", "'WorkerNotificationObligation','FRIAObligation','DeployerIncidentReport'"), ("SMEStakeholder", "'SupportMeasureObligation'"),
    ("GPAIModelInstance", "'GeneralGPAIObligation','GPAIObligation'"), ("GPAISystemicRiskModelInstance", "'SystemicRiskGPAIObligation'"),
)
_named = "(select *, case when k % 4 in (0, 1) then n end as a from typed)"
MODELLED = [
    _t("typed", _ex("name"), TYPE, "type"), _t("typed", _ex("name"), LABEL, "'item-' || k", "literal", lang="en"), _t("typed", _ex("name"), "hasSummary", "text", "literal", STRING), _t("(select * from inst where single)", _is("AIRegulatorySandboxInstance"), "hasSummary", "text", "literal", STRING),
    _t(_named, _ex("name"), "hasArticleReference", _ex("'Article_' || coalesce(a, src)")), _t("typed", _ex("name"), "hasParagraphReference", _ex(f"'Paragraph_' || {_slug(chr(39) + 'Article ' + chr(39) + ' || n || ref')}")),
    _t("typed", _ex("name"), "hasAnnexReference", _ex("'Annex_' || case when k % 4 = 3 then 'IV' else ann end")), _t("(select * from typed where k % 6 = 0)", _ex("name"), RDFS + "comment", "'evidence: ev ' || k", "literal", lang="en"),
    _t("(select * from typed where k % 3 = 0)", _ex("name"), RDFS + "comment", "'cq_target: CQ' || (k % 10 + 1)", "literal", lang="en"),
    *[_t(f"(select * from typed where cls in ({kinds}))", _is(who), "hasObligation", _ex("name")) for who, kinds in _bearers], _t("(select * from typed where cls like '%Power')", _is("AIOffice"), "hasPower", _ex("name")),
    _t("(select * from typed where cls in ('ProviderIncidentReport','DeployerIncidentReport'))", _ex("name"), "hasReportingTarget", _is("MarketSurveillanceAuthority")),
    _t(f"(select * from {_named} where cls like '%Condition' and (a between 57 and 63 or src between 57 and 63))", _is("AIRegulatorySandboxInstance"), "hasCondition", _ex("name")),
    _t(f"(select * from {_named} where cls like '%Condition' and (a = 51 or src = 51))", _is("GPAISystemicRiskModelInstance"), "hasCondition", _ex("name")),
    _t(f"(select * from {_named} where cls like '%Condition' and (a = 5 or src = 5) and exists (select 1 from practice where label = 'h'))", _is(BIOMETRIC), "hasCondition", _ex("name")),
]
ENRICH = """enr as (select o_orderkey as k, o_orderkey % 5 as j, o_custkey as c from orders), who as (select e.k, j, case when i.single then 'AIRegulatorySandboxInstance' else i.name end as name from enr e join inst i on i.k = e.c)"""
_law = "'Legislation_3' || (2000 + k % 24) || 'R' || lpad(cast(k % 7 as varchar), 4, '0')"
ENRICHED = [
    _t("(select * from who where j = 0)", _ex("name"), "hasMaximumFineRatio", "'0.0' || (k % 9 + 1)", "literal", XSD + "decimal"), _t("(select * from who where j = 1)", _ex("name"), "hasDeadline", "'P' || (k % 30 + 1) || 'D'", "literal", XSD + "duration"),
    _t("(select * from who where j = 2)", _ex("name"), "cites", _ex(_law)), _t("(select * from enr where j = 3)", _ex("'Article_' || (k % 113 + 1)"), "hasArticleReference", _ex("'Article_' || (k % 50 + 1)")),
    _t("(select * from who where j = 2)", _ex(_law), TYPE, _is("EULegislation")), _t("(select * from who where j = 2)", _ex(_law), LABEL, f"replace('EU legislation ' || {_law}, 'Legislation_', '')", "literal", lang="en"), _t("(select * from who where j = 2)", _ex(_law), "hasCELEXNumber", f"replace({_law}, 'Legislation_', '')", "literal", STRING),
]


def _union(parts: list[str], more: str = "") -> str:
    return f"with {RECORDS}{', ' + more if more else ''} " + " union ".join(parts)


for _name, _fn, _parts, _more in (
    ("construct_structure", structure, STRUCTURE, ""),
    ("construct_anchors", lambda spark, d: wiring.anchors(annexes(spark, d), EX), ANCHORED, ""),
    ("construct_rules", ruled, RULED, ""),
    ("construct_systems", systems, SYSTEMS, ""),
    ("construct_instances", modelled, MODELLED, ""),
    ("construct_enrichments", enriched, ENRICHED, ENRICH),
):
    query(_name, _union(_parts, _more))(_fn)


@query("construct_backstops", f"with {RECORDS}, c as (select coalesce(case when k % 4 in (0, 1) then n end, src) as a from typed where cls like '%Condition') select 'proportionality_condition_art51_stub' as stub, count(*) filter (where a = 51) = 0 as made from c union all select 'necessity_condition_art5_biometric_stub', count(*) filter (where a = 5) = 0 and exists (select 1 from practice where label = 'h') from c")
def construct_backstops(spark, d):
    g = backed(spark, d).select(F.regexp_replace("s", EX, "").alias("stub")).distinct().withColumn("made", F.lit(True))
    names = spark.createDataFrame([(s[0],) for s in wiring.STUBS.values()], "stub string")
    return names.join(g, "stub", "left").select("stub", F.coalesce("made", F.lit(False)).alias("made"))


@query("rule_breakdown", f"""with {RECORDS}, r as (select case unit when 'IV' then 'annex_iv_components' when 'VIII' then 'annex_viii_fields' when 'IX' then 'annex_ix_fields' when 'VII' then 'annex_vii_steps' else 'annex_vi_steps' end as rule, cls as type from component
    union all select 'annex_iii_sectors', 'AreaOfApplication' from area union all select 'article_5_practices', 'ProhibitedPractice' from practice union all select 'article_14_risk_controls', 'RiskControl' from control union all select 'notified_body_requirements', 'Requirement' from range(12))
    select 'rule' as "by", rule as name, count(*) as n from r group by rule union all select 'type', type, count(*) from r group by type union all select 'total', 'total', count(*) from r""")  # fmt: skip
def rule_breakdown(spark, d):
    return rules.summary(_rules(spark, d))


META = """meta as (select r_regionkey as r, '32024R168' || r_regionkey as celex, case when r_regionkey <> 3 then 'cellar:' || r_regionkey end as uri, '2025-0' || (r_regionkey + 1) || '-02' as day from region), ok as (select * from meta where uri is not null),
n as (select n_nationkey as k, n_name as name, ok.r from nation join ok on r = n_regionkey), l as (select *, '3' || (1990 + k) || 'L' || lpad(cast(k as varchar), 4, '0') || case when k % 2 = 0 then '(01)' else '' end as no from n)"""
_no = "'Legislation_' || replace(replace(replace(no, '/', '_'), '(', '_'), ')', '_')"
_act, _dl, _ef = _is("Act"), _ex("'ComplianceDeadline_' || replace(day, '-', '')"), _ex("'EntryIntoForce_' || replace(day, '-', '')")
METADATA_SQL = [
    _t("ok", _act, TYPE, _is(OWL + "NamedIndividual")), _t("ok", _act, TYPE, _is("AIActRegulation")), _t("ok", _act, LABEL, "'The act'", "literal", lang="en"), _t("ok", _act, "hasCELEXNumber", "celex", "literal"), _t("ok", _act, "hasCellarURI", "uri", "literal"),
    _t("ok", _dl, TYPE, _is("ComplianceDeadlineProvision")), _t("ok", _dl, LABEL, "'Compliance deadline ' || day", "literal"), _t("ok", _dl, "hasProvisionDate", "day", "literal", XSD + "date"), _t("ok", _act, "hasComplianceProvision", _dl), _t("ok", _dl, "hasArticleReference", _ex("'Article_' || (r + 1)")), _t("ok", _dl, "hasArticleReference", _ex("'Article_' || (r + 50)")),
    _t("ok", _ef, TYPE, _is("EntryIntoForceDate")), _t("ok", _ef, LABEL, "'Entry into force ' || day", "literal"), _t("ok", _ef, "hasEffectiveDate", "day", "literal", XSD + "date"), _t("ok", _act, "hasEntryIntoForceProvision", _ef),
    _t("n", _ex("'Creator_' || case when k % 2 = 0 then 'ID' || k else name end"), TYPE, _is(DPV + "Authority")), _t("n", _ex("'Creator_' || case when k % 2 = 0 then 'ID' || k else name end"), LABEL, "name", "literal"), _t("n", _act, "createdBy", _ex("'Creator_' || case when k % 2 = 0 then 'ID' || k else name end")),
    *[x for p in ("amends", "cites") for x in (_t("l", _ex(_no), TYPE, _is("EULegislation")), _t("l", _ex(_no), LABEL, "'EU Legislation ' || no", "literal"), _t("l", _ex(_no), "hasCELEXNumber", "no", "literal"), _t("l", _act, p, _ex(_no)))], _t("l", _ex(_no), "hasModifiedLocation", "case when k % 3 = 0 then 'A' || k end", "literal"),
]


@query("construct_metadata", f"with {META} " + " union ".join(METADATA_SQL))
def construct_metadata(spark, d):
    """A metadata record for each region; one has no cellar address and gives nothing."""
    k = F.col("n_nationkey")
    celex = F.concat(F.lit("3"), (1990 + k).cast("string"), F.lit("L"), F.lpad(k.cast("string"), 4, "0"), F.when(k % 2 == 0, "(01)").otherwise(""))
    law = F.struct(celex.alias("celex"), F.when(k % 3 == 0, F.concat(F.lit("A"), k.cast("string"))).alias("modified_location"))
    maker = F.struct(F.col("n_name").alias("label"), F.when(k % 2 == 0, F.concat(F.lit("ID"), k.cast("string"))).alias("identifier"))
    per = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(law).alias("laws"), F.collect_list(maker).alias("makers"))
    r = F.col("r_regionkey")
    day = F.concat(F.lit("2025-0"), (r + 1).cast("string"), F.lit("-02"))
    refs = F.array(F.concat(F.lit("Article "), (r + 1).cast("string")), F.concat(F.lit("Art. "), (r + 50).cast("string")))
    rows = table(spark, d, "region").join(per, r == F.col("n_regionkey")).select(
        F.struct(F.concat(F.lit("32024R168"), r.cast("string")).alias("celex"), F.when(r != 3, F.concat(F.lit("cellar:"), r.cast("string"))).alias("cellar_uri")).alias("regulation"),
        F.array(F.struct(day.alias("date"), refs.alias("article_references"))).alias("deadlines"), F.array(F.struct(day.alias("date"), F.lit(None).cast("array<string>").alias("article_references"))).alias("entry_into_force"),
        F.col("makers").alias("created_by"), F.col("laws").alias("amends"), F.col("laws").alias("cites"),
    )
    return metadata_triples(rows.select(F.from_json(F.to_json(F.struct("*")), METADATA).alias("m")).select("m.*"), EX, "Act", "The act")
