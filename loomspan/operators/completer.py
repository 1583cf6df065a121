"""Calls to an external model: pluggable, replayable, and checked afterwards.

A completer maps prompts to answers. The default one replays recorded answers
by the prompt's hash, so a run needs no network and repeats exactly. Everything
before and after the call is DataFrame work.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import unfenced, verbalise
from loomspan.operators.doctree import first_wins, one_per_unit
from loomspan.operators.graphs import merge
from loomspan.terms import LABEL, TYPE, XSD, construct, safe_suffix, tagged_suffix, term_struct


def prompt_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def replay(prompts: DataFrame, recorded: DataFrame) -> DataFrame:
    """prompts with answer from recorded (prompt_key, answer); an empty object where none is recorded."""
    keyed = prompts.withColumn("prompt_key", prompt_key(F.col("prompt")))
    return keyed.join(recorded.select("prompt_key", "answer"), "prompt_key", "left").withColumn("answer", F.coalesce("answer", F.lit("{}"))).drop("prompt_key")


def call_model(prompts: DataFrame, complete: Callable[[str], str], retries: int = 3, pause: float = 4.0) -> DataFrame:
    """prompts with answer and error from a live completer.

    After the last failed attempt the answer is an empty object and error says
    what the client raised; error is null where there is an answer. A null
    prompt is a call like any other. An empty table gives an empty result; other
    columns stay, whatever their names, but answer and error, which are replaced.
    """

    def one(prompt: str) -> tuple[str, str | None]:
        error = None
        for attempt in range(1, retries + 1):
            try:
                return complete(prompt), None
            except Exception as e:  # noqa: BLE001  whatever a client raises is a failed attempt
                error = f"{type(e).__name__}: {e}"
                if attempt < retries:
                    time.sleep(pause * attempt)
        return "{}", error

    prompts = prompts.drop("answer", "error")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = b.schema.names.index("prompt")
            got = [one(p) for p in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([g[i] for g in got], pa.string()) for i in (0, 1)]], names=[*b.schema.names, "answer", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInArrow(work, fields + ", answer string, error string")


def parsed(answers: DataFrame, schema: str) -> DataFrame:
    """answers with j, the JSON of the answer without fences; null if it is none."""
    return answers.withColumn("j", F.from_json(unfenced(F.col("answer")), schema))


def extracted(answers: DataFrame) -> DataFrame:
    """Instances of extraction answers (source_article, source_annex, tag, answer): suffixes tagged, one sandbox an article."""
    item = "uri_suffix:string,type:string,summary:string,paragraph_ref:string,cq_targets:array<string>,evidence_text:string"
    rows = parsed(answers, f"instances array<struct<{item}>>").select("source_article", "source_annex", "tag", F.posexplode("j.instances").alias("pos", "i"))
    rows = rows.select("source_article", "source_annex", "tag", "pos", "i.*").where("uri_suffix is not null and type is not null")
    rows = rows.withColumn("uri_suffix", tagged_suffix(F.col("uri_suffix"), F.col("tag")))
    articles = one_per_unit(rows.where("source_article is not null"), "source_article", "type", "AIRegulatorySandbox", "pos")
    return articles.unionByName(rows.where("source_article is null"))


# gaps: candidates, prompts, and what a valid answer adds


def lacking(g: DataFrame, classes: list[str], predicate: str, most: int) -> DataFrame:
    """(s): the first ``most`` instances, by name, of the classes that lack a predicate."""
    have = g.where(F.col("p") == predicate).select("s")
    want = g.where((F.col("p") == TYPE) & F.col("o").isin(classes)).select("s").distinct()
    return want.join(have, "s", "left_anti").orderBy("s").limit(most)


def described(g: DataFrame, subjects: DataFrame, ns: str) -> DataFrame:
    """(s, text): subjects in words."""
    rows = subjects.select("s").join(g.where(F.col("p").isin(TYPE, LABEL, ns + "hasSummary", ns + "hasArticleReference")), "s", "left")
    of = lambda p: F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o"))))
    per = rows.groupBy("s").agg(of(TYPE).alias("t"), F.element_at(F.array_append(of(LABEL), ""), 1).alias("l"), F.element_at(F.array_append(of(ns + "hasSummary"), ""), 1).alias("d"), of(ns + "hasArticleReference").alias("r"))
    return per.select("s", verbalise(F.col("t"), F.col("l"), F.col("d"), F.col("r")).alias("text"))


def article_of(reference: Column) -> Column:
    """The number in an article's name or reference."""
    return F.nullif(F.regexp_extract(reference, r"Article[_ ](\d+)", 1), F.lit("")).cast("int")


def retrieved(rows: DataFrame, articles: DataFrame, annexes: DataFrame, most: int) -> DataFrame:
    """rows (article int, annex string, ...) with context: the first ``most`` characters of the article's text, or of the annex's by its numeral in any case; empty where there is none.

    articles has number and text, annexes number and text; of repeated numbers
    the first text in order counts.
    """
    a = articles.groupBy(F.col("number").cast("int").alias("article")).agg(F.min("text").alias("_article"))
    x = annexes.groupBy(F.upper(F.col("number").cast("string")).alias("_annex")).agg(F.min("text").alias("_text"))
    out = rows.withColumn("_annex", F.upper("annex")).join(a, "article", "left").join(x, "_annex", "left")
    text = F.coalesce("_article", "_text", F.lit(""))
    return out.withColumn("context", F.substr(text, F.lit(1), F.lit(most))).drop("_annex", "_article", "_text")


#: Characters of context for each kind of gap.
CONTEXT = {"control_pairs": 2000, "fines": 3000, "deadlines": 2500}


def examples(g: DataFrame, cls: str, ns: str, n: int = 5) -> DataFrame:
    """(s, text): the first n instances of a class by name, in words, for a prompt to follow."""
    picked = g.where((F.col("p") == TYPE) & (F.col("o") == cls)).select("s").distinct().orderBy("s").limit(n)
    return described(g, picked, ns)


def new_components(answers: DataFrame, g: DataFrame, ns: str, field: str, cls: str, parent: str, reference: str, once: bool = True) -> DataFrame:
    """Triples of components that an answer lists under ``field``: named, not there yet, and the first of its name if ``once``."""
    rows = parsed(answers, f"{field} array<struct<uri_suffix:string,paragraph:string,section:string,summary:string>>").select(F.posexplode(f"j.{field}").alias("pos", "i")).select("pos", "i.*")
    rows = rows.where("trim(coalesce(uri_suffix, '')) <> ''").withColumn("s", F.concat(F.lit(ns), safe_suffix(F.col("uri_suffix"))))
    rows = rows.join(g.select("s").distinct(), "s", "left_anti")
    rows = first_wins(rows, ["s"], ["pos"]) if once else rows
    s, up = F.col("s"), F.lit(ns + parent)
    return construct(rows, term_struct(s, TYPE, F.lit(ns + cls), "iri"), term_struct(s, LABEL, F.col("uri_suffix"), lang="en"), term_struct(s, ns + "hasSummary", F.col("summary"), dt=XSD + "string"), term_struct(s, ns + "hasAnnexReference", F.lit(ns + reference), "iri"), term_struct(up, ns + "hasRequiredComponent", s, "iri"), term_struct(s, ns + "hasComponentOf", up, "iri"))


def control_pairs(g: DataFrame, ns: str, control_type: str, per_article: tuple[int, int] = (3, 2), most: int = 15) -> DataFrame:
    """(article, obligation, control): obligations and risk controls that share an article, so many of each an article by name, so many pairs in all."""
    refs = g.where(F.col("p") == ns + "hasArticleReference").select("s", F.col("o").alias("article"))
    types = g.where(F.col("p") == TYPE)
    ob = types.where(F.col("o").contains("Obligation") | F.col("o").contains("IncidentReport")).select("s").distinct().join(refs, "s")
    co = types.where(F.col("o") == control_type).select("s").distinct().join(refs, "s")
    top = lambda df, n: df.withColumn("_n", F.row_number().over(Window.partitionBy("article").orderBy("s"))).where(F.col("_n") <= n).drop("_n")
    a, b = top(ob, per_article[0]).withColumnRenamed("s", "obligation"), top(co, per_article[1]).withColumnRenamed("s", "control")
    return a.join(b, "article").select("article", "obligation", "control").orderBy("article", "obligation", "control").limit(most)


def accepted_pairs(answers: DataFrame, ns: str) -> DataFrame:
    ok = parsed(answers, "requires boolean, reason string").where("j.requires")
    return construct(ok, term_struct(F.col("obligation"), ns + "requiresControl", F.col("control"), "iri"))


def single_literal(answers: DataFrame, ns: str, field: str, predicate: str) -> DataFrame:
    """One text literal, for answers (s, answer) that give a non-empty one."""
    ok = parsed(answers, f"{field} string").withColumn("v", F.trim(F.col(f"j.{field}"))).where("v <> ''")
    return construct(ok, term_struct(F.col("s"), ns + predicate, F.col("v")))


def new_obligations(answers: DataFrame, ns: str, tag: str, article: str, bearers: list[str]) -> DataFrame:
    """Obligations of an article; the suffix holds the tag, or gets it."""
    rows = parsed(answers, "obligations array<struct<uri_suffix:string,summary:string>>").select(F.explode("j.obligations").alias("i")).select("i.*").where("trim(coalesce(uri_suffix, '')) <> ''")
    s = F.concat(F.lit(ns), tagged_suffix(F.col("uri_suffix"), F.lit(tag)))
    links = [term_struct(F.lit(ns + b), ns + "hasObligation", s, "iri") for b in bearers]
    return construct(rows, term_struct(s, TYPE, F.lit(ns + "GPAIObligation"), "iri"), term_struct(s, LABEL, F.col("uri_suffix"), lang="en"), term_struct(s, ns + "hasSummary", F.col("summary"), dt=XSD + "string"), term_struct(s, ns + "hasArticleReference", F.lit(ns + article), "iri"), *links)


def numbers(answers: DataFrame, ns: str, field: str, predicate: str, valid: Callable[[Column], Column], made: Callable[[Column], Column]) -> DataFrame:
    """Decimal literals for answers (s, answer) whose number is valid."""
    ok = parsed(answers, f"{field} double, reason string").withColumn("v", F.col(f"j.{field}")).where(valid(F.col("v")))
    return construct(ok, term_struct(F.col("s"), ns + predicate, made(F.col("v")).cast("string"), dt=XSD + "decimal"))


def _short(v: Column) -> Column:
    """Four decimals at most, one at least."""
    return F.regexp_replace(F.round(v, 4).cast("decimal(14,4)").cast("string"), r"(\.\d)(\d*?)0+$", "$1$2")


def fine_triples(answers: DataFrame, ns: str) -> DataFrame:
    return numbers(answers, ns, "fine_eur", "hasFine", lambda v: v > 0, lambda v: v.cast("long"))


def ratio_triples(answers: DataFrame, ns: str) -> DataFrame:
    return numbers(answers, ns, "ratio", "hasMaximumFineRatio", lambda v: (v > 0) & (v <= 1), _short)


def deadline_triples(answers: DataFrame, ns: str) -> DataFrame:
    ok = parsed(answers, "deadline string").withColumn("v", F.col("j.deadline")).where("v like 'P%'")
    return construct(ok, term_struct(F.col("s"), ns + "hasDeadline", F.col("v"), dt=XSD + "duration"))


def area_triples(answers: DataFrame, systems: DataFrame, ns: str, keys: list[str], link: str) -> DataFrame:
    """Areas whose normalised key is known, and links from the first system whose name ends with the key."""
    rows = parsed(answers, "areas array<struct<sector_key:string,label:string,description:string>>").select(F.explode("j.areas").alias("i")).select("i.*")
    rows = rows.withColumn("key", F.regexp_replace(F.lower(F.coalesce("sector_key", F.lit(""))), "[^a-z_]", "")).where(F.col("key").isin(keys))
    a = F.concat(F.lit(ns + "AreaOfApplication_"), F.col("key"))
    made = construct(rows, term_struct(a, TYPE, F.lit(ns + "AreaOfApplication"), "iri"), term_struct(a, LABEL, F.col("label"), lang="en"), term_struct(a, ns + "hasSummary", F.nullif("description", F.lit("")), dt=XSD + "string"), term_struct(a, ns + "hasAnnexReference", F.lit(ns + "Annex_III"), "iri"))
    # the keys are a short list, so systems find theirs without a join of all with all
    key = F.lit(None).cast("string")
    for k in sorted(keys):
        key = F.when(F.col("s").endswith(k), k).otherwise(key)
    first = systems.withColumn("key", key).where("key is not null").groupBy("key").agg(F.min("s").alias("system"))
    return merge(made, construct(rows.select("key").distinct().join(first, "key"), term_struct(F.col("system"), link, a, "iri")))


def baseline_prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """(id, condition, prompt, keywords): every question under every condition; contexts has id, condition, context. Conditions are a fixed few."""
    plain = questions.select("id", F.lit("llm_only").alias("condition"), F.col("question").alias("prompt"), "keywords")
    with_context = questions.join(contexts, "id").select("id", "condition", F.concat(F.col("question"), F.lit("\n\nContext:\n"), F.col("context")).alias("prompt"), "keywords")
    return plain.unionByName(with_context)


def verbalised_rows(rows: DataFrame, most: int = 15) -> DataFrame:
    """(id, context): up to ``most`` numbered rows of a query's result in words, and how many more there are; rows has id, pos, text."""
    w = Window.partitionBy("id")
    ranked = rows.withColumn("n", F.row_number().over(w.orderBy("pos", "text"))).withColumn("total", F.count("*").over(w)).where(F.col("n") <= most)
    line = F.concat(F.col("n").cast("string"), F.lit(". "), F.col("text"))
    per = ranked.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n").alias("c"), F.max("total").alias("t"))
    return per.select("id", F.concat("c", F.when(F.col("t") > most, F.concat(F.lit("\n... and "), (F.col("t") - most).cast("string"), F.lit(" more"))).otherwise("")).alias("context"))


def recognise(sentences: DataFrame, model: Callable[[], object] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """(sentence, pos, text, type) from a named-entity model that is loaded once a worker; without one there are no entities."""
    schema = f"sentence {sentences.schema['sentence'].dataType.simpleString()}, pos int, text string, type string"
    if model is None:
        return sentences.sparkSession.createDataFrame([], schema)
    types = types or {"LAW": "LEGISLATION", "DATE": "DEADLINE", "MONEY": "MONEY", "PERCENT": "MONEY"}

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nlp = model()
        for b in it:
            rows = [(i, n, e.text, types[e.label_]) for i, t in enumerate(b.column(1).to_pylist()) for n, e in enumerate(nlp(t or "").ents) if e.label_ in types]
            keys = pa.array([r[0] for r in rows], pa.int64())
            yield pa.record_batch([b.column(0).take(keys), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())], names=["sentence", "pos", "text", "type"])

    return sentences.select("sentence", "text").mapInArrow(work, schema)
