"""The engine's surface: register, ingest, extract by strategy, experiment. Everything takes and returns DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import annotation, answers, documents, evaluation, fusion, ner, normalize, rules, store
from ..sources import readers, sinks
from ..sources.tables import written

FACT = ["paper_id", "version", "field", "field_key", "item_idx", "value_num", "value_unit", "value_str", "source", "confidence", "fact_ord", "block_ordinal", "page", "section", "evidence_text", "char_start", "char_end", "extractor_version"]


def register_documents(arrivals: DataFrame, key: str, content: str, order: list[str]) -> DataFrame:
    """New content versions of documents."""
    return store.content_versions(arrivals, key, content, order).where("is_new").drop("is_new")


def ingest(docs: DataFrame, key: str = "doc_id", text: str = "text", sections: DataFrame | None = None) -> DataFrame:
    """Blocks of text documents, with section headings if sections are given."""
    blocks = documents.blocks_of_text(docs, key, text)
    return blocks if sections is None else documents.assign_sections(blocks, sections).select(blocks.columns)


class Ingested(NamedTuple):
    """documents: paper_id, version, title, authors, abstract, references, needs_ocr, was_ocred, used_grobid. blocks: with the
    section headings of their document. failures: paper_id, version, stage, reason, lost (no document came of it)."""

    documents: DataFrame
    blocks: DataFrame
    failures: DataFrame


def ingest_files(
    files: DataFrame,
    parser: Callable[[], Callable[[bytes], list[dict]]],
    ocr: Callable[[], Callable[[bytes], bytes]] | None = None,
    metadata: Callable[[], Callable[[bytes], str]] | None = None,
    seconds: float | None = None,
    store: str | None = None,
) -> Ingested:
    """Binary files (paper_id, version, content) as documents, blocks and failures, all of one pass through the plug-ins
    (readers.processed_files): one bad file costs its own document, at most.

    store: a folder that all executors share; the pass is written there once, and the three tables read it. Without it each
    action on a table goes through the files again."""
    done = readers.processed_files(files, parser, ocr, metadata, seconds=seconds)
    if store is not None:
        done.write.mode("overwrite").parquet(store)
        done = files.sparkSession.read.schema(done.schema).parquet(store)
    key = ["paper_id", "version"]
    kept = readers.parse_tei(done.where("blocks is not null"))
    flags = ["needs_ocr", "was_ocred", (F.col("xml").isNotNull() & F.col("tei_error").isNull()).alias("used_grobid")]
    heads = kept.select(*key, "title", "authors", "abstract", "references", *flags)
    blocks = done.select(*key, F.inline("blocks"))
    blocks = blocks.select(*key, "block_ordinal", "block_type", "page", "section", "text", "bbox")
    broken = kept.where("tei_error is not null").select(*key, F.lit("metadata").alias("stage"), F.col("tei_error").alias("reason"), F.lit(False).alias("lost"))
    failures = done.select(*key, F.inline("failures")).unionByName(broken)
    if metadata is None:
        return Ingested(heads, blocks, failures)
    sections = kept.select(*key, F.posexplode("sections").alias("section_ordinal", "s")).select(*key, "section_ordinal", "s.heading", "s.text")
    return Ingested(heads, documents.assign_sections(blocks, sections, key=key).select(blocks.columns), failures)


def _long(facts: DataFrame) -> DataFrame:
    place = F.col("block_ordinal").cast("long") * (1 << 31) + F.col("char_start")
    kinds = {"field_key": "string", "item_idx": "int", "value_num": "double", "value_unit": "string", "value_str": "string"}
    new = {c: F.lit(None).cast(t) for c, t in kinds.items() if c not in facts.columns}
    if "field_key" in new:
        new["field_key"] = F.col("field")
    out = facts.withColumns(new) if new else facts
    return out.withColumn("fact_ord", F.col("fact_ord").cast("long") if "fact_ord" in facts.columns else place).select(FACT)


def rule_facts(blocks: DataFrame, only: list[str] | None = None, since: str | None = None) -> DataFrame:
    return _long(rules.facts(blocks, only=only, since=since))


def ner_facts(blocks: DataFrame, keys: list[str] | None = None, since: str | None = None) -> DataFrame:
    labels = None if keys is None else sorted({ner.KEYS[k] for k in keys if k in ner.KEYS})
    found = _long(ner.facts(ner.first_mentions(ner.mentions(blocks, labels=labels, since=since))))
    return found if keys is None else found.where(F.col("field_key").isin(keys))


def llm_facts(blocks: DataFrame, model_answers: DataFrame, predicted: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """model_answers: paper_id, version, raw_text and, if known, extractor_version; predicted: what answers.predictions has
    made of them already; keys: of which facts evidence is sought (others are left out)."""
    version = "extractor_version" if "extractor_version" in model_answers.columns else None
    found = answers.facts(answers.predictions(answers.parse(model_answers)) if predicted is None else predicted)
    found = found if keys is None else found.where(F.col("field_key").isin(keys))
    located = answers.locate(found, blocks, None if version else F.lit("llm@recorded"))
    if version:
        located = located.join(model_answers.select("paper_id", "version", version).distinct(), ["paper_id", "version"])
    return _long(located)


def hybrid_facts(blocks: DataFrame, model_answers: DataFrame | None = None, only: list[str] | None = None, predicted: DataFrame | None = None, keys: list[str] | None = None, since: str | None = None) -> DataFrame:
    """The facts of all sources (of rules, those in only); fusion.fuse_scalars and fuse_precursors choose among them. keys: the
    field_key that are wanted; what gives others alone isn't computed. since: see rules.facts and ner.mentions."""
    ruled = [n for n, _, _ in rules.RULES if (only is None or n in only) and (keys is None or n in keys)]
    found = [rule_facts(blocks, ruled, since)] if ruled else []
    if keys is None or any(k in ner.KEYS for k in keys):
        found.append(ner_facts(blocks, keys, since))
    if model_answers is not None:
        found.append(llm_facts(blocks, model_answers, predicted, keys))
    return reduce(DataFrame.unionByName, found)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"rule": rule_facts, "ner": ner_facts, "llm": llm_facts, "hybrid": hybrid_facts}


def get_strategy(name: str) -> Callable[..., DataFrame]:
    own = {"prompt_llm": "llm", "rag_llm": "llm"}.get(n := name.strip().lower(), n)
    if own not in STRATEGIES:
        raise ValueError(f"unknown extractor {name!r}: one of {', '.join(STRATEGIES)}")
    return STRATEGIES[own]


class Unavailable(RuntimeError):
    """A strategy was asked for without what it needs."""


def strategies(answered: bool = False) -> dict[str, dict[str, bool]]:
    """What each strategy needs, and whether it can run where answers of a model are there or a model can be asked."""
    needs = {"rule": False, "ner": False, "llm": True, "hybrid": True}
    return {name: {"needs_answers": n, "available": answered or not n} for name, n in needs.items()}


def extract(blocks: DataFrame, strategy: str, *inputs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Facts of a strategy; documents (paper_id, version) that stored has results of are left out. llm and hybrid take the
    answers of a model as their input."""
    run = get_strategy(strategy)
    needy = [k for k, f in STRATEGIES.items() if f is run and strategies()[k]["needs_answers"]]
    if needy and not inputs:
        raise Unavailable(f"{needy[0]} needs the answers of a model")
    todo = blocks if stored is None else blocks.join(stored.select("paper_id", "version").distinct(), ["paper_id", "version"], "left_anti")
    return run(todo, *inputs)


def normalized_precursors(facts: DataFrame, threshold: float = normalize.THRESHOLD) -> DataFrame:
    """Fused precursors with synonyms merged into canonical entities."""
    fused = fusion.fuse_precursors(facts).withColumnRenamed("fused_idx", "item_idx")
    return normalize.merge_precursors(normalize.match_names(fused, threshold=threshold))[0]


Parts = tuple[DataFrame, DataFrame, DataFrame]


def evaluate(predicted: Parts, gold: Parts, strict: bool = False) -> DataFrame:
    """The report of each paper that both have: paper_id, level (entity, relation, field), tp, fp, fn. predicted and gold:
    (scalars, precursors, techniques). strict: a prediction without gold is an error."""
    (p, pp, pt), (g, gp, gt) = predicted, gold
    if strict:
        lone = [r[0] for r in p.select("paper_id").join(g.select("paper_id"), "paper_id", "left_anti").distinct().limit(10).collect()]
        if lone:
            raise ValueError(f"no gold for paper {', '.join(map(str, lone))}")
    both = p.select("paper_id").join(g.select("paper_id"), "paper_id").distinct()
    on = lambda df: df.join(both, "paper_id", "left_semi")
    status, matches = evaluation.scalar_status(p, g), evaluation.match_precursors(on(pp), on(gp))
    counts = evaluation.entity_counts(matches, evaluation.named_scalars(p, g), on(evaluation.technique_sets(pt, gt)))
    return counts.unionByName(evaluation.relation_counts(evaluation.relations(matches))).unionByName(evaluation.field_counts(status))


def run_experiment(predictions: dict[str, Parts], gold: Parts) -> tuple[DataFrame, DataFrame]:
    """The ablation table of several extractors, and the reports of each paper that it sums up."""
    reports = None
    for name, parts in predictions.items():
        one = evaluate(parts, gold).withColumn("extractor", F.lit(name))
        reports = one if reports is None else reports.unionByName(one)
    return evaluation.ablation(reports), reports


def tracked_experiment(run_id: str, config: DataFrame, predictions: dict[str, Parts], gold: Parts) -> DataFrame:
    """An experiment as a long table of its run, with the configuration (one row) as parameters. Papers count once,
    whatever the number of extractors. The reports of the papers are written first, one extractor's at a time, so that no plan
    holds more than one comparison with gold; counts and measures read them."""
    reports = None
    for name, parts in predictions.items():
        one = written(run_experiment({name: parts}, gold)[1], "reports")
        reports = one if reports is None else reports.unionByName(one)
    papers = None
    for p, _, _ in predictions.values():
        papers = p.select("paper_id") if papers is None else papers.union(p.select("paper_id"))
    params = config.select(documents.as_params(config)).first()[0]
    counted = papers.agg(F.count_distinct("paper_id").alias("n")).join(reports.agg(F.count_distinct("paper_id").alias("scored")))  # two numbers
    n, scored = counted.first()
    return sinks.track_run(F.lit(run_id), F.create_map(*[F.lit(x) for kv in params.items() for x in kv]), evaluation.ablation(reports), F.lit(n), F.lit(scored))


def normalized_predictions(scalars: DataFrame, threshold: float = normalize.THRESHOLD) -> DataFrame:
    """Material and solvent (strings) under their canonical names; extractor_version, if there, says so."""
    out = normalize.normalize_scalars(scalars, threshold)
    return out.withColumn("extractor_version", normalize.normalized_version(F.col("extractor_version"))) if "extractor_version" in out.columns else out


def submit_annotations(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Annotations (paper_id, version, annotator_id, payload, created_at) with new ones in place of the same annotator's."""
    return annotation.upsert(stored, new, ["paper_id", "version", "annotator_id"], "created_at")


def read_jobs(log: DataFrame, paper_id: str | None = None) -> DataFrame:
    """The state of each job, of one paper if given (log: paper_id, job_id, event, event_seq)."""
    rows = log if paper_id is None else log.where(F.col("paper_id") == paper_id)
    return store.job_states(rows)


def read_results(results: DataFrame, paper_id: str, version: int | None = None) -> DataFrame:
    """Stored results of a paper, of its latest version unless one is named."""
    own = results.where(F.col("paper_id") == paper_id)
    return own.where(F.col("version") == version) if version is not None else store.latest(own, ["paper_id", "extractor"], "version")
