"""Queries of incidents, the evidence attached to them, and its quality; ``retrieval`` finds the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of the deterministic evidence, blocklist and size limits.
BLOCKLIST = ("drop all pressure alarms", "disable safety interlocks")
SNIPPET_CHARS = 1200
CONTEXT_CHARS = 4000
NO_CONTEXT = "No retrieved context available."
FALLBACK_SOURCES = (
    "SOP: Leak Isolation Standard Work v3",
    "Maintenance Manual: Pump & Valve Response Guide",
    "Incident Archive: Similar high-risk events",
)
FALLBACK_RESPONSE = (
    "Validate upstream/downstream pressure, isolate suspected segment, "
    "and create a CMMS work order with priority based on confidence."
)
FALLBACK_CITATIONS = (
    "SOP:LeakIsolationStandardWorkV3::section-4",
    "Manual:PumpValveResponseGuide::chapter-2",
)


def incident_query(incident: Column, action: Column, assets: Column) -> Column:
    """Search text of an incident."""
    return F.concat_ws(
        " ", F.lit("incident"), incident, F.lit("leak response"), action, F.lit("assets"),
        F.array_join(assets, " "),
    )


def index_report(corpus: DataFrame) -> DataFrame:
    """Documents that can be indexed, and those lacking an id or a text."""
    usable = F.col("id").isNotNull() & (F.trim(F.coalesce("content", F.lit(""))) != "")
    return corpus.agg(F.count_if(usable).alias("uploaded"), F.count_if(~usable).alias("failed"))


def citation(source: Column, doc: Column, title: Column) -> Column:
    return F.concat_ws(
        "::",
        F.coalesce(source, F.lit("unknown")),
        F.coalesce(doc.cast("string"), F.lit("na")),
        F.coalesce(title, F.lit("Untitled")),
    )


def assemble_context(hits: DataFrame, qid: str = "query_id") -> DataFrame:
    """Context text, sources, first three sources and citations per query, best hit first.

    ``hits`` holds at most k ranked documents per query.
    """
    title = F.coalesce("title", F.lit("Untitled"))
    source = F.coalesce("source", F.lit("unknown"))
    line = F.concat(
        F.lit("- ["), source, F.lit("] "), title, F.lit(": "), F.left("content", F.lit(SNIPPET_CHARS))
    )
    entry = F.struct(
        "place",
        line.alias("line"),
        source.alias("source"),
        citation(F.col("source"), F.col("id"), F.col("title")).alias("citation"),
    )
    ranked = hits.groupBy(qid).agg(F.array_sort(F.collect_list(entry)).alias("docs"))
    joined = F.array_join(F.transform("docs", lambda d: d["line"]), "\n")
    return ranked.select(
        qid,
        F.left(joined, F.lit(CONTEXT_CHARS)).alias("context"),
        F.transform("docs", lambda d: d["source"]).alias("all_sources"),
        F.slice(F.transform("docs", lambda d: d["source"]), 1, 3).alias("sources"),
        F.transform("docs", lambda d: d["citation"]).alias("citations"),
        F.size("docs").alias("n_docs"),
    )


def blocked(text: Column, terms: tuple[str, ...] = BLOCKLIST) -> Column:
    """Any blocked term as a substring, whatever the case; NULL text is not blocked."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for term in terms:
        hit = hit | lowered.contains(term.lower())
    return hit


def fallback_rationale() -> Column:
    return F.concat(
        F.lit("Incident "), F.col("incident_id"), F.lit(" has risk score "),
        F.format_string("%.2f", F.col("risk_score")), F.lit(". Recommended action is "),
        F.col("recommended_action"), F.lit("."),
    )


def evidence(incidents: DataFrame, min_docs: int = 1, terms: tuple[str, ...] = BLOCKLIST) -> DataFrame:
    """Generated evidence, or the fixed one when there is none, too few documents or a blocked text.

    ``incidents`` carries n_docs, sources, citations and the generated rationale
    and suggested_response, NULL when nothing was generated.
    """
    unsafe = blocked(F.col("rationale"), terms) | blocked(F.col("suggested_response"), terms)
    few = F.coalesce("n_docs", F.lit(0)) < min_docs
    use_fixed = F.col("rationale").isNull() | few | unsafe

    def texts(values: tuple[str, ...]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    return incidents.withColumns(
        {
            "fallback": use_fixed,
            "sources": F.when(use_fixed, texts(FALLBACK_SOURCES)).otherwise(F.col("sources")),
            "citations": F.when(use_fixed, texts(FALLBACK_CITATIONS)).otherwise(F.col("citations")),
            "rationale": F.when(use_fixed, fallback_rationale()).otherwise(F.col("rationale")),
            "suggested_response": F.when(use_fixed, F.lit(FALLBACK_RESPONSE)).otherwise(
                F.coalesce(
                    "suggested_response",
                    F.lit("Escalate to operator with manual review checklist."),
                )
            ),
        }
    )


def normalized(text: Column) -> Column:
    """Lower case, runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def contains_any(text: Column, phrases: Column) -> Column:
    return F.exists(phrases, lambda p: F.contains(text, normalized(p)))


def retrieval_quality(cases: DataFrame, produced: DataFrame, key: str = "incident_id") -> DataFrame:
    """Per case: source recall, grounding, blocked phrases and citations of the evidence.

    A case for which nothing was produced counts as not grounded and without citations.
    """
    joined = cases.join(produced, key, "left")
    text = normalized(F.concat_ws(" ", "rationale", "suggested_response"))
    expected = F.col("expected_sources")
    found = F.coalesce("sources", F.array().cast("array<string>"))
    hits = F.size(F.filter(expected, lambda s: F.array_contains(found, s)))
    n_citations = F.coalesce(F.size("citations"), F.lit(0))
    return joined.withColumn("_text", text).select(
        key,
        F.round(hits / F.greatest(F.size(expected), F.lit(1)), 4).alias("source_recall"),
        contains_any(F.col("_text"), F.col("expected_phrases")).alias("grounded"),
        contains_any(F.col("_text"), F.col("blocked_phrases")).alias("hallucination_flag"),
        (n_citations > 0).alias("citations_present"),
        n_citations.alias("n_citations"),
    )


def quality_rollup(cases: DataFrame) -> DataFrame:
    def rate(name: str) -> Column:
        return F.round(F.coalesce(F.avg(F.col(name).cast("int")), F.lit(0.0)), 4)

    return cases.agg(
        F.count(F.lit(1)).alias("cases"),
        rate("grounded").alias("grounded_rate"),
        rate("citations_present").alias("citation_rate"),
        rate("hallucination_flag").alias("hallucination_rate"),
    )
