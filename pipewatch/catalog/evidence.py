"""Retrieval and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipewatch.catalog.decisions import decided
from pipewatch.catalog.registry import CTES, query
from pipewatch.operators import decisions as d
from pipewatch.operators import evidence as ev
from pipewatch.operators import retrieval as rt
from pipewatch.plans import operations
from pipewatch.sources.readers import read_knowledge
from pipewatch.sources.scratch import scratch_path
from pipewatch.sources.views import table, view

# Phrases looked for in generated texts: the standing blocklist and two of the corpus's own.
SCREENED = (*ev.BLOCKLIST, "erning", "The Reanble")

CTES["corpus"] = """
    SELECT doc_id AS id, concat(lang, '-', doc_id) AS title, source, text AS content FROM documents"""
CTES["corpus_words"] = r"""
    SELECT id, list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS words FROM corpus"""
CTES["query_words"] = r"""
    SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_filter(
        string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS term FROM benchmark) GROUP BY 1, 2"""
CTES["term_counts"] = """
    SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(words) AS len, unnest(words) AS term FROM corpus_words)
    WHERE term IN (SELECT term FROM query_words) GROUP BY 1, 2, 3"""
CTES["bm25_rows"] = """
    SELECT item_id, id, round(sum((tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))
        * (qtf * ln(1 + (n - df + 0.5) / (df + 0.5)))), 6) AS score
    FROM term_counts t JOIN (SELECT term, count(*) AS df FROM term_counts GROUP BY 1) f ON f.term = t.term
      JOIN query_words q ON q.term = t.term, (SELECT count(*) AS n, avg(len(words)) AS avg_len FROM corpus_words)
    GROUP BY item_id, id"""
CTES["top_docs"] = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS place FROM bm25_rows)
    WHERE place <= 5"""
CTES["context_text"] = """
    SELECT t.item_id, left(string_agg(concat('- [', coalesce(source, 'unknown'), '] ', coalesce(title, 'Untitled'), ': ',
        left(content, 1200)), chr(10) ORDER BY place), 4000) AS context,
      list(coalesce(source, 'unknown') ORDER BY place) AS all_sources,
      list(concat_ws('::', source, t.id, title) ORDER BY place) AS citations, CAST(count(*) AS INTEGER) AS n_docs
    FROM top_docs t JOIN corpus c ON c.id = t.id GROUP BY t.item_id"""
CTES["eval_cases"] = """
    SELECT item_id, [concat('src', item_id % 20), concat('src', (item_id * 7) % 20)] AS expected_sources,
      [array_to_string(string_split(text, ' ')[1:2], ' ')] AS expected_phrases,
      [array_to_string(string_split(text, ' ')[3:5], ' ')] AS blocked_phrases FROM benchmark"""
_NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
CTES["case_quality"] = f"""
    SELECT e.item_id, round(len(list_filter(expected_sources, lambda s: list_contains(coalesce(all_sources[1:3], []), s)))
        / greatest(len(expected_sources), 1), 4) AS source_recall,
      contains({_NORM.format("concat_ws(' ', context, suggested)")}, {_NORM.format("expected_phrases[1]")}) AS grounded,
      contains({_NORM.format("concat_ws(' ', context, suggested)")}, {_NORM.format("blocked_phrases[1]")}) AS hallucination_flag,
      coalesce(len(citations), 0) > 0 AS citations_present, CAST(coalesce(len(citations), 0) AS INTEGER) AS n_citations
    FROM eval_cases e LEFT JOIN (SELECT *, 'escalate' AS suggested FROM context_text) c ON c.item_id = e.item_id"""


def corpus(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat_ws("-", "lang", F.col("doc_id").cast("string")).alias("title"),
        "source",
        F.col("text").alias("content"),
    )


#: Indexes stored by this session, by folder; a session writes each once.
_stored: dict[tuple[str, str], rt.SearchIndex] = {}


def index(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stored:
        _stored[key] = rt.write_index(corpus(spark, sf))
    return _stored[key]


def best(spark, sf):
    """The five best documents of each benchmark item."""
    return rt.search(index(spark, sf), table(spark, sf, "benchmark"), qid="item_id", qtext="text")


def hits(spark, sf):
    return best(spark, sf).join(corpus(spark, sf), "id")


def contexts(spark, sf):
    return ev.assemble_context(hits(spark, sf), qid="item_id")


@query("a11_knowledge_scan", "SELECT CAST(id AS VARCHAR) AS id, title, source, md5(content) AS content_md5 FROM corpus")
def a11(spark, sf):
    path = scratch_path(spark, "knowledge")
    corpus(spark, sf).withColumn("id", F.col("id").cast("string")).write.json(path)
    return read_knowledge(spark, path).select("id", "title", "source", F.md5("content").alias("content_md5"))


@query("k8_bm25_scores", "SELECT item_id, id, score FROM bm25_rows")
def k8(spark, sf):
    return rt.scores(index(spark, sf), table(spark, sf, "benchmark"), qid="item_id", qtext="text")


@query(
    "k8_index_terms",
    """SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS occurrences FROM (SELECT id, term, count(*) AS n
         FROM (SELECT id, unnest(words) AS term FROM corpus_words) GROUP BY 1, 2) GROUP BY term""",
)
def k8_terms(spark, sf):
    """What the stored index holds of every term."""
    rows = index(spark, sf).rows.filter("term IS NOT NULL")
    occurrences = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    return rows.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.sum(occurrences).alias("occurrences"))


@query("f4_top_documents", "SELECT item_id, id, score, CAST(place AS INTEGER) AS place FROM top_docs")
def f4(spark, sf):
    return best(spark, sf)


@query(
    "k7_incident_query",
    """SELECT r.incident_id, concat('incident ', r.incident_id, ' leak response ', recommended_action, ' assets ',
         replace(asset_ids, ',', ' ')) AS query FROM decision_rows r JOIN context_rows c ON c.incident_id = r.incident_id""",
)
def k7(spark, sf):
    context = d.incident_context(view(spark, sf, "incident_telemetry")).select("incident_id", "asset_ids")
    joined = decided(spark, sf).join(context, "incident_id")
    text = ev.incident_query(F.col("incident_id"), F.col("recommended_action"), F.col("asset_ids"))
    return joined.select("incident_id", text.alias("query"))


@query("c7_incident_evidence")
def c7_evidence(spark, sf):
    """Decisions with the evidence retrieved for them; c7_decision_evidence is the bare join, which SQL can check."""
    decisions = decided(spark, sf)
    context = d.incident_context(view(spark, sf, "incident_telemetry")).select("incident_id", "asset_ids")
    found = operations.incident_evidence(decisions.join(context, "incident_id", "left"), corpus(spark, sf), index=index(spark, sf))
    # Requests are grouped by incident, so a decision's row holds its own evidence and its texts need no second join.
    evidence = {c: F.col(c) for c in ("fallback", "n_docs", "context", "rationale", "suggested_response")}
    evidence |= {c: F.array_join(c, "|") for c in ("sources", "citations")}
    known = F.col("incident_id").isNotNull()
    return found.select("incident_id", "risk_tier", *(F.when(known, value).alias(c) for c, value in evidence.items()))


@query(
    "k9_index_report",
    """SELECT count(*) FILTER (WHERE id IS NOT NULL AND trim(coalesce(content, '')) <> '') AS uploaded,
         count(*) FILTER (WHERE NOT (id IS NOT NULL AND trim(coalesce(content, '')) <> '')) AS failed FROM corpus""",
)
def k9(spark, sf):
    return ev.index_report(corpus(spark, sf))


@query(
    "k10_context_assembly",
    "SELECT item_id, context, array_to_string(all_sources[1:3], ',') AS sources, n_docs FROM context_text",
)
def k10(spark, sf):
    return contexts(spark, sf).select(
        "item_id", "context", F.array_join("sources", ",").alias("sources"), "n_docs"
    )


@query("k11_citations", "SELECT item_id, array_to_string(citations, ' ') AS citations FROM context_text")
def k11(spark, sf):
    return contexts(spark, sf).select("item_id", F.array_join("citations", " ").alias("citations"))


@query(
    "k12_blocklist",
    "SELECT conv_id, turn, "
    + " OR ".join(f"contains(lower(text), '{t.lower()}')" for t in SCREENED)
    + " AS blocked FROM conversations WHERE role = 'assistant'",
)
def k12(spark, sf):
    said = table(spark, sf, "conversations").filter("role = 'assistant'")
    return said.select("conv_id", "turn", ev.blocked(F.col("text"), SCREENED).alias("blocked"))


CTES["generated"] = """
    SELECT concat('N', conv_id) AS incident_id, max(text) AS rationale, count(*) AS n_docs
    FROM conversations WHERE role = 'assistant' GROUP BY 1"""


@query(
    "k13_fallback_evidence",
    f"""SELECT incident_id, fallback, CASE WHEN fallback THEN concat('Incident ', incident_id, ' has risk score ',
           CAST(CAST(CAST(risk_score AS DECIMAL(18, 4)) AS DECIMAL(18, 2)) AS VARCHAR), '. Recommended action is ',
           recommended_action, '.') ELSE rationale END AS rationale,
         CASE WHEN fallback THEN {", ".join("'" + s + "'" for s in ["|".join(ev.FALLBACK_SOURCES)])} ELSE 'conversation' END AS sources,
         CASE WHEN fallback THEN '{"|".join(ev.FALLBACK_CITATIONS)}' ELSE concat('conversation::', incident_id) END AS citations,
         CASE WHEN fallback THEN '{ev.FALLBACK_RESPONSE}' ELSE 'Escalate to operator with manual review checklist.' END AS suggested_response
       FROM (SELECT r.incident_id, risk_score, recommended_action, rationale, rationale IS NULL OR coalesce(n_docs, 0) < 2
           OR {" OR ".join(f"contains(lower(coalesce(rationale, '')), '{t.lower()}')" for t in SCREENED)} AS fallback
         FROM decision_rows r LEFT JOIN generated g ON g.incident_id = r.incident_id)""",
)
def k13(spark, sf):
    generated = (
        table(spark, sf, "conversations")
        .filter("role = 'assistant'")
        .groupBy(F.concat(F.lit("N"), "conv_id").alias("incident_id"))
        .agg(F.max("text").alias("rationale"), F.count(F.lit(1)).alias("n_docs"))
    )
    incidents = decided(spark, sf).join(generated, "incident_id", "left").withColumns(
        {
            "suggested_response": F.lit(None).cast("string"),
            "sources": F.array(F.lit("conversation")),
            "citations": F.array(F.concat(F.lit("conversation::"), "incident_id")),
        }
    )
    out = ev.evidence(incidents, min_docs=2, terms=SCREENED)
    return out.select(
        "incident_id", "fallback", "rationale", "suggested_response",
        F.array_join("sources", "|").alias("sources"), F.array_join("citations", "|").alias("citations"),
    )


def cases(spark, sf):
    words = F.split("text", " ")
    item = F.col("item_id")
    return table(spark, sf, "benchmark").select(
        "item_id",
        F.array(
            F.concat(F.lit("src"), item % 20), F.concat(F.lit("src"), (item * 7) % 20)
        ).alias("expected_sources"),
        F.array(F.array_join(F.slice(words, 1, 2), " ")).alias("expected_phrases"),
        F.array(F.array_join(F.slice(words, 3, 3), " ")).alias("blocked_phrases"),
    )


def case_quality(spark, sf):
    produced = contexts(spark, sf).select(
        "item_id", "sources", "citations", F.col("context").alias("rationale"),
        F.lit("escalate").alias("suggested_response"),
    )
    return ev.retrieval_quality(cases(spark, sf), produced, "item_id")


@query(
    "k14_retrieval_quality",
    "SELECT item_id, source_recall, grounded, hallucination_flag, citations_present, n_citations FROM case_quality",
)
def k14(spark, sf):
    return case_quality(spark, sf)


@query(
    "c9_eval_case_join",
    """SELECT e.item_id, array_to_string(expected_sources, ',') AS expected_sources,
         array_to_string(all_sources[1:3], ',') AS sources FROM eval_cases e LEFT JOIN context_text c ON c.item_id = e.item_id""",
)
def c9(spark, sf):
    joined = cases(spark, sf).join(contexts(spark, sf), "item_id", "left")
    return joined.select(
        "item_id",
        F.array_join("expected_sources", ",").alias("expected_sources"),
        F.array_join("sources", ",").alias("sources"),
    )


@query(
    "d35_retrieval_rollup",
    """SELECT count(*) AS cases, round(avg(CAST(grounded AS INTEGER)), 4) AS grounded_rate,
         round(avg(CAST(citations_present AS INTEGER)), 4) AS citation_rate,
         round(avg(CAST(hallucination_flag AS INTEGER)), 4) AS hallucination_rate FROM case_quality""",
)
def d35(spark, sf):
    return ev.quality_rollup(case_quality(spark, sf))
