"""Ranked, fuzzy and prefix search over documents, parts and the company view."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmaforge.functions.text import ACCENTED, PLAIN
from firmaforge.operators import search as s
from firmaforge.plans import views
from queries.company_sql import SEGMENTS
from queries.facets import enriched
from queries.registry import query

TEXT = {"text": 1.0}
QUERY = "Nicht entre hethan"
TYPOS = "nihct hethann"


def _words(expr: str) -> str:
    return (
        f"list_transform(list_filter(string_split_regex(lower({expr}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), "
        f"lambda w: translate(w, '{ACCENTED}', '{PLAIN}'))"
    )


_POSTINGS = f"""words AS (SELECT doc_id AS id, {_words('text')} AS w FROM documents),
  lens AS (SELECT id, len(w) AS length FROM words WHERE len(w) > 0),
  stats AS (SELECT count(*) AS docs, avg(length) AS mean_length FROM lens),
  terms AS (SELECT id, unnest(w) AS term FROM words),
  postings AS (SELECT terms.id, term, length, count(*) AS tf FROM terms JOIN lens ON lens.id = terms.id GROUP BY ALL)"""


def _scored(matches: str) -> str:
    return f"""hits AS (SELECT postings.*, wanted, edits FROM postings JOIN {matches} ON term = variant),
  freq AS (SELECT term, count(DISTINCT id) AS df FROM hits GROUP BY term),
  scores AS (SELECT hits.id, wanted, max(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2
      / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)) * (1 - edits / len(wanted))) AS score
    FROM hits JOIN freq ON freq.term = hits.term CROSS JOIN stats GROUP BY hits.id, wanted)"""


def _exact(terms: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{t}', '{t}', 0)" for t in terms) + ") AS m(wanted, variant, edits)"


def _near(terms: list[str]) -> str:
    parts = [
        f"SELECT '{t}' AS wanted, term AS variant, damerau_levenshtein(term, '{t}') AS edits FROM (SELECT DISTINCT term FROM postings) "
        f"WHERE damerau_levenshtein(term, '{t}') <= {s.allowed_edits(t)}"
        for t in terms
    ]
    return "(" + " UNION ALL ".join(parts) + ") AS m"


def _documents(spark, d):
    return views.table(spark, d, "documents").select("doc_id", "text", "lang", "source")


_INDEXES: dict[tuple, s.Index] = {}


def _index(spark, d, name, build):
    """The stored index of a table: built once in a session, then only searched."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _INDEXES:
        _INDEXES[key] = build()
    return _INDEXES[key]


def document_index(spark, d):
    return _index(spark, d, "documents", lambda: s.build_index(_documents(spark, d), "doc_id", TEXT))


def company_index(spark, d):
    return _index(spark, d, "companies", lambda: s.build_index(enriched(spark, d), "company_id", s.GENERAL))


@query(
    "search_bm25",
    f"""WITH {_POSTINGS}, {_scored(_exact(s.query_terms(QUERY)))}
        SELECT id AS doc_id, round(sum(score), 6) AS score FROM scores GROUP BY id""",
)
def search_bm25(spark, d):
    hits = s.search(_documents(spark, d), QUERY, "doc_id", TEXT, document_index(spark, d), fuzzy=False)
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query(
    "search_all_terms",
    f"""WITH {_POSTINGS}, {_scored(_exact(s.query_terms('nicht für')))}
        SELECT id AS doc_id, round(sum(score), 6) AS score FROM scores JOIN documents ON doc_id = id
        WHERE lang IN ('de', 'fr') GROUP BY id HAVING count(*) = 2""",
)
def search_all_terms(spark, d):
    hits = s.search(
        _documents(spark, d),
        "nicht für",
        "doc_id",
        TEXT,
        document_index(spark, d),
        filters={"lang": ["de", "fr"]},
        mode="all",
        fuzzy=False,
    )
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query(
    "search_fuzzy",
    f"""WITH {_POSTINGS}, {_scored(_near(s.query_terms(TYPOS)))}
        SELECT id AS doc_id, round(sum(score), 6) AS score FROM scores GROUP BY id""",
)
def search_fuzzy(spark, d):
    hits = s.search(_documents(spark, d), TYPOS, "doc_id", TEXT, document_index(spark, d))
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query(
    "search_highlight",
    f"""WITH {_POSTINGS}, {_scored(_near(['hethan']))},
        top AS (SELECT id, sum(score) AS score FROM scores GROUP BY id ORDER BY score DESC, id LIMIT 10)
        SELECT doc_id, round(score, 6) AS score, CAST((SELECT sum(tf) FROM hits WHERE hits.id = doc_id) AS BIGINT) AS marked
        FROM top JOIN documents ON doc_id = id""",
)
def search_highlight(spark, d):
    """Best ten documents for one word, and how many words of each are marked."""
    index = document_index(spark, d)
    hits = s.basic_search(_documents(spark, d), "hethan", 10, index, "doc_id", TEXT, ("text",))
    marked = F.size(F.regexp_extract_all("text_marked", F.lit("<em>[^<>]+</em>"), F.lit(0)))
    return hits.select("doc_id", F.round("score", 6).alias("score"), marked.cast("long").alias("marked"))


_FIRM_FIELDS = " UNION ALL ".join(
    f"SELECT company_no, '{f}' AS field, CAST({b} AS DOUBLE) AS boost, "
    + ("array_to_string(keywords, ' ')" if f == "keywords" else f)
    + " AS t FROM segments"
    for f, b in s.GENERAL.items()
)
_FIRM_HITS = f"""{SEGMENTS}, texts AS ({_FIRM_FIELDS}),
  words AS (SELECT company_no AS id, field, boost, {_words('t')} AS w FROM texts WHERE t IS NOT NULL),
  lens AS (SELECT id, field, boost, len(w) AS length FROM words WHERE len(w) > 0),
  stats AS (SELECT field, count(*) AS docs, avg(length) AS mean_length FROM lens GROUP BY field),
  terms AS (SELECT id, field, unnest(w) AS term FROM words),
  postings AS (SELECT id, field, boost, term, length, count(*) AS tf FROM terms JOIN lens USING (id, field) GROUP BY ALL)"""


@query(
    "search_companies",
    f"""WITH {_FIRM_HITS},
        hits AS (SELECT postings.*, wanted, edits FROM postings JOIN {_near(['000000042', 'tourism', 'nation'])} ON term = variant),
        freq AS (SELECT field, term, count(DISTINCT id) AS df FROM hits GROUP BY ALL),
        scores AS (SELECT id, field, wanted, max(boost * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2
            / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)) * (1 - edits / len(wanted))) AS score
          FROM hits JOIN freq USING (field, term) JOIN stats USING (field) GROUP BY ALL),
        per_field AS (SELECT id, field, sum(score) AS score FROM scores GROUP BY ALL),
        top AS (SELECT id, max(score) AS score FROM per_field GROUP BY id),
        found AS (SELECT id, list(DISTINCT term) AS ts FROM hits GROUP BY id)
        SELECT company_no, round(top.score, 6) AS score,
          CASE WHEN list_contains(ts, split_part(legal_name, '#', 2))
            THEN split_part(legal_name, '#', 1) || '#<em>' || split_part(legal_name, '#', 2) || '</em>' ELSE legal_name END AS legal_name_marked,
          array_to_string(list_transform(keywords, lambda k: CASE WHEN list_contains(ts, k)
            THEN '<em>' || k || '</em>' ELSE k END), ',') AS keywords_marked
        FROM top JOIN found USING (id) JOIN segments ON company_no = id ORDER BY top.score DESC, company_id LIMIT 10""",
)
def search_companies(spark, d):
    """Boosted search over all company fields."""
    hits = s.basic_search(enriched(spark, d), "000000042 tourism nation", 10, company_index(spark, d))
    return hits.select(
        "company_no",
        F.round("score", 6).alias("score"),
        "legal_name_marked",
        F.array_join("keywords_marked", ",").alias("keywords_marked"),
    )


@query(
    "search_suggestions",
    f"""WITH {_FIRM_HITS}, near AS (SELECT wanted, variant AS suggestion, CAST(edits AS INTEGER) AS edits, count(*) AS df
          FROM (SELECT DISTINCT id, field, term FROM postings WHERE field IN ('legal_name', 'trade_name', 'keywords', 'city'))
          JOIN {_near(['toursm', 'otel'])} ON term = variant GROUP BY ALL)
        SELECT * FROM near WHERE wanted NOT IN (SELECT wanted FROM near WHERE edits = 0)
        QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY edits, df DESC, suggestion) <= 5""",
)
def search_suggestions(spark, d):
    """Terms near a misspelt one; the other is known and gets none."""
    return s.suggestions(company_index(spark, d), "toursm otel", s.SERVICE)


@query(
    "search_advanced",
    f"""WITH {SEGMENTS} SELECT company_no, strftime(last_updated, '%Y-%m-%d') AS day FROM segments
        WHERE city = 'NATION_3' AND industry = 'Tourism' AND rating >= 2
        ORDER BY last_updated DESC, company_id LIMIT 10 OFFSET 1""",
)
def search_advanced(spark, d):
    """All terms over several fields, filtered, by date, from the second hit on."""
    hits = s.advanced_search(
        enriched(spark, d),
        "otel NATION_3",
        {"city": "NATION_3", "industry": "Tourism", "rating": {"min": 2}},
        sort=[F.desc("last_updated")],
        start=1,
        size=10,
        index=company_index(spark, d),
    )
    return hits.select("company_no", F.date_format("last_updated", "yyyy-MM-dd").alias("day"))


def _service(spark, d):
    return s.service_search(enriched(spark, d), "tourism otel", {"priority_tier": ["A", "B"]}, number=1, size=20, sort_by="rating", index=company_index(spark, d))


@query(
    "search_service",
    f"""WITH {SEGMENTS} SELECT company_no, rating FROM segments WHERE industry = 'Tourism' AND priority_tier IN ('A', 'B')
        ORDER BY rating DESC, company_id LIMIT 20""",
)
def search_service(spark, d):
    return _service(spark, d).hits.select("company_no", "rating")


@query(
    "search_service_facets",
    f"""WITH {SEGMENTS}, h AS (SELECT * FROM segments WHERE industry = 'Tourism' AND priority_tier IN ('A', 'B'))
        SELECT * FROM (SELECT 'city' AS facet, city AS value, count(*) AS count FROM h GROUP BY ALL ORDER BY count DESC, value LIMIT 20)
        UNION ALL SELECT 'industry', industry, count(*) FROM h GROUP BY ALL
        UNION ALL SELECT 'company_type', company_type, count(*) FROM h WHERE company_type IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'priority_tier', priority_tier, count(*) FROM h GROUP BY ALL
        UNION ALL SELECT 'total', 'total', count(*) FROM h""",
)
def search_service_facets(spark, d):
    answer = _service(spark, d)
    total = answer.total.select(F.lit("total").alias("facet"), F.lit("total").alias("value"), F.col("total").alias("count"))
    return answer.aggregations.unionByName(total)


@query(
    "competitors",
    f"""WITH {SEGMENTS}, n AS (SELECT count(*) AS n FROM segments),
        k AS (SELECT count(*) FILTER (industry = 'Tourism') AS ki, count(*) FILTER (city = 'NATION_3') AS kc FROM segments),
        c AS (SELECT company_no, company_id, CASE WHEN industry = 'Tourism' THEN 2 * ln(1 + (n - ki + 0.5) / (ki + 0.5)) ELSE 0 END
          + CASE WHEN city = 'NATION_3' THEN 1.5 * ln(1 + (n - kc + 0.5) / (kc + 0.5)) ELSE 0 END AS score FROM segments, n, k
          WHERE industry = 'Tourism' OR city = 'NATION_3')
        SELECT company_no, round(score, 6) AS score FROM c ORDER BY c.score DESC, company_id LIMIT 20""",
)
def competitors(spark, d):
    """No name is near this one, so industry and city decide."""
    hits = s.competitors(enriched(spark, d), "Zyxwvutsrq", "Tourism", "NATION_3", index=company_index(spark, d))
    return hits.select("company_no", F.round("score", 6).alias("score"))


@query(
    "competitors_by_name",
    """WITH near AS (SELECT c_custkey, damerau_levenshtein(split_part(c_name, '#', 2), '000000042') AS edits FROM customer)
       SELECT c_custkey AS company_no FROM near WHERE edits = 0""",
)
def competitors_by_name(spark, d):
    """The firm of that very number comes first."""
    return s.competitors(enriched(spark, d), "000000042", index=company_index(spark, d)).limit(1).select("company_no")


_COMPLETED = """WITH f AS (SELECT p_name, p_brand, p_partkey, CASE WHEN lower(p_name) LIKE 'smlal%' THEN 0
         ELSE (SELECT min(damerau_levenshtein(left(lower(p_name), n), 'smlal')) FROM (VALUES (4), (5), (6)) AS v(n)) END AS edits
         FROM part WHERE left(lower(p_name), 1) = 's')
       SELECT p_name, p_brand, p_partkey, CAST(edits AS INTEGER) AS edits FROM f WHERE edits <= 1
       ORDER BY edits, p_name, p_brand, p_partkey LIMIT 10"""


@query("autocomplete", _COMPLETED)
def autocomplete(spark, d):
    parts = views.table(spark, d, "part")
    return s.autocomplete(parts, "Smlal", 10, ("p_name",), ("p_name", "p_brand", "p_partkey"))


@query("autocomplete_indexed", _COMPLETED)
def autocomplete_indexed(spark, d):
    """The same from stored prefixes."""
    shown = ("p_name", "p_brand", "p_partkey")
    index = _index(spark, d, "prefixes", lambda: s.build_prefix_index(views.table(spark, d, "part"), ("p_name",), shown))
    return s.autocomplete_indexed(index, "Smlal", 10)


@query(
    "search_index_build",
    f"""WITH {_POSTINGS}, t AS (SELECT term, length(term) AS n FROM postings GROUP BY term)
        SELECT 'postings' AS part, (SELECT count(*) FROM postings) AS rows UNION ALL SELECT 'vocabulary', (SELECT count(*) FROM t)
        UNION ALL SELECT 'documents', (SELECT docs FROM stats)""",
)
def search_index_build(spark, d):
    """Build the index of the documents anew, and count what it holds."""
    index = s.build_index(_documents(spark, d), "doc_id", TEXT)
    parts = [("postings", index.postings), ("vocabulary", index.vocabulary)]
    counts = [df.agg(F.lit(n).alias("part"), F.count("*").alias("rows")) for n, df in parts]
    return counts[0].union(counts[1]).union(index.stats.select(F.lit("documents"), "docs"))
