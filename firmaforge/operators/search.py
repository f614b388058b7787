"""Ranked text search over term postings: multi-field, all-terms, fuzzy, prefix.

An index is four stored tables: postings, each file sorted by term, so that most row groups are
skipped, a vocabulary with the document frequency of each term of each field, its terms by what
is left of them when a letter or two are deleted, and statistics of one row per field. A query
finds its terms in the vocabulary first, near ones by looking up its own deletions, and then reads
the postings of those terms only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmaforge.functions.text import ACCENTED, PLAIN, fold_latin, token_count, tokens
from firmaforge.operators.facets import facets
from firmaforge.operators.filters import compile_filters
from firmaforge.operators.ranking import ordered_by, top_rows
from firmaforge.session import cut, new_shared_path

K1, B = 1.2, 0.75

# Field boosts of the general search and of the service search.
GENERAL = {"legal_name": 3.0, "trade_name": 2.0, "keywords": 1.0, "city": 1.0, "address": 1.0, "industry": 1.0}
ALL_TERMS = {"legal_name": 3.0, "trade_name": 2.0, "keywords": 1.0, "city": 1.0, "industry": 1.0}
SERVICE = {"legal_name": 2.0, "trade_name": 1.0, "keywords": 1.0, "city": 1.0}


# Terms of one query that go into the scan of the postings as literals; more are joined.
LITERAL_TERMS = 500

# Bytes of a row group of the sorted tables: what a look-up reads of a file for one term.
ROW_GROUP = 8 << 20


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # id, field, term, tf, length
    vocabulary: DataFrame  # field, term, df
    stats: DataFrame  # field, docs, mean_length: one row per field
    deletions: DataFrame  # left, field, term, df: sorted by what is left


def _field_text(df: DataFrame, field: str) -> Column:
    dtype = dict(df.dtypes)[field]
    return F.array_join(field, " ") if dtype.startswith("array") else F.col(field)


def _field_tokens(df: DataFrame, field: str, stop_words: list[str] | None) -> Column:
    return F.coalesce(tokens(_field_text(df, field), stop_words), F.array().cast("array<string>"))


def build_index(
    df: DataFrame, id_col: str, fields: Iterable[str], stop_words: list[str] | None = None, path: str | None = None
) -> Index:
    """Write an index to ``path`` (a new folder in the shared one by default) and read it."""
    fields = list(fields)
    path = path or new_shared_path(df.sparkSession, "index")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def per_field(rows: DataFrame, value) -> DataFrame:
        lists = F.array(*[F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in fields])
        return rows.select(F.col(id_col).alias("id"), F.inline(lists))

    # Short rows make many terms, so they are dealt out by number and not by the size of files.
    texts = df.select(*dict.fromkeys([id_col, *fields])).repartition(parts, id_col)
    postings = (
        per_field(texts, lambda f: _field_tokens(df, f, stop_words))
        .select("id", "field", F.size("value").alias("length"), F.explode("value").alias("term"))
        .groupBy("id", "field", "term", "length")
        .agg(F.count("*").alias("tf"))
    )
    # The statistics are a pass of their own, so they count words and do not build them.
    counts = per_field(
        df, lambda f: F.size(_field_tokens(df, f, stop_words)) if stop_words else token_count(_field_text(df, f))
    )
    stats = (
        counts.filter("value > 0")
        .groupBy("field")
        .agg(F.count("*").alias("docs"), F.avg("value").alias("mean_length"))
    )
    def store(rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/{name}")

    # Sorted where they were counted, by document and term: a term that very many documents share
    # is spread, and nothing is shuffled again or worked out twice to find ranges.
    store(postings.sortWithinPartitions("term"), "postings")
    written = df.sparkSession.read.parquet(f"{path}/postings")
    vocabulary = written.groupBy("field", "term").agg(F.count("*").alias("df"))
    vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    terms = df.sparkSession.read.parquet(f"{path}/vocabulary")
    near = terms.repartition(parts, "term").select(F.explode(deletions(F.col("term"))).alias("left"), "field", "term", "df")
    # What is left of very many terms is spread likewise.
    store(near.repartition("left", "term").sortWithinPartitions("left"), "deletions")
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    return read_index(df.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{part}") for part in ("postings", "vocabulary", "stats", "deletions")])


def query_terms(query: str, stop_words: list[str] | None = None) -> list[str]:
    """The analyser of :func:`tokens` for one short query text."""
    import re

    lowered = query.replace("İ", "i").lower()
    words = [w for w in re.split(r"[^\w]+|_", lowered) if w and w not in (stop_words or [])]
    plain = str.maketrans(ACCENTED, PLAIN)
    return list(dict.fromkeys(w.translate(plain) for w in words))


def allowed_edits(term: str) -> int:
    """None for up to 2 characters, one for up to 5, else two."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def _swapped(term: str) -> set[str]:
    """The term with one pair of neighbours exchanged."""
    return {term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)} - {term}


def edit_distance(term: Column, wanted: str, limit: int) -> Column:
    """Edits up to ``limit``, where a swap of neighbours counts as one; null beyond it."""
    if limit == 0:
        return F.when(term == wanted, 0)
    best = F.levenshtein(term, F.lit(wanted), limit)
    best = F.when(best >= 0, best)
    swapped = _swapped(wanted)
    for variant in sorted(swapped):
        rest = F.levenshtein(term, F.lit(variant), limit - 1)
        best = F.least(best, F.when(rest >= 0, rest + 1))
    if limit == 2:
        twice = set().union(*[_swapped(v) for v in swapped]) if swapped else set()
        if twice:
            best = F.least(best, F.when(term.isin(sorted(twice)), 2))
    near = F.length(term).between(len(wanted) - limit, len(wanted) + limit)
    return F.when(near, best)


# Letters of a term whose deletions are stored: of two terms within k edits, what is left of
# their first letters is equal after k deletions from each at most.
DELETED_FROM = 8


def deletions(term: Column) -> Column:
    """The first letters of a term, without none, one or two of them: 37 texts at most.

    Terms under four letters are no more than one edit from any that asks for them, and under
    two letters none (see :func:`allowed_edits`).
    """
    s = F.left(term, F.lit(DELETED_FROM))
    n = F.length(s)
    rest = F.lit(DELETED_FROM)
    none = F.array().cast("array<string>")
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.left(s, i - 1), F.substring(s, i + 1, rest)))
    two = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.transform(
                F.sequence(i + 1, n),
                lambda j: F.concat(F.left(s, i - 1), F.substring(s, i + 1, j - i - 1), F.substring(s, j + 1, rest)),
            ),
        )
    )
    size = F.length(term)
    return F.array_distinct(
        F.concat(F.array(s), F.when(size >= 2, one).otherwise(none), F.when(size >= 4, two).otherwise(none))
    )


def deletions_of(term: str, limit: int) -> set[str]:
    """The same for one term of a query."""
    left = {term[:DELETED_FROM]}
    for _ in range(limit):
        left |= {x[:i] + x[i + 1 :] for x in left for i in range(len(x))}
    return left


def matching_terms(index: Index, terms: list[str], fields: Iterable[str], fuzzy: bool) -> DataFrame:
    """Entries of the vocabulary near the terms asked for: field, term, df, wanted, edits.

    Near terms share a deletion with a wanted one, which the scan of the stored deletions looks
    up; only those are compared by their edits.
    """
    named = F.col("field").isin(list(fields))
    if not fuzzy:
        hit = index.vocabulary.filter(named & F.col("term").isin(terms))
        return hit.withColumn("wanted", F.col("term")).withColumn("edits", F.lit(0))
    asked = sorted(set().union(*[deletions_of(t, allowed_edits(t)) for t in terms]))
    kept = index.deletions.filter(F.col("left").isin(asked) & named).select("field", "term", "df").distinct()
    # One struct per query term; an entry near two of them counts for both.
    options = []
    for wanted in terms:
        edits = edit_distance(F.col("term"), wanted, allowed_edits(wanted))
        options.append(F.when(edits.isNotNull(), F.struct(F.lit(wanted).alias("wanted"), edits.alias("edits"))))
    return kept.select("field", "term", "df", F.inline(F.array_compact(F.array(*options))))


def field_scores(index: Index, terms: list[str], fields: dict[str, float], fuzzy: bool) -> DataFrame:
    """id, field, wanted, score: BM25 of the best matching term, boosted by field.

    A term found through edits keeps the share of its letters that agree.
    """
    near = matching_terms(index, terms, fields, fuzzy)
    postings = index.postings.filter(F.col("field").isin(list(fields)))
    if fuzzy:
        few = near.limit(LITERAL_TERMS + 1).collect()
        if len(few) <= LITERAL_TERMS:
            near = near.sparkSession.createDataFrame(few, near.schema)
            postings = postings.filter(F.col("term").isin(sorted({r["term"] for r in few})))
    else:
        postings = postings.filter(F.col("term").isin(terms))
    # Terms within two edits of a query's: their number follows the alphabet, not the texts. Statistics
    # have one row per searched field.
    known = postings.join(F.broadcast(near), ["field", "term"]).join(F.broadcast(index.stats), "field")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length"))
    kept = 1 - F.col("edits") / F.length("wanted")
    boost = F.element_at(F.create_map(*[F.lit(x) for kv in fields.items() for x in kv]), F.col("field"))
    return known.groupBy("id", "field", "wanted").agg(
        F.max(boost * idf * F.col("tf") * (K1 + 1) / norm * kept).alias("score"),
        F.collect_set("term").alias("terms"),
    )


def suggestions(index: Index, query: str, fields: dict[str, float], size: int = 5) -> DataFrame:
    """wanted, suggestion, edits, df: terms near those of the query that no document holds."""
    terms = query_terms(query)
    near = (
        matching_terms(index, terms, fields, True)
        .groupBy("wanted", "term")
        .agg(F.min("edits").alias("edits"), F.sum("df").alias("df"))
    )
    known = near.filter("edits = 0").select("wanted")
    return top_rows(
        near.join(known, "wanted", "left_anti").withColumnRenamed("term", "suggestion"),
        ["wanted"],
        [F.asc("edits"), F.desc("df"), F.asc("suggestion")],
        size,
    ).select("wanted", "suggestion", "edits", "df")


def _scored_ids(index: Index, query: str, fields: dict[str, float], mode: str, fuzzy: bool) -> DataFrame:
    """id, score, terms. ``best`` takes the best field, ``all`` needs every term somewhere."""
    terms = query_terms(query)
    if not terms:
        raise ValueError("the query holds no term")
    scores = field_scores(index, terms, fields, fuzzy)
    if mode == "best":
        per_field = scores.groupBy("id", "field").agg(
            F.sum("score").alias("score"), F.flatten(F.collect_list("terms")).alias("terms")
        )
        return per_field.groupBy("id").agg(
            F.max("score").alias("score"), F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")
        )
    per_term = scores.groupBy("id", "wanted").agg(
        F.max("score").alias("score"), F.flatten(F.collect_list("terms")).alias("terms")
    )
    return (
        per_term.groupBy("id")
        .agg(
            F.count("*").alias("found"),
            F.sum("score").alias("score"),
            F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"),
        )
        .filter(F.col("found") == len(terms))
        .drop("found")
    )


def highlight(text: Column, terms: Column) -> Column:
    """Wrap the words of ``text`` that fold to one of ``terms`` in ``<em>`` tags."""
    pattern = F.array_join(terms, "|")
    groups: dict[str, str] = {}
    for accented, plain in zip(ACCENTED, PLAIN):
        groups[plain] = groups.get(plain, plain) + accented
    for plain, letters in groups.items():
        pattern = F.replace(pattern, F.lit(plain), F.lit(f"[{letters}]"))
    full = F.concat(F.lit(r"(?iU)(?<![\p{L}\p{N}])("), pattern, F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(terms) > 0, F.regexp_replace(text, full, F.lit("<em>$1</em>"))).otherwise(text)


def marked_field(df: DataFrame, field: str, terms: Column) -> Column:
    """The highlighted copy of a text or of each item of an array."""
    if dict(df.dtypes)[field].startswith("array"):
        return F.transform(field, lambda x: highlight(x, terms))
    return highlight(F.col(field), terms)


def _check_size(size: int) -> None:
    """Pages of hits are small, which is what lets them be broadcast."""
    if not 1 <= size <= 100:
        raise ValueError("a page holds 1 to 100 hits")


def search(
    df: DataFrame,
    query: str | None,
    id_col: str = "company_id",
    fields: dict[str, float] | None = None,
    index: Index | None = None,
    filters: dict[str, Any] | None = None,
    mode: str = "best",
    fuzzy: bool = True,
) -> DataFrame:
    """All hits with ``score`` and matched ``terms``; filters are applied before joining."""
    fields = fields or GENERAL
    kept = df.filter(compile_filters(df, filters))
    if not query:
        return kept.withColumn("score", F.lit(0.0)).withColumn("terms", F.array().cast("array<string>"))
    index = index or build_index(df, id_col, fields)
    scored = _scored_ids(index, query, fields, mode, fuzzy).withColumnRenamed("id", id_col)
    return kept.join(scored, id_col)


def basic_search(
    df: DataFrame,
    query: str,
    size: int = 10,
    index: Index | None = None,
    id_col: str = "company_id",
    fields: dict[str, float] | None = None,
    marked: tuple[str, ...] = ("legal_name", "trade_name", "keywords"),
) -> DataFrame:
    """Best hits over all text fields, with highlighted copies of some of them.

    The best ids are found first; whole documents are read for those only.
    """
    _check_size(size)
    fields = fields or GENERAL
    index = index or build_index(df, id_col, fields)
    top = _scored_ids(index, query, fields, "best", True).orderBy(F.desc("score"), F.asc("id")).limit(size)
    hits = df.join(F.broadcast(top.withColumnRenamed("id", id_col)), id_col)  # size rows at most
    marks = {f"{f}_marked": marked_field(df, f, F.col("terms")) for f in marked if f in df.columns}
    return hits.withColumns(marks).drop("terms").orderBy(F.desc("score"), F.asc(id_col))


def advanced_search(
    df: DataFrame,
    query: str | None = None,
    filters: dict[str, Any] | None = None,
    sort: list[Column] | None = None,
    start: int = 0,
    size: int = 20,
    id_col: str = "company_id",
    index: Index | None = None,
) -> DataFrame:
    """Every term has to occur in some field; filtered, sorted and cut to one page."""
    hits = search(df, query, id_col, ALL_TERMS, index, filters, mode="all", fuzzy=False)
    order = sort or [F.desc("score"), F.desc("last_updated")]
    return hits.orderBy(*order, F.asc(id_col)).offset(start).limit(size)


@dataclass(frozen=True)
class Answer:
    total: DataFrame
    max_score: DataFrame
    hits: DataFrame
    aggregations: DataFrame
    suggestions: DataFrame | None


def service_search(
    df: DataFrame,
    query: str | None = None,
    filters: dict[str, Any] | None = None,
    number: int = 1,
    size: int = 20,
    sort_by: str = "relevance",
    descending: bool = True,
    id_col: str = "company_id",
    index: Index | None = None,
) -> Answer:
    """One page of hits with the facets and the total of the whole hit set.

    The hits are found once and written; page, total, best score and facets read them.
    """
    _check_size(size)
    if number < 1:
        raise ValueError("page numbers start at 1")
    if query and index is None:
        index = build_index(df, id_col, SERVICE)
    hits = cut(search(df, query, id_col, SERVICE, index, filters))
    order = [F.desc("score")] if sort_by == "relevance" else ordered_by(df, sort_by, descending)
    paged = hits.orderBy(*order, F.asc(id_col)).offset((number - 1) * size).limit(size)
    return Answer(
        hits.agg(F.count("*").alias("total")),
        hits.agg(F.max("score").alias("max_score")),
        paged,
        facets(hits),
        suggestions(index, query, SERVICE) if query and index else None,
    )


def competitors(
    df: DataFrame,
    name: str,
    industry: str | None = None,
    city: str | None = None,
    size: int = 20,
    id_col: str = "company_id",
    index: Index | None = None,
) -> DataFrame:
    """Companies with a similar name, the same industry (weight 2) or city (1.5)."""
    _check_size(size)
    index = index or build_index(df, id_col, ["legal_name"])
    clauses = [
        _scored_ids(index, name, {"legal_name": 1.0}, "best", True).select(F.col("id").alias(id_col), "score")
    ]
    total = df.agg(F.count("*").alias("n"))
    for field, value, boost in (("industry", industry, 2.0), ("city", city, 1.5)):
        if value:
            same = df.filter(F.col(field) == value).select(id_col)
            n, k = total.select("n").scalar(), same.agg(F.count("*")).scalar()
            # A keyword value has frequency and length one, which leaves the rarity.
            idf = F.log(1 + (n - k + 0.5) / (k + 0.5))
            clauses.append(same.withColumn("score", F.lit(boost) * idf))
    summed = reduce(DataFrame.unionByName, clauses).groupBy(id_col).agg(F.sum("score").alias("score"))
    top = summed.orderBy(F.desc("score"), F.asc(id_col)).limit(size)
    return df.join(F.broadcast(top), id_col).orderBy(F.desc("score"), F.asc(id_col))


def autocomplete(
    df: DataFrame,
    prefix: str,
    size: int = 10,
    name_cols: tuple[str, ...] = ("legal_name", "trade_name"),
    shown: tuple[str, ...] = ("legal_name", "trade_name", "city", "company_type"),
    fuzzy: bool = True,
) -> DataFrame:
    """Names that start with the prefix, or nearly so; fewest edits first.

    The first letter has to agree, which also lets sorted files be skipped.
    """
    plain = str.maketrans(ACCENTED, PLAIN)
    wanted = prefix.replace("İ", "i").lower().translate(plain)
    limit = allowed_edits(wanted) if fuzzy else 0

    def edits(name: str) -> Column:
        folded = fold_latin(F.lower(F.translate(F.col(name), "İ", "i")))
        best = F.when(folded.startswith(wanted), 0)
        for length in range(max(1, len(wanted) - limit), len(wanted) + limit + 1) if limit else ():
            near = edit_distance(F.left(folded, F.lit(length)), wanted, limit)
            best = F.least(best, F.when(F.left(folded, F.lit(1)) == wanted[:1], near))
        return best

    found = F.least(*[edits(n) for n in name_cols]) if len(name_cols) > 1 else edits(name_cols[0])
    hits = df.select(*shown, found.alias("edits")).filter("edits IS NOT NULL")
    return hits.orderBy("edits", *shown).limit(size)


# Lengths of the prefixes that are stored.
SHORTEST_PREFIX, LONGEST_PREFIX = 2, 20


@dataclass(frozen=True)
class PrefixIndex:
    names: DataFrame  # prefix, folded, shown...: sorted by prefix
    prefixes: DataFrame  # prefix: distinct
    shown: tuple[str, ...]


def _folded(name: Column) -> Column:
    return fold_latin(F.lower(F.translate(name, "İ", "i")))


def build_prefix_index(
    df: DataFrame,
    name_cols: tuple[str, ...] = ("legal_name", "trade_name"),
    shown: tuple[str, ...] = ("legal_name", "trade_name", "city", "company_type"),
    path: str | None = None,
) -> PrefixIndex:
    """Store each row under the prefixes of its folded names, laid out by prefix."""
    path = path or new_shared_path(df.sparkSession, "prefixes")
    folded = F.array_distinct(F.array_compact(F.array(*[_folded(F.col(n)) for n in name_cols])))
    named = df.select(F.explode(folded).alias("folded"), *shown)
    lengths = F.sequence(F.lit(SHORTEST_PREFIX), F.least(F.length("folded"), F.lit(LONGEST_PREFIX)))
    rows = named.filter(F.length("folded") >= SHORTEST_PREFIX).select(
        F.explode(F.transform(lengths, lambda n: F.left("folded", n))).alias("prefix"), "folded", *shown
    )
    # A prefix that very many names share spans files.
    rows.repartitionByRange("prefix", "folded").sortWithinPartitions("prefix").write.mode("overwrite").parquet(f"{path}/names")
    stored = df.sparkSession.read.parquet(f"{path}/names")
    distinct = stored.select("prefix").distinct().repartitionByRange("prefix").sortWithinPartitions("prefix")
    distinct.write.mode("overwrite").parquet(f"{path}/prefixes")
    return PrefixIndex(stored, df.sparkSession.read.parquet(f"{path}/prefixes"), shown)


def autocomplete_indexed(index: PrefixIndex, prefix: str, size: int = 10, fuzzy: bool = True) -> DataFrame:
    """What :func:`autocomplete` finds, by reading the rows of one prefix, or of near ones.

    The first letter has to agree, so near prefixes come from a range of the distinct ones.
    Prefixes of 2 to 18 letters are answered; beyond 18 only exact ones.
    """
    wanted = prefix.replace("İ", "i").lower().translate(str.maketrans(ACCENTED, PLAIN))
    limit = allowed_edits(wanted) if fuzzy else 0
    if len(wanted) < SHORTEST_PREFIX or (limit and len(wanted) + limit > LONGEST_PREFIX):
        raise ValueError(f"stored prefixes have {SHORTEST_PREFIX} to {LONGEST_PREFIX} letters")
    exact = index.names.filter(F.col("prefix") == wanted[:LONGEST_PREFIX])
    found = exact.filter(F.col("folded").startswith(wanted)).select(*index.shown, F.lit(0).alias("edits"))
    if limit:
        edits = edit_distance(F.col("prefix"), wanted, limit)
        lengths = F.length("prefix").between(max(1, len(wanted) - limit), len(wanted) + limit)
        near = index.prefixes.filter(F.col("prefix").startswith(wanted[0]) & lengths & edits.isNotNull())
        near = near.select("prefix", edits.alias("edits"))
        # Prefixes within two edits of one text: their number follows the alphabet, not the names.
        few = near.limit(LITERAL_TERMS + 1).collect()
        names = index.names
        if len(few) <= LITERAL_TERMS:
            near = near.sparkSession.createDataFrame(few, near.schema)
            names = names.filter(F.col("prefix").isin([r["prefix"] for r in few]))
        found = found.unionByName(names.join(near, "prefix").select(*index.shown, "edits"))
    # A row stands under several near prefixes and names, and has the fewest edits of them. Rows
    # that are shown alike are one suggestion.
    return found.groupBy(*index.shown).agg(F.min("edits").alias("edits")).orderBy("edits", *index.shown).limit(size)
