"""Record matching and merging: exact candidate keys, weighted scores, components, merge.

How pairs are found without comparing whole blocks
--------------------------------------------------
A score is a weighted sum of three yes/no fields (site, phone, e-mail host) and two graded
ones (name, address). For a given threshold only some combinations of equal yes/no fields
can still reach it: with the default weights every match shares the site, and shares also a
phone or an e-mail host, or has the very same name and address. ``candidate_rules`` derives
these combinations from weights and threshold, and each becomes an equi-join on all its
fields at once. Nothing that can reach the threshold is missed.

Copies (records equal in everything that is compared) are folded into one profile first, so
a group of copies costs one row however large it is. A key shared by very many profiles is
cut into slices that are paired tile by tile, as separate join keys, so no task gets the
group as a whole; inside the join a bound on the graded fields discards hopeless pairs.

Where the threshold leaves the name a least similarity over two thirds (0.8 for merging),
lengths are compared too, and a profile whose flags many share stands under the rarest pairs of
neighbouring letters of its name only, as many as similar names can't all differ in. Below that (0.4 for listing
matches by site and mail host) no prefix is short enough to leave anybody out.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmaforge.functions import similarity as sim
from firmaforge.functions import text
from firmaforge.operators.components import connected_components
from firmaforge.operators.near_equal import near_equal_keys
from firmaforge.operators.ranking import top_rows
from firmaforge.session import cut

# Field weights and thresholds.
WEIGHTS = {"domain": 0.35, "legal_name": 0.25, "phone": 0.15, "email": 0.15, "address": 0.10}
EXACT, REVIEW, MINIMUM = 0.95, 0.85, 0.70

FLAGS = ("domain", "phone", "email")
EPS = 1e-9


@dataclass(frozen=True)
class MatchConfig:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    exact: float = EXACT
    review: float = REVIEW
    minimum: float = MINIMUM
    # Profiles per slice of a key; a tile of two slices is one unit of comparing.
    slice_rows: int = 400
    # Keys of equal flags that more profiles share are split by the letter pairs of the names; the
    # few of the others are cheaper to compare than to be keyed by each pair.
    gram_rows: int = 32


def candidate_rules(weights: dict[str, float], threshold: float) -> list[tuple[str, ...]]:
    """Field combinations whose equality is necessary for a score of ``threshold``.

    Combinations that reach it only with full marks for name and address carry both as
    further equalities. Supersets of a weaker rule are left out.
    """
    graded = weights["legal_name"] + weights["address"]
    rules: list[tuple[str, ...]] = []
    strict: list[tuple[str, ...]] = []
    for size in range(len(FLAGS) + 1):
        for flags in combinations(FLAGS, size):
            slack = sum(weights[f] for f in flags) + graded - threshold
            if slack < -EPS or any(set(r) <= set(flags) for r in rules):
                continue
            (strict if slack < EPS else rules).append(flags)
    if () in rules:
        raise ValueError("threshold is reachable by name and address alone: no key to join on")
    minimal = [r for r in strict if not any(set(o) < set(r) for o in strict)]
    return rules + [(*r, "legal_name", "address") for r in minimal]


# --- blocking keys as a user-visible operator ---------------------------------------------


def blocking_keys(
    legal_name: Column, url: Column, phones: Column, city: Column, compat: bool = False
) -> Column:
    """Array of blocking keys; ``compat`` keeps the letter-dropping name key."""
    key = text.match_key(legal_name, compat)
    phone = text.normalize_phone(F.try_element_at(phones, F.lit(1)))
    return F.array_compact(
        F.array(
            F.concat(F.lit("domain:"), text.url_domain(url)),
            F.when(F.length(key) >= 3, F.concat(F.lit("name:"), F.left(key, F.lit(3)))),
            F.when(F.length(phone) >= 6, F.concat(F.lit("phone:"), F.left(phone, F.lit(6)))),
            F.when(F.length(city) > 0, F.concat(F.lit("city:"), F.upper(city))),
        )
    )


def composite_key(keys: Column) -> Column:
    """All keys as one text: records are then compared only where all of them agree."""
    return F.when(F.size(keys) > 0, F.array_join(keys, "|")).otherwise("unknown")


# --- profiles ------------------------------------------------------------------------------


def features(companies: DataFrame) -> DataFrame:
    """What matching compares, from nested company records."""
    c = F.col
    return match_features(
        companies.select(
            "id",
            c("identity.legal_name").alias("legal_name"),
            c("identity.city").alias("city"),
            c("web_presence.website_url").alias("website_url"),
            c("contacts.phones_public").alias("phones"),
            c("contacts.emails_public").alias("emails"),
            c("contacts.address_public").alias("address"),
        )
    )


def match_features(flat: DataFrame) -> DataFrame:
    """Normalised match fields from flat columns id, legal_name, city, website_url, phones,
    emails, address."""
    no_texts = F.array().cast("array<string>")

    def items(column: str, fn) -> Column:
        out = F.transform(F.coalesce(F.col(column), no_texts), fn)
        return F.sort_array(F.array_distinct(F.filter(F.array_compact(out), lambda x: F.length(x) > 0)))

    # Much work for few bytes, so the rows are dealt out by number and not by the size of files.
    parts = int(flat.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = ("id", "legal_name", "city", "website_url", "phones", "emails", "address")
    spread = flat.select(*needed).repartition(parts, "id", "website_url")
    # Fields without a usable value are empty, never null: profiles group and join on them.
    name = text.normalize_name(F.col("legal_name"))
    return spread.select(
        "id",
        (F.length(name) > 0).alias("has_name"),
        sim.token_sort_text(name).alias("name"),
        F.coalesce(text.url_domain(F.col("website_url")), F.lit("")).alias("domain"),
        items("phones", text.normalize_phone).alias("phones"),
        items("emails", text.email_domain).alias("hosts"),
        F.lower(text.normalize_address(F.col("address"))).alias("address"),
        blocking_keys(
            F.col("legal_name"), F.col("website_url"), F.col("phones"), F.col("city"), compat=True
        ).alias("keys"),
    )


PROFILE = ["has_name", "name", "domain", "phones", "hosts", "address"]


def with_profile(feats: DataFrame, compat: bool = False) -> DataFrame:
    """Add ``profile``: equal for records that are equal in everything compared."""
    block = composite_key(F.col("keys")) if compat else F.lit("")
    return feats.withColumn("block", block).withColumn(
        "profile", F.sha2(F.to_json(F.struct("block", *PROFILE)), 256)
    )


def profiles(profiled: DataFrame) -> DataFrame:
    """One row per profile: smallest record id, number of copies, compared values."""
    return profiled.groupBy("profile").agg(
        F.min("id").alias("id"),
        F.count("*").alias("copies"),
        *[F.any_value(c).alias(c) for c in ("block", *PROFILE)],
    )


def _prepared(feats: DataFrame, compat: bool) -> tuple[DataFrame, DataFrame]:
    """Records with their profile, written once since several joins read them, and profiles."""
    profiled = cut(with_profile(feats, compat).drop("keys"))
    return profiled, cut(profiles(profiled))


# --- scores --------------------------------------------------------------------------------


def _weighted(weights: dict[str, float], parts: dict[str, Column]) -> Column:
    """Sum in field order, then divided by the sum of weights, as floating-point wants it."""
    total, weight = F.lit(0.0), 0.0
    for name, value in parts.items():
        total = total + value * F.lit(weights[name])
        weight += weights[name]
    return total / F.lit(weight)


def _flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def _tiled(keyed: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join on ``_k`` with hot keys cut into square tiles.

    A key of n profiles is cut into s = n/rows slices. Tile (i, j) pairs slice i with slice j,
    i <= j, so every pair meets in exactly one tile and no task holds more than two slices of
    a key. Keys that fit one slice have the single tile (0, 0).
    """
    hot = (
        keyed.groupBy("_k")
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > rows)
        .select("_k", F.ceil(F.col("_n") / rows).cast("int").alias("_slices"))
    )
    # At most one row per ``rows`` profiles, usually none; AQE broadcasts it only when small.
    names = keyed.columns
    slices = F.coalesce("_slices", F.lit(1))
    own = F.pmod(F.xxhash64("profile"), slices).cast("int")
    sized = keyed.join(hot, "_k", "left").select(*names, slices.alias("_slices"), own.alias("_own"))
    left = sized.select(*names, F.col("_own").alias("_i"), F.explode(F.sequence(F.col("_own"), F.col("_slices") - 1)).alias("_j"))
    right = sized.select(*names, F.col("_own").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_i"))
    # Few bytes may mean many comparisons, so these partitions are counted out and not left to
    # be coalesced by size.
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    on = ["_k", "_i", "_j"]
    return left.repartition(parts, *on), right.repartition(parts, *on)


def _equal_flags() -> dict[str, Column]:
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    return {
        "domain": (a("domain") != "") & (a("domain") == b("domain")),
        "phone": F.arrays_overlap(a("phones"), b("phones")),
        "email": F.arrays_overlap(a("hosts"), b("hosts")),
    }


def _bag(name: Column) -> Column:
    """Characters of an ASCII text as integers, numbered by occurrence: the size of the
    intersection of two bags is an upper bound of the common subsequence."""
    codes = F.sort_array(F.transform(F.filter(F.split(name, ""), lambda x: x != ""), F.ascii))
    return _numbered(codes)


def _numbered(ordered: Column) -> Column:
    """Numbers in order, those that are equal told apart by a count.

    The array is bound to a variable: an expression in its place would be worked out for each item.
    """
    return F.transform(
        F.array(ordered),
        lambda xs: F.transform(xs, lambda x, i: F.shiftleft(x.cast("long"), 32) + i - F.array_position(xs, x)),
    )[0]


def _parts(flags: dict[str, Column], name: Column, address: Column) -> dict[str, Column]:
    return {
        "domain": _flag(flags["domain"]),
        "legal_name": name,
        "phone": _flag(flags["phone"]),
        "email": _flag(flags["email"]),
        "address": address,
    }


def _graded(name: Column, address: Column) -> tuple[Column, Column]:
    both_names = F.col("a.has_name") & F.col("b.has_name")
    both_addresses = (F.col("a.address") != "") & (F.col("b.address") != "")
    return F.when(both_names, name).otherwise(0.0), F.when(both_addresses, address).otherwise(0.0)


def _score_bound(weights: dict[str, float]) -> Column:
    """No pair scores higher than this; cheap enough to sit in the join condition."""
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    shared = F.size(F.array_intersect(a("bag"), b("bag")))
    shorter = F.least(F.length(a("address")), F.length(b("address")))
    name, address = _graded(
        sim.ratio_from_lcs(shared, a("name"), b("name")),
        sim.ratio_from_lcs(shorter, a("address"), b("address")),
    )
    return _weighted(weights, _parts(_equal_flags(), name, address))


def least_name_similarity(weights: dict[str, float], rules: list[tuple[str, ...]], at: int, threshold: float) -> float:
    """What the name must score in a pair that rule ``at`` finds and no earlier one does.

    The address has full marks in this, and so have flags of the pair that the rule does not
    ask for, as long as they would not let an earlier rule find it.
    """
    own = set(rules[at]) & set(FLAGS)
    earlier = [set(r) for r in rules[:at]]
    others = [f for f in FLAGS if f not in own]
    best = 0.0
    for size in range(len(others) + 1):
        for more in combinations(others, size):
            if not any(e <= own | set(more) for e in earlier):
                best = max(best, sum(weights[f] for f in (*own, *more)))
    return (threshold * sum(weights.values()) - best - weights["address"]) / weights["legal_name"]


def _prefix_share(least: float) -> float | None:
    """The share of a name's letters that prefixes of its grams have to cover; None: no use.

    With a common subsequence of L letters, dx letters of one name and dy of the other are
    lost, and 2 L >= r (2 L + dx + dy). A lost letter spoils two pairs of neighbours, an added
    one spoils one, so 2 dx + dy pairs at most, which is greatest for dy = 0.
    """
    r = least - 0.005 - EPS  # scores are rounded to whole percents
    if r <= 2 / 3:
        return None
    c = 2 * (1 - r) / r
    return 2 * c / (1 + c)


def _gram_ranks(prof: DataFrame) -> Column:
    """Place of each pair of ASCII characters in an order from rare to frequent, by its code.

    Counted over all names; there are 2^14 pairs at most, whatever the number of names.
    """
    counted = prof.select(F.explode(_gram_codes(F.col("name"))).alias("code")).groupBy("code").count().collect()
    ranks = [0] * (1 << 14)
    for rank, row in enumerate(sorted(counted, key=lambda row: (row["count"], row["code"]))):
        ranks[row["code"]] = rank
    return F.from_json(F.lit(json.dumps(ranks)), "array<int>")


def _gram_codes(name: Column) -> Column:
    """Pairs of neighbours of an ASCII text with one space around it, as numbers."""
    spaced = F.concat(F.lit(" "), name, F.lit(" "))
    return F.transform(
        F.sequence(F.lit(1), F.length(name) + 1),
        lambda i: F.ascii(F.substring(spaced, i, F.lit(1))) * 128 + F.ascii(F.substring(spaced, i + 1, F.lit(1))),
    )


def _gram_prefix(name: Column, ranks: Column, share: float) -> Column:
    """The rarest grams of a name, numbered by occurrence: similar names have one in common."""
    ranked = F.sort_array(F.transform(_gram_codes(name), lambda code: F.get(ranks, code)))
    return F.slice(_numbered(ranked), 1, (F.floor(F.length(name) * share + 1e-9) + 1).cast("int"))


# No number of a gram: those start at -1.
NO_PIECE = -2


def _by_grams(keyed: DataFrame, rules: list[int], rows: int) -> DataFrame:
    """Profiles of keys that more than ``rows`` share, under each gram of their prefix; others as they are.

    The grams stay with the former only.
    """
    crowded = keyed.filter(F.col("rule").isin(rules)).groupBy("_k").agg(F.count("*").alias("_n"))
    crowded = crowded.filter(F.col("_n") > rows).select("_k", F.lit(True).alias("_crowded"))
    grams = {f"grams_{at}": F.when(F.col("_crowded") & (F.col("rule") == at), F.col(f"grams_{at}")) for at in rules}
    pieces = F.coalesce(*[F.col(g) for g in grams], F.array("piece"))
    names = [n for n in keyed.columns if n not in ("piece", "_k")]
    marked = keyed.join(crowded, "_k", "left").withColumns(grams)
    return marked.select(*names, F.explode(pieces).alias("piece"))


def candidate_pairs(prof: DataFrame, cfg: MatchConfig = MatchConfig(), threshold: float | None = None) -> DataFrame:
    """Pairs (a, b) of profiles that may reach the threshold, each exactly once.

    All rules are keyed into one table and joined at once. Where a rule leaves the name a least
    similarity over two thirds, profiles with equal flags meet only if their lengths allow it, and,
    where more than ``gram_rows`` share the flags, if the names share one of their rarest grams.
    """
    threshold = cfg.minimum if threshold is None else threshold
    rules = candidate_rules(cfg.weights, threshold)
    c = F.col
    shares = [
        None if "legal_name" in rule else _prefix_share(least_name_similarity(cfg.weights, rules, at, threshold))
        for at, rule in enumerate(rules)
    ]
    least = [least_name_similarity(cfg.weights, rules, at, threshold) - 0.005 - EPS for at in range(len(rules))]
    ranks = _gram_ranks(prof) if any(shares) else None
    held = prof.withColumns(
        {
            "bag": _bag(c("name")),
            "pieces": near_equal_keys(c("name"), c("address"))
            if any("legal_name" in rule for rule in rules)
            else F.array().cast("array<long>"),
            **{f"grams_{at}": _gram_prefix(c("name"), ranks, share) for at, share in enumerate(shares) if share},
        }
    )
    held = cut(held) if any(shares) or len(rules) > 1 else held
    none, nothing = F.array(F.lit("")), F.array(F.lit(NO_PIECE).cast("long"))

    def keys_of(at: int) -> Column:
        rule = rules[at]
        phones = c("phones") if "phone" in rule else none
        hosts = c("hosts") if "email" in rule else none
        pieces = c("pieces") if "legal_name" in rule else nothing
        usable = (c("domain") != "") if "domain" in rule else F.lit(True)
        if "legal_name" in rule:
            usable = usable & c("has_name") & (c("address") != "")
        if shares[at]:
            usable = usable & c("has_name")

        def item(phone: Column, host: Column, piece: Column) -> Column:
            return F.struct(
                F.lit(at).alias("rule"), phone.alias("phone"), host.alias("host"), piece.alias("piece")
            )

        made = F.flatten(
            F.flatten(F.transform(phones, lambda p: F.transform(hosts, lambda h: F.transform(pieces, lambda g: item(p, h, g)))))
        )
        return F.when(usable, made)

    every = F.flatten(F.array_compact(F.array(*[keys_of(at) for at in range(len(rules))])))
    key = F.xxhash64("rule", "block", "domain", "phone", "host", "piece")
    keyed = held.select(*held.columns, F.inline(every)).withColumn("_k", key)
    by_grams = [at for at, share in enumerate(shares) if share]
    if by_grams:
        keyed = _by_grams(keyed, by_grams, cfg.gram_rows).withColumn("_k", key)
    left, right = _tiled(keyed, cfg.slice_rows)
    equal = _equal_flags()

    def smallest(name: str) -> Column:
        return F.array_min(F.array_intersect(c(f"a.{name}"), c(f"b.{name}")))

    met = None
    for at, rule in enumerate(rules):
        conds = [equal[f] for f in rule if f in equal]
        if "phone" in rule:
            conds.append(c("a.phone") == smallest("phones"))
        if "email" in rule:
            conds.append(c("a.host") == smallest("hosts"))
        if shares[at]:
            one, two = F.length("a.name"), F.length("b.name")
            conds.append(2 * F.least(one, two) >= least[at] * (one + two))
            conds.append((c("a.piece") == NO_PIECE) | (c("a.piece") == smallest(f"grams_{at}")))
        if "legal_name" in rule:
            conds.append(c("a.piece") == smallest("pieces"))
        for earlier in rules[:at]:
            found = reduce(lambda x, y: x & y, [equal[f] for f in earlier if f in equal], F.lit(True))
            if "legal_name" in earlier:
                texts = (c("a.address") != "") & (c("b.address") != "") & F.arrays_overlap("a.pieces", "b.pieces")
                found = found & c("a.has_name") & c("b.has_name") & texts
            conds.append(~found)
        here = reduce(lambda x, y: x & y, conds)
        met = F.when(c("a.rule") == at, here) if met is None else met.when(c("a.rule") == at, here)
    on = F.lit(True)
    for part in ("_k", "_i", "_j", "rule", "block", "phone", "host", "piece"):
        on = on & (c(f"a.{part}") == c(f"b.{part}"))
    on = on & ((c("a._i") < c("a._j")) | (c("a.id") < c("b.id"))) & met
    on = on & (_score_bound(cfg.weights) >= threshold - EPS)
    fields = ["id", "copies", *PROFILE]
    pairs = left.alias("a").join(right.alias("b"), on)
    return pairs.select(*[F.struct(*[c(f"{s}.{f}") for f in fields]).alias(s) for s in "ab"])


def _scored(pairs: DataFrame, cfg: MatchConfig) -> DataFrame:
    def common(field: str) -> Column:
        # Equal texts need no counting; a null costs nothing.
        one, two = F.col(f"a.{field}"), F.col(f"b.{field}")
        return sim.lcs_length_arrow(F.when(one != two, one), two)

    ratios = pairs.withColumns({"_name_lcs": common("name"), "_address_lcs": common("address")})
    name, address = _graded(
        sim.ratio_from_lcs(F.col("_name_lcs"), F.col("a.name"), F.col("b.name")),
        sim.ratio_from_lcs(F.col("_address_lcs"), F.col("a.address"), F.col("b.address")),
    )
    parts = _parts(_equal_flags(), name, address)
    in_order = F.col("a.id") < F.col("b.id")

    def first_of(field: str, swap: bool) -> Column:
        one, two = F.col(f"a.{field}"), F.col(f"b.{field}")
        return F.when(in_order, two if swap else one).otherwise(one if swap else two)

    return ratios.select(
        first_of("id", False).alias("company_a_id"),
        first_of("id", True).alias("company_b_id"),
        first_of("copies", False).alias("copies_a"),
        first_of("copies", True).alias("copies_b"),
        _weighted(cfg.weights, parts).alias("match_score"),
        F.create_map(*[x for n, v in parts.items() for x in (F.lit(n), v)]).alias("match_fields"),
    )


def _labelled(scored: DataFrame, cfg: MatchConfig) -> DataFrame:
    score = F.col("match_score")
    return scored.select(
        "company_a_id",
        "company_b_id",
        "match_score",
        "match_fields",
        F.when(score >= cfg.exact, "exact").otherwise("fuzzy").alias("match_type"),
        ((score >= cfg.review) & (score < cfg.exact)).alias("requires_review"),
        *[c for c in scored.columns if c.startswith("copies")],
    )


def profile_matches(prof: DataFrame, cfg: MatchConfig = MatchConfig(), threshold: float | None = None) -> DataFrame:
    """Matches between different profiles, by the smallest record id of each.

    ``copies_a * copies_b`` record pairs stand behind a row.
    """
    threshold = cfg.minimum if threshold is None else threshold
    pairs = candidate_pairs(prof, cfg, threshold)
    return _labelled(_scored(pairs, cfg).filter(F.col("match_score") >= threshold), cfg)


def _self_parts() -> dict[str, Column]:
    flags = {
        "domain": F.col("domain") != "",
        "phone": F.size("phones") > 0,
        "email": F.size("hosts") > 0,
    }
    return _parts(flags, _flag(F.col("has_name")), _flag(F.col("address") != ""))


def copy_matches(profiled: DataFrame, prof: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Matches inside the groups of copies: every copy with the first record of its group.

    All copies of a group score the same with each other, so these rows carry everything the
    full list of pairs would.
    """
    parts = _self_parts()
    groups = prof.filter(F.col("copies") > 1).select(
        "profile",
        F.col("id").alias("company_a_id"),
        _weighted(cfg.weights, parts).alias("match_score"),
        F.create_map(*[x for n, v in parts.items() for x in (F.lit(n), v)]).alias("match_fields"),
    )
    pairs = (
        profiled.select("profile", F.col("id").alias("company_b_id"))
        .join(groups.filter(F.col("match_score") >= cfg.minimum), "profile")
        .filter("company_b_id <> company_a_id")
    )
    return _labelled(pairs, cfg)


def find_matches(feats: DataFrame, cfg: MatchConfig = MatchConfig(), compat: bool = False) -> DataFrame:
    """Match edges between records; copies are joined to the first of their group.

    ``compat`` compares only records whose blocking keys all agree.
    """
    profiled, prof = _prepared(feats, compat)
    return (
        profile_matches(prof, cfg).drop("copies_a", "copies_b").unionByName(copy_matches(profiled, prof, cfg))
    )


def expand_matches(feats: DataFrame, cfg: MatchConfig = MatchConfig(), compat: bool = False) -> DataFrame:
    """Every matching pair of records spelt out. The size is that of the answer: use
    :func:`find_matches` where large groups of copies are about."""
    profiled, prof = _prepared(feats, compat)
    member = profiled.select("profile", F.col("id").alias("member"))
    by_first = prof.select("profile", F.col("id").alias("first"))
    named = member.join(by_first, "profile").select("first", "member")
    across = (
        # Written down first: scoring is not to be planned, let alone run, inside these joins.
        cut(profile_matches(prof, cfg))
        .drop("copies_a", "copies_b")
        .join(named.select(F.col("first").alias("company_a_id"), F.col("member").alias("_a")), "company_a_id")
        .join(named.select(F.col("first").alias("company_b_id"), F.col("member").alias("_b")), "company_b_id")
    )
    ordered = across.select(
        F.least("_a", "_b").alias("company_a_id"),
        F.greatest("_a", "_b").alias("company_b_id"),
        "match_score", "match_fields", "match_type", "requires_review",
    )
    within = copy_matches(profiled, prof, cfg)
    others = within.select("company_a_id", F.col("company_b_id").alias("_c"))
    inside = within.join(others, "company_a_id").filter("company_b_id < _c").select(
        F.col("company_b_id").alias("company_a_id"),
        F.col("_c").alias("company_b_id"),
        "match_score", "match_fields", "match_type", "requires_review",
    )
    return ordered.unionByName(within).unionByName(inside)


def review_queue(matches: DataFrame) -> DataFrame:
    """Matches that a person has to decide."""
    return matches.filter("requires_review").withColumns(
        {"reviewed_at": F.lit(None).cast("timestamp"), "reviewed_by": F.lit(None).cast("string")}
    )


# --- groups and merge ----------------------------------------------------------------------


def merge_groups(feats: DataFrame, cfg: MatchConfig = MatchConfig(), compat: bool = False) -> DataFrame:
    """``id``, ``component`` for every record that has to be merged with another.

    Works on one row per profile: copies follow their profile. Only pairs at or above the
    exact threshold are looked for, which the stricter candidate rules make cheap.
    """
    profiled, prof = _prepared(feats, compat)
    return _groups(profiled, prof, profile_matches(prof, cfg, threshold=cfg.exact), cfg)


def _groups(profiled: DataFrame, prof: DataFrame, edges: DataFrame, cfg: MatchConfig) -> DataFrame:
    parts = connected_components(edges, "company_a_id", "company_b_id")
    alone = _weighted(cfg.weights, _self_parts()) >= cfg.exact
    grouped = (
        prof.join(parts, prof["id"] == parts["node"], "left")
        .select(
            "profile",
            F.coalesce("component", F.when(alone & (F.col("copies") > 1), F.col("id"))).alias("component"),
        )
        .filter(F.col("component").isNotNull())
    )
    return profiled.select("id", "profile").join(grouped, "profile").select("id", "component")


def _first(value: Column, order: Column) -> Column:
    """The first value in record order that is present."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def _text(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def running_mean(values: DataFrame, group: str, order: str, value: str, spread: int = 16) -> DataFrame:
    """The value left after averaging a group one record at a time, in order.

    A record's weight halves with every record after it. The smallest half that a double holds
    is 2^-1074, so earlier records than the last 1,100 weigh exactly nothing; the last ones
    are taken per slice of the group first and then overall.
    """
    from pyspark.sql import Window

    keep = 1100
    slice_ = F.pmod(F.xxhash64(order), F.lit(spread))
    per_slice = Window.partitionBy(group, "_s").orderBy(F.desc(order))
    overall = Window.partitionBy(group).orderBy(F.desc(order))
    last = (
        values.select(group, order, value, slice_.alias("_s"))
        .withColumn("_r", F.row_number().over(per_slice))
        .filter(F.col("_r") <= keep)
        .withColumn("_r", F.row_number().over(overall))
        .filter(F.col("_r") <= keep)
    )
    listed = last.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_l"))
    start = F.element_at("_l", 1)[value]
    mean = F.aggregate(F.slice("_l", 2, keep), start, lambda acc, x: (acc + x[value]) / 2)
    return listed.select(group, mean.alias(value))


def merge(companies: DataFrame, groups: DataFrame) -> DataFrame:
    """One record per component: the first record completed from the others.

    Entries of ``provenance`` are kept by :func:`merged_provenance` as rows, since a group of
    copies may have more of them than one record can hold; the column is null here.
    """
    c = F.col
    rows = companies.join(groups, "id")
    order = c("id")
    web, contacts, meta = c("web_presence"), c("contacts"), c("business_meta")
    address = _text("contacts.address_public")
    firsts = {
        f: _first(_text(f"identity.{f}"), order) for f in ("trade_name", "company_type", "city", "district")
    }
    base = [n for n in companies.columns if n not in ("provenance", "confidence_score")]
    scalars = rows.groupBy("component").agg(
        F.min_by(F.struct(*base), order).alias("_base"),
        *[v.alias(f"_{n}") for n, v in firsts.items()],
        _first(web, order).alias("_web"),
        _first(_text("web_presence.website_url"), order).alias("_site"),
        _first(c("web_presence.google_places"), order).alias("_places"),
        _first(contacts, order).alias("_contacts"),
        F.min_by(address, F.when(address.isNotNull(), F.struct(-F.length(address), order))).alias("_address"),
        _first(meta, order).alias("_meta"),
        *[
            _first(_text(f"business_meta.{f}"), order).alias(f"_{f}")
            for f in ("industry_naics_guess", "sic_guess", "headcount_band_guess")
        ],
        _first(c("business_meta.founding_year_guess"), order).alias("_founding_year_guess"),
    )

    none = F.array().cast("array<struct<kind:string,item:string,value:string>>")

    def listed(kind: str, array: Column) -> Column:
        made = F.transform(
            array,
            lambda x: F.struct(
                F.lit(kind).alias("kind"), x.alias("item"), F.lit(None).cast("string").alias("value")
            ),
        )
        return F.coalesce(made, none)

    links = F.transform(
        F.map_entries("web_presence.social_links"),
        lambda e: F.struct(F.lit("social").alias("kind"), e["key"].alias("item"), e["value"].alias("value")),
    )
    items = (
        rows.select(
            "component",
            "id",
            F.explode(
                F.concat(
                    listed("email", c("contacts.emails_public")),
                    listed("phone", c("contacts.phones_public")),
                    listed("keyword", c("business_meta.keywords")),
                    F.coalesce(links, none),
                )
            ).alias("_i"),
        )
        .select("component", "id", "_i.*")
        # Distinct values per group first; for social links the last record wins.
        .groupBy("component", "kind", "item")
        .agg(F.max_by("value", "id").alias("value"))
    )
    keywords = top_rows(items.filter("kind = 'keyword'"), ["component"], [F.asc("item")], 50)
    gathered = (
        items.filter("kind <> 'keyword'")
        .unionByName(keywords)
        .groupBy("component")
        .agg(
            *[
                F.sort_array(F.collect_list(F.when(c("kind") == k, c("item")))).alias(f"_{k}s")
                for k in ("email", "phone", "keyword")
            ],
            F.map_from_entries(
                F.sort_array(F.collect_list(F.when(c("kind") == "social", F.struct("item", "value"))))
            ).alias("_social"),
        )
    )
    confidence = running_mean(rows, "component", "id", "confidence_score")
    full = scalars.join(gathered, "component", "left").join(confidence, "component", "left")

    def with_fields(struct: Column, **fields: Column) -> Column:
        out = struct
        for name, value in fields.items():
            out = out.withField(name, value)
        return F.when(struct.isNotNull(), out)

    replaced = {
        "identity": with_fields(c("_base.identity"), **{n: c(f"_{n}") for n in firsts}),
        "web_presence": with_fields(
            c("_web"), website_url=c("_site"), social_links=c("_social"), google_places=c("_places")
        ),
        "contacts": with_fields(
            c("_contacts"), emails_public=c("_emails"), phones_public=c("_phones"), address_public=c("_address")
        ),
        "business_meta": with_fields(
            c("_meta"),
            keywords=c("_keywords"),
            **{
                f: c(f"_{f}")
                for f in ("industry_naics_guess", "sic_guess", "headcount_band_guess", "founding_year_guess")
            },
        ),
        "provenance": F.lit(None),
        "confidence_score": c("confidence_score"),
    }
    return full.select(
        *[
            replaced.get(f.name, c(f"_base.{f.name}")).cast(f.dataType).alias(f.name)
            for f in companies.schema.fields
        ]
    )


def merged_provenance(companies: DataFrame, groups: DataFrame) -> DataFrame:
    """All provenance entries by the id of the record that now stands for them."""
    return _provenance_rows(companies.join(groups, "id", "left"), F.coalesce("component", "id"))


def _provenance_rows(companies: DataFrame, owner: Column) -> DataFrame:
    return companies.select(owner.alias("id"), F.explode("provenance").alias("_p")).select("id", "_p.*")


def aliases(companies: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct legal and trade names behind every merged record."""
    names = F.array(
        F.struct(F.lit("legal").alias("kind"), F.col("identity.legal_name").alias("name")),
        F.struct(F.lit("trade").alias("kind"), F.col("identity.trade_name").alias("name")),
    )
    return (
        companies.join(groups, "id")
        .select("component", F.explode(names).alias("_n"))
        .select(F.col("component").alias("id"), "_n.kind", "_n.name")
        .filter("name <> ''")
        .distinct()
    )


@dataclass(frozen=True)
class Resolution:
    companies: DataFrame
    matches: DataFrame
    groups: DataFrame | None
    provenance: DataFrame  # one row for each entry of every record, by the id that stands for it


def resolve(
    companies: DataFrame, cfg: MatchConfig = MatchConfig(), auto_merge: bool = True, compat: bool = False
) -> Resolution:
    """Merged groups and untouched records, the match list, and who was merged with whom."""
    profiled, prof = _prepared(features(companies), compat)
    # Scored once: the edges of the groups are the matches at or above the exact threshold.
    scored = cut(profile_matches(prof, cfg))
    matches = scored.drop("copies_a", "copies_b").unionByName(copy_matches(profiled, prof, cfg))
    if not auto_merge:
        return Resolution(companies, matches, None, _provenance_rows(companies, F.col("id")))
    groups = cut(_groups(profiled, prof, scored.filter(F.col("match_score") >= cfg.exact), cfg))
    # Entries are rows of their own for all records, so the column is null in all of them.
    nothing = F.lit(None).cast(companies.schema["provenance"].dataType)
    untouched = companies.join(groups.select("id"), "id", "left_anti").select(*companies.columns)
    untouched = untouched.withColumn("provenance", nothing)
    return Resolution(
        merge(companies, groups).unionByName(untouched), matches, groups, merged_provenance(companies, groups)
    )
