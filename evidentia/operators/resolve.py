"""Entity resolution: match rules as equi-joins, sticky decisions, components, representatives.

Entities have entity_id, entity_type, canonical_name, source_system, scheme and identifier.
Names are standardised once (``standardise_names``) and all rules join on those columns.

The match table of a rule holds all its pairs, so a group of g equal keys has g * (g - 1) / 2
of them by definition.  For components that is not needed: ``star_edges`` links each member of
a group to the least one, in numbers that grow with the rows, and gives the same components.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evidentia.functions import text
from evidentia.functions.ids import item_id, pair_id, sql_pair_id
from evidentia.plans.storage import through_files
from evidentia.sources.staging import view, with_views

from .components import connected_components

BLOCK_CAP = 80
#: Rows of a key that are paired with all rows of it in one task, and the slices that a larger key has at most.
SLICE, MAX_SLICES = 500, 64
#: confidence and least key length of each rule
RULES = {
    "payment_channel": 0.99, "exact_clean_name": 0.995, "legal_suffix": 0.99, "near_typo": 0.995,
    "whitespace_join": 0.997, "conservative_one_edit": 0.996,
}


def standardise_names(entities: DataFrame) -> DataFrame:
    """Adds every key and flag of the name that rules join on."""
    n = F.col("canonical_name")
    return entities.withColumns({
        "normalized_name": text.normalize_name(n),
        "org_key": text.normalize_org_name(n),
        "analysis_key": text.analysis_org_key(n),
        "basic_key": text.basic_org_key(n),
        "channel": text.payment_channel(n),
        "legal_suffix": text.raw_legal_suffix(n),
        "plausible": text.is_plausible_org_name(n),
        "payee_class": text.payee_class(n),
    })


def name_quality_profile(named: DataFrame) -> DataFrame:
    """Counts by entity type, plausibility, payee class and channel."""
    return named.groupBy("entity_type", "plausible", "payee_class", "channel").agg(F.count("*").alias("n"))


def organisations(named: DataFrame) -> DataFrame:
    return named.filter(F.col("entity_type").isin(*text.ORG_TYPES))


def canonical_aliases(named: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(entity_id, alias_text, normalized_alias) of organisations; those that exist stay as they are."""
    rows = organisations(named).filter("org_key <> ''").select("entity_id", F.col("canonical_name").alias("alias_text"), F.col("org_key").alias("normalized_alias"))
    return rows if existing is None else existing.unionByName(rows.join(existing.select("entity_id", "normalized_alias"), ["entity_id", "normalized_alias"], "left_anti"))


def entity_identifiers(named: DataFrame) -> DataFrame:
    """(entity_id, scheme, identifier): scheme in lower case, identifier in upper case without spaces."""
    rows = named.filter("scheme IS NOT NULL AND identifier IS NOT NULL")
    return rows.select("entity_id", F.lower("scheme").alias("scheme"), F.upper(F.regexp_replace("identifier", r"\s+", "")).alias("identifier")).distinct()


def evidence_of(**parts: Column) -> Column:
    """JSON of what a match rests on: keys in order, absent values as nulls."""
    return F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"})


def _both(column: str, name: str | None = None) -> dict[str, Column]:
    return {f"left_{name or column}": F.col(f"a.{column}"), f"right_{name or column}": F.col(f"b.{column}")}


def _names() -> dict[str, Column]:
    return _both("canonical_name", "name")


def _sides(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of the pairs of equal keys, and the keys to join them on.

    All pairs of a key are the result, but one task need not make them: a key of more than SLICE
    rows has slices, and a row of it lies in one of them on the left and in all on the right.
    What is shuffled is rows, at most MAX_SLICES copies of each.
    """
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > SLICE)
    large = through_files(large.select(*keys, F.least(F.ceil(F.col("_n") / SLICE), F.lit(MAX_SLICES)).cast("int").alias("_slices")))
    if large.isEmpty():
        return rows, rows, keys
    cut = rows.join(large, keys, "left").withColumn("_slices", F.coalesce("_slices", F.lit(1)))
    left = cut.withColumn("_slice", F.pmod(F.xxhash64("entity_id"), F.col("_slices")).cast("int"))
    right = cut.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    # a number of its own, as slices are few bytes and much work, and would be put together again
    n = 3 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(n, *keys, "_slice"), right.repartition(n, *keys, "_slice"), [*keys, "_slice"]


def _pairs(rows: DataFrame, keys: list[str], method: str, shown: dict[str, Column] | Column, keep: Column | None = None, capped: bool = False, more: tuple = ()) -> DataFrame:
    """(left_id, right_id, match_id, match_method, evidence) of rows with equal keys, and a residual on columns of both.

    ``shown`` may be the evidence itself; ``capped`` says that no key has many rows; ``more`` are columns to add.
    """
    left, right, keys = (rows, rows, keys) if capped else _sides(rows, keys)
    a, b = left.alias("a"), right.alias("b")
    on = keep
    for k in reversed(keys):
        same = F.col(f"a.{k}") == F.col(f"b.{k}")
        on = same if on is None else same & on
    return _paired(a, b, on, method, shown, more)


def _paired(a: DataFrame, b: DataFrame, on: Column, method: str, shown: dict[str, Column] | Column, more: tuple = ()) -> DataFrame:
    """The matches of rows (aliased a and b) that meet ``on``, the lesser entity on the left."""
    return a.join(b, (F.col("a.entity_id") < F.col("b.entity_id")) & on).select(
        F.col("a.entity_id").alias("left_id"), F.col("b.entity_id").alias("right_id"),
        pair_id(F.col("a.entity_id"), F.col("b.entity_id"), method).alias("match_id"), F.lit(method).alias("match_method"),
        (evidence_of(**shown) if isinstance(shown, dict) else shown).alias("evidence"), *more,
    )


def _told_once(rows: DataFrame, keys: list[str], method: str, shown: dict[str, Column], unsure: Column, carried: tuple = ()) -> DataFrame:
    """``_pairs`` of entities with any number of keys, and ``unsure``: of several keys in common the surest tells the pair, then the least evidence.

    What the keys of an entity would tell goes along with each of them, so that a pair is judged
    where it is made and pairs are never shuffled.  ``carried`` are flags of entities, for both sides.
    """
    key = F.struct(*keys, F.struct(unsure.alias("unsure"), evidence_of(**shown).alias("evidence")).alias("_told"))
    held = rows.filter("entity_id IS NOT NULL").groupBy("entity_id").agg(F.collect_set(key).alias("_keys"), *[F.max(c).alias(c) for c in carried])
    each = held.select("entity_id", *carried, F.when(F.size("_keys") > 1, F.col("_keys._told")).alias("_all"), F.explode("_keys").alias("_key")).select("entity_id", *carried, "_all", "_key.*")
    first = F.coalesce(F.array_min(F.array_intersect("a._all", "b._all")) == F.col("a._told"), F.lit(True))
    flags = [x.alias(n) for c in carried for n, x in _both(c).items()]
    return _pairs(each, keys, method, F.col("a._told.evidence"), first, more=(F.col("a._told.unsure").alias("unsure"), *flags))


def _scored(pairs: DataFrame, confidence, status: str = "auto_accepted") -> DataFrame:
    return pairs.withColumns({"confidence": confidence if isinstance(confidence, Column) else F.lit(confidence), "status": F.lit(status)})


def match_identifier_exact(identifiers: DataFrame) -> DataFrame:
    keys = ["scheme", "identifier"]
    return _scored(_told_once(identifiers, keys, "identifier_exact", {k: F.col(k) for k in keys}, F.lit(False)).drop("unsure"), 1.0)


def match_name_exact(aliases: DataFrame, carried: tuple = ()) -> DataFrame:
    """Equal aliases of 5 or more characters: automatic with two words or 10 characters, else for review.

    A pair with several such aliases is told by the surest of them.  ``carried`` are flags of the
    aliases' entities that the matches get, as left_ and right_ columns.
    """
    name = F.col("normalized_alias")
    sure = (F.instr(name, " ") > 0) | (F.length(name) >= 10)
    best = _told_once(aliases.filter(F.length(name) >= 5), ["normalized_alias"], "normalized_name_exact", {"normalized_name": name}, ~sure, carried)
    return _scored(best, F.when(F.col("unsure"), 0.93).otherwise(0.97)).withColumn("status", F.when(F.col("unsure"), "review").otherwise("auto_accepted")).drop("unsure")


def block_sizes(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their first word, and the words (block) that at most BLOCK_CAP rows share, counted per task before the shuffle."""
    rows = rows.withColumn("block", F.split(key, " ")[0])
    return rows, rows.groupBy("block").agg(F.count("*").alias("_n")).filter(F.col("_n") <= BLOCK_CAP).select("block")


def blocked(rows: DataFrame, key: str) -> DataFrame:
    """Rows with their first word, for words that at most BLOCK_CAP rows share.

    The cap is part of the rule: larger blocks make no match.  Counts are joined back, so a
    word that very many rows share is counted per task and then dropped before any pair.
    """
    rows, small = block_sizes(rows, key)
    return rows.join(small, "block", "left_semi")


@F.pandas_udf(DoubleType())
def ratcliff_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of matching blocks of two strings (Ratcliff and Obershelp); depends on the order."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def letter_bag(key: str) -> Column:
    """The letters of a text, each with its number among its like: bags meet in as many as the texts have in common."""
    return text.let(F.array_sort(F.split(key, "")), lambda c: F.transform(c, lambda x, i: F.concat(x, (i + 1 - F.array_position(c, x)).cast("string"))))


def similar_candidates(aliases: DataFrame, least: float = 0.88) -> DataFrame:
    """Pairs of aliases (left_id, right_id, left_name, right_name, bound) of one block whose ratio can reach ``least``.

    The matching blocks of two texts hold no more letters than they have in common, so twice
    that number by the sum of lengths bounds the ratio.  Both tests are JVM expressions.
    """
    rows = blocked(aliases.filter(F.length("normalized_alias") >= 8), "normalized_alias").withColumn("bag", letter_bag("normalized_alias"))
    a, b = rows.alias("a"), rows.alias("b")
    x, y = F.length("a.normalized_alias"), F.length("b.normalized_alias")
    bound = 2 * F.size(F.array_intersect("a.bag", "b.bag")) / (x + y)
    pairs = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.entity_id") < F.col("b.entity_id"))
                   & (F.col("a.normalized_alias") != F.col("b.normalized_alias")) & (2 * F.least(x, y) / (x + y) >= least))
    return pairs.select(
        F.col("a.entity_id").alias("left_id"), F.col("b.entity_id").alias("right_id"),
        F.col("a.normalized_alias").alias("left_name"), F.col("b.normalized_alias").alias("right_name"), bound.alias("bound"),
    ).filter(F.col("bound") >= least)


def match_name_similarity(aliases: DataFrame, least: float = 0.88) -> DataFrame:
    """Similar aliases (8 or more characters) of one block, for review; the left one has the lesser id."""
    pairs = similar_candidates(aliases, least)
    shown = evidence_of(left=F.col("left_name"), right=F.col("right_name"))
    rated = pairs.select("left_id", "right_id", ratcliff_ratio("left_name", "right_name").alias("ratio"), shown.alias("evidence"))
    best = rated.groupBy("left_id", "right_id").agg(F.max(F.struct("ratio", "evidence")).alias("m")).select("left_id", "right_id", "m.*").filter(F.col("ratio") >= least)
    out = best.withColumns({"match_id": pair_id(F.col("left_id"), F.col("right_id"), "name_similarity"), "match_method": F.lit("name_similarity")})
    return _scored(out, F.round("ratio", 4), "review").drop("ratio")


def match_payment_channel(named: DataFrame) -> DataFrame:
    rows = organisations(named).filter("analysis_key <> ''").select("entity_id", "analysis_key", "channel", "canonical_name")
    some = F.col("a.channel").isNotNull() | F.col("b.channel").isNotNull()
    return _scored(_pairs(rows, ["analysis_key"], "payment_channel", {"normalized_name": F.col("a.analysis_key")} | _names() | _both("channel"), some), RULES["payment_channel"])


def match_exact_clean_name(named: DataFrame) -> DataFrame:
    rows = organisations(named).filter("length(basic_key) >= 5 AND channel IS NULL AND NOT replace(basic_key, ' ', '') RLIKE '^[0-9]+$'")
    return _scored(_pairs(rows.select("entity_id", "basic_key", "canonical_name"), ["basic_key"], "exact_clean_name", {"clean_name": F.col("a.basic_key")} | _names()), RULES["exact_clean_name"])


def match_legal_suffix(named: DataFrame) -> DataFrame:
    rows = organisations(named).filter("org_key <> ''").select("entity_id", "org_key", "legal_suffix", "canonical_name")
    some = F.col("a.legal_suffix").isNotNull() | F.col("b.legal_suffix").isNotNull()
    return _scored(_pairs(rows, ["org_key"], "legal_suffix", {"normalized_name": F.col("a.org_key")} | _names() | _both("legal_suffix"), some), RULES["legal_suffix"])


def one_edit_keys(keys: DataFrame, key: str) -> DataFrame:
    """(left_key, right_key), both ways round: distinct texts one edit apart that have the same first word and number of words.

    Texts of one length meet in what is left of both without their character at one place, and a
    longer text meets a shorter one in what it is without a character.  So the pairs that are made
    are those that are found, however many texts begin with the same word.
    """
    cut = lambda i: F.concat(F.substring(F.col(key), F.lit(1), i - 1), F.substring(F.col(key), i + 1, F.length(key)))
    cuts = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.struct(i.alias("place"), cut(i).alias("rest")))
    keys = keys.filter(F.length(key) > 0).select(key).distinct()
    each = keys.select(key, F.inline(cuts))
    a, b = each.alias("a"), each.alias("b")
    replaced = a.join(b, (F.col("a.rest") == F.col("b.rest")) & (F.col("a.place") == F.col("b.place")) & (F.col(f"a.{key}") != F.col(f"b.{key}")))
    replaced = replaced.select(F.col(f"a.{key}").alias("left_key"), F.col(f"b.{key}").alias("right_key"))
    longer = each.select(F.col(key).alias("left_key"), "rest").distinct().join(keys.select(F.col(key).alias("right_key")), F.col("rest") == F.col("right_key")).select("left_key", "right_key")
    both = replaced.unionByName(longer).unionByName(longer.select(F.col("right_key").alias("left_key"), F.col("left_key").alias("right_key")))
    words = [F.split(c, " ") for c in ("left_key", "right_key")]
    return both.filter((words[0][0] == words[1][0]) & (F.size(words[0]) == F.size(words[1])) & text.within_one_edit(F.col("left_key"), F.col("right_key")))


def _one_edit(named: DataFrame, method: str, shortest: int, words: int, capped: bool = True) -> DataFrame:
    """Names one edit apart with the same first word and number of words; without a cap, also those of words that more than BLOCK_CAP rows share."""
    rows = organisations(named).withColumn("n_words", F.size(F.split("analysis_key", " ")))
    rows = rows.filter((F.length("analysis_key") >= shortest) & (F.col("n_words") >= words)).select("entity_id", "analysis_key", "n_words", "canonical_name")
    shown = _names() | _both("analysis_key", "normalized") | {"maximum_edit_distance": F.lit(1)}
    near = (F.col("a.analysis_key") != F.col("b.analysis_key")) & text.within_one_edit(F.col("a.analysis_key"), F.col("b.analysis_key"))
    found = _pairs(blocked(rows, "analysis_key"), ["block", "n_words"], method, shown, near, capped=True)
    if not capped:
        rows, small = block_sizes(rows, "analysis_key")
        large = through_files(rows.join(small, "block", "left_anti").select("entity_id", "analysis_key", "canonical_name"))
        if not large.isEmpty():
            left = large.join(one_edit_keys(large, "analysis_key"), F.col("analysis_key") == F.col("left_key")).drop("left_key")
            found = found.unionByName(_paired(left.alias("a"), large.alias("b"), F.col("a.right_key") == F.col("b.analysis_key"), method, shown))
    return _scored(found, RULES[method])


def match_near_typo(named: DataFrame, capped: bool = True) -> DataFrame:
    return _one_edit(named, "near_typo", 20, 2, capped)


def match_conservative_one_edit(named: DataFrame, capped: bool = True) -> DataFrame:
    return _one_edit(named, "conservative_one_edit", 15, 3, capped)


def match_whitespace_join(named: DataFrame) -> DataFrame:
    rows = organisations(named).filter("plausible AND length(analysis_key) >= 10").withColumn("joined", F.replace("analysis_key", F.lit(" "), F.lit("")))
    rows = rows.filter("length(joined) >= 15").select("entity_id", "analysis_key", "joined", "canonical_name")
    shown = _names() | _both("analysis_key", "normalized") | {"compact_normalized": F.col("a.joined")}
    return _scored(_pairs(rows, ["joined"], "whitespace_join", shown, F.col("a.analysis_key") != F.col("b.analysis_key")), RULES["whitespace_join"])


#: Rules whose matches are accepted, some or all of them, without a human.
AUTOMATIC = ("identifier_exact", "normalized_name_exact", "exact_clean_name", "whitespace_join", "payment_channel", "legal_suffix", "near_typo", "conservative_one_edit")


def star_edges(rows: DataFrame, key: str) -> DataFrame:
    """(left_id, right_id): each member of a group of equal keys to the least; components as with all pairs."""
    least = rows.groupBy(key).agg(F.min("entity_id").alias("left_id"))
    return rows.join(least, key).filter("left_id <> entity_id").select("left_id", F.col("entity_id").alias("right_id"))


def accepted_edges(named: DataFrame, rules: tuple = AUTOMATIC) -> DataFrame:
    """Edges (left_id, right_id, status) with the components of all automatic matches of the rules.

    Rules of equal keys give a star for each group.  A rule whose pairs need one member with a
    channel or suffix, or two spellings, joins the whole group if there is one, and nothing else;
    only the rules of one edit need pairs, within their capped blocks.
    """
    orgs, ids, aliases = organisations(named), entity_identifiers(named), canonical_aliases(named)
    some = lambda rows, key, c: rows.join(rows.filter(F.col(c).isNotNull()).select(key).distinct(), key, "left_semi")
    spelled = orgs.filter("plausible AND length(analysis_key) >= 10").withColumn("joined", F.replace("analysis_key", F.lit(" "), F.lit(""))).filter("length(joined) >= 15")
    twice = spelled.groupBy("joined").agg(F.min("analysis_key").alias("a"), F.max("analysis_key").alias("b")).filter("a <> b").select("joined")
    sure = (F.length("normalized_alias") >= 5) & ((F.instr("normalized_alias", " ") > 0) | (F.length("normalized_alias") >= 10))
    clean = "length(basic_key) >= 5 AND channel IS NULL AND NOT replace(basic_key, ' ', '') RLIKE '^[0-9]+$'"
    stars = (
        ("identifier_exact", ids.withColumn("key", F.concat_ws("\0", "scheme", "identifier"))), ("normalized_name_exact", aliases.filter(sure).withColumn("key", F.col("normalized_alias"))),
        ("exact_clean_name", orgs.filter(clean).withColumn("key", F.col("basic_key"))), ("whitespace_join", spelled.join(twice, "joined", "left_semi").withColumn("key", F.col("joined"))),
        ("payment_channel", some(orgs.filter("analysis_key <> ''"), "analysis_key", "channel").withColumn("key", F.col("analysis_key"))),
        ("legal_suffix", some(orgs.filter("org_key <> ''"), "org_key", "legal_suffix").withColumn("key", F.col("org_key"))),
    )
    rows = None
    for rule, found in stars:
        if rule not in rules:
            continue
        one = found.select("entity_id", F.concat(F.lit(rule), F.lit("\0"), "key").alias("key"))
        rows = one if rows is None else rows.unionByName(one)
    edges = named.sparkSession.createDataFrame([], "left_id string, right_id string") if rows is None else star_edges(rows.distinct(), "key")
    for rule, match in (("near_typo", match_near_typo), ("conservative_one_edit", match_conservative_one_edit)):
        if rule in rules:
            edges = edges.unionByName(match(named).select("left_id", "right_id"))
    return edges.distinct().withColumn("status", F.lit("auto_accepted"))


def upsert_matches(existing: DataFrame, new: DataFrame, ran: tuple | None = None) -> DataFrame:
    """Matches by id: confidence and evidence (if both tables have it) are refreshed, a human accepted or rejected stays.

    ``ran`` are the rules that ``new`` comes from, if these are known: as a match's id is that of
    its pair and rule, matches of all other rules stay as they are and are not joined.
    """
    e, n = existing.alias("e"), new.alias("n")
    human = F.col("e.status").isin("accepted", "rejected")
    status = F.when(human, F.col("e.status")).otherwise(F.coalesce("n.status", "e.status"))
    pick = lambda c: F.coalesce(f"n.{c}", f"e.{c}").alias(c)
    columns = ["match_id", "left_id", "right_id", "match_method", "confidence"]
    columns += [c for c in ("evidence",) if c in existing.columns and c in new.columns]
    if ran is not None:
        touched = F.coalesce(F.col("match_method").isin(*ran), F.lit(False))
        return upsert_matches(existing.filter(touched), new).unionByName(existing.filter(~touched).select(*columns, "status"))
    return e.join(n, F.col("e.match_id") == F.col("n.match_id"), "full").select(*map(pick, columns), status.alias("status"))


def resolve_members(entities: DataFrame, matches: DataFrame) -> DataFrame:
    """(entity_id, component): least id reachable over accepted matches; entities alone are their own."""
    edges = matches.filter(F.col("status").isin("auto_accepted", "accepted")).select(F.col("left_id").alias("u"), F.col("right_id").alias("v"))
    found = connected_components(edges).withColumnRenamed("id", "entity_id")
    return entities.select("entity_id").join(found, "entity_id", "left").withColumn("component", F.coalesce("component", "entity_id"))


def quality_representative(named: DataFrame, members: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(entity_id, canonical_id, decision): each component's best-documented member stands for it."""
    rows = named.join(members, "entity_id").join(identifiers.select("entity_id").distinct().withColumn("has_id", F.lit(1)), "entity_id", "left")
    spelled = Window.partitionBy("component", "org_key")
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in text.TYPE_RANK.items() for x in kv])[F.col("entity_type")], F.lit(0))
    procurement = F.lit(False)
    for term in text.PROCUREMENT_SOURCES:
        procurement = procurement | F.contains(F.lower("source_system"), F.lit(term))
    score = F.struct(
        (F.col("entity_type") == "COUNCIL").cast("int").alias("a"), F.count("*").over(spelled).alias("b"), F.coalesce("has_id", F.lit(0)).alias("c"),
        F.coalesce(procurement, F.lit(False)).cast("int").alias("d"), F.col("channel").isNull().cast("int").alias("e"), rank.alias("f"),
        F.least(F.length("org_key"), F.lit(120)).alias("g"),
    )
    scored = rows.select("entity_id", "component", score.alias("score"))
    best = scored.groupBy("component").agg(F.max("score").alias("top"), F.count("*").alias("n"))
    chosen = scored.join(best, "component").filter("score = top").groupBy("component").agg(F.min("entity_id").alias("canonical_id"), F.max("n").alias("n"))
    return members.join(chosen, "component").select(
        "entity_id", "canonical_id", F.when(F.col("n") > 1, "accepted_entity_matches:quality_preferred").otherwise("identity").alias("decision")
    )


def canonicalise(df: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """Replaces ids of a column by their representatives."""
    found = members.select(F.col("entity_id").alias(column), F.col("canonical_id").alias("_c"))
    return df.join(found, column, "left").withColumn(column, F.coalesce("_c", column)).drop("_c")


def close_resolved_reviews(reviews: DataFrame, members: DataFrame) -> DataFrame:
    """Open ENTITY_MATCH reviews whose two sides have one representative become resolved."""
    side = lambda c, out: members.select(F.col("entity_id").alias(c), F.col("canonical_id").alias(out))
    rows = reviews.join(side("subject_id", "_s"), "subject_id", "left").join(side("object_id", "_o"), "object_id", "left")
    done = (F.col("item_type") == "ENTITY_MATCH") & (F.col("status") == "open") & (F.col("_s") == F.col("_o"))
    return rows.withColumn("status", F.when(done, "resolved").otherwise(F.col("status"))).select(reviews.columns)


def cleanup_invalid(named: DataFrame, aliases: DataFrame, matches: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the aliases, fuzzy matches and open reviews of organisations with implausible names.

    Matches and reviews may bring the flag of each side along (left_implausible and so on, see
    ``flag_implausible``): they are then not joined, and so not shuffled, for it.
    """
    bad = implausible_ids(named)
    rows, hit = {}, {}
    for name, df, sides in (("matches", matches, ("left", "right")), ("reviews", reviews, ("subject", "object"))):
        for side in sides:
            if f"{side}_implausible" not in df.columns:
                df = df.join(bad.select(F.col("entity_id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_implausible")), f"{side}_id", "left")
        rows[name], hit[name] = df, F.coalesce(*(F.col(f"{side}_implausible") for side in sides), F.lit(False))
    plain = lambda df: [c for c in df.columns if not c.endswith("_implausible")]
    wrong = (F.col("status") == "review") & F.col("match_method").isin("name_similarity", "normalized_name_exact") & hit["matches"]
    m = rows["matches"].withColumn("status", F.when(wrong, "rejected").otherwise(F.col("status"))).select(plain(matches))
    done = (F.col("item_type") == "ENTITY_MATCH") & (F.col("status") == "open") & hit["reviews"]
    r = rows["reviews"].withColumn("status", F.when(done, "resolved").otherwise(F.col("status"))).select(plain(reviews))
    return aliases.join(bad, "entity_id", "left_anti"), m, r


def implausible_ids(named: DataFrame) -> DataFrame:
    return organisations(named).filter(~F.col("plausible")).select("entity_id").distinct()


def flag_implausible(named: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds implausible (true or null) to aliases: for matches of which ``cleanup_invalid`` is to judge very many."""
    return aliases.join(implausible_ids(named).withColumn("implausible", F.lit(True)), "entity_id", "left")


def match_reviews(matches: DataFrame) -> DataFrame:
    """ENTITY_MATCH review items of matches that need a human, with the flags of their sides if the matches have them."""
    rows = matches.filter("status = 'review'")
    flags = [F.col(f"{a}_implausible").alias(f"{b}_implausible") for a, b in (("left", "subject"), ("right", "object")) if f"{a}_implausible" in matches.columns]
    return rows.select(
        item_id(F.lit("ENTITY_MATCH"), F.col("left_id"), F.col("right_id"), F.array("match_id")).alias("review_id"),
        F.lit("ENTITY_MATCH").alias("item_type"), F.lit("open").alias("status"), F.col("left_id").alias("subject_id"), F.col("right_id").alias("object_id"),
        F.col("confidence").alias("score"), *flags,
    )


def all_matches(named: DataFrame) -> DataFrame:
    """Every rule's matches over standardised names."""
    aliases = canonical_aliases(named)
    out = match_whitespace_join(named)
    for more in (
        match_conservative_one_edit(named), match_identifier_exact(entity_identifiers(named)), match_name_exact(aliases), match_name_similarity(aliases),
        match_payment_channel(named), match_exact_clean_name(named), match_legal_suffix(named), match_near_typo(named),
    ):
        out = out.unionByName(more)
    return out


def resolve_entities(entities: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """(entity_id, canonical_id, decision) of all entities; ``decided`` are matches with human decisions.

    Without decisions only components matter, so no pairs of equal keys are made (``accepted_edges``);
    a decision is on one pair under one rule, so with them the pairs are.
    """
    named = through_files(standardise_names(entities))
    matches = accepted_edges(named) if decided is None else upsert_matches(decided, through_files(all_matches(named)))
    return quality_representative(named, resolve_members(named, matches), entity_identifiers(named))


# Queries over the driver's tables -----------------------------------------------------------


def _q(f):
    return lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))


def _named(v) -> DataFrame:
    return through_files(standardise_names(v("entities")))


SURE = ("identifier_exact", "exact_clean_name", "whitespace_join", "payment_channel", "legal_suffix", "conservative_one_edit")


def _members(v, named: DataFrame | None = None) -> DataFrame:
    return resolve_members(v("entities"), accepted_edges(_named(v) if named is None else named, SURE))


def _representatives(v) -> DataFrame:
    named = _named(v)
    return quality_representative(named, _members(v, named), entity_identifiers(named))


def _cleaned(v) -> tuple[DataFrame, DataFrame, DataFrame]:
    named = _named(v)
    aliases = canonical_aliases(named)
    matches = match_name_exact(flag_implausible(named, aliases), ("implausible",))
    return cleanup_invalid(named, aliases, matches, match_reviews(matches))


def _evidence(v) -> DataFrame:
    """Evidence of the rules that SQL can repeat."""
    n = _named(v)
    out = match_name_exact(canonical_aliases(n))
    for m in (match_identifier_exact(entity_identifiers(n)), match_payment_channel(n), match_exact_clean_name(n), match_legal_suffix(n), match_near_typo(n, capped=False), match_whitespace_join(n), match_conservative_one_edit(n, capped=False)):
        out = out.unionByName(m)
    return out.select("match_id", "match_method", "evidence")


def _refreshed(v) -> DataFrame:
    n = _named(v)
    old = _decided(n).withColumn("evidence", F.lit('{"by":"an earlier run"}'))
    return upsert_matches(old, match_legal_suffix(n), ("legal_suffix",)).select("match_id", "status", "evidence")


def _upserted(v) -> DataFrame:
    n = _named(v)
    return upsert_matches(_decided(n), match_legal_suffix(n), ("legal_suffix",)).select(*_M)


def _decided(n: DataFrame) -> DataFrame:
    m = match_exact_clean_name(n).unionByName(match_legal_suffix(n))
    return m.withColumn("status", F.expr("CASE WHEN match_id < '2' THEN 'rejected' WHEN match_id < '4' THEN 'accepted' ELSE 'review' END")).withColumn("confidence", F.lit(0.5))


def _reviews(v) -> DataFrame:
    e = v("entities").select("entity_id")
    return e.select(
        F.concat(F.lit("v"), "entity_id").alias("review_id"), F.expr("CASE WHEN right(entity_id, 1) < '7' THEN 'ENTITY_MATCH' ELSE 'SIGNAL_REVIEW' END").alias("item_type"),
        F.expr("CASE WHEN right(entity_id, 1) < '5' THEN 'open' ELSE 'approved' END").alias("status"), F.col("entity_id").alias("subject_id"),
        F.expr("concat(substring(entity_id, 1, 8), '0')").alias("object_id"))


_M = ("match_id", "left_id", "right_id", "match_method", "confidence", "status")
QUERIES = {
    "d_standardise_names": _q(lambda v: standardise_names(v("entities")).drop("raw_type")),
    "d_name_quality_profile": _q(lambda v: name_quality_profile(_named(v))),
    "e1_canonical_aliases": _q(lambda v: canonical_aliases(_named(v))),
    "e1_entity_identifiers": _q(lambda v: entity_identifiers(_named(v))),
    "e2_match_identifier_exact": _q(lambda v: match_identifier_exact(entity_identifiers(_named(v))).select(*_M)),
    "e3_match_name_exact": _q(lambda v: match_name_exact(canonical_aliases(_named(v))).select(*_M)),
    "e4_similar_candidates": _q(lambda v: similar_candidates(canonical_aliases(_named(v)))),
    "e4_match_name_similarity": _q(lambda v: match_name_similarity(canonical_aliases(_named(v))).select(*_M)),
    "e5_match_payment_channel": _q(lambda v: match_payment_channel(_named(v)).select(*_M)),
    "e6_match_exact_clean_name": _q(lambda v: match_exact_clean_name(_named(v)).select(*_M)),
    "e7_match_legal_suffix": _q(lambda v: match_legal_suffix(_named(v)).select(*_M)),
    "e8_match_near_typo": _q(lambda v: match_near_typo(_named(v)).select(*_M)),
    "e9_match_whitespace_join": _q(lambda v: match_whitespace_join(_named(v)).select(*_M)),
    "e10_match_conservative_one_edit": _q(lambda v: match_conservative_one_edit(_named(v)).select(*_M)),
    "e11_upsert_matches": _q(_upserted),
    "e11_match_evidence": _q(_evidence),
    "e11_refreshed_evidence": _q(_refreshed),
    "e12_connected_components": _q(_members),
    "e13_quality_representative": _q(_representatives),
    "e14_close_resolved_reviews": _q(lambda v: close_resolved_reviews(_reviews(v), _members(v).withColumnRenamed("component", "canonical_id"))),
    "e15_cleanup_invalid": _q(lambda v: _cleaned(v)[1].select(*_M)),
    "e15_cleanup_aliases": _q(lambda v: _cleaned(v)[0]),
    "e15_cleanup_reviews": _q(lambda v: _cleaned(v)[2]),
    "e13_canonicalise": _q(lambda v: canonicalise(v("payments").select("fact_id", "supplier_id"), v("supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("entity_id"), F.concat(F.lit("S"), F.col("s_suppkey") - F.col("s_suppkey") % 3).alias("canonical_id")), "supplier_id")),
    "d12_dataset_date": _q(lambda v: v("orders").select("o_orderkey", text.dataset_date(F.concat(F.lit("https://x/companies-"), F.expr("CASE WHEN o_orderkey % 4 > 0 THEN cast(cast(o_orderdate as date) as string) ELSE 'latest' END"), F.lit(".csv"))).alias("day"))),
    "d15_plain_decimal": _q(lambda v: v("orders").select("o_orderkey", text.plain_decimal(F.when(F.col("o_orderkey") % 4 > 0, F.format_number("o_totalprice", 2)).otherwise("n/a")).alias("amount"))),
    "e16_resolve_entities": _q(lambda v: resolve_entities(v("entities"))),
}

_N = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, lower({text.sql_squeeze('canonical_name')}) AS normalized_name, {text.sql_normalize_org('canonical_name')} AS org_key,
  {text.sql_normalize_org("(" + text.sql_without_channel('canonical_name') + ")")} AS analysis_key, {text.sql_basic_key('canonical_name')} AS basic_key,
  CASE WHEN NOT regexp_matches({text.sql_squeeze('canonical_name')}, '{text.DATE_PATTERN}') THEN {text.sql_channel('canonical_name')} END AS channel,
  {text.sql_raw_suffix('canonical_name')} AS legal_suffix, {text.sql_plausible('canonical_name')} AS plausible, {text.sql_payee_class('canonical_name')} AS payee_class FROM {{entities}}),
 al AS (SELECT entity_id, canonical_name AS alias_text, org_key AS normalized_alias FROM e WHERE entity_type IN {text.ORG_TYPES} AND org_key <> ''),
 ids AS (SELECT DISTINCT entity_id, lower(scheme) AS scheme, upper(replace(identifier, ' ', '')) AS identifier FROM e WHERE scheme IS NOT NULL)
"""


def _sql_pairs(rows: str, on: str, method: str, confidence: str, status: str = "'auto_accepted'") -> str:
    return f"""SELECT DISTINCT {sql_pair_id('a.entity_id', 'b.entity_id', method)} AS match_id, a.entity_id AS left_id, b.entity_id AS right_id, '{method}' AS match_method,
      ({confidence})::DOUBLE AS confidence, {status} AS status FROM ({rows}) a JOIN ({rows}) b ON a.entity_id < b.entity_id AND {on}"""


def _sql_block(where: str, words: str) -> str:
    return f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY string_split(k, ' ')[1]) AS block_size FROM (SELECT entity_id, canonical_name, analysis_key AS k, len(string_split(analysis_key, ' ')) AS n FROM e)
      WHERE length(k) >= {where} AND n >= {words}) WHERE block_size <= {BLOCK_CAP}"""


def _sql_names(where: str, words: str) -> str:
    """``_sql_block`` without its cap."""
    return f"SELECT * FROM (SELECT entity_id, canonical_name, analysis_key AS k, len(string_split(analysis_key, ' ')) AS n FROM e) WHERE length(k) >= {where} AND n >= {words}"


_EDIT = "a.n = b.n AND string_split(a.k, ' ')[1] = string_split(b.k, ' ')[1] AND a.k <> b.k AND levenshtein(a.k, b.k) <= 1"
_SURE = {
    "e2_match_identifier_exact": _sql_pairs("SELECT * FROM ids", "a.scheme = b.scheme AND a.identifier = b.identifier", "identifier_exact", "1.0"),
    "e5_match_payment_channel": _sql_pairs("SELECT * FROM e WHERE analysis_key <> ''", "a.analysis_key = b.analysis_key AND (a.channel IS NOT NULL OR b.channel IS NOT NULL)", "payment_channel", "0.99"),
    "e6_match_exact_clean_name": _sql_pairs("SELECT * FROM e WHERE length(basic_key) >= 5 AND channel IS NULL AND NOT regexp_matches(replace(basic_key, ' ', ''), '^[0-9]+$')", "a.basic_key = b.basic_key", "exact_clean_name", "0.995"),
    "e7_match_legal_suffix": _sql_pairs("SELECT * FROM e WHERE org_key <> ''", "a.org_key = b.org_key AND (a.legal_suffix IS NOT NULL OR b.legal_suffix IS NOT NULL)", "legal_suffix", "0.99"),
    "e9_match_whitespace_join": _sql_pairs("SELECT *, replace(analysis_key, ' ', '') AS j FROM e WHERE plausible AND length(analysis_key) >= 10 AND length(replace(analysis_key, ' ', '')) >= 15", "a.j = b.j AND a.analysis_key <> b.analysis_key", "whitespace_join", "0.997"),
    "e10_match_conservative_one_edit": _sql_pairs(_sql_block("15", "3"), _EDIT, "conservative_one_edit", "0.996"),
}
_NAME_EXACT = _sql_pairs("SELECT * FROM al WHERE length(normalized_alias) >= 5", "a.normalized_alias = b.normalized_alias", "normalized_name_exact",
                         "CASE WHEN contains(a.normalized_alias, ' ') OR length(a.normalized_alias) >= 10 THEN 0.97 ELSE 0.93 END",
                         "CASE WHEN contains(a.normalized_alias, ' ') OR length(a.normalized_alias) >= 10 THEN 'auto_accepted' ELSE 'review' END")
_TYPO = _sql_pairs(_sql_block("20", "2"), _EDIT, "near_typo", "0.995")


def _sql_shown(query: str, **shown: str) -> str:
    """A rule's query with its evidence."""
    both = ", ".join(f"{k} := {shown[k]}" for k in sorted(shown))
    return query.replace(" AS status FROM", f" AS status, to_json(struct_pack({both}))::VARCHAR AS evidence FROM", 1)


_SIDES = {"left_name": "a.canonical_name", "right_name": "b.canonical_name"}
_EDITED = _SIDES | {"left_normalized": "a.k", "right_normalized": "b.k", "maximum_edit_distance": "1"}
_SHOWN = [
    _sql_shown(_NAME_EXACT, normalized_name="a.normalized_alias"), _sql_shown(_SURE["e2_match_identifier_exact"], scheme="a.scheme", identifier="a.identifier"),
    _sql_shown(_SURE["e5_match_payment_channel"], normalized_name="a.analysis_key", left_channel="a.channel", right_channel="b.channel", **_SIDES),
    _sql_shown(_SURE["e6_match_exact_clean_name"], clean_name="a.basic_key", **_SIDES),
    _sql_shown(_SURE["e7_match_legal_suffix"], normalized_name="a.org_key", left_legal_suffix="a.legal_suffix", right_legal_suffix="b.legal_suffix", **_SIDES),
    *(_sql_shown(_sql_pairs(_sql_names(*least), _EDIT, method, str(RULES[method])), **_EDITED) for method, least in (("near_typo", ("20", "2")), ("conservative_one_edit", ("15", "3")))),
    _sql_shown(_SURE["e9_match_whitespace_join"], left_normalized="a.analysis_key", right_normalized="b.analysis_key", compact_normalized="a.j", **_SIDES),
]
_COMPONENTS = " UNION ALL ".join(f"SELECT left_id, right_id FROM ({q})" for q in _SURE.values())
_REACH = f""", ed AS MATERIALIZED (SELECT DISTINCT left_id AS u, right_id AS v FROM ({_COMPONENTS} {{more}})), both_ AS MATERIALIZED (SELECT u, v FROM ed UNION SELECT v, u FROM ed),
 reach AS (SELECT entity_id AS id, entity_id AS r FROM e UNION SELECT reach.id, both_.v FROM reach JOIN both_ ON both_.u = reach.r),
 comp AS (SELECT id AS entity_id, min(r) AS component FROM reach GROUP BY 1)"""
_MORE = " UNION ALL ".join(f"SELECT left_id, right_id FROM ({q}) WHERE status = 'auto_accepted'" for q in (
    _NAME_EXACT, _TYPO))
_REACH, _REACH_ALL = _REACH.replace("{more}", ""), _REACH.replace("{more}", "UNION ALL " + _MORE)
_RANK = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in text.TYPE_RANK.items()) + " ELSE 0 END"
_BEST = f""", s AS (SELECT e.entity_id, component, ((entity_type = 'COUNCIL')::INT, count(*) OVER (PARTITION BY component, org_key), (e.entity_id IN (SELECT entity_id FROM ids))::INT,
        (source_system = 'contracts finder')::INT, (channel IS NULL)::INT, {_RANK}, least(length(org_key), 120)) AS score FROM e JOIN comp USING (entity_id)),
      t AS (SELECT *, max(score) OVER (PARTITION BY component) AS top, count(*) OVER (PARTITION BY component) AS n FROM s),
      c AS (SELECT component, min(entity_id) AS canonical_id, max(n) AS n FROM t WHERE score = top GROUP BY 1)
      SELECT entity_id, canonical_id, CASE WHEN n > 1 THEN 'accepted_entity_matches:quality_preferred' ELSE 'identity' END AS decision FROM comp JOIN c USING (component)"""
ORACLE = {k: with_views(q) for k, q in {
    "e13_canonicalise": "SELECT fact_id, CASE WHEN s_suppkey % 3 > 0 THEN 'S' || (s_suppkey - s_suppkey % 3) ELSE supplier_id END AS supplier_id FROM {payments} LEFT JOIN supplier ON 'S' || s_suppkey = supplier_id",
    "d12_dataset_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 AND year(o_orderdate) >= 2000 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders",
    "d15_plain_decimal": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS amount FROM orders",
    "d_standardise_names": _N + "SELECT * EXCLUDE (raw_type) FROM e",
    "d_name_quality_profile": _N + "SELECT entity_type, plausible, payee_class, channel, count(*) AS n FROM e GROUP BY ALL",
    "e1_canonical_aliases": _N + "SELECT * FROM al",
    "e1_entity_identifiers": _N + "SELECT * FROM ids",
    **{k: _N + q for k, q in _SURE.items()},
    "e4_similar_candidates": _N + f""", b AS (SELECT * FROM (SELECT entity_id, normalized_alias AS k, string_split(normalized_alias, ' ')[1] AS block, count(*) OVER (PARTITION BY string_split(normalized_alias, ' ')[1]) AS size
        FROM al WHERE length(normalized_alias) >= 8) WHERE size <= {BLOCK_CAP}),
      p AS (SELECT x.entity_id AS left_id, y.entity_id AS right_id, x.k AS left_name, y.k AS right_name, length(x.k) + length(y.k) AS n,
        list_sum(list_transform(list_distinct(string_split(x.k, '')), lambda c: least(length(x.k) - length(replace(x.k, c, '')), length(y.k) - length(replace(y.k, c, ''))))) AS common
        FROM b x JOIN b y ON x.block = y.block AND x.entity_id < y.entity_id AND x.k <> y.k AND 2 * least(length(x.k), length(y.k)) / (length(x.k) + length(y.k)) >= 0.88)
      SELECT left_id, right_id, left_name, right_name, 2 * common / n AS bound FROM p WHERE 2 * common / n >= 0.88""",
    "e3_match_name_exact": _N + _NAME_EXACT,
    "e8_match_near_typo": _N + _TYPO,
    "e11_match_evidence": _N + " UNION ALL ".join(f"SELECT match_id, match_method, evidence FROM ({q})" for q in _SHOWN),
    "e11_refreshed_evidence": _N + f""", n AS ({_SHOWN[4]}), d AS (SELECT match_id FROM ({_SURE['e6_match_exact_clean_name']}) UNION ALL SELECT match_id FROM n)
      SELECT match_id, CASE WHEN match_id < '2' THEN 'rejected' WHEN match_id < '4' THEN 'accepted' ELSE coalesce(n.status, 'review') END AS status,
      coalesce(n.evidence, '{{"by":"an earlier run"}}') AS evidence FROM d LEFT JOIN n USING (match_id)""",
    "e11_upsert_matches": _N + f""", d AS (SELECT * REPLACE (CASE WHEN match_id < '2' THEN 'rejected' WHEN match_id < '4' THEN 'accepted' ELSE 'review' END AS status, 0.5::DOUBLE AS confidence)
      FROM ({_SURE['e6_match_exact_clean_name']} UNION ALL {_SURE['e7_match_legal_suffix']})), n AS ({_SURE['e7_match_legal_suffix']})
      SELECT d.match_id, d.left_id, d.right_id, d.match_method, coalesce(n.confidence, d.confidence) AS confidence,
      CASE WHEN d.status IN ('accepted', 'rejected') THEN d.status ELSE coalesce(n.status, d.status) END AS status FROM d LEFT JOIN n USING (match_id)""",
    "e12_connected_components": _N + _REACH + " SELECT * FROM comp",
    "e13_quality_representative": _N + _REACH + _BEST,
    "e16_resolve_entities": _N + _REACH_ALL + _BEST,
    "e14_close_resolved_reviews": _N + _REACH + """, v AS (SELECT 'v' || entity_id AS review_id, CASE WHEN right(entity_id, 1) < '7' THEN 'ENTITY_MATCH' ELSE 'SIGNAL_REVIEW' END AS item_type,
        CASE WHEN right(entity_id, 1) < '5' THEN 'open' ELSE 'approved' END AS status, entity_id AS subject_id, substring(entity_id, 1, 8) || '0' AS object_id FROM e)
      SELECT review_id, item_type, CASE WHEN item_type = 'ENTITY_MATCH' AND status = 'open' AND a.component = b.component THEN 'resolved' ELSE status END AS status, subject_id, object_id
      FROM v LEFT JOIN comp a ON a.entity_id = subject_id LEFT JOIN comp b ON b.entity_id = object_id""",
    "e15_cleanup_aliases": _N + "SELECT * FROM al WHERE entity_id NOT IN (SELECT entity_id FROM e WHERE NOT plausible)",
    "e15_cleanup_reviews": _N + f", m AS ({_NAME_EXACT}), bad AS (SELECT entity_id FROM e WHERE NOT plausible) " + """SELECT sha256('ENTITY_MATCH' || chr(0) || left_id || chr(0) || right_id || chr(0) || match_id) AS review_id,
      'ENTITY_MATCH' AS item_type, CASE WHEN left_id IN (SELECT entity_id FROM bad) OR right_id IN (SELECT entity_id FROM bad) THEN 'resolved' ELSE 'open' END AS status,
      left_id AS subject_id, right_id AS object_id, confidence AS score FROM m WHERE status = 'review'""",
    "e15_cleanup_invalid": _N + f", m AS ({_NAME_EXACT}), bad AS (SELECT entity_id FROM e WHERE NOT plausible) " + """SELECT * REPLACE (CASE WHEN status = 'review' AND
      (left_id IN (SELECT entity_id FROM bad) OR right_id IN (SELECT entity_id FROM bad)) THEN 'rejected' ELSE status END AS status) FROM m""",
}.items()}
