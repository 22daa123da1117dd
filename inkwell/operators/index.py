"""The inverted index as tables: mentions, postings (term, chunk_id, tf), terms (term, tf, df), and the graphs built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.runtime import width


def postings(mentions: DataFrame) -> DataFrame:
    """(term, chunk_id, tf): one row per term and chunk; combined inside the map tasks before the shuffle."""
    return mentions.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))


def terms(post: DataFrame) -> DataFrame:
    """(term, tf, df): mentions and chunks of each term."""
    return post.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def frequent(found: DataFrame, acronyms: list[str], least: int = 2) -> DataFrame:
    """Terms of at least `least` mentions, and acronyms whatever their number."""
    return found.where((F.col("tf") >= least) | F.col("term").isin(acronyms))


def of_frequent(post: DataFrame, least: int = 2, definitions: DataFrame | None = None, spared: list[str] = ()) -> DataFrame:
    """Postings of terms of at least `least` mentions, of acronyms (acronym) and of the spared spellings, whatever their case.

    The number of mentions is all that decides, so that rare terms, which are most of them, are found by an aggregation and go by a semi-join.
    """
    counted = post.groupBy("term").agg(F.sum("tf").alias("tf"))
    kept = counted.where((F.col("tf") >= least) | F.lower("term").isin(list(spared))).select("term")
    if definitions is not None:
        kept = kept.union(definitions.select(F.explode(F.array("acronym", F.lower("acronym"))).alias("term"))).distinct()
    return post.join(kept, "term", "left_semi")


def meaningful(found: DataFrame, stop: list[str], lexicon: list[str], more_than: int = 25) -> DataFrame:
    """Terms of more than `more_than` chunks that are proper nouns, in the lexicon, or name a bank or company, and no stop words."""
    name = F.col("term").rlike(r"^\p{Lu}") | F.lower("term").isin(lexicon) | F.lower("term").rlike("nb|bank|co")
    return found.where((F.length("term") > 1) & ~F.lower("term").isin(stop) & (F.col("df") > more_than) & name)


# Endings of common word forms.
WORD_ENDINGS = "ed ing ly er est tion sion ment ness ity ies ied".split()


def linkable(found: DataFrame, stop: list[str], endings: list[str] = WORD_ENDINGS) -> DataFrame:
    """Terms fit for links: four characters or more, no stop word, no number, no single repeated character, no common word form unless it begins with a
    capital; of several words, or with a capital anywhere, or of eight letters or more."""
    t, low = F.col("term"), F.lower(F.trim("term"))
    common_form = low.rlike(f"(?:{'|'.join(endings)})$") & ~t.rlike(r"^\p{Lu}")
    shaped = t.contains(" ") | t.rlike(r"\p{Lu}") | (F.length(t) >= 8)
    return found.where((F.length(t) >= 4) & ~low.isin(stop) & ~low.rlike(r"^\d+$") & ~low.rlike(r"^(.)\1*$") & ~common_form & shaped)


def presplit(found: DataFrame, size: int = 250) -> DataFrame:
    """Adds `kept` (words in capitals of three letters or more need no further reading) and, for the others, `batch`, groups of `size` by name."""
    from inkwell.operators.postprocess import placed

    caps = F.col("term").rlike(r"^\p{Lu}{3,}$")
    rest = placed(found.where(~caps), "term").withColumn("batch", F.floor(F.col("place") / size)).drop("place")
    return found.where(caps).withColumn("batch", F.lit(None).cast("bigint")).unionByName(rest).withColumn("kept", caps)


def posting_lists(post: DataFrame) -> DataFrame:
    """(term, chunk_ids), ids sorted: the array form, for sinks only."""
    return post.groupBy("term").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def duplicate_stats(mentions: DataFrame) -> DataFrame:
    """(terms, ids, distinct_ids, duplicates): what deduplication of the posting lists removes."""
    per_term = postings(mentions).groupBy("term").agg(F.sum("tf").alias("ids"), F.count(F.lit(1)).alias("distinct_ids"))
    return per_term.agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("ids"), F.lit(0)).alias("ids"), F.coalesce(F.sum("distinct_ids"), F.lit(0)).alias("distinct_ids")).withColumn("duplicates", F.col("ids") - F.col("distinct_ids"))


#: Rows up to which a lexicon is broadcast; a larger one is joined by shuffle.
SMALL = 100_000


def sent(rows: DataFrame, n: int) -> DataFrame:
    """A lexicon of n rows, marked for broadcast where these are few."""
    return F.broadcast(rows) if n <= SMALL else rows


def merge_groups(post: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Postings in which every spelling of a synonym group has the chunks of all of them.

    The canonical term, its underscored form and all variants get the union; terms are matched without regard to case. Groups must not share a
    spelling. A lexicon of up to `SMALL` spellings is broadcast, a larger one is joined.
    """
    spellings: dict[str, str] = {}
    for canonical, variants in groups.items():
        for v in dict.fromkeys([canonical, canonical.replace(" ", "_"), *variants, *(v.replace(" ", "_") for v in variants)]):
            if spellings.setdefault(v.lower(), canonical) != canonical:
                raise ValueError(f"two groups share the spelling {v!r}")
    spark = post.sparkSession
    n = len(spellings)
    members = spark.createDataFrame(list(spellings.items()), "spelling string, canonical string")
    targets = [(c, t) for c, vs in groups.items() for t in dict.fromkeys([c, c.replace(" ", "_"), *vs])]
    outputs = spark.createDataFrame(targets, "canonical string, term string")
    hit = post.join(sent(members, n), F.lower("term") == F.col("spelling"))
    union = hit.groupBy("canonical", "chunk_id").agg(F.sum("tf").alias("tf"))
    merged = union.join(sent(outputs, n), "canonical").select("term", "chunk_id", "tf")
    return post.join(sent(members.select("spelling"), n), F.lower("term") == F.col("spelling"), "left_anti").select("term", "chunk_id", "tf").union(merged)


def cooccurrence(post: DataFrame, block: int = 512) -> DataFrame:
    """(a, b, weight), a < b: in how many chunks two entities stand together.

    A chunk with k entities has k(k-1)/2 pairs, which are the result and not an intermediate; a chunk is one row with its sorted entities, so that the
    postings do not join themselves. A chunk of more than `block` entities is cut into blocks, each of which meets itself and the ones behind it in a
    row of its own, spread over the tasks.
    """
    sets = post.groupBy("chunk_id").agg(F.array_sort(F.collect_set("term")).alias("t"))
    few = sets.where(F.size("t").between(2, block)).select(F.col("t").alias("p"), F.col("t").alias("q"), F.lit(True).alias("same"))
    starts = F.sequence(F.lit(1), F.size("t"), F.lit(block))
    rows = sets.where(F.size("t") > block).select("t", F.explode(starts).alias("x")).repartition(width(post.sparkSession), F.xxhash64("t"), F.col("x"))
    meets = F.transform(F.filter(starts, lambda y: y >= F.col("x")), lambda y: F.struct(F.slice("t", y, block).alias("q"), (y == F.col("x")).alias("same")))
    many = rows.select(F.slice("t", F.col("x"), block).alias("p"), F.explode(meets).alias("m")).select("p", "m.q", "m.same")
    left = few.union(many).select(F.posexplode("p").alias("i", "a"), "q", "same")
    pairs = left.select("a", F.explode(F.when(F.col("same"), F.slice("q", F.col("i") + 2, F.size("q"))).otherwise(F.col("q"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def associations(edges: DataFrame, top: int = 10, least: int = 3) -> DataFrame:
    """(entity, other, weight, rank): the `top` neighbours of each entity by weight, then name, of those with at least `least`."""
    both = edges.select(F.col("a").alias("entity"), F.col("b").alias("other"), "weight").union(edges.select("b", "a", "weight")).where(F.col("weight") >= least)
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("weight"), "other")))
    return ranked.where(F.col("rank") <= top)


def with_parents(post: DataFrame, hierarchy: dict[str, list[str]]) -> DataFrame:
    """Postings in which a parent also has the chunks of its children, one level up; the hierarchy is a lexicon, broadcast up to `SMALL` edges."""
    rows = [(p, c) for p, cs in hierarchy.items() for c in cs]
    edges = post.sparkSession.createDataFrame(rows, "parent string, child string")
    up = post.join(sent(edges, len(rows)), F.lower("term") == F.col("child")).select(F.col("parent").alias("term"), "chunk_id", "tf")
    return post.select("term", "chunk_id", "tf").union(up).groupBy("term", "chunk_id").agg(F.sum("tf").alias("tf"))


def children_of(terms: list[str], hierarchy: dict[str, list[str]]) -> list[str]:
    """The terms and the children of those that are parents, each once, in order: what a search for a parent looks up."""
    return list(dict.fromkeys(x for t in terms for x in [t, *hierarchy.get(t.lower(), [])]))


def with_identities(post: DataFrame, detected: DataFrame) -> DataFrame:
    """Postings in which an identity also has the chunks of the names detected for it; detected: (identity, name)."""
    names = detected.select(F.lower(F.trim("identity")).alias("identity"), F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
    hits = post.withColumn("name", F.lower("term")).join(names, "name").select(F.col("identity").alias("term"), "chunk_id", "tf")
    return post.select("term", "chunk_id", "tf").union(hits).groupBy("term", "chunk_id").agg(F.sum("tf").alias("tf"))


def with_detections(post: DataFrame, detections: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Postings with detected chunks (identity, chunk_id) added to the identity in its blank and underscored form, then group merge."""
    rows = detections.select(F.explode(F.array_distinct(F.array(F.lower("identity"), X.underscored(F.lower("identity"))))).alias("term"), "chunk_id", F.lit(1).cast("bigint").alias("tf"))
    return merge_groups(post.select("term", "chunk_id", "tf").union(rows).groupBy("term", "chunk_id").agg(F.sum("tf").alias("tf")), groups)


def identity_rollup(detected: DataFrame) -> DataFrame:
    """(identity, surname, n, rank) of detections (identity, surname): how often each name was found, commonest first, then by name.

    One identity has most names; ranks come from places among all rows, so that its names need not meet in one task.
    """
    from inkwell.operators.postprocess import placed_within

    counts = detected.groupBy("identity", "surname").agg(F.count(F.lit(1)).alias("n")).withColumn("_less", -F.col("n"))
    return placed_within(counts, "identity", "_less", "surname").select("identity", "surname", "n", (F.col("place") + 1).cast("int").alias("rank"))


def identity_volume(detected: DataFrame) -> DataFrame:
    """(identity, chunk_ids, chunk_count) of detections (identity, chunk_id), largest first when shown."""
    return detected.groupBy("identity").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.count_distinct("chunk_id").alias("chunk_count"))


def top_families(rollup: DataFrame, noise: list[str] = (), most: int = 25, least: int = 1) -> DataFrame:
    """The first `most` names of each identity with at least `least` mentions and none of the noise words; rollup: (identity, surname, n, rank)."""
    kept = rollup.where((F.col("n") >= least) & ~F.col("surname").isin(list(noise))).drop("rank")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("identity").orderBy(F.desc("n"), "surname")))
    return ranked.where(F.col("rank") <= most)


def several_identities(detected: DataFrame) -> DataFrame:
    """(surname, identities, n): names found under more than one identity."""
    found = detected.groupBy("surname").agg(F.array_sort(F.collect_set("identity")).alias("identities"))
    return found.withColumn("n", F.size("identities")).where("n > 1")


def crosstab(detected: DataFrame, identities: list[str], least: int = 10) -> DataFrame:
    """A row per surname with a column per identity, of counts of at least `least`."""
    counts = detected.groupBy("surname", "identity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.groupBy("surname").pivot("identity", identities).agg(F.sum("n"))


def group_volume(post: DataFrame, groups: dict[str, list[str]], residual: str = "Other") -> DataFrame:
    """(grp, n, pct): postings whose term has any keyword of a group as a substring, and the rest; a row counts for the first group it fits."""
    rules = [(g, "|".join(k.lower() for k in ks)) for g, ks in groups.items()]
    counts = post.withColumn("grp", X.first_match(F.col("term"), rules, residual)).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    total = post.agg(F.count(F.lit(1)).alias("t")).select("t").scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def compare_sets(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, in_both, only_left, only_right, relation): how two sets of values per key differ: equal, subset, superset, overlap, disjoint."""
    a = left.select(key, value).distinct().withColumn("_a", F.lit(1))
    b = right.select(key, value).distinct().withColumn("_b", F.lit(1))
    counted = a.join(b, [key, value], "full_outer").groupBy(key).agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("in_both"), F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right")
    )
    relation = F.when((F.col("only_left") == 0) & (F.col("only_right") == 0), "equal").when(F.col("in_both") == 0, "disjoint").when(F.col("only_left") == 0, "subset").when(F.col("only_right") == 0, "superset").otherwise("overlap")
    return counted.withColumn("relation", relation)


def evaluation(truth: DataFrame, found: DataFrame, grp: str = "grp", name: str = "name") -> DataFrame:
    """(grp, expected, hit, accuracy): the share of the true names of each group that were found."""
    hits = found.select(F.col(grp), F.lower(F.trim(name)).alias(name)).distinct().withColumn("_hit", F.lit(1))
    joined = truth.select(F.col(grp), F.lower(F.trim(name)).alias(name)).distinct().join(hits, [grp, name], "left")
    return joined.groupBy(grp).agg(F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("hit")).withColumn("accuracy", F.col("hit") / F.col("expected"))


def merged_sources(first: DataFrame, second: DataFrame, key: str, top: int = 10) -> DataFrame:
    """Rows of `first` and, of the keys it lacks, the `top` highest-scored rows of `second` (key, score), tagged by `source`."""
    extra = second.join(first.select(key), key, "left_anti").orderBy(F.desc("score"), key).limit(top)
    return first.select(key, "score").withColumn("source", F.lit("fixed")).unionByName(extra.select(key, "score").withColumn("source", F.lit("detected")))


def dominant(families: DataFrame, counts: DataFrame, top_families: int = 10, top: int = 3) -> DataFrame:
    """(identity, places): the `top` places by summed counts over the first `top_families` families; families (identity, surname, rank), counts (surname, place, n)."""
    sums = families.where(F.col("rank") <= top_families).select("identity", "surname").join(counts, "surname").groupBy("identity", "place").agg(F.sum("n").alias("n"))
    ranked = sums.withColumn("r", F.row_number().over(Window.partitionBy("identity").orderBy(F.desc("n"), "place"))).where(F.col("r") <= top)
    return ranked.groupBy("identity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "place"))), lambda s: s.place), ", ").alias("places"))
