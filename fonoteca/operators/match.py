"""Matching of albums with candidates of outside sources, and merging of what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fonoteca.functions.text import blank_to_null, safe_query, strip
from fonoteca.functions.udfs import match_key, ratio


def confidence_gate(candidates: DataFrame, key: str, least: float = 80.0, margin: float = 5.0, by_provider: dict[str, float] | None = None) -> DataFrame:
    """key, provider, top, second, verdict: the best candidate is taken if it is good and clearly the best.

    Of each task's share of a group only the two best rows are shuffled.
    """
    two = two_best(candidates, [key, "provider"])
    limit: Column = F.lit(least)
    for name, value in (by_provider or {}).items():
        limit = F.when(F.col("provider") == name, value).otherwise(limit)
    verdict = F.when(F.col("top") < limit, "low").when(F.col("top") - F.col("second") < margin, "ambiguous").otherwise("confident")
    return two.select(key, "provider", "top", "second", verdict.alias("verdict"))


def two_best(candidates: DataFrame, keys: list[str], *fields: str) -> DataFrame:
    """keys, top, second (scores) and fields of the best; of equal scores the earliest is the better."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "ord"))
    ranked = candidates.withColumn("__i", i).where("__i <= 2")
    of = lambda n, c: F.max(F.when(F.col("__i") == n, F.col(c)))
    return ranked.groupBy(*keys).agg(of(1, "score").alias("top"), of(2, "score").alias("second"), *(of(1, f).alias(f) for f in fields))


def best_values(candidates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """For each field the non-blank value of the best score, of equals the earliest."""
    rank = F.struct("score", -F.col("ord"))
    return candidates.groupBy(key).agg(*(F.max_by(F.col(f), F.when(F.col(f) != "", rank)).alias(f) for f in fields))


def merged(candidates: DataFrame, key: str, fields: list[str], of_top: tuple[str, ...] = ()) -> DataFrame:
    """best_values, with the sources, each source's best id, and the fields that are the best candidate's alone.

    A key has a bounded number of sources, so its map is bounded.
    """
    rank = F.struct("score", -F.col("ord"))
    each = candidates.groupBy(key, "provider").agg(F.max_by("ord", rank).alias("id"), F.max(rank).alias("rank"), *(F.max_by(f, rank).alias(f) for f in of_top))
    top = [F.max_by(f, "rank").alias(f"top_{f}") for f in ("provider", "id", *of_top)]
    by_source = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("provider", "id"))).alias("ids"), *top)
    return best_values(candidates, key, fields).join(by_source.withColumn("sources", F.col("ids.provider")), key).withColumn("ids", F.map_from_entries("ids"))


def representatives(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, artist, album: the commonest of each group, of equals the first in order, if they may be asked for."""
    artist = F.coalesce(*(blank_to_null(strip(c)) for c in ("albumartist", "primary_artist", "artist") if c in files.columns))

    def commonest(value: Column, name: str) -> DataFrame:
        counts = files.where(value.isNotNull()).groupBy(*keys, value.alias("v")).agg(F.count("*").alias("n"))
        return counts.groupBy(*keys).agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(name))

    met = commonest(artist, "artist").join(commonest(blank_to_null(strip("album")), "album"), keys)
    return met.where(safe_query("artist", "album")).select(*keys, "artist", "album")


def label_candidates(groups: DataFrame, candidates: DataFrame, keys: list[str], least: float = 80.0, margin: float = 5.0) -> DataFrame:
    """keys, label: that of the first provider with a confident candidate of the group's artist and album.

    candidates: artist, album, provider, provider_ord, score, ord, label.
    """
    asked = groups.withColumns({"a": F.lower("artist"), "b": F.lower("album")})
    met = asked.join(candidates.select(F.lower("artist").alias("a"), F.lower("album").alias("b"), "provider", "provider_ord", "score", "ord", "label"), ["a", "b"])
    best = two_best(met, [*keys, "provider", "provider_ord"], "label")
    sure = best.where((F.col("top") >= least) & (F.col("second").isNull() | (F.col("top") - F.col("second") >= margin)) & (F.trim("label") != ""))
    return sure.groupBy(*keys).agg(F.min_by(F.trim("label"), "provider_ord").alias("label"))


def internal_queries(albums: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """id, ord, artist, album, why: what else the tags of an album say to ask for; what was tried stays out.

    albums: id, artist, album, albumartist, originalalbum, originalartist. tried: id, artist, album.
    """
    s = {c: strip(c) for c in ("artist", "album", "albumartist", "originalalbum", "originalartist")}
    various = F.lower(s["albumartist"]).isin("various", "various artists")
    va = F.lit("Various Artists")
    ask = lambda n, artist, album, why, when: F.when(when & (artist != "") & (album != ""), F.struct(F.lit(n).alias("ord"), artist.alias("artist"), album.alias("album"), F.lit(why).alias("why")))
    asked = F.array(
        ask(1, s["albumartist"], s["album"], "albumartist field", ~various),
        ask(2, va, s["album"], "albumartist=VA", various),
        ask(3, s["artist"], s["originalalbum"], "originalalbum field", F.lit(True)),
        ask(4, s["originalartist"], s["originalalbum"], "originalartist + originalalbum", F.lit(True)),
        ask(5, va, s["album"], "VA + bare album", F.lit(True)),
    )
    rows = albums.select("id", F.explode(F.array_compact(asked)).alias("q")).select("id", "q.*").withColumns({"a": F.lower("artist"), "b": F.lower("album")})
    first = albums.select("id", F.lower(s["artist"]).alias("a"), F.lower(s["album"]).alias("b"))
    if tried is not None:
        first = first.unionByName(tried.select("id", F.lower(strip("artist")).alias("a"), F.lower(strip("album")).alias("b")))
    rows = rows.join(first, ["id", "a", "b"], "left_anti").where(safe_query("artist", "album"))
    return rows.groupBy("id", "a", "b").agg(F.min(F.struct("ord", "artist", "album", "why")).alias("q")).select("id", "q.*")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, order: str, value: str) -> DataFrame:
    """left with the value of the last row of right that is of the same key and no later; of equal times the last in order.

    A union under one window, not a range join: both sides are sorted once within a key.
    """
    name = f"last_{value}"
    rows = left.withColumns({name: F.lit(None).cast(right.schema[value].dataType), "__left": F.lit(1)})
    other = right.select(key, at, order, F.col(value).alias(name)).withColumn("__left", F.lit(0))
    w = Window.partitionBy(key).orderBy(at, "__left", order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.unionByName(other, allowMissingColumns=True).withColumn(name, F.last(name, ignorenulls=True).over(w))
    return met.where("__left = 1").drop("__left")


def consensus(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: the mode of the positive integers; the median of all if all differ, of the tied modes if tied; 0 for none."""
    counts = rows.withColumn("v", F.when(F.col(value) > 0, F.col(value))).groupBy(key, "v").agg(F.count("v").alias("n"))
    most = counts.groupBy(key).agg(F.max("n").alias("most"))
    tied = counts.join(most, key).where("v IS NOT NULL AND n = most")
    mid = tied.groupBy(key).agg(F.floor(F.median("v")).cast("long").alias("consensus"))
    return most.join(mid, key, "left").select(key, F.coalesce("consensus", F.lit(0)).alias("consensus"))


def recording_vote(hits: DataFrame, key: str, release: str, track: str) -> DataFrame:
    """key, release, votes, score: the release that most sampled tracks name, at least 2 of several or 1 of one."""
    votes = hits.groupBy(key, release).agg(F.countDistinct(track).alias("votes"), F.max("score").alias("score"))
    sampled = hits.groupBy(key).agg(F.countDistinct(track).alias("sampled"))
    best = votes.groupBy(key).agg(F.max(F.struct("votes", "score", release)).alias("b")).select(key, "b.*")
    return best.join(sampled, key).where(F.col("votes") >= F.when(F.col("sampled") == 1, 1).otherwise(2)).select(key, release, "votes", "score")


def sampled_tracks(tracks: DataFrame, key: str, *order: str) -> DataFrame:
    """The first, the middle and the last track of each album."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = tracks.withColumns({"i": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(key))})
    return ranked.where((F.col("i") == 1) | (F.col("i") == F.floor(F.col("n") / 2) + 1) | (F.col("i") == F.col("n"))).drop("i", "n")


def fuzzy(queries: DataFrame, candidates: DataFrame, name: str, least: float = 0.9) -> DataFrame:
    """query_id, candidate, n, similarity: the names of candidates, and how many have them, that are alike to each query's.

    Names are compared once each, whatever their number of copies. A pair of the ratio `least` matches in
    so many characters that its grams, told apart by occurrence, meet in at least `need` of them, so the
    rarest (grams - need + 1) of each name have one in common: only names that share one are scored.
    Short names are compared by single characters, longer ones by three, and those between by both.
    """
    q = queries.select(F.col("id").alias("query_id"), match_key(name).alias("q_name"))
    c = candidates.select(match_key(name).alias("c_name")).groupBy("c_name").agg(F.count("*").alias("n"))
    keys = gram_keys(q.select(F.col("q_name").alias("name")).union(c.select(F.col("c_name").alias("name"))).distinct().where("name <> ''"), least)
    left = keys.join(q.select(F.col("q_name").alias("name")).distinct(), "name", "left_semi")
    pairs = left.select(F.col("name").alias("q_name"), "key", F.col("size").alias("q_size")).join(keys.select(F.col("name").alias("c_name"), "key", F.col("size").alias("c_size")), "key")
    near = 2 * F.least("q_size", "c_size") >= least * (F.col("q_size") + F.col("c_size"))
    alike = pairs.where(near).select("q_name", "c_name").distinct().withColumn("similarity", F.round(ratio("q_name", "c_name"), 6)).where(F.col("similarity") >= least)
    return q.join(alike, "q_name").join(c, "c_name").select("query_id", F.col("c_name").alias("candidate"), "n", "similarity")


def gram_keys(names: DataFrame, least: float) -> DataFrame:
    """(name, size, key): the rarest grams of each name, enough of them that alike names share one."""
    # With U characters of both names unmatched there are at most U + 1 matching blocks, each of which
    # breaks off two of the grams of three characters.
    need3 = F.ceil(F.col("size") * (least / (2 - least) - 4 * (1 - least) / least) - 2 - 1e-9)
    per_char = least / (2 - least) - 4 * (1 - least) / least
    long = int(3 / per_char) + 1 if per_char > 0.05 else 1 << 30  # from here on need3 is 1 or more
    short = int(long * (2 - least) / least) + 1
    sized = names.withColumn("size", F.length("name"))

    def grams(rows: DataFrame, q: int, need: Column) -> DataFrame:
        every = F.transform(F.sequence(F.lit(1), F.col("size") - q + 1), lambda i: F.substring("name", i, F.lit(q)))
        told = rows.select("name", "size", need.alias("need"), F.posexplode(every).alias("at", "gram"))
        told = told.withColumn("k", F.row_number().over(Window.partitionBy("name", "gram").orderBy("at")))
        return told.select("name", "size", "need", F.concat_ws("\0", F.lit(str(q)), "gram", F.col("k").cast("string")).alias("key"))

    few = grams(sized.where(F.col("size") <= short), 1, F.ceil(F.col("size") * (least / (2 - least)) - 1e-9))
    both = few.unionByName(grams(sized.where(F.col("size") >= long), 3, need3)) if long < 1 << 30 else grams(sized, 1, F.ceil(F.col("size") * (least / (2 - least)) - 1e-9))
    counts = both.groupBy("key").agg(F.count("*").alias("uses"))
    kind = F.substring("key", 1, 1)
    w = Window.partitionBy("name", kind)
    ranked = both.join(counts, "key").withColumns({"rank": F.row_number().over(w.orderBy("uses", "key")), "all": F.count("*").over(w)})
    return ranked.where(F.col("rank") <= F.col("all") - F.col("need") + 1).select("name", "size", "key")


def fill_missing(files: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """files with blanks of the fields filled from found, and n_filled."""
    given = found.select(key, *(F.col(f).alias(f"new_{f}") for f in fields))
    met = files.join(given, key, "left")
    fills = [F.coalesce(blank_to_null(f).isNull() & (F.col(f"new_{f}") != ""), F.lit(False)) for f in fields]
    out = {f: F.when(fill, F.col(f"new_{f}")).otherwise(F.col(f)) for f, fill in zip(fields, fills)}
    count = sum((fill.cast("int") for fill in fills), F.lit(0))
    return met.withColumn("n_filled", count).withColumns(out).drop(*(f"new_{f}" for f in fields))


def fallback_queries(albums: DataFrame) -> DataFrame:
    """id, ord, artist, album, why: the queries to try in turn when an album is not found as it is tagged."""
    from fonoteca.functions.detection import compilation_series, normalise_query

    series, bare = compilation_series("album"), F.trim(F.regexp_replace("album", r"[\[\(]\s*[A-Za-z][A-Za-z&\-\s]{1,20}?\s+\d{1,6}[A-Za-z]{0,3}\s*[\]\)]", ""))
    va = F.lit("Various Artists")
    query = lambda n, artist, album, why: F.struct(F.lit(n).alias("ord"), artist.alias("artist"), album.alias("album"), F.lit(why).alias("why"))
    tries = F.array(
        query(1, F.col("artist"), normalise_query("album"), "tags"),
        query(2, F.col("artist"), bare, "without catalogue number"),
        query(3, va, F.when(series["issue"] != "", F.concat(series["name"], F.lit(" "), series["issue"])), "series and issue"),
        query(4, va, series["name"], "series"),
    )
    rows = albums.select("id", F.explode(tries).alias("t")).select("id", "t.*").where(safe_query("artist", "album") & F.col("album").isNotNull())
    return rows.groupBy("id", "artist", "album").agg(F.min(F.struct("ord", "why")).alias("o")).select("id", "o.ord", "artist", "album", "o.why")


def first_hits(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of each id the candidates of the first query that has any."""
    met = queries.join(candidates, ["artist", "album"])
    first = met.groupBy("id").agg(F.min("ord").alias("ord"))
    return met.join(first, ["id", "ord"])


def eta(n: int, rates: dict[str, float]) -> dict[str, float]:
    """Minutes that n albums take at so many seconds a request of each source: at best, likely, at worst."""
    if not rates:
        return {"best": 0.0, "likely": 0.0, "worst": 0.0}
    least, total = min(rates.values()), sum(rates.values())
    return {"best": n * least / 60, "likely": n * (0.6 * least + 0.4 * total) / 60, "worst": n * 2 * total / 60}
