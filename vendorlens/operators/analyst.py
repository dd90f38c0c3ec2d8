"""Deterministic rules for the analyst stages: credibility, corroboration, horizon, factors, trajectory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vendorlens.functions.scalars import risk_level
from vendorlens.operators.evidence import mentions
from vendorlens.operators.segments import neighbour, time_segment
from vendorlens.sources.scratch import written

# Credibility of source classes; the last is for hosts of no class.
SOURCE_CLASSES = {"Official": 0.95, "News": 0.82, "Forum": 0.41, "Unknown": 0.30}
CREDIBLE, CORROBORATED, TRAJECTORY_STEP = 0.8, 2, 5

#: Words of routine evidence (a pattern of our own on lower-cased text).
ROUTINE = r"\b(?:annual report|quarterly (?:report|results)|form (?:10-k|10-q|8-k)|proxy statement|earnings call|historical(?:ly)?|market (?:news|update)|share price)\b"


def source_class(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(host_suffix, class, credibility) from (host_suffix, class)."""
    return spark.createDataFrame([(h, c, SOURCE_CLASSES[c]) for h, c in rows], "host_suffix string, class string, credibility double")


def credibility(evidence: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds host, class and credibility of each row's url: the class of the longest suffix of its host.

    Suffixes are joined by equality: each host's own suffixes are listed (a handful)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[^:]+://([^/?#]+)", 1))
    rows = evidence.withColumn("host", host)
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    near = rows.select("host").distinct().withColumn("host_suffix", F.explode(suffixes)).join(classes, "host_suffix")
    best = near.groupBy("host").agg(F.max_by(F.struct("class", "credibility"), F.length("host_suffix")).alias("x"))
    return rows.join(best, "host", "left").withColumns({"class": F.coalesce("x.class", F.lit("Unknown")), "credibility": F.coalesce("x.credibility", F.lit(SOURCE_CLASSES["Unknown"]))}).drop("x")


def supported_signals(signals: DataFrame, keys: list[str]) -> DataFrame:
    """For each key and signal: its hosts, whether several have it, the best credibility and the joint confidence.

    ``signals`` has the signal columns with host and credibility; a host counts once. With a column ``is_routine`` of the evidence,
    a signal has one too: whether all of its evidence is routine."""
    own = [*keys, "category", "severity", "keyword", "weight", "ord"]
    news = F.bool_and("is_routine") if "is_routine" in signals.columns else F.lit(False)
    once = signals.groupBy(*own, "host").agg(F.max("credibility").alias("credibility"), news.alias("is_routine"))
    joint = 1 - F.exp(F.sum(F.log(1 - F.col("credibility"))))
    return once.groupBy(*own).agg(F.count("*").alias("n_hosts"), F.max("credibility").alias("best"), F.round(joint, 6).alias("confidence"), F.bool_and("is_routine").alias("is_routine")).withColumn("corroborated", F.col("n_hosts") >= CORROBORATED)


def subject_check(evidence: DataFrame, vendor_col: str = "vendor_name", *, chars: int = 500, least: int = 1) -> DataFrame:
    """Adds mentions of the vendor in title and start of the snippet, and whether it is the subject."""
    name = F.lower(F.trim(F.col(vendor_col)))
    text = F.lower(F.concat_ws(" ", F.col("title"), F.substring("snippet", 1, chars)))
    count = ((F.length(text) - F.length(F.replace(text, name, F.lit("")))) / F.length(name)).cast("int")
    return evidence.withColumn("n_mentions", F.when(mentions(F.col(vendor_col), F.col("title"), F.col("snippet")) & (F.length(name) > 0), count).otherwise(0)).withColumn("is_subject", F.col("n_mentions") >= least)


def horizon(newest: Column, as_of: Column) -> Column:
    """Immediate to 30 days, near-term to 90, medium-term to 180, else long-term; near-term without a date."""
    days = F.datediff(as_of, newest)
    return F.when(days.isNull(), "Near-term").when(days <= 30, "Immediate").when(days <= 90, "Near-term").when(days <= 180, "Medium-term").otherwise("Long-term")


def primary_category(groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, primary_category, secondary): the heaviest category and the others in order."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "ord", "category")))
    named = groups.groupBy(*keys).agg(F.transform(rows, lambda x: x.category).alias("c"))
    return named.select(*keys, F.col("c")[0].alias("primary_category"), F.slice("c", F.lit(2), F.size("c")).alias("secondary"))


def top_factors(supported: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """The n signals of a key with the largest weight times confidence."""
    strength = F.round(F.col("weight") * F.col("confidence"), 6)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("strength"), "ord"))
    return supported.withColumn("strength", strength).withColumn("place", place).where(F.col("place") <= n)


def routine(text: Column) -> Column:
    """Whether evidence is routine news: corporate filings, historic cases, market reports."""
    return F.coalesce(F.lower(text).rlike(ROUTINE), F.lit(False))


def override_level(supported: DataFrame, keys: list[str]) -> DataFrame:
    """Score and level from all signals, and from those only that are corroborated or from a credible source and not routine.

    ``supported`` may have a column ``is_routine``: whether all evidence of the signal is routine. A level of HIGH or
    CRITICAL that routine signals alone hold up comes down to MEDIUM or LOW by that.
    """
    news = F.coalesce(F.col("is_routine"), F.lit(False)) if "is_routine" in supported.columns else F.lit(False)
    solid = (F.col("corroborated") | (F.col("best") >= CREDIBLE)) & ~news
    score = lambda w: F.least(F.lit(100), F.coalesce(F.sum(w), F.lit(5))).cast("int")
    both = supported.groupBy(*keys).agg(score(F.col("weight")).alias("raw_score"), score(F.when(solid, F.col("weight"))).alias("adjusted_score"))
    return both.withColumns({"raw_level": risk_level(F.col("raw_score")), "adjusted_level": risk_level(F.col("adjusted_score"))})


#: Shorter by this than a known similarity, since similarities are rounded to six places.
_ROUNDED = 1e-6


def _profiles(rows: DataFrame, key: str, places: DataFrame, on: list[str]) -> DataFrame:
    """(key, bits, tokens, size): the set of each key's signals as bits, 64 to a number, and in the order of ``places``."""
    listed = rows.join(places, on).groupBy(key).agg(F.array_sort(F.collect_list("place")).alias("all"))
    words = F.sequence(F.lit(0), F.expr("array_max(all) div 64"))
    bits = F.transform(words, lambda w: F.aggregate(F.filter("all", lambda x: F.floor(x / 64) == w), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (x % 64).cast("int")))))
    return listed.select(key, bits.alias("bits"), F.col("all").alias("tokens"), F.size("all").alias("size"))


def _shared(a: str, b: str) -> Column:
    both = F.zip_with(a, b, lambda x, y: F.bit_count(F.coalesce(x, F.lit(0).cast("long")).bitwiseAND(F.coalesce(y, F.lit(0).cast("long")))))
    return F.aggregate(both, F.lit(0), lambda acc, x: acc + x)


def analogues(signals: DataFrame, cases: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, case_id, shared, jaccard, place): the k known cases whose signals are most alike.

    Keys and cases with the same signals are compared once: what is joined are distinct sets, as bits. A set meets cases by its
    signals from the rarest one on. The first gives a similarity that k + 1 cases reach; from then on only as many signals are
    looked up as a case of that similarity can miss, and only cases of a size that allows it. The first common
    signal names a pair, so none is met twice.
    """
    on = ["category", "severity", "keyword"]
    own = written(signals.select(key, *on).distinct(), "analogue-signals")
    known = written(cases.where(F.col(key).isNotNull()).select(F.col(key).alias("case_id"), *on).distinct(), "analogue-cases")
    # at most as many rows as the lexicon has entries
    rare = known.groupBy(*on).agg(F.count("*").alias("n"))
    seen = own.select(*on).distinct().join(rare, on, "full")
    places = seen.select(*on, "n", (F.row_number().over(Window.orderBy(F.col("n").isNull(), "n", *on)) - 1).alias("place"))
    places = written(places, "analogue-places")
    sets = written(_profiles(own, key, places.drop("n"), on), "analogue-sets")
    n_all, last = places.agg(F.count("*"), F.count("n")).first()
    mine = sets.groupBy("bits").agg(F.first("tokens").alias("t"), F.first("size").alias("a")).select("bits", "a", F.filter("t", lambda x: x < F.lit(last)).alias("tokens"))
    place = F.row_number().over(Window.partitionBy("bits").orderBy("case_id"))
    listed = _profiles(known, "case_id", places.drop("n"), on).withColumn("_place", place).where(F.col("_place") <= k + 1)
    other = listed.groupBy(F.col("bits").alias("case_bits")).agg(F.first("tokens").alias("case_tokens"), F.first("size").alias("b"), F.array_sort(F.collect_list("case_id")).alias("ids"))
    size_class = lambda c: F.floor(F.log2(c)).cast("int")
    postings = other.select("*", F.explode("case_tokens").alias("token"), size_class(F.col("b")).alias("class"))

    def met(tokens: DataFrame, allowed: Column) -> DataFrame:
        """The best pairs of sets that meet at a token, with their similarity."""
        pairs = tokens.join(postings, ["token", "class"]).where(allowed & (F.col("token") == F.array_intersect("tokens", "case_tokens")[0]))
        scored = pairs.withColumn("shared", _shared("bits", "case_bits").cast("long"))
        return scored.select("bits", "ids", "shared", F.round(F.col("shared") / (F.col("a") + F.col("b") - F.col("shared")), 6).alias("jaccard"))

    def best(pairs: DataFrame) -> DataFrame:
        """(bits, top): the k + 1 best cases of each set, in order."""
        # a case among the best lies in one of as many best pairs
        nth = F.row_number().over(Window.partitionBy("bits").orderBy(F.desc("jaccard"), F.col("ids")[0]))
        few = pairs.withColumn("_n", nth).where(F.col("_n") <= k + 1).select("bits", F.explode("ids").alias("case_id"), "shared", "jaccard")
        top = F.array_sort(F.collect_list(F.struct((-F.col("jaccard")).alias("far"), "case_id", "shared", "jaccard")))
        return few.groupBy("bits").agg(F.slice(top, 1, k + 1).alias("top"))

    largest = F.lit(float(max(n_all, 1)))
    first = mine.where(F.size("tokens") > 0).select("*", F.col("tokens")[0].alias("token"), F.explode(F.sequence(F.lit(0), size_class(largest))).alias("class"))
    some = written(met(first, F.lit(True)), "analogue-first")
    reached = best(some).select("bits", F.when(F.size("top") > k, F.element_at("top", -1).jaccard - _ROUNDED).otherwise(0.0).alias("least"))
    bound = mine.join(reached, "bits", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    bound = bound.withColumns({"lo": F.col("least") * F.col("a"), "hi": F.when(F.col("least") > 0, F.least(largest, F.col("a") / F.col("least"))).otherwise(largest)})
    prefix = F.size("tokens") - F.greatest(F.lit(1), F.ceil("lo").cast("int")) + 1
    more = bound.withColumn("_prefix", prefix).where("_prefix > 1").select("*", F.explode(F.slice("tokens", F.lit(2), F.col("_prefix") - 1)).alias("token"))
    low = size_class(F.greatest(F.col("lo"), F.lit(1.0)))
    more = more.select("*", F.explode(F.sequence(low, F.greatest(low, size_class(F.greatest(F.col("hi"), F.lit(1.0)))))).alias("class"))
    rest = met(more, (F.col("b") >= F.col("lo")) & (F.col("b") <= F.col("hi")))
    tops = best(some.unionByName(rest))
    found = sets.select(key, "bits").join(tops, "bits")
    mineless = F.slice(F.filter("top", lambda x: x.case_id != F.col(key)), 1, k)
    return found.select(key, F.posexplode(mineless).alias("pos", "x")).select(key, "x.case_id", "x.shared", "x.jaccard", (F.col("pos") + 1).alias("place"))


def trajectory(reports: DataFrame, *, days: float = 30) -> DataFrame:
    """Adds previous_score and trajectory of each report within its vendor's history, which is cut into segments of so many days."""
    delta = F.col("risk_score") - F.col("previous_score")
    rule = F.when((F.col("risk_level") == "CRITICAL") & (delta >= 0), "Critical").when(delta <= -TRAJECTORY_STEP, "Improving").when(delta >= TRAJECTORY_STEP, "Deteriorating").otherwise("Stable")
    found = neighbour(reports, ["vendor_id"], ["created_at", "report_id"], {"previous_score": "risk_score"}, time_segment(F.col("created_at"), days))
    return found.withColumn("trajectory", rule)


def converging(signals: DataFrame, key: str, day_col: str = "day", days: int = 90) -> DataFrame:
    """(key, day, weights and categories in the trailing window and the one before it), for each day with a signal.

    A category enters the window on a day with a signal of it if it isn't in it, and leaves it ``days`` after the last one; the
    number of categories is the running sum of these events, and no list of them is kept. Windows run over days, not signals.
    """
    number = F.datediff(F.col(day_col), F.lit("1970-01-01").cast("date"))
    daily = signals.groupBy(key, "category", number.alias("_d")).agg(F.sum("weight").alias("_w"))
    own = Window.partitionBy(key, "category").orderBy("_d")
    gaps = daily.withColumns({"_enters": F.coalesce(F.col("_d") - F.lag("_d").over(own) >= days, F.lit(True)), "_leaves": F.coalesce(F.lead("_d").over(own) - F.col("_d") >= days, F.lit(True))})
    event = lambda on, day, now, before, weight, is_day: F.when(on, F.struct(day.alias("d"), F.lit(now).alias("now"), F.lit(before).alias("before"), weight.alias("w"), F.lit(is_day).alias("is_day")))
    d, none = F.col("_d"), F.lit(0).cast("long")
    events = F.array(
        event(F.lit(True), d, 0, 0, F.col("_w"), True), event(F.col("_enters"), d, 1, 0, none, False), event(F.col("_leaves"), d + days, -1, 0, none, False),
        event(F.col("_enters"), d + days, 0, 1, none, False), event(F.col("_leaves"), d + 2 * days, 0, -1, none, False),
    )
    moves = gaps.select(key, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).groupBy(key, "e.d").agg(F.sum("e.now").alias("now"), F.sum("e.before").alias("before"), F.sum("e.w").alias("w"), F.bool_or("e.is_day").alias("is_day"))
    order = Window.partitionBy(key).orderBy("d")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    window = lambda lo, hi: F.coalesce(F.sum("w").over(order.rangeBetween(lo, hi)), F.lit(0))
    found = moves.select(
        key, F.date_add(F.lit("1970-01-01").cast("date"), F.col("d")).alias(day_col), "is_day", window(-days + 1, 0).alias("weight_now"), window(-2 * days + 1, -days).alias("weight_before"),
        F.sum("now").over(up_to).cast("int").alias("categories_now"), F.sum("before").over(up_to).cast("int").alias("categories_before"),
    )
    return found.where("is_day").drop("is_day")
