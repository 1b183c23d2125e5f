"""Quality rules by robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Method. Each text gives a vector of transformed statistics (FEATURES). For the texts of a language and source, the estimate is the mean and covariance of that share
(H) of the vectors whose covariance has the least determinant: from two starts (medians and quartile ranges; mean and covariance of all vectors) concentration steps
take the H vectors nearest by Mahalanobis distance and estimate again, and the start that ends with the smaller determinant wins. It is then reweighted: mean and covariance of all vectors
within the 97.5 % quantile. A text farther from its group's estimate than CUTOFF is rejected. The covariance is regularised by adding the square of a smallest scale (FLOORS) for
each statistic, since most texts have no symbols or repeated lines at all, which would leave it singular.

In Spark. Statistics come from one projection over the texts and are staged; everything after that reads a few numbers a row. Equal vectors of a language and source count once, so that
copies, however many, can't become the estimate. The H nearest are found by counts of distances in bins of a 32nd of an octave, exactly those up to the bin that reaches H; so a group of any size is
counts and sums that are aggregated before they are shuffled, never sorted or brought together. Estimates are one row a group and start.
A language and source with fewer than LEAST vectors is taken with the others of its language that are; if these are too few, it is held against the language's largest group; without
one, it is taken with those of other languages, or held against the largest group of all. Where no group has LEAST vectors, no text is rejected but by the base rule.

Base rule: fewer than 50 words, or more than half of them in windows of three words that occur twice or more. Texts that fail it don't take part in estimates.

Nulls: a null text has no words; a null language or source is one of its own. Repeated rows get a row each. Very long texts are taken whole (windows are told apart by packed hashes, which are
checked word by word, up to PACKED words, and by the words themselves beyond). Empty tables give empty results; columns that aren't asked for are ignored. Only functions of DataFrames; nothing comes to the driver but the number of groups and the name of the largest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of

#: Blanks between words: code points 9 to 13 and 32.
BLANKS, BLANK_RUN = "\t\n\x0b\x0c\r ", r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words whose windows' places fit the packed form.
PACKED_BITS = 20
PACKED = 1 << PACKED_BITS

#: Transformed statistics, and the scale below which a difference in one of them says nothing. That of length is wide: a text a hundred times the usual one is no outlier for that alone.
FEATURES = {
    "log_word_length": ("ln((word_chars + 1) / (n_words + 1))", 0.05),
    "symbols": ("sqrt(n_symbols / (word_chars + 1))", 0.04),
    "repeated_lines": ("sqrt(n_dup_lines / (n_lines + 1))", 0.15),
    "repeated_words": ("sqrt(n_repeat_words / (n_words + 1))", 0.15),
    "log_words": ("ln(n_words + 1)", 1.5),
}
FLOORS = [floor for _, floor in FEATURES.values()]
P = len(FEATURES)
X = [f"x{i}" for i in range(P)]
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]
#: Share of the vectors that the determinant is the least of; what makes the covariance of such a share, and of those within the 97.5 % quantile, that of all if they are normal (5 statistics).
H, H_FACTOR, QUANTILE, Q_FACTOR = 0.75, 1.4132, 12.8325, 1.0591
#: Squared distance from which a text is rejected: the quantile of the chi-squared distribution of 5 degrees that 1.5e-5 exceed.
CUTOFF = 30.0
LEAST, STEPS, BINS = 60, 4, 32
#: Estimates are broadcast up to so many groups (some 250 bytes each).
BROADCAST_GROUPS = 50_000


def _long(c: Column) -> Column:
    return c.cast("long")


def _repeated(n: Column) -> Column:
    """Words in windows of three that occur at least twice, from __words and __hits (packed hash and place of such windows, in order)."""
    w, hits = F.col("__words"), F.col("__hits")
    place = lambda x: x.bitwiseAND(PACKED - 1).cast("int")
    differ = lambda p, q: (w[p] != w[q]) | (w[p + 1] != w[q + 1]) | (w[p + 2] != w[q + 2])
    clash = F.filter(hits, lambda x, k: (k > 0) & (F.shiftright(F.get(hits, k - 1), PACKED_BITS) == F.shiftright(x, PACKED_BITS)) & differ(place(F.get(hits, k - 1)), place(x)))
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("place"))))
    return F.when(n < 3, F.array().cast("array<int>")).when((n > PACKED) | (F.size(clash) > 0), _plain_repeats(windows)).otherwise(F.sort_array(F.transform(hits, place)))


def _plain_repeats(windows: Column) -> Column:
    """Places of windows that stand beside an equal one in their order; for the rare texts that the packed form can't tell."""
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    runs = F.aggregate(
        windows,
        F.struct(F.lit(None).cast("struct<a:string,b:string,c:string,place:int>").alias("last"), F.array().cast("array<int>").alias("found")),
        lambda a, x: F.struct(x.alias("last"), F.when(F.coalesce(same(a["last"], x), F.lit(False)), F.concat(a["found"], F.array(a["last"]["place"], x["place"]))).otherwise(a["found"]).alias("found")),
    )
    return F.sort_array(F.array_distinct(runs["found"]))


def statistics(docs: DataFrame, columns: list[str]) -> DataFrame:
    """columns of docs, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, base_failed."""
    # each of these steps refers to the one before more than once, so that they stay apart and nothing is worked out twice
    held = docs.select(*columns, text_of().alias("__text"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    held = held.select(*columns, F.array_remove(F.split("__text", BLANK_RUN), "").alias("__words"), _long(F.regexp_count("__text", F.lit(SYMBOLS))).alias("n_symbols"), lines.alias("__lines"))
    w, n = F.col("__words"), F.size("__words")
    counted = held.select(
        *columns, "__words", "n_symbols", _long(n).alias("n_words"), _long(F.length(F.array_join(w, ""))).alias("word_chars"), _long(F.size("__lines")).alias("n_lines"),
        _long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        F.sort_array(F.when((n >= 3) & (n <= PACKED), F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.shiftleft(F.xxhash64(w[i], w[i + 1], w[i + 2]), PACKED_BITS).bitwiseOR(_long(i)))).otherwise(F.array().cast("array<long>"))).alias("__sorted"),
    )
    s, key = F.col("__sorted"), lambda x: F.shiftright(x, PACKED_BITS)
    near = F.filter(s, lambda x, k: (key(F.get(s, k - 1)) == key(x)) | (key(F.get(s, k + 1)) == key(x)))
    kept = [*columns, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    hits = counted.select(*kept, "__words", near.alias("__hits"))
    places = hits.select(*kept, _repeated(F.size("__words")).alias("__places"))
    at = F.col("__places")
    covered = F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.get(at, k + 1) - x)), F.lit(0).cast("long"), lambda a, x: a + x)
    found = places.select(*kept, covered.alias("n_repeat_words"))
    return found.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def named_group(level: int, *columns: str) -> Column:
    return F.to_json(F.struct(F.lit(level).alias("level"), *columns))


def groups_of(vectors: DataFrame) -> DataFrame:
    """own (a language and source), group (those it is held against; null if there are too few vectors), member (whether it is estimated with them). vectors: language, origin."""
    own, wide = named_group(0, "language", "origin"), named_group(1, "language")
    sizes = staged(vectors.groupBy(own.alias("own"), wide.alias("wide")).agg(F.count("*").alias("n")), "sizes")
    large, small = sizes.where(F.col("n") >= LEAST), sizes.where(F.col("n") < LEAST)
    pools = small.groupBy("wide").agg(F.sum("n").alias("wide_n"))
    leading = large.groupBy("wide").agg(F.max_by("own", F.struct("n", "own")).alias("leading"))
    rest = pools.join(leading, "wide", "left_anti").agg(F.sum(F.when(F.col("wide_n") < LEAST, F.col("wide_n"))).alias("n")).first().n or 0
    every = large.select(F.col("own").alias("name"), "n").union(pools.where(F.col("wide_n") >= LEAST).select("wide", "wide_n"))
    most = every.agg(F.max_by("name", F.struct("n", "name")).alias("name")).first().name
    named = sizes.join(pools, "wide", "left").join(leading, "wide", "left")
    group = F.when(F.col("n") >= LEAST, F.col("own")).when(F.col("wide_n") >= LEAST, F.col("wide")).when(F.col("leading").isNotNull(), F.col("leading"))
    pooled = rest >= LEAST
    group = group.otherwise(F.lit('{"level":2}' if pooled else most))
    member = (F.col("n") >= LEAST) | (F.coalesce("wide_n", F.lit(0)) >= LEAST) | (F.col("leading").isNull() & F.lit(pooled))
    return named.select("own", group.alias("group"), member.alias("member"))


def _estimate(moments: DataFrame, factor: float) -> DataFrame:
    """From means m0.. and covariances c_i_j of a group the inverse triangle (w_i_j) of its regularised covariance, and the logarithm of the determinant."""
    out = moments
    for i, j in LOWER:  # the triangle of Cholesky, a column at a time so that each is worked out once
        own = F.col(f"c{i}_{j}") * factor + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
        for k in range(j):
            own = own - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        out = out.withColumn(f"l{i}_{j}", F.sqrt(own) if i == j else own / F.col(f"l{j}_{j}"))
    for i in range(P):
        for j in range(i, -1, -1):
            own = F.lit(1.0) if i == j else F.lit(0.0)
            for k in range(j, i):
                own = own - F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}")
            out = out.withColumn(f"w{i}_{j}", own / F.col(f"l{i}_{i}"))
    size = sum((F.ln(F.col(f"l{i}_{i}")) for i in range(P)), F.lit(0.0))
    return out.select("group", "start", *(f"m{i}" for i in range(P)), *(f"w{i}_{j}" for i, j in LOWER), size.alias("size"))


def _moments(rows: DataFrame) -> DataFrame:
    means = [F.avg(x).alias(f"m{i}") for i, x in enumerate(X)]
    return rows.groupBy("group", "start").agg(*means, *(F.covar_pop(X[i], X[j]).alias(f"c{i}_{j}") for i, j in LOWER))


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from the estimate beside it."""
    along = (sum((F.col(f"w{i}_{j}") * (F.col(X[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(P))
    return sum((y * y for y in along), F.lit(0.0))


def _hinted(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def nearest_share(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """The rows of each group and start up to the bin of distances that reaches the share H. rows: group, x0.."""
    far = rows.join(_hinted(estimates, few), "group").select("group", "start", *X, distance().alias("d2"))
    far = far.withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-12) * BINS).cast("int"))
    counts = far.groupBy("group", "start", "bin").agg(F.count("*").alias("n"))
    # bins of a group: an aggregate of a few thousand rows at most, as doubles have some 2,000 octaves and distances far fewer
    along = Window.partitionBy("group", "start").orderBy("bin")
    reach = counts.select("group", "start", "bin", F.sum("n").over(along).alias("up_to"), F.sum("n").over(Window.partitionBy("group", "start")).alias("all"))
    edge = reach.where(F.col("up_to") >= F.col("all") * H).groupBy("group", "start").agg(F.min("bin").alias("edge"))
    return far.join(_hinted(edge, few), ["group", "start"]).where(F.col("bin") <= F.col("edge"))


def estimates(vectors: DataFrame, few: bool) -> DataFrame:
    """vectors: group, x0.. One row a group: m0.., w0_0.., of the minimum-covariance-determinant estimate, reweighted."""
    quart = vectors.groupBy("group").agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i, x in enumerate(X)))
    scale = lambda i: F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i]))
    middle = quart.select(
        "group", F.lit(0).alias("start"), *(F.col(f"q{i}")[1].alias(f"m{i}") for i in range(P)), *((1 / scale(i) if i == j else F.lit(0.0)).alias(f"w{i}_{j}") for i, j in LOWER), F.lit(0.0).alias("size")
    )
    every = _estimate(_moments(vectors.withColumn("start", F.lit(1))), 1.0)
    now = staged(middle.unionByName(every), "estimates")
    for _ in range(STEPS):
        now = staged(_estimate(_moments(nearest_share(vectors, now, few)), H_FACTOR), "estimates")
    best = now.groupBy("group").agg(F.min(F.struct("size", "start", *(c for c in now.columns if c not in ("group", "size", "start")))).alias("best")).select("group", "best.*")
    within = vectors.join(_hinted(best, few), "group").where(distance() <= QUANTILE).select("group", "start", *X)
    return staged(_estimate(_moments(within), Q_FACTOR), "estimates").drop("start", "size")


def quality_rules(docs: DataFrame, columns: list[str]) -> DataFrame:
    """columns of docs; its statistics, base_failed, distance (squared; null where there is no estimate or the base rule fails) and kept. docs: text, lang, source."""
    named = docs.select(*columns, "text", F.col("lang").cast("string").alias("language"), F.col("source").cast("string").alias("origin"))
    found = statistics(named, [*columns, "language", "origin"]).withColumns({x: F.expr(sql) for x, (sql, _) in zip(X, FEATURES.values())})
    found = staged(found, "statistics")
    own = named_group(0, "language", "origin")
    vectors = found.where(~F.col("base_failed")).select("language", "origin", *X).distinct()
    vectors = staged(vectors, "vectors")
    groups = staged(groups_of(vectors), "groups")
    few = groups.count() <= BROADCAST_GROUPS
    of_group = _hinted(groups.where(F.col("group").isNotNull()), few)
    learned = estimates(vectors.withColumn("own", own).join(of_group.where("member"), "own").select("group", *X), few)
    far = groups.join(learned, "group").select("own", *(c for c in learned.columns if c != "group"))
    told = found.withColumn("own", own).join(_hinted(far, few), "own", "left")
    d2 = F.when(~F.col("base_failed"), distance())
    told = told.select(*columns, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", d2.alias("distance"))
    return told.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))
