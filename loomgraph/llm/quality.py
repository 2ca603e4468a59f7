"""Quality rules with robust multivariate outliers, in DataFrame functions alone.

Word, symbol, capital, line and repetition counts give every text a vector of transformed shares. For each language and
source, each language and all rows the regularised minimum covariance determinant of that vector is found: from three
starts (median and its deviations, lower quartile and its deviations, median and the least deviations) concentration
steps take the half-plus subset of smallest Mahalanobis distance, give its mean and covariance, and go on until the
determinant falls no more; the start of least determinant counts, and is reweighted once by all rows within the 97.5 %
quantile. A group's estimate is then drawn towards its language's, and that towards the one of all rows, by SHRINK rows'
weight, at any size of group. A text is rejected if its squared Mahalanobis distance exceeds a chi-square limit, under
its group's covariance plus that of its own counts, which scatter by NOISE over the square root of its words.

Scale: the texts are read once, into a narrow table of counts; every step aggregates that table by estimate and distance
bin, with partial sums, in one pass; texts never move, and no group is gathered. Tables of a row a group are written, so
that Spark knows their size and broadcasts them only while they are small. Sums are whole numbers, so results don't
depend on the order of rows.

Defined results: null and empty texts have no words, fail the base rules and are not kept; very long texts are counted
whole, in one row's arrays of a few numbers a word; ties of distances share a bin, of whose rows each counts by the same
fraction; null languages and sources are groups of their own; tables of few rows are judged by what SHRINK and the least
deviations make of them; repeated rows count as often as they stand there; an empty table gives no rows; columns other
than doc_id, text, lang and source pass through untouched.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import durable, table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS, UPPER = r"[#*$%&|<>]", "[A-Z]"
REPEAT_WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30

#: Transformed statistics; the least standard deviation of each (the regularisation), and that of the statistic of one
#: text, times the square root of its number of words.
FEATURES = ("x_length", "x_symbols", "x_upper", "x_lines", "x_repeats")
LEAST, NOISE = (0.04, 0.03, 0.06, 0.12, 0.12), (0.6, 0.4, 0.6, 0.6, 0.6)
#: Rows by whose weight the wider estimate enters.
SHRINK = 100
#: A fall of the logarithm of the determinant by less than this is none.
FALL = 1e-2
#: Chi-square with 5 degrees of freedom: 1e-7 of clean texts lie beyond LIMIT, 0.025 beyond NEAR; what covariances of a half,
#: and of all within NEAR, lack of the full one.
LIMIT, NEAR, HALF_FACTOR, NEAR_FACTOR = 40.9, 12.833, 1.912, 1.0555
#: Features are whole numbers of 1 / UNIT, up to MOST; their histograms' bins are WIDTH wide; distance bins a doubling.
UNIT, MOST, WIDTH, BINS = 2048, 16.0, 4, 24
P = len(FEATURES)
#: Lower triangles are arrays by rows: row and column of each place, the place where each row begins.
PLACES = [(i, j) for i in range(P) for j in range(i + 1)]
ROW, COLUMN, BEGIN = [i for i, _ in PLACES], [j for _, j in PLACES], [i * (i + 1) // 2 for i in range(P)]


def counted(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines and n_repeat_words; text is replaced by its working forms."""
    w, n = REPEAT_WINDOW, F.size("words_")
    count = lambda letters: F.regexp_count("text_", F.lit(letters)).cast("long")
    # the hash of a word and the next, of two pairs, of two fours
    pairs = lambda c, k: F.zip_with(c, F.slice(c, k + 1, F.size(c)), lambda a, b: F.xxhash64(a, b))
    out = docs.withColumn("text_", F.coalesce(F.col("text"), F.lit(""))).withColumn("words_", F.regexp_extract_all("text_", F.lit(WORD), F.lit(0)))
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("words_", "")).cast("long"),
            "n_upper": count(UPPER),
            "n_symbols": count(SYMBOLS),
            "lines_": F.filter(F.split("text_", "\n", -1), lambda x: x.rlike(WORD)),
            "hashes_": F.when(n >= w, F.transform("words_", lambda x: F.xxhash64(x))),
        }
    )
    for k in (1, 2, 4):
        out = out.withColumn("hashes_", pairs("hashes_", k))
    out = out.withColumn("hashes_", F.slice("hashes_", 1, F.greatest(n - (w - 1), F.lit(0))))
    out = out.withColumns({"n_lines": F.size("lines_").cast("long"), "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long")})
    # only texts that have a repeated window sort their windows
    again = F.size(F.array_distinct("hashes_")) < F.size("hashes_")
    out = out.withColumn("sorted_", F.when(F.coalesce(again, F.lit(False)), F.sort_array(F.transform("hashes_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn("next_", F.when(F.col("sorted_").isNotNull(), F.zip_with(F.col("sorted_"), F.slice("sorted_", 2, F.size("sorted_")), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))))
    # a window stands twice or more if it equals the next one or the one before it in the sorted array
    out = out.withColumn("twice_", F.zip_with(F.col("next_"), F.concat(F.array(F.lit(False)), F.col("next_")), lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))))
    out = out.withColumn("starts_", F.sort_array(F.transform(F.filter(F.zip_with(F.col("sorted_"), F.col("twice_"), lambda s, y: F.when(y, s["i"])), lambda p: p.isNotNull()), lambda p: p)))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(w), p - a["at"])).alias("n"), p.alias("at"))
    covered = F.aggregate("starts_", F.struct(F.lit(0).alias("n"), F.lit(-w).alias("at")), step)["n"]
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.drop("text_", "words_", "lines_", "hashes_", "sorted_", "next_", "twice_", "starts_")


def judged(counts: DataFrame) -> DataFrame:
    """counts with base_failed, the group key and the features as whole numbers of 1/UNIT."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    x = {"x_length": F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)), "x_symbols": share("n_symbols", "word_chars"), "x_upper": share("n_upper", "word_chars"), "x_lines": share("n_dup_lines", "n_lines"), "x_repeats": share("n_repeat_words", "n_words")}
    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "group_": F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))),
        }
    ).withColumns({k: F.floor(F.least(v, F.lit(MOST)) * UNIT + 0.5).cast("long") for k, v in x.items()})


def levels() -> Column:
    """The keys that a group's rows count for: the group, its language, all rows."""
    return F.array(F.col("group_"), F.concat(F.lit("\x1e"), F.substring_index("group_", "\x1f", 1)), F.lit(""))


def quantile(bins: DataFrame, q: float) -> DataFrame:
    """key, k, at: the bin of bins (key, k, bin, n) in which the quantile lies."""
    w = Window.partitionBy("key", "k")
    upto = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    return upto.where(F.col("upto") >= q * F.col("all")).groupBy("key", "k").agg(F.min("bin").alias("at"))


def starts(vectors: DataFrame) -> DataFrame:
    """key, start, and the mean and (diagonal) factor of each start, from one histogram of all features."""
    long = vectors.select("group_", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.floor(F.col(f) / WIDTH).cast("long").alias("bin")) for i, f in enumerate(FEATURES)])).alias("e"))
    bins = durable(long.groupBy("group_", "e.k", "e.bin").agg(F.count("*").alias("n")), "bins")
    bins = durable(bins.select(F.explode(levels()).alias("key"), "k", "bin", "n").groupBy("key", "k", "bin").agg(F.sum("n").alias("n")), "bins")
    half, low = durable(quantile(bins, 0.5), "half"), durable(quantile(bins, 0.25), "low")

    def spread(at: DataFrame) -> DataFrame:
        off = bins.join(at, ["key", "k"]).select("key", "k", F.abs(F.col("bin") - F.col("at")).alias("bin"), "n").groupBy("key", "k", "bin").agg(F.sum("n").alias("n"))
        return at.join(quantile(off, 0.5).withColumnRenamed("at", "mad"), ["key", "k"])

    made = [spread(half), spread(low), half.withColumn("mad", F.lit(0).cast("long"))]
    rows = [x.select("key", F.lit(i).alias("start"), F.struct("k", ((F.col("at") + 0.5) * WIDTH / UNIT).alias("m"), (F.col("mad") * 1.4826 * WIDTH / UNIT).alias("s")).alias("f")) for i, x in enumerate(made)]
    each = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("key", "start").agg(F.sort_array(F.collect_list("f")).alias("f"))  # one a feature
    least = F.array(*map(F.lit, LEAST))
    diagonal = lambda t: F.when(of(ROW, t) == of(COLUMN, t), 1 / F.greatest(F.get("f", of(ROW, t))["s"], F.get(least, of(ROW, t)))).otherwise(0.0)
    return each.select("key", "start", F.transform("f", lambda x: x["m"]).alias("m"), F.transform(places(), diagonal).alias("w"))


def places() -> Column:
    return F.sequence(F.lit(0), F.lit(len(PLACES) - 1))


def of(values: list[int], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i)


def cholesky(c: Column, diagonal: Column) -> Column:
    """The lower factor of the covariance c with `diagonal` added to its diagonal."""

    def step(done, t):
        i, j = of(ROW, t), of(COLUMN, t)
        products = F.zip_with(F.slice(done, of(BEGIN, i) + 1, j), F.slice(done, of(BEGIN, j) + 1, j), lambda a, b: a * b)
        rest = F.get(c, t) - F.aggregate(products, F.lit(0.0), lambda a, b: a + b) + F.when(i == j, F.get(diagonal, i)).otherwise(0.0)
        return F.concat(done, F.array(F.when(i == j, F.sqrt(F.greatest(rest, F.lit(1e-12)))).otherwise(rest / F.get(done, of(BEGIN, j) + j))))

    return F.aggregate(places(), F.array().cast("array<double>"), step)


def inverse(low: Column) -> Column:
    """The inverse of a lower factor."""

    def step(done, t):
        i, j = of(ROW, t), of(COLUMN, t)
        inner = F.aggregate(F.sequence(j, i - 1), F.lit(0.0), lambda a, k: a + F.get(low, of(BEGIN, i) + k) * F.get(done, of(BEGIN, k) + j))
        own = F.get(low, of(BEGIN, i) + i)
        return F.concat(done, F.array(F.when(i == j, 1 / own).otherwise(-F.when(j < i, inner) / own)))

    return F.aggregate(places(), F.array().cast("array<double>"), step)


def distance() -> Column:
    """The squared Mahalanobis distance of the features from m, by the inverse factor w."""
    y = []
    for i in range(P):
        parts = [F.get("w", F.lit(i * (i + 1) // 2 + j)) * (F.col(FEATURES[j]) / UNIT - F.get("m", F.lit(j))) for j in range(i + 1)]
        y.append(sum(parts[1:], parts[0]))
    return sum((x * x for x in y[1:]), y[0] * y[0])


def terms() -> dict[str, Column]:
    """What the moments sum: a row's count, features and their products."""
    pairs = {f"s{i}{j}": F.col(FEATURES[i]) * F.col(FEATURES[j]) for i in range(P) for j in range(i + 1)}
    return {"n": F.lit(1).cast("long")} | {f"s{i}": F.col(f) for i, f in enumerate(FEATURES)} | pairs


def moments(out: DataFrame, factor: float) -> DataFrame:
    """out (terms) with means m and covariance c, times factor."""
    n = F.col("n").cast("double")
    out = out.withColumn("m", F.array(*[F.col(f"s{i}") / n / UNIT for i in range(P)]))
    return out.withColumn("c", F.array(*[(F.col(f"s{i}{j}") / n / UNIT / UNIT - F.get("m", F.lit(i)) * F.get("m", F.lit(j))) * factor for i, j in PLACES]))


def fitted(vectors: DataFrame, groups: DataFrame, fits: DataFrame) -> DataFrame:
    """A row for each vector and estimate (key, start, m, w) that its group counts for, with d2."""
    by_group = groups.join(fits.select("key", "start", "m", "w"), "key").groupBy("group_").agg(F.collect_list(F.struct("key", "start", "m", "w")).alias("fits"))  # three levels, three starts
    return vectors.join(by_group, "group_").select(*FEATURES, F.explode("fits").alias("f")).select(*FEATURES, "f.*").withColumn("d2", distance())


def concentrated(vectors: DataFrame, groups: DataFrame, fits: DataFrame) -> DataFrame:
    """key, start, m, w, det (logarithm) of the half-plus subset nearest by fits; of the last bin's rows each counts in part."""
    bins = fitted(vectors, groups, fits).groupBy("key", "start", F.floor(F.log2(F.col("d2") + 1e-3) * BINS).cast("long").alias("bin")).agg(*[F.sum(v).alias(k) for k, v in terms().items()])
    w = Window.partitionBy("key", "start")
    bins = bins.select("*", (F.sum("n").over(w.orderBy("bin")) - F.col("n")).alias("before"), F.sum("n").over(w).alias("all"))
    h = F.least(F.floor((F.col("all") + P + 1) / 2), F.col("all"))
    bins = bins.withColumn("part", F.least((h - F.col("before")) / F.col("n"), F.lit(1.0))).where("part > 0")
    out = moments(bins.groupBy("key", "start").agg(*[F.sum(F.floor(F.col(c) * F.col("part") + 0.5)).alias(c) for c in terms()]), HALF_FACTOR)
    out = out.select("key", "start", "m", cholesky(F.col("c"), F.array(*[F.lit(x * x) for x in LEAST])).alias("l"))
    det = F.aggregate(F.sequence(F.lit(0), F.lit(P - 1)), F.lit(0.0), lambda a, i: a + F.log(F.get("l", of(BEGIN, i) + i)))
    return out.select("key", "start", "m", inverse(F.col("l")).alias("w"), det.alias("det"))


def estimate(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """key, n (rows), m, c: the reweighted estimate of each key."""
    fits = durable(concentrated(vectors, groups, durable(starts(vectors), "starts")).withColumn("fell", F.lit(True)), "fits")
    best = fits
    while True:
        last = fits.where("fell")
        new = concentrated(vectors, groups, last).join(last.select("key", "start", F.col("det").alias("had")), ["key", "start"])
        fits = durable(new.withColumn("fell", F.col("det") < F.col("had") - FALL).drop("had"), "fits")
        if fits.where("fell").isEmpty():
            break
        best = best.unionByName(fits.where("fell"))
    one = best.groupBy("key").agg(F.min_by(F.struct("m", "w"), F.struct("det", "start")).alias("x")).select("key", F.lit(0).alias("start"), "x.*")
    near = fitted(vectors, groups, durable(one, "best")).groupBy("key").agg(F.count("*").alias("rows"), *[F.sum(F.when(F.col("d2") <= NEAR, v)).alias(k) for k, v in terms().items()])
    return moments(near.where("n > 0"), NEAR_FACTOR).select("key", F.col("rows").cast("double").alias("n"), "m", "c")


def shrunk(estimates: DataFrame, groups: DataFrame) -> DataFrame:
    """group_, m, c of every group: its own estimate, its language's and that of all rows, each drawn to the wider one."""
    out = groups.select("group_").distinct().withColumn("keys", levels())
    for i, tag in enumerate("gla"):
        tagged = estimates.select(F.col("key").alias(f"key_{tag}"), *[F.col(c).alias(f"{c}_{tag}") for c in "nmc"])
        out = out.withColumn(f"key_{tag}", F.col("keys")[i]).join(tagged, f"key_{tag}")

    def drawn(c: str, tag: str, wider: Column) -> Column:
        n = F.col(f"n_{tag}")
        return F.zip_with(F.col(f"{c}_{tag}"), wider, lambda a, b: (n * a + SHRINK * b) / (n + SHRINK))

    return out.select("group_", *[drawn(c, "g", drawn(c, "l", F.col(f"{c}_a"))).alias(c) for c in "mc"])


def outliers(counts: DataFrame) -> DataFrame:
    """counts (a durable table with text counts, lang, source) with base_failed, d2 and kept."""
    vectors = durable(judged(counts).where("NOT base_failed").select("group_", *FEATURES), "vectors")
    groups = durable(vectors.select("group_").distinct().select("group_", F.explode(levels()).alias("key")), "groups")
    fit = durable(shrunk(durable(estimate(vectors, groups), "estimates"), groups), "shrunk")
    out = judged(counts).join(fit, "group_", "left")
    # a factor and a solve a row, in plain columns: the covariance is the row's own
    for t, (i, j) in enumerate(PLACES):
        rest = F.get("c", F.lit(t)) + (F.lit(LEAST[i] ** 2) + F.lit(NOISE[i] ** 2) / F.greatest("n_words", F.lit(1)) if i == j else F.lit(0.0))
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    for i, f in enumerate(FEATURES):
        y = F.col(f) / UNIT - F.get("m", F.lit(i))
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    out = out.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))).drop(*[f"l{i}{j}" for i, j in PLACES], *[f"y{i}" for i in range(P)])
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("d2") > LIMIT, F.lit(False))).drop("group_", "m", "c", *FEATURES)


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, all columns untouched. One row is judged once however often its doc_id stands there."""
    free = {c: c if c in ("doc_id", "text", "lang", "source") else f"in_{c}" for c in docs.columns}  # no clash with the counts
    out = outliers(durable(counted(docs.toDF(*free.values())), "counts"))
    # a filter on kept alone would move below the factor's columns, each use of which then is written out in full; one on
    # a column that isn't deterministic stays where it is
    out = out.withColumn("at_", F.monotonically_increasing_id()).where("kept AND at_ >= 0")
    return out.select(*free.values()).toDF(*docs.columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = outliers(durable(counted(docs).drop("text"), "counts"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
