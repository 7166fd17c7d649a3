"""Quality rules: fixed limits, then robust multivariate outliers, with DataFrame functions only.

Every text gives counts (words, their characters, symbols, repeated lines, words in repeated
five-word windows). Fixed limits reject texts of fewer than `MIN_WORDS` words and texts with over
20 % of their words in repeated windows. The others are judged within their language and source:
the counts become a vector of four transformed statistics, the minimum covariance determinant
gives a location and a covariance that outliers cannot pull, and a text whose squared Mahalanobis
distance exceeds `LIMIT` is rejected.

The statistics are the logarithm of the mean word length and the arcsine square roots of three
shares (symbols, repeated lines, repeated words). Pseudo-counts draw short texts, whose ratios say
little, towards a plain text, so that they are not rejected for chance.

The estimate takes concentration steps from two deterministic starts (all rows; medians and
quartiles): distances of all rows under the present fit, then mean and covariance of the
`HALF` share of rows with the smallest ones, whose determinant cannot grow; the start that ends
with the smaller determinant wins. A step is one aggregation by (group, distance bin) that carries
the sums of all products; the fit follows from the running totals over a group's bins, so a group
with a third of all rows costs a few hundred partial sums. Sums are of whole numbers (statistics in
units of 1/4096), so results do not depend on the order of rows. The covariance gets the squares of
`FLOOR` on its diagonal, since most texts have no symbol at all and a spread of zero would make
every other text infinitely far.

Groups of under `MIN_GROUP` judged rows are pooled by language, and languages that are still too
small into one group. Defined cases: a null text has no words and is rejected, like an empty one;
null languages and sources are groups like others; repeated rows get the same verdict; an empty
table gives an empty result; other columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from moundlens.llm.common import durable, read_table

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
HALF = 0.75  # share of a group's rows that the fit rests on
CONSISTENCY = 1.485  # makes the covariance of that share estimate that of normal data (4 dimensions)
LIMIT = 28.47  # chi-square with 4 degrees of freedom, 1 - 1e-5
FLOOR = (0.08, 0.06, 0.15, 0.15)
MIN_GROUP = 50
STEPS = 10
UNIT = 4096
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
P = 4
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; the window at place i covers i .. i + 4."""

    def places(s: Column) -> Column:
        def at(k: Column) -> Column:
            own = F.get(s, k)["x"]
            again = (own == F.get(s, k - 1)["x"]) | (own == F.get(s, k + 1)["x"])
            return F.when(F.coalesce(again, F.lit(False)), F.get(s, k)["i"])

        spots = F.transform(F.sequence(F.lit(0), F.size(s) - 1), at)
        return F.array_sort(F.filter(spots, lambda i: i.isNotNull()))

    def add(acc: Column, i: Column) -> Column:
        total = acc["total"] + F.least(F.lit(WINDOW), i - acc["last"]).cast("long")
        return F.struct(i.alias("last"), total.alias("total"))

    pairs = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(_let(pairs, places), start, add, lambda acc: acc["total"])


def with_counts(df: DataFrame, text: str) -> DataFrame:
    """Adds the columns of COUNTS, n_lines and base_failed; all names in `df` must be internal."""
    keep = df.columns
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = F.array_remove(F.split(whole, "[\\x20\\x09-\\x0D]+"), "")
    # translate() deletes what has no counterpart
    lines = F.filter(F.split(whole, "\n"), lambda x: F.translate(x, _BLANKS, "") != "")
    df = df.select(
        *keep,
        parts.alias("_w"),
        lines.alias("_l"),
        F.length(F.translate(whole, _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    last = F.size("_w") - WINDOW
    hashes = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(F.col("_w"), i + k) for k in range(WINDOW)))
    )
    df = df.withColumn("_h", F.when(last >= 0, hashes).otherwise(F.array().cast("array<long>")))
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, _covered(F.col("_h"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )
    few = F.col("n_words") < MIN_WORDS
    return df.withColumn("base_failed", few | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT))


def _share(part: str, whole: Column) -> Column:
    return F.asin(F.sqrt(F.least(F.col(part) / whole, F.lit(1.0))))


def _vector() -> list[Column]:
    """The statistics in whole units; bounded, so that sums of products fit 64 bits."""
    words, symbols = F.col("n_words"), F.col("n_symbols")
    length = F.log((F.col("word_chars") + 250) / (words + 50))  # 50 words of five characters
    stats = [
        F.greatest(F.least(length, F.lit(4.0)), F.lit(0.0)),
        _share("n_symbols", symbols + words + 20),
        _share("n_dup_lines", F.col("n_lines") + 5),
        _share("n_repeat_words", words + 20),
    ]
    return [F.floor(s * UNIT).cast("long").alias(f"x{k}") for k, s in enumerate(stats)]


def _key(lang: str, source: str) -> list[Column]:
    none = F.lit("\x00")
    return [F.coalesce(F.col(c).cast("string"), none).alias(a) for c, a in ((lang, "_lang"), (source, "_source"))]


def _grouped(stats: DataFrame) -> DataFrame:
    """(_lang, _source, _group): the group of every language and source."""
    sizes = stats.groupBy("_lang", "_source").agg(F.count_if(~F.col("base_failed")).alias("n"))
    small = F.col("n") < MIN_GROUP
    by_lang = sizes.where(small).groupBy("_lang").agg(F.sum("n").alias("m"))
    own = F.concat(F.lit("s"), "_lang", F.lit("\x01"), "_source")
    pooled = F.when(F.col("m") >= MIN_GROUP, F.concat(F.lit("l"), "_lang")).otherwise(F.lit("a"))
    return sizes.join(by_lang, "_lang", "left").select("_lang", "_source", F.when(small, pooled).otherwise(own).alias("_group"))


_SUMS = [f"s{i}" for i in range(P)] + [f"q{i}{j}" for i, j in _PAIRS]


def _sums() -> list[Column]:
    one = [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)]
    return one + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _PAIRS]


def _fit(sums: DataFrame, keep: list[str]) -> DataFrame:
    """Means and the Cholesky factor of the regularised covariance, from n, sums and products."""
    n = F.col("n").cast("double")
    mean = [(F.col(f"s{i}") / n / UNIT).alias(f"m{i}") for i in range(P)]
    df = sums.select(*keep, *mean, *((F.col(f"q{i}{j}") / n / (UNIT * UNIT)).alias(f"r{i}{j}") for i, j in _PAIRS))
    cov = []
    for i, j in _PAIRS:
        c = (F.col(f"r{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENCY
        cov.append((F.greatest(c, F.lit(0.0)) + FLOOR[i] ** 2 if i == j else c).alias(f"c{i}{j}"))
    return _factor(df.select(*keep, *(f"m{i}" for i in range(P)), *cov), keep)


def _factor(df: DataFrame, keep: list[str]) -> DataFrame:
    means = [f"m{i}" for i in range(P)]
    for j in range(P):
        below = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        # rounding cannot push a pivot below a small part of its floor
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - below, F.lit(FLOOR[j] ** 2 / 4))))
        rest = {}
        for i in range(j + 1, P):
            cross = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            rest[f"l{i}{j}"] = (F.col(f"c{i}{j}") - cross) / F.col(f"l{j}{j}")
        if rest:
            df = df.withColumns(rest)
    volume = sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)).alias("volume")
    return df.select(*keep, *means, *(f"l{i}{j}" for i, j in _PAIRS), volume)


def _distance() -> Column:
    z: list[Column] = []
    for i in range(P):
        off = F.col(f"x{i}") / F.lit(float(UNIT)) - F.col(f"m{i}")
        off = sum((-F.col(f"l{i}{k}") * z[k] for k in range(i)), off)
        z.append(off / F.col(f"l{i}{i}"))
    return sum((v * v for v in z), F.lit(0.0))


def _quantile_start(stats: DataFrame) -> DataFrame:
    """Medians, and quartile spreads on the diagonal."""
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.shiftright(f"x{k}", 3).alias("v")) for k in range(P))))
    counts = stats.select("_group", cells.alias("c")).groupBy("_group", "c.k", "c.v").agg(F.count(F.lit(1)).alias("n"))
    # a statistic has at most 2**11 values of this width: small windows
    order = Window.partitionBy("_group", "k").orderBy("v")
    whole = Window.partitionBy("_group", "k")
    run = counts.select("_group", "k", "v", F.sum("n").over(order).alias("upto"), F.sum("n").over(whole).alias("all"))

    def at(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("v"))) * (8.0 / UNIT)

    marks = run.groupBy("_group", "k").agg(at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("spread"))
    one = marks.groupBy("_group").agg(
        *(F.max(F.when(F.col("k") == i, F.col("mid"))).alias(f"m{i}") for i in range(P)),
        *(
            (F.max(F.when(F.col("k") == i, F.col("spread") * F.col("spread"))) + FLOOR[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}")
            for i, j in _PAIRS
        ),
    )
    return _factor(one.withColumn("start", F.lit(1)), ["_group", "start"])


def estimate(stats: DataFrame) -> DataFrame:
    """One fit for each group of (_group, x0..x3): means, factor, volume; a durable table."""
    every = stats.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), *_sums())
    first = _fit(every.withColumn("start", F.lit(0)), ["_group", "start"])
    fit = durable(first.union(_quantile_start(stats).select(*first.columns)), "quality-start")
    last = None
    for _ in range(STEPS):
        # 16 bins an octave; what lies beyond the last bin is never near
        place = F.least(F.floor(F.log2(_distance() * 64 + 1) * 16), F.lit(512)).cast("int")
        near = stats.join(fit, "_group").withColumn("bin", place)
        bins = near.groupBy("_group", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *_sums())
        order = Window.partitionBy("_group", "start").orderBy("bin")
        whole = Window.partitionBy("_group", "start")
        run = bins.select("*", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("all"))
        inside = run.where(F.col("before") < F.col("all") * HALF)
        sums = inside.groupBy("_group", "start").agg(*(F.sum(c).alias(c) for c in ["n", *_SUMS]))
        fit = durable(_fit(sums, ["_group", "start"]), "quality-fit")
        volume = fit.agg(F.sum(F.round("volume", 9)).cast("decimal(38,9)")).first()[0]
        if volume == last:
            break
        last = volume
    best = Window.partitionBy("_group").orderBy("volume", "start")
    return durable(fit.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "start"), "quality-best")


def _judged(
    docs: DataFrame, text_col: str, lang_col: str, source_col: str, carry: list[str] | None
) -> DataFrame:
    """c0, c1, ... for the documents' columns (those of `carry`), then COUNTS, base_failed, distance, kept."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    out = names if carry is None else [of[c] for c in carry]
    text = of[text_col]
    df = docs.toDF(*names)
    df = df.select(*dict.fromkeys([*out, text]), *_key(of[lang_col], of[source_col]))
    stats = with_counts(df, text).select(*out, "_lang", "_source", *COUNTS, "n_lines", "base_failed", *_vector())
    stats = durable(stats, "quality-statistics")
    group = durable(_grouped(stats), "quality-groups")
    judged = stats.where(~F.col("base_failed")).select("_lang", "_source", *(f"x{k}" for k in range(P)))
    fit = estimate(judged.join(group, ["_lang", "_source"]))
    by_key = durable(group.join(fit, "_group", "left"), "quality-estimates")
    seen = stats.join(by_key, ["_lang", "_source"], "left").withColumn("_d", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("_d") <= LIMIT, F.lit(True))
    distance = F.when(~F.col("base_failed"), F.col("_d"))
    return seen.select(*out, *COUNTS, "base_failed", distance.alias("distance"), kept.alias("kept"))


def judge(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    carry: list[str] | None = None,
) -> DataFrame:
    """The documents' columns, then COUNTS, base_failed, distance and kept (the last eight).

    The columns are written beside the counts, so texts are read and counted once; they are never
    shuffled unless the table of estimates is too large for Spark to broadcast. Who needs only some
    columns names them in `carry`.
    """
    found = _judged(docs, text_col, lang_col, source_col, carry)
    return found.toDF(*(docs.columns if carry is None else carry), *COUNTS, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents' columns, rejected rows left out."""
    found = _judged(docs, text_col, lang_col, source_col, None).where("kept")
    return found.select(*(F.col(f"c{k}").alias(name) for k, name in enumerate(docs.columns)))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = judge(docs, carry=["doc_id"])
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "distance")
