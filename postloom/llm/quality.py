"""Quality classifier: interpolated modified Kneser-Ney perplexity with language-specific thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.chat import numbered
from postloom.llm.common import bounded, cut
from postloom.llm.ngrams import context, explode, score, suffix

#: Bytes of an n-gram, of 256 values each.
ORDER = 5
#: Trusted rows (an id and a flag) that are sent to all documents; more are joined by a shuffle.
MOST_SENT = 1 << 20
#: Held-out rows that the quantile pooled over languages counts for in a language's threshold.
POOLED_ROWS = 40


def discounts(counts: DataFrame) -> dict[int, list[float]]:
    """D1, D2 and D3+ of each order from its counts of counts (four numbers an order)."""
    seen = counts.where("c <= 4").groupBy("k", "c").agg(F.count("*").alias("n")).collect()  # 4 rows an order
    by = {(r["k"], r["c"]): r["n"] for r in seen}
    out = {}
    for k in {r["k"] for r in seen}:
        n = [by.get((k, c), 0) for c in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        out[k] = [min(max((c - (c + 1) * y * n[c] / n[c - 1]) if n[c - 1] else 0.5 * c, 0.05 * c), 0.95 * c) for c in (1, 2, 3)]
    return out


def kneser_ney(train: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, logp): natural log probability of the last byte of each asked n-gram given the others.

    ``train`` has distinct n-grams of the order and their counts (gram, c).  Lower
    orders count distinct left extensions.  Counts, contexts and probabilities are
    tables hashed by n-gram and joined order by order; lower-order probabilities
    are interpolated, down to the uniform one of 256 bytes, so none is zero.  The
    probabilities of each lower order are written before the next order is planned.
    """
    levels = {order: train.where("c > 0").select("gram", "c")}
    for k in range(order - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy(suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("c"))
    counts = None
    for k, x in levels.items():
        x = x.withColumn("k", F.lit(k))
        counts = x if counts is None else counts.unionByName(x)
    counts = cut(counts)
    d = discounts(counts)
    c = F.col("c")
    below, k_below = None, 0
    for k in range(1, order + 1):
        d1, d2, d3 = d.get(k, [0.5, 1.0, 1.5])
        off = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        level = counts.where(F.col("k") == k)
        heads = level.groupBy(context(F.col("gram")).alias("h")).agg(F.sum("c").alias("total"), F.sum(off).alias("freed"))
        want = asked.select(suffix(F.col("gram"), k).alias("gram")).distinct()
        got = want.join(level.select("gram", (c - off).alias("kept")), "gram", "left").withColumn("h", context(F.col("gram")))
        got = got.join(heads, "h", "left")
        if below is None:
            lower = F.lit(1.0 / 256)
        else:
            got = got.withColumn("low", suffix(F.col("gram"), k_below)).join(below, "low")
            lower = F.col("p_low")
        p = F.when(F.col("total").isNull(), lower).otherwise((F.coalesce("kept", F.lit(0.0)) + F.col("freed") * lower) / F.col("total"))
        got = got.select("gram", p.alias("p"))
        if k < order:  # a plan of one order's joins at a time: the driver holds a plan anew for each of its stages
            below, k_below = cut(got.select(F.col("gram").alias("low"), F.col("p").alias("p_low"))), k
    return got.select("gram", F.log("p").alias("logp"))


def trusted_sample(labels: DataFrame, docs: DataFrame, rows: int | None = None, seed: int = 5) -> DataFrame:
    """(label_id, fit): all trusted rows, or in a seeded order at most ``rows`` a language; even ones fit the model, odd ones the thresholds.

    ``docs`` has doc_id and lang.  With ``rows`` each task sends at most so many of a language on.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    key = F.xxhash64(F.lit(seed), "doc_id")
    found = docs.select("doc_id", "lang").join(good, "doc_id").distinct()
    if rows is None:
        return found.select(F.col("doc_id").alias("label_id"), (F.pmod(key, F.lit(2)) == 0).alias("fit")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(key, "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= rows).select(F.col("doc_id").alias("label_id"), (F.pmod(key, F.lit(2)) == 0).alias("fit")).distinct()


def percentiles(rows: DataFrame, group: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """(group, n, a column for each quantile): exact percentiles of groups of any size, by their places in a range sort."""
    n = cut(rows.groupBy(group).agg(F.count(value).alias("n")))
    placed = numbered(rows.select(group, value), group, value, name="place").join(bounded(n, MOST_SENT), group)
    at = {name: (F.col("n") - 1) * q for name, q in quantiles.items()}
    value_at = lambda place: F.max(F.when(F.col("place") == place, F.col(value)))
    ends = [c for name, x in at.items() for c in (value_at(F.floor(x)).alias(f"{name}_low"), value_at(F.ceil(x)).alias(f"{name}_high"), F.max(x - F.floor(x)).alias(f"{name}_part"))]
    between = lambda name: F.col(f"{name}_low") + F.col(f"{name}_part") * (F.col(f"{name}_high") - F.col(f"{name}_low"))
    return placed.groupBy(group).agg(F.max("n").alias("n"), *ends).select(group, "n", *(between(name).alias(name) for name in quantiles))


def thresholds(held: DataFrame, quantile: float, rows: int | None = None, seed: int = 5, pooled: int = POOLED_ROWS) -> DataFrame:
    """(lang, t, t_all): each language's threshold from the perplexities of its held-out trusted rows (doc_id, lang, perplexity).

    The language's own quantile, drawn towards its median times the quantile of
    perplexity over median of all languages by the weight of ``pooled`` rows: many
    rows decide alone, and few are not taken for a whole distribution.  ``t_all`` is
    the quantile of all languages, for those without any row.  Percentiles are exact,
    so that reruns agree, over all rows, or at most ``rows`` a language.
    """
    held = held.select("doc_id", "lang", "perplexity")
    if rows is not None:
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "doc_id", "perplexity"), "doc_id", "perplexity"))
        held = held.withColumn("rank", rank).where(F.col("rank") <= rows)
    held = cut(held)
    own = cut(percentiles(held, "lang", "perplexity", {"q": quantile, "mid": 0.5}).withColumnRenamed("n", "m"))
    ratio = held.join(bounded(own.select("lang", "mid"), MOST_SENT), "lang").select(F.lit("wide").alias("kind"), (F.col("perplexity") / F.col("mid")).alias("x"))
    both = percentiles(ratio.unionByName(held.select(F.lit("t_all").alias("kind"), F.col("perplexity").alias("x"))), "kind", "x", {"x": quantile})
    spread = both.agg(*(F.max(F.when(F.col("kind") == name, F.col("x"))).alias(name) for name in ("wide", "t_all")))
    t = (F.col("m") * F.col("q") + pooled * F.col("mid") * F.col("wide")) / (F.col("m") + pooled)
    return own.join(F.broadcast(spread), F.lit(True)).select("lang", t.alias("t"), "t_all")  # one row


def score_quality(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = 0.995, slack: float = 1.05, fit_rows: int | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: str | None = None) -> DataFrame:
    """Perplexity of every document under a model of trusted text: doc_id, lang, n_grams, perplexity, threshold, accepted.

    With ``keep``, that column goes along as well.

    A byte n-gram model is trained on half of all trusted labelled rows (with ``fit_rows``
    at most so many a language); the other half gives, per language, the ``quantile`` of perplexity
    (see ``thresholds``), and ``slack`` times it is the threshold.  Every document is scored whole: its
    n-grams are exploded (packed by batch), joined to the probability table by
    n-gram and summed; the most frequent ones are looked up in a bounded table.

    Null and empty texts have no n-grams, null perplexity and are rejected.  A null
    language counts as ''.  A language without held-out trusted rows takes the quantile of
    all languages.  Repeated rows are scored each; without any trusted row all
    non-empty documents are accepted.  Other columns are not read.  An empty table
    gives none.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), *([F.col(keep).alias("kept_key")] if keep else []))
    sample = cut(trusted_sample(labels, named, fit_rows))
    sample = bounded(sample, MOST_SENT)
    flagged = named.join(sample, F.col("doc_id") == F.col("label_id"), "left")
    carried = ("doc_id", "lang", *(["kept_key"] if keep else []))
    counted = explode(flagged.withColumn("trust", F.coalesce("fit", F.lit(False))), order, carried, trusted="trust")
    grams = cut(counted.where("gram >= 0").groupBy("gram").agg(F.sum("trusted").alias("c"), F.sum("n").alias("n")))
    weights = cut(kneser_ney(grams, grams, order).withColumnRenamed("logp", "weight").join(grams.select("gram", "n"), "gram"))
    scored = cut(score(named, order, weights, carried))
    scored = scored.withColumn("perplexity", F.when(F.col("n") > 0, F.exp(-F.col("total") / F.col("n"))))
    held = scored.where("perplexity is not null").join(sample.where("not fit"), F.col("doc_id") == F.col("label_id"))
    limits = bounded(cut(thresholds(held, quantile, fit_rows)), MOST_SENT)
    out = scored.join(limits, "lang", "left")
    if out.where("t_all is null").limit(1).count():  # languages without trusted rows
        whole = limits.agg(F.max("t_all").alias("t_any"))
        out = out.join(F.broadcast(whole), F.lit(True), "left").withColumn("t_all", F.coalesce("t_all", "t_any"))
    out = out.withColumn("threshold", F.coalesce("t", "t_all") * slack)
    accepted = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", F.col("n").alias("n_grams"), "perplexity", "threshold", accepted.alias("accepted"), *([F.col("kept_key").alias(keep)] if keep else []))
