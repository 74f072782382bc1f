"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources carries integer weights. The token budget
runs down the tree: children share their parent's budget by weight, a child takes no
more than it holds (its tokens times ``max_epochs``), and what it cannot take goes to
its siblings by their weights. Only what a whole subtree cannot take reaches the
siblings of its ancestors. All of it is exact integer arithmetic in windows over the
tree, whose size is that of the configuration and not of the corpus.

A leaf reads its documents in epochs, each in the order of a seeded hash. It takes
whole epochs while they fit and then the shortest prefix of the next that reaches its
budget. To find where the prefix ends, documents are summed by a prefix of the hash
first, so only the documents of one small slice per leaf are ever ordered, however
many a leaf holds. Selection is then a filter by hash; texts are not shuffled.

Tokens are runs of characters other than white space. Everything is DataFrame code.

Defined results: a null text has no tokens. A null language is ``und``, a null source
``none``. Leaves without weight or tokens give nothing. Rows that repeat an id share
their place in every order: all of them are taken or none. Ties of weight and size go
by name. An empty table gives an empty table. Other columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from growthlens.llm.common import WORD, attach_small, written

LEAF = ["domain", "lang", "source"]
SLICE_ROWS = 4_096  # documents of a leaf that are ordered together, on average


@dataclass(frozen=True)
class Targets:
    """Integer weights by name (``None``: any other name), and how much to take."""

    domain: dict[str | None, int]
    lang: dict[str | None, int]
    source: dict[str | None, int] = field(default_factory=lambda: {None: 1})
    numerator: int = 1  # budget as a fraction of the tokens there are
    denominator: int = 2
    max_epochs: int = 2
    seed: str = "mix-1"


#: Target weights of the registered query.
TARGETS = Targets(
    domain={"web": 60, "forum": 25, "reference": 15, None: 5},
    lang={"en": 50, "de": 20, "fr": 15, "es": 15, None: 5},
    source={"src0": 3, None: 1},
)


def domain_of(source: str = "source") -> Column:
    """Domain of a source by its number: the registered query's rule."""
    number = F.expr(f"try_cast(regexp_extract({source}, '^src([0-9]{{1,9}})$', 1) as bigint)")
    return F.when(number < 7, "web").when(number < 14, "forum").when(number < 20, "reference").otherwise("other")


def _weight(column: str, weights: dict[str | None, int]) -> Column:
    out = F.lit(weights.get(None, 0))
    for name, weight in weights.items():
        if name is not None:
            out = F.when(F.col(column) == name, weight).otherwise(out)
    return out.cast("long")


def leaf_rows(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens`` per document."""
    return docs.select(
        "doc_id",
        (domain_of() if domain is None else domain).alias("domain"),
        F.coalesce("lang", F.lit("und")).alias("lang"),
        F.coalesce("source", F.lit("none")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )


def allocate(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Split each parent's ``budget`` over its children by ``weight``, none above its ``cap``; adds ``share``.

    Children are ordered by cap per weight. Those that cannot take their part form a
    prefix of that order and take their cap; the others divide the rest, rounded so
    that the parts add up.
    """
    ratio = F.col("cap").cast("double") / F.col("weight")
    order = Window.partitionBy(*parents).orderBy(ratio, name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    group = Window.partitionBy(*parents)
    big = "decimal(38,0)"
    out = children.withColumns(
        {
            "_left": F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "_weights": F.sum("weight").over(after),
        }
    )
    is_open = F.col("cap").cast("decimal(19,0)") * F.col("_weights").cast("decimal(18,0)") > F.col("_left").cast("decimal(19,0)") * F.col("weight").cast("decimal(18,0)")
    out = out.withColumn("_open", is_open)
    first = out.withColumns(
        {
            "_any": F.max("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "_rest": F.max(F.when(F.col("_open"), F.col("_left"))).over(group),
            "_all": F.max(F.when(F.col("_open"), F.col("_weights"))).over(group),
        }
    )
    done = f"(_all - _weights)"
    part = F.expr(
        f"(cast(_rest as {big}) * cast({done} + weight as decimal(18,0))) div cast(_all as {big})"
        f" - (cast(_rest as {big}) * cast({done} as decimal(18,0))) div cast(_all as {big})"
    )
    share = F.when(F.col("_any"), part).otherwise(F.col("cap"))
    return first.withColumn("share", share.cast("long")).drop("_left", "_weights", "_open", "_any", "_rest", "_all")


def budgets(rows: DataFrame, targets: Targets) -> DataFrame:
    """``domain, lang, source, tokens, documents, budget`` of every leaf that may be taken from."""
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    leaves = leaves.withColumns(
        {"w_domain": _weight("domain", targets.domain), "w_lang": _weight("lang", targets.lang), "w_source": _weight("source", targets.source)}
    )
    usable = (F.col("tokens") > 0) & (F.least("w_domain", "w_lang", "w_source") > 0)
    total = Window.partitionBy(F.lit(0))
    leaves = leaves.withColumn("all_tokens", F.sum("tokens").over(total)).filter(usable)
    leaves = written(leaves.withColumn("cap", F.col("tokens") * targets.max_epochs), "leaves")

    budget = F.expr(f"cast((cast(max(all_tokens) as decimal(38,0)) * {targets.numerator}) div {targets.denominator} as bigint)")
    domains = leaves.groupBy("domain").agg(F.max("w_domain").alias("weight"), F.sum("cap").alias("cap"), budget.alias("wanted"))
    domains = domains.withColumn("budget", F.least(F.max("wanted").over(total), F.sum("cap").over(total))).withColumn("root", F.lit(0))
    domains = allocate(domains, ["root"], "domain").select("domain", F.col("share").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.max("w_lang").alias("weight"), F.sum("cap").alias("cap")).join(domains, "domain")
    langs = allocate(langs, ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    sources = leaves.withColumn("weight", F.col("w_source")).join(langs, ["domain", "lang"])
    sources = allocate(sources, ["domain", "lang"], "source")
    return sources.select(*LEAF, "tokens", "documents", F.col("share").alias("budget"))


def order_key(targets: Targets, epoch: str = "epochs") -> Column:
    """Place of a document in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(targets.seed), F.col(epoch).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def plan(rows: DataFrame, targets: Targets) -> DataFrame:
    """Per leaf: whole ``epochs``, and ``cut``, the last key of the next epoch's prefix (null: none) with the tokens ``before`` it.

    ``rows`` is read twice and should be a written table.
    """
    leaves = budgets(rows, targets).withColumn("epochs", F.expr("budget div tokens"))
    leaves = leaves.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    digits = F.greatest(F.lit(1), F.ceil(F.log(F.col("documents") / SLICE_ROWS) / F.log(F.lit(16.0))))
    leaves = written(leaves.withColumn("digits", digits.cast("int")), "leaf_budgets")
    open_leaves = leaves.filter("rest > 0").select(*LEAF, "epochs", "rest", "digits")

    keyed = attach_small(rows, open_leaves, LEAF, 256, "inner").withColumn("key", order_key(targets))
    keyed = keyed.withColumn("slice", F.substring("key", F.lit(1), F.col("digits")))
    slices = keyed.groupBy(*LEAF, "rest", "slice").agg(F.sum("n_tokens").alias("held"))
    running = Window.partitionBy(*LEAF).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("below", F.coalesce(F.sum("held").over(running), F.lit(0)))
    last = written(slices.filter("below < rest and below + held >= rest").select(*LEAF, "slice", "below"), "last_slices")

    inside = attach_small(keyed, last, [*LEAF, "slice"], 256, "inner")
    inside = inside.groupBy(*LEAF, "rest", "below", "key").agg(F.sum("n_tokens").alias("held"))
    inside = inside.withColumn("before", F.col("below") + F.coalesce(F.sum("held").over(Window.partitionBy(*LEAF).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cuts = inside.filter("before < rest").groupBy(*LEAF).agg(F.max("key").alias("cut"), F.max("before").alias("before"))
    return written(leaves.join(cuts, LEAF, "left").drop("digits"), "plan")


def _chosen(rows: DataFrame, leaves: DataFrame, targets: Targets) -> DataFrame:
    placed = attach_small(rows, leaves, LEAF, 320, "inner").withColumn("key", order_key(targets))
    in_prefix = F.coalesce(F.col("key") <= F.col("cut"), F.lit(False))
    return placed.withColumn("copies", F.col("epochs") + in_prefix.cast("long")).filter("copies > 0")


def mix(docs: DataFrame, targets: Targets = TARGETS, domain: Column | None = None) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, copies, tokens_taken`` of every selected document.

    ``copies`` is in how many epochs it is read; ``tokens_taken`` counts them all, the last
    document of a prefix only as far as the budget reaches.
    """
    rows = written(leaf_rows(docs, domain), "leaf_rows")
    chosen = _chosen(rows, plan(rows, targets), targets)
    last = F.when(F.col("key") == F.col("cut"), F.least("n_tokens", F.col("rest") - F.col("before")))
    last = last.when(F.col("key") < F.col("cut"), F.col("n_tokens")).otherwise(0)
    return chosen.select("doc_id", *LEAF, "n_tokens", "copies", (F.col("epochs") * F.col("n_tokens") + last).alias("tokens_taken"))


def keep_mixed(docs: DataFrame, targets: Targets = TARGETS, domain: Column | None = None) -> DataFrame:
    """The selected rows of ``docs`` with all their columns, a row once per epoch that reads it.

    The leaves' cuts are attached to the documents where they lie; texts are not shuffled
    as long as the leaves fit into a broadcast.
    """
    rows = written(leaf_rows(docs, domain), "leaf_rows")
    cuts = plan(rows, targets).select(*[F.col(c).alias(f"_{c}") for c in (*LEAF, "epochs", "cut")])
    placed = docs.withColumns(
        {
            "_domain": domain_of() if domain is None else domain,
            "_lang": F.coalesce("lang", F.lit("und")),
            "_source": F.coalesce("source", F.lit("none")),
        }
    )
    placed = attach_small(placed, cuts, ["_domain", "_lang", "_source"], 320, "inner")
    in_prefix = F.coalesce(order_key(targets, "_epochs") <= F.col("_cut"), F.lit(False))
    copies = (F.col("_epochs") + in_prefix.cast("long")).cast("int")
    repeated = placed.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))))
    return repeated.select(*docs.columns)
