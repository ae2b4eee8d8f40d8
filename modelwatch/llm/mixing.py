"""Mixing sources to target weights by hierarchical budgeting (operator 7).

Weights sit on the nodes of a tree (domain, language, source). The token budget runs down from the root: siblings share their
parent's budget by weight; one that holds fewer tokens than its share (times the allowed epochs) gets what it
holds, and its siblings take up the rest; only when all of them are full does the rest go to their parent's
siblings. This is water filling level by level with the capacities of whole subtrees, in integers.

A leaf's tokens are read in epochs. Each epoch is an order of its documents seeded by epoch and document; a budget of
more than one epoch takes every document once for each whole epoch, and of the last one the prefix
of documents that fits: the running sum of tokens stays within what is left.

Results for odd input: null levels are a node of their own (named ``~``), and level values may hold any characters (``node_name``); null texts and texts without words hold 0 tokens
and come along whenever their epoch's order reaches them within the budget; equal ids are ordered by text; repeated rows of a leaf are
taken or left one by one; an empty table or a budget of 0 gives an empty selection; nodes without a weight weigh 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import table

LEVELS = ["domain", "lang", "source"]
BIG = "decimal(38,0)"
#: Order slots of a leaf: the running sum is taken over slots first and within one slot then.
SLOT_DIGITS = 3


def tokens(text: str = "text") -> Column:
    """Words of the whole text."""
    return F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def node_name(value: Column) -> Column:
    """A level's value as a part of a path: ``%`` and ``/`` are written %25 and %2F, a lone ``~`` %7E, null is ``~``."""
    safe = F.replace(F.replace(value, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    return F.when(value == "~", "%7E").otherwise(F.coalesce(safe, F.lit("~")))


def water_fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``grant`` to ``nodes`` (parent..., name, weight, capacity, budget of the parent).

    In the order of capacity per weight a child is full if its capacity stays within its share of what the
    children before it leave; the children after the full ones share the rest by weight, rounded down.
    """
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("capacity").cast("double") / F.col("weight"), name)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    zero = F.lit(0).cast(BIG)
    ranked = (nodes.withColumn("used", F.coalesce(F.sum("capacity").over(earlier), zero).cast(BIG))
              .withColumn("open", F.sum("weight").over(later).cast(BIG)))
    ranked = ranked.withColumn("full", F.col("capacity").cast(BIG) * F.col("open") <= F.col("weight").cast(BIG) * (F.col("budget").cast(BIG) - F.col("used")))
    rest = F.col("budget").cast(BIG) - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(by), zero).cast(BIG)
    free = F.sum(F.when(~F.col("full"), F.col("weight"))).over(by).cast(BIG)
    share = F.floor(F.col("weight").cast(BIG) * rest / free)
    return ranked.withColumn("grant", F.when(F.col("full"), F.col("capacity")).otherwise(F.least(share, F.col("capacity").cast(BIG))).cast("long")).drop("used", "open", "full")


def budgets(leaves: DataFrame, levels: list[str], budget: int, epochs: int, weights: DataFrame | None = None) -> DataFrame:
    """``leaves`` (levels..., available) plus the tokens granted to each (``grant``).

    ``weights``: (node, weight) with the path of a node, its ``node_name``s joined by ``/``, positive integers.
    """
    path = lambda depth: F.concat_ws("/", *[F.col(f"`{c}`") for c in levels[:depth]])
    granted = leaves.select(F.lit("").alias("up"), F.lit(budget).cast("long").alias("budget")).distinct()
    for depth in range(1, len(levels) + 1):
        up = F.lit("") if depth == 1 else path(depth - 1)
        nodes = leaves.groupBy(up.alias("up"), path(depth).alias("node")).agg((F.sum("available") * epochs).alias("capacity"))
        if weights is None:
            nodes = nodes.withColumn("weight", F.lit(1).cast("long"))
        else:
            nodes = nodes.join(weights.select("node", F.col("weight").cast("long").alias("weight")), "node", "left").withColumn("weight", F.coalesce("weight", F.lit(1).cast("long")))
        nodes = nodes.join(granted, "up")
        granted = stored(water_fill(nodes, ["up"], "node").select(F.col("node").alias("up"), F.col("grant").alias("budget")), "grants")
    return leaves.withColumn("node", path(len(levels))).join(granted.select(F.col("up").alias("node"), F.col("budget").alias("grant")), "node")


def order_key(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("~"))))


def selection(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """``rows`` (leaf, key, n_tokens, text_key, ...) plus ``copies``, how often each is taken.

    The prefix of the last epoch: token sums of the leaf's order slots give each slot its start, then only the rows
    of a slot are sorted. No task sees a whole leaf.
    """
    whole = F.when(F.col("available") > 0, F.floor(F.col("grant") / F.col("available"))).otherwise(F.lit(0)).cast("long")
    plan = leaves.select("leaf", whole.alias("whole"), (F.col("grant") - whole * F.col("available")).alias("rest"))
    placed = rows.join(plan, "leaf").withColumn("place", order_key(seed, F.col("whole"), F.col("key")))
    placed = placed.withColumn("slot", F.substring("place", 1, SLOT_DIGITS))
    slots = placed.groupBy("leaf", "slot").agg(F.sum("n_tokens").alias("in_slot"))
    by_slot = Window.partitionBy("leaf").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select(F.col("leaf").alias("l"), F.col("slot").alias("s"), F.coalesce(F.sum("in_slot").over(by_slot), F.lit(0)).alias("before"))
    inner = Window.partitionBy("leaf", "slot").orderBy("place", F.col("key").asc_nulls_first(), "text_key").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("running", F.sum("n_tokens").over(inner))
    met = summed.join(starts, (summed["leaf"] == starts["l"]) & (summed["slot"] == starts["s"])).drop("l", "s")
    fits = (F.col("rest") > 0) & (F.col("before") + F.col("running") <= F.col("rest"))
    return met.withColumn("copies", F.col("whole") + fits.cast("long")).drop("whole", "rest", "place", "slot", "running", "before")


def mixed(rows: DataFrame, levels: list[str], budget_share: tuple[int, int], epochs: int, seed: int,
          weights: DataFrame | None = None) -> DataFrame:
    """``rows`` (levels..., key, text_key, n_tokens) plus leaf and copies, for a budget of a part (numerator, denominator) of all tokens."""
    clean = rows.withColumns({c: node_name(F.col(f"`{c}`").cast("string")) for c in levels})
    clean = clean.withColumn("leaf", F.concat_ws("/", *levels))
    leaves = stored(clean.groupBy("leaf", *levels).agg(F.sum("n_tokens").alias("available")), "leaves")
    total = leaves.agg(F.sum("available")).first()[0] or 0
    granted = stored(budgets(leaves, levels, total * budget_share[0] // budget_share[1], epochs, weights), "budgets")
    return selection(clean, granted, seed)


def domain() -> Column:
    """The test tables name no domain: the main crawl source is one, curated sources are the other."""
    return F.when(F.col("source") == "src0", "web").otherwise("curated")


WEIGHTS = [("web", 2), ("curated", 3), ("web/en", 2), ("curated/en", 2)]
SEED, EPOCHS, SHARE = 17, 2, (1, 2)


def weights_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "node string, weight long")


def oracle_sql() -> str:
    """The selection of ``op7_mix_sources`` as SQL: the fill level by level, then one running sum over each leaf."""
    paths = [" || '/' || ".join(LEVELS[:d]) for d in range(1, len(LEVELS) + 1)]
    weights = ", ".join(f"('{node}', {w})" for node, w in WEIGHTS)
    steps = []
    for depth, path in enumerate(paths, 1):
        up = "''" if depth == 1 else paths[depth - 2]
        steps.append(f"""n{depth} as (select {up} as up, {path} as node, sum(available)::hugeint * {EPOCHS} as capacity from leaves group by all),
  w{depth} as (select n.*, coalesce(w.weight, 1)::hugeint as weight, g.budget from n{depth} n join g{depth - 1} g using (up) left join weights w on w.node = n.node),
  r{depth} as (select *, coalesce(sum(capacity) over (partition by up order by capacity::double / weight, node rows between unbounded preceding and 1 preceding), 0) as used,
    sum(weight) over (partition by up order by capacity::double / weight, node rows between current row and unbounded following) as open from w{depth}),
  f{depth} as (select *, capacity * open <= weight * (budget - used) as filled from r{depth}),
  s{depth} as (select *, budget - coalesce(sum(capacity) filter (where filled) over (partition by up), 0) as rest,
    sum(weight) filter (where not filled) over (partition by up) as free from f{depth}),
  g{depth} as (select node as up, case when filled then capacity else least(weight * rest // free, capacity) end as budget from s{depth})""")
    name = lambda c: f"case when {c} = '~' then '%7E' else coalesce(replace(replace({c}, '%', '%25'), '/', '%2F'), '~') end as {c}"
    return f"""with docs as (select doc_id, case when source = 'src0' then 'web' else 'curated' end as domain, {name('lang')},
    {name('source')}, md5(coalesce(text, '')) as text_key,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from documents),
  leaves as (select {", ".join(LEVELS)}, sum(n_tokens) as available from docs group by all),
  weights as (select * from (values {weights}) t(node, weight)),
  g0 as (select '' as up, (sum(available) * {SHARE[0]} // {SHARE[1]})::hugeint as budget from leaves),
  {", ".join(steps)},
  plan as (select {paths[-1]} as leaf, case when available > 0 then budget // available else 0 end as whole, available, budget
    from leaves join g{len(LEVELS)} on up = {paths[-1]}),
  placed as (select d.*, leaf, whole, budget - whole * available as rest,
    md5('{SEED}:' || whole::varchar || ':' || coalesce(doc_id::varchar, '~')) as place from docs d join plan on leaf = {paths[-1]}),
  summed as (select *, sum(n_tokens) over (partition by leaf order by place, doc_id nulls first, text_key rows unbounded preceding) as running from placed)
select doc_id, leaf, n_tokens, (whole + (rest > 0 and running <= rest)::int)::bigint as copies from summed
where whole + (rest > 0 and running <= rest)::int > 0"""


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(domain().alias("domain"), "lang", "source", F.col("doc_id").alias("key"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), tokens().alias("n_tokens"))
    out = mixed(rows, LEVELS, SHARE, EPOCHS, SEED, weights_frame(spark))
    return out.where("copies > 0").select(F.col("key").alias("doc_id"), "leaf", "n_tokens", "copies")
