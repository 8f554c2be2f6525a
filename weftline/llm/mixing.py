"""Mixing sources to target weights by hierarchical budgeting; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import Guarded, checkpointed, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Leaves up to which their plan is sent to every task; beyond it the documents are joined by shuffle.
SENT_LEAVES = 100_000


@dataclass(frozen=True)
class Settings:
    weights: dict[str, dict[str, int]] = field(
        default_factory=lambda: {
            "domain": {"web": 5, "reference": 3, "forum": 2},
            "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
            "source": {},
        }
    )  #: for each level of the tree, whole weights by name; 1 for any other name, 0 leaves a subtree out
    percent: int = 80  #: tokens to select, as a percentage of those that there are
    epochs: int = 3  #: passes over a leaf at most
    seed: int = 17


LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The domain of a source, by the last character of its name; a rule that stands for a table of sources."""
    return F.element_at(F.array(F.lit("web"), F.lit("reference"), F.lit("forum")), F.ascii(F.right(source, F.lit(1))) % 3 + 1)


def with_tree(docs: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` with the names of their branch in ``_domain, _lang, _source``; null names are ``unknown``."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return docs.withColumns({"_domain": domain_of(named(source)), "_lang": named(lang), "_source": named(source)})


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _wide(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def share(children: DataFrame, path: list[str], name: str) -> DataFrame:
    """Split ``budget`` among the children of each ``path`` by ``weight``, none getting more than ``cap``.

    Water filling: what a child can't take goes to its siblings by weight.  Children are ordered by
    how soon they are full; those that fill up are the first ones, and the others share the rest.
    Tokens lost to rounding go one each to the first of the others by name.  Adds ``target``.
    """
    group = [F.col(p) for p in path] or [F.lit(0)]
    order = [F.col("cap") / F.col("weight"), F.col(name)]
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*group).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*group)
    full = _wide(F.col("cap")) * _wide(F.col("_w")) <= _wide(F.col("budget") - F.col("_c")) * _wide(F.col("weight"))
    rows = children.withColumns({"_c": F.coalesce(F.sum("cap").over(before), F.lit(0)), "_w": F.sum("weight").over(onward)})
    rows = rows.withColumn("_full", full)
    rows = rows.withColumns(
        {
            "_left": F.col("budget") - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(whole),
            "_open": F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(whole),
        }
    )
    part = F.expr("CAST(CAST(_left AS DECIMAL(19,0)) * CAST(weight AS DECIMAL(19,0)) DIV CAST(greatest(_open, 1) AS DECIMAL(19,0)) AS BIGINT)")
    rows = rows.withColumn("_part", F.when(F.col("_full"), F.col("cap")).otherwise(part))
    odd = F.col("_left") - F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_part"))).over(whole)
    rank = F.row_number().over(Window.partitionBy(*group, "_full").orderBy(name))
    target = F.col("_part") + F.when(~F.col("_full") & (rank <= F.col("_odd")), 1).otherwise(0)
    return rows.withColumn("_odd", odd).withColumn("target", target).drop("_c", "_w", "_full", "_left", "_open", "_part", "_odd")


def allocate(leaves: DataFrame, settings: Settings) -> DataFrame:
    """``(_domain, _lang, _source, tokens, target)`` for each leaf, from its ``tokens``.

    Weights go down the tree.  A node gets no more than the leaves below it can give in
    ``epochs`` passes, so a shortage is made up by siblings first and goes to the level
    above only when all of them are full.
    """
    columns = [f"_{v}" for v in LEVELS]
    nodes = leaves.withColumn("cap", F.col("tokens") * settings.epochs)
    for level in LEVELS:
        named = settings.weights.get(level, {})
        weight = F.lit(1)
        for name, w in named.items():
            weight = F.when(F.col(f"_{level}") == name, w).otherwise(weight)
        nodes = nodes.withColumn(f"_w_{level}", weight.cast("long"))
    nodes = checkpointed(nodes.where(" AND ".join(f"_w_{v} > 0" for v in LEVELS)))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    above = None
    for depth, level in enumerate(LEVELS):
        path, here = columns[:depth], columns[: depth + 1]
        children = nodes.groupBy(*here).agg(F.sum("cap").alias("cap"), F.min(f"_w_{level}").alias("weight"), F.sum("tokens").alias("tokens"))
        if above is None:
            room = F.sum("cap").over(Window.partitionBy(F.lit(0)))
            children = children.withColumn("budget", F.least(F.lit(total * settings.percent // 100), room))
        else:
            children = children.join(above.select(*path, F.col("target").alias("budget")), path)
        above = checkpointed(share(children, path, columns[depth]))
    return above.select(*columns, "tokens", "target")


def _order(seed: int, doc_id: str = "doc_id") -> Column:
    """Where a document stands in its leaf's partial epoch, the one after the ``full`` ones."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def _with_leaf(rows: DataFrame, leaves: DataFrame, n: int) -> DataFrame:
    return rows.join(F.broadcast(leaves) if n <= SENT_LEAVES else leaves, [f"_{v}" for v in LEVELS])


def plan(slim: DataFrame, settings: Settings) -> tuple[DataFrame, int]:
    """What to take from each leaf: ``full`` epochs of all its documents, then those with order ``<= last``.

    ``slim`` holds ``doc_id``, the names and ``n_tokens``.  The documents of the last, partial epoch are the
    longest run, by that epoch's seeded order, within what is left of the leaf's target.  Where
    it ends is found without sorting a leaf: token sums by the first two and then by the next
    two digits of the order narrow it down to a 65,536th of the leaf, which alone is sorted.
    """
    columns = [f"_{v}" for v in LEVELS]
    slim = slim.where("n_tokens > 0")
    found = allocate(slim.groupBy(*columns).agg(F.sum("n_tokens").alias("tokens")), settings)
    leaves = checkpointed(found.withColumns({"full": F.expr("target DIV tokens"), "left": F.expr("target % tokens"), "head": F.lit("")}))
    n = leaves.count()
    for width in (2, 4):
        rows = _with_leaf(slim, leaves.where("left > 0").select(*columns, "full", "left", "head"), n)
        rows = rows.withColumn("o", _order(settings.seed)).where(F.col("o").startswith(F.col("head")))
        sums = rows.groupBy(*columns, "left", F.left("o", F.lit(width)).alias("h")).agg(F.sum("n_tokens").alias("t"))
        after = F.sum("t").over(Window.partitionBy(*columns).orderBy("h"))
        cut = sums.withColumn("after", after).where(F.col("after") > F.col("left"))
        cut = cut.groupBy(*columns).agg(F.min(F.struct("h", (F.col("left") - F.col("after") + F.col("t")).alias("l"))).alias("cut"))
        leaves = checkpointed(
            leaves.join(cut, columns, "left").select(
                *columns, "tokens", "target", "full",
                F.coalesce("cut.l", "left").alias("left"), F.coalesce("cut.h", "head").alias("head"),
            )
        )
    rows = _with_leaf(slim, leaves.where("head != ''").select(*columns, "full", "left", "head"), n)
    rows = rows.withColumn("o", _order(settings.seed)).where(F.col("o").startswith(F.col("head")))
    so_far = F.sum("n_tokens").over(Window.partitionBy(*columns).orderBy("o").rangeBetween(Window.unboundedPreceding, 0))
    last = rows.withColumn("so_far", so_far).where("so_far <= left").groupBy(*columns).agg(F.max("o").alias("last"))
    # Without a document of the last stretch, all those before it still count.
    leaves = leaves.join(last, columns, "left").select(*columns, "target", "full", F.coalesce("last", "head").alias("last"))
    return checkpointed(leaves), n


def take(rows: DataFrame, leaves: DataFrame, n: int, settings: Settings, doc_id: str = "doc_id") -> DataFrame:
    """``rows`` repeated for each epoch that takes them, in ``epoch`` (from 0)."""
    at = _with_leaf(rows, leaves.select(*[f"_{v}" for v in LEVELS], "full", "last"), n)
    part = F.when(_order(settings.seed, doc_id) <= F.col("last"), 1).otherwise(0)
    passes = F.expr("full").cast("int") + part
    at = at.withColumn("_passes", passes).where("_passes > 0")
    return at.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_passes") - 1))).drop("_passes", "full", "last")


def slim_table(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang", "source")
    return stored(with_tree(rows).select("doc_id", *[f"_{v}" for v in LEVELS], n_tokens(F.col("text")).alias("n_tokens")))


def mix(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The training mixture of ``docs``: every column and ``epoch``, a row for each time that a document is used.

    Budget: ``percent`` of all tokens (words).  Each leaf (domain, language, source) is read in whole
    epochs and then to the end of a prefix, by an order that differs with seed and epoch; a document is used whole or not,
    so a leaf stays short of its target by less than one document.  Texts without words (null
    too) are never taken.  Null names are ``unknown``; null ids count as empty text in the order.
    Rows with the same id stand at the same place of the order, and are taken together or not at all.
    An empty table gives an empty mixture.  A column ``epoch`` of the input is replaced.
    """
    leaves, n = plan(slim_table(docs), settings)
    g = Guarded(docs.drop("epoch"))
    rows = with_tree(g.df, g["lang"], g["source"]).where(F.col(g["text"]).rlike(r"[^\x20\x09-\x0D]"))
    return take(rows, leaves, n, settings, g["doc_id"]).select(*g.df.columns, "epoch").toDF(*g.names, "epoch")


def mixture_of_ids(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The mixture without texts: ``(doc_id, domain, lang, source, n_tokens, epoch)``."""
    slim = slim_table(docs)
    leaves, n = plan(slim, settings)
    return take(slim.where("n_tokens > 0"), leaves, n, settings).select(
        "doc_id", *[F.col(f"_{v}").alias(v) for v in LEVELS], "n_tokens", "epoch"
    )


def mixture_sql(settings: Settings = Settings(), documents: str = "documents") -> str:
    """The same mixture of ids in DuckDB's SQL."""
    weight = lambda level: (
        "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in settings.weights.get(level, {}).items()) + " ELSE 1 END"
        if settings.weights.get(level)
        else "1"
    )
    steps = []
    for depth, level in enumerate(LEVELS):
        path, here = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        by = ", ".join(path) or "0"
        budget = (
            f"least((SELECT CAST(sum(n_tokens) AS BIGINT) FROM slim) * {settings.percent} // 100, CAST(sum(c.cap) OVER () AS BIGINT))"
            if not depth
            else "p.target"
        )
        joined = f" JOIN s{depth - 1} p USING ({', '.join(path)})" if depth else ""
        names = ", ".join(here)
        steps.append(f"""
        a{depth} AS (SELECT {names}, CAST(sum(cap) AS HUGEINT) AS cap, CAST(min({weight(level)}) AS HUGEINT) AS weight FROM leaf GROUP BY {names}),
        b{depth} AS (SELECT {", ".join(here)}, c.cap, c.weight, CAST({budget} AS HUGEINT) AS budget FROM a{depth} c{joined}),
        c{depth} AS (SELECT *, cap * sum(weight) OVER (PARTITION BY {by} ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                     <= (budget - coalesce(sum(cap) OVER (PARTITION BY {by} ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS isfull FROM b{depth}),
        d{depth} AS (SELECT *, budget - coalesce(sum(cap) FILTER (isfull) OVER (PARTITION BY {by}), 0) AS rest, greatest(coalesce(sum(weight) FILTER (NOT isfull) OVER (PARTITION BY {by}), 0), 1) AS openw FROM c{depth}),
        e{depth} AS (SELECT *, CASE WHEN isfull THEN cap ELSE (rest * weight) // openw END AS part FROM d{depth}),
        s{depth} AS (SELECT {names}, part + CASE WHEN NOT isfull AND row_number() OVER (PARTITION BY {by}, isfull ORDER BY {level})
                     <= rest - coalesce(sum(part) FILTER (NOT isfull) OVER (PARTITION BY {by}), 0) THEN 1 ELSE 0 END AS target FROM e{depth})""")
    leaf = f"s{len(LEVELS) - 1}"
    names = ", ".join(LEVELS)
    return f"""
        WITH slim0 AS (
            SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_tokens FROM {documents}
        ), slim AS (
            SELECT *, list_extract(['web', 'reference', 'forum'], ascii(right(source, 1)) % 3 + 1) AS domain FROM slim0 WHERE n_tokens > 0
        ), leaf AS (
            SELECT {names}, sum(n_tokens) AS tokens, sum(n_tokens) * {settings.epochs} AS cap FROM slim GROUP BY {names}
        ),{",".join(steps)},
        planned AS (
            SELECT {names}, CAST(target AS BIGINT) // CAST(tokens AS BIGINT) AS nfull, CAST(target AS BIGINT) % CAST(tokens AS BIGINT) AS rest FROM {leaf} JOIN leaf USING ({names})
        ), ordered AS (
            SELECT *, md5('{settings.seed}:' || nfull || ':' || doc_id) AS o FROM slim JOIN planned USING ({names})
        ), run AS (
            SELECT *, sum(n_tokens) OVER (PARTITION BY {names} ORDER BY o, doc_id) AS so_far FROM ordered
        )
        SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(0, nfull + CASE WHEN so_far <= rest THEN 1 ELSE 0 END)) AS INTEGER) AS epoch FROM run
    """
