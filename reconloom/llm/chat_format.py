"""Chat formatting of reply trees, in DataFrame operations only.

Template, for each message of a path:
``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>`` newline. Inside roles and
texts a backslash is doubled and ``<|`` becomes ``<\\|``, so control strings occur
only where the template puts them and ``unescape`` gives back every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconloom.sources.durable import durable, release

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def leaf_paths(nodes: DataFrame, max_doublings: int = 40) -> DataFrame:
    """``tree, leaf, node, up``: each leaf with every node on its way to the root, ``up`` steps above it.

    ``nodes`` has ``tree, node, parent``; a parent that is null or not in the
    tree makes a root. Self-joins double the reach: after k rounds all ancestors
    up to 2**k - 1 steps are listed, so a chain of a million replies takes 20
    rounds. A cycle has no leaf and gives no path; a leaf below a cycle is an error.
    """
    ids = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    jump = durable(nodes.select("tree", "node", F.col("parent").alias("above")).join(ids, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("above") == F.col("_n"))).select("tree", "node", "above").distinct(), "chat-jump")
    used = jump.select(F.col("tree").alias("_t"), F.col("above").alias("_n")).distinct()
    # what is reached so far, in one table for each round, so that no round writes the others again
    reach = durable(nodes.join(used, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")).distinct(), "chat-reach")
    for k in range(max_doublings):
        if jump.isEmpty():
            release(jump)
            return reach
        step = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("above").alias("_to"))
        on = F.col("tree").eqNullSafe(F.col("_t"))
        more = reach.join(step, on & (F.col("node") == F.col("_n"))).select("tree", "leaf", F.col("_to").alias("node"), (F.col("up") + F.lit(1 << k)).alias("up"))
        longer = jump.join(step, on & (F.col("above") == F.col("_n"))).select("tree", "node", F.col("_to").alias("above"))
        reach = reach.unionByName(durable(more, "chat-reach"))
        longer = durable(longer, "chat-jump")
        release(jump)
        jump = longer
    raise ValueError("a reply tree has a cycle above a leaf")


def format_trees(nodes: DataFrame, top: int | None = None, learn: str = "assistant", few_branches: bool = False) -> DataFrame:
    """Format the best ``top`` branches of each tree (all if None) as conversations.

    ``nodes``: ``tree, node, parent, role, text`` and optionally ``score``; ``node``
    is unique in its tree. Rows that repeat a node and its parent follow one another
    by text; if the parents differ, each way up is followed. A null ``tree`` is a
    tree like others, a null ``node`` a leaf without parent links. Further columns,
    whatever their names, are not read. A
    null role or text counts as empty. Branches rank by
    the sum of their scores (null: 0), ties by the smaller leaf. Returns ``tree,
    leaf, rank, n_messages, formatted, loss_spans``: the spans (start from 0,
    length, in code points) of the escaped texts of role ``learn``. An empty
    table gives an empty one. With ``few_branches`` all branches of a tree are put
    together in one task, so that texts are shuffled once and not twice: for threads
    and other trees whose branches together are of the size of a row or two.
    """
    if "score" not in nodes.columns:
        nodes = nodes.withColumn("score", F.lit(0.0))
    base = durable(nodes.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "chat-nodes")
    paths = leaf_paths(base)
    known = base.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "score", "role", "text")
    same = F.col("tree").eqNullSafe(F.col("_t")) & F.col("node").eqNullSafe(F.col("_n"))
    if top is not None:
        scored = paths.join(known.select("_t", "_n", "score"), same).groupBy("tree", "leaf").agg(F.sum("score").alias("branch"))
        best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch"), "leaf"))).where(F.col("rank") <= top)
        paths = paths.join(best.select(F.col("tree").alias("_bt"), F.col("leaf").alias("_bl")), F.col("tree").eqNullSafe(F.col("_bt")) & F.col("leaf").eqNullSafe(F.col("_bl")), "left_semi")
    full = _beside(paths, base) if few_branches else paths.join(known, same)
    opened = full.withColumn("_head", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))).withColumn("_body", escape(F.col("text"))).withColumn("_part", F.concat("_head", "_body", F.lit(END)))
    along = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"), "_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = opened.withColumn("_at", F.coalesce(F.sum(F.length("_part")).over(along), F.lit(0)) + F.length("_head"))
    message = F.struct((-F.col("up")).alias("order"), F.col("_part").alias("part"), F.col("_at").cast("int").alias("start"), F.length("_body").alias("length"), (F.col("role") == learn).alias("learn"))
    grouped = placed.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(message)).alias("m"), F.sum("score").alias("branch"))
    ranked = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch"), "leaf")))
    return ranked.select(
        "tree", "leaf", "rank", F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda x: x["part"]), "").alias("formatted"),
        F.transform(F.filter("m", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
    )


def _beside(paths: DataFrame, base: DataFrame) -> DataFrame:
    """The messages of all paths, with both tables dealt by tree: what follows by tree, leaf or node needs no exchange."""
    way = F.struct("leaf", "up")
    places = paths.select("tree", "node", way.alias("_way"))
    messages = base.select("tree", "node", F.struct("role", "text", "score").alias("_said"))
    ways = F.collect_list("_way").over(Window.partitionBy("tree", "node"))
    both = places.unionByName(messages, allowMissingColumns=True).repartition("tree").withColumn("_ways", ways)
    each = both.where("_said is not null").select("tree", "node", "_said.*", F.explode("_ways").alias("_way"))
    return each.select("tree", "node", "_way.leaf", "_way.up", "role", "text", "score")


def read_back(formatted: Column) -> Column:
    """The messages (role, text) that a formatted conversation holds."""
    parts = F.split(formatted, "\\Q" + END + "\\E")
    real = F.slice(parts, 1, F.size(parts) - 1)
    role = lambda p: unescape(F.substring_index(F.substr(p, F.lit(len(START) + 1)), SEP, 1))
    text = lambda p: unescape(F.substr(p, F.instr(p, SEP) + F.lit(len(SEP))))
    return F.transform(real, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def threads(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as reply trees that are chains; equal turns follow by role and text, null turns come first.

    Repeated rows are messages of their own, rows with a null conversation one chain. Texts may be null or of any
    length; an empty table gives an empty one; further columns are not read."""
    order = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    k = F.row_number().over(order)
    return messages.select(F.col(conv).alias("tree"), k.cast("long").alias("node"), F.when(k > 1, k - 1).cast("long").alias("parent"), F.col(role).alias("role"), F.col(text).alias("text"))
