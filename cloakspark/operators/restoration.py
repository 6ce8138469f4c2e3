"""Restoration of texts and of JSON payloads: nested values are expanded inside the mapping, so each text meets it once.

A value may mention other tokens, and so take several passes over a text to restore. Instead of passing over the texts
again and again, values are replaced by what they become after all passes, together with the number of passes that
takes: with the values after a and after b passes, one join gives those after a + b. Texts are then joined with the
expanded mapping once.

Passes over texts remain for the odd rows only: those with a token that leads back to itself or isn't done after all
passes, and those where an open bracket stands before a token, so that a token could arise where two pieces meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakspark.functions import patterns as P
from cloakspark.functions import text as T
from cloakspark.operators import trees
from cloakspark.sources.session import checkpointed

#: Values that would grow beyond this in the mapping stay as they are, and their texts are restored in passes.
LONGEST = 1_000_000
ROW = "__row"


def _gaps(text: Column) -> Column:
    return F.split(text, P.PLACEHOLDER, -1)


def _stitched(text: Column, values: Column) -> Column:
    """A text with its tokens replaced by as many values, in order."""
    return F.array_join(F.zip_with(_gaps(text), values, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")


def _open(piece: Column) -> Column:
    """A token could begin in this piece and end in the next."""
    return piece.rlike(P.OPEN_TOKEN)


def _open_before_token(text: Column) -> Column:
    return F.exists(F.slice(F.reverse(_gaps(text)), 2, 2**31 - 1), _open)


def _replaced(open_: DataFrame, key: str, tokens: Column, known: DataFrame) -> DataFrame:
    """key, found (array of token, text, in order, by place), own (map of token to text), deeper, left, sound over the tokens of each row. known: as `expanded` gives it; unknown tokens stay."""
    each = open_.select(key, F.posexplode(tokens).alias("at", "token")).join(known.withColumnRenamed("placeholder", "token"), "token", "left")
    one = F.struct("at", "token", F.coalesce("text", "token").alias("text"))
    return each.groupBy(key).agg(
        F.array_sort(F.collect_list(one)).alias("found"), F.map_from_entries(F.collect_set(F.struct("token", F.coalesce("text", "token").alias("text")))).alias("own"), F.max(F.coalesce("depth", F.lit(0))).alias("deeper"), F.bool_or(F.coalesce("more", F.lit(False))).alias("left"), F.bool_and(F.coalesce("plain", F.lit(True))).alias("sound"),
    )


def _composed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values after the passes of a and then of b. Both: placeholder, text, depth, more, plain."""
    open_ = a.where("more")
    inner = _replaced(open_, "placeholder", T.tokens_in(F.col("text")), b)
    whole = _stitched(F.col("text"), F.transform("found", lambda x: x["text"]))
    # the length is known before the text is built
    length = F.length("text") + F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"]))
    fits = length <= LONGEST
    done = open_.join(inner, "placeholder").select(
        "placeholder", F.when(fits, whole).otherwise(F.col("text")).alias("text"), (F.col("depth") + F.col("deeper")).alias("depth"), (F.col("left") | ~fits).alias("more"), (F.col("plain") & F.col("sound") & fits).alias("plain"),
    )
    return a.where("not more").unionByName(done)


def expanded(mapping: DataFrame, passes: int) -> DataFrame:
    """placeholder, text, depth, more, plain: of each token what it becomes in `passes` passes, and in how many it does so.

    more: known tokens are left in the text, which may go on for ever. plain: no token can arise across the edge of a
    value on the way. Only values that mention a known token, and those they mention, travel more than once. Null values
    are left out; of repeated placeholders the smallest value counts.
    """
    one = mapping.where("original_value is not null").groupBy("placeholder").agg(F.min("original_value").alias("text"))
    start = [F.lit(1).alias("depth"), ~F.exists(_gaps(F.col("text")), _open)]
    edges = checkpointed(one.where(F.col("text").rlike(P.PLACEHOLDER)).select("placeholder", F.explode(F.array_distinct(T.tokens_in(F.col("text")))).alias("target")).join(one.select(F.col("placeholder").alias("target")), "target", "left_semi"))
    if passes < 2 or edges.isEmpty():
        return one.select("placeholder", "text", start[0], F.lit(False).alias("more"), start[1].alias("plain"))
    sources = edges.select("placeholder").distinct().withColumn("more", F.lit(True))
    targets = edges.select(F.col("target").alias("placeholder")).distinct().withColumn("meant", F.lit(True))
    marked = one.join(sources, "placeholder", "left").join(targets, "placeholder", "left")
    marked = checkpointed(marked.select("placeholder", "text", start[0], F.coalesce("more", F.lit(False)).alias("more"), start[1].alias("plain"), F.coalesce("more", "meant", F.lit(False)).alias("used")))
    power, total, left = marked.where("used").drop("used"), None, passes
    while left:
        if left & 1:
            total = power if total is None else checkpointed(_composed(total, power))
            if total.where("more").isEmpty():
                break
        left >>= 1
        if left:
            power = checkpointed(_composed(power, power))
    return marked.where("not used").drop("used").unionByName(total)


def _in_passes(rows: DataFrame, column: str, once, max_passes: int) -> DataFrame:
    """__row, column, passes: `once` (rows to rows with `new`) again and again over the rows that still change."""
    rows, done = rows.select(ROW, column, F.lit(0).alias("passes")), None
    for _ in range(max_passes):
        new = once(rows)
        moved = ~F.col("new").eqNullSafe(F.col(column))
        new = checkpointed(new.select(ROW, F.col("new").alias(column), (F.col("passes") + moved.cast("int")).alias("passes"), moved.alias("moved")))
        still = new.where(~F.col("moved")).drop("moved")
        done = still if done is None else done.unionByName(still)
        rows = new.where("moved").drop("moved")
        if rows.isEmpty():
            return done
    return done.unionByName(rows)


def _restored(df: DataFrame, id_col: str, column: str, mapping: DataFrame, max_passes: int, tokens, put, split_open) -> DataFrame:
    """Of texts and payloads alike. tokens: column to array of its tokens; put: column to the new column, with `found` and `own` at hand; split_open: whether a token could arise across a gap."""
    passes = max(1, max_passes)
    # a made-up key, as ids may repeat or be null; kept, so that it stays the same
    rows = checkpointed(df.select(id_col, column, F.monotonically_increasing_id().alias(ROW)).withColumn("__tokens", tokens(F.col(column))).withColumn("__any", F.size("__tokens") > 0))
    some = rows.where("__any")
    known = expanded(mapping, passes)
    joined = some.join(_replaced(some, ROW, F.col("__tokens"), known), ROW)
    joined = joined.withColumn("new", put(F.col(column)))  # by itself, as it is mentioned several times
    moved = (~F.col("new").eqNullSafe(F.col(column))).cast("int")
    sound = F.lit(True) if passes == 1 else F.col("sound") & ~F.col("left") & ~split_open(F.col(column))
    joined = joined.select(ROW, id_col, "new", F.when(sound, F.greatest(moved, F.when(moved > 0, F.col("deeper")).otherwise(0)) if passes > 1 else moved).alias("passes"))
    joined = checkpointed(joined.withColumnRenamed("new", column))
    out = rows.where("not coalesce(__any, false)").select(id_col, column, F.lit(0).alias("passes"))
    odd = joined.where("passes is null")
    out = out.unionByName(joined.where("passes is not null").select(id_col, column, "passes"))
    if odd.isEmpty():
        return out
    plain = checkpointed(expanded(mapping, 1))

    def once(left: DataFrame) -> DataFrame:
        found = _replaced(left, ROW, tokens(F.col(column)), plain)
        return left.join(found.select(ROW, "found", "own"), ROW, "left").withColumn("new", F.when(F.col("found").isNull(), F.col(column)).otherwise(put(F.col(column))))

    again = _in_passes(some.join(odd.select(ROW), ROW, "left_semi"), column, once, passes)
    return out.unionByName(again.join(some.select(ROW, id_col), ROW).select(id_col, column, "passes"))


def restored(df: DataFrame, id_col: str, text_col: str, mapping: DataFrame, max_passes: int = 5) -> DataFrame:
    """id, text, passes: known tokens replaced by their values, as if in passes until one changes nothing, max_passes at most.

    One row per row of `df`: repeated and null ids stay apart, null texts stay null with 0 passes, unknown tokens stay. A
    pass counts for a row if it changed its text. mapping: placeholder, original_value. Spark picks the joins; texts
    without tokens take part in none.
    """
    return _restored(df, id_col, text_col, mapping, max_passes, T.tokens_in, lambda t: _stitched(t, F.transform("found", lambda x: x["text"])), _open_before_token)


def restored_json(df: DataFrame, id_col: str, json_col: str, mapping: DataFrame, max_passes: int = 5) -> DataFrame:
    """The same for JSON texts of any shape: known tokens in their string values are replaced; keys, numbers and structure stay."""

    def put(json: Column) -> Column:
        return F.when(json.isNotNull(), trees.mapped_values(json, lambda v: T.stitched(v, P.PLACEHOLDER, lambda t: F.coalesce(F.element_at("own", t), t)), "<"))

    return _restored(df, id_col, json_col, mapping, max_passes, trees.tokens_of, put, lambda json: F.exists(trees.string_values(json, "<"), _open_before_token))
