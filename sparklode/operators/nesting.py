"""Nesting of definitions by a sweep over their starts and ends."""

from pyspark.sql import DataFrame, Window, functions as F

KEYS = ["row"]   # the number of a file, see segment.masked_files
FILE = ["repo_id", "file_path", "file_rel_path"]


def resolve_nesting(defs: DataFrame) -> DataFrame:
    """Drops definitions inside functions; adds the nearest enclosing class.

    ``defs``: row (of the file), first, last, is_function, name, depth ...
    Each definition gives an opening and a closing event; running sums per file
    tell how many functions and classes are open. At class depth c, the class
    opened last at depth c-1 is the enclosing one. All windows are per file (a
    file is bounded by the corpus size limit) and share one hash partitioning.
    Result adds parent: STRUCT(name, depth), NULL at top level.
    """
    rest = [c for c in defs.columns if c not in KEYS]
    event = F.explode(F.array(
        F.struct(F.col("first").alias("at"), F.lit(0).alias("closes")),
        F.struct(F.col("last").alias("at"), F.lit(1).alias("closes"))))
    e = defs.select(*KEYS, F.struct(*rest).alias("d"), event.alias("e"))
    before = (Window.partitionBy(*KEYS).orderBy("e.at", "e.closes")
              .rowsBetween(Window.unboundedPreceding, -1))
    step = F.when(F.col("e.closes") == 0, 1).otherwise(-1)
    is_function = F.col("d.is_function")
    open_ = e.select(
        *KEYS, "d", "e",
        F.coalesce(F.sum(F.when(is_function, step).otherwise(0)).over(before),
                   F.lit(0)).alias("functions"),
        F.coalesce(F.sum(F.when(is_function, 0).otherwise(step)).over(before),
                   F.lit(0)).alias("classes"))
    kept = open_.where((F.col("e.closes") == 0) & (F.col("functions") == 0))
    inside = F.struct(F.col("classes").alias("level"), F.lit(False).alias("encloses"))
    around = F.struct((F.col("classes") + 1).alias("level"), F.lit(True).alias("encloses"))
    roles = kept.select(*KEYS, "d", F.explode(F.when(is_function, F.array(inside)).otherwise(
        F.array(inside, around))).alias("r"))
    above = (Window.partitionBy(*KEYS, "r.level").orderBy("d.first", "r.encloses")
             .rowsBetween(Window.unboundedPreceding, -1))
    parent = F.last(F.when(F.col("r.encloses"), F.struct("d.name", "d.depth")),
                    ignorenulls=True).over(above)
    return (roles.withColumn("parent", F.when(F.col("r.level") > 0, parent))
            .where(~F.col("r.encloses")).select(*KEYS, "d.*", "parent"))
