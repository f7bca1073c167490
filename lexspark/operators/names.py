"""Names out of a table of any size, found in texts as whole words: stretches of words meet the names in a hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stretches have up to so many words; a longer name is looked up by as many stretches as cover it.
WORDS = 8
#: Hashes of up to so many names go to all tasks, so only stretches that a name may have are shuffled.
BROADCAST = 1 << 20


def _words(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda w: w != "")


def _stretches(norm: Column, size: int) -> Column:
    """The stretches of so many words from every place: a match is the start of a word, and looks ahead."""
    return F.regexp_extract_all(norm, F.lit(f"(?:^| )(?=([^ ]+(?: [^ ]+){{{size - 1}}})(?: |$))"), F.lit(1))


def _may_have(told: DataFrame, keyed: DataFrame, few: bool) -> DataFrame:
    """The stretches that a name may have by a hash; all of them, if there are many names."""
    if not few:
        return told
    hashes = F.broadcast(keyed.select(F.xxhash64("_stretch").alias("_h")).distinct())
    return told.withColumn("_h", F.xxhash64("_stretch")).join(hashes, "_h", "left_semi").drop("_h")


def _long(rows: DataFrame, names: DataFrame, row: str, norm: str, name: str, few: bool) -> DataFrame:
    """row and name, for names of WORDS words or more (``_n``): all stretches of a name stand in one text as far apart as in the name."""
    last = F.col("_n") - WORDS
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(WORDS)), F.array(last)))
    pieces = names.select(name, "_n").distinct().withColumn("_all", F.size(offsets)).select(
        name, "_all", F.explode(offsets).alias("_offset"), _words(F.col(name)).alias("_w")
    ).select(name, "_all", "_offset", F.array_join(F.slice("_w", F.col("_offset") + 1, WORDS), " ").alias("_stretch"))
    told = rows.withColumn("_id", F.monotonically_increasing_id()).select(  # keys of rows may repeat
        row, "_id", F.posexplode(_stretches(F.col(norm), WORDS)).alias("_at", "_stretch")
    )
    met = _may_have(told, pieces, few).join(pieces, "_stretch")
    whole = met.groupBy("_id", row, name, (F.col("_at") - F.col("_offset")).alias("_start")).agg(
        F.count(F.lit(1)).alias("_found"), F.first("_all").alias("_all")
    ).where("_found = _all")
    return whole.groupBy("_id", row, name).agg(F.count(F.lit(1))).select(row, name)


def found_names(rows: DataFrame, names: DataFrame, row: str = "row", norm: str = "norm", name: str = "name") -> DataFrame:
    """The columns of names and ``row``, for each row and each name that its normal form has as whole words.

    Names are in normal form too, with single spaces between words; null and empty ones are left out, and so are rows without words.
    Each row is read once, whatever the number of names, and once more if there are long ones. No
    text goes along with its stretches; of these only the ones are shuffled that have a name's hash,
    unless there are more than BROADCAST names.
    """
    given = names.where(F.size(_words(F.col(name))) > 0).withColumn("_n", F.size(_words(F.col(name))))
    of_size = given.groupBy(F.least("_n", F.lit(WORDS)).alias("n")).agg(  # at most WORDS rows
        F.sum(F.ceil(F.col("_n") / WORDS)).alias("pieces")
    ).collect()
    sizes, few = sorted(r.n for r in of_size), sum(r.pieces for r in of_size) <= BROADCAST
    out = [row, *names.columns]
    if not sizes:
        return given.join(rows.select(row).where("false"), F.lit(True)).select(*out)
    parts = []
    if short := [k for k in sizes if k < WORDS]:
        keyed = given.where(F.col("_n") < WORDS).withColumn("_stretch", F.array_join(_words(F.col(name)), " "))
        every = F.array_distinct(F.flatten(F.array(*[_stretches(F.col(norm), k) for k in short])))
        told = rows.select(F.col(row), F.explode(every).alias("_stretch"))
        parts.append(_may_have(told, keyed, few).join(keyed, "_stretch").select(*out))
    if WORDS in sizes:
        many = given.where(F.col("_n") >= WORDS)
        parts.append(_long(rows, many, row, norm, name, few).join(many, name).select(*out))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def longest_name(rows: DataFrame, names: DataFrame, row: str = "row", norm: str = "norm", name: str = "name", tie: str | None = None) -> DataFrame:
    """row and the columns of names: the longest name in each row that has any; of equally long ones the first by ``tie``, or by itself. ``tie`` is a number."""
    told = F.struct(F.col(name), *[F.col(c) for c in names.columns if c != name])
    rank = F.struct((-F.length(name)).alias("l"), F.col(tie or name).alias("t"), F.col(name).alias("n"))
    best = found_names(rows, names, row, norm, name).groupBy(row).agg(F.min_by(told, rank).alias("_b"))
    return best.select(row, "_b.*")
