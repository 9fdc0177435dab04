"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

A source's documents stand in one fixed order: by size, then by a hash (md5) of id and text. Each expects the same number
of copies e = target / size of the source. With one random offset u for each source, the document at place r is taken
floor(u + r * e) - floor(u + (r - 1) * e) times: once for each integer that the running sum of expected copies crosses.
As the order is by size, every stretch of sizes is sampled at the same rate, and the words taken differ from the target by
about the size of the largest documents at most.

No source is sorted as a whole. Rows are dealt into groups of one source, one size and the same first digits of the
hash, more digits the more rows have that size; a place is the row's number in its group plus a running sum over the
counts of the groups before it, so the order is the same however the groups are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Stash

#: Rows that one group should hold at most, on average: PART_ROWS, or fewer so that a table has PARTS of them, or more so that it has MOST_PARTS.
PART_ROWS, PARTS, MOST_PARTS = 50_000, 512, 1 << 16
#: Hexadecimal digits of the hash.
DIGITS = 12
WORD = r"[^\x20\x09-\x0D]+"
_MINE = "__mix_"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _offset(name: Column, seed: int) -> Column:
    """The random offset of a source, in (0, 1), from its name and the seed; a multiple of 1 / 2**17, so that sums stay exact."""
    digits = F.md5(F.concat(F.lit(f"{seed}:"), name))
    value = F.lit(0)
    for k in range(1, 5):
        value = value * 16 + (F.instr(F.lit("0123456789abcdef"), F.substring(digits, k, 1)) - 1)
    return (value + 0.5) / 65536.0


def _copies(offset: Column, place: Column, each: Column) -> Column:
    return (F.floor(offset + place * each) - F.floor(offset + (place - 1) * each)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds ``target`` to a table of sources (name, n, size).

    Sources by name (null last) weigh ``weights`` in turn and share ``share`` times all sizes; no target
    is above ``most`` times its source's size, and what is cut off is shared again by weight. In the order
    of limit / weight, the limited sources come first; the level of the rest follows from running sums.
    """
    turn = F.row_number().over(Window.orderBy(F.col("name").isNull(), "name")) - 1
    table = sources.withColumn("turn", turn % len(weights))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") + 1).cast("int"))
    table = table.withColumn("weight", weight).withColumn("limit", F.col("size") * float(most))
    ahead = Window.orderBy(F.col("limit") / F.col("weight"), F.col("name").isNull(), "name")
    before, onward, every = ahead.rowsBetween(Window.unboundedPreceding, -1), ahead.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    total = F.sum("size").over(every) * float(share)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    table = table.withColumn("level", level)
    fits = F.max(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))).over(every)
    table = table.withColumn("target", F.least(F.coalesce(fits, F.lit(float("inf"))) * F.col("weight"), F.col("limit")))
    return table.drop("turn", "weight", "limit", "level")


class SourceMix:
    """Takes documents so that each source's words come near its share.

    Null and empty texts have size 0; null sources are one source, the last. Ids and sources may repeat or be null;
    rows that are equal in id and text are told apart only by count, so reruns agree on how often they are taken. Ties
    in size go by the hash. Long texts count whole. An empty table gives no rows. ``weigh`` returns the input's columns
    and four more, ``__mix_size``, ``__mix_source_size``, ``__mix_target`` and ``__mix_copies``, which no input column
    may be named; all other names inside are new ones. ``emit`` returns the input's columns, each row as often
    as it is taken, and ``copy`` (from 1; an input column of that name is replaced).
    """

    def __init__(self, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0):
        self.weights, self.share, self.most, self.seed = weights, share, most, seed

    def weigh(self, docs: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
        stash = Stash(docs.sparkSession, "mix")
        keyed = self._keyed(docs, id_, text, source)
        groups, many = self._groups(stash.put("rows", keyed.select(*self._own("name", "size", "key", "hash"))), stash)
        return self._placed(keyed.drop(_MINE + "name"), groups, many, docs.columns)

    def sizes(self, docs: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
        """What ``weigh`` gives, with the id as the only input column; the texts are read once and never shuffled."""
        stash = Stash(docs.sparkSession, "mix")
        narrow = stash.put("rows", self._keyed(docs, id_, text, source).select(id_, *self._own("name", "size", "key", "hash")))
        groups, many = self._groups(narrow, stash)
        return self._placed(narrow.drop(_MINE + "name"), groups, many, [id_])

    @staticmethod
    def _own(*names: str) -> list[str]:
        return [_MINE + n for n in names]

    def _keyed(self, docs: DataFrame, id_: str, text: str, source: str) -> DataFrame:
        body = F.col(text).cast("string")
        key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
        hash_ = F.substring(F.md5(F.concat(F.coalesce(F.col(id_).cast("string"), F.lit("")), F.lit(":"), F.coalesce(body, F.lit("")))), 1, DIGITS)
        return docs.withColumns(dict(zip(self._own("name", "size", "key", "hash"), (F.col(source), n_words(body), key, hash_), strict=True)))

    def _groups(self, narrow: DataFrame, stash: Stash) -> tuple[DataFrame, DataFrame]:
        """(groups, sizes of many rows): for each (source, size, first digits) how many rows of the source come before and what
        the source's figures are; and by how many digits the sizes that many rows have are cut, a bounded number of them."""
        name, size, key, hash_, digits, part, held, before = self._own("name", "size", "key", "hash", "digits", "part", "held", "before")
        counts = stash.put("counts", narrow.groupBy(key, size).agg(F.first(name, True).alias(name), F.count("*").alias(held)))
        total = counts.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0]
        rows = max(1, total // MOST_PARTS, min(PART_ROWS, total // PARTS))
        many = counts.where(F.col(held) > rows).select(key, size, F.least(F.lit(DIGITS), F.ceil(F.log(16.0, F.col(held) / rows))).cast("int").alias(digits))
        groups = self._cut(narrow.select(key, size, hash_), many).groupBy(key, size, part).agg(F.count("*").alias(held))
        ahead = Window.partitionBy(key).orderBy(size, part).rowsBetween(Window.unboundedPreceding, -1)
        groups = groups.select(key, size, part, F.coalesce(F.sum(held).over(ahead), F.lit(0)).alias(before))
        sources = counts.groupBy(key).agg(F.first(name, True).alias("name"), F.sum(F.col(size) * F.col(held)).alias("size"))
        sources = targets(sources, self.weights, self.share, self.most)
        each = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0))
        figures = zip(("size", "target", each, _offset(F.col(key), self.seed)), self._own("source_size", "target", "each", "offset"), strict=True)
        sources = sources.select(key, *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in figures])
        return stash.put("groups", groups.join(sources, key)), many

    def _cut(self, rows: DataFrame, many: DataFrame) -> DataFrame:
        size, key, hash_, digits, part = self._own("size", "key", "hash", "digits", "part")
        cut = rows.join(F.broadcast(many), [key, size], "left")
        return cut.withColumn(part, F.expr(f"substring({hash_}, 1, coalesce({digits}, 0))")).drop(digits)

    def _placed(self, rows: DataFrame, groups: DataFrame, many: DataFrame, columns: list[str]) -> DataFrame:
        size, key, hash_, part, before, place, each, offset, copies = self._own("size", "key", "hash", "part", "before", "place", "each", "offset", "copies")
        own = Window.partitionBy(key, size, part).orderBy(hash_)
        full = self._cut(rows, many).withColumn(place, F.row_number().over(own)).join(groups, [key, size, part])
        taken = _copies(F.col(offset), F.col(place) + F.col(before), F.col(each))
        return full.select(*columns, size, *self._own("source_size", "target"), taken.alias(copies))

    def emit(self, docs: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
        taken = self.weigh(docs, id_, text, source).where(F.col(_MINE + "copies") > 0)
        names = [c for c in docs.columns if c != "copy"]
        return taken.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col(_MINE + "copies"))).alias("copy"))
