"""Mixing sources to target weights, in DataFrame functions only.

Targets: sources share the size of the corpus by weight; a target stops at max_repeats times its
source and the excess goes to the others by weight (water filling: the level rises until no further source is full).

Quotas: the mix is cut into blocks of equally many words, and Sainte-Lague gives them to
sources one by one to the highest quotient target / (2 k + 1), k being the blocks a source has. Only the
quotients near a source's exact share can decide, so about four for each source are ranked. A
source's quota is given to its shards (documents dealt by a seeded hash) in the same way.

Sources and quotients are ranked by ranges of a sorted table and the number of rows in the ranges before, so that neither
all sources nor all shards of one are ever in one task.

Blocks: within a shard, documents stand in seeded order on an axis of words that is cut into
equal blocks. A quota beyond whole passes over the axis goes to the blocks with the least seeded
hashes. A document has taken what its own words on the axis have been taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Shards whose blocks one task hashes.
SHARDS_OF_TASK = 256
#: Words of a block: 1024, or a part of the corpus while that is small. Shards: 2^18 words, 2^20 shards at most.
BLOCK_WORDS, LEAST_BLOCKS, SHARD_WORDS, MOST_SHARDS = 1024, 16384, 1 << 18, 1 << 20


def seeded(*parts: Column | str) -> Column:
    """60 bits of the MD5 of the parts joined by colons, as a long."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def ranked(rows: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """rows with a column rank, from 1 by order, which no two rows may share. One number for each range is put in one task."""
    ranges = scratch.keep(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_own", own).join(before, "_range").withColumn("rank", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def _exact(whole: Column) -> Column:
    return whole.cast("decimal(19,0)")


def targets(sizes: DataFrame, cycle: tuple[int, ...], max_repeats: int, scratch: Scratch) -> DataFrame:
    """(s, source, z, target) of each source from (source, size), written: s counts from 0 by code point, null last."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("z"))
    named = ranked(sources, [F.col("source").asc_nulls_last()], scratch, "named").withColumn("s", F.col("rank") - 1).drop("rank")
    weighed = scratch.keep(named.withColumn("w", F.element_at(F.array(*map(F.lit, cycle)), (F.col("s") % len(cycle) + 1).cast("int"))), "weighed")
    cap = F.col("z") * max_repeats
    all_z, all_w = weighed.agg(F.sum("z"), F.sum("w")).first()
    left_z, left_w, full = all_z or 0, all_w or 0, None
    while True:
        # a source is full if its cap is no more than its part of what those that are not full share
        filled = _exact(cap) * _exact(F.lit(left_w)) <= _exact(F.col("w")) * _exact(F.lit(left_z)) if left_w else F.lit(True)
        found = weighed.agg(F.count(F.when(filled, 1)), F.sum(F.when(filled, cap)), F.sum(F.when(filled, F.col("w")))).first()
        if found[0] == full:
            break
        full, left_z, left_w = found[0], (all_z or 0) - (found[1] or 0), (all_w or 0) - (found[2] or 0)
    level = F.lit(float(left_z) / left_w if left_w else 0.0)
    return weighed.select("s", "source", "z", F.when(filled, cap.cast("double")).otherwise(F.col("w").cast("double") * level).alias("target"))


def sainte_lague(parties: DataFrame, group: str, party: str, votes: str, seats: str, cap: str, slack: int, scratch: Scratch) -> DataFrame:
    """parties with a column quota: seats of each group given to its parties, none above cap.

    slack widens the range of quotients that are ranked, in parts of a party's fair share of one seat
    for every party; 1 is enough without caps.
    """
    whole = parties.groupBy(group).agg(F.sum(votes).cast("double").alias("_v"), F.count("*").alias("_n"))
    shared = parties.join(whole, group).withColumn("_f", F.coalesce(F.col(votes) / F.nullif(F.col("_v"), F.lit(0.0)), F.lit(0.0)))
    reach = slack * (1 + F.col("_n") * F.col("_f"))
    exact = F.col(seats) * F.col("_f")
    bounded = shared.withColumn("_base", F.least(F.col(cap), F.greatest(F.lit(0), F.floor(exact - reach)))).withColumn(
        "_top", F.least(F.col(cap), F.ceil(exact + reach))
    )
    bounded = scratch.keep(bounded, "bounded")
    tries = bounded.filter("_top > _base").select(group, party, votes, F.explode(F.sequence(F.col("_base"), F.col("_top") - 1)).alias("_k"))
    order = [F.col(group), (F.col(votes) / (2 * F.col("_k") + 1)).desc(), F.col(party), F.col("_k")]
    tries = scratch.keep(ranked(tries, order, scratch, "tries"), "quotients")
    # of each group, the best quotients that the seats are left for
    of_group = bounded.groupBy(group).agg((F.max(seats) - F.sum("_base")).alias("_left")).join(tries.groupBy(group).agg(F.min("rank").alias("_first")), group)
    won = tries.join(of_group, group).filter("rank < _first + _left").groupBy(group, party).agg(F.count("*").alias("_more"))
    back = bounded.join(won, [group, party], "left")
    return back.withColumn("quota", (F.col("_base") + F.coalesce("_more", F.lit(0))).cast("long")).select(*parties.columns, "quota")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = 3,
    seed: str = "mix",
    shard_words: int = SHARD_WORDS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs.

    size is the number of words, 0 for a null text; taken is the number of words the mix takes from
    the row, repeats counted, never over max_repeats * size. A null source is a source, the last. Null
    ids and rows that repeat an id are rows like any other; rows alike in id and text can change places. Further
    columns are read only if named in keep. An empty table gives an empty one. Sources of no words have target 0.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *[F.xxhash64(c).alias(f"hash_of_{c}") for c in keep],
        F.col(text_col).cast("string").alias("_text"),
    )
    # rows without an id are dealt by their text
    key = seeded(seed, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("_text", F.lit(""))))))
    sizes = scratch.keep(rows.withColumn("key", key).drop("_text"), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    block = max(1, min(BLOCK_WORDS, total // LEAST_BLOCKS))
    shard = max(shard_words, total // MOST_SHARDS)

    sources = targets(sizes.select("source", "size"), cycle, max_repeats, scratch).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("z") / shard)))
    sources = sources.withColumn("g", F.lit(0)).withColumn("seats", F.lit(total // block)).withColumn("cap", F.ceil(F.col("z") * max_repeats / block))
    sources = scratch.keep(sainte_lague(sources, "g", "s", "target", "seats", "cap", 2, scratch), "sources")

    dealt = sizes.join(sources.select("source", "s", "shards").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "key", "s", F.pmod("key", "shards").alias("shard"), *[f"hash_of_{c}" for c in keep]
    )
    shards = dealt.groupBy("s", "shard").agg(F.sum("size").alias("z")).withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("z") / block)).cast("long"))
    of_source = sources.select("s", F.col("z").alias("source_size"), "target", F.col("quota").alias("seats"))
    shards = shards.join(of_source, "s").withColumn("cap", F.when(F.col("z") > 0, F.col("blocks") * max_repeats).otherwise(F.lit(0)))
    given = sainte_lague(shards, "s", "shard", "z", "seats", "cap", 4, scratch)

    # the cut is a column of a written table: as an expression it would be worked out for each block again
    hashes = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: seeded(seed, F.col("s"), F.col("shard"), i)))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, total // (shard * SHARDS_OF_TASK) + 1)
    spare = (F.col("quota") % F.col("blocks")).cast("int")
    cut = F.when(spare > 0, F.element_at(hashes, F.greatest(spare, F.lit(1)))).otherwise(F.lit(-1))
    cuts = scratch.keep(given.repartition(int(tasks), "s", "shard").withColumn("last", cut), "cuts")
    passes = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda i: ((F.col("quota") - F.col("quota") % F.col("blocks")) / F.col("blocks") + F.when(seeded(seed, F.col("s"), F.col("shard"), i) <= F.col("last"), 1).otherwise(0)).cast("int"),
    )
    spread = cuts.repartition(int(tasks), "s", "shard")
    passes = scratch.keep(spread.select(F.col("s").alias("_s"), F.col("shard").alias("_shard"), "source_size", "target", "z", "blocks", passes.alias("times")), "passes")

    axis = Window.partitionBy("s", "shard").orderBy("key", "doc_id", "size", *[f"hash_of_{c}" for c in keep])
    placed = dealt.withColumn("at", F.sum("size").over(axis.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(passes, (F.col("s") == F.col("_s")) & (F.col("shard") == F.col("_shard")))
    taken = F.expr(
        """if(size = 0, 0L, aggregate(
             sequence(((at + 1) * blocks - 1) div z, ((at + size) * blocks - 1) div z), 0L,
             (acc, i) -> acc + element_at(times, int(i + 1)) * (least(at + size, ((i + 1) * z) div blocks) - greatest(at, (i * z) div blocks))))"""
    )
    taken = placed.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), *[f"hash_of_{c}" for c in keep])
    return scratch.only(taken, "taken")


#: Parts of a copy that are added up: integers, so that the sum is the same in any order.
_COPY = 1 << 20


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The rows of docs as often as the mix takes them, in whole documents; all columns as they were.

    A row comes taken / size times, rounded so that the sum of these along its source's documents, in order of size, is
    always that of the whole numbers but for a part of one. A source's words are thus within about its longest document
    of those that the mix takes. Rows alike in id, source and text share evenly what they take. Rows without words go.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    taken = mix(docs, id_col, text_col, source_col, seed=seed, keep=(text_col, source_col))
    row = [f"hash_of_{text_col}", f"hash_of_{source_col}"]
    alike = taken.withColumn("_id", F.xxhash64(id_col)).groupBy("_id", *row).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"), F.count("*").alias("_many"))
    shares = alike.filter("_taken > 0").withColumn("_share", F.expr(f"((_taken * {_COPY}L) div _size) * _many"))
    order = [F.col(row[1]), (F.col("_size") / F.col("_many")), F.xxhash64(F.lit(seed), F.col("_id"), F.col(row[0])), F.col("_id"), F.col(row[0])]
    ranges = scratch.keep(shares.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "shares")
    sums = ranges.groupBy(row[1], "_range").agg(F.sum("_share").alias("_sum"))
    before = sums.select(row[1], "_range", (F.sum("_sum").over(Window.partitionBy(row[1]).orderBy("_range")) - F.col("_sum")).alias("_before"))
    upto = F.sum("_share").over(Window.partitionBy(row[1], "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    start = F.pmod(seeded(seed, "copies", F.col(row[1])), F.lit(_COPY))
    summed = ranges.join(before, [row[1], "_range"]).withColumn("_upto", upto + start)
    whole = summed.select("_id", *row, "_many", F.expr(f"_upto div {_COPY}L - (_upto - _share) div {_COPY}L").alias("_copies")).filter("_copies > 0")
    # several rows alike: all get the whole part of the mean, and the rest of them one more by a seeded hash
    keyed = docs.select(F.struct("*").alias("_doc"), F.xxhash64(id_col).alias("_id"), F.xxhash64(text_col).alias(row[0]), F.xxhash64(source_col).alias(row[1]))
    chance = seeded(seed, "copies", F.col(f"_doc.{id_col}")) / float(1 << 60)
    each = F.expr("_copies div _many") + F.when(chance < F.expr("(_copies % _many) / _many"), 1).otherwise(0)
    many = keyed.join(whole, ["_id", *row]).withColumn("_each", each.cast("int")).filter("_each > 0")
    return many.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_each")))).select("_doc.*")


#: DuckDB: the same mix of documents, with every quotient ranked. Block and shard sizes as above.
SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS key
  FROM documents),
whole AS (SELECT sum(size)::BIGINT AS total, greatest(1, least(1024, sum(size)::BIGINT // 16384))::BIGINT AS block,
                 greatest(262144, sum(size)::BIGINT // 1048576)::BIGINT AS shard_words FROM sizes),
named AS (SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS s FROM sizes GROUP BY source),
weighed AS (SELECT *, (s % 3 + 1)::DOUBLE AS w, z * 3.0::DOUBLE AS cap FROM named),
spread AS (
  SELECT *, (sum(z) OVER ())::DOUBLE AS all_z, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER p, 0) AS z_before, coalesce(sum(w) OVER p, 0) AS w_before
  FROM weighed WINDOW p AS (ORDER BY z / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap * (all_w - w_before) <= w * (all_z - z_before) AS capped FROM spread),
aims AS (
  SELECT s, source, z, CASE WHEN capped THEN cap ELSE w * ((all_z - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
         / (all_w - sum(CASE WHEN capped THEN w ELSE 0 END) OVER ())) END AS target FROM capped),
tries AS (
  SELECT s, target / (2 * k + 1) AS q, k FROM aims, whole, unnest(range(0, least(total // block, ceil(z * 3.0::DOUBLE / block)::BIGINT))) AS t(k)),
won AS (SELECT s, count(*) AS quota FROM (SELECT s, row_number() OVER (ORDER BY q DESC, s, k) AS r FROM tries), whole
        WHERE r <= total // block GROUP BY s),
dealt AS (
  SELECT d.doc_id, d.size, d.key, a.s, a.z AS source_size, a.target, coalesce(w.quota, 0) AS seats,
         d.key % greatest(1, ceil(a.z::DOUBLE / shard_words)::BIGINT) AS shard
  FROM sizes d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source LEFT JOIN won w ON w.s = a.s, whole),
shards AS (
  SELECT s, shard, any_value(seats) AS seats, sum(size)::BIGINT AS z, greatest(1, round(sum(size)::DOUBLE / any_value(block)))::BIGINT AS blocks
  FROM dealt, whole GROUP BY s, shard),
shard_tries AS (
  SELECT s, shard, seats, z::DOUBLE / (2 * k + 1) AS q, k FROM shards, unnest(range(0, CASE WHEN z > 0 THEN 3 * blocks ELSE 0 END)) AS t(k)),
shard_won AS (
  SELECT s, shard, count(*) AS quota
  FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY q DESC, shard, k) AS r FROM shard_tries) WHERE r <= seats GROUP BY s, shard),
blocked AS (
  SELECT s, shard, z, blocks, i, coalesce(quota, 0) AS quota,
         row_number() OVER (PARTITION BY s, shard ORDER BY ('0x' || substr(md5('mix:' || s || ':' || shard || ':' || i), 1, 15))::BIGINT) AS r
  FROM shards LEFT JOIN shard_won USING (s, shard), unnest(range(0, blocks)) AS t(i)),
spans AS (
  SELECT s, shard, (i * z) // blocks AS lo, ((i + 1) * z) // blocks AS hi,
         quota // blocks + CASE WHEN r <= quota % blocks THEN 1 ELSE 0 END AS times FROM blocked),
placed AS (SELECT *, sum(size) OVER (PARTITION BY s, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS a FROM dealt)
SELECT p.doc_id, p.size, p.source_size, p.target,
       coalesce(sum(b.times * greatest(0, least(p.a + p.size, b.hi) - greatest(p.a, b.lo))), 0)::BIGINT AS taken
FROM placed p LEFT JOIN spans b ON b.s = p.s AND b.shard = p.shard AND b.lo < p.a + p.size AND b.hi > p.a
GROUP BY p.doc_id, p.size, p.source_size, p.target
"""
