"""Blocks of a candidate group are bounded by members too."""

from pyspark.sql import functions as F

from tessera.llm import minhash


def test_groups_of_short_texts_are_cut(spark, monkeypatch):
    """Texts of one shingle came whole to one task, whose matrix grew with the square of their number."""
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 50)
    members = spark.range(400).select("id", F.array((F.col("id") % 7).cast("long")).alias("s"), F.lit(1).cast("long").alias("grp"))
    members = members.union(spark.range(1000, 1020).selectExpr("id", "array(id % 2)", "2L"))
    pairs = minhash.block_pairs(members)
    assert pairs.groupBy("grp", "low", "high").count().agg(F.max("count")).first()[0] < 200
    links = {(r.u, r.v) for r in minhash.verified(members, 80).collect()}
    root = {r.id: r.id for r in members.collect()}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for u, v in links:
        root[find(u)] = find(v)
    groups = {}
    for r in members.collect():
        groups.setdefault((r.grp, r.s[0]), set()).add(find(r.id))
    assert len(groups) == 9 and all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == 9
